"""Token ids of whole texts by the tokenizers library, remembered by chunk.

A byte-level BPE tokenizer splits a text before it merges, and always does so in front of a single space or line feed
that stands between two characters which are no white space. So the ids of a text are the ids of those chunks in a row,
and the library has to encode each different chunk once. Texts in which white space meets white space, or which may hold
special tokens, go to the library whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import common

#: White space beside the space and the line feed, as Unicode has it, and the separators that some regex engines add.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


def splits(text: str, specials: tuple[str, ...] = ("<|",)) -> bool:
    """Whether a text may be split: in front of each space and line feed there."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text) or any(x in text for x in specials))


#: The share of new chunks at which a full coder is of no use any more.
ANEW = 0.3

_ENDS = ".,;:!?"
_ONE_KIND = regex.compile(r" ?(?:\p{L}|\uFFFD)+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+|'(?:s|t|re|ve|m|ll|d)")


def _crosses(token: str) -> bool:
    """Whether a token has characters of several kinds: letters, digits, white space, others."""
    return _ONE_KIND.fullmatch(token) is None


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: What a byte may be: a separator (1), a white space or separator that isn't split at (2), the first byte of such ones beyond ASCII (3).
_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 10]] = 1
_KINDS[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
_KINDS[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = 3


class _Hashes:
    """Two hashes, of 64 and 32 bits, of slices of a buffer: differences of running sums of letters' numbers times powers."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 1 << 64, 256, np.uint64), rng.integers(0, 1 << 32, 256, np.uint32)
        self.bases = int(rng.integers(0, 1 << 61)) * 8 + 5, int(rng.integers(0, 1 << 29)) * 8 + 5
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._reach(1 << 19)

    def _reach(self, n: int) -> None:
        self.powers = []
        for base, kind, bits in ((self.bases[0], np.uint64, 64), (self.bases[1], np.uint32, 32)):
            both = []
            for x in (base, pow(base, -1, 1 << bits)):
                steps = np.full(n, x, kind)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps, dtype=kind))
            self.powers.append((both[0], both[1]))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.powers[0][0]):
            self._reach(2 * len(data))
        out = []
        for letters, (powers, back) in zip(self.letters, self.powers, strict=True):
            sums = np.zeros(len(data) + 1, letters.dtype)
            np.cumsum(letters[data] * powers[: len(data)], dtype=sums.dtype, out=sums[1:])
            out.append((sums[ends] - sums[starts]) * back[starts])
        first = out[0] ^ (out[0] >> np.uint64(29))
        return (first * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1), out[1]


class _Table:
    """Numbers of pairs of hashes; 0 for one that isn't there. Open addressing, all look-ups of a call at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.checks, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        same = (held == keys) & (self.checks[at] == checks)
        out = np.where(same, self.numbers[at], np.int32(0))
        todo = np.flatnonzero(~same & (held != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same = (held == keys[todo]) & (self.checks[at] == checks[todo])
            out[todo[same]] = self.numbers[at[same]]
            open_ = ~same & (held != 0)
            at, todo = at[open_], todo[open_]
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray) -> None:
        """Pairs that are different from each other and from all there are."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys)
            old = self.keys[held], self.checks[held], self.numbers[held]
            self.__init__(max(self.bits + 1, int(4 * (self.n + len(keys))).bit_length()))
            self.add(*old)
        self.n += len(keys)
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            self.numbers[at[free]] = numbers[free]  # of several that want a place, the last one has it
            mine = np.zeros(len(keys), bool)
            mine[free] = self.numbers[at[free]] == numbers[free]
            self.keys[at[mine]], self.checks[at[mine]] = keys[mine], checks[mine]
            rest = ~mine
            keys, checks, numbers, at = keys[rest], checks[rest], numbers[rest], (at[rest] + 1) & (len(self.keys) - 1)


class Chunked:
    """What is known of chunks, and the values of texts by it. A subclass learns the values of new chunks, a few numbers each.

    ``keep``: chunks that are remembered. Then what a call adds is forgotten, and all starts anew when over ``ANEW`` of a call's chunks are new.
    """

    def __init__(self, path: str, keep: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.keep = Tokenizer.from_file(path), keep
        self.specials = tuple(x.content for x in self.library.get_added_tokens_decoder().values())
        #: Bytes that call for a closer look at a text: also those that special tokens start with.
        self.kinds = _KINDS.copy()
        self.kinds[[x.encode()[0] for x in self.specials]] = 3
        self.hashes = _Hashes()
        self._clear()

    def _clear(self) -> None:
        self.table = _Table()
        self.starts, self.lengths, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 2
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 1
        self.lengths[1] = 1  # chunk 0 stands for one that isn't known, chunk 1 for an end mark

    def _room(self, chunks_: int, values: int) -> None:
        while self.n + chunks_ > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lengths, self.lengths * 0])
        while self.used + values > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])

    def _add(self, values: np.ndarray, lengths: np.ndarray | list[int]) -> None:
        """New chunks, their values in a row."""
        lengths = np.asarray(lengths, np.int64)
        self._room(len(lengths), len(values))
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(values)] = values
        self.n, self.used = self.n + len(lengths), self.used + len(values)

    def _learn(self, new: list[bytes]) -> None:
        raise NotImplementedError

    def _learn_whole(self, text: str) -> None:
        raise NotImplementedError

    def _is_whole(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Which texts aren't split: those with an inner pair of separators, other white space, a special token, or anything like it."""
        whole = np.zeros(len(texts), bool)
        apart = kinds == 1
        twice = np.flatnonzero(apart[1:] & apart[:-1]) + 1
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        for at in (twice[~begins[twice]], np.flatnonzero(kinds == 2)):
            whole[np.searchsorted(offsets, at, side="right") - 1] = True
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(kinds == 3), side="right") - 1)
        for k in odd[~whole[odd]].tolist():
            whole[k] = not splits(texts[k].as_py(), self.specials)
        return whole

    def numbers(self, texts: pa.Array | list[str | None], then) -> object:
        """Calls ``then`` with the numbers of all texts' chunks in a row and the place of each text's first one, and gives its result. Null counts as empty; a text that isn't split is one chunk."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kinds = self.kinds[data]
        whole = np.flatnonzero(self._is_whole(texts, data, offsets, kinds)).tolist()
        begins = np.zeros(len(data) + 1, bool)
        begins[:-1] = kinds == 1
        for k in whole:
            begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        keys, checks = self.hashes.of(data, starts, ends)
        number = self.table.find(keys, checks)
        full, before = self.n > self.keep, (self.n, self.used)
        number[first[whole]] = -1
        new = np.flatnonzero(number == 0)
        if len(new):
            new = new[np.lexsort((checks[new], keys[new]))]
            fresh = np.append(True, (keys[new][1:] != keys[new][:-1]) | (checks[new][1:] != checks[new][:-1]))
            some = new[fresh]
            number[new] = self.n + np.cumsum(fresh) - 1
            if not full:
                self.table.add(keys[some], checks[some], np.arange(self.n, self.n + len(some), dtype=np.int32))
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        after = self.n, self.used
        for k in whole:
            number[first[k]] = self.n
            self._learn_whole(texts[k].as_py())
        out = then(number, first)
        self.n, self.used = before if full else after  # a text that isn't split isn't kept
        if full and len(new) > ANEW * len(number):
            self._clear()
        return out

    def values(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of chunks in a row, and where each chunk's begin and the last ones end."""
        lengths = self.lengths[number]
        upto = np.zeros(len(number) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        where = np.repeat((self.starts[number] - upto[:-1]).astype(np.int32 if self.used + upto[-1] < 1 << 31 else np.int64), lengths)
        where += np.arange(len(where), dtype=where.dtype)
        return self.flat[where], upto


class ChunkCoder(Chunked):
    """Ids of texts; about 60 bytes a chunk are remembered."""

    def __init__(self, path: str, keep: int = 1_500_000):
        super().__init__(path, keep)
        from tokenizers import Tokenizer, pre_tokenizers

        vocabulary = self.library.get_vocab()
        #: Bytes of each token: a byte-level vocabulary has one character for each.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)
        letters = byte_letters()
        self.letters = {b: x for b, x in enumerate(letters) if b != 10}
        #: The same model on texts in byte letters, parted at line feeds: without the pattern. It gives the same ids where no
        #: token goes over the pattern's bounds, a text has no apostrophe, whose contractions the pattern cuts off, and what it
        #: has beyond ASCII are letters: tokens may hold parts of characters.
        self.fast = None
        byte_of = {x: bytes([b]) for b, x in enumerate(letters)}
        if all(_crosses(b"".join(map(byte_of.get, t)).decode(errors="replace")) is False for t, n in vocabulary.items() if n not in self.library.get_added_tokens_decoder()):
            self.fast = Tokenizer.from_file(path)
            self.fast.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _learn(self, new: list[bytes]) -> None:
        """The new chunks in a few texts: they stay apart there, and the bytes of the tokens tell where each ends. One that starts with no white space gets a line feed, whose id goes."""
        plain = np.zeros(len(new), bool)
        if self.fast is not None:
            plain[:] = [x[:1] == b" " and len(x) > 1 and b"'" not in x and (x.isascii() or x[1:].decode().rstrip(_ENDS).isalpha()) for x in new]
        lengths, starts, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), 0
        found = [np.zeros(0, np.uint32)]
        for some, quick in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
            for k in range(0, len(some), 2000):
                rows = some[k : k + 2000]
                part = [new[x] for x in rows.tolist()]
                heads = 0
                if quick:  # white space between byte letters parts pieces
                    ids = self.fast.encode_batch_fast([b"\n".join(part).decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids
                else:
                    heads = np.array([x[:1] not in b" \n" for x in part], np.int64)
                    part = [b"\n" + x if h else x for x, h in zip(part, heads, strict=True)]
                    ids = self.library.encode(b"".join(part).decode(), add_special_tokens=False).ids
                ids = np.array(ids, np.uint32)
                n = np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, part))), side="right"), prepend=0)
                lengths[rows], starts[rows] = n - heads, at + np.cumsum(n) - n + heads
                found.append(ids)
                at += len(ids)
        begin, first = self.used, self.n
        self._add(np.concatenate(found), lengths)  # makes room for the chunks; their values lie in the order of the texts above
        self.starts[first : self.n], self.used = begin + starts, begin + at

    def _learn_whole(self, text: str) -> None:
        ids = self.library.encode(text, add_special_tokens=False).ids
        self._add(np.array(ids, np.uint32), [len(ids)])

    def encode_all(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row as unsigned 32-bit integers, and how many each has; none for null or empty. ``end`` follows each text."""

        def gather(number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if end is not None:
                self.flat[0] = end
                number, first = np.insert(number, first[1:], 1), first + np.arange(len(first))
            ids, upto = self.values(number)
            return ids, np.diff(upto[first])

        return self.numbers(texts, gather)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


_CODERS: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One a Python worker and file."""
    common.claim("tokens", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def batches(texts: pa.Array, most: int = 1 << 19):
    """Slices of ``texts`` of about ``most`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
