"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

The merges of BPE have two properties that make prefixes a dynamic programme: the encoding of a prefix of encoded tokens
is those tokens, and a row of tokens is an encoding if and only if each neighbouring pair of them is the encoding of its
own bytes. So each prefix has one last token: the one that ends there and goes with the last token of the prefix before it.
``count(prefix) = count(prefix without its last token) + 1``. What a prefix of a piece needs is remembered by the prefix,
so pieces that begin alike share it.

A text is split into chunks (see ``tokens``), and a chunk into the tokenizer's pieces; the count at a prefix of the text is the sum
over the chunks before it and the count at a prefix of one chunk. ``write_table`` stores, for each document, the counts at all its
prefixes by code points: their steps from one to the next, which are mostly 0 and 1, compressed. ``longest`` and ``counts_at`` answer
questions about budgets and truncation from that table alone, without texts and without a tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: How a byte-level tokenizer of this family splits texts, and its byte alphabet's offset (fixed values).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Bytes of the pieces whose prefixes are remembered; longer ones are rare, and each has many prefixes.
SHORT = 64
#: Prefixes of pieces that are remembered, about 200 bytes each, then they are found anew; and pairs of tokens, about 250 bytes each.
STATES, PAIRS = 400_000, 300_000
_ENDS = ".,;:!?"


class PrefixCounter(tokens.Chunked):
    """Counts for the byte-level BPE file at ``path``. ``keep``: chunks that it remembers."""

    def __init__(self, path: str, keep: int = 1_000_000):
        super().__init__(path, keep)
        self.model = self.library.model
        self.letters = tokens.byte_letters()
        added = {*self.library.get_added_tokens_decoder()}
        self.text_of = {number: token for token, number in self.library.get_vocab().items() if number not in added}
        byte_of = {x: bytes([k]) for k, x in enumerate(self.letters)}
        id_of = {b"".join(map(byte_of.__getitem__, token)): number for number, token in self.text_of.items()}
        #: Every end of a token: the token that it is itself, or -1.
        self.tails = {token[k:]: -1 for token in id_of for k in range(1, len(token))} | id_of
        self.piece = regex.compile(PIECE)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _clear(self) -> None:
        super()._clear()
        self.states: dict[bytes, tuple[int, int]] = {}  # of a prefix of a piece: its last token and its count

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their own bytes."""
        found = self.pairs.get((left, right))
        if found is None:
            got = self.model.tokenize(self.text_of[left] + self.text_of[right])
            found = len(got) == 2 and got[0].id == left and got[1].id == right
            if len(self.pairs) < PAIRS:
                self.pairs[left, right] = found
        return found

    def _last(self, prefix: bytes) -> tuple[int, int]:
        """The last token and the count of a prefix, from those of shorter ones."""
        if (found := self.states.get(prefix)) is not None:
            return found
        n, tails, ends = len(prefix), self.tails, []
        for begin in range(n - 1, -1, -1):
            token = tails.get(prefix[begin:])
            if token is None:  # no token ends so
                break
            if token >= 0:
                ends.append((begin, token))
        for begin, token in reversed(ends):
            if not begin:
                if self._whole(token):
                    found = (token, 1)
                    break
            else:
                left, count = self._last(prefix[:begin])
                if self._fits(left, token):
                    found = (token, count + 1)
                    break
        if found is None:
            raise ValueError("the vocabulary has no token for a byte")
        self.states[prefix] = found
        return found

    def _piece(self, piece: bytes) -> list[tuple[int, int]]:
        """The states of all prefixes of a piece, from one byte on. Short pieces share what pieces that began alike have left."""
        if len(piece) <= SHORT:
            return [self._last(piece[:end]) for end in range(1, len(piece) + 1)]
        out: list[tuple[int, int]] = []
        for end in range(1, len(piece) + 1):
            state = None
            for begin in range(end - 1, -1, -1):
                token = self.tails.get(piece[begin:end])
                if token is None:
                    break
                if token < 0:
                    continue
                if not begin:
                    if self._whole(token):
                        state = (token, 1)
                        break
                elif self._fits(out[begin - 1][0], token):
                    state = (token, out[begin - 1][1] + 1)
                    break
            if state is None:
                raise ValueError("the vocabulary has no token for a byte")
            out.append(state)
        return out

    def _count(self, piece: bytes) -> int:
        return self._last(piece)[1] if len(piece) <= SHORT else self._piece(piece)[-1][1]

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes encode as that token: not so for one that no merge reaches."""
        found = self.pairs.get((-1, token))
        if found is None:
            got = self.model.tokenize(self.text_of[token])
            found = self.pairs[-1, token] = len(got) == 1
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts at every code point of a text without special tokens, from 0 on."""
        out = np.zeros(len(text) + 1, np.int64)
        total, at = 0, 0
        for found in self.piece.finditer(text):
            piece, at = found.group(), found.start()
            states = self._piece(piece.encode())
            ends = np.cumsum([len(x.encode()) for x in piece])
            out[at + 1 : at + 1 + len(piece)] = [total + states[e - 1][1] for e in ends]
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # an apostrophe and a part of a contraction's letters are two pieces
                for k in range(2, len(piece)):
                    out[at + k] = total + 1 + self._count(piece[1:k].encode())
            total += states[-1][1]
        for run in regex.finditer(r"\s{2,}|(?<=\S)\s(?=\S)", text):  # a prefix that ends within white space has all of it in one piece
            a, b = run.span()
            states = self._piece(run.group().encode())
            ends = np.cumsum([len(x.encode()) for x in run.group()])
            out[a + 1 : b + 1] = [out[a] + states[e - 1][1] for e in ends]
        return out

    def counts(self, text: str | None) -> np.ndarray:
        """Token counts of all prefixes of ``text`` by code points: n + 1 of them, 0 first. Null counts as empty.

        A special token's string counts as one token at its end, and as ordinary text before that.
        """
        if not text:
            return np.zeros(1, np.int64)
        cuts = [m.span() for m in regex.finditer("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))), text)] if self.specials else []
        out, total, at = [np.zeros(1, np.int64)], 0, 0
        for a, b in [*cuts, (len(text), None)]:
            part = self._plain(text[at:a] if b is None else text[at : b - 1])  # before its last character, the string is ordinary text
            out.append(total + part[1:])
            if b is not None:
                total += int(self._plain(text[at:a])[-1]) + 1
                out.append(np.array([total]))
                at = b
        return np.concatenate(out)

    def _learn(self, new: list[bytes]) -> None:
        if len(self.states) > STATES:
            self.states = {}
        found: list[int] = []
        lengths, last = [], self._last
        for chunk in new:
            text = chunk.decode()
            word = text[1:-1] if text[-1] in _ENDS else text[1:]
            if text[0] == " " and word.isalpha() and len(chunk) <= SHORT:  # one piece, and perhaps a mark, which is a token of its own
                size = len(chunk) + len(word) + 1 - len(text)
                if size == len(word) + 1:
                    counts = [last(chunk[:k])[1] for k in range(1, size + 1)]
                else:
                    counts = [last(chunk[:k])[1] for k in np.cumsum([len(x.encode()) for x in text[: len(word) + 1]]).tolist()]
                if len(word) + 1 < len(text):
                    counts.append(counts[-1] + 1)
            else:
                counts = self._plain(text)[1:].tolist()
            found += counts
            lengths.append(len(counts))
        self._add(np.array(found, np.uint32), lengths)

    def _learn_whole(self, text: str) -> None:
        counts = self.counts(text)[1:]
        self._add(counts, [len(counts)])

    def all_counts(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The counts at all prefixes of all texts in a row, from one code point on, and how many code points each text has."""

        def gather(number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts, upto = self.values(number)
            total = self.flat[self.starts[number] + self.lengths[number] - 1].astype(np.int64)  # no chunk is empty
            before = np.cumsum(total) - total
            base = np.repeat(np.append(before, 0)[first[:-1]], np.diff(first))
            return counts + np.repeat(before - base, self.lengths[number]), np.diff(upto[first])

        return self.numbers(texts, gather)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One a Python worker and file."""
    common.claim("prefix", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _packed(counts: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Counts of prefixes as their steps: a byte each where all fit (``b``), else four (``i``)."""
    steps = np.diff(counts, prepend=0)
    small = len(steps) == 0 or (steps.min() >= -128 and steps.max() < 128)
    return (b"b" if small else b"i") + press.compress(steps.astype("<i1" if small else "<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """The counts at all prefixes, from none on."""
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<i1" if data[:1] == b"b" else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def table(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_chars, n_tokens, prefixes (the packed counts at all prefixes).

    Null and empty texts have no prefixes and 0 of all. Rows are kept one by one, repeated ones and null ids too; other columns are not read. No shuffle.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of, press = counter(tokenizer), zstandard.ZstdCompressor(level=1)
        for frame in frames:
            for part in tokens.batches(frame.column(1)):
                texts = frame.column(1)[part]
                counts, n = counts_of.all_counts(texts)
                ends = np.cumsum(n)
                own = [counts[a:b] for a, b in zip(ends - n, ends, strict=True)]
                last = [int(x[-1]) if len(x) else 0 for x in own]
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([frame.column(0)[part], sizes, pa.array(n), pa.array(last, pa.int64()), pa.array([_packed(x, press) for x in own], pa.binary())], ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefixes"])

    return documents.select("doc_id", "text").mapInArrow(common.tidied(run), "doc_id long, n_bytes long, n_chars long, n_tokens long, prefixes binary")


def longest(prefixes: Column, n_tokens: Column, n_chars: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored counts alone; a text within the budget isn't unpacked."""

    @F.pandas_udf("long")
    def find(rows: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(unpacked(x) <= budget)[-1]) for x in rows], dtype="int64") if len(rows) else pd.Series([], dtype="int64")

    packed = F.when(n_tokens > budget, prefixes).otherwise(F.lit(_packed(np.zeros(0, np.int64), zstandard.ZstdCompressor())))
    return F.when(n_tokens > budget, find(packed)).otherwise(n_chars)


def counts_at(prefixes: Column, n_chars: Column) -> Column:
    """The exact count of the prefix of ``n_chars`` code points (the whole text where it has fewer), from the stored counts alone."""

    @F.pandas_udf("long")
    def find(rows: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([int((c := unpacked(x))[min(k, len(c) - 1)]) for x, k in zip(rows, at, strict=True)], dtype="int64")

    return find(prefixes, n_chars.cast("long"))


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit and fit_chars, the code points of the longest prefix within ``limit`` tokens; see ``table``. The table is written and read back."""
    held = common.stored(table(documents, tokenizer), "prefixes")
    fit = longest(F.col("prefixes"), F.col("n_tokens"), F.col("n_chars"), limit)
    return held.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), fit.alias("fit_chars"))


def op6_prefix_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents by their prefix tables."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
