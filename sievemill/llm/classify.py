"""Classifiers that compare how well two zstandard dictionaries compress a text, calibrated by logistic regression.

Quality: one dictionary trained on texts labelled good, one on bad ones. Both compress the whole text; the difference of the
sizes over their sum and over the text's bytes are the calibration's inputs, beside the lesser size over the text's bytes, which
tells a difference that is small because the text compresses well from one that is small because no dictionary fits it.

Toxicity: lower-cased texts are cut into windows of words, each word coded in fixed length. One dictionary is trained by zstandard on
windows of toxic texts, one on windows of ordinary texts. Most of a toxic text is ordinary, too, so both compressors have the same
ordinary text beside their dictionary, nearer than it, and a dictionary is trained on the half of the windows that this text compresses
worse: what the lengths differ in is then what only the one class's texts have. The differences over all windows of the whole text are calibrated.

What is fitted comes from a bounded sample of labelled rows (``SAMPLE`` a class), chosen by a hash of doc_id. Copies in the
sample count once. Half of the sample makes the dictionaries, the other half the calibration, at the labels' own shares, so that a score is a probability.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of a class that a fit reads at most, bytes of a text among them (longer ones aren't chosen), and a dictionary's bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 60_000, 65_536
#: Words of a window that is scored, and of one that the toxicity dictionaries are trained on; bytes of these dictionaries, and of the ordinary text beside them.
WINDOW, TRAINING_WINDOW, LEARNED, SHARED = 32, 8, 32_768, 3_900_000
#: First letters that a word's code shares with other words.
START = 4
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.7, 0.5


def sample(documents: DataFrame, labels: DataFrame, label: str, may_learn: Column, n: int = SAMPLE) -> pd.DataFrame:
    """A bounded sample (text, y) of labelled documents: up to ``n`` rows of either class, in order of a hash of doc_id; ``attrs["prior"]`` is the share of label 1 among all of them.

    Null labels, texts and ids are passed over; several labels of one id count as the greatest of them.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    able = documents.where(F.col("text").isNotNull() & may_learn & (F.octet_length("text").between(1, SAMPLE_BYTES))).select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id").withColumn("o", F.xxhash64("doc_id"))
    counts = {r["y"]: r["count"] for r in able.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = able.where(F.col("y") == y).orderBy("o", "doc_id", "h").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    rows = documents.select("doc_id", "text").withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen.dropDuplicates(["doc_id", "h"])), ["doc_id", "h"])  # 2 n rows at most
    found = rows.select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"]).drop_duplicates(["text"], ignore_index=True)
    found.attrs["prior"] = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    return found


def _without_copies(texts: list[str]) -> list[int]:
    """Places of texts that no earlier one nearly equals: by 8 least hashes of their words."""
    seen: dict[tuple[int, int], list[int]] = {}
    keep = []
    for k, text in enumerate(texts):
        words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in set(text.lower().encode().split())), np.uint64)
        if not len(words):
            continue
        with np.errstate(over="ignore"):
            least = [int(((words ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)).min()) for j in range(8)]
        votes = Counter(x for j, v in enumerate(least) for x in seen.get((j, v), ()))
        if votes and votes.most_common(1)[0][1] >= 4:
            continue
        keep.append(k)
        for j, v in enumerate(least):
            seen.setdefault((j, v), []).append(k)
    return keep


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton's steps; the classes count as if label 1 had the share ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    weights, penalty = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (p - y)) + penalty @ weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _press(data: bytes, level: int = 3) -> dict:
    return {"data": data, "level": level}


def _compressor(spec: dict) -> Callable[[bytes], bytes]:
    kind = zstandard.DICT_TYPE_AUTO if spec["data"][:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(spec["data"], dict_type=kind)
    held.precompute_compress(level=spec["level"])
    return zstandard.ZstdCompressor(level=spec["level"], dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False).compress


def _trained(texts: list[bytes], size: int = DICTIONARY, **kind: int) -> bytes:
    """A zstandard dictionary of whole texts, in parts of 8000 bytes; their raw bytes where they are too few to train one, of each part as much as the dictionary has room for."""
    parts = [x[k : k + 8000] for x in texts for k in range(0, len(x), 8000)]
    try:
        return zstandard.train_dictionary(size, parts, **kind).as_bytes()
    except zstandard.ZstdError:
        room = size // max(1, len(parts)) - 1 if sum(map(len, parts)) + len(parts) > size else size
        return b" ".join(x[:room] for x in parts)[-size:].rjust(16)


#: The compressors of the scorer that this Python worker used last, by its token: a worker outlives many scorers.
_LIVE: dict[str, tuple] = {}


class _Scorer:
    """Dictionaries, scaling and weights. Only one scorer at a time has its compressors in a Python worker."""

    def __init__(self, dictionaries: tuple):
        self.dictionaries, self.weights, self.mean, self.scale, self.token = dictionaries, None, None, None, uuid.uuid4().hex

    def made(self) -> tuple:
        if self.token not in _LIVE:
            _LIVE.clear()
            _LIVE[self.token] = self.compressors()
        return _LIVE[self.token]

    def compressors(self) -> tuple:
        return tuple(map(_compressor, self.dictionaries))

    def inputs(self, text: str) -> list[float]:
        raise NotImplementedError

    def fit(self, texts: list[str], y: np.ndarray, prior: float) -> _Scorer:
        n = len(self.inputs(""))
        x = np.array([self.inputs(t) for t in texts], float).reshape(len(texts), n)
        if len(set(y.tolist())) < 2:  # nothing to tell apart: every text's score is the share of label 1
            share = min(max(prior, 1e-3), 1 - 1e-3)
            self.mean, self.scale, self.weights = np.zeros(n), np.ones(n), np.append(np.zeros(n), math.log(share / (1 - share)))
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.weights = _logistic((x - self.mean) / self.scale, y, prior)
        return self

    def score(self, texts: pd.Series) -> pd.Series:
        common.claim("scorer", lambda: (_CODES.clear(), _LIVE.clear()))
        x = np.array([self.inputs(t or "") for t in texts], float).reshape(len(texts), len(self.mean))
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class QualityScorer(_Scorer):
    def inputs(self, text: str) -> list[float]:
        data = text.encode()
        good, bad = (len(press(data)) for press in self.made())
        n = len(data)  # the constants leave a short text, whose sizes are mostly overhead, near the usual ratio of 0.44
        return [(bad - good) / (bad + good), (bad - good) / (n + 64), math.log((min(good, bad) + 28) / (n + 64))]


def fit_quality(labelled: pd.DataFrame) -> QualityScorer:
    keep = labelled.iloc[_without_copies(labelled["text"].tolist())]
    for_dictionary, y = np.arange(len(keep)) % 2 == 0, keep["y"].to_numpy()
    texts = keep["text"].tolist()
    of = lambda label: [t.encode() for t, d, v in zip(texts, for_dictionary, y, strict=True) if d and v == label]
    scorer = QualityScorer((_press(_trained(of(1))), _press(_trained(of(0)))))
    return scorer.fit([t for t, d in zip(texts, for_dictionary, strict=True) if not d], y[~for_dictionary], labelled.attrs.get("prior", 0.5))


#: Lower-cased ASCII letters and digits and all bytes beyond ASCII; the others part words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Codes(dict):
    """A word in fixed length: 8 bytes for its first ``START`` letters, so that inflected words share them, and 8 for the whole. A dictionary matches them wholly or not at all."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh3_64_digest(b"^" + word.decode(errors="ignore")[:START].encode()) + xxhash.xxh3_64_digest(word)
        if len(self) < 300_000:
            self[word] = found
        return found


_CODES = _Codes()


def _windows(text: str, size: int) -> list[bytes]:
    """The words of the whole text in order, coded, ``size`` of them a window."""
    coded = b"".join(map(_CODES.__getitem__, text.encode().translate(_LETTERS).split()))
    return [coded[k : k + 16 * size] for k in range(0, len(coded), 16 * size)]


def _matcher(data: bytes) -> Callable[[bytes], bytes]:
    """A compressor that has indexed all of ``data``: it searches long enough to find the far end of it, too."""
    held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    log = max(10, (len(data) - 1).bit_length())
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        window_log=log + 1,
        chain_log=log,
        hash_log=log,
        search_log=4,
        min_match=7,
        target_length=32,
        strategy=zstandard.STRATEGY_LAZY2,
    )
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


class ToxicScorer(_Scorer):
    """``dictionaries``: what was trained on toxic and on ordinary windows, and the ordinary text that both compressors have beside it."""

    def compressors(self) -> tuple:
        toxic, ordinary, shared = self.dictionaries
        return _matcher(toxic + shared), _matcher(ordinary + shared)

    def gains(self, text: str) -> np.ndarray:
        """Per window, the bytes that the toxic dictionary saves against the ordinary one."""
        toxic, ordinary = self.made()
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in _windows(text, WINDOW)], float)

    def inputs(self, text: str) -> list[float]:
        gains = self.gains(text)
        n = len(gains) + 2
        most = np.sort(gains)[-3:].sum() / 3 if len(gains) else 0.0
        return [math.log1p(max(most, 0.0)), math.sqrt(np.maximum(gains, 0).sum() / n), gains.sum() / n]


def _costly(texts: list[str], press: Callable[[bytes], bytes]) -> list[bytes]:
    """The half of the texts' windows that the shared text compresses worse: what a dictionary beside it has to learn."""
    windows = [x for text in texts for x in _windows(text, TRAINING_WINDOW)]
    ratio = np.array([len(press(x)) / len(x) for x in windows])
    middle = np.median(ratio) if windows else 0.0
    return [x for x, r in zip(windows, ratio, strict=True) if r >= middle]


def fit_toxic(labelled: pd.DataFrame) -> ToxicScorer:
    keep = labelled.iloc[_without_copies(labelled["text"].tolist())]
    texts, y = keep["text"].tolist(), keep["y"].to_numpy()
    for_dictionary = np.arange(len(keep)) % 8 < 5
    toxic, ordinary = ([t for t, d, label in zip(texts, for_dictionary, y, strict=True) if d and label == k] for k in (1, 0))
    cut = len(ordinary) * 3 // 4
    shared = b"".join(x for t in ordinary[:cut] for x in _windows(t, 1 << 40))[-SHARED:].rjust(64)
    press = _matcher(shared)
    learned = [_trained(_costly(some, press), LEARNED, k=32, d=8) for some in (toxic, ordinary[cut:])]
    scorer = ToxicScorer((*learned, shared))
    return scorer.fit([t for t, d in zip(texts, for_dictionary, strict=True) if not d], y[~for_dictionary], labelled.attrs.get("prior", 0.5))


def scored(documents: DataFrame, scorer: _Scorer, text: str = "text") -> Column:
    """The score of a text column; null counts as the empty text."""
    held = documents.sparkSession.sparkContext.broadcast(scorer)  # two dictionaries and a few numbers

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return held.value.score(texts)

    return run(F.col(text))


def quality_scorer(documents: DataFrame, labels: DataFrame) -> QualityScorer:
    return fit_quality(sample(documents, labels, "quality", ~common.held_out(F.col("doc_id"), 4, 2)))


def toxic_scorer(documents: DataFrame, labels: DataFrame) -> ToxicScorer:
    return fit_toxic(sample(documents, labels, "toxic", ~common.held_out(F.col("doc_id"), 5, 0)))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored as the empty text; the longest ones are scored whole. Without labels every score is 0.5, with labels
    of one class only it is their share. Equal texts have equal scores; repeated rows are scored one by one. A null doc_id is kept and
    counts as the empty id. An empty table gives an empty result. Other columns are not read.
    """
    scorer = quality_scorer(documents, labels)
    out = documents.select("doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("held_out"), scored(documents, scorer).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxic(documents: DataFrame, labels: DataFrame, threshold: float = TOXIC_THRESHOLD) -> DataFrame:
    """As ``score_quality``, for toxicity."""
    scorer = toxic_scorer(documents, labels)
    out = documents.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), scored(documents, scorer).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_compression_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, at a threshold of 0.7; see ``score_quality`` for nulls, empty, long and repeated texts and empty tables."""
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, at a threshold of 0.5; see ``score_toxic``."""
    return score_toxic(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
