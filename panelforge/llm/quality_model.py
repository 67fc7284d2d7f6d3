"""A quality classifier made of compression.

Two zstandard dictionaries, each with its entropy tables, are built from well and from badly labelled text. A document is
compressed with either one in blocks of BLOCK bytes, all of it. The difference of the two sizes, over the larger one, says
which kind a block, or the whole text, resembles. The score is that difference calibrated: logistic regression on held-in
rows takes the whole text's, the blocks' median, least and greatest, and their squares, and nothing else.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, utf8

SAMPLE = 3000  #: labelled rows of either kind that are drawn to learn from, at most
LONGEST = 40_000  #: bytes: rows with longer texts aren't learned from, so that a sample stays below 240 MB; none is cut
DICTIONARY = 64 * 1024
BLOCK = 256
LEVEL = 3
THRESHOLD = 0.7
SEED = 7


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  #: the last is the constant


def _compressors(good: bytes, bad: bytes):
    import zstandard

    out = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
        words.precompute_compress(level=LEVEL)
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        out.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, **plain))
    return out


def features(text: bytes | None, pair) -> tuple[float, ...]:
    """Normalised size differences of a whole text: of all of it, and the median, least and greatest of its blocks'; the
    squares of the first two, and the first times the least. All are 0 for an empty text."""
    good = bad = 0
    blocks = []
    for i in range(0, len(text or b""), BLOCK):
        part = text[i : i + BLOCK]
        x, y = len(pair[0].compress(part)), len(pair[1].compress(part))
        good, bad = good + x, bad + y
        blocks.append((y - x) / max(x, y))
    whole = (bad - good) / max(good, bad, 1)
    blocks = sorted(blocks) or [0.0]
    middle, least, most = blocks[len(blocks) // 2], blocks[0], blocks[-1]
    return whole, middle, least, most, whole * whole, middle * middle, whole * least


N_FEATURES = 7


def _build(samples: list[bytes]) -> bytes:
    """The content of a dictionary: trained by the library, or, for too few samples, the samples themselves."""
    import zstandard

    pieces = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        if len(pieces) >= 50:
            return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(pieces)[-DICTIONARY:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method; the last column of x is the constant, which isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[bytes | None, int]]) -> Model:
    """rows: (text, label). Dictionaries come from one half, the calibration from the other. Without rows of both kinds
    every score is the share of label 1 (one half without any row)."""
    order = np.random.default_rng(SEED).permutation(len(rows))
    half = [rows[i] for i in order[: len(rows) // 2]], [rows[i] for i in order[len(rows) // 2 :]]
    good, bad = (_build([t or b"" for t, q in half[0] if q == k]) for k in (1, 0))
    y = np.array([q for _, q in half[1]], float)
    if len(set(y.tolist())) < 2:
        share = min(max(float(np.mean([q for _, q in rows])) if rows else 0.5, 1e-3), 1 - 1e-3)
        none = (0.0,) * N_FEATURES
        return Model(good, bad, none, (1.0,) * N_FEATURES, (*none, math.log(share / (1 - share))))
    pair = _compressors(good, bad)
    x = np.array([features(t, pair) for t, _ in half[1]])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y)
    return Model(good, bad, tuple(mean), tuple(scale), tuple(w))


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> Model:
    """A model of rows that aren't held out: at most `sample` of either label, first by hash, whole texts of up to LONGEST
    bytes. The ids of that bounded sample, and nothing else, are broadcast to find its texts; an id that repeats gives one
    text. Null labels and ids are left out."""
    known = bare(labels, id=key, q=label).filter("q in (0, 1) and id is not null").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("q").alias("q"))
    picked = [known.filter(F.col("q") == k).orderBy(F.xxhash64(F.col("id")), "id").limit(sample) for k in (0, 1)]
    ids = picked[0].union(picked[1])
    texts = bare(docs, id=key, t=text).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= LONGEST).join(F.broadcast(ids), "id")
    one = F.min_by(F.struct("t"), F.struct(F.xxhash64("t"), F.col("t"))).alias("one")
    rows = texts.groupBy("id", "q").agg(one).select("id", F.col("one.t").cast("binary").alias("t"), "q").collect()
    return fit([(bytes(r["t"]) if r["t"] is not None else None, int(r["q"])) for r in sorted(rows, key=lambda r: str(r["id"]))])


def _scored(model: bytes):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m: Model = pickle.loads(model)
        pair = _compressors(m.good, m.bad)
        mean, scale, w = (np.array(v) for v in (m.mean, m.scale, m.weights))
        for batch in batches:
            x = np.array([features(t, pair) for t in utf8(batch.column("text"))]).reshape(-1, len(mean))
            score = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs, whole texts; null and empty texts get the score of length 0.
    Repeated rows each get a row; an empty table gives none. Columns other than key and text are not read."""
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scored(pickle.dumps(model)), f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: doc_id, held_out, score, predicted."""
    rows = score(docs, learn(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
