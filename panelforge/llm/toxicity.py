"""Toxic passages as maximum-scoring segments.

Every word has a log-odds score: how much likelier it is in a toxic than in a clean document, by counts of labelled documents
under Dirichlet priors. A word's prior is what its first five characters say, theirs what the first four say, then the first
three, then all words: an unseen form of a known stem is scored by the stem, and a rare word isn't trusted by itself. DRIFT is
taken off each score, so that clean text runs downhill. One scan, linear in a text's words, finds all its maximal segments.

Under clean text the greatest segment score of n words follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-L x)), whose K
and L are fitted to the clean labelled documents. A segment's normalised score, L S - ln(K n), is minus the logarithm of how
many as good ones n clean words hold; it is significant, a toxic passage, where fewer than EXPECTED are. The document's score
is a logistic calibration of the best segment's and of the sum of its best segments' normalised scores, over labelled
documents scored without their own counts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, staged, utf8

SAMPLE = 20_000  #: labelled rows of either kind that are learned from, at most, first by a hash of their ids; whole texts
KEYS = 1 << 22  #: hashes of words and stems, at most this many: bounds what is sent to a task
LEAST = 3  #: a word or stem seen less often in the labelled rows is left to its prior
PRIOR = 10.0  #: occurrences that a prior counts for
STEMS = (3, 4, 5)
MOST = 8.0  #: scores are held within
DRIFT = 1.5
BEST = 8  #: segments whose normalised scores are summed
EXPECTED = 0.01
THRESHOLD = 0.7
PIECE = 1 << 20  #: characters whose words are held at once
CACHED = 500_000  #: words whose scores a task holds
_WORD = re.compile(r"\w+")


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def pieces(text: bytes | None) -> Iterator[list[str]]:
    """The words of a whole text in lower case, some at a time. No word is cut."""
    held = (text or b"").decode("utf-8", "replace")
    at = 0
    while at < len(held):
        end = at + PIECE
        while end < len(held) and (held[end].isalnum() or held[end] == "_"):
            end += 1
        yield _WORD.findall(held[at:end].lower())
        at = end


def keys_of(word: str) -> list[int]:
    """The hashes of a word's stems and of the word, the most general first."""
    levels = [word[:n] for n in STEMS] + [word]
    return [zlib.crc32(x.encode("utf-8", "replace"), i) % KEYS for i, x in enumerate(levels)]


@dataclass(frozen=True)
class Lexicon:
    """Counts by key, sorted, in toxic and in clean labelled documents; and those of all words."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int

    def scores(self, words: list[str], less: tuple[Counter, int] | None = None) -> np.ndarray:
        """The log odds of words' toxic share against that of all words, less DRIFT. less: counts that aren't to be used, and
        the label they belong to."""
        keys = np.array([keys_of(w) for w in words], np.int64).reshape(-1, len(STEMS) + 1)
        base = (self.n_toxic + 1.0) / (self.n_toxic + self.n_clean + 2.0)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(keys.shape, bool)
        toxic, clean = (np.where(known, x[at], 0) if len(x) else np.zeros(keys.shape) for x in (self.toxic, self.clean))
        if less:
            own = np.array([less[0][k] for k in keys.ravel().tolist()], np.int64).reshape(keys.shape)
            toxic, clean = (np.maximum(x - own * (less[1] == k), 0) for x, k in ((toxic, 1), (clean, 0)))
        share = np.full(len(words), base)
        for level in range(keys.shape[1]):
            t, c = toxic[:, level], clean[:, level]
            share = (t + PRIOR * share) / (t + c + PRIOR)
        return np.clip(np.log(share / (1 - share)) - np.log(base / (1 - base)), -MOST, MOST) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, end) of all maximal scoring segments, from left to right: disjoint, each with no better part, and none
    that could be joined to a better whole. Linear: a segment is merged once. Scores of one sign in a row are one step."""
    if not len(scores):
        return []
    up = scores > 0
    edges = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    ends = np.r_[edges[1:], len(scores)]
    sums = np.add.reduceat(scores, edges)
    total, out = 0.0, []  # out: (sum before, sum up to the end, first, end, place of the last one before with a smaller sum before)
    for first, end, s in zip(edges.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        before, total = total, total + s
        at = len(out) - 1
        while True:
            while at >= 0 and out[at][0] >= before:
                at = out[at][4]
            if at < 0 or out[at][1] >= total:
                break
            before, first = out[at][0], out[at][2]  # joined with it, and with all between
            del out[at:]
            at -= 1
        out.append((before, total, first, end, at))
    return [(upto - before, first, end) for before, upto, first, end, _ in out]


def _scores(text: bytes | None, cache: dict[str, float], lexicon: Lexicon, less=None) -> np.ndarray:
    """Every word's score less DRIFT."""
    parts = []
    for words in pieces(text):
        new = list(set(words).difference(cache))
        if new:
            cache.update(zip(new, lexicon.scores(new, less).tolist()))
        parts.append(np.fromiter(map(cache.__getitem__, words), float, len(words)))
        if len(cache) > CACHED:
            cache.clear()
    return np.concatenate(parts) if parts else np.zeros(0)


def _best(scores: np.ndarray) -> list[float]:
    """The scores of the BEST greatest segments, the greatest first; 0 where there are fewer."""
    found = sorted((s for s, _, _ in segments(scores)), reverse=True)[:BEST]
    return found + [0.0] * (BEST - len(found))


def _counted(batches: Iterator) -> Iterator:
    """(key, toxic, clean) of a task's labelled texts."""
    import pyarrow as pa

    held = Counter(), Counter()
    sums = [0, 0]
    for batch in batches:
        for text, label in zip(utf8(batch.column("t")), batch.column("toxic").to_pylist()):
            for words in pieces(text):
                sums[label] += len(words)
                for w, n in Counter(words).items():
                    for key in keys_of(w):
                        held[label][key] += n
    for label, n in enumerate(sums):
        held[label][-1] = n  # of all words
    keys = sorted(held[0].keys() | held[1].keys())
    columns = [keys, [held[1][k] for k in keys], [held[0][k] for k in keys]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "toxic", "clean"])


def _described(model: bytes):
    """(toxic, n, best) of labelled texts, each scored without its own counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexicon: Lexicon = pickle.loads(model)
        for batch in batches:
            labels, sizes, best = batch.column("toxic").to_pylist(), [], []
            for text, label in zip(utf8(batch.column("t")), labels):
                own: Counter = Counter()
                for words in pieces(text):
                    for w, n in Counter(words).items():
                        for key in keys_of(w):
                            own[key] += n
                scores = _scores(text, {}, lexicon, (own, label))
                sizes.append(len(scores))
                best.append(_best(scores))
            arrays = [pa.array(labels, pa.int32()), pa.array(sizes, pa.int64()), pa.array(best, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "n", "best"])

    return run


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    rate: float  #: L of the extreme-value law
    log_k: float
    weights: tuple[float, ...]  #: the last is the constant

    def normalised(self, score, n):
        """L S - ln(K n): of scores S in texts of n words."""
        return self.rate * score - self.log_k - np.log(np.maximum(n, 1))

    def features(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of texts, rows of: the best segment's normalised score, and the logarithm of the positive ones' sum."""
        z = np.where(best > 0, self.normalised(best, np.asarray(n)[:, None]), -10.0)
        return np.c_[np.clip(z[:, 0], -10, 60), np.log1p(np.maximum(z, 0).sum(1))]

    def scored(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(n, best) @ w[:-1] + w[-1], -30, 30)))


def extreme_law(n: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """(L, ln K) by maximum likelihood from the greatest segment scores s of clean texts of n words. For a given L the best K
    is known; L is where the likelihood's slope changes its sign."""
    keep = n > 0
    n, s = n[keep].astype(float), s[keep]
    if len(s) < 10 or np.ptp(s) < 1e-9:
        return 1.0, 0.0
    logs = np.log(n)

    def slope(rate: float) -> float:
        w = logs - rate * s
        w = np.exp(w - w.max())
        return 1 / rate - s.mean() + float((w * s).sum() / w.sum())

    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    w = logs - low * s
    return low, float(np.log(len(s)) - (w.max() + np.log(np.exp(w - w.max()).sum())))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method with halved steps; the last column of x is the constant, which isn't shrunk."""
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (keep * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        size = 1.0
        while cost(w + size * step) > cost(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of rows that aren't held out: at most `sample` of either label, first by a hash of their ids. The ids of that
    bounded sample are sent to every task to find its texts, each learned from whole, however long; words are counted there.
    The driver gets KEYS counts at most, and a row of fixed width for each sampled text. Null labels and ids, and labels other
    than 0 and 1, are left out; an id labelled both ways counts as toxic; of texts that share an id each counts. Without rows
    of both kinds every score is the share of label 1 (one half without any row)."""
    known = bare(labels, id=key, toxic=label).filter("toxic in (0, 1) and id is not null").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    ids = staged(picked[0].union(picked[1]), "toxicity-sample")
    texts = bare(docs, id=key, t=text).join(F.broadcast(ids), "id").select("t", "toxic")
    sums = texts.mapInArrow(_counted, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = sums.filter((F.col("key") < 0) | (F.col("toxic") + F.col("clean") >= LEAST)).orderBy("key").toArrow()
    keys, toxic, clean = (rows.column(c).to_numpy() for c in ("key", "toxic", "clean"))
    whole = keys < 0
    lexicon = Lexicon(keys[~whole].astype(np.int32), toxic[~whole], clean[~whole], int(toxic[whole].sum()), int(clean[whole].sum()))
    seen = texts.mapInArrow(_described(pickle.dumps(lexicon)), "toxic int, n bigint, best array<double>").toArrow()
    y, n = seen.column("toxic").to_numpy(), seen.column("n").to_numpy()
    best = np.array(seen.column("best").to_pylist(), float).reshape(-1, BEST)
    order = np.lexsort((*best.T, n, y))  # sums in floating point don't depend on the order of tasks
    y, n, best = y[order], n[order], best[order]
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(lexicon, 1.0, 0.0, (0.0, 0.0, float(np.log(share / (1 - share)))))
    law = Model(lexicon, *extreme_law(n[y == 0], best[y == 0, 0]), ())
    weights = _logistic(np.c_[law.features(n, best), np.ones(len(y))], y.astype(float))
    return Model(lexicon, law.rate, law.log_k, tuple(weights.tolist()))


def _scored(model: bytes):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m: Model = pickle.loads(model)
        cache: dict[str, float] = {}
        for batch in batches:
            found = [_scores(t, cache, m.lexicon) for t in utf8(batch.column("text"))]
            best = np.array([_best(x) for x in found]).reshape(-1, BEST)
            score = m.scored(np.array([len(x) for x in found], float), best)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs, whole texts. Null and empty texts, and those without a word, get the score
    of a text without a segment. Repeated rows each get a row; an empty table gives none. Other columns are not read."""
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scored(pickle.dumps(model)), f"doc_id {kind}, score double")


def passages(docs: DataFrame, model: Model, expected: float = EXPECTED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, score, expected): every toxic passage, in words of the document from 0, end exclusive: the
    maximal segments that fewer than `expected` of as many clean words would hold as good. Texts without one give no rows;
    repeated rows give theirs each."""
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = pickle.dumps(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m: Model = pickle.loads(sent)
        cache: dict[str, float] = {}
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                scores = _scores(t, cache, m.lexicon)
                for s, first, end in segments(scores):
                    many = float(np.exp(-np.clip(m.normalised(s, len(scores)), -300, 300)))
                    if many < expected:
                        rows.append((d, first, end, s, many))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ["doc_id", "first_word", "end_word", "score", "expected"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return source.mapInArrow(run, f"doc_id {kind}, first_word bigint, end_word bigint, score double, expected double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: doc_id, held_out, score, predicted."""
    rows = score(docs, learn(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)
