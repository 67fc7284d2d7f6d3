"""Benchmark decontamination: gapped word-pair seeds, then Smith-Waterman alignment.

The benchmark is a stated query set and is taken in blocks of bounded size, each against all documents in one pass.

Seeds lose no alignment that reaches the score. One of M matches whose skips cost E scores 2 M - E; a skip of a words of the
item and b of the text costs max(a, b). If it scores S, its M - 1 steps from match to match cost 2 M - S, so counting 2 for
a step without a skip and 1 for a step of cost 1, steps count S - 2 at least. Such a step is a pair of words that stand one
or two apart in the item and in the text. All of an item's pairs are seeds; items whose pairs in a text, and then on
neighbouring diagonals, count less than that are discarded, as are places with too few shared words. Others are aligned.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import bare, utf8

SCORE = 0.5  #: of the item's own score; chance agreement stays below 0.35
MIN_WORDS = 8  #: an item shorter than twice this needs as many words in place, or all it has
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 20_000  #: of the benchmark, at most, in one broadcast
_EDGE = b".,;:!?\"'()[]{}|*#$%&<>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case, without punctuation at their ends; words of nothing else are left out."""
    return [x for x in (w.strip(_EDGE) for w in text.decode("utf-8", "replace").lower().encode().split()) if x] if text else []


class Index:
    """A block of the benchmark: its words as numbers, and its pairs of words one or two apart with the places they have."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.number = {w: n + 1 for n, w in enumerate(vocabulary)}  # 0: a word that no item has
        self.coded = [self.code(w) for _, w in self.items]
        self.bags = [Counter(c.tolist()) for c in self.coded]
        sizes = np.array([len(c) for c in self.coded], np.int64)
        self.offset = np.cumsum(np.r_[0, sizes])  # an item's first place among all places
        self.item_of = np.repeat(np.arange(len(sizes)), sizes)
        every = np.concatenate(self.coded) if self.coded else np.zeros(0, np.int64)
        codes, places, near = [], [], []
        for apart in (1, 2):
            at = np.flatnonzero(self.item_of[:-apart] == self.item_of[apart:])
            codes.append(self.pair(every[at], every[at + apart]))
            places.append(at)
            near.append(np.full(len(at), apart == 1))
        # an item of one word has no pair: the word itself is its seed
        lone = np.flatnonzero(np.repeat(sizes, sizes) == 1)
        code = np.concatenate([*codes, every[lone]])
        order = np.argsort(code, kind="stable")
        self.known, begins = np.unique(code[order], return_index=True)
        self.begins = np.r_[begins, len(code)]
        self.places = np.concatenate([*places, lone])[order]
        self.near = np.concatenate([*near, np.ones(len(lone), bool)])[order]
        self.touched = np.zeros(len(every), np.int8)

    def code(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two words as a number; 0 if no item has one of them. Numbers up to the vocabulary's size stand for one word."""
        return np.where((a > 0) & (b > 0), a * (len(self.number) + 1) + b, 0)

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seeds): where code has a seed, and which of known it is."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(code)
        seed = np.minimum(np.searchsorted(self.known, code[at]), len(self.known) - 1)
        good = self.known[seed] == code[at]
        return at[good], seed[good]

    def postings(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of seeds, posting): every posting of seeds."""
        sizes = self.begins[seeds + 1] - self.begins[seeds]
        which = np.repeat(np.arange(len(seeds)), sizes)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.begins[seeds][which]

    def limits(self, n: int, score: float) -> tuple[float, int, int]:
        """Of an item: the score it takes, what its steps count at least, and what its skips cost at most."""
        size = len(self.coded[n])
        least = max(score, min(1.0, MIN_WORDS / size))
        return least, max(1, int(np.ceil(2 * least * size - 2 - 1e-6))), int(2 * size * (1 - least) + 1e-6)

    def candidates(self, found: list[tuple[int, np.ndarray, np.ndarray]], score: float) -> list[int]:
        """Items whose places with a hit count enough: 2 a place for neighbours in both, else 1."""
        weak, strong = [], [np.zeros(0, np.int64)]
        for apart, _, seeds in found:
            _, at = self.postings(np.unique(seeds))
            weak.append(self.places[at])
            if apart < 2:
                strong.append(self.places[at[self.near[at]]])
        weak, strong = np.concatenate(weak), np.concatenate(strong)
        self.touched[weak] = 1
        self.touched[strong] = 2
        places = np.unique(weak)
        items, which = np.unique(self.item_of[places], return_inverse=True)
        sums = np.bincount(which, self.touched[places])
        self.touched[weak] = 0
        return [n for n, total in zip(items.tolist(), sums.tolist()) if total >= self.limits(n, score)[1]]

    def windows(self, n: int, found: list[tuple[int, np.ndarray, np.ndarray]], score: float) -> list[list[int]]:
        """[first, end) of the text, apart from each other: where item n can align with the score it takes."""
        _, count, skips = self.limits(n, score)
        diagonals, counts = [], []
        low, high = int(self.offset[n]), int(self.offset[n + 1])
        for apart, at, seeds in found:
            kinds, kind = np.unique(seeds, return_inverse=True)
            which, posting = self.postings(kinds)
            mine = (self.places[posting] >= low) & (self.places[posting] < high)
            for k, p in zip(which[mine].tolist(), posting[mine].tolist()):
                here = at[kind == k]
                diagonals.append(here - (int(self.places[p]) - low))
                counts.append(np.full(len(here), 2 if apart < 2 and self.near[p] else 1))
        diagonal, weight = np.concatenate(diagonals), np.concatenate(counts)
        order = np.argsort(diagonal, kind="stable")
        diagonal, total = diagonal[order], np.cumsum(np.r_[0, weight[order]])
        within = total[np.searchsorted(diagonal, diagonal + skips, "right")] - total[np.searchsorted(diagonal, diagonal, "left")]
        out: list[list[int]] = []
        for d in np.unique(diagonal[within >= count]).tolist():
            if out and d - skips <= out[-1][1]:
                out[-1][1] = d + skips + high - low
            else:
                out.append([d - skips, d + skips + high - low])
        return out

    def matches(self, words: list[bytes], score: float = SCORE) -> list[tuple[int, float, int, int]]:
        """(item's id, score, first word, end): for each item that the text has a copy of, the best alignment."""
        text = self.code(words)
        found = [(0, *self.hits(text))] + [(k, *self.hits(self.pair(text[:-k], text[k:]))) for k in (1, 2)]
        found = [f for f in found if len(f[1])]
        if not found:
            return []
        out = []
        for n in self.candidates(found, score):
            item, best = self.coded[n], (0.0, 0, 0)
            least = self.limits(n, score)[0]
            need = least * len(item) - 1e-6
            for low, high in self.windows(n, found, score):
                low = max(0, low)
                window = text[low:high]
                shared = Counter(window.tolist())
                if sum(min(k, shared[w]) for w, k in self.bags[n].items() if w in shared) < need:
                    continue  # not enough words of the item are there, in whatever order
                got, begin, end = align(item, window)
                if got / (MATCH * len(item)) > best[0]:
                    best = (got / (MATCH * len(item)), low + begin, low + end)
            if best[0] >= least:
                out.append((self.items[n][0], best[0], best[1], best[2]))
        return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and where its alignment begins and ends in the window. Row by row; a run of
    gaps within a row is a running maximum."""
    n = len(window)
    slope = -GAP * np.arange(n + 1)
    above, from_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, begin, end = 0, 0, 0
    for word in item:
        here, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        step = above[:-1] + np.where(window == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        better = np.maximum(step, down)
        live = better > 0
        here[1:] = np.where(live, better, 0)
        origin[1:] = np.where(live, np.where(step >= down, from_above[:-1], from_above[1:]), origin[1:])
        run = np.maximum.accumulate(here + slope)
        wide = run - slope
        at = np.maximum.accumulate(np.where(here + slope == run, np.arange(n + 1), 0))
        origin, here = np.where(wide > here, origin[at], origin), np.maximum(wide, here)
        top = int(here.argmax())
        if here[top] > best:
            best, begin, end = int(here[top]), int(origin[top]), top
        above, from_above = here, origin
    return best, begin, end


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded bytes and items, in the order of ids; null texts and ids are left out."""
    rows = bare(benchmark, item_id="item_id", text="text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        text = r["text"].encode()
        if held and (size + len(text) > BLOCK_BYTES or len(held) >= BLOCK_ITEMS):
            yield held
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    if held:
        yield held


def _matched(index, score: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = index()
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))) for m in own.matches(words_of(t), score)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def _indexed(docs: DataFrame, block: list[tuple[int, bytes]]):
    """The block's index: a function that gives it on an executor."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Index(block)))
    return lambda: pickle.loads(sent.value)


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): for each document and each item that it has a copy of, its best
    alignment, in words of the document from 0, end exclusive. score: that of the alignment, 1 for an exact copy.

    Whole texts. Null and empty texts, and items without a word, match nothing. Repeated rows of documents each match;
    repeated items count once. An empty table on either side gives no rows. Other columns are not read.
    """
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, score double, first_word bigint, end_word bigint"
    out = None
    for block in blocks(benchmark):
        part = source.mapInArrow(_matched(_indexed(source, block), score), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else source.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, text: str = "text") -> DataFrame:
    """docs without the rows whose text has a copy of a benchmark item, with all their columns.

    Null and empty texts hold no item and stay; repeated rows all stay or all go. Null, empty and repeated items, or none at
    all, remove nothing more. An empty table gives none. Columns may have any names.
    """
    place, out = docs.columns.index(text), docs

    def cleaner(index):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            own = index()
            for batch in batches:
                yield batch.filter(pa.array([not own.matches(words_of(t), score) for t in utf8(batch.column(place))], pa.bool_()))

        return run

    for block in blocks(benchmark):
        out = out.mapInArrow(cleaner(_indexed(bare(docs, text=text), block)), docs.schema)
    return out
