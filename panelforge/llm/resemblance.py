"""Near copies by shingle sets, for the stage that keeps one document of each group.

Fingerprints within a few bits miss most near copies: texts whose 5-word shingle sets have a Jaccard similarity of 0.8 differ
in about ten bits of 64, a distance at which pivots or blocks would have to face a large share of all pairs. So pairs are
proposed by min-hashes here: BANDS keys of ROWS least hashes each, of which two sets with similarity x share one with
chance 1 - (1 - x^ROWS)^BANDS; at 0.8 all but one in eight million pairs share one. Every proposed pair is verified on the whole
sets.

A key's sets propose a star around the least of them, so that a large group of near copies gives about one pair a copy; what
that leaves apart is tried around a set drawn by a hash of key and set, which differs from key to key. No key emits all its
pairs. Equal sets are one vertex.

That is not exact: two similar sets that are the centre of none of their keys never meet. Pairs and small groups, and crowds
around one text, are found whole; of a large crowd of copies that resemble each other only here and there, links are lost
and the crowd falls into more groups than it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, utf8
from .components import components

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 40
SEED = 42
PART = 4096  #: shingles whose min-hashes are worked out together
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes | None) -> np.ndarray:
    """The different hashes of a whole text's shingles, sorted; fewer words are one shingle, none make an empty set."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64))


class Sketcher:
    """Set hashes and band keys."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.times = rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 64, BANDS, np.uint64)

    def bands(self, own: np.ndarray) -> list[int]:
        if not len(own):
            return []
        least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(own), PART):
            x = own[i : i + PART, None] * self.times
            np.minimum(least, (x ^ (x >> np.uint64(29))).min(0), out=least)
        keys = (least.reshape(BANDS, ROWS) * self.mix).sum(1) ^ self.salt
        return keys.view(np.int64).tolist()

    @staticmethod
    def set_hash(own: np.ndarray) -> int:
        from xxhash import xxh3_64_intdigest

        return xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def stars(sets: DataFrame) -> DataFrame:
    """(u, v, own), u < v: proposed pairs of sets. sets: (s, bands), each s once. own: whether one of the two is the least
    set of a key; the others are around a set drawn by a hash. Keys are dealt once, for the centres and for the pairs."""
    keyed = sets.select("s", F.explode("bands").alias("key")).repartition("key")
    drawn = F.min_by("s", F.struct(F.xxhash64("s", "key"), "s"))
    groups = keyed.groupBy("key").agg(F.array(F.min("s"), drawn).alias("centres"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = keyed.join(groups, "key").select("s", F.posexplode("centres").alias("which", "c")).filter("s != c")
    ends = pairs.select(F.least("s", "c").alias("u"), F.greatest("s", "c").alias("v"), (F.col("which") == 0).alias("own"))
    return ends.groupBy("u", "v").agg(F.max("own").alias("own"))


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        held = [shingle_set(t).view(np.int64) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(held, pa.list_(pa.int64()))], ["s", "shingles"])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(s, shingles) of (s, text)."""
    return staged(texts.mapInArrow(_sets, "s bigint, shingles array<bigint>"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of SIMILAR or more. sets: shingle_sets()."""
    a, b = (sets.select(F.col("s").alias(k), F.col("shingles").alias(n)) for k, n in (("u", "x"), ("v", "y")))
    both = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    # similar sets are of similar size: the others needn't be compared
    able = (F.least(F.size("x"), F.size("y")) >= SIMILAR * F.greatest(F.size("x"), F.size("y"))) & (both >= SIMILAR * (sizes - both))
    return staged(pairs.select("u", "v").join(a, "u").join(b, "v").filter(able).select("u", "v"), "shingle-links")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): verified pairs that connect the same sets as all verified ones among pairs do. Pairs around the least sets of
    keys come first; of the others only those whose ends aren't connected by then are compared."""
    near = verified(pairs.filter("own"), sets)
    root = components(near)
    u, v = (root.withColumnsRenamed({"vertex": k, "root": f"root_{k}"}) for k in ("u", "v"))
    rest = pairs.filter("not own").join(u, "u", "left").join(v, "v", "left")
    apart = ~F.coalesce(F.col("root_u") == F.col("root_v"), F.lit(False))
    return near.union(verified(rest.filter(apart), sets))
