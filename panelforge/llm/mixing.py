"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power alpha, normalised. alpha is bisected until the mixture has a
target entropy and no source repeats more than a limit. Weights are then realised as budgeted block permutations: a
source's documents are dealt into BLOCKS blocks by hash; each epoch of a source is a permutation of its blocks, and its
blocks are taken in that order until its budget of tokens is met. Sums run over blocks, never over the rows of a source,
so a source with a third of all rows is no one's single task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bare, free_name, staged

BLOCKS = 1024
REPEATS = 2.0  #: no source is read more often than this
ENTROPY = 0.98  #: of the entropy of equal weights, wanted
SECTIONS, ROUNDS = 32, 4  #: each round narrows the exponent's interval 32 times, as 5 bisections do


@dataclass(frozen=True)
class Mixture:
    """The exponent found, the entropy it gives (nats), and how many tokens the whole mixture has."""

    alpha: float
    entropy: float
    budget: float


def _tokens(text: str):
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _block(key: str, text: str, blocks: int, seed: int):
    """The block of a record: the hash of its id and text. A null of either hashes like any other value."""
    whose = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(F.lit(seed), whose, F.xxhash64(F.col(f"`{text}`"))), F.lit(blocks)).cast("int")


def fit(sources: DataFrame, repeats: float = REPEATS, entropy: float = ENTROPY) -> Mixture:
    """The largest exponent in [0, 1] whose weights reach the wanted entropy, or, where the repetition limit forbids that,
    the smallest one it allows.

    sources: (source, tokens). Each round weighs SECTIONS exponents in one aggregate over the table of sources, so it may
    have any number of rows; the driver gets one row for each exponent. The budget is the least that reads the source
    with the lowest repetition once in full. Sources without tokens take no part; none at all give exponent 1.
    """
    sources = sources.filter("tokens > 0")
    sums = (F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least"))
    all_ = sources.agg(*sums).first()
    if not all_["n"]:
        return Mixture(1.0, 0.0, 0.0)
    total, ratio = float(all_["t"]), all_["most"] / all_["least"]
    # most repetitions, with the largest source read once: (most / least) ** (1 - alpha)
    floor = max(0.0, 1 - math.log(repeats) / math.log(ratio)) if ratio > 1 else 0.0

    def weighed(low: float, high: float) -> list:
        points = sorted({low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)})
        at = F.explode(F.array(*[F.lit(x) for x in points]))
        share = F.pow(F.col("tokens") / F.lit(total), F.col("alpha"))
        sums = sources.select("tokens", at.alias("alpha")).groupBy("alpha").agg(F.sum(share).alias("z"), F.sum(share * F.log(share)).alias("s"))
        return sorted((r["alpha"], r["z"], math.log(r["z"]) - r["s"] / r["z"]) for r in sums.collect())

    low, high, want = floor, 1.0, entropy * math.log(all_["n"])
    for _ in range(ROUNDS):
        grid = weighed(low, high)
        good = [i for i, (_, _, h) in enumerate(grid) if h >= want]  # entropy falls as alpha grows
        if not good:
            high = low = grid[0][0]
            break
        low, high = grid[good[-1]][0], grid[min(good[-1] + 1, len(grid) - 1)][0]
        if low == high:
            break
    alpha, z, h = weighed(low, low)[0]
    most = all_["most"]
    return Mixture(alpha, h, most * z / math.pow(most / total, alpha))


def blocked(docs: DataFrame, key: str, source: str, text: str, blocks: int, seed: int) -> DataFrame:
    """docs with __source (null is a source of its own), __tokens and __block."""
    return docs.withColumns({"__source": F.col(f"`{source}`"), "__tokens": _tokens(text), "__block": _block(key, text, blocks, seed)})


def schedule(stats: DataFrame, mixture: Mixture, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """(__source, __block, __epoch, __place): which blocks are read in which epoch, and where in the source's stream.

    stats: (__source, __block, tokens): at most `blocks` rows a source. Every epoch before the last is whole. The last one
    takes blocks, in the epoch's own order, while their middle lies within what is left of the budget, so a source misses
    its budget by half a block at most. A source without tokens is read once.
    """
    whole = Window.partitionBy("__source")
    own = F.sum("tokens").over(whole)
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    weight = F.pow(own / F.lit(float(max(total, 1))), F.lit(mixture.alpha))
    powered = F.sum(F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(mixture.alpha)))
    norm = stats.groupBy("__source").agg(F.sum("tokens").alias("t")).filter("t > 0").agg(powered).first()[0] or 1.0
    reads = F.when(own > 0, F.round(F.lit(mixture.budget) * weight / F.lit(norm) / own, 9)).otherwise(1.0)
    dealt = stats.select("*", own.alias("own"), reads.alias("reads")).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("reads").cast("int") - 1, F.lit(0)))).alias("__epoch")
    )
    turn = Window.partitionBy("__source", "__epoch").orderBy("__order", "__block")
    dealt = dealt.withColumn("__order", F.xxhash64(F.lit(seed), F.col("__epoch"), F.col("__source"), F.col("__block")))
    dealt = dealt.select("*", F.sum("tokens").over(turn).alias("run"), F.row_number().over(turn).alias("nth"))
    left = (F.col("reads") - F.col("__epoch")) * F.col("own")
    return dealt.filter((left >= F.col("own")) | (F.col("run") - F.col("tokens") / 2 <= left)).select(
        "__source", "__block", "__epoch", (F.col("__epoch") * blocks + F.col("nth") - 1).alias("__place")
    )


def _planned(docs, key, source, text, repeats, entropy, blocks, seed):
    rows = blocked(docs, key, source, text, blocks, seed)
    stats = staged(rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("rows")), "mix-blocks")
    mixture = fit(stats.groupBy("__source").agg(F.sum("tokens").alias("tokens")), repeats, entropy)
    return rows, schedule(stats, mixture, seed, blocks), mixture


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    repeats: float = REPEATS, entropy: float = ENTROPY, blocks: int = BLOCKS, seed: int = 0,
) -> tuple[DataFrame, Mixture]:
    """(doc_id, source, tokens, epoch, block, place) for every reading of a document in the mixture; and the mixture.

    `place` orders a source's blocks over its epochs. Each document is read at least once, as the budget reads the source
    that is down-weighted most in full. Null sources are one source; null and empty texts have no tokens and follow their
    block. Repeated rows are each read; an empty table gives none. Other columns are left out.
    """
    slim = bare(docs, doc_id=key, source=source, text=text)
    rows, plan, mixture = _planned(slim, "doc_id", "source", "text", repeats, entropy, blocks, seed)
    rows = rows.select("doc_id", "source", "__tokens", "__source", "__block")
    plan = plan.withColumnsRenamed({"__source": "s", "__block": "b"})
    read = rows.join(plan, rows["__source"].eqNullSafe(plan["s"]) & (rows["__block"] == plan["b"]))
    renamed = {"__tokens": "tokens", "__epoch": "epoch", "__block": "block", "__place": "place"}
    return read.select("doc_id", "source", *renamed).withColumnsRenamed(renamed), mixture


def mixed(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    repeats: float = REPEATS, entropy: float = ENTROPY, blocks: int = BLOCKS, seed: int = 0,
) -> DataFrame:
    """The mixture itself: docs' rows with all their columns, each as often as it is read, once at least.

    Null sources are one source; null and empty texts have no tokens and follow their block; a source without tokens is read
    once. Repeated rows are each read as often as the others of their block. An empty table gives no rows. Columns may have
    any names.
    """
    _, plan, _ = _planned(bare(docs, doc_id=key, source=source, text=text), "doc_id", "source", "text", repeats, entropy, blocks, seed)
    times = plan.groupBy("__source", "__block").agg(F.count("*").cast("int").alias("__times"))
    s, b, n = free_name(docs, "__s"), free_name(docs, "__b"), free_name(docs, "__n")
    times = times.select(F.col("__source").alias(s), F.col("__block").alias(b), F.col("__times").alias(n))
    at = free_name(docs, "__at")
    same = F.col(f"`{source}`").eqNullSafe(F.col(s)) & (F.col(at) == F.col(b))
    read = docs.withColumn(at, _block(key, text, blocks, seed)).join(times, same)
    return read.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
