"""How filters interact: what each of a chain removes in every order of the chain, what it repeats, and what it is worth.

Filters are evaluated once a document and kept as the bits of a mask. Documents are counted by mask, and only these few cells
meet the orders: each cell is unpivoted against all steps of all orders, a running bit-or over the steps before tells whether
the cell was gone by then, conditional sums give the counts, and a filter's total over all orders its Shapley share.

Whether a text repeats one of a smaller id is decided by its digest: copies are counted and their least id is found before
anything is shuffled, so a text that a third of the corpus repeats arrives as a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, utf8

#: Letter: what a document that fails the filter is like. A letter's place is its bit. E looks at the whole table.
FILTERS = {
    "A": "under 100 words", "B": "under 80 different words of 100", "C": "over 10 capitals A-Z of 100 code points", "D": "one of #$%&*|",
    "E": "the text of a smaller id",
}
COPY = 1 << "".join(FILTERS).index("E")
_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_TAILS = bytes(range(0x80, 0xC0))  # all bytes of a code point but its first


def failures(text: bytes | None) -> int:
    """The bits of the filters that one whole text fails by itself, A to D. Null is an empty text, which fails A alone."""
    text = text or b""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text.translate(None, _TAILS)),
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(1 << i for i, x in enumerate(fails) if x)


def _measured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = utf8(batch.column("text"))
        columns = [batch.column("id"), batch.column("part"), pa.array([failures(t) for t in texts], pa.int32()),
                   pa.array([blake2b(t or b"", digest_size=16).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "part", "own", "digest"])


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of mask, and how many of these are
    labelled quality 1, and toxic 1.

    A null part is the empty string, a null text an empty one. Repeated rows are documents each; those that share an id are no
    copies of each other. A null id is greater than any other and not smaller than another null, and has no label. A label
    holds if any row of its id says so. An empty table gives no cells. Other columns are not read.
    """
    source = bare(docs, id=key, part=part, text=text).withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(_measured, f"id {kind}, part string, own int, digest binary")
    rows = rows.groupBy("id", "part", "own", "digest").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    flags = bare(labels, id=key, quality="quality", toxic="toxic").filter("id is not null")
    flags = flags.groupBy("id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # rows without an id match nothing; the second key deals them over all tasks
    dealt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.xxhash64("id"))
    marked = rows.withColumn("deal", dealt).join(flags.withColumn("deal", F.xxhash64("id")), ["deal", "id"], "left")
    marked = marked.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    kinds = marked.groupBy("digest", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    single = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    counted = kinds.withColumn("first", first).withColumn("single", single)
    either = F.array(F.struct(F.col("own").alias("mask"), F.col("single").alias("n")),
                     F.struct(F.col("own").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("single")).alias("n")))
    split = counted.select("part", "good", "toxic", F.inline(either)).filter("n > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))


def interactions(masks: DataFrame, letters: str = "".join(FILTERS)) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, each
    order of the filters and each step of it. masks: cells(). A part's cells give all its rows, zeros included; there are as
    many rows a part as orders and steps, however many documents."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = masks.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    long = long.withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    long = long.withColumn("bit", F.expr(f"CAST(shiftleft(1, instr('{letters}', filter) - 1) AS INT)"))
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda of, when, name: F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~here & ~gone, "kept"), total("n", here & ~gone, "removed"), total("n", here & gone, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"), total("good", here & ~gone, "good_lost"), total("toxic", here & ~gone, "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest: interactions of the five filters over whole documents."""
    return interactions(cells(docs, labels))


#: The same columns in DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN first IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > first) THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
             [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM b AS a, b AS b, b AS c, b AS d, b AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS before FROM o, range(1, 6) AS r(k)),
g AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before::BIGINT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & before::BIGINT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g
"""
