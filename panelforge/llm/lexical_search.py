"""Ranked lexical search: an inverted index as a DataFrame, joined with the terms of the items that are looked for.

A first pass counts every document's terms, which gives the corpus' size and length, and keeps the counts of the terms that
items hold, packed a document a row, in the shared folder. Postings are these rows unpacked: (bucket, term, document, tf, n).
They meet the items' terms by bucket and term, every match is scored in integers, scores are summed by item and document, and
a window ranks them.

Items whose terms are few enough, which is checked, go to every task, and postings are dealt by document: a document's matches
then meet in its own task, no match crosses the network, and only each task's best of an item do. Otherwise both sides are
dealt by bucket and term, and sums by item and document.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, staged, utf8, width

TOP = 50
BUCKETS = 4096  #: that terms are dealt into
SENT_BYTES = 8 << 20  #: of the items' terms, at most, that are sent to every task
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: letters and digits of ASCII, and all beyond it
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes.maketrans(_CAPITALS.encode(), _SMALL.encode())
#: The same matches in UTF-8: every byte beyond ASCII belongs to a term.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text, only A-Z in lower case; null has none."""
    return _TERM.findall(text.translate(_LOWER)) if text else []


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, bucket, term), each once. Rows that share an id are one item; null ids and texts have none."""
    found = F.regexp_extract_all(F.translate("text", _CAPITALS, _SMALL), F.lit(TERM), F.lit(0))
    rows = bare(items, item_id=key, text=text).filter("item_id is not null and text is not null")
    return rows.select("item_id", F.explode(found).alias("term")).distinct().withColumn("bucket", _bucket())


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _counted(only: frozenset[bytes] | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, lists, counts = [], [], []
            for text in utf8(batch.column("text")):
                terms = terms_of(text)
                held = Counter(terms if only is None else filter(only.__contains__, terms))
                sizes.append(len(terms))
                lists.append(list(held))
                counts.append(list(held.values()))
            lists = pa.array(lists, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            # rows may repeat an id: a drawn number, which the written table fixes, tells them apart
            own = pa.array([int.from_bytes(os.urandom(8)) >> 1 for _ in sizes], pa.int64())
            arrays = [batch.column("doc_id"), own, pa.array(sizes, pa.int64()), lists, pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "own", "n", "terms", "tfs"])

    return run


def packed(docs: DataFrame, only: frozenset[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, own, n, terms, tfs): a row a document, written to the shared folder. n counts all its terms; terms and tfs are
    those of `only`, or all. own tells rows of one id apart."""
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, own bigint, n bigint, terms array<string>, tfs array<bigint>"
    return staged(source.mapInArrow(_counted(only), schema), "search-terms")


def postings(rows: DataFrame) -> DataFrame:
    """(doc_id, own, n, bucket, term, tf): the postings of packed() rows."""
    return rows.select("doc_id", "own", "n", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).withColumn("bucket", _bucket())


def search(docs: DataFrame, items: DataFrame, top: int = TOP, sent_bytes: int = SENT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, scores above 0 only, ties in the order of doc_id, null
    ids last. Ranks of an item run from 1.

    Null and empty texts have no terms and are no documents. Rows of documents that repeat an id, or are equal throughout, are
    documents each. Items without a term, and terms that no document has, find nothing; an empty table on either side gives no
    rows. Whole texts; other columns are not read.
    """
    spark = docs.sparkSession
    wanted = staged(item_terms(items), "search-items")
    size = wanted.agg(F.sum(F.octet_length("term") + 24).alias("b")).first()["b"] or 0
    small = size <= sent_bytes
    only = frozenset(r["term"].encode() for r in wanted.select("term").distinct().toLocalIterator()) if small else None
    rows = packed(docs, only, key, text)
    whole = rows.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, length = F.lit(whole["N"]).cast("long"), F.lit(whole["L"]).cast("long")
    held = postings(rows)
    df = held.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # a term's items are one row: every posting meets one row at most
    weighted = wanted.join(df, ["bucket", "term"]).withColumn("w", weight).filter("w > 0")
    by_term = weighted.groupBy("bucket", "term").agg(F.collect_list(F.struct("item_id", "w")).alias("items")) if small else weighted
    if small:
        # dealt by document, whose sums then need no second shuffle
        held = postings(rows.filter(F.size("terms") > 0).repartition(width(spark), "own"))
        by_term = F.broadcast(by_term)
    m = F.lit(50) + F.expr("(50 * n * __N) div __L")
    part = held.withColumns({"__N": n_docs, "__L": length}).withColumn("m", m)
    part = part.select("doc_id", "own", "bucket", "term", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("part"))
    matched = part.join(by_term, ["bucket", "term"])
    if small:
        matched = matched.select("doc_id", "own", "part", F.inline("items"))
    scores = matched.groupBy("item_id", "doc_id", "own").agg(F.sum(F.col("w") * F.col("part")).alias("score")).filter("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "own")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same columns in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS own, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, own, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
p AS (SELECT doc_id, own, term, count(*) AS tf FROM x GROUP BY doc_id, own, term),
n AS (SELECT own, sum(tf)::BIGINT AS n FROM p GROUP BY own),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT item_id, i.term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM i JOIN f ON i.term = f.term, s),
m AS (SELECT p.doc_id, p.own, p.term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l))) AS part FROM p JOIN n ON p.own = n.own, s),
g AS (SELECT item_id, doc_id, own, sum(w * part)::BIGINT AS score FROM m JOIN w ON m.term = w.term GROUP BY item_id, doc_id, own),
r AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, own))::INT AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
