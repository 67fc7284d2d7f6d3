"""Quality rules as a bitmask ledger.

One pass evaluates every rule once for each document and keeps the measurements and one integer whose bits are the rules
that failed. Policies are numbered sets of rules: applying one, comparing two or counting what a rule costs are bitwise
expressions over the ledger and never look at a text again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bare, free_name, small_batches, utf8

#: Measurements of a text, all counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Bit `bit` of the ledger is set where `sql`, an expression over the measurements' columns, holds."""

    bit: int
    name: str
    sql: str


#: A bit, once given, keeps its meaning; new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "many_words", "n_words > 100000"),
)
#: Version: bits whose failure rejects. Version 1 has the base rules alone; 3 drops repeated lines, as the ablation of 2
#: against labels showed that what only this rule rejects is mostly good.
POLICIES = {1: 0b0000011, 2: 0b0111111, 3: 0b0110111}
CURRENT = 3
BASE = 0b11


def repeated_positions(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text; all are 0 for null and for texts without a word."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    gaps = len(text) - len(b"".join(words))  # white space is ASCII: a byte is a character
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - gaps,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_positions(words),
        len(lines),
    )


def _measured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        columns = list(zip(*map(measure, utf8(batch.column("text"))))) or [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *MEASURES]
        )


def failed_bits(names: dict[str, str] | None = None) -> Column:
    """The ledger's integer, from the measurements' columns (names: what they are called). Rules are evaluated once, side by
    side."""
    out = F.lit(0).cast("long")
    for r in RULES:
        fails = re.sub("|".join(MEASURES), lambda m: f"`{names[m[0]]}`", r.sql) if names else r.sql
        out = out.bitwiseOR(F.when(F.expr(fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return out


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): one row for each row of docs, whole texts.

    A null text has no words, like an empty one. Repeated rows each get a row; an empty table gives none. Columns other
    than key and text are not read.
    """
    source = bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return rows.withColumn("failed", failed_bits())


def passes(version: int = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, fails, alone, kept_without): for each rule of a policy, how many rows fail it, fail only it, and would be
    kept without it. One aggregate over the ledger."""
    mask, kept = POLICIES[version], F.count_if(passes(version)).alias("kept")
    used = [r for r in RULES if mask >> r.bit & 1]
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count_if(hit.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}") for r in used]
    sums += [F.count_if(hit == F.lit(1 << r.bit).cast("long")).alias(f"a{r.bit}") for r in used]
    one = rows.agg(kept, *sums)
    return one.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("fails"), F.col(f"a{r.bit}").alias("alone"),
                (F.col("kept") + F.col(f"a{r.bit}")).alias("kept_without"),
            )
            for r in used
        ]))
    )


def with_ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the ledger's integer in one more column, and that column's name. One pass over the texts."""
    place, names = docs.columns.index(text), {m: free_name(docs, f"__{m}") for m in MEASURES}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = list(zip(*map(measure, utf8(batch.column(place))))) or [[]] * len(MEASURES)
            arrays = [*batch.columns, *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names.values()])

    small_batches(docs.sparkSession)
    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names.values()]]))
    bits = free_name(docs, "__failed")
    return rows.withColumn(bits, failed_bits(names)).drop(*names.values()), bits


def keep(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The rows of docs whose ledger passes a policy, with all their columns.

    A null or empty text has no words and fails the rule of few words. Repeated rows are judged alike and all stay or go; an
    empty table gives none. Columns may have any names, null values in others don't matter.
    """
    rows, bits = with_ledger(docs, text)
    return rows.filter(F.col(bits).bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0).drop(bits)


#: The same columns in DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS o(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(n.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN n_words > 100000 THEN 64 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       (failed & 55) = 0 AS kept, failed::BIGINT AS failed, 3 AS policy
FROM b
"""


def judged(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The digest: measurements, base_failed, kept under a policy, the bits, and the policy's number."""
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger(docs).select(
        "doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & passes(version)).alias("kept"), "failed", F.lit(version).alias("policy")
    )
