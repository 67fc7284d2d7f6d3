"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

The fixed patterns give seed entities. Candidates are strings shaped like identifiers, digits in groups or names around an @,
with the lexical patterns they stand in: a label before them (`Tel:`, `phone = `), or the words on both sides. Patterns and
the values they announce are a bipartite graph, scored in rounds: a pattern is as good for a kind as the values it announces
that are of the kind, against those of other kinds and, at a discount, those not known; a value is as good as its best
pattern. Values that a confident pattern announces count from the next round on, so they induce patterns of their own. A
pattern once confident stays so, and rounds go on until none joins, however long a chain of patterns is. What confident patterns announce in the shape of their kind is added. DataFrame operations only.

A match's place is the length of the pieces between matches: split() and regexp_extract_all() walk a text alike. Places are
summed in blocks, patterns are written so that no start inside a run is tried twice, and candidates meet fixed spans in the
order of their starts: all of it stays linear on texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bare, staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: What the contract states, with possessive runs. A match begins at a run's first character or where the last one ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this have no match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Something shaped like an identifier: a name around an @, written out or not; or digits in groups.
CANDIDATE = (
    r"(?<![\p{L}\p{N}_.@+%-])(?:[\p{L}\p{N}_.+%-]++(?:@|\x20?+[\[({]at[\])}]\x20?+)[\p{L}\p{N}_]++(?:[.-]++[\p{L}\p{N}_]++)*+"
    r"|[+(]{0,2}+[0-9](?:[\x20().-]{0,3}+[0-9])*+)(?![\p{L}\p{N}_@])"
)
#: Read backward from a candidate, so that a name of any length is one anchored run: the label or word before it.
LABEL = r"\A[\"']?\x20?[:=]\x20?([\p{L}\p{N}_.-]*+)"
WORD_BEFORE = r"\A[\s\"'(]{1,2}([\p{L}\p{N}_.-]*+)"
WORD_AFTER = r"\A[^\p{L}\p{N}_]{1,3}([\p{L}_][\p{L}\p{N}_-]*+)"
#: What a candidate, without its separators, must look like to be taken for a kind that the fixed pattern didn't see.
SHAPES = {"email": r"@|[\[({]at[\])}]", "ip": r"^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}$", "card": r"^(?:[^0-9]*[0-9]){12,19}$", "phone": r"^(?:[^0-9]*[0-9]){5,15}$"}
MIN_SEEDS = 5  #: different values of a kind that a pattern must announce
UNKNOWN = 0.1  #: how much a value that nothing is known of counts against a pattern
CONFIDENCE = 0.8  #: of a pattern, to yield values
TOGETHER = 128  #: matches of a block


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of a pattern's matches in a text: places in code points, end
    exclusive, and the pieces of text up to the matches next to it."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    empty = F.array().cast(kind)

    def bound(value: Column, use) -> Column:
        """use(value), with value worked out once however often use names it."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def zipped(x: Column) -> Column:
        """Matches with the pieces before and after them."""
        n = F.size(x["v"])
        return F.arrays_zip(F.slice(x["s"], F.lit(1), n).alias("p"), x["v"].alias("v"), F.slice(x["s"], F.lit(2), n).alias("q"))

    def in_blocks(both: Column) -> Column:
        whole = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / TOGETHER).cast("int"))
        return F.transform(whole, lambda i: F.slice(both, i * TOGETHER + 1, F.lit(TOGETHER)))

    def length(x: Column) -> Column:
        return F.length(x["p"]) + F.length(x["v"])

    def start_of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(sums, none, step)["out"]

    def placed(block: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            end = start + F.length(x["v"])
            one = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), x["p"].alias("before"), x["q"].alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), empty.alias("out")), step)["out"]

    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    found = bound(F.struct(values.alias("v"), pieces.alias("s")), lambda x: F.when(F.size(x["v"]) > 0, zipped(x)))
    blocks = bound(found, in_blocks)
    placed_ = bound(blocks, lambda b: F.flatten(F.zip_with(b, start_of(b), placed)))
    return F.coalesce(placed_, empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    d = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(d))

    def term(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(F.length(d) > 0, F.aggregate(F.transform(places, term), F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    """The check that a match of a kind must pass."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(value)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a kind by its fixed pattern; matches that fail its check are dropped."""
    hint = HINTS[kind]
    may = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9][ -]?[0-9]")
    if kind == "ip":
        may = text.rlike(r"[0-9]\.[0-9]")
    none = F.array().cast("array<struct<start:int,end:int>>")
    slim = F.transform(F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["value"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(may, slim).otherwise(none)


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, label, pair>> of candidates with a pattern: the label before them, and the words
    around them as `before _ after`, in lower case; null where there is none."""

    def named(name: Column) -> Column:
        return F.when(name.rlike(r"^[\p{L}_]"), F.lower(name))

    def seen(x: Column) -> Column:
        back = F.reverse(x["before"])
        label, before = (named(F.reverse(F.regexp_extract(back, p, 1))) for p in (LABEL, WORD_BEFORE))
        pair = F.concat(before, F.lit(" _ "), named(F.regexp_extract(x["after"], WORD_AFTER, 1)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.concat(label, F.lit(":")).alias("label"), pair.alias("pair"))

    found = F.filter(F.transform(located(text, CANDIDATE), seen), lambda x: x["label"].isNotNull() | x["pair"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,value:string,label:string,pair:string>>")
    return F.when(text.rlike("[0-9]|@|[\\[({]at[\\])}]"), found).otherwise(none)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, email, ip, card, phone, candidates) of whole texts; h tells apart texts that share an id. Written to the
    shared folder, as later steps read it often."""
    rows = bare(docs, doc_id=key, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = [base_spans(F.col("text"), k).alias(k) for k in KINDS]
    return staged(rows.select("doc_id", F.xxhash64("text").alias("h"), *spans, candidates(F.col("text")).alias("candidates")), "pii")


def against_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, value, label, pair, kind, touched): candidates, the kind of the fixed span that begins with
    them, and whether any fixed span touches them. Both are walked in the order of their starts. rows: scanned()."""
    able = rows.filter(F.size("candidates") > 0)

    def of_kind(k: str) -> Column:
        return F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))

    base = F.concat(*map(of_kind, KINDS))
    spans = able.select("doc_id", "h", F.inline(base)).select("*", F.struct("start", "end", "kind").alias("span"))
    both = able.select("doc_id", "h", F.inline("candidates")).unionByName(spans.drop("kind"), allowMissingColumns=True)
    # frames that grow from the front only: one that reaches to the end is summed up anew for every row
    walk, back = (Window.partitionBy("doc_id", "h").orderBy(*o) for o in ((F.asc("start"), F.col("span").isNull()), (F.desc("start"), F.col("span").isNotNull())))
    past, rest = walk.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    near = both.select(
        "*", F.last("span", True).over(past).alias("prev"), F.max("span.end").over(past).alias("reach"), F.last("span", True).over(rest).alias("next"),
    ).filter("span is null")
    begins = F.when(F.col("prev.start") == F.col("start"), F.col("prev")).when(F.col("next.start") <= F.col("start") + 2, F.col("next"))
    touched = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next.start") < F.col("end"), F.lit(False))
    with_seed = near.select("doc_id", "h", "start", "end", "value", "label", "pair", begins.alias("seed"), touched.alias("touched"))
    # what is touched but doesn't begin with a span is no evidence; words after it count only where the span ends there too
    whole = F.col("seed").isNull() | (F.col("seed.end") == F.col("end"))
    return with_seed.filter("seed is not null or not touched").select(
        "doc_id", "h", "start", "end", "value", "label", F.when(whole, F.col("pair")).alias("pair"), F.col("seed.kind").alias("kind"), "touched"
    )


def _shaped(value: Column) -> Column:
    """The kinds whose shape a value has."""
    return F.array_compact(F.array(*[F.when(value.rlike(SHAPES[k]), F.lit(k)) for k in KINDS]))


def graph(seen: DataFrame) -> DataFrame:
    """(pattern, value, kind, seed): an edge for each pattern and different value, once for each kind the value may be of;
    seed: 1 where a fixed pattern found the value. seen: against_spans()."""
    patterns = F.explode(F.array_compact(F.array("label", "pair"))).alias("pattern")
    plain = F.lower(F.regexp_replace("value", r"[\x20()-]", "")).alias("value")
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(_shaped(F.col("value")))
    rows = seen.select(patterns, plain, kinds.alias("kinds"), F.col("kind").isNotNull().cast("double").alias("seed"))
    return rows.select("pattern", "value", F.explode("kinds").alias("kind"), "seed").groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed"))


def confident(edges: DataFrame) -> DataFrame:
    """(pattern, kind, good): patterns sure enough of a kind, their best one. edges: (pattern, value, kind, score)."""
    per_kind = edges.groupBy("pattern", "kind").agg(
        F.sum("score").alias("own"), F.count_if(F.col("score") > 0).alias("values"), F.count_if(F.col("score") == 0).alias("unknown")
    )
    kinds = F.collect_list(F.struct("own", "values", "unknown", "kind")).alias("kinds")  # four at most
    rows = per_kind.groupBy("pattern").agg(F.sum("own").alias("all"), kinds).select("pattern", "all", F.inline("kinds"))
    good = F.col("own") / (F.col("all") + UNKNOWN * F.col("unknown"))
    sure = rows.filter(F.col("values") >= MIN_SEEDS).withColumn("good", good).filter(F.col("good") >= CONFIDENCE)
    return sure.groupBy("pattern").agg(F.max_by(F.struct("kind", "good"), F.struct("good", "own", "kind")).alias("best")).select("pattern", "best.*")


def bootstrap(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, kind, start, end): what confident patterns announce, in the shape of their kind, and no fixed span
    touches; and the patterns. rows: scanned()."""
    seen = staged(against_spans(rows), "pii-seen")
    edges = staged(graph(seen), "pii-graph")
    sure = found = None
    while True:
        if found is None:
            scored = edges.withColumn("score", F.col("seed"))
        else:
            scored = edges.join(found, ["value", "kind"], "left").withColumn("score", F.coalesce(F.greatest("seed", "said"), "seed"))
        # a confident pattern stays so: patterns only join, and the rounds end when none does
        new = confident(scored)
        new = staged(new if sure is None else new.join(sure, "pattern", "left_anti"), "pii-patterns")
        if sure is not None and new.isEmpty():
            break
        sure = new if sure is None else staged(sure.unionByName(new), "pii-patterns")
        told = edges.filter("seed = 0").join(sure, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("good").alias("said"))
        found = staged(told, "pii-found")
    fresh = seen.filter(~F.col("touched")).select("doc_id", "h", "start", "end", "value", F.explode(F.array_compact(F.array("label", "pair"))).alias("pattern"))
    fits = fresh.join(sure, "pattern").filter(F.array_contains(_shaped(F.col("value")), F.col("kind")))
    best = fits.groupBy("doc_id", "h", "start", "end").agg(F.max_by("kind", F.struct("good", "kind")).alias("kind"))
    return best.select("doc_id", "h", "kind", "start", "end"), sure


def _written(kind: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string")))


def found(docs: DataFrame) -> DataFrame:
    """The digest: counts of base spans, base_sha256, spans (base and bootstrapped), n_added.

    Null texts are empty. Repeated rows each get a row; an empty table gives none. Columns other than doc_id and text are
    not read.
    """
    rows = scanned(docs)
    more = bootstrap(rows)[0].groupBy("doc_id", "h").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "d", "h": "g"})
    both = rows.drop("candidates").join(more, rows["doc_id"].eqNullSafe(more["d"]) & (rows["h"] == more["g"]), "left")
    base = F.array_join(F.concat(*[_written(F.lit(k), F.col(k)) for k in KINDS]), ",")

    def all_of(k: str) -> Column:
        added = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
        extra = F.transform(F.filter(added, lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return _written(F.lit(k), F.array_sort(F.concat(F.col(k), extra)))

    return both.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*[all_of(k) for k in KINDS]), ",").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"),
    )


def _sql_kind(i: int, kind: str, pattern: str, check: str) -> str:
    """Spans of one kind: pieces between matches give the places."""
    return f"""
SELECT doc_id, {i} AS o, '{kind}' AS kind, v, since + length(p) AS a, since + length(p) + length(v) AS b FROM (
  SELECT doc_id, v, p, coalesce(sum(length(p) + length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since
  FROM (SELECT doc_id, unnest(m) AS v, unnest(s[1:len(m)]) AS p, generate_subscripts(m, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s FROM d))) WHERE {check}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), "
    f"lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * substr(reverse({_DIGITS}), i::INT, 1)::INT) "
    f"- CASE WHEN i % 2 = 0 AND substr(reverse({_DIGITS}), i::INT, 1)::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
)
#: The digest in DuckDB. Spans that contexts add are left out: it holds for tables in which no pattern announces anything.
SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ("
    + " UNION ALL ".join([
        _sql_kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_kind(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda q: q::HUGEINT)) <= 255"),
        _sql_kind(2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _sql_kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ])
    + """), y AS (SELECT doc_id, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY o, a) AS spans, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip,
  count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, 0::BIGINT AS n_added FROM d LEFT JOIN y USING (doc_id)"""
)
