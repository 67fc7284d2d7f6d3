"""Filter interactions, toxic segments and ranked search against brute force, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import filter_audit, lexical_search, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(lexical_search.TERM)


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    out = [(i, prose(int(n)), ("en", "de", None)[i % 3], "s") for i, n in enumerate(rng.integers(5, 180, 40))]
    out += [(50, None, "en", "s"), (51, "", "de", None), (52, " \t\n", "", "s"), (53, out[4][1], "en", "s"), (2, out[4][1], "fr", "s"), (53, out[4][1], "en", "s")]
    out += [(54, "SHOUTED " * 120, "en", "s"), (55, prose(120) + " #1 | x", "de", "s"), (None, out[7][1], "en", "s"), (None, "only without an id", "en", "s"), (None, "only without an id", "en", "s")]
    out += [(56, prose(40_000), "en", "s"), (57, "é" * 300 + " ÀÉ ünï" * 40, "fr", "s"), (58, "W1 W1 w2 " * 30, "en", "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    made = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 1) if i % 7] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (55, None, None), (9999, 1, 1)]
    return spark.createDataFrame(made, LABELS).persist()


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("part", "own", "digest", "n", "good", "mask", "first", "id", "t", "terms", "term", "bucket", "score", "rank", "deal", "items", "toxic", "__N")
    return docs.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: filter interactions ---


def plain_mask(t):
    words = WORD.findall(t)
    fails = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))
    return {"ABCD"[i] for i, x in enumerate(fails) if x}


def plain_audit(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    made = defaultdict(list)
    for i, t, lang, _ in docs:
        fails = plain_mask(t or "")
        m = least.get(t or "")
        if m is not None and (i is None or i > m):
            fails.add("E")
        made[lang or ""].append((frozenset(fails), i in good, i in toxic))
    out = {}
    for part, held in made.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = held
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] and bool(x[0] & set(order[:k])) for x in held)
                unique = sum(x[0] == {f} for x in held)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(x[1] for x in gone), sum(x[2] for x in gone)]
                removed_by[f] += len(gone)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(removed_by[order[k - 1]])
    return out


def test_interactions_against_brute_force(docs, labels, clashing, empty):
    got = filter_audit.audited(clashing, labels).collect()
    held = [tuple(r) for r in docs.collect()]
    want = plain_audit(held, [tuple(r) for r in labels.collect()])
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        assert want[r["part"], r["filter_order"], r["step"]] == list(r)[3:], (r, want[r["part"], r["filter_order"], r["step"]])
    assert filter_audit.audited(empty, labels).count() == 0
    none = filter_audit.audited(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("removed")).first()
    assert none[0] == 0 and none[1] > 0


def test_a_text_that_a_third_repeats(spark, labels):
    made = [(i, "the same text in very many rows", "en", "s") for i in range(3000)] + [(5000 + i, f"text {i}", "en", "s") for i in range(6000)]
    cells = {r["mask"]: r["n"] for r in filter_audit.cells(spark.createDataFrame(made, SCHEMA), labels).collect()}
    assert cells == {1: 6001, 1 | filter_audit.COPY: 2999}


# --- 12: toxic segments ---


def test_segments_against_brute_force():
    """Maximal scoring segments by their definition: the best run of all first, then the best within what is left beside it."""

    def plain(x, at=0):
        best = (0.0, 0, 0)
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                s = sum(x[i:j])
                if s > best[0] + 1e-12 or s > best[0] - 1e-12 and best[0] > 0 and j - i > best[2] - best[1]:
                    best = (s, i, j)
        s, i, j = best
        return [] if s <= 0 else plain(x[:i], at) + [(s, at + i, at + j)] + plain(x[j:], at + j)

    rng = np.random.default_rng(1)
    for n in range(40):
        x = rng.normal(-0.3, 1, n)
        got, want = toxicity.segments(x), plain(list(x))
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])
    assert toxicity.segments(np.zeros(0)) == [] and toxicity.segments(np.array([-1.0, -2])) == []
    long = rng.normal(-0.1, 1, 1_000_000)
    assert sum(b - a for _, a, b in toxicity.segments(long)) <= 1_000_000


def test_the_extreme_value_law_is_found():
    """Greatest scores drawn from a known law give its rate and constant back."""
    rng = np.random.default_rng(2)
    n = rng.integers(50, 2000, 20_000)
    s = (np.log(n) + np.log(0.05) + rng.gumbel(size=len(n))) / 0.7
    rate, log_k = toxicity.extreme_law(n, s)
    assert abs(rate - 0.7) < 0.02 and abs(log_k - np.log(0.05)) < 0.15


def test_pieces_cut_no_word(monkeypatch):
    text = "Ünder_score and a long_word, " * 50 + "x" * 400
    want = toxicity._WORD.findall(text.lower())
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert [w for p in toxicity.pieces(text.encode()) for w in p] == want
    assert list(toxicity.pieces(None)) == []


def planted(spark, n=900):
    """Clean prose, and documents with a short abusive passage made of a few stems."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("an", "er", "il", "os") for c in ("", "a", "ten", "ish")]
    bad = [f"{a}{c}" for a in ("zork", "quib", "vexu") for c in ("", "ing", "ed", "ish", "ard")]
    made, marks = [], []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(20, 300))))
        toxic = int(i % 6 == 0)
        at = int(rng.integers(0, len(text)))
        if toxic:
            text[at:at] = list(rng.choice(bad, 5))
        made.append((i, " ".join(text), "en", "s"))
        marks.append((i, 1, toxic))
    return spark.createDataFrame(made, SCHEMA), spark.createDataFrame(marks, LABELS)


def test_planted_passages_are_found(spark):
    docs, labels = planted(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.classified(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    text = {r["doc_id"]: toxicity._WORD.findall(r["text"]) for r in docs.collect()}
    found = toxicity.passages(docs, model).collect()
    bad = re.compile("^(zork|quib|vexu)")
    marks = {r["doc_id"] for r in labels.collect() if r["toxic"]}
    assert len({r["doc_id"] for r in found} & marks) >= 0.98 * len(marks)
    assert sum(bool(bad.match(w)) for r in found for w in text[r["doc_id"]][r["first_word"]:r["end_word"]]) >= 0.9 * 5 * len(marks)
    # words never seen, of a stem that was
    new = spark.createDataFrame([(1, "ban osa zorkelino quibanda vexuton ban bana"), (2, "ban bana bater filish dosten ban bana")], "doc_id bigint, text string")
    a, b = (r["score"] for r in toxicity.score(new, model).orderBy("doc_id").collect())
    assert a > 0.7 > 0.3 > b


def test_scores_of_odd_rows(spark, docs, labels, clashing, empty):
    got = toxicity.classified(clashing, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert toxicity.classified(empty, labels).count() == 0
    for marks in (labels.limit(0), labels.filter("toxic = 0")):
        scores = {r["score"] for r in toxicity.classified(docs, marks).collect()}
        assert len(scores) == 1
    again = toxicity.classified(docs.repartition(5), labels).collect()
    key = lambda r: (str(r["doc_id"]), r["score"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.classified(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic = held[held.toxic == 1]
    assert (held.predicted == held.toxic).mean() > 0.98 and toxic.predicted.mean() > 0.85
    assert held[held.toxic == 0].predicted.mean() < 0.005


# --- 13: ranked search ---


def plain_search(docs, items, top):
    low = str.maketrans(lexical_search._CAPITALS, lexical_search._SMALL)
    held = [(i, Counter(TERM.findall((t or "").translate(low)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    want = {}
    for item in {i for i, t in items if i is not None and t is not None}:
        terms = {w for i, t in items if i == item and t is not None for w in TERM.findall(t.translate(low))}
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // length
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        want[item] = [(None if none else i, -s) for s, none, i in sorted(scores)[:top]]
    return {k: v for k, v in want.items() if v}


def ranked(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in out[r["item_id"]]
        out[r["item_id"]][r["rank"]] = (r["doc_id"], r["score"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("top, sent_bytes", [(50, lexical_search.SENT_BYTES), (3, lexical_search.SENT_BYTES), (7, 0)])
def test_search_against_brute_force(spark, docs, clashing, empty, top, sent_bytes):
    """On both ways: items that are sent to every task, and items that are dealt by bucket and term."""
    items = [(1, "w1 w2, W3 w3"), (2, "é-w299 ünï"), (3, None), (4, ""), (5, "nothing here"), (6, "w5"), (6, "w6 w7"), (None, "w1"), (7, " ".join(f"w{i}" for i in range(300)))]
    made = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("x"))
    got = ranked(lexical_search.search(clashing, made, top, sent_bytes))
    assert got == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], items, top)
    assert lexical_search.search(empty, made, top, sent_bytes).count() == lexical_search.search(docs, made.limit(0), top, sent_bytes).count() == 0


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "the same words") for i in (9, 3, 3, 7, None, 1)] + [(20 + i, f"other{i}") for i in range(9)], "doc_id bigint, text string")
    got = ranked(lexical_search.search(docs, spark.createDataFrame([(1, "same")], "item_id bigint, text string"), 5))
    assert [i for i, _ in got[1]] == [1, 3, 3, 7, 9] and len({s for _, s in got[1]}) == 1
