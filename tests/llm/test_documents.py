"""Each operator against brute force, on texts that are null, empty, long, repeated, tied, and beside columns whose names clash."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, components, decontaminate, mixing, pii, quality_model, quality_rules, shards, simhash, suffix_dedup, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = "licensed under terms that everyone repeats word for word in each of these many long documents here, " * 2


def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary, n))

    base = [prose(int(n)) for n in rng.integers(20, 200, 25)]
    out = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    words = base[3].split()
    out += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, "   \n\t ", "en", "s0", 5), (103, "one", "en", "s1", 3), (104, "One TWO", "en", "s1", 7),
        (105, base[3], "en", "s0", 1), (106, base[3], "en", "s0", 1), (107, " ".join(words[:-1] + ["changed"]), "en", "s0", 1),
        (108, PASSAGE + prose(60), "en", "s2", 1), (109, prose(60) + PASSAGE + prose(10), "en", "s2", 1), (110, prose(5) + PASSAGE, "en", "s2", 1),
        (111, "é" * 70 + " ünï " + "x" * 300 + "  y  z", "de", "s2", 1), (112, prose(30_000), "en", "s0", 1), (113, "a b c " * 200, "en", "s0", 1),
        (114, "\n".join(["same line here"] * 9 + ["other"]), "en", "s0", 1), (115, " ".join(w + "###" for w in base[7].split()), "en", "s1", 1), (None, "no id at all but some words", "en", "s1", 1),
        (116, base[5] + "\x00\x0b\x0c\x1c\x85\xa0 end", "en", "s1", 1), (103, "one", "en", "s1", 3),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def clashing(docs):
    from pyspark.sql import functions as F

    names = ("slot", "shard", "fp", "component_id", "__component", "__nth", "failed", "kind", "body", "doc", "tie", "block", "__source", "__at", "h", "score", "bucket", "size")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bits(a, b):
    return bin(a ^ b).count("1")


# --- 1: sharding ---


def test_shards_are_even_and_slots_gapless(docs):
    got, at = shards.shard_records(docs, 5)
    got = got.collect()
    assert len(got) == docs.count() and at.version == 1 and len(at.owner) == shards.SLOTS
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    for r in got:
        assert (r["text_crc32"] is None) == (r["size"] == 8 and r["doc_id"] == 100)
    by = {(i, t) for i, t in texts(docs)}
    want = Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t in texts(docs))
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) and len(by) == len(want)


def load_of(rows, n):
    out = [0] * n
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def test_shards_are_even_on_whole_tables(spark):
    for sf, most in (("/root/testdata/sf0.001", 0.02), ("/root/testdata/sf0.01", 0.01)):
        got = shards.shard_records(spark.read.parquet(f"{sf}/documents.parquet"), 24)[0].collect()
        load, largest = load_of(got, 24), max(r["size"] for r in got)
        assert max(load) - min(load) <= max(most * sum(load) / 24, largest - sum(load) / 24), load


def test_rows_that_repeat_are_spread(spark):
    """A row that half of the table repeats, and rows without id and text, make no shard fuller than another."""
    made = [(7, "the same row " * 4)] * 10_000 + [(i, f"text number {i} of many") for i in range(9_000)] + [(None, None)] * 1_000
    got, _ = shards.shard_records(spark.createDataFrame(made, "doc_id bigint, text string"), 24)
    got = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t or "") + 8) for i, t in made)
    load = load_of(got, 24)
    assert max(load) - min(load) < 0.01 * max(load), load
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_rebalancing_moves_little_and_evens_out():
    rng = np.random.default_rng(0)
    weight = {i: int(w) for i, w in enumerate(rng.integers(100, 5000, shards.SLOTS))}
    first = shards.rebalance(shards.even_map(24), weight)
    load = lambda m: [sum(weight[i] for i, s in enumerate(m.owner) if s == k) for k in range(m.shards)]
    assert max(load(first)) - min(load(first)) < 10
    assert shards.rebalance(first, weight).version == 2
    grown = shards.rebalance(first, weight, 25)
    assert max(load(grown)) - min(load(grown)) < 5000 and len(grown.moved) < 0.06 * shards.SLOTS
    assert all(grown.owner[i] != first.owner[i] for i in grown.moved)


def test_stored_maps(spark):
    a = shards.even_map(3, 16)
    b = shards.rebalance(a, {i: i for i in range(16)})
    both = a.table(spark).union(b.table(spark))
    assert shards.SlotMap.load(both) == b and shards.SlotMap.load(both, 0) == a


def test_shards_of_clashing_and_empty(clashing, empty):
    assert shards.shard_records(clashing, 4)[0].count() == clashing.count()
    assert shards.shard_records(empty, 4)[0].collect() == []


# --- 2: quality rules ---


def plain_measures(t):
    words = WORD.findall(t or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_ledger_measures(docs):
    got = quality_rules.judged(docs).collect()
    want = Counter((i, *plain_measures(t)) for i, t in texts(docs))
    assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_keep_agrees_with_the_ledger(docs, clashing, empty):
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in quality_rules.keep(docs).collect())
    said = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in quality_rules.judged(docs).filter("kept").collect())
    assert kept == said
    assert quality_rules.keep(clashing).columns == clashing.columns and quality_rules.keep(clashing).count() == len(kept)
    assert quality_rules.keep(empty).collect() == [] and quality_rules.judged(empty).collect() == []


def test_ablation(docs):
    ledger = quality_rules.ledger(docs)
    all_ = ledger.collect()
    kept = lambda mask: sum(not r["failed"] & mask for r in all_)
    mask = quality_rules.POLICIES[2]
    for r in quality_rules.ablation(ledger, 2).collect():
        bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r["rule"])
        assert r["kept_without"] == kept(mask & ~bit) and r["fails"] == sum(bool(x["failed"] & bit) for x in all_)


# --- 3: repeated passages ---


def plain_dedup(pairs):
    seen, out = set(), {}
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        if (i, b) in out:
            continue
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = covered.count(b"\0\1") + (1 if covered[:1] == b"\1" else 0)
        out[i, b] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare_dedup(docs):
    want = plain_dedup(texts(docs))
    got = suffix_dedup.deduplicated(docs, with_text=True).collect()
    assert len(got) == docs.count()
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, set()).add(v)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in by_id[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    return sum(r["n_removed"] for r in got)


def test_passages(docs, clashing, empty):
    assert compare_dedup(docs) > 1000
    compare_dedup(clashing)
    assert suffix_dedup.deduplicated(empty).collect() == []


def repetitive(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("ab"), 90)) for _ in range(6)] + ["".join(rng.choice(list("abcdefgh \n"), 130)) for _ in range(6)]
    made = [(i, "".join(rng.choice(pool, 5)) + "".join(rng.choice(list("xyz"), int(rng.integers(0, 150))))) for i in range(60)]
    made += [(90, "z" * 350), (91, "ab" * 120), (92, "z" * 99), (93, "z" * 100)]
    return spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)


def test_passages_with_many_borders(spark):
    assert compare_dedup(repetitive(spark)) > 5000


@pytest.mark.parametrize("limit", ["HOT", "HOT_HERE"])
def test_hot_anchors_take_the_other_way(spark, monkeypatch, limit):
    rows_ = repetitive(spark).collect()
    want = plain_dedup([(r["doc_id"], r["text"]) for r in rows_])
    monkeypatch.setattr(suffix_dedup, limit, 2 if limit == "HOT" else 3)
    # in this process, where the patch holds: the kernels one after another
    held = suffix_dedup._sampled(4)
    import pyarrow as pa

    def of(part):
        return pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in part]), pa.array([r["text"] for r in part])], ["doc_id", "text"])

    batch = of(rows_)
    blobs = [b for part in (rows_[::2], rows_[1::2]) for b in held(iter([of(part)]))]  # two chunks
    marks = pa.Table.from_batches(list(suffix_dedup._grouped(iter(blobs))))
    wanted = marks.filter(pa.compute.is_valid(marks["a"]))
    assert any(wanted["hot"].to_pylist())
    assert not all(wanted["hot"].to_pylist())
    borders = list(suffix_dedup._resolved(iter(suffix_dedup._fetched(4)(pa.Table.from_batches([batch]), wanted).to_batches())))
    spans = pa.concat_tables([marks.filter(pa.compute.is_null(marks["a"])), pa.Table.from_batches(borders)])
    for r in suffix_dedup._digest(pa.Table.from_batches([batch]), spans).to_pylist():
        text = next(x["text"] for x in rows_ if x["doc_id"] == r["doc_id"]).encode()
        assert want[r["doc_id"], text] == (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])


def test_contexts_are_as_many_rows_for_any_number_of_ranges(spark, monkeypatch):
    rows_ = repetitive(spark).collect()
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", 12)
    batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows_]), pa.array([r["text"] for r in rows_])], ["doc_id", "text"])
    marks = pa.Table.from_batches(list(suffix_dedup._grouped(suffix_dedup._sampled(4)(iter([batch])))))
    wanted = marks.filter(pa.compute.is_valid(marks["a"]))
    n_contexts = wanted["hot"].to_pylist().count(False)
    assert 0 < n_contexts < len(wanted)
    counts, found = set(), []
    for parts in (1, 8, 512):
        fetched = suffix_dedup._fetched(parts)(pa.Table.from_batches([batch]), wanted).to_pandas()
        assert (fetched["kind"] == 0).sum() == n_contexts and fetched["slot"].between(0, parts - 1).all()
        counts.add(len(fetched))
        covered = set()
        for _, own in fetched.groupby("slot"):
            for b in suffix_dedup._resolved(iter([pa.RecordBatch.from_pandas(own, preserve_index=False)])):
                for r in b.to_pylist():
                    covered |= {(r["doc"], r["tie"], s) for s in range(r["start"], r["end"])}
        found.append(covered)
    assert len(counts) == 1
    assert found[0] and all(x == found[0] for x in found)


def test_deep_shallow_sorting():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, (400, 40), np.uint8)
    data[100:200, :24] = data[0, :24]
    data[150] = data[151] = data[152]
    group = rng.integers(0, 7, 400)
    order, common = suffix_dedup.deep_shallow(group, data, 16)
    want = sorted(range(400), key=lambda i: (group[i], bytes(data[i])))
    assert [(group[i], bytes(data[i])) for i in order] == [(group[i], bytes(data[i])) for i in want]
    for a, b, n in zip(order, order[1:], common[1:]):
        if group[a] != group[b]:
            assert n == -1
        else:
            x, y = bytes(data[a]), bytes(data[b])
            assert x[:n] == y[:n] and (n == 40 or x[n] != y[n])


# --- 4: near duplicates ---


def plain_print(t):
    from xxhash import xxh64_intdigest

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{print: least id reachable}."""
    distinct, root = sorted(set(p for _, p in prints)), {}
    for p in distinct:
        root[p] = p
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bits(a, b) <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return {p: least.get(find(p)) for p in distinct}


def test_near_duplicates(docs, clashing, empty):
    prints = [(i, plain_print(t)) for i, t in texts(docs)]
    want = plain_components(prints)
    for d in (docs, clashing):
        got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(d).collect())
        assert got == Counter((i, format(p, "016x"), want[p]) for i, p in prints)
    assert simhash.near_duplicates(empty).collect() == []


def plain_sets(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def plain_groups(texts):
    """{text: group}: linked are prints within 3 bits, and 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    distinct = sorted({t or "" for t in texts})
    prints, sets, root = [plain_print(t) for t in distinct], [plain_sets(t) for t in distinct], list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if bits(prints[i], prints[j]) <= 3 or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(distinct)}


def edited_copies():
    """Long and short texts with one to several words changed, a chain of edits, and a crowd around one text."""
    rng = np.random.default_rng(77)
    words = [f"v{i}" for i in range(3000)]
    out = []
    for n, edits in ((60, 1), (60, 2), (200, 4), (200, 9), (400, 8), (900, 20), (900, 60), (30, 1)):
        base = rng.choice(words, n).tolist()
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for i in rng.choice(n, edits, replace=False):
                copy[i] = "edited" + str(rng.integers(1_000_000))
            out.append(" ".join(copy))
    chain = rng.choice(words, 300).tolist()
    for i in range(12):
        chain[25 * i] = f"step{i}"
        out.append(" ".join(chain))
    crowd = rng.choice(words, 120).tolist()
    for i in range(60):
        out.append(" ".join(crowd[:i] + [f"crowd{i}"] + crowd[i + 1 :]))
    return out


def test_near_copies_beyond_the_fingerprints_radius(spark):
    """One row of each group by brute force over all pairs stays, the one with the least id."""
    made = list(enumerate(edited_copies()))
    group = plain_groups([t for _, t in made])
    least = {}
    for i, t in made:
        least.setdefault(group[t], i)
    kept = simhash.keep_one(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())
    by_print = plain_components([(i, plain_print(t)) for i, t in made])
    assert len(set(by_print.values())) > len(least) + 20  # fingerprints alone leave many


def test_keep_one(docs, clashing, empty):
    group, least = plain_groups([t for _, t in texts(docs)]), {}
    for i, t in texts(docs):
        at = group[t or ""]
        least[at] = min((i, least.get(at, i))) if i is not None and least.get(at, i) is not None else (i if i is not None else least.get(at))
    for d in (docs, clashing):
        kept = simhash.keep_one(d)
        assert kept.columns == d.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert Counter(ids) == Counter(least.values())
    assert simhash.keep_one(empty).collect() == []


def test_keep_one_keeps_every_component(spark):
    """Whatever the ids: null ones, and one that unlinked texts share."""
    rng = np.random.default_rng(21)
    text = [" ".join(rng.choice([f"k{i}" for i in range(900)], 60)) for _ in range(9)]
    made = [(None, t) for t in text[:4]] + [(7, t) for t in text[4:7]] + [(None, text[0]), (None, text[7]), (3, text[7]), (9, text[8]), (7, text[8]), (7, text[8])]
    assert all(bits(plain_print(a), plain_print(b)) > 3 for i, a in enumerate(text) for b in text[:i])
    got = simhash.keep_one(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    want = [(None, t) for t in text[:4]] + [(7, t) for t in text[4:7]] + [(3, text[7]), (7, text[8])]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)


def made_prints():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 64, 30, np.uint64)
    prints = {int(c) for c in centres} | {0, (1 << 64) - 1, 1, 7, 15}
    for c in centres[:10]:
        for _ in range(25):
            c = c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, int(rng.integers(1, 5))).astype(np.uint64))
            prints.add(int(c))
    crowd = centres[20]  # thousands that differ from one in a bit or two, and from each other in up to four
    prints |= {int(crowd) ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    return np.array(sorted(prints), np.uint64)


@pytest.mark.parametrize("rows", [400_000, 50])
def test_links_keep_every_component(spark, monkeypatch, rows):
    """Links by pivot cells against all pairs compared bit by bit, a large group of near copies among them."""
    values = made_prints()
    monkeypatch.setattr(simhash, "ROWS", rows)
    d = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp bigint")
    pairs = simhash.tabled(d).select("fp", "table", F.inline(simhash.cells(F.col("fp"), F.col("table")))).orderBy("key")
    batches = pairs.select("key", "home", "fp", "table").toArrow().to_batches(max_chunksize=200)
    edges = {(a % (1 << 64), b % (1 << 64)) for out in simhash._edges(iter(batches)) for a, b in zip(*[c.to_pylist() for c in out.columns])}
    assert {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(simhash.tabled(d)).collect()} and all(bits(a, b) <= 3 for a, b in edges)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want, seen = {}, np.zeros(len(values), bool)
    for i in range(len(values)):  # breadth first over every linked pair
        front = [i] if not seen[i] else []
        seen[i] = True
        while front:
            at = front.pop()
            want[int(values[at])] = int(values[i])
            near = np.flatnonzero((np.bitwise_count(values ^ values[at]) <= 3) & ~seen)
            seen[near] = True
            front += near.tolist()
    assert {p: find(p) for p in root} == want


def test_the_pivot_table_discards_nearly_all_pairs(spark):
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 64, 20_000, np.uint64))
    d = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp bigint")
    got = simhash.tabled(d).select("fp", "table", F.inline(simhash.cells(F.col("fp"), F.col("table")))).toArrow()
    tally = {}
    table = np.array(got.column("table").combine_chunks().flatten()).reshape(-1, simhash.PIVOTS)
    simhash.forest(got.column("key").to_numpy(), np.array(got.column("home").combine_chunks()), got.column("fp").to_numpy().view(np.uint64), table, tally)
    assert tally["proposed"] > 500 and tally["left"] < tally["proposed"] / 100


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        if a != b:
            root[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(pairs + [(None, 3), (7, None)], "u bigint, v bigint")).collect()
    assert {r["vertex"]: r["root"] for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


# --- 5: personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


PRIVATE = [
    "mail a.b@c.d_e@f.gh.ij and x@y and @z.com a@b.c.d-e.", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.255 1.2.3", "4111 1111 1111 1111 x 4111-1111-1111-1112 49927398716 5500005555555559",
    "+1 (555) 555-0100. +44.20.7946.0958 x +1 2 +", "é🙂 +4915112345678 🙂 me@ünï.de me@uni.de", "1" * 500 + " " + "a" * 3000 + "@", "12 " * 700, "a@b.cc" * 40, None, "",
    "4111111111111111 4111111111111111", "0 00 000 0000 000 00", "+1-" + "2" * 30, "x.x@x..y.z@q.r",
]


def test_base_spans(spark, docs, clashing, empty):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)] + [(0, PRIVATE[0])], "doc_id bigint, text string")
    got = pii.found(d).collect()
    assert len(got) == len(PRIVATE) + 1
    for r in got:
        want = plain_spans(PRIVATE[r["doc_id"]])
        assert r["spans"] == ",".join(want) and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
    assert pii.found(clashing).count() == docs.count() and pii.found(empty).collect() == []


def test_announced_values_are_found(spark):
    made = [(i, f"Ref {i}. Tel: +1 (555) 555-{1000 + i} thanks") for i in range(20)] + [(100, "so Tel: 5550199 it is"), (101, "Note: 5550199 elsewhere")]
    made += [(200 + i, f"Note: value{i}") for i in range(20)]
    got = {r["doc_id"]: r for r in pii.found(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got[100]["spans"] == "phone:8:15" and got[100]["n_added"] == 1 and got[100]["n_phone"] == 0
    assert got[101]["spans"] == "" and all(got[i]["n_added"] == 0 for i in range(20))


def planted(rng, cue, unseen, n, at):
    """Documents in which a cue announces seeds, and others in which it announces what no fixed pattern finds."""
    words = [f"{'bcdfgh'[i % 6]}{'aeiou'[i % 5]}w{chr(97 + i % 23)}" for i in range(200)]
    noise = lambda: " ".join(rng.choice(words, 6))
    seeds = {"email": lambda i: f"u{i}@h{i}.example", "ip": lambda i: f"10.{i % 250}.7.{i % 99}", "phone": lambda i: f"+49 30 {100000 + 7 * i}", "card": None}
    out = [(at + i, f"{noise()} {cue[0]}{seeds[cue[1]](i)}{cue[2]} {noise()}", None) for i in range(n)]
    for j, u in enumerate(unseen):
        head = f"{noise()} {cue[0]}"
        out.append((at + n + j, head + u + cue[2] + " " + noise(), f"{cue[1]}:{len(head)}:{len(head) + len(u)}"))
    return out


def test_recall_by_kind_on_planted_contexts(spark):
    """Labels with : and =, quotes, and words on both sides; unseen values in one or several groups. Every one is found with
    its exact place, and nothing else is."""
    rng = np.random.default_rng(31)
    made = planted(rng, ("Tel: ", "phone", ""), ["5550199", "030 1234567", "(030) 765-4321", "0176.22.33.44"] + [f"030 55{i:05}" for i in range(26)], 40, 0)
    made += planted(rng, ('mail = "', "email", '"'), ["joe [at] corp.example", "ann@localhost", "x.y(at)z.org"] + [f"user{i}@intranet" for i in range(27)], 40, 1000)
    made += planted(rng, ("connect from ", "ip", " refused"), ["300.1.2.3", "10-0-0-17"] + [f"10-0-{i}-9" for i in range(28)], 40, 2000)
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    numbers = [str(4000_0000_0000_0000 + 37 * i) for i in range(1200)]
    good, bad = [n for n in numbers if luhn(n)], [n for n in numbers if not luhn(n)]
    made += [(3000 + i, f"paid by card: {n} today", None) for i, n in enumerate(good[:40])]
    made += [(3100 + i, f"paid by card: {n} today", f"card:14:{14 + len(n)}") for i, n in enumerate(bad[:20] + [f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" for n in bad[20:30]])]
    made += [(4000 + i, f"order: {700_000 + i} and so on", None) for i in range(60)]  # no kind's label
    made += [(5000 + i, f"mixed: {x}", None) for i, x in enumerate([f"m{i}@n.example" for i in range(9)] + [f"+49 40 {200000 + i}" for i in range(9)] + ["9988776"])]
    got = {r["doc_id"]: r for r in pii.found(spark.createDataFrame([m[:2] for m in made], "doc_id bigint, text string")).collect()}
    caught, wanted = Counter(), Counter()
    for i, t, span in made:
        if span:
            wanted[span.split(":")[0]] += 1
            caught[span.split(":")[0]] += got[i]["spans"] == span
        else:
            assert got[i]["n_added"] == 0, (t, got[i]["spans"])
    assert set(wanted) == set(BASE) and all(caught[k] >= 0.9 * wanted[k] for k in wanted), (caught, wanted)


def test_found_values_induce_patterns(spark):
    """Two hops: Tel: knows numbers by their fixed form and announces others; only those stand after Fon:, whose further
    values are found in the next round; Fax: needs a third."""
    made = [(i, f"Ref. Tel: +1 (555) 555-{1000 + i} thanks") for i in range(20)] + [(100 + i, f"Tel: 55{10000 + i} it is") for i in range(8)]
    made += [(200 + i, f"our Fon: 55{10000 + i} here") for i in range(7)] + [(300 + i, f"a Fon: 77{10000 + i} b") for i in range(6)]
    made += [(400 + i, f"Fax: 77{10000 + i}") for i in range(6)] + [(500, "Fax: 88 12345 x"), (501, "Fix: 99 12345 x")]
    got = {r["doc_id"]: r["spans"] for r in pii.found(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got[100] == "phone:5:12" and got[200] == "phone:9:16" and got[305] == "phone:7:14" and got[400] == "phone:5:12"
    assert got[500] == "phone:5:13" and got[501] == ""


def test_long_chains_and_long_labels(spark):
    """Eight labels, each announced by values of the one before; and a label of 200 characters."""
    labels = [f"label{'abcdefgh'[k]}" for k in range(8)]
    number = lambda i: f"55{10000 + 37 * i}"
    lines = [f"{labels[0]}: +49 30 55{10000 + 37 * i}" for i in range(5)]
    lines += [f"{labels[0]}: {number(100 + i)}" for i in range(5)]
    for k in range(1, 8):
        lines += [f"{labels[k]}: {number(100 * k + i)}" for i in range(5)] + [f"{labels[k]}: {number(100 * (k + 1) + i)}" for i in range(5)]
    long = "x" * 200
    lines += [f"{long}: +49 30 66{10000 + 37 * i}" for i in range(5)] + [f"{long}: 77{10000 + 37 * i}" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_added"] for r in pii.found(docs).collect()}
    assert [got[i] for i, t in enumerate(lines) if "+" not in t] == [1] * sum("+" not in t for t in lines)
    assert all(got[i] == 0 for i, t in enumerate(lines) if "+" in t)


def test_long_texts_take_linear_time(spark):
    text = "mail: someone@host.example, " * 40_000
    began = time.perf_counter()
    r = pii.found(spark.createDataFrame([(1, text), (2, "a" * 1_000_000 + "@" * 1000), (3, "1 " * 500_000), (4, "a.b-c=" * 170_000)], "doc_id bigint, text string")).filter("doc_id = 1").first()
    assert r["n_email"] == 40_000 and r["spans"].startswith("email:6:26,email:34:54") and time.perf_counter() - began < 60


# --- 6: mixing ---


def test_mixture_meets_its_limits(spark, empty):
    made = [(i, "w " * 50, "big" if i % 10 else f"small{i % 7}") for i in range(4000)] + [(9000, None, None), (9001, "", "void")]
    d = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    got, m = mixing.mix(d)
    read = Counter(r["doc_id"] for r in got.collect())
    assert set(read) == {i for i, *_ in made}
    tokens = Counter()
    for i, t, s in made:
        tokens[s] += len((t or "").split())
    used = Counter()
    for i, t, s in made:
        used[s] += read[i] * len((t or "").split())
    live = [s for s in tokens if tokens[s]]
    z = sum((tokens[s] / sum(tokens.values())) ** m.alpha for s in live)
    for s in live:
        want = m.budget * (tokens[s] / sum(tokens.values())) ** m.alpha / z
        assert abs(used[s] - want) <= 0.5 * 50 * 3 + 1e-6 * want and used[s] <= mixing.REPEATS * tokens[s] + 100
    assert used["big"] == tokens["big"] and mixing.mix(empty)[0].collect() == []


def weights_of(tokens, alpha):
    share = np.array(tokens, float) / sum(tokens)
    w = share**alpha / (share**alpha).sum()
    return w, float(-(w * np.log(w)).sum())


@pytest.mark.parametrize("tokens", [[100, 200, 300], [1, 1000, 100_000], [5, 5, 5], [10, 90_000], [400, 800, 90, 1, 7000]])
def test_exponent_and_budget_against_a_fine_grid(spark, tokens):
    """alpha by brute force: the largest that reaches the entropy, or the smallest that the repetition limit allows; and the
    budget: every source read once at least, none more often than the limit."""
    d = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens bigint")
    got = mixing.fit(d)
    grid = np.linspace(0, 1, 200_001)
    able = [a for a in grid[::50] if (lambda w: (w / tokens).max() / (w / tokens).min())(weights_of(tokens, a)[0]) <= mixing.REPEATS + 1e-9]
    enough = [a for a in able if weights_of(tokens, a)[1] >= mixing.ENTROPY * np.log(len(tokens))]
    want = max(enough) if enough else min(able)
    assert abs(got.alpha - want) < 1e-3
    reads = got.budget * weights_of(tokens, got.alpha)[0] / np.array(tokens)
    assert abs(reads.min() - 1) < 1e-6 and reads.max() <= mixing.REPEATS + 1e-6
    assert abs(got.entropy - weights_of(tokens, got.alpha)[1]) < 1e-9


def test_places_of_epochs_are_apart(spark):
    """Whatever the number of blocks: a place of a source belongs to one block of one epoch, and sources meet their budget."""
    rng = np.random.default_rng(8)
    made = [(i, f"s{int(i > 2500)}", " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(1, 60, 3000))]
    rows, mixture = mixing.mix(spark.createDataFrame(made, "doc_id bigint, source string, text string"), blocks=4096)
    rows = rows.collect()
    at = {}
    for r in rows:
        assert at.setdefault((r["source"], r["place"]), (r["epoch"], r["block"])) == (r["epoch"], r["block"])
    tokens = [sum(len(t.split()) for _, s, t in made if s == k) for k in ("s0", "s1")]
    wanted = mixture.budget * weights_of(tokens, mixture.alpha)[0]
    per_block = Counter()
    for r in rows:
        per_block[r["source"], r["epoch"], r["block"]] += r["tokens"]
    largest = max(per_block.values())
    for k, w in zip(("s0", "s1"), wanted):
        assert abs(sum(r["tokens"] for r in rows if r["source"] == k) - w) <= largest


def test_entropy_target(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 500), ("c", 250)], "source string, tokens bigint")
    m = mixing.fit(s, repeats=100.0, entropy=0.95)
    assert abs(m.entropy - 0.95 * np.log(3)) < 1e-3 and 0 < m.alpha < 1
    assert mixing.fit(s.filter("source = 'a'")).alpha == 1.0 and mixing.fit(s.filter("false")).budget == 0


def test_mixed_rows(docs, clashing, empty):
    m = mixing.mixed(clashing)
    assert m.columns == clashing.columns
    want = Counter(r["doc_id"] for r in mixing.mix(docs)[0].collect())
    assert Counter(r["doc_id"] for r in m.collect()) == want and mixing.mixed(empty).collect() == []


# --- 7: quality classifier ---


def test_classifier(spark, docs, clashing, empty):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["the", "river", "house", "green", "walks", "slowly", "and", "sings"], 60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click", "***", "FREE!!", "win%%"], 60)) for _ in range(120)]
    made = [(i, t) for i, t in enumerate(good + bad)]
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality_model.classified(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 240 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] < 120) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    # what held-out rows are labelled changes nothing
    flipped = spark.createDataFrame([(i, int(i < 120) ^ (zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(240)], "doc_id bigint, quality int")
    assert quality_model.learn(d, flipped) == quality_model.learn(d, labels)
    odd = quality_model.classified(clashing, labels).collect()
    assert len(odd) == docs.count() and all(r["score"] is not None for r in odd)
    assert quality_model.classified(empty, labels.filter("false")).collect() == []
    assert {round(r["score"], 6) for r in quality_model.classified(docs, labels.filter("false")).collect()} == {0.5}


# --- 8: token counts ---


def test_token_counts(spark, docs, clashing, empty):
    import sentencepiece

    odd = ["a  b   c", "   ", " ", "  x", "x  ", "a▁▁b", " \n ", "\x00a", "é" * 70 + " " + "a" * 200, "<s> </s> <unk>", "🙂 🙂🙂", "　 x", "word " * 20_000, None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    for frame, source in ((d, d), (clashing, docs)):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(frame).collect())
        want = Counter()
        for i, t in texts(source):
            n = len(lib.encode(t)) if t else 0
            want[i, len((t or "").encode()), n, n > 4096] += 1
        assert got == want
    assert token_counts.token_counts(empty).collect() == []


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_chunk_maps_compose(chunk):
    import sentencepiece

    t = token_counts.Transducer(token_counts.model_path())
    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    for x in ("a  b   c", "   ", "  x", "x  ", "▁a▁", "the quick brown fox", "x" * 30, " a" * 40, "日本語 text 日", "aaaaaaaaaaaaaaaab" * 9, "=====----====", "Ñandú's naïve—café"):
        assert t.count(x, chunk) == len(lib.encode(x)), x


def test_transitions_emit_counts_of_prefixes():
    """What the transitions up to a place emitted is the library's count of that prefix; also with a table that overflows."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    t = token_counts.Transducer(token_counts.model_path())
    text = "Internationalization of unbelievable things, incl. naïve ones: aaaaaaa 12345"
    state, total = t.run(t.start, "▁")
    for i, c in enumerate(text):
        state, n = t.run(state, token_counts.escaped(c)[1:])
        total += n
        assert total == len(lib.encode(text[: i + 1])), text[: i + 1]


@pytest.mark.parametrize("chunk, fan, compiled", [(64, 1, 200_000), (64, 3, 200_000), (50, 2, 300), (4096, 256, 200_000)])
def test_whole_tables_count_like_the_library(spark, sf, monkeypatch, chunk, fan, compiled):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    if compiled < 1000:
        d = d.limit(30)
    d = d.persist()
    monkeypatch.setattr(token_counts, "COMPILED", compiled)
    want = Counter((i, len(lib.encode(t or ""))) for i, t in texts(d))
    got = token_counts.token_counts(d.union(d.limit(5)), chunk=chunk, fan=fan).collect()
    assert Counter({(r["doc_id"], r["n_tokens"]): 1 for r in got}) == want and len(got) == sum(want.values()) + 5


# --- 10: decontamination ---


def test_decontamination(spark, docs, clashing, empty):
    rng = np.random.default_rng(6)
    v = [f"t{i}" for i in range(3000)]
    item = [" ".join(rng.choice(v, 40)) for _ in range(4)] + ["short item of five words"]
    noise = lambda n: " ".join(rng.choice(v, n))
    words = item[1].split()
    edited = " ".join(w if i % 6 else "zz" for i, w in enumerate(words))
    gapped = " ".join(words[:15] + ["extra", "words"] + words[18:])
    made = [
        (0, noise(80)), (1, noise(50) + " " + item[0] + " " + noise(9)), (2, edited), (3, noise(3) + " " + gapped), (4, item[2].upper()),
        (5, item[3] + " . " + item[0]), (6, " ".join(reversed(words))), (7, "a " + item[4]), (8, " ".join(words[:12])), (9, None), (10, "")
    ]
    b = spark.createDataFrame(list(enumerate(item)) + [(9, None), (None, "x y z"), (0, item[0])], "item_id bigint, text string")
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (5, 0), (7, 4)}
    assert got[1, 0]["score"] == 1.0 and (got[1, 0]["first_word"], got[1, 0]["end_word"]) == (50, 90)
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(d, b).collect()) == [0, 6, 8, 9, 10]
    assert decontaminate.keep_clean(clashing, b).columns == clashing.columns and decontaminate.keep_clean(clashing, b).count() == docs.count()
    assert decontaminate.contaminated(empty, b).collect() == [] and decontaminate.contaminated(d, b.filter("false")).collect() == [] and decontaminate.keep_clean(empty, b).collect() == []


def plain_align(item, window):
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i, a in enumerate(item, 1):
        for j, w in enumerate(window, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == w else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_score():
    rng = np.random.default_rng(9)
    for _ in range(60):
        item, window = rng.integers(0, 6, int(rng.integers(1, 25))), rng.integers(0, 6, int(rng.integers(1, 40)))
        best, begin, end = decontaminate.align(item, window)
        assert best == plain_align(item, window) == (plain_align(item, window[begin:end]) if best else 0)


def test_edited_copies_are_all_found(spark):
    """As Smith-Waterman over the whole text says, whatever edits leave of the item's n-grams."""
    rng = np.random.default_rng(11)
    v = [f"t{i}" for i in range(500)]
    items = [(n, " ".join(rng.choice(v, int(rng.integers(20, 60))))) for n in range(12)] + [(12, "two words"), (13, "alone")]
    noise = lambda: rng.choice(v, int(rng.integers(0, 30))).tolist()
    texts = []
    for _, t in items:
        words = t.split()
        edits = [[w if i % k else "zz" for i, w in enumerate(words, 1)] for k in (2, 3, 4, 5)]
        edits += [[x for w in words for x in (w, "zz")][:-1], [w if rng.random() > 0.25 else "zz" for w in words], [w for w in words if rng.random() > 0.3]]
        texts += [" ".join(noise() + e + noise()) for e in edits]
    # the edited copies are many beside documents that hold each n-gram once
    texts += [t for _, t in items]
    expected = {}
    for d, t in enumerate(texts):
        for n, item in items:
            score = plain_align(item.split(), t.split()) / (2 * len(item.split()))
            if score >= max(0.5, min(1, 8 / len(item.split()))):
                expected[d, n] = score
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()} == expected
    assert len(expected) > 60 and min(expected.values()) < 0.53


def test_blocks_of_the_benchmark(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"item {i} has some words in it") for i in range(10)], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert [len(x) for x in decontaminate.blocks(b)] == [3, 3, 3, 1]
    d = spark.createDataFrame([(1, "so item 7 has some words in it"), (2, "nothing")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).filter("score = 1").collect()}
    assert found == {(1, 7)}


def test_staged_tables_go_to_the_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
