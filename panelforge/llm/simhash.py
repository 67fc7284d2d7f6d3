"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint is the majority vote of the hashes of its 3-word shingles. Distinct fingerprints are linked at
MAX_BITS or fewer differing bits, and documents take the least id that links reach.

The pivot table holds the Hamming distances of each distinct fingerprint to PIVOTS reference fingerprints. It is worked out
once, by expressions, and stays beside the fingerprint. By the triangle inequality linked fingerprints differ by MAX_BITS at
most in every coordinate.

1. Proposing: MAX_BITS differing bits leave one of MAX_BITS + 1 blocks of a fingerprint untouched. Within the fingerprints
   that share a block, the first CELL_PIVOTS coordinates make a grid of cells MAX_BITS + 1 wide, so linked ones are in one
   cell or in neighbouring cells. Each has a row in its own cell and visits the neighbouring cells ahead of it that its
   distances can reach; pairs with at least one at home are proposed. Cells alone would have to face a large share of all
   pairs of a corpus, blocks alone would leave a frequent block to one task: together no pair is lost and no key is large.
2. Discarding: within a cell rows are in the order of a further coordinate, and a row faces those within MAX_BITS of it;
   a pair whose largest coordinate difference is greater than MAX_BITS goes.
3. Verifying: survivors are compared bit by bit.

A cell gives the edges of a spanning forest rather than all its pairs; pairs whose ends are connected already are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import resemblance
from .common import bare, free_name, small_batches, staged, utf8, width
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BLOCKS = MAX_BITS + 1
BLOCK_BITS = 64 // BLOCKS
PIVOTS = 24
CELL_PIVOTS = 2  #: coordinates that make cells
SIDE = 64 // (MAX_BITS + 1) + 1  #: cells of a coordinate
ROWS = 400_000  #: of whole cells, compared together
PAIRS = 1 << 20  #: proposed pairs held at a time
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer; 0 for null and for texts without a word."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), ">u8", max(1, len(words) - SHINGLE + 1))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def _prints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        values = pa.array([fingerprint(t) for t in utf8(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs."""
    source = bare(docs, doc_id=key, text=text)
    return source.mapInArrow(_prints, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint")


def pivots() -> list[int]:
    """The reference fingerprints, as signed integers: a fixed draw."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64).view(np.int64).tolist()


def distances(fp: Column) -> Column:
    """A row of the pivot table: Hamming distances to each reference fingerprint."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots()])


def cells(fp: Column, table: Column) -> Column:
    """array<struct<key, home>>: the cell that a fingerprint lives in and those that it visits, under each of its blocks."""
    at = [F.get(table, F.lit(p)).cast("long") for p in range(CELL_PIVOTS)]
    own, place = [F.floor(d / (MAX_BITS + 1)) for d in at], [d % (MAX_BITS + 1) for d in at]
    # a step up is in reach from all places of a cell but the first, a step down from all but the last
    reach = [{0: F.lit(True), 1: m > 0, -1: (m < MAX_BITS) & (c > 0)} for m, c in zip(place, own)]
    ahead = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    made = []
    for block in range(BLOCKS):
        value = F.shiftrightunsigned(fp, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
        for a, b in ahead:
            key = ((F.lit(block << BLOCK_BITS) + value) * SIDE + own[0] + a) * SIDE + own[1] + b
            made.append(F.when(reach[0][a] & reach[1][b], F.struct(key.alias("key"), F.lit((a, b) == (0, 0)).alias("home"))))
    return F.array_compact(F.array(*made))


def forest(key: np.ndarray, home: np.ndarray, values: np.ndarray, table: np.ndarray, tally: dict | None = None) -> list[tuple[int, int]]:
    """Edges (greater, smaller) that connect the values as all links between rows of one key do, one of the two at home.
    tally: counts of pairs proposed, left by the pivot table and linked are added to it."""
    order = np.lexsort((table[:, CELL_PIVOTS], key))
    key, home, values, table = key[order], home[order], values[order], table[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]][: len(key)])
    code = group * 256 + table[:, CELL_PIVOTS]
    here = np.arange(len(code))
    sizes = np.searchsorted(code, code + MAX_BITS, "right") - here - 1
    upto = np.cumsum(sizes)
    root, edges, a = np.arange(len(code)), [], 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    while a < len(code):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        i = np.repeat(here[a:b], sizes[a:b])
        j = np.arange(len(i)) - np.repeat(upto[a:b] - sizes[a:b] - (upto[a - 1] if a else 0), sizes[a:b]) + i + 1
        a, good = b, home[i] | home[j]
        proposed = int(good.sum())
        good &= root[i] != root[j]
        i, j = i[good], j[good]
        for p in range(PIVOTS):
            if p != CELL_PIVOTS:
                near = np.abs(table[i, p] - table[j, p]) <= MAX_BITS
                i, j = i[near], j[near]
        left = len(i)
        linked = np.bitwise_count(values[i] ^ values[j]) <= MAX_BITS
        i, j = i[linked], j[linked]
        if tally is not None:
            for name, n in (("proposed", proposed), ("left", left), ("linked", len(i))):
                tally[name] = tally.get(name, 0) + n
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((int(max(values[x], values[y])), int(min(values[x], values[y]))))
        if len(i):
            while (root[root] != root).any():
                root = root[root]
    return edges


def _edges(batches: Iterator) -> Iterator:
    """Rows (key, home, fp, table) in the order of key: the forests of their cells, some ROWS at a time."""
    import pyarrow as pa

    def done(parts: list) -> pa.RecordBatch:
        found = forest(*(np.concatenate(x) for x in zip(*parts)))
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        table = batch.column("table").flatten().to_numpy().reshape(-1, PIVOTS)
        cut = int(np.searchsorted(key, key[-1]))  # the last cell may go on
        if size + cut >= ROWS and (cut or key[0] != held[-1][0][-1]):
            yield done([*held, (key[:cut], home[:cut], fp[:cut], table[:cut])])
            held, size = [], 0
            key, home, fp, table = key[cut:], home[cut:], fp[cut:], table[cut:]
        held.append((key, home, fp, table))
        size += len(key)
    if held:
        yield done(held)


def tabled(distinct: DataFrame) -> DataFrame:
    """distinct with the pivot table's rows: written once, and read from then on."""
    return staged(distinct.withColumn("table", distances(F.col("fp"))), "simhash-table")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges that connect the same fingerprints as all links do. distinct: tabled(), no repeats."""
    rows = distinct.select("fp", "table", F.inline(cells(F.col("fp"), F.col("table"))))
    dealt = rows.repartition(width(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_edges, "u bigint, v bigint")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one vertex however many
    documents have them. component_id is the least non-null doc_id of the component, null if there is none. Repeated rows
    each get a row; an empty table gives none. Columns other than key and text are not read.
    """
    prints = staged(fingerprints(docs, key, text), "simhash")
    least = tabled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least))
    named = least.drop("table").join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(of_root, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _described(batches: Iterator) -> Iterator:
    """Rows (id, a, b, __text) with fingerprints, shingle-set hashes and band keys in place of texts."""
    import pyarrow as pa

    sketcher = resemblance.Sketcher()
    for batch in batches:
        texts = utf8(batch.column("__text"))
        sets = [resemblance.shingle_set(t) for t in texts]
        columns = (
            pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array([sketcher.set_hash(x) if len(x) else None for x in sets], pa.int64()),
            pa.array([sketcher.bands(x) for x in sets], pa.list_(pa.int64())),
        )
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("id", "a", "b")] + list(columns), ["id", "a", "b", "fp", "s", "bands"])


def _similar_prints(rows: DataFrame, marked: DataFrame, first: str, second: str, text: str) -> DataFrame:
    """(u, v): fingerprints of texts whose shingle sets are equal or similar. rows: _described(), staged."""
    found = (F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("a", "b")).alias("r"))
    sets = staged(rows.filter("s is not null").groupBy("s").agg(*found), "shingle-bands")
    pairs = staged(resemblance.stars(sets.select("s", "bands")), "shingle-pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    owner = sets.join(ends, "s", "left_semi").select("s", F.col("r.a").alias(first), F.col("r.b").alias(second))
    texts = marked.join(owner, [first, second]).select("s", F.col(f"`{text}`").alias("text")).dropDuplicates(["s"])
    similar = resemblance.similar(pairs, resemblance.shingle_sets(texts))
    at = sets.select("s", "fp")
    u, v = (at.withColumnsRenamed({"s": k, "fp": f"f{k}"}) for k in ("u", "v"))
    near = similar.join(u, "u").join(v, "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    equal = rows.select("s", F.col("fp").alias("u")).distinct().join(at.withColumnRenamed("fp", "v"), "s").select("u", "v")
    return near.union(equal).filter("u != v").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each group of near copies, with all their columns. Linked are fingerprints within
    MAX_BITS, as in classes(), and texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, which
    fingerprints miss (resemblance.py). Of a group the row with the least id stays, one without an id only where the group
    has no other; of rows that share that id the first by a hash of all their columns does.

    Rows are told apart by two 64-bit hashes over their columns (those of map type left out), not by their ids. Choosing
    reads fingerprints, ids and hashes alone; texts are read again, by the hashes of the rows that stay, and cross the
    network only where these are too many to be sent to every task. Rows that are equal throughout are a group's own copies:
    one of them stays. Null and empty texts link by their fingerprint; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    first, second, count = (free_name(docs, n) for n in ("__first", "__second", "__count"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumns({first: F.xxhash64(*plain), second: F.xxhash64(F.lit("second"), *reversed(plain))})
    slim = marked.select(F.col(f"`{key}`").alias("id"), F.col(first).alias("a"), F.col(second).alias("b"), F.col(f"`{text}`").alias("__text"))
    more = [StructField("fp", LongType()), StructField("s", LongType()), StructField("bands", ArrayType(LongType()))]
    rows = staged(slim.mapInArrow(_described, StructType([*slim.schema.fields[:3], *more])), "simhash-rows")
    edges = links(tabled(rows.select("fp").distinct())).union(_similar_prints(rows, marked, first, second, text))
    roots = components(edges)
    counted = rows.groupBy("id", "a", "b", "fp").agg(F.count("*").alias("n"))
    rooted = counted.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct(F.col("id").isNull(), "id", "a", "b")
    best = rooted.groupBy("root").agg(F.min_by(F.struct("a", "b", "n"), order).alias("best")).select("best.*")
    best = staged(best.withColumnsRenamed({"a": first, "b": second, "n": count}), "simhash-kept")
    single = marked.join(best.filter(F.col(count) == 1), [first, second], "left_semi")
    repeated = marked.join(best.filter(F.col(count) > 1), [first, second], "left_semi").dropDuplicates([first, second])
    return single.union(repeated).drop(first, second)
