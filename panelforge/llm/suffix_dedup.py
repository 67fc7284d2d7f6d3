"""Removal of repeated passages by a sparse suffix array.

A byte goes if a string of WINDOW bytes that covers it also starts earlier. Sorting every suffix of a corpus would move many
times its size, so suffixes are sampled where content says so: every window has as anchor the place of its least GRAM-byte
hash, which equal windows share. What decides about an anchor's windows is its context, the REACH bytes before it and those
after.

1. Anchors (about one byte in thirty) are grouped by the anchor's hash and the context's. A context seen before goes whole.
2. Anchors alone with their hash go nowhere. What is left are first occurrences of different contexts with one anchor:
   the borders of repeated passages. Only their contexts are fetched.
3. Those contexts share at least GRAM bytes, and are sorted as suffixes, to the right and to the left of the anchor, by
   deep-shallow sorting: multikey sorting, eight bytes a character, to SHALLOW bytes (all groups of a depth at once, by one
   library sort in place of pivots); blind tries order the groups whose common prefix is longer. Neighbours' common prefixes then give classes of equal strings for every length, a window is a
   pair of a left and a right class, and in each pair all but the earliest window go.
4. Spans are cut out of the texts.

Steps 1 and 2 take equal 64-bit hashes, of an anchor and of its context, for equal strings and don't compare bytes.

Groups of copies are reduced to their first context where they are read, before any shuffle. An anchor with more than HOT
different contexts (a passage in very many documents), or more than HOT_HERE in one chunk, isn't sorted in one task: its
windows are dealt by their own hash, and a chunk sends its anchor's task one row in place of all contexts.
Texts cross the network once; the exchange is used for both joins. Contexts and windows travel one a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, staged, utf8, width

WINDOW = 100
GRAM = 36
REACH = WINDOW - GRAM
SHALLOW_RIGHT, SHALLOW_LEFT = 48, 16
HOT = 4_000  #: different contexts of one anchor that a task sorts, about 1 MB
HOT_HERE = 400  #: different contexts of one anchor in one chunk, beyond which the chunk sends word of them only
CHUNK = 8_000_000  #: bytes of text whose anchors are reduced together
PART_BYTES, PARTS = 4 << 20, 20_000  #: text for each partition of anchors, up to that many partitions
SLAB = 1 << 18  #: bytes hashed at a time
NO_ID = -(1 << 63)  #: stands for a null id: before all others

REC = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("pos", "<i4")])
CTX = np.dtype([("a", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("hold", "u1", (REACH + WINDOW,))])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u4"), ("start", "<i4"), ("end", "<i4")])

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


class _Hasher:
    """Polynomial hashes, modulo 2**64, of any substring of a slab."""

    def __init__(self, size: int) -> None:
        self.value = np.random.default_rng(1).integers(1, 1 << 64, 256, _U)
        self.up, self.down = np.ones(size, _U), np.ones(size, _U)
        np.multiply.accumulate(np.full(size - 1, _U(_BASE)), out=self.up[1:])
        np.multiply.accumulate(np.full(size - 1, _U(pow(_BASE, -1, 1 << 64))), out=self.down[1:])

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _extreme(x: np.ndarray, span: int, which) -> np.ndarray:
    """which (np.minimum or np.maximum) over every run of span entries."""
    done = 1
    while done * 2 <= span:
        x, done = which(x[:-done], x[done:]), done * 2
    return which(x[: len(x) - (span - done)], x[span - done :]) if span > done else x


def anchors(texts: list[bytes], hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """Of texts of WINDOW bytes or more that fill a slab at most: the anchors' hashes, context hashes, texts and places."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    sums = hasher.sums(data)
    n = len(data) - GRAM + 1
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * hasher.down[:n]) | _U(1)
    least = _extreme(grams, REACH + 1, np.minimum)
    for e in ends[:-1]:  # windows across two texts choose nothing
        least[e - WINDOW + 1 : e] = 0
    pad = np.zeros(REACH, _U)
    chosen = np.flatnonzero(_extreme(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == grams)
    text = np.searchsorted(ends, chosen, "right")
    low, high = np.maximum(chosen - REACH, starts[text]), np.minimum(chosen + WINDOW, ends[text])
    context = hasher.of(sums, low, high) ^ _mixed(((chosen - low) * 256 + (high - chosen)).astype(_U))
    # least hashes are small numbers: mixed again, they spread over all ranges
    return _mixed(grams[chosen]), context, text, chosen - starts[text]


def _slabs(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Texts of WINDOW bytes or more, in slabs, with their numbers and offsets; longer ones are cut with enough overlap for
    every window and context."""
    part, which, offset, size = [], [], [], 0
    margin, step = 2 * WINDOW, SLAB - 8 * WINDOW
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), step) if len(t) >= WINDOW else ():
            low = max(0, at - margin)
            cut = t[low : at + step + 2 * margin]
            if size + len(cut) > SLAB:
                yield part, which, offset
                part, which, offset, size = [], [], [], 0
            part.append(cut)
            which.append(i)
            offset.append(low)
            size += len(cut)
    if part:
        yield part, which, offset


def first_ones(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """REC rows: the first of each (a, b) in the order of (doc, tie, pos), sorted by (a, b); and the later ones."""
    rows = rows[np.lexsort((rows["pos"], rows["tie"], rows["doc"], rows["b"], rows["a"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    same = (rows["doc"] == head["doc"]) & (rows["tie"] == head["tie"]) & (rows["pos"] == head["pos"])  # the same row read twice
    return rows[new], rows[~new & ~same]


def _slots(rows: np.ndarray, parts: int) -> np.ndarray:
    """The range of a, of parts ranges, that each row falls into."""
    return ((rows["a"] >> _U(32)) * _U(parts)) >> _U(32)


def _dealt(rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows sorted by a, cut by ranges of a into parts."""
    slot = _slots(rows, parts)
    cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(rows) else []
    for i, j in zip(cuts, [*cuts[1:], len(rows)]):
        yield int(slot[i]), rows[i:j].tobytes()


def _scattered(kind: int, rows: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Rows that any partition may have, in pieces that go to partitions by a hash of their first document."""
    return [(kind, (int(rows["tie"][i]) + i // 2_000) % parts, rows[i : i + 2_000].tobytes()) for i in range(0, len(rows), 2_000)]


def _blobs(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    kinds, slots, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), pa.array(slots, pa.int32()), pa.array(bodies, pa.binary())], ["kind", "slot", "body"])


def _singly(kind: int, rows: np.ndarray, parts: int) -> Iterator:
    """Each row by itself to its range of a, in Arrow batches: a group has few rows for each range, and pieces of them would
    grow in number with groups times ranges."""
    import pyarrow as pa

    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        n, size = len(part), part.dtype.itemsize
        ends = pa.py_buffer(np.arange(0, (n + 1) * size, size, np.int32))
        body = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(part.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(_slots(part, parts).astype(np.int32)), body], ["kind", "slot", "body"])


def _tie(text: bytes) -> int:
    """Tells apart texts that share an id: the lower half of what Spark's xxhash64 gives."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text, 42) & 0xFFFFFFFF


def _ids(column) -> list[int]:
    return [NO_ID if x is None else x for x in column.to_pylist()]


def _sampled(parts: int):
    """Documents to their anchors. kind 0: first ones by range of hash; kind 1: spans of contexts already seen here; kind 2:
    the contexts of anchors that are hot here, of which kind 0 has one row, at place -1."""

    def reduced(held: list[tuple[int, bytes]], hasher: _Hasher):
        held.sort(key=lambda x: x[0])
        first: dict[bytes, int] = {}
        whole, ids, texts = [], [], []
        for i, t in held:
            if t not in first:
                first[t] = i
                ids.append(i)
                texts.append(t)
            elif i != first[t]:  # a copy: all of it starts earlier
                whole.append((i, _tie(t), 0, len(t)))
        ties, found = [_tie(t) for t in texts], []
        for part, which, offset in _slabs(texts):
            a, b, text, pos = anchors(part, hasher)
            rec = np.empty(len(a), REC)
            number = np.array(which)[text]
            rec["a"], rec["b"], rec["pos"] = a, b, pos + np.array(offset)[text]
            rec["doc"], rec["tie"] = np.array(ids, np.int64)[number], np.array(ties, np.uint32)[number]
            found.append(rec)
        heads, later = first_ones(np.concatenate(found)) if found else (np.zeros(0, REC),) * 2
        spans = np.empty(len(later) + len(whole), SPAN)
        for f, x in (("doc", later["doc"]), ("tie", later["tie"]), ("start", later["pos"] - REACH), ("end", later["pos"] + WINDOW)):
            spans[f][: len(later)] = x
        spans[len(later) :] = np.array(whole, SPAN) if whole else np.zeros(0, SPAN)
        new = np.r_[True, heads["a"][1:] != heads["a"][:-1]][: len(heads)]
        hot = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] > HOT_HERE
        word = heads[hot & new].copy()
        word["b"], word["doc"], word["tie"], word["pos"] = 0, NO_ID, 0, -1
        sent = np.concatenate([heads[~hot], word])
        rows = [(0, s, body) for s, body in _dealt(sent[np.argsort(sent["a"], kind="stable")], parts)]
        rows += _scattered(2, heads[hot], parts) + _scattered(1, spans, parts)
        return _blobs(rows)

    def run(batches: Iterator) -> Iterator:
        hasher, held, size = _Hasher(SLAB + 1), [], 0
        for batch in batches:
            for i, t in zip(_ids(batch.column("doc_id")), utf8(batch.column("text"))):
                if t and len(t) >= WINDOW:
                    held.append((i, t))
                    size += len(t)
                    if size >= CHUNK:
                        yield reduced(held, hasher)
                        held, size = [], 0
        if held:
            yield reduced(held, hasher)

    return run


def _marks(doc, tie, start, end, a=None, hot=None):
    import pyarrow as pa

    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc.astype(np.int64)), pa.array(tie.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
            pa.array(a.view(np.int64)) if a is not None else pa.nulls(n, pa.int64()), pa.array(hot) if hot is not None else pa.nulls(n, pa.bool_()),
        ],
        ["doc", "tie", "start", "end", "a", "hot"],
    )


MARKS = "doc bigint, tie bigint, start int, end int, a bigint, hot boolean"


def _bodies(batches: Iterator, kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """The rows of each kind, however many a body holds."""
    import pyarrow as pa

    got: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k in np.unique(kind).tolist():
            body = batch.column("body").filter(pa.array(kind == k)).cast(pa.large_binary())
            _, ends, data = body.buffers()
            ends = np.frombuffer(ends, np.int64)[body.offset : body.offset + len(body) + 1]
            got[k].append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kinds[k]))
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in got.items()}


def _grouped(batches: Iterator) -> Iterator:
    """All anchors of a range of hashes: spans of contexts seen before, and the places whose contexts are wanted (a set)."""
    got = _bodies(batches, {0: REC, 1: SPAN, 2: REC})
    spans, sent = got[1], got[2]
    if len(sent):
        yield _marks(sent["doc"], sent["tie"], sent["pos"], sent["pos"], np.ascontiguousarray(sent["a"]), np.ones(len(sent), bool))
    if len(spans):
        yield _marks(spans["doc"], spans["tie"], spans["start"], spans["end"])
    heads, later = first_ones(got[0])
    if len(later):
        yield _marks(later["doc"], later["tie"], later["pos"] - REACH, later["pos"] + WINDOW)
    new = np.ones(len(heads), bool)
    new[1:] = heads["a"][1:] != heads["a"][:-1]
    at = np.cumsum(new) - 1
    size = np.bincount(at, minlength=1)[at]
    hot = (size > HOT) | (np.bincount(at, heads["pos"] < 0, minlength=1)[at] > 0)
    taken = ((size > 1) | hot) & (heads["pos"] >= 0)
    want, many = heads[taken], hot[taken]
    if len(want):
        yield _marks(want["doc"], want["tie"], want["pos"], want["pos"], np.ascontiguousarray(want["a"]), many)


def _runs(marks) -> dict[tuple[int, int], np.ndarray]:
    """Rows of an Arrow table of marks by document."""
    doc, tie = marks.column("doc").to_numpy(), marks.column("tie").to_numpy()
    order = np.lexsort((tie, doc))
    doc, tie = doc[order], tie[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]) if len(doc) else []
    return {(int(doc[i]), int(tie[i])): order[i:j] for i, j in zip(cuts, [*cuts[1:], len(doc)])}


def _fetched(parts: int):
    """Texts and the places wanted in them. kind 0: contexts, a row each, by range of hash; kind 1: windows of hot anchors, a
    row each, by range of their own hash, first ones; kind 2: spans of windows already seen here."""

    def run(texts, marks):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        wanted, contexts, windows = _runs(marks), [], []
        start, a, hot = marks.column("start").to_numpy(), marks.column("a").to_numpy(), marks.column("hot").to_numpy(zero_copy_only=False)
        seen = set()
        for doc, t in zip(_ids(texts.column("doc_id")), utf8(texts.column("text"))) if wanted else ():
            at = (doc, _tie(t)) if t else None
            if at not in wanted or at in seen:
                continue
            seen.add(at)
            for i in wanted[at].tolist():
                p = int(start[i])
                left, right = t[max(0, p - REACH) : p], t[p : p + WINDOW]
                if hot[i]:
                    low, high = max(0, p - REACH), min(p, len(t) - WINDOW)
                    windows += [(*np.frombuffer(xxh3_128_digest(t[s : s + WINDOW]), "<u8").tolist(), *at, s) for s in range(low, high + 1)]
                else:
                    contexts.append((int(a[i]) & ((1 << 64) - 1), *at, p, len(left), len(right), left.rjust(REACH, b"\0") + right.ljust(WINDOW, b"\0")))
        ctx = np.zeros(len(contexts), CTX)
        if contexts:
            columns = list(zip(*contexts))
            for f, x in zip(("a", "doc", "tie", "pos", "left", "right"), columns):
                ctx[f] = x
            ctx["hold"] = np.frombuffer(b"".join(columns[-1]), np.uint8).reshape(len(contexts), -1)
        heads, later = first_ones(np.array(windows, REC))
        spans = _spans(later["doc"], later["tie"], later["pos"])
        return pa.Table.from_batches([_blobs(_scattered(2, spans, parts)), *_singly(0, ctx, parts), *_singly(1, heads, parts)])

    return run


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows that begin at start, those that begin next to each other as one span."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + WINDOW)
    at = np.flatnonzero(new)
    out = np.empty(len(at), SPAN)
    out["doc"], out["tie"], out["start"] = doc[at], tie[at], start[at]
    out["end"] = (start[np.r_[at[1:] - 1, len(doc) - 1]] if len(at) else start) + WINDOW
    return out


# --- deep-shallow sorting ---


def _shallow(group: np.ndarray, data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, all groups at once: rows are sorted by their next character (eight bytes) within their group, and
    rows of one character make a group of the next round; a group of one row is done. Returns the order, and the group of
    each row in that order."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    for c in range(0, depth, 8):
        size = np.bincount(np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1)
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        character = np.ascontiguousarray(data[order[open_], c : c + 8]).view(">u8").ravel()
        moved = np.lexsort((character, group[open_]))
        order[open_] = order[open_][moved]
        character, own = character[moved], group[open_]
        split = np.zeros(len(group), bool)
        split[open_[1:]] = (open_[1:] == open_[:-1] + 1) & (own[1:] == own[:-1]) & (character[1:] != character[:-1])
        group = group + np.cumsum(split)
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    return order, group


class BlindTrie:
    """Sorts strings of one length, as big-endian integers, that share a long prefix. An inner node is [depth in bits, child
    0, child 1]; a leaf is a list of equal strings' numbers in a tuple. A string is sent down by single bits, unseen
    otherwise, compared once with the leaf it meets, and put in where they first differ."""

    def __init__(self, values: list[int], bits: int) -> None:
        self.values, self.bits, self.root = values, bits, None
        for i in range(len(values)):
            self.add(i)

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = ([i],)
            return
        v, top, node = self.values[i], self.bits - 1, self.root
        while len(node) == 3:
            node = node[1 + (v >> (top - node[0]) & 1)]
        differ = v ^ self.values[node[0][0]]
        if not differ:
            node[0].append(i)
            return
        depth = self.bits - differ.bit_length()
        parent, node = None, self.root
        while len(node) == 3 and node[0] < depth:
            parent, side = node, 1 + (v >> (top - node[0]) & 1)
            node = node[side]
        new = [depth, node, ([i],)] if v >> (top - depth) & 1 else [depth, ([i],), node]
        if parent is None:
            self.root = new
        else:
            parent[side] = new

    def sorted(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += (node[2], node[1])
            else:
                out += node[0]
        return out


def deep_shallow(group: np.ndarray, data: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of data's rows within groups of equal `group`, and each one's common prefix with the one before it (-1 at a
    group's start)."""
    order, fine = _shallow(group, data, shallow)
    cuts = np.flatnonzero(np.r_[True, fine[1:] != fine[:-1], True]) if len(order) else np.zeros(1, int)
    for i, j in zip(cuts[:-1], cuts[1:]):
        if j - i > 1:
            rows = order[i:j]
            trie = BlindTrie([int.from_bytes(r, "big") for r in map(bytes, data[rows])], 8 * data.shape[1])
            order[i:j] = rows[trie.sorted()]
    ranked = data[order]
    common = np.full(len(order), -1)
    if len(order) > 1:
        differ = ranked[1:] != ranked[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), data.shape[1])
        common[1:][group[order][1:] != group[order][:-1]] = -1
    return order, common


def repeated_windows(ctx: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, start) of every window of the contexts that an earlier one of them also has."""
    ctx = ctx[np.lexsort((ctx["pos"], ctx["tie"], ctx["doc"]))]
    same = np.unique(ctx["a"], return_inverse=True)[1]
    right, left = np.ascontiguousarray(ctx["hold"][:, REACH:]), np.ascontiguousarray(ctx["hold"][:, REACH - 1 :: -1] if REACH else ctx["hold"][:, :0])
    order_r, common_r = deep_shallow(same, right, SHALLOW_RIGHT)
    order_l, common_l = deep_shallow(same, left, SHALLOW_LEFT)
    out, n = [], len(ctx)
    place = np.rec.fromarrays([ctx["doc"], ctx["tie"], ctx["pos"]]) if n else None
    for before in range(REACH + 1):
        after = WINDOW - before
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        class_r[order_r], class_l[order_l] = np.cumsum(common_r < after), np.cumsum(common_l < before)
        able = np.flatnonzero((ctx["left"] >= before) & (ctx["right"] >= after))
        pair = class_r[able] * (n + 1) + class_l[able]
        _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)  # rows are in order: the first is the earliest
        head = able[first][inverse]
        later = able[(head != able) & (place[head] != place[able])] if n else able
        out.append((ctx["doc"][later], ctx["tie"][later], ctx["pos"][later].astype(np.int64) - before))
    return tuple(np.concatenate(x) for x in zip(*out))


def _resolved(batches: Iterator) -> Iterator:
    got = _bodies(batches, {0: CTX, 1: REC, 2: SPAN})
    _, later = first_ones(got[1])
    for spans in (_spans(*repeated_windows(got[0])), _spans(later["doc"], later["tie"], later["pos"].astype(np.int64)), got[2]):
        if len(spans):
            yield _marks(spans["doc"], spans["tie"], spans["start"], spans["end"])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return start[at], end[np.r_[at[1:] - 1, len(end) - 1]]


def _cut(texts, marks):
    import hashlib

    import pyarrow as pa

    by, out = _runs(marks), []
    start, end = marks.column("start").to_numpy(), marks.column("end").to_numpy()
    for doc, t in zip(_ids(texts.column("doc_id")), utf8(texts.column("text"))):
        t = t or b""
        at = by.get((doc, _tie(t))) if len(t) >= WINDOW else None
        removed = spans = 0
        kept = t
        if at is not None:
            low, high = np.maximum(start[at], 0), np.minimum(end[at], len(t))
            full = high - low >= WINDOW  # a context cut short by the text's ends may hold no window
            if full.any():
                low, high = merged(low[full], high[full])
                removed, spans = int((high - low).sum()), len(low)
                kept = b"".join(t[i:j] for i, j in zip([0, *high.tolist()], [*low.tolist(), len(t)]))
        out.append((None if doc == NO_ID else doc, len(t), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = zip(*out) if out else [[]] * 6
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _digest(texts, marks):
    return _cut(texts, marks).drop_columns(["kept"])


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs; with_text adds `kept`, the bytes
    that are left.

    Null texts are empty; texts below WINDOW bytes lose nothing. A null id comes before all others. Rows that repeat an id
    and a text are one document and get the same result; rows that share an id and differ in text are different documents,
    in the order of a hash of their texts. An empty table gives no rows. Other columns are not read.
    """
    source = bare(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width(docs.sparkSession), min(PARTS, -(-size // PART_BYTES)))
    blobs = "kind tinyint, slot int, body binary"
    buckets = 8 * parts

    def bucket(doc: str, tie: Column) -> Column:
        """By id and text: neither a null id nor one that repeats puts its texts into one group."""
        return F.pmod(F.xxhash64(F.coalesce(doc, F.lit(NO_ID)), tie), F.lit(buckets)).cast("int").alias("bucket")

    dealt = source.mapInArrow(_sampled(parts), blobs).repartitionById(parts, "slot")
    marks = staged(dealt.mapInArrow(_grouped, MARKS), "dedup-marks")
    tie = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def dealt_out(df: DataFrame):
        """The partitions of a stated number serve both joins: texts are dealt once, and in more parts the more there are."""
        return df.repartition(parts, "bucket").groupBy("bucket")

    texts = dealt_out(source.select(bucket("doc_id", tie), "doc_id", "text"))
    wanted = dealt_out(marks.filter("a is not null").select(bucket("doc", F.col("tie")), "*"))
    fetched = texts.cogroup(wanted).applyInArrow(_fetched(parts), blobs)
    borders = fetched.repartitionById(parts, "slot").mapInArrow(_resolved, MARKS)
    spans = dealt_out(marks.filter("a is null").union(borders).select(bucket("doc", F.col("tie")), "*"))
    if with_text:
        return texts.cogroup(spans).applyInArrow(_cut, DIGEST + ", kept binary")
    return texts.cogroup(spans).applyInArrow(_digest, DIGEST)


#: The digest in DuckDB, window by window: for small tables.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
j AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM j),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed FROM s GROUP BY doc_id),
e AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s
      UNION ALL SELECT doc_id, d.n, coalesce(max(b), 0) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, d.n),
k AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since, upto) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, lower(sha256(unhex(kept))) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
