"""Token counts by a compiled finite-state transducer.

The tokenizer merges the adjacent pair with the best score, leftmost first, until no pair makes a piece. Two facts turn that
into a machine that reads characters from left to right:

- A sequence of pieces is a text's encoding exactly if each two neighbours, encoded on their own, stay as they are: the
  first merge across a border would happen in those two pieces alone just as well. So the last piece of each prefix is the
  one piece that ends there and stays apart from the last piece of the prefix before it.
- No merge crosses two characters that stand side by side in no piece. Such a place, a word's start for one, is a boundary:
  the machine is in its start state there whatever came before.

A state thus holds, for each earlier place from which a piece may still grow, the characters read since, the last piece of
the prefix up to there, and its count relative to now. A transition on a character is annotated with the number of tokens
that it emits, the difference of the prefixes' counts (which may be negative where pieces merge). States and transitions are
compiled from the vocabulary's pieces and scores when they are first met; the library encodes nothing. A run from one word
boundary to the next begins and ends in the start state, so the transitions along it are joined into one, annotated with
their sum, which later runs of the same characters take as a whole.

A chunk of text acts on the machine as a state map: run its head, up to the first boundary, from whatever state it is
entered in; after that, emit a count and leave in a state that don't depend on the entry. Maps compose associatively, so
every text is cut into chunks of CHUNK characters, the chunks are mapped independently, and the maps are composed by a tree
scan: neighbours within a task first, up to FAN of them, then the rows that remain of a text after a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 4096  #: characters
FAN = 256  #: chunks of a text that are composed before the shuffle
COMPILED = 200_000  #: states, pairs or joined transitions kept; beyond that they are compiled anew
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """What the machine is compiled from: pieces and scores, read from the model's file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
        plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        merged = [p for p in self.score if len(p) > 1]
        #: character pairs that a merge can cross
        self.side_by_side = {p[i : i + 2] for p in merged for i in range(len(p) - 1)}
        #: whether a mark after another character is always a boundary
        self.marks_part = all(b != MARK or a == MARK for a, b in self.side_by_side)
        #: strings from which a longer piece may grow
        self.growing = {p[:i] for p in merged for i in range(1, len(p))}
        #: the merges of each piece that its own merges reach
        made = {p: self.merges(p) for p in self.score}
        self.traces = {p: trace for p, (parts, trace) in made.items() if parts == [p]}

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """A short string encoded as the tokenizer does it, merge by merge; and each merge's score, with the first and the
        last part after it."""
        parts, trace = list(text), []
        while True:
            able = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not able:
                return parts, trace
            least, i = min(able)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            trace.append((-least, parts[0], parts[-1]))

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether two pieces side by side stay as they are. Until a merge crosses their border each goes through its own
        merges in its own order, and the best of the two next ones and of the merge across comes first, the leftmost of
        equal ones."""
        score, own, other, i, j, x, y = self.score, self.traces[a], self.traces[b], 0, 0, a[-1], b[0]
        while True:
            across = score.get(x + y)
            left = own[i][0] if i < len(own) else None
            right = other[j][0] if j < len(other) else None
            if across is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is not None and (right is None or left >= right):
                x = own[i][2]
                i += 1
            elif right is not None:
                y = other[j][1]
                j += 1
            else:
                return True


class State(dict):
    """Transitions: a character to (next state, tokens emitted). live: (grown, last, count) for each place a piece may grow
    from, the nearest one last: the characters read since, the piece that ends there, and its count relative to now."""

    __slots__ = ("live",)

    def __init__(self, live: tuple = ()) -> None:
        self.live = live


@dataclass(frozen=True)
class ChunkMap:
    """How a chunk acts: from its entry state it runs `head`. Without a boundary (exit is None) that is all; else the
    boundary follows, `count` tokens are emitted and `exit`, a state's live places, is where it leaves."""

    head: str
    count: int = 0
    exit: tuple | None = None


class Transducer:
    """The compiled tokenizer of one worker."""

    def __init__(self, path: str) -> None:
        self.words = Vocabulary(path)
        self.start = State()
        self.states, self.apart, self.joined = {(): self.start}, {}, {}

    def state(self, live: tuple) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State(live)
        return found

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether two pieces side by side stay as they are."""
        found = self.apart.get((a, b))
        if found is None:
            found = self.apart[a, b] = self.words.stay_apart(a, b)
        return found

    def compile(self, state: State, c: str) -> tuple[State, int]:
        """Adds state's transition on c."""
        words, live = self.words, state.live
        if c not in words.score:  # unknown: its bytes are tokens, and nothing merges with it
            state[c] = self.start, len(c.encode())
            return state[c]
        if not live or live[-1][1][-1] + c not in words.side_by_side:
            live = (("", "", 0),)
        grown, last, count = [], None, 0
        for since, before, n in live:
            string = since + c
            if last is None and string in words.traces and (not before or self._stay_apart(before, string)):
                last, count = string, n + 1
            if string in words.growing:
                grown.append((string, before, n))
        state[c] = self.state((*[(s, b, n - count) for s, b, n in grown], ("", last, 0))), count
        return state[c]

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after text, and the tokens emitted."""
        total = 0
        for c in text:
            try:
                state, n = state[c]
            except KeyError:
                state, n = self.compile(state, c)
            total += n
        if len(self.apart) > COMPILED:
            self.apart.clear()
        if len(self.joined) > COMPILED:
            self.joined.clear()
        if len(self.states) > COMPILED:
            self.start = State()
            self.states = {(): self.start}
            state = self.state(state.live)
        return state, total

    def run_words(self, text: str) -> tuple[State, int]:
        """run() from the start state, word by word: the transitions of each closed run are joined when it is first met."""
        parts = text.split(MARK)
        if len(parts) < 3 or not self.words.marks_part or "" in parts[1:]:  # runs of marks are read mark by mark
            return self.run(self.start, text)
        closed, joined = parts[1:-1], self.joined
        missing = [w for w in set(closed) if w not in joined]
        if missing:
            for w in missing:
                n = self.run(self.start, MARK + w)[1]  # may begin a table anew
                self.joined[w] = n
            joined = self.joined
        first = self.run(self.start, parts[0])[1] if parts[0] else 0
        try:
            total = first + sum(map(joined.__getitem__, closed))
        except KeyError:
            return self.run(self.start, text)
        state, n = self.run(self.start, MARK + parts[-1])
        return state, total + n

    def boundary(self, a: str, b: str) -> bool:
        """Whether no merge crosses from character a to b."""
        return a + b not in self.words.side_by_side

    def map(self, chunk: str) -> ChunkMap:
        """The state map of a chunk."""
        pairs, score = self.words.side_by_side, self.words.score
        first = next((i for i in range(len(chunk)) if chunk[i] not in score or i and chunk[i - 1 : i + 1] not in pairs), None)
        if first is None:
            return ChunkMap(chunk)
        state, count = self.run_words(chunk[first:])
        return ChunkMap(chunk[:first], count, state.live)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.exit is None:
            if a.head and b.head and self.boundary(a.head[-1], b.head[0]):
                a = ChunkMap(a.head, 0, ())
            else:
                return ChunkMap(a.head + b.head, b.count, b.exit)
        state, n = self.run(self.state(a.exit), b.head)
        return ChunkMap(a.head, a.count + n + b.count, state.live if b.exit is None else b.exit)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, pair by pair: log2 rounds."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def applied(self, whole: ChunkMap) -> int:
        """Tokens emitted from the start state on."""
        return self.run(self.start, whole.head)[1] + whole.count

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        marked = escaped(text)
        return self.applied(self.scan([self.map(marked[i : i + chunk]) for i in range(0, len(marked), chunk)])) if text else 0


_OWN: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """This process's machine: what one task has compiled serves those that follow in the same worker."""
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Transducer(path)
    return _OWN[path]


def escaped(text: str) -> str:
    """A text as the machine reads it: spaces as marks, and one before the first character."""
    return MARK + text.replace(" ", MARK) if text else ""


MAP = "n_bytes bigint, digest bigint, part int, copies bigint, head string, count bigint, exit string"


def _mapped(path: str, chunk: int, fan: int):
    """Texts to rows of state maps, one for every `fan` chunks, equal rows of a batch once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        machine = compiled(path)
        for batch in batches:
            copies: dict[tuple, int] = {}
            for at in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                copies[at] = copies.get(at, 0) + 1
            rows = []
            for (doc, text), n in copies.items():
                raw, marked = (text or "").encode(), escaped(text or "")
                digest = xxh3_64_intdigest(raw) - (1 << 63)
                for part, at in enumerate(range(0, max(1, len(marked)), chunk * fan)):
                    block = marked[at : at + chunk * fan]
                    m = machine.scan([machine.map(block[i : i + chunk]) for i in range(0, max(1, len(block)), chunk)])
                    rows.append((doc, len(raw), digest, part, n, m.head, m.count, None if m.exit is None else json.dumps(m.exit)))
            columns = zip(*rows) if rows else [[]] * 8
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ["doc_id", "n_bytes", "digest", "part", "copies", "head", "count", "exit"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _composed(path: str):
    """Rows of maps, those of a text together and in order, to the counts of texts. Only one text's maps are held."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine, key, maps, copies, last = compiled(path), None, [], 0, -1
        for batch in batches:
            out = []
            for doc, size, digest, part, n, head, count, exit_ in zip(*[c.to_pylist() for c in batch.columns]):
                if (doc, size, digest) != key:
                    if maps:
                        out.append((*key[:2], machine.applied(machine.scan(maps)), copies))
                    key, maps, copies, last = (doc, size, digest), [], 0, -1
                if part == 0:
                    copies += n
                if part != last:  # the same text again has the same map
                    left = None if exit_ is None else tuple(map(tuple, json.loads(exit_)))
                    maps.append(ChunkMap(head, count, left))
                    last = part
            yield _counts(out, batch.schema.field("doc_id").type)
            kind = batch.schema.field("doc_id").type
        if maps:
            yield _counts([(*key[:2], machine.applied(machine.scan(maps)), copies)], kind)

    def _counts(rows: list, kind):
        import pyarrow as pa

        columns = zip(*rows) if rows else [[]] * 4
        arrays = [pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "copies"])

    return run


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of docs, whole texts.

    path: the model's file, readable on every executor. Null and empty texts have no bytes and no tokens. Repeated rows
    are counted where they are read, composed once, and each get a row; an empty table gives none. Columns other than key
    and text are not read. Only maps cross the network, about a hundred bytes for a million characters or less.
    """
    at, source = path or model_path(), bare(docs, doc_id=key, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    maps = source.mapInArrow(_mapped(at, chunk, fan), f"doc_id {kind}, {MAP}")
    own = ("doc_id", "n_bytes", "digest")
    rows = maps.repartition(*own).sortWithinPartitions(*own, "part")
    found = rows.mapInArrow(_composed(at), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, copies bigint")
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return found.withColumn("copies", each).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
