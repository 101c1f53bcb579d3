"""Token counts of a piece vocabulary by a finite-state transducer that is compiled as it is met.

The vocabulary merges neighbouring pieces, best score first. A sequence of pieces is the encoding of its text exactly
when every two neighbours are, so each prefix of a text has one last piece, and it follows from the last pieces at the
few earlier places from which some piece of the vocabulary may still be under way. These places, with their last piece
and their count relative to the present place, are the state; there are finitely many. A transition carries the change
of the count. Where two characters stand together in no piece, the state is the start again.

Long texts are cut into chunks. A chunk becomes a map from entry states to (exit state, count), for the entry states
that its left context can leave. Composition of maps is associative, so the maps of a text are composed by a parallel
prefix scan: neighbours pairwise, in as many rounds as the number of chunks has binary digits. Should the entry that is
really met be missing from the map of a chunk, this chunk alone is run once more from that entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import byte_texts, row_of, stored_table

#: Characters of a chunk, and those before it from which its entry states are found.
CHUNK = 32_768
CONTEXTS = (24, 96, 512)
#: Compiled states that a task keeps; beyond that it starts compiling anew.
STATES = 120_000
SPACE = "▁"

#: No piece to the left: whatever follows is independent of what came before.
_NONE = -1

State = tuple[str, tuple[tuple[int, int, int], ...]]
START: State = ("", ((0, _NONE, 0),))


class Pieces:
    """The mergeable pieces of a vocabulary, with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: model.get_score(i) for i, t in self.text.items()}
        self.starts = {t[:n] for t in self.id for n in range(1, len(t))}
        self.together = {t[n : n + 2] for t in self.id for n in range(len(t) - 1)}
        self._beside: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, of equals the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, left: int, right: int) -> bool:
        """Whether two pieces next to each other stay as they are."""
        if left == _NONE:
            found = self._whole.get(right)
            if found is None:
                found = self._whole[right] = len(self.merged(self.text[right])) == 1
            return found
        found = self._beside.get((left, right))
        if found is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            a, b = self.text[left], self.text[right]
            found = self._beside[(left, right)] = self.merged(a + b) == [a, b]
        return found


class Transducer:
    """States by number, transitions as found: ``moves[state][character]`` is (next state, change of the count)."""

    def __init__(self, pieces: Pieces, states: int = STATES):
        self.pieces, self.most = pieces, states
        self._clear()

    def _clear(self) -> None:
        self.number: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def of(self, state: State) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def _next(self, state: State, c: str) -> tuple[State, int]:
        pieces, (under, places) = self.pieces, state
        last = places[-1][1]
        if last != _NONE and pieces.text[last][-1] + c not in pieces.together:
            return self._next(START, c)
        if c not in pieces.id:
            return START, len(c.encode("utf-8", "surrogatepass"))  # one token a byte
        for back, left, count in places:
            whole = under[len(under) - back :] + c
            own = pieces.id.get(whole)
            if own is not None and pieces.beside(left, own):
                change = count + 1
                break
        else:
            raise ValueError(f"no last piece at {under + c!r}")
        going = [(back + 1, left, count - change) for back, left, count in places if under[len(under) - back :] + c in pieces.starts]
        longest = going[0][0] if going else 0
        under = (under + c)[len(under) + 1 - longest :]
        return (under, (*going, (0, own, 0))), change

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and change of the count."""
        total, moves = 0, self.moves
        for c in text:
            found = moves[state].get(c)
            if found is None:
                after, change = self._next(self.states[state], c)
                if len(self.states) >= self.most:
                    self._clear()
                    moves = self.moves
                    state = self.of(after)
                    total += change
                    continue
                found = moves[state][c] = (self.of(after), change)
            state, change = found
            total += change
        return state, total

    def count(self, text: str) -> int:
        return self.run(0, prepared(text))[1]

    def chunk_map(self, context: str, text: str) -> list[tuple[str, str, int]]:
        """(entry, exit, count) for the entry states that the context leaves; no context means the start."""
        entries = {self.states[self.run(0, context[-n:] if context else "")[0]] for n in CONTEXTS}
        found = []
        for entry in sorted(entries):
            after, total = self.run(self.of(entry), text)
            found.append((written(entry), written(self.states[after]), total))
        return found


def prepared(text: str) -> str:
    """The text as the library sees it: one space before it, spaces as a visible mark; empty stays empty."""
    return (SPACE + text).replace(" ", SPACE) if text else ""


def written(state: State) -> str:
    return state[0] + "\n" + ";".join(f"{a},{b},{c}" for a, b, c in state[1])


def read_state(text: str) -> State:
    under, _, places = text.rpartition("\n")
    return under, tuple(tuple(int(n) for n in place.split(",")) for place in places.split(";"))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(Pieces(path))


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = transducer(path)
    for batch in batches:
        sizes, counts = [], []
        for text in byte_texts(batch):
            sizes.append(len(text))
            counts.append(machine.count(text.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    names = ["_row", "part", "context", "chunk"]
    for batch in batches:
        for row, text in zip(batch.column(0), batch.column(1), strict=True):
            seen = prepared(text.as_py())
            for part, at in enumerate(range(0, len(seen), chunk)):
                values = [[row.as_py()], [part], [seen[max(0, at - max(CONTEXTS)) : at]], [seen[at : at + chunk]]]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


_MAP = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())]))


def _mapped(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = transducer(path)
    for batch in batches:
        maps = [[{"entry": e, "exit": x, "n": n} for e, x, n in machine.chunk_map(c.as_py(), t.as_py())] for c, t in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, _MAP)], names=["_row", "part", "moves"])


def _rerun(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """One more move of a chunk, from the given entry."""
    machine = transducer(path)
    for batch in batches:
        moves = []
        for entry, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            after, total = machine.run(machine.of(read_state(entry)), text)
            moves.append([{"entry": entry, "exit": written(machine.states[after]), "n": total}])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(moves, _MAP)], names=["_row", "part", "moves"])


_MOVES = "array<struct<entry:string,exit:string,n:long>>"


def composed(maps: DataFrame, parts: int) -> DataFrame:
    """(_row, n_tokens) of (_row, part, moves): neighbours compose pairwise, round by round; null where an entry is missing."""

    def after(left: Column, right: Column) -> Column:
        def move(m: Column) -> Column:
            then = F.get(F.filter(right, lambda r: r["entry"] == m["exit"]), 0)
            return F.struct(m["entry"].alias("entry"), then["exit"].alias("exit"), (m["n"] + then["n"]).alias("n"))

        return F.transform(left, move)

    while parts > 1:
        pair = maps.groupBy("_row", F.expr("part div 2").cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "moves")))["moves"].alias("two"))
        both = F.when(F.size("two") == 1, F.col("two")[0]).otherwise(after(F.col("two")[0], F.get("two", F.lit(1))))
        maps, parts = stored_table(pair.select("_row", "part", both.alias("moves")), "maps"), -(-parts // 2)
    first = F.get(F.filter("moves", lambda m: m["entry"] == written(START)), 0)
    return maps.select("_row", F.when(first["exit"].isNotNull(), first["n"]).alias("n_tokens"))


def missing(maps: DataFrame) -> DataFrame:
    """(_row, part, entry): the first chunk of a text that is met in a state which its map does not hold."""

    def step(so_far: Column, one: Column) -> Column:
        own = F.get(F.filter(one["moves"], lambda m: m["entry"] == so_far["state"]), 0)
        stuck = so_far["part"].isNotNull()
        part = F.when(stuck, so_far["part"]).when(own.isNull(), one["part"])
        return F.struct(F.when(stuck | own.isNull(), so_far["state"]).otherwise(own["exit"]).alias("state"), part.alias("part"))

    start = F.struct(F.lit(written(START)).alias("state"), F.lit(None).cast("int").alias("part"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "moves")))
    found = maps.groupBy("_row").agg(F.aggregate(in_order, start, step).alias("s"))
    return found.where("s.part IS NOT NULL").select("_row", "s.part", F.col("s.state").alias("entry"))


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens of the whole text.

    Null and empty texts have no bytes and no tokens. Characters outside the vocabulary count one token a byte; control
    strings inside a text are ordinary text. Rows that repeat an id repeat; a null doc_id is passed on. Empty input
    gives no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(lambda b: _counted(b, path), f"doc_id {kind}, n_bytes long, n_tokens long")
    long = stored_table(row_of(rows.where(is_long)), "long-texts")
    cut = long.select("_row", "text").mapInArrow(lambda b: _cut(b, chunk), "_row long, part int, context string, chunk string")
    maps = cut.repartition("_row", "part").mapInArrow(lambda b: _mapped(b, path), f"_row long, part int, moves {_MOVES}")
    maps = stored_table(maps, "maps")
    parts = (maps.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        total = stored_table(composed(maps, parts), "composed")
        open_ = total.where("n_tokens IS NULL").select("_row")
        if not open_.limit(1).count():
            break
        lacking = stored_table(missing(maps.join(open_, "_row", "left_semi")), "missing")
        again = cut.join(lacking, ["_row", "part"]).select("_row", "part", "entry", "chunk").mapInArrow(lambda b: _rerun(b, path), f"_row long, part int, moves {_MOVES}")
        both = maps.unionByName(again).groupBy("_row", "part").agg(F.flatten(F.collect_list("moves")).alias("moves"))
        maps = stored_table(both, "maps")
    counted = long.join(total, "_row").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
    return short.unionByName(counted)
