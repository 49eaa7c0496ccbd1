"""Transcript parsing by a hidden Markov model, and canonical rendering.

A transcript is a table of lines in order. Each line shows one symbol: the kind
of speaker marker it starts with, its length, whether it asks, and whether it is
the transcript's first. The hidden state is the speaker's role and whether the
line opens a turn; a line that doesn't has the role of the line before it.
Start, transition and symbol probabilities are counted from lines of known role,
and the most probable states are found by Viterbi.

Long transcripts are cut into blocks of lines. In the algebra of maximum and
sum a block is a matrix from the state before it to the state at its end, and
matrices combine in any order. Blocks are therefore reduced in parallel, the
transcript's block matrices are solved in groups of ``FAN`` (and groups of
groups, where there are more), and then every block is decoded with the role
before it and at its end given. No task holds more than a block of lines or a
group of matrices.

Ties go to the role named first. Every line gives one row; reading the rendered
lines in order gives the canonical transcript, in which a header opens every
turn.

Rows: ids and turns are whole numbers, of either sign; a null text counts as an
empty line; rows with a null transcript id form one transcript; a null turn stands
before all others; lines of the same turn and place there stand in the order of
their texts, repeated ones together. Columns that are not named play no part, and
their names may be any. An empty table gives no rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.shape import dense_index
from foldspark.session import cut

ROLES = ("system", "user", "assistant")
# Speaker names in markers, in the order of ROLES.
NAMES = (("system", "instructions", "context"), ("user", "human", "question", "q", "customer", "student"),
         ("assistant", "ai", "bot", "answer", "a", "agent", "tutor"))
# Upper limits of a line's length in code points, by which lines are told apart.
LENGTHS = (0, 40, 80, 160, 320, 640, 1280)
SMOOTHING = 0.5
# Lines of a block (a power of two), and blocks that are solved together.
BLOCK = 64
FAN = 256
# Stands for a null id or turn.
_NO_ID = -(1 << 63)
_SYMBOLS = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 2 * 2

_MARK = (r"(?i)^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(%s)(?:\|?>|\]|\*\*:?|:\*\*|\s*:)\s*")


def _mark(names: tuple[str, ...]) -> str:
    return _MARK % "|".join(names)


def marked_role(text: Column) -> Column:
    """Number of the role a line's marker names, the number of roles if none."""
    out = F.lit(len(ROLES))
    for k in reversed(range(len(ROLES))):
        out = F.when(text.rlike(_mark(NAMES[k])), k).otherwise(out)
    return out


def content(text: Column) -> Column:
    """The line without its marker."""
    return F.regexp_replace(text, _mark(tuple(n for names in NAMES for n in names)), "")


def lines_of(transcripts: DataFrame, id_col: str, text_col: str, turn_col: str | None = None,
             role_col: str | None = None) -> DataFrame:
    """``(id, turn, line, text)``, and ``role``, of every line: the lines of a text
    count from 0. Turns order the texts of an id."""
    none = F.lit(_NO_ID)
    turn = none if turn_col is None else F.coalesce(F.col(turn_col).cast("long"), none)
    role = [] if role_col is None else [F.col(role_col).alias("role")]
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "text")
    return transcripts.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"),
                              turn.alias("turn"), *role, lines)


def observed(lines: DataFrame) -> DataFrame:
    """``lines`` with the marker's role, the line's content and its symbol,
    whose lowest bit tells the transcript's first place."""
    place = F.struct("turn", "line")
    first = lines.groupBy("id").agg(F.min(place).alias("_first"))
    length = F.lit(0)
    for limit in LENGTHS:
        length = length + (F.length("content") > limit).cast("int")
    marked = F.col("marker") < len(ROLES)
    parts = ((F.col("marker") * (len(LENGTHS) + 1) + length) * 2
             + F.col("content").rlike(r"\?\s*$").cast("int")) * 2
    return (lines.withColumn("marker", marked_role(F.col("text")))
            .withColumn("content", F.when(marked, content(F.col("text"))).otherwise(F.col("text")))
            .join(first, "id")
            .withColumn("symbol", parts + (place == F.col("_first")).cast("int")).drop("_first"))


# State 2 r is a line of role r that opens a turn, 2 r + 1 one that doesn't.
_N = 2 * len(ROLES)


def _follows(before: int, state: int) -> bool:
    return state % 2 == 0 or state // 2 == before // 2


@dataclass(frozen=True)
class Model:
    """Log probabilities of first states, state changes and symbols."""

    start: tuple[float, ...]
    change: tuple[tuple[float, ...], ...]
    show: tuple[tuple[float, ...], ...]


def _logs(counts: list[float], possible: list[bool]) -> tuple[float, ...]:
    total = sum(counts) + SMOOTHING * sum(possible)
    return tuple(math.log((c + SMOOTHING) / total) if p else -math.inf
                 for c, p in zip(counts, possible, strict=True))


def fit(lines: DataFrame) -> Model:
    """The model counted from ``observed`` lines with a known ``role``, where
    every source row is a turn. Lines of other roles than ``ROLES`` are not
    used."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")).cast("int") - 1
    known = cut(lines.filter(role >= 0).select(
        "id", "turn", "symbol", role.alias("r"), (F.col("line") > 0).cast("int").alias("later")))
    shown = [[0.0] * _SYMBOLS for _ in range(_N)]
    for row in known.groupBy("r", "later", "symbol").agg(F.count(F.lit(1)).alias("n")).collect():
        shown[2 * row["r"] + row["later"]][row["symbol"]] = row["n"]
    turns = known.groupBy("id", "turn", "r").agg(F.count(F.lit(1)).alias("n"))
    change = [[0.0] * _N for _ in range(_N)]
    for row in turns.groupBy("r").agg(F.count(F.when(F.col("n") > 1, 1)).alias("second"),
                                      F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("further")).collect():
        change[2 * row["r"]][2 * row["r"] + 1] = row["second"]
        change[2 * row["r"] + 1][2 * row["r"] + 1] = row["further"]
    after = turns.filter(F.col("turn") > _NO_ID).select("id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("to"))
    for row in (turns.join(after, ["id", "turn"]).groupBy("r", (F.col("n") > 1).cast("int").alias("later"), "to")
                .agg(F.count(F.lit(1)).alias("n")).collect()):
        change[2 * row["r"] + row["later"]][2 * row["to"]] = row["n"]
    start = [0.0] * _N
    for row in turns.groupBy("id").agg(F.min_by("r", "turn").alias("r")).groupBy("r").agg(
            F.count(F.lit(1)).alias("n")).collect():
        start[2 * row["r"]] = row["n"]
    return Model(_logs(start, [k % 2 == 0 for k in range(_N)]),
                 tuple(_logs(c, [_follows(k, j) for j in range(_N)]) for k, c in enumerate(change)),
                 tuple(_logs(c, [True] * _SYMBOLS) for c in shown))


def _step(scores: list[float], symbol: int, model: Model) -> tuple[list[float], list[int]]:
    """Scores after one more line, and the best state before it for each state."""
    out, back = [], []
    for to in range(_N):
        best = max(range(_N), key=lambda r: scores[r] + model.change[r][to])
        out.append(scores[best] + model.change[best][to] + model.show[to][symbol])
        back.append(best)
    return out, back


def _first_step(symbol: int, model: Model, before: int) -> list[float]:
    """Scores after a block's first line. The transcript's first line does not
    depend on the state before it."""
    if symbol & 1:
        return [model.start[r] + model.show[r][symbol] for r in range(_N)]
    return _step([0.0 if r == before else -math.inf for r in range(_N)], symbol, model)[0]


def block_matrix(symbols: list[int], model: Model) -> list[float]:
    """Best score of the block from each state before it to each state at its end."""
    rows = []
    for before in range(_N):
        scores = _first_step(symbols[0], model, before)
        for s in symbols[1:]:
            scores, _ = _step(scores, s, model)
        rows += scores
    return rows


def decode(symbols: list[int], model: Model, before: int, end: int) -> list[int]:
    """The best states of a block's lines, with the states before and at its end."""
    scores, backs = _first_step(symbols[0], model, before), []
    for s in symbols[1:]:
        scores, back = _step(scores, s, model)
        backs.append(back)
    out = [end]
    for back in reversed(backs):
        out.append(back[out[-1]])
    return out[::-1]


def _combined(matrices: list[list[float]]) -> list[float]:
    total = matrices[0]
    for m in matrices[1:]:
        total = [max(total[i * _N + k] + m[k * _N + j] for k in range(_N)) for i in range(_N) for j in range(_N)]
    return total


def _ends(matrices: list[list[float]], before: int, end: int | None) -> list[int]:
    """States at the ends of consecutive blocks, from the state before the first
    to the one at the end of the last (the best one, if it is not given)."""
    scores, backs = [0.0 if r == before else -math.inf for r in range(_N)], []
    for m in matrices:
        back = [max(range(_N), key=lambda r, j=j: scores[r] + m[r * _N + j]) for j in range(_N)]
        scores = [scores[back[j]] + m[back[j] * _N + j] for j in range(_N)]
        backs.append(back)
    state = max(range(_N), key=lambda r: scores[r]) if end is None else end
    out = []
    for back in reversed(backs):
        out.append(state)
        state = back[state]
    return out[::-1]


def _groups(batches, *keys: str):
    """Rows of a sorted table by key, as dictionaries."""
    rows = (row for b in batches for row in b.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _written(rows, schema: pa.Schema, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _record(held, schema)
            held = []
    if held:
        yield _record(held, schema)


_MATRIX = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))])
_END = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("end", pa.int32())])
_LINE = pa.schema([("id", pa.int64()), ("turn", pa.int64()), ("line", pa.int32()), ("content", pa.string()), ("role", pa.int32()),
                   ("new_turn", pa.bool_())])


def _reduce_lines(batches, model):
    yield from _written(((*key, block_matrix([r["symbol"] for r in rows], model))
                         for key, rows in _groups(batches, "id", "block")), _MATRIX)


def _reduce_matrices(batches):
    yield from _written(((*key, _combined([r["matrix"] for r in rows]))
                         for key, rows in _groups(batches, "id", "upper")), _MATRIX)


def _solve_group(batches):
    def solved():
        for (id_, _), found in _groups(batches, "id", "upper"):
            rows = list(found)
            state = rows[0]["before"]
            for r, end in zip(rows, _ends([r["matrix"] for r in rows], state, rows[0]["end"]), strict=True):
                yield id_, r["block"], state, end
                state = end
    yield from _written(solved(), _END)


def _decode_lines(batches, model):
    def decoded():
        for (id_, _), found in _groups(batches, "id", "block"):
            rows = list(found)
            states = decode([r["symbol"] for r in rows], model, rows[0]["before"], rows[0]["end"])
            for r, state in zip(rows, states, strict=True):
                yield id_, r["turn"], r["line"], r["content"], state // 2, state % 2 == 0
    yield from _written(decoded(), _LINE)


def solve(matrices: DataFrame) -> DataFrame:
    """``(id, block, before, end)`` from ``(id, block, matrix)``: the states
    around every block on the best path."""
    grouped = matrices.withColumn("upper", F.floor(F.col("block") / FAN).cast("long"))

    def by_group(frame):
        return frame.repartition("id", "upper").sortWithinPartitions("id", "upper", "block")

    if (matrices.agg(F.max("block")).first()[0] or 0) < FAN:
        around = grouped.withColumns({"before": F.lit(0), "end": F.lit(None).cast("int")})
    else:
        reduced = cut(by_group(grouped).mapInArrow(_reduce_matrices, "id long, block long, matrix array<double>"))
        around = grouped.join(solve(reduced).withColumnRenamed("block", "upper"), ["id", "upper"])
    return by_group(around.select("id", "upper", "block", "matrix", "before", "end")).mapInArrow(
        _solve_group, "id long, block long, before int, end int")


def _in_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``place``, the running number in the transcript, and
    ``block``. A range-partitioned sort numbers them, and equal lines are told
    apart by where they stand, so neither a long text nor a transcript that holds
    most rows comes to one task."""
    told = lines.withColumn("_tie", F.monotonically_increasing_id())
    numbered = dense_index(told, ["id", "turn", "line", "text", "_tie"], "_number")
    first = numbered.groupBy("id").agg(F.min("_number").alias("_from"))
    return (numbered.join(first, "id").withColumn("place", F.col("_number") - F.col("_from"))
            .withColumn("block", F.shiftright("place", BLOCK.bit_length() - 1)))


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """``(id, turn, line, role, new_turn, rendered)`` of every ``observed`` line:
    its source row and place there, the role found, whether a turn opens, and
    the line's part of the canonical transcript."""
    blocked = cut(_in_blocks(lines).select("id", "block", "place", "turn", "line", "content", "symbol"))

    def by_block(frame):
        return frame.repartition("id", "block").sortWithinPartitions("id", "block", "place")

    matrices = cut(by_block(blocked.select("id", "block", "place", "symbol")).mapInArrow(
        partial(_reduce_lines, model=model), "id long, block long, matrix array<double>"))
    placed = blocked.join(cut(solve(matrices)), ["id", "block"])
    found = by_block(placed).mapInArrow(partial(_decode_lines, model=model),
                                        "id long, turn long, line int, content string, role int, new_turn boolean")
    role = F.get(F.array(*map(F.lit, ROLES)), F.col("role"))
    header = F.when(F.col("new_turn"), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise("")
    return found.select(
        F.nullif("id", F.lit(_NO_ID)).alias("id"), F.nullif("turn", F.lit(_NO_ID)).alias("turn"),
        F.col("line").cast("long").alias("line"), role.alias("role"), "new_turn",
        F.concat(header, "content", F.lit("\n")).alias("rendered"))
