"""Chat formatting: roles of the lines of a transcript by a hidden Markov model, then canonical turns.

A state is a role with "begins here" or "goes on".  A line shows a speaker
marker (or none), its length, whether a blank line stood before it and how it
ends.  Counts over all labelled lines give the model; Viterbi gives the states.

A transcript may be longer than a task should hold.  Lines are put in order by
range partitions and cut into segments of bounded length; each segment gives
one small matrix, best scores from every state before it to every state at its
end.  The matrices of a transcript are chained, which fixes the states at the
cuts, and each segment is then decoded by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r begins: 2r, goes on: 2r + 1
MARKERS = 256
SIZES = (MARKERS, 16, 2, 4)
SMOOTH = 0.5
SEGMENT = 20_000
# A name is a word, and up to three more that do not begin in lower case; a time may stand before it.
_NAME = r"([^\W\d_][\w.'’-]*+(?: [^\W_a-z][\w.'’-]*+){0,3})"
_TIME = r"(?:[\[(]?\d{1,2}:\d\d(?::\d\d)?(?: ?[AaPp][Mm])?[\])]?\s*(?:[-–]\s*)?)?"
_MARKER = re.compile("|".join([
    rf"\s*<\|(?:im_start|start_header_id)\|>\s*{_NAME}\s*(?:<\|end_header_id\|>\s*|$)",  # <|im_start|>user
    rf"\s*<\|(?!im_end\||eot_id\||end\|){_NAME}\|>\s*",                                  # <|user|>
    rf"\s*#{{1,6}}\s*{_NAME}\s*:?\s*$",                                                  # ### User
    rf"[>\-\s]*{_TIME}[#*_\[(<|]*{_NAME}[\])>|*_]*\s*:(?!//)[*_]*\s*",                   # [12:01] **John Smith**: ...
    rf"\s*{_TIME}(?:\[{_NAME}\]|<{_NAME}>)(?:\s+|$)",                                    # [user] ...
    rf"\s*(?:\*\*|__){_NAME}(?:\*\*|__)\s*$",                                            # **User**
]))
_CLOSED = re.compile(r"\s*<\|(?:im_end|eot_id|end)\|>\s*$")
LINES = "conv_id long, segment long, ord long, turn long, line long, text string, role string, seen array<int>"


def marker(line: str) -> tuple[int, int]:
    """Hashed name of the speaker marker a line begins with, 0 for none, and where the rest begins.

    Numbers of a name do not count: ``User 1`` and ``User 2`` are one name.
    Whether a line with a marker begins a turn is up to the model.
    """
    found = _MARKER.match(line)
    if not found:
        return 0, 0
    name = re.sub(r"[\W\d_]+", " ", found.group(found.lastindex)).strip().lower()
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % (MARKERS - 1) + 1, found.end()


def _seen(line: str, blank_before: bool) -> list[int]:
    end = line.rstrip()[-1:]
    return [marker(line)[0], min(15, len(line).bit_length()), int(blank_before), {"?": 1, ":": 2, ".": 3}.get(end, 0)]


def lines_of(transcripts: DataFrame) -> DataFrame:
    """Ordered lines of ``transcripts(conv_id, turn, text[, role])``, cut into segments.

    ``turn`` orders the pieces of text of a transcript; ties stand in the order
    of their texts.  Blank lines only mark the line after them in a text.  Null ids are
    one transcript, null turns come first, null texts are blank.  ``role`` is
    the speaker where known.
    """
    role = F.col("role") if "role" in transcripts.columns else F.lit(None).cast("string")
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                              F.coalesce("text", F.lit("")).alias("text"), role.alias("role"))
    tie = F.xxhash64("text", "role")
    dealt = (rows.withColumn("tie", tie).repartitionByRange("conv_id", "turn", "tie")
             .sortWithinPartitions("conv_id", "turn", "tie", "text").drop("tie"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, segment, count = TaskContext.get().partitionId() << 32, object(), -1, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for conv, turn, text, role in zip(*(batch.column(i) for i in range(4))):
                conv, turn, role = conv.as_py(), turn.as_py(), role.as_py()
                if conv != last:
                    last, segment, count = conv, segment + 1, 0
                blank = False
                for number, line in enumerate(text.as_py().split("\n")):
                    if not line.strip():
                        blank = True
                        continue
                    if count == SEGMENT:
                        segment, count = segment + 1, 0
                    for column, value in zip(out, (conv, part + segment, count, turn, number, line, role, _seen(line, blank))):
                        column.append(value)
                    count, blank = count + 1, False
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(out[i], pa.int64()) for i in range(5)], pa.array(out[5], pa.string()), pa.array(out[6], pa.string()),
                 pa.array(out[7], pa.list_(pa.int32()))], names=[c.split()[0] for c in LINES.split(", ")])

    return settle(dealt.mapInArrow(cut, LINES), "transcript-lines")


class Model:
    """Log probabilities: start (S), step (S, S) and, per kind of observation, (S, values)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, shown: list[np.ndarray]):
        share = lambda x: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis=-1, keepdims=True))
        self.start, self.step, self.shown = share(start), share(step), [share(x) for x in shown]
        # a turn goes on only after its own role
        for a in range(STATES):
            for r in range(len(ROLES)):
                if a // 2 != r:
                    self.step[a, 2 * r + 1] = -np.inf
        self.start[1::2] = -np.inf

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(x[:, seen[:, k]].T for k, x in enumerate(self.shown))


def train(lines: DataFrame) -> Model:
    """Counts over all lines with a known role.  Only sums leave the tasks: at most one row per state and value.

    A line begins a turn if it is the first of its turn.  Where no line has a
    role the model is even.
    """
    known = lines.filter(F.col("role").isin(*ROLES))
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))]), F.col("role"))
    order = F.struct("turn", "segment", "ord")
    firsts = known.groupBy("conv_id", "turn").agg(F.min(F.struct("segment", "ord")).alias("first"))
    lasts = known.groupBy("conv_id", "turn").agg(F.max(F.struct("segment", "ord")).alias("last"), F.first("role").alias("role"),
                                                 F.count(F.lit(1)).alias("lines"))
    placed = known.join(firsts, ["conv_id", "turn"]).withColumn(
        "state", 2 * rank + (F.struct("segment", "ord") != F.col("first")).cast("int"))
    shown = (placed.select("state", F.posexplode("seen").alias("kind", "value")).groupBy("state", "kind", "value")
             .agg(F.count(F.lit(1)).alias("n")).collect())
    # steps inside turns follow from their lengths, steps between turns from the turn before
    turns = lasts.select("conv_id", "turn", rank.alias("r"), "lines")
    inside = turns.groupBy("r").agg(F.sum(F.col("lines") - 1).alias("on"), F.sum((F.col("lines") > 1).cast("long")).alias("longer")).collect()
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("to"))
    between = turns.join(after, ["conv_id", "turn"]).groupBy("r", (F.col("lines") > 1).alias("long"), "to").agg(F.count(F.lit(1)).alias("n")).collect()
    opening = (known.groupBy("conv_id").agg(F.min_by("role", order).alias("role")).groupBy(rank.alias("r"))
               .agg(F.count(F.lit(1)).alias("n")).collect())
    start, step = np.zeros(STATES), np.zeros((STATES, STATES))
    counts = [np.zeros((STATES, n)) for n in SIZES]
    for state, kind, value, n in shown:
        counts[kind][state, value] += n
    for r, n in opening:
        start[2 * r] += n
    for r, on, longer in inside:
        step[2 * r, 2 * r + 1] += longer
        step[2 * r + 1, 2 * r + 1] += on - longer
    for r, long, to, n in between:
        step[2 * r + int(long), 2 * to] += n
    return Model(start, step, counts)


def chain(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best score from every state before a segment to every state at its end."""
    out = None
    for e in model.scores(seen):
        edge = model.step + e[None]
        out = edge if out is None else (out[:, :, None] + edge[None]).max(axis=1)
    return out


def decode(model: Model, seen: np.ndarray, before: int, at_end: int) -> np.ndarray:
    """Best states of a segment, after state ``before`` (-1: it opens the transcript), ending in ``at_end`` (-1: any)."""
    e = model.scores(seen)
    best = e[0] + (model.start if before < 0 else model.step[before])
    back = np.zeros((len(e), STATES), np.int8)
    for t in range(1, len(e)):
        ways = best[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + e[t]
    path = np.zeros(len(e), np.int64)
    path[-1] = best.argmax() if at_end < 0 else at_end
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def cuts(model: Model, matrices: list[np.ndarray], first: np.ndarray) -> list[int]:
    """Best state at the end of every segment, from the scores at the end of the first one and the others' matrices."""
    best, back = first, []
    for m in matrices:
        ways = best[:, None] + m
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def recover(lines: DataFrame, model: Model) -> DataFrame:
    """``(conv_id, segment, ord, turn, line, text, role, state)`` for every line, ``role`` the recovered one."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    sizes = lines.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    split = sizes.filter("low <> high").select(F.col("conv_id").alias("c"), "low")
    long = lines.join(split, F.col("conv_id").eqNullSafe(F.col("c")))

    def matrix(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, rows = shared.value, rows.sort_values("ord")
        seen = np.vstack(rows["seen"].to_list())
        if rows["low"].iloc[0] == rows["segment"].iloc[0]:  # the first one: scores from the start
            head = m.start + m.scores(seen[:1])[0]
            out = np.full((STATES, STATES), -np.inf)
            out[0] = head if len(seen) == 1 else (head[:, None] + chain(m, seen[1:])).max(axis=0)
        else:
            out = chain(m, seen)
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1].astype("Int64"), "segment": rows["segment"].iloc[:1], "m": [out.ravel().tolist()]})

    def bounds(rows: pd.DataFrame) -> pd.DataFrame:
        m, rows = shared.value, rows.sort_values("segment")
        parts = [np.array(x).reshape(STATES, STATES) for x in rows["m"]]
        ends = cuts(m, parts[1:], parts[0][0])
        return pd.DataFrame({"c": rows["conv_id"].astype("Int64"), "s": rows["segment"], "before": [-1, *ends[:-1]], "at_end": ends})

    matrices = long.groupBy("conv_id", "segment").applyInPandas(matrix, "conv_id long, segment long, m array<double>")
    ends = settle(matrices.groupBy("conv_id").applyInPandas(bounds, "c long, s long, before int, at_end int"), "cuts")
    placed = lines.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left").select(
        "conv_id", "segment", "ord", "turn", "line", "text", "seen", F.coalesce("before", F.lit(-1)).alias("before"),
        F.coalesce("at_end", F.lit(-1)).alias("at_end"))
    dealt = placed.repartition("segment").sortWithinPartitions("segment", "ord")
    schema = "conv_id long, segment long, ord long, turn long, line long, text string, role string, state int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rest = shared.value, None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            segment = rest.column(1).to_numpy()
            cut = int(np.flatnonzero(segment == segment[-1])[0]) if len(segment) else 0
            if cut:
                yield states(m, rest.slice(0, cut))
            rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield states(m, rest)

    def states(m: Model, rows: pa.RecordBatch) -> pa.RecordBatch:
        segment = rows.column(1).to_numpy()
        seen = rows.column(6).flatten().to_numpy().reshape(len(segment), len(SIZES))
        before, at_end = rows.column(7).to_numpy(), rows.column(8).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        out = np.concatenate([decode(m, seen[lo:hi], before[lo], at_end[lo])
                              for lo, hi in zip(starts, np.append(starts[1:], len(segment)))])
        return pa.RecordBatch.from_arrays(
            [*[rows.column(i) for i in range(6)], pa.array([ROLES[s // 2] for s in out]), pa.array(out, pa.int32())],
            names=[c.split()[0] for c in schema.split(", ")])

    return dealt.mapInArrow(run, schema)


def canonical(recovered: DataFrame) -> DataFrame:
    """Turns rendered one way: ``(conv_id, segment, ord, turn, line, role, n_lines, rendered)``.

    A turn is the lines from one that begins it to the next, whole wherever its
    transcript was cut; its marker and closing tag are taken off.  ``segment``
    and ``ord`` give the order of the turns and depend on the cuts, all else
    does not.
    """
    pieces = settle(_pieces(recovered), "turns")
    rest = pieces.filter("continued")
    begun = pieces.filter("NOT continued")
    # a piece that goes on belongs to the last turn begun in an earlier segment; there are few segments
    ends = begun.groupBy("conv_id", "segment").agg(F.max("ord").alias("ord"))
    marks = ends.join(rest.select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    marks = marks.select("conv_id", "segment", F.struct("segment", "ord").alias("head")).unionByName(
        rest.select("conv_id", "segment"), allowMissingColumns=True)
    marks = marks.groupBy("conv_id", "segment").agg(F.max("head").alias("head"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    heads = marks.select(F.col("segment").alias("s"), F.last("head", ignorenulls=True).over(before).alias("head"))
    tails = (rest.join(heads, F.col("segment") == F.col("s")).groupBy("head.segment", "head.ord").agg(
        F.sum("n_lines").alias("more"), F.array_sort(F.collect_list(F.struct(F.col("s"), "rendered"))).alias("parts"))
        .select(F.col("segment").alias("s"), F.col("ord").alias("o"), "more", "parts"))
    body = F.array_join(F.filter(F.col("parts.rendered"), lambda x: x != ""), "\n")
    whole = begun.join(tails, (F.col("segment") == F.col("s")) & (F.col("ord") == F.col("o")), "left")
    return whole.select("conv_id", "segment", "ord", "turn", "line", "role", (F.col("n_lines") + F.coalesce("more", F.lit(0))).alias("n_lines"),
                        F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.concat_ws("\n", F.nullif("rendered", F.lit("")), F.nullif(body, F.lit("")))).alias("rendered"))


def _pieces(recovered: DataFrame) -> DataFrame:
    """Turns as far as they lie in one segment; ``continued`` are those begun in an earlier one."""
    dealt = recovered.repartition("segment").sortWithinPartitions("segment", "ord")
    schema = ("conv_id long, segment long, ord long, turn long, line long, role string, n_lines long, "
              "continued boolean, rendered string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_turn: list | None = None
        for batch in batches:
            out = []
            for conv, segment, place, turn, line, text, role, state in zip(*(c.to_pylist() for c in batch.columns)):
                if open_turn is None or open_turn[1] != segment or state % 2 == 0:
                    if open_turn is not None:
                        out.append(_closed(open_turn))
                    open_turn = [conv, segment, place, turn, line, role, state % 2 == 1, []]
                open_turn[7].append(_shown(text, state % 2 == 0))
            yield _batch(out, schema)
        if open_turn is not None:
            yield _batch([_closed(open_turn)], schema)

    return dealt.mapInArrow(run, schema)


def _shown(line: str, begins: bool) -> str:
    line = _CLOSED.sub("", line)
    return line[marker(line)[1]:].strip() if begins else line


def _closed(turn: list) -> tuple:
    conv, segment, place, number, line, role, continued, texts = turn
    return conv, segment, place, number, line, role, len(texts), continued, "\n".join(t for t in texts if t)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
