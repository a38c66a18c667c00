"""Transcript parsing: a hidden Markov model over speaker markers and line features finds each line's speaker.

A turn may change where a row begins or a speaker marker stands ("User:", "### Assistant", "<|system|>", "[Bot]"), and
nowhere else; the lines from there to the next such place are a speech. The hidden state of a speech is its speaker
(system, user, assistant). What is seen of a speech: the role that its row states, if it is the row's first, its marker,
whether its last line that isn't blank ends in a question mark, and the length of its longest line. Each counts once, so
no number of lines overrules a stated role. Viterbi finds the likeliest speakers of a whole conversation; lines of one row with one speaker become
one turn, rendered as ``<|role|>\\n...\\n<|end|>``. A marker is left out only where a turn begins with it whose speaker it
names; all other lines are kept as they are.

Log probabilities are whole numbers (thousandths), so sums don't depend on the order. Viterbi's step is a max-plus
matrix product, and that is associative: a conversation is cut into chunks of CHUNK rows, each chunk gives one 3 x 3 matrix,
the matrices of a conversation are walked, and chunks are then decoded apart from each other with both their ends known.
Rows are numbered by ranges of (conversation, turn, role, first PREFIX characters), so no conversation, however long
and whatever its turn numbers, has its lines in one task.

Defined cases. Rows are ordered by turn, then role, then text, nulls first. Equal rows of one conversation and turn count
once. Each row without a conversation id is a conversation of its own, equal ones too. A null text is one empty line; line ends are
\\n, \\r\\n or \\r. A null or unknown role is no evidence. Of equally likely speakers, the first in ROLES is taken at
the end of each chunk and at each step back. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.session import cut

ROLES = ("system", "user", "assistant")
CHUNK = 4096
PREFIX = 256

#: Names of speakers in markers and role columns (fixed values), in the order of ROLES.
NAMES = ("system|instructions?|developer|context", "user|human|customer|question|q", "assistant|bot|ai|model|gpt|answer|a")


def _logs(*p: float) -> list[int]:
    return [round(1000 * math.log(x)) for x in p]


START = np.array(_logs(0.2, 0.75, 0.05), np.int64)
#: From (row) to (column).
TURN = np.array([_logs(0.03, 0.90, 0.07), _logs(0.02, 0.08, 0.90), _logs(0.02, 0.90, 0.08)], np.int64)
#: Evidence for each speaker (row): nothing, or the name of each speaker (columns).
STATED = np.array([[0] + _logs(*[0.97 if i == j else 0.015 for j in range(3)]) for i in range(3)], np.int64)
MARKED = np.array([[0] + _logs(*[0.94 if i == j else 0.03 for j in range(3)]) for i in range(3)], np.int64)
ASKS = np.array([_logs(0.95, 0.05), _logs(0.65, 0.35), _logs(0.88, 0.12)], np.int64)
LENGTH = np.array([_logs(0.3, 0.4, 0.3), _logs(0.4, 0.4, 0.2), _logs(0.25, 0.4, 0.35)], np.int64)


def marker(names: str) -> str:
    return rf"(?i)^\s*(?:<\|\s*(?:{names})\s*\|>|\[(?:{names})\]\s*:?|#{{1,6}}\s*(?:{names})\s*:?\s*$|\*{{0,2}}(?:{names})\*{{0,2}}\s*:\*{{0,2}})\s*"


ANY_MARKER = marker("|".join(NAMES))


def _which(found: list[Column]) -> Column:
    code = F
    for i, x in enumerate(found):
        code = code.when(x, F.lit(i + 1))
    return code.otherwise(F.lit(0))


def _seen(line: Column, at: Column, role: Column) -> Column:
    """What is seen of a line, as one number: first line of its row, stated role, marker, question, length (3: blank)."""
    stated = F.when(at == 0, _which([role.rlike(f"(?i)^\\s*(?:{n})\\s*$") for n in NAMES])).otherwise(F.lit(0))
    marked = _which([line.rlike(marker(n)) for n in NAMES])
    asks = line.rlike(r"[?？]\s*$").cast("int")
    size = F.when(line.rlike(r"^\s*$"), 3).when(F.length(line) < 60, 0).when(F.length(line) < 240, 1).otherwise(2)
    return ((((at == 0).cast("int") * 4 + stated) * 4 + marked) * 2 + asks) * 4 + size


def evidence() -> np.ndarray:
    """Log probability of each number of _seen for each speaker."""
    codes = np.arange(2 * 4 * 4 * 2 * 4)
    size, asks, marked, stated = codes % 4 % 3, codes // 4 % 2, codes // 8 % 4, codes // 32 % 4
    return (STATED[:, stated] + MARKED[:, marked] + ASKS[:, asks] + LENGTH[:, size]).T


EVIDENCE = evidence()


#: Matrix of each number: from the speaker before to this speech's, evidence included.
STEPS = [TURN + e for e in EVIDENCE]


def speeches(codes: list[int]) -> list[tuple[int, int]]:
    """Number as of _seen, and count of lines, of each speech of a row with these lines."""
    out: list[tuple[int, int]] = []
    for c in codes:
        if c >= 128 or c // 8 % 4:
            out.append((c, 1))
            continue
        head, n = out[-1]
        if head % 4 == 3:
            head += c % 8 - head % 8
        elif c % 4 != 3:
            head += c // 4 % 2 * 4 + max(head % 4, c % 4) - head % 8
        out[-1] = head, n + 1
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def product(codes: list[int]) -> np.ndarray:
    m = STEPS[codes[0]]
    for c in codes[1:]:
        m = times(m, STEPS[c])
    return m


def decoded(codes: list[int], before: int | None, last: int | None) -> list[int]:
    """Likeliest speakers of a chunk's speeches after the speaker ``before`` (None: a conversation begins), ending in ``last``."""
    score = START + EVIDENCE[codes[0]] if before is None else STEPS[codes[0]][before]
    back = []
    for c in codes[1:]:
        ways = score[:, None] + STEPS[c]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def ends(first: list[int], matrices: list[np.ndarray]) -> list[int]:
    """Speaker that each chunk of a conversation ends in; ``first``: scores after the first chunk."""
    scores = [np.array(first, np.int64)]
    for m in matrices:
        scores.append((scores[-1][:, None] + m).max(axis=0))
    out = [int(scores[-1].argmax())]
    for s, m in zip(reversed(scores[:-1]), reversed(matrices)):
        out.append(int((s + m[:, out[-1]]).argmax()))
    return out[::-1]


def runs(parts: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, across batches."""
    key, rows = None, []
    for b in parts:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _rows(schema: str, names: list[str], rows: Iterator[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "longs": pa.list_(pa.int64())}
    types = [kinds[k] for k in schema.split()]
    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], names=names)
            batch = []
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), types)], names=names)


def numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` with the chunk of each; ``at`` grows with their order, and its upper bits name the part it was given in.

    It is null for a conversation of up to ``chunk`` rows, and negative, each its own, for rows without one, so that
    these spread over tasks. A small table has one row per part and conversation of more than ``chunk`` rows: where its numbers begin.
    """
    part = F.shiftright("at", 33).alias("part")
    held = rows.filter("conv IS NOT NULL").groupBy("conv", part).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv")
    held = held.withColumns({"before_part": F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"), "all": F.sum("n").over(whole)})
    begins = cut(held.filter(F.col("all") > chunk).select("conv", "part", (F.col("before_part") - F.col("least")).alias("off")), "chat-parts")
    number = F.when(F.col("conv").isNull(), -1 - F.col("at")).otherwise(F.floor((F.col("at") + F.col("off")) / chunk))
    return rows.withColumn("part", part).join(begins, ["conv", "part"], "left").withColumn("chunk", number).drop("part", "off")


def parse(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, part (from 0, of a row), role, text and rendered: the canonical turns."""
    c = lambda n: F.col(f"`{n}`")
    rows = table.select(c(conv).cast("long").alias("conv"), c(turn).cast("long").alias("turn"), c(role).alias("role"), c(text).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col(x).asc_nulls_first() for x in ("conv", "turn", "role", "text")]
    rows = rows.repartitionByRange(*order[:3], F.substring("text", 1, PREFIX).asc_nulls_first()).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)
    seen = lambda x, i: F.struct(_seen(x, i, F.coalesce("role", F.lit(""))).alias("code"), x.alias("line"), (F.length(x) - F.length(F.regexp_replace(x, ANY_MARKER, ""))).alias("mark"))
    rows = cut(rows.select("conv", "at", "turn", "n", F.transform(lines, seen).alias("lines")), "chat-rows")
    rows = numbered(rows, chunk)
    keys = ["conv", "chunk"]

    def summary(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for key, got in runs(parts, 2):
                codes = [c for r in got for c, _ in speeches(r[1])]
                start = START + EVIDENCE[codes[0]]
                for x in codes[1:]:
                    start = (start[:, None] + STEPS[x]).max(axis=0)
                yield (*key, start.tolist(), product(codes).ravel().tolist())

        return _rows("long long longs longs", ["conv", "chunk", "start", "matrix"], made())

    codes = rows.filter("chunk >= 0").select("conv", "chunk", "at", F.col("lines.code").alias("codes"))
    chunks = codes.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(summary, "conv long, chunk long, start array<long>, matrix array<long>")

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (conv,), got in runs(parts, 1):
                out = ends(got[0][1], [np.array(r[2], np.int64).reshape(3, 3) for r in got[1:]])
                for i, r in enumerate(got):
                    yield conv, r[0], out[i - 1] if i else None, out[i]

        return _rows("long long int int", ["conv", "chunk", "before", "last"], made())

    borders = chunks.repartition("conv").sortWithinPartitions(*keys).mapInArrow(walk, "conv long, chunk long, before int, last int")
    joined = rows.join(cut(borders, "chat-borders"), keys, "left").select(*keys, "at", "turn", "n", "lines", "before", "last")

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (conv, _), got in runs(parts, 2):
                said = [speeches([x["code"] for x in r[3]]) for r in got]
                path = decoded([c for r in said for c, _ in r], got[0][4], got[0][5])
                speakers = iter([s for s, n in zip(path, (n for r in said for _, n in r)) for _ in range(n)])
                for _, turn, n, lines, *_ in got:
                    parts_of, now = [], None
                    for x in lines:
                        s = next(speakers)
                        begins, now = s != now, s
                        if begins:
                            parts_of.append((s, []))
                        parts_of[-1][1].append(x["line"][x["mark"] :] if begins and x["code"] // 8 % 4 == s + 1 else x["line"])
                    for _ in range(n if conv is None else 1):
                        for part, (s, kept) in enumerate(parts_of):
                            yield conv, turn, part, ROLES[s], "\n".join(kept)

        return _rows("long long int string string", ["conv", "turn", "part", "role", "text"], made())

    turns = joined.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(decode, "conv long, turn long, part int, role string, text string")
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return turns.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "part", "role", "text", rendered.alias("rendered"))
