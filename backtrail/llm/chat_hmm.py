"""Transcript parsing with a hidden Markov model, and canonical turns.

The lines of a conversation are observations, their roles hidden states. A line shows a speaker marker ("User:",
"### Assistant", "<|system|>", ...) or none, and features: whether a message begins with it, its length, its punctuation,
whether it opens the conversation. Markers may be absent or wrong: transitions and the other features decide as well.
Viterbi finds the likeliest roles of all lines together; neighbouring lines of one role and message become one turn, whose
marker is removed and whose rendering is canonical. Probabilities are counted on a bounded number of labelled messages of
bounded length in conversations of bounded length (MAX_TRAIN, MAX_TRAIN_CHARS, MAX_TRAIN_CONVERSATION, parameters; longer
ones aren't learned from); roles are never inputs of a prediction.

A conversation may be larger than a task. Messages are range-partitioned by (conversation, turn, text), wherever that
cuts. Viterbi's step is a product of matrices in the (max, +) semiring, which is associative: one pass gives for each
partition the matrices of its first and last conversation, at most two small rows; from these the driver knows with which
scores each partition is entered and in which state it is left on the best path; a second pass then finds all states. The
result is the same as that of one pass over the whole conversation.

Defined results: messages are ordered by turn (null first), then text; a null text is one empty line; messages without a
conversation belong together; repeated messages stay repeated. Without any label the roles are system, user and assistant.
Of equally likely paths the one whose last state is first in the roles' alphabetical order counts, then the one before it,
and so on. Other columns aren't looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import scratch_root

MAX_TRAIN = 12_000
MAX_TRAIN_CHARS, MAX_TRAIN_CONVERSATION = 4000, 1000
#: Characters and messages of a partition, about.
PART_CHARS, PART_MESSAGES = 16 << 20, 100_000
ROLES = ("assistant", "system", "user")
#: Fixed names of speakers.
SPEAKERS = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user", "student": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant", "model": "assistant", "gpt": "assistant",
}
_NAME = "|".join(sorted(SPEAKERS, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*({_NAME})\s*(?:\|>|\n|$)|(?:#{{1,6}}\s*|\*\*|\[)?({_NAME})(?:\s*(?:\*\*|\]))?\s*:(?:\*\*)?|#{{2,6}}\s*({_NAME})\s*$|\[({_NAME})\])\s*", re.I)


def marker(line: str) -> tuple[str, int]:
    """(role that a line's speaker marker names or "", where the line's own text begins)."""
    m = _MARKER.match(line)
    return (SPEAKERS[next(x for x in m.groups() if x).lower()], m.end()) if m else ("", 0)


def observe(line: str, first_line: bool, opens: bool) -> tuple[str, ...]:
    """The features of a line; each is one categorical observation."""
    n = len(line)
    return (
        f"marker={marker(line)[0]}",
        f"size={first_line}:{min(n.bit_length(), 11)}",
        f"asks={line.rstrip().endswith('?')}",
        f"shape={'list' if line[:2] in ('- ', '* ') or line[:1].isdigit() else 'code' if line[:4] == '    ' or line[:3] == '```' else 'prose'}",
        f"opens={opens}",
    )


class Hmm:
    """start, stay (within a message) and turn (to another message, or to a line with a marker) hold log probabilities."""

    def __init__(self, roles: list[str], start: list[float], stay: list[list[float]], turn: list[list[float]], emit: list[dict[str, float]], rare: list[float]):
        self.roles, self.start, self.stay, self.turn, self.emit, self.rare = roles, start, stay, turn, emit, rare

    @classmethod
    def fit(cls, messages: list[tuple]) -> Hmm:
        """messages: (conversation, turn, text, role), in order."""
        roles = sorted({m[3] for m in messages if m[3]}) or list(ROLES)
        k, at = len(roles), {r: i for i, r in enumerate(roles)}
        start, stay, turn = [1.0] * k, [[0.2] * k for _ in roles], [[0.2] * k for _ in roles]
        counts: list[dict[str, float]] = [{} for _ in roles]
        total = [0] * k
        for r, i in at.items():  # markers usually name the speaker, whether or not the labelled messages show it
            for name in set(SPEAKERS.values()):
                counts[i][f"marker={name}"] = 2.0 if name == r else 0.02
            stay[i][i] += 2
        before = None
        for conv, _, text, role in messages:
            if role not in at:
                before = None
                continue
            i = at[role]
            if before and before[0] == conv:
                turn[before[1]][i] += 1
            elif not before or before[0] != conv:
                start[i] += 1
            for j, line in enumerate((text or "").split("\n")):
                total[i] += 1
                stay[i][i] += j > 0
                for o in observe(line, j == 0, j == 0 and (not before or before[0] != conv)):
                    counts[i][o] = counts[i].get(o, 0.0) + 1
            before = conv, i
        log = lambda row: [math.log(x / sum(row)) for x in row]
        emit = [{o: math.log((n + 0.2) / (total[i] + 4)) for o, n in c.items()} for i, c in enumerate(counts)]
        return cls(roles, log(start), [log(r) for r in stay], [log(r) for r in turn], emit, [math.log(0.2 / (n + 4)) for n in total])

    def emissions(self, line: str, first_line: bool, opens: bool) -> list[float]:
        seen = observe(line, first_line, opens)
        return [sum(e.get(o, rare) for o in seen) for e, rare in zip(self.emit, self.rare, strict=True)]

    def viterbi(self, lines: list[tuple[str, bool]], enter: list[float] | None, leave: int | None) -> list[int]:
        """States of lines (text, begins a message). enter: scores before them, None at the conversation's start; leave: the
        last state, None for the best one."""
        scores, back, k = enter, [], range(len(self.roles))
        for line, first in lines:
            e = self.emissions(line, first, scores is None)
            if scores is None:
                back.append(None)
                scores = [s + x for s, x in zip(self.start, e, strict=True)]
                continue
            step = self.turn if first or marker(line)[0] else self.stay
            from_ = [max(k, key=lambda s, t=t: scores[s] + step[s][t]) for t in k]
            scores = [scores[f] + step[f][t] + e[t] for t, f in enumerate(from_)]
            back.append(from_)
        state = max(k, key=scores.__getitem__) if leave is None else leave
        out = [state]
        for from_ in reversed(back[1:]):
            state = from_[state]
            out.append(state)
        return out[::-1]

    def advance(self, rows: list[list[float]] | None, line: str, first: bool, begins: bool) -> list[list[float]]:
        """The (max, +) matrix after one more line; rows None: before the first line. A conversation's start has one row."""
        e = self.emissions(line, first, begins)
        if begins:
            return [[s + x for s, x in zip(self.start, e, strict=True)]]
        step = self.turn if first or marker(line)[0] else self.stay
        if rows is None:
            return [[s + x for s, x in zip(r, e, strict=True)] for r in step]
        return [[max(r[s] + step[s][t] for s in range(len(r))) + e[t] for t in range(len(r))] for r in rows]


def render(lines: list[tuple[str, bool]], states: list[int], roles: list[str]) -> tuple[int, str]:
    """(number of turns, canonical text) of a message's lines."""
    turns: list[tuple[str, list[str]]] = []
    for (line, first), s in zip(lines, states, strict=True):
        name, begin = marker(line)
        if first or turns[-1][0] != roles[s] or name:
            turns.append((roles[s], []))
        turns[-1][1].append(line[begin:])
    return len(turns), "".join(f"<|{role}|>\n{chr(10).join(text).strip()}\n<|end|>\n" for role, text in turns)


def fit(conversations: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS, max_conversation: int = MAX_TRAIN_CONVERSATION) -> Hmm:
    """Learn from labelled messages of conversations outside the held-out fold (remainder 2 of 4): all of them, or those of a
    share of the conversations, by hashed id, that has about max_train messages. What comes to the driver doesn't grow."""
    known = conversations.where("conv_id is not null and role is not null").where(F.crc32(F.col("conv_id").cast("string")) % 4 != 2)
    known = known.where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).select("conv_id", "turn", "text", "role")
    n, scale = known.count(), 1_000_000
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("conv_id"), F.lit(scale)) < scale * max_train // n)
    short = known.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_conversation).select("conv_id")
    rows = known.join(short, "conv_id", "left_semi").orderBy("conv_id", "turn", "text", "role").collect()
    return Hmm.fit([tuple(r) for r in rows])


def parse(messages: DataFrame, hmm: Hmm, partitions: int | None = None) -> DataFrame:
    """(conv_id, turn, role_pred, n_lines, n_turns, rendered) of each message (conv_id, turn, text)."""
    spark = messages.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    rows = messages.select("conv_id", "turn", "text").withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "text", "row"]
    if partitions is None:
        seen = messages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        partitions = max(spark.sparkContext.defaultParallelism, seen["n"] // PART_MESSAGES + seen["chars"] // PART_CHARS + 1)
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("row").checkpoint()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation of this partition: its matrix as if it went on from before, and as if it began."""
        from pyspark import TaskContext

        out, now, began, going, position = [], None, None, None, 0
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None and position == 0:
                        out.append((0, now[0], began, going))
                    position += now is not None
                    now, began, going = (conv,), None, None
                for j, line in enumerate((text or "").split("\n")):
                    began = hmm.advance(began, line, j == 0, began is None)
                    if position == 0:
                        going = hmm.advance(going, line, j == 0, False)
        if now is not None:
            out.append((position, now[0], began, going))
            ids = TaskContext.get().partitionId()
            flat = lambda m: [x for r in m or [] for x in r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids] * len(out)), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([flat(o[2]) for o in out], pa.list_(pa.float64())), pa.array([flat(o[3]) for o in out], pa.list_(pa.float64()))],
                names=["p", "position", "conv_id", "began", "going"],
            )

    found = rows.mapInArrow(edges, "p bigint, position bigint, conv_id bigint, began array<double>, going array<double>").collect()
    enter, leave = path_through([(r.p, r.position, r.conv_id, r.began, r.going) for r in found], len(hmm.roles))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role_pred", pa.string()), ("n_lines", pa.int32()), ("n_turns", pa.int32()), ("rendered", pa.string())])
        held: list[tuple] = []
        first = True

        def finish(last: bool) -> pa.RecordBatch:
            lines = [(line, j == 0) for _, _, text in held for j, line in enumerate((text or "").split("\n"))]
            roles = hmm.viterbi(lines, enter.get(p) if first else None, leave.get(p) if last else None)
            out, at = [], 0
            for conv, turn, text in held:
                m = (text or "").count("\n") + 1
                turns, shown = render(lines[at : at + m], roles[at : at + m], hmm.roles)
                out.append((conv, turn, hmm.roles[roles[at]], m, turns, shown))
                at += m
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if held and held[-1][0] != row[0]:
                    yield finish(False)
                    held, first = [], False
                held.append(row)
        if held:
            yield finish(True)

    return rows.mapInArrow(states, "conv_id bigint, turn bigint, role_pred string, n_lines int, n_turns int, rendered string")


def path_through(edges: list[tuple], k: int) -> tuple[dict[int, list[float]], dict[int, int]]:
    """(scores with which a partition's first conversation is entered, where it goes on from before;
    state in which a partition's last conversation is left, where it goes on behind). edges: (partition, position of the
    conversation in it, conversation, matrix if it began here, matrix if it goes on), in any order."""
    by: dict[int, list[tuple]] = {}
    for e in sorted(edges, key=lambda e: (e[0], e[1])):
        by.setdefault(e[0], []).append(e)
    order = sorted(by)
    enter: dict[int, list[float]] = {}
    after: dict[int, list[float]] = {}
    for before, p in zip([None, *order], order, strict=False):
        first, last = by[p][0], by[p][-1]
        if before is not None and by[before][-1][2] == first[2]:
            enter[p] = after[before]
        if first is last and p in enter:
            matrix = [last[4][i * k : i * k + k] for i in range(k)]
            after[p] = [max(enter[p][s] + matrix[s][t] for s in range(k)) for t in range(k)]
        else:
            after[p] = list(last[3])
    leave: dict[int, int] = {}
    for p, behind in reversed(list(zip(order, order[1:], strict=False))):
        if behind in enter:  # the last conversation of p goes on in behind
            first = by[behind][0]
            matrix = [first[4][i * k : i * k + k] for i in range(k)]
            if len(by[behind]) == 1 and behind in leave:
                end = leave[behind]
            else:
                end = max(range(k), key=lambda t, m=matrix, a=after[p]: max(a[s] + m[s][t] for s in range(k)))
            leave[p] = max(range(k), key=lambda s, m=matrix, a=after[p], e=end: a[s] + m[s][e])
    return enter, leave
