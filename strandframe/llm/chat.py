"""Chat formatting by minimum-cost role repair.

An automaton tells which turns are legal: an optional system turn, then user and assistant in alternation, ending with
the assistant. For every turn of a conversation a step is chosen - keep, merge into the turn before, relabel, or put
an empty turn in front - so that the sum of their costs is least; dynamic programming over the automaton's states
finds it, and the repaired sequence is rendered. Of steps that are equally cheap the first as listed by options() is
taken.

A conversation may be of any length: turns are dealt by ranges of conversation and place, so that a long one spans
partitions. Costs of a run of turns are a 4 x 4 matrix (min-plus), and only the two runs at the edges of each
partition are gathered: two rows of a few numbers a partition. From these follow the states in which a run that is
part of a longer conversation begins and the costs that lie beyond its end.

Each input turn gives one row with its fragment of the rendering; fragments joined by position are the conversation.
Defined results: turns are ordered by turn, then role, then text (nulls first), and rows that repeat all four are turns
of their own; rows with a null conv_id form one conversation; a null text is empty; a null or unknown role must be
relabelled or merged; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut

# The roles, other names for them, costs and marks.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
UNKNOWN = 3
MERGE, MERGE_UNKNOWN, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 3, 1, 2
END = "<|end|>\n"
INFINITE = 1 << 40

#: States: nothing yet, or the role of the last turn plus 1. Roles that may follow.
LEGAL = ((0, 1), (1,), (2,), (1,))
STATES = range(4)
#: Empty turns that bring each state to the end, an assistant's turn.
CLOSING: tuple[tuple[int, ...], ...] = ((), (1, 2), (2,), ())
FINAL = [INSERT * len(roles) for roles in CLOSING]

Step = tuple[int, int, str, tuple[int, ...], int]  # cost, next state, action, inserted roles, role


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else UNKNOWN


def options(state: int, role: int) -> list[Step]:
    relabel = RELABEL_UNKNOWN if role == UNKNOWN else RELABEL
    out: list[Step] = []
    for q in LEGAL[state]:
        if q == role:
            out.append((0, q + 1, "keep", (), q))
    if state and role in (state - 1, UNKNOWN):
        out.append((MERGE_UNKNOWN if role == UNKNOWN else MERGE, state, "merge", (), state - 1))
    for q in LEGAL[state]:
        if q != role:
            out.append((relabel, q + 1, "relabel", (), q))
    for p in LEGAL[state]:
        for q in LEGAL[p + 1]:
            cost = INSERT + (0 if q == role else relabel)
            out.append((cost, q + 1, "insert" if q == role else "insert+relabel", (p,), q))
    return out


OPTIONS = [[options(s, r) for r in range(4)] for s in STATES]


def costs_to_go(roles: list[int], beyond: list[int]) -> list[list[int]]:
    """Least cost from each state before each turn to the end, given those beyond the last turn."""
    out = [beyond]
    for role in reversed(roles):
        after = out[-1]
        out.append([min((o[0] + after[o[1]] for o in OPTIONS[s][role]), default=INFINITE) for s in STATES])
    out.reverse()
    return out


def choose(roles: list[int], state: int, beyond: list[int]) -> list[tuple[int, Step]]:
    """The state before each turn and the step taken."""
    to_go = costs_to_go(roles, beyond)
    out = []
    for i, role in enumerate(roles):
        step = min(OPTIONS[state][role], key=lambda o: o[0] + to_go[i + 1][o[1]])  # the first of the least
        out.append((state, step))
        state = step[1]
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost of the turns from each state to each."""
    columns = [costs_to_go(roles, [0 if t == end else INFINITE for t in STATES])[0] for end in STATES]
    return [[columns[t][s] for t in STATES] for s in STATES]


def fragment(state: int, step: Step, text: str) -> str:
    _, _, action, inserted, role = step
    if action == "merge":
        return "\n" + text
    out = []
    for q in (*inserted, role):
        out.append((END if state else "") + f"<|{ROLES[q]}|>\n")
        state = q + 1
    return "".join(out) + text


def closing(state: int) -> str:
    return "".join(END + f"<|{ROLES[q]}|>\n" for q in CLOSING[state]) + END


def _runs(stream: Iterable[pa.RecordBatch], wanted: list[int]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows with one conv_id, which is column 0."""
    name, rows, any_row = None, [], False
    for batch in stream:
        for row in zip(*(batch.column(i).to_pylist() for i in wanted)):
            if any_row and row[0] != name:
                yield name, rows
                rows = []
            name, any_row = row[0], True
            rows.append(row)
    if any_row:
        yield name, rows


def _edges(stream: Iterable[pa.RecordBatch], beyond: dict[tuple[int, int], list[int]] | None) -> Iterator[pa.RecordBatch]:
    """The first and the last run of the partition: costs (16), or the state to which each state leads (4)."""
    part = TaskContext.get().partitionId()
    kept: list[tuple[object, list[int]]] = []
    for name, rows in _runs(stream, [0, 2]):
        kept = [*kept[:1], (name, [role_code(r[1]) for r in rows])]
    out = []
    for place, (name, roles) in enumerate(kept):
        if beyond is None:
            out.append((part, place, len(kept), None if name is None else str(name), len(roles), sum(matrix(roles), [])))
        elif (part, place) in beyond:
            ends = []
            for state in STATES:
                steps = choose(roles, state, beyond[part, place])
                ends.append(steps[-1][1][1] if steps else state)
            out.append((part, place, len(kept), None, len(roles), ends))
    columns = list(zip(*out)) if out else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "place", "n", "name", "turns", "numbers"])


EDGES = "part long, place long, n long, name string, turns long, numbers array<long>"


def spanning(dealt: DataFrame) -> dict[tuple[int, int], tuple[int, list[int], int, bool]]:
    """For runs of conversations that span partitions: first state, costs beyond, turns before, and whether it ends here."""
    rows = sorted(dealt.mapInArrow(lambda s: _edges(s, None), EDGES).collect(), key=lambda r: (r["part"], r["place"]))
    chains: list[list] = []
    for r in rows:
        last = chains[-1][-1] if chains else None
        # a run goes on if it is the last of its partition and the next partition's first has the same name
        if last is not None and last["part"] != r["part"] and r["place"] == 0 and last["name"] == r["name"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    beyond: dict[tuple[int, int], list[int]] = {}
    for chain in chains:
        costs = FINAL
        for r in reversed(chain):
            beyond[r["part"], r["place"]] = costs
            m = r["numbers"]
            costs = [min(m[4 * s + t] + costs[t] for t in STATES) for s in STATES]
    if not chains:
        return {}
    ends = {(r["part"], r["place"]): r["numbers"] for r in dealt.mapInArrow(lambda s: _edges(s, beyond), EDGES).collect()}
    out = {}
    for chain in chains:
        state = before = 0
        for r in chain:
            key = (r["part"], r["place"])
            out[key] = (state, beyond[key], before, r is chain[-1])
            state, before = ends[key][state], before + r["turns"]
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, new_role, action, inserted, cost and rendered for each turn."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # the last key only parts rows that are equal in all columns
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("conv_id", "turn", "role", "text", "tie").sortWithinPartitions("conv_id", "turn", "role", "text").drop("tie")
    dealt = cut(dealt)  # every pass must see the same partitions
    known = spanning(dealt)
    fields = [("conv_id", dealt.schema["conv_id"].dataType), ("turn", dealt.schema["turn"].dataType)]
    kinds = {name: kind.simpleString() for name, kind in fields}
    schema = f"conv_id {kinds['conv_id']}, position long, turn {kinds['turn']}, role string, new_role string, action string, inserted string, cost long, rendered string"

    def render(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types: list[pa.DataType] = []

        def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field(0).type, b.schema.field(1).type]
                yield b

        runs = _runs(seen(stream), [0, 1, 2, 3])
        held = next(runs, None)
        place = 0
        while held is not None:
            following = next(runs, None)
            # a partition's last run is at place 1, or at 0 if it is the only one
            key = (part, 0) if place == 0 else (part, 1) if following is None else (part, 2)
            state, beyond, before, ends = known.get(key, (0, FINAL, 0, True))
            name, turns = held
            out = []
            steps = choose([role_code(t[2]) for t in turns], state, beyond)
            for i, ((state, step), (_, turn, role, text)) in enumerate(zip(steps, turns)):
                shown = fragment(state, step, text or "")
                if ends and i == len(turns) - 1:
                    shown += closing(step[1])
                out.append((name, before + i, turn, role, ROLES[step[4]], step[2], ",".join(ROLES[q] for q in step[3]), step[0], shown))
            kinds = [types[0], pa.int64(), types[1], *[pa.string()] * 4, pa.int64(), pa.string()]
            names = ["conv_id", "position", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
            for start in range(0, len(out), 2048):
                columns = zip(*out[start : start + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            place, held = place + 1, following

    return dealt.mapInArrow(render, schema)
