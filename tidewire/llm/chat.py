"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

A turn is a row of text, its role unknown. The hidden states are the roles; what is
seen are the lines of a turn: a speaker marker at its start ("User:", "### Assistant",
"<|im_start|>system"), how long a line is, how it ends, and how many there are. Line
features are independent given the role, so a turn's log-likelihoods are sums over
its lines. Initial, transition and emission probabilities are counted over all rows
whose role is known, with one added to each count.

Viterbi runs over blocks of turns. Of each block a table of best scores from any
state before it to any state at its end is made; these tables are chained per
conversation, one small row a block, which fixes the states at every block's edges;
then each block finds its own best path between them. A conversation of any length
is thus spread over as many tasks as it has blocks.

Defined results: a null or empty text is one empty line; turns are in order of turn,
ties in order of the hash of the text, then of the given role, null turns first;
repeated rows are turns of their own; a row without conv_id is a conversation of one turn; given roles
outside ROLES are unknown; equal paths go to the earlier role in ROLES; no known role
at all makes all probabilities equal; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import ALNUM_WORD
from tidewire.plans.scan import previous, running
from tidewire.plans.storage import stage

ROLES = ("system", "user", "assistant")
TURNS = 512

#: Words that mark a speaker, by role; fixed values.
MARKERS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "question", "prompt", "customer", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "response", "agent", "gpt", "a"),
}
_SPEAKER = {word: role for role, words in MARKERS.items() for word in words}
_MARKER = re.compile(r"\s*(?:<\|im_start\|>\s*|<\||[#*\[\s]*)(" + "|".join(sorted(_SPEAKER, key=len, reverse=True)) + r")\s*(?:\|>\s*|[*\]]*\s*:[*\s]*|\]\s*|(?=\n)\s*|(?<=\w)$)", re.IGNORECASE)
_FEATURES = 64


def marker(text: str) -> tuple[str | None, int]:
    """The role that a speaker marker at the start of a text names, and where it ends."""
    found = _MARKER.match(text)
    return (_SPEAKER[found[1].lower()], found.end()) if found else (None, 0)


def features(text: str | None) -> list[int]:
    """Numbers below _FEATURES: the marker, the number of lines, and two for each line."""
    text = text or ""
    role, end = marker(text)
    lines = text[end:].split("\n")
    out = [0 if role is None else 1 + ROLES.index(role), 4 + min(len(lines), 8) - 1]
    for k, line in enumerate(lines):
        line = line.rstrip()
        size = min(len(line).bit_length(), 11)
        last = line[-1:]
        kind = 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3 if ALNUM_WORD.fullmatch(last) else 4
        out += [12 + size + (12 if k else 0), 36 + kind + (5 if k else 0)]
    return out


@dataclass(frozen=True)
class Model:
    """Log-probabilities: start (roles), move (from, to), emit (roles, features)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def seen(self, text: str | None) -> np.ndarray:
        return self.emit[:, features(text)].sum(1)


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with their conversation key, their block and what orders them in it."""
    known = F.lower(F.trim(F.col("role").cast("string")))
    alone = F.concat(F.lit("alone:"), F.monotonically_increasing_id().cast("string"))
    at = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 60)))
    return turns.select(
        "conv_id",
        "turn",
        "text",
        F.coalesce(F.concat(F.lit("c:"), F.col("conv_id").cast("string")), alone).alias("conv"),
        F.when(known.isin(*ROLES), known).alias("given"),
        at.alias("at"),
        F.xxhash64("text", known).alias("tie"),
        F.floor(at / TURNS).alias("block"),
    )


def fit(turns: DataFrame) -> Model:
    """The model counted from all rows with a known role."""
    rows = turns.where(F.lower(F.trim(F.col("role").cast("string"))).isin(*ROLES)).select(F.lower(F.trim("role")).alias("role"), "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ROLES), _FEATURES), np.int64)
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                np.add.at(counts[ROLES.index(role)], features(text), 1)
        r, f = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"role": pa.array(r, pa.int64()), "feature": pa.array(f, pa.int64()), "n": counts[r, f]})

    emit = np.ones((len(ROLES), _FEATURES))
    for x in rows.mapInArrow(tally, "role long, feature long, n long").groupBy("role", "feature").agg(F.sum("n").alias("n")).collect():
        emit[x["role"], x["feature"]] += x["n"]
    named = _ordered(turns).where("conv_id is not null").select("conv", "at", "tie", "given")
    pairs = running(named, ["conv"], ["at", "tie"], {"before": previous("given")}, block_size=TURNS)
    first = F.col("before").isNull()
    moves = pairs.groupBy(first.alias("first"), F.col("before.given").alias("before"), "given").count().collect()
    start, move = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    for x in moves:
        if x["given"] is None:
            continue
        if x["first"]:
            start[ROLES.index(x["given"])] += x["count"]
        elif x["before"] is not None:
            move[ROLES.index(x["before"]), ROLES.index(x["given"])] += x["count"]
    groups = [slice(0, 4), slice(4, 12), slice(12, 24), slice(24, 36), slice(36, 41), slice(41, 46)]
    for g in groups:
        emit[:, g] /= emit[:, g].sum(1, keepdims=True)
    return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit))


def opened(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best scores of the states at the end of a conversation's first turns."""
    best = model.start + seen[0]
    for row in seen[1:]:
        best = (best[:, None] + model.move).max(0) + row
    return best


def chained(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best scores (state before the turns, state at their end)."""
    best = model.move + seen[0]
    for row in seen[1:]:
        best = (best[:, :, None] + model.move[None]).max(1) + row
    return best


def path(model: Model, seen: np.ndarray, before: int | None, end: int | None) -> list[int]:
    """The best states of turns between the state before them (None: none) and at their end (None: any)."""
    score = (model.start if before is None else model.move[before]) + seen[0]
    back = []
    for row in seen[1:]:
        ways = score[:, None] + model.move
        back.append(ways.argmax(0))
        score = ways.max(0) + row
    states = [int(score.argmax()) if end is None else end]
    for row in reversed(back):
        states.append(int(row[states[-1]]))
    return states[::-1]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal keys, one table each."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        at = 0
        for i, name in enumerate(names):
            if name != now:
                if now is not None and (held or i > at):
                    yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, at, now = [], i, name
        if at < len(names):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _sorted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _edges(rows: DataFrame, model: Model) -> DataFrame:
    """(conv, block, before, end): the states before and at the end of each block on the
    best path of its conversation."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    table = "conv string, block long, best array<double>, opened array<double>"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["conv", "block"]):
            seen = np.array([held.value.seen(t) for t in run.column("text").to_pylist()])
            conv, block = run.column("conv")[0].as_py(), run.column("block")[0].as_py()
            best, first = chained(held.value, seen), opened(held.value, seen)
            yield pa.RecordBatch.from_pydict({"conv": [conv], "block": pa.array([block], pa.int64()), "best": [best.ravel().tolist()], "opened": [first.tolist()]})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["conv"]):
            score = np.array(run.column("opened")[0].as_py())
            back = []
            for best in run.column("best").to_pylist()[1:]:
                ways = score[:, None] + np.array(best).reshape(len(ROLES), len(ROLES))
                back.append(ways.argmax(0))
                score = ways.max(0)
            ends = [int(score.argmax())]
            for row in reversed(back):
                ends.append(int(row[ends[-1]]))
            ends.reverse()
            yield pa.RecordBatch.from_pydict({"conv": run.column("conv").combine_chunks(), "block": run.column("block").combine_chunks(), "before": pa.array([None, *ends[:-1]], pa.int64()), "end": pa.array(ends, pa.int64())})

    narrow = rows.where("conv_id is not null").select("conv", "block", "at", "tie", "text")
    blocks = stage(_sorted(narrow, ["conv", "block"], ["at", "tie"]).mapInArrow(summarise, table), "blocks")
    return stage(_sorted(blocks, ["conv"], ["block"]).mapInArrow(chain, "conv string, block long, before long, end long"), "edges")


def render(role: str, text: str | None) -> str:
    """A turn in canonical form, without the speaker marker it may start with."""
    text = text or ""
    return f"<|im_start|>{role}\n{text[marker(text)[1] :].strip()}<|im_end|>\n"


def recover(turns: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, given_role, role, rendered) per row of turns."""
    rows = _ordered(turns)
    held = turns.sparkSession.sparkContext.broadcast(model)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["conv", "block"]):
            texts = run.column("text").to_pylist()
            seen = np.array([held.value.seen(t) for t in texts])
            states = path(held.value, seen, run.column("before")[0].as_py(), run.column("end")[0].as_py())
            names = [ROLES[s] for s in states]
            more = {"role": names, "rendered": [render(r, t) for r, t in zip(names, texts)]}
            yield from pa.table({"conv_id": run.column("conv_id"), "turn": run.column("turn"), "given_role": run.column("given"), **more}).to_batches()

    placed = rows.join(_edges(rows, model), ["conv", "block"], "left")
    found = _sorted(placed, ["conv", "block"], ["at", "tie"]).select("conv", "block", "conv_id", "turn", "given", "text", "before", "end")
    return found.mapInArrow(decode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, given_role string, role string, rendered string")
