"""The sequential batching rule, for the option mixes that have no closed form.

The rule runs over rows that Spark has partitioned by segment and sorted; a
segment starts where the rule forgets its state, so partitions never depend
on each other and memory stays constant however long a segment is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

SAVED, REJECTED, SKIPPED, OUT_OF_RANGE = "saved", "rejected", "skipped", "out_of_range"
# The reasons of a report.
GAP, SPAN, COUNT, TIMEOUT = "Time gap", "Time span", "Max message count reached", "Time out reached"
RANGE = "Out of range"


@dataclass
class OpenBatch:
    """What a feed remembers between two messages."""

    batch_id: int | None = None
    n: int = 0
    last: int = 0

    def close(self) -> None:
        self.batch_id, self.n = None, 0


def step(state: OpenBatch, article: int, t: int, in_range: bool, has_files: bool, gap: int, span: int, limit: int):
    """One message (times in microseconds). Returns (action, reason the open batch was closed or None)."""
    was_open = state.n > 0
    if not in_range:
        state.close()
        state.last = t
        return OUT_OF_RANGE, (RANGE if was_open else None)
    reason = None
    if gap and t - state.last >= gap:
        reason = GAP if was_open else None
        state.close()
        state.last = t
    if span:
        if t // span != state.last // span:
            reason = SPAN if state.n > 0 else reason
            state.close()
            state.last = t
        elif limit and state.n >= limit:
            return REJECTED, reason
    if not has_files:
        return SKIPPED, reason
    if state.n == 0:
        state.batch_id = article
    state.n += 1
    state.last = t
    return SAVED, reason


def after(state: OpenBatch, span: int, gap: int, limit: int) -> bool:
    """Close by count after a saved message; with a gap or span the count never closes."""
    if limit and state.n >= limit and not span and not gap:
        state.close()
        return True
    return False


def run(frames: Iterator[pd.DataFrame], gap: int, span: int, limit: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (newsgroup, segment, article_number); state restarts per segment.

    ``carried_*`` columns hold the open batch a feed enters its first segment with."""
    current = None
    state = OpenBatch()
    for frame in frames:
        size = len(frame)
        feeds = frame["newsgroup"].to_numpy()
        segments = frame["segment"].to_numpy()
        articles = frame["article_number"].to_numpy()
        times = frame["t"].to_numpy()
        in_range = frame["in_range"].to_numpy()
        has_files = frame["has_files"].to_numpy()
        carried_id = frame["carried_id"].to_numpy()
        carried_n = frame["carried_n"].to_numpy()
        carried_last = frame["carried_last"].to_numpy()
        actions = np.empty(size, dtype=object)
        batches = np.full(size, -1, dtype="int64")
        open_id = np.zeros(size, dtype="int64")
        open_n = np.zeros(size, dtype="int64")
        open_last = np.zeros(size, dtype="int64")
        for i in range(size):
            key = (feeds[i], segments[i])
            if key != current:
                current = key
                state = OpenBatch()
                if carried_n[i] > 0:
                    state = OpenBatch(int(carried_id[i]), int(carried_n[i]), int(carried_last[i]))
            article = int(articles[i])
            actions[i], _ = step(state, article, int(times[i]), in_range[i], has_files[i], gap, span, limit)
            if actions[i] == SAVED:
                batches[i] = state.batch_id
                after(state, span, gap, limit)
            if state.n > 0:
                open_id[i], open_n[i], open_last[i] = state.batch_id, state.n, state.last
        yield pd.DataFrame(
            {
                "newsgroup": feeds,
                "article_number": articles,
                "t": times,
                "n_bytes": frame["n_bytes"].to_numpy(),
                "action": actions,
                "batch_id": pd.array(np.where(batches < 0, 0, batches), dtype="Int64"),
                "saved": batches >= 0,
                "open_id": open_id,
                "open_n": open_n,
                "open_last": open_last,
            }
        )
