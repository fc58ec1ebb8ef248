"""Session events folded by a state machine, over batches and streams; windowed usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moves of a session: (state, event kind) -> next state; any other move is rejected and changes nothing.
MOVES = {
    ("new", "view"): "open",
    ("new", "signup"): "open",
    ("open", "view"): "open",
    ("open", "click"): "active",
    ("active", "click"): "active",
    ("active", "view"): "active",
    ("active", "purchase"): "done",
    ("active", "error"): "failed",
    ("open", "error"): "failed",
    ("done", "view"): "open",
    ("failed", "view"): "open",
}
OUT = "session long, at timestamp, seq long, kind string, state string, accepted boolean"


def _step(state: str, kind: str, moves: dict[tuple[str, str], str]) -> tuple[str, bool]:
    to = moves.get((state, kind))
    return (state, False) if to is None else (to, True)


def fold(events: DataFrame, moves: dict[tuple[str, str], str] = MOVES) -> DataFrame:
    """(session, at, seq, kind, state, accepted): events (session, at, seq, kind) of each session in order of
    time and seq, the state after each, and whether the move was valid.

    A session is folded in one task from sorted batches: only its state is held, never its events.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, "new"
        for rows in batches:
            states, valid = [], []
            for s, kind in zip(rows["session"], rows["kind"], strict=True):
                if s != session:
                    session, state = s, "new"
                state, ok = _step(state, kind, moves)
                states.append(state)
                valid.append(ok)
            yield rows.assign(state=states, accepted=valid)

    ordered = events.select("session", "at", "seq", "kind").where("session is not null").repartition("session").sortWithinPartitions("session", "at", "seq", "kind")
    return ordered.mapInPandas(run, OUT)


def fold_stream(events: DataFrame, late: str, moves: dict[tuple[str, str], str] = MOVES) -> DataFrame:
    """fold() over a stream: events wait in state until the watermark has passed them, then are applied in order.

    An event later than the watermark is dropped by Spark before it gets here.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = held.get if held.exists else ("new", [])
        waiting = [tuple(w) for w in waiting]
        for rows in batches:
            waiting += [(int(a.timestamp() * 1_000_000), int(s), k) for a, s, k in zip(rows["at"], rows["seq"], rows["kind"], strict=True)]
        mark = held.getCurrentWatermarkMs() * 1000
        ready = sorted(w for w in waiting if w[0] <= mark)
        rest = [w for w in waiting if w[0] > mark]
        out = []
        for at, seq, kind in ready:
            state, ok = _step(state, kind, moves)
            out.append((key[0], pd.Timestamp(at, unit="us"), seq, kind, state, ok))
        held.update((state, rest))
        if rest:
            held.setTimeoutTimestamp(max(min(w[0] for w in rest) // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "at", "seq", "kind", "state", "accepted"])

    marked = events.withWatermark("at", late)
    return marked.groupBy("session").applyInPandasWithState(run, OUT, "state string, waiting array<struct<at:long,seq:long,kind:string>>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_usage(events: DataFrame, at: str, late: str, width: str, by: list[str], value: str) -> DataFrame:
    """Calls and values by window and group; on a stream late rows beyond the watermark are left out."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    out = marked.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "calls", "total")
