"""The folds of operators.events on streams: state by key, events in order of time within a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttled(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Rows key, us, event_id that a leading-edge throttle keeps; the state is the last kept time."""
    gap = round(seconds * 1e6)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        kept = []
        for us, event_id in zip(rows["us"].tolist(), rows["event_id"].tolist(), strict=True):
            if last is None or us - last > gap:
                last = us
                kept.append((k[0], us, event_id))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "us", "event_id"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, us long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def changed(events: DataFrame, key: str, value: str) -> DataFrame:
    """Rows key, event_id, value whose value differs from the one before (null equals null); the state is the last value."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event_id, v in zip(rows["event_id"].tolist(), rows[value].tolist(), strict=True):
            if not seen or v != last:
                out.append((k[0], event_id, v))
            seen, last = True, v
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", value])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, {value} string", "last string", "append", GroupStateTimeout.NoTimeout)


def taps(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Rows key, event_id, suppressed of the taps among events of kind press and tap; the state is the last press not yet used up."""
    near = round(seconds * 1e6)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        press = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for us, event_id, kind in rows[["us", "event_id", "kind"]].itertuples(index=False):
            if kind == "press":
                press = us
            else:
                hit = press is not None and us - press < near
                out.append((k[0], event_id, hit))
                press = None if hit else press
        state.update((press,))
        yield pd.DataFrame(out, columns=[key, "event_id", "suppressed"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, suppressed boolean", "press long", "append", GroupStateTimeout.NoTimeout)


def navigation(events: DataFrame, key: str) -> DataFrame:
    """Rows key, event_id, depth, top; events need kind, word and found; the state is the stack of words."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event_id, kind, word, found in rows[["event_id", "kind", "word", "found"]].itertuples(index=False):
            if kind == "close":
                stack = []
            elif kind == "open" and found:
                stack = [word]
            elif kind == "push" and found:
                stack = [*stack, word]
            elif kind == "pop":
                stack = stack[:-1]
            out.append((k[0], event_id, len(stack), stack[-1] if stack else None))
        state.update((stack,))
        yield pd.DataFrame(out, columns=[key, "event_id", "depth", "top"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, depth long, top string", "stack array<string>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Run a stream over what is there now, write what it appends to the folder `out`, and read that."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
