"""A sliding-log rate limit over a stream of requests, with the same decisions as over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwright.operators.folds import SlidingLog
from inkwright.operators.ordered import stream_by_key

DAY = 86_400.0
#: (window in seconds, most requests in it), tested in turn.
LIMITS = [(DAY, 3), (7 * DAY, 12)]
SCHEMA = "user_id long, event_id long, allowed boolean, wait int"


def decide(requests: DataFrame, limits: list[tuple[float, int]] = LIMITS) -> DataFrame:
    """(user_id, event_id, allowed, wait) of requests (user_id, event_id, t), t in seconds. Ties in time go by event_id."""

    def start(_: int):
        log = SlidingLog(limits)
        return lambda r: [(r.user_id, r.event_id, *log.offer(r.t))]

    return stream_by_key(requests.where("user_id is not null and t is not null"), "user_id", ["t", "event_id"], SCHEMA, start)


def decide_stream(requests: DataFrame, limits: list[tuple[float, int]] = LIMITS, late: str = "7 days") -> DataFrame:
    """The same over a streaming frame, in the order in which requests arrive and within a micro-batch in that of their times; one
    that is older than the watermark, `late` behind the latest, is dropped. The log of a key is its state: never more entries than
    its limits allow, and removed when the watermark shows that all of them have expired."""
    longest = max(window for window, _ in limits)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limits, [list(k) for k in state.get[0]] if state.exists else None)
        rows = pd.concat([p[["event_id", "t"]] for p in parts]).sort_values(["t", "event_id"])
        out = [(key[0], r.event_id, *log.offer(r.t)) for r in rows.itertuples(index=False)]
        state.update(([list(k) for k in log.kept],))
        last = max([k[-1] for k in log.kept if k] + [float(rows["t"].max())])
        state.setTimeoutTimestamp(int(max((last + longest) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "wait"])

    timed = requests.where("user_id is not null and t is not null").withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, SCHEMA, "kept array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)
