"""Rate limits call by call: every call is allowed or refused as it comes.

The first `limit` calls of a window (per key, by time, then id) are allowed, as the batch form counts
them. State holds just those calls, so it stays small for any number of calls. The keys are dealt over
SHARDS groups for each window, and a group decides its calls together: a group for each key would spend
nearly all its time on the way to Python and back. A call is decided when it
comes; if an earlier call of the window arrives after it and takes its place, a correction follows. The
newest revision of a call is its decision, whatever order calls come in. An event-time timer drops
the state of a window once the watermark has passed its end. Calls that come later than the watermark
allows are not decided; Spark counts them as rows dropped by watermark.

A call that is delivered again within the watermark counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Groups of keys for each window.
SHARDS = 8


def _decider(keys: list[str], limit: int, end_of: str, columns: list[str]):
    # a call that holds a place: its keys, time and id; the last value of a state is how often it was decided
    place = [*keys, "_micros", "event_id"]

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *values, revision = state.get if state.exists else (*[[] for _ in place], 0)
        held = [np.array(v, dtype=object) for v in values]
        last = None
        for frame in frames:
            revision += 1
            last = int(frame[end_of].iat[0])
            both = [np.r_[h, frame[c].to_numpy(object)] for h, c in zip(held, place, strict=True)]
            n_held = len(held[0])
            of_key = np.zeros(len(both[0]), dtype=np.int64)
            for values in both[:-2]:
                code = pd.factorize(values, use_na_sentinel=False)[0]
                of_key = pd.factorize(of_key * (code.max() + 1) + code)[0]
            times, ids = both[-2].astype(np.int64), both[-1].astype(np.int64)
            order = np.lexsort((ids, times, of_key))
            k, t, i = of_key[order], times[order], ids[order]
            other_key = np.r_[True, k[1:] != k[:-1]]
            fresh = other_key | np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])]  # a call that comes again counts once
            nth = np.cumsum(fresh)
            rank = nth - np.maximum.accumulate(np.where(other_key, nth, 0))
            allowed = np.empty(len(order), dtype=bool)
            allowed[order] = rank < limit
            made = frame[columns].assign(allowed=allowed[n_held:])
            moved = np.flatnonzero(~allowed[:n_held])
            if len(moved):  # allowed calls gave their places to earlier ones
                back = {c: values[moved] for c, values in zip(place, both, strict=True) if c in columns}
                back = pd.DataFrame(back | {"window_start": frame["window_start"].iat[0], "allowed": False})
                made = pd.concat([made, back[made.columns].astype(made.dtypes)], ignore_index=True)
            kept = order[fresh & (rank < limit)]
            held = [values[kept] for values in both]
            yield made.assign(revision=revision)
        state.update((*[h.tolist() for h in held], revision))
        if last is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    return decide


def decisions(
    calls: DataFrame, limit: int, keys: list[str], unit: str = "minute", lateness: str = "10 minutes"
) -> DataFrame:
    """A stream of keys, window_start, event_id, allowed, revision: one row per call as it comes,
    and one per correction."""
    columns = [*keys, "window_start", "event_id"]
    windowed = (
        calls.withWatermark("request_time", lateness)
        .dropDuplicatesWithinWatermark(["event_id"])
        .withColumn("window_start", F.date_trunc(unit, "request_time"))
        .withColumn("_micros", F.unix_micros("request_time"))
        .withColumn("_end", F.unix_millis(F.col("window_start") + F.expr(f"INTERVAL 1 {unit}")))
    )
    kinds = dict(windowed.dtypes)
    # keys are text on the way: beside a NULL, pandas would turn whole numbers to floats
    texts = {c: F.col(c).cast("string") for c in keys}
    out = ", ".join(f"`{c}` {'string' if c in keys else kinds[c]}" for c in columns) + ", allowed boolean, revision long"
    state = ", ".join([*[f"k{n} array<string>" for n in range(len(keys))], "times array<long>, ids array<long>, revision long"])
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)) if keys else F.lit(0)
    return (
        windowed.select(*columns, "request_time", "_micros", "_end", shard.alias("_shard"))  # the event time goes along
        .withColumns(texts)
        .groupBy("_shard", "window_start")
        .applyInPandasWithState(
            _decider(keys, limit, "_end", columns), out, state, "append", GroupStateTimeout.EventTimeTimeout
        )
        .withColumns({c: F.col(c).cast(kinds[c]) for c in keys})
    )


def decided(log: DataFrame) -> DataFrame:
    """The newest decision of every call of a decisions log."""
    values = F.struct(*[c for c in log.columns if c not in ("event_id", "revision")])
    return log.groupBy("event_id").agg(F.max_by(values, "revision").alias("_v")).select("event_id", "_v.*")
