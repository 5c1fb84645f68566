"""History kept by the stream: validity intervals from a change feed, in whatever order it comes.

State holds, per bucket of log positions and shard of ids, the ids, positions and times of the images that
came, so it is bounded by the width of a bucket however often an id changes. A shard stands for about
SHARD_POSITIONS positions of a bucket: a group for each id would spend nearly all its time on the way to Python and
back. An image that comes late splits the interval it falls into: it is written with its own end, and a
correction gives the image before it the new one. The log of images and corrections is the history;
intervals() folds it, the newest revision of an image's end being the one that holds. The end of a bucket's
last image is the head of the id's next bucket. An image that is delivered again is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfwise.operators.changelog import LSN_PER_BUCKET, images

KEY = ["id", "bucket", "lsn", "sort_by"]
SHARD_POSITIONS = 1_000


def _split(columns: list[str]):
    place = ["id", "lsn", "sort_by", "_micros"]

    def split(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *values, revision = state.get if state.exists else (*[[] for _ in place], 0)
        held = [np.array(v, dtype=object) for v in values]
        for frame in frames:
            revision += 1
            times = [None if pd.isna(t) else int(t) for t in frame["_micros"]]
            came = frame.assign(_micros=pd.Series(times, dtype=object, index=frame.index))
            ids, lsns, sorts, micros = (np.r_[h, came[c].to_numpy(object)] for h, c in zip(held, place, strict=True))
            of_id = pd.factorize(ids, use_na_sentinel=False)[0]
            order = np.lexsort((sorts.astype(np.int64), lsns.astype(np.int64), of_id))  # stable: the held before those that come again
            n, at, by = of_id[order], lsns[order], sorts[order]
            first = np.r_[True, (n[1:] != n[:-1]) | (at[1:] != at[:-1]) | (by[1:] != by[:-1])]
            order, n = order[first], n[first]
            fresh = order >= len(held[0])
            followed = np.r_[n[1:] == n[:-1], False]
            # ends of the new images, and of those that now have another follower
            changed = np.flatnonzero(fresh | (followed & np.r_[fresh[1:], False]))
            times = micros[order]
            if len(changed):
                new, follows, rows = fresh[changed], followed[changed], order[changed]
                images = came[columns].astype(object).iloc[np.where(new, rows - len(held[0]), 0)].reset_index(drop=True)
                made = images.where(pd.Series(new), None)  # a correction has the place and the end only
                ends = np.where(follows, np.r_[times[1:], None][changed], None)
                yield made.assign(
                    id=ids[rows], bucket=key[0], lsn=lsns[rows], sort_by=sorts[rows], is_image=new, has_next=follows,
                    next_micros=ends, revision=revision,
                )
            held = [ids[order], lsns[order], sorts[order], times]
        state.update((*[h.tolist() for h in held], revision))

    return split


def interval_log(changes: DataFrame, lsn_per_bucket: int = LSN_PER_BUCKET) -> DataFrame:
    """A stream of images and corrections from a stream of changes (id, lsn, sort_by, change_ts,
    change_type and any other columns)."""
    values = [c for c in changes.columns if c not in ("id", "lsn", "sort_by", "change_ts")]
    kinds = dict(changes.dtypes)
    placed = images(changes).select(
        F.col("id").cast("string"), F.floor(F.col("lsn") / lsn_per_bucket).alias("bucket"), "lsn", F.col("sort_by").cast("bigint").alias("sort_by"),
        F.unix_micros(F.col("change_ts").cast("timestamp")).alias("_micros"), *values,
    )
    columns = ["_micros", *values]
    shards = -(-lsn_per_bucket // SHARD_POSITIONS)
    state = "ids array<string>, lsn array<long>, sort_by array<long>, micros array<long>, revision long"
    out = ", ".join(
        ["id string", "bucket long", "lsn long", "sort_by long", "is_image boolean", "has_next boolean",
         "next_micros long", "revision long", "_micros long", *[f"`{c}` {kinds[c]}" for c in values]]
    )
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("_shard")
    made = placed.select("*", shard).groupBy("bucket", "_shard").applyInPandasWithState(
        _split(columns), out, state, "append", GroupStateTimeout.NoTimeout
    )
    # ids are text on the way: beside a NULL, pandas would turn whole numbers to floats
    return made.withColumn("id", F.col("id").cast(kinds["id"]))


def intervals(log: DataFrame) -> DataFrame:
    """Validity intervals from the log: as changelog.history() gives them over all changes."""
    fixed = [*KEY, "is_image", "has_next", "next_micros", "revision"]
    values = [c for c in log.columns if c not in fixed]
    newest = log.groupBy(*KEY).agg(
        F.max_by(F.struct("has_next", "next_micros"), "revision").alias("_end"),
        F.max_by(F.struct(*values), "is_image").alias("_row"),
    )
    rows = newest.select(*KEY, "_end.*", "_row.*")
    heads = rows.groupBy("id", "bucket").agg(F.min_by("_micros", F.struct("lsn", "sort_by")).alias("_head"))
    following = F.lead("_head").over(Window.partitionBy("id").orderBy("bucket"))
    heads = heads.select("id", "bucket", following.alias("_next_head"))
    moment = lambda c: F.timestamp_micros(c)
    return (
        rows.join(heads, ["id", "bucket"])
        .withColumn("valid_from", moment(F.col("_micros")))
        .withColumn("valid_to", moment(F.when(F.col("has_next"), F.col("next_micros")).otherwise(F.col("_next_head"))))
        .where(F.col("change_type") != "delete")
        .withColumn("is_current", F.col("valid_to").isNull())
        .drop("bucket", "has_next", "next_micros", "_micros", "_next_head")
    )
