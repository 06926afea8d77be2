"""Odometry and its evaluation on streams of frames.

A sequence's state is its map, its last motion and the end of its last frame, as one compressed file
of arrays; eviction bounds the map, so the state doesn't grow with the stream. Frames come whole in
a micro-batch, which holds for file sources with a file a frame. What a frame is late or irregular
is told by the data: a frame that isn't after the last one, or whose duration is off, is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import algebra as A
from ..operators import registration as R
from ..operators import trajectories as T


def odometry(points: DataFrame, options: R.Options = R.Options(), state: type[R.Odometry] = R.Odometry, expected: float = 0.0, tolerance: float = 0.05) -> DataFrame:
    """R.POSES of a stream of points.

    expected: duration of a frame; after a sequence's first frame, frames whose duration isn't within
    a share `tolerance` of it are skipped (0: none is). Frames that come after a later one are skipped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own, last = state(options), -1
        if held.exists:
            body, last = held.get
            own.restore(bytes(body))
        rows = pd.concat(list(frames))
        out = []
        for frame, part in rows.groupby("frame_id"):
            late = frame <= last
            odd = expected > 0 and own.frames > 0 and abs(np.ptp(part["t"].to_numpy()) / expected - 1) > tolerance
            if not late and not odd:
                out += R.frame_rows(key[0], own, part)
                last = int(frame)
        held.update((own.state(), last))
        yield pd.DataFrame(out, columns=R.NAMES)

    rows = points.select("seq", "frame_id", "point_id", "x", "y", "z", "t")
    return rows.groupBy("seq").applyInPandasWithState(run, R.POSES, "state binary, last long", "append", GroupStateTimeout.NoTimeout)


def newest(frames: DataFrame, n: int) -> DataFrame:
    """Of a micro-batch the points of each sequence's last n frames: older ones are dropped, as by a queue of n places that is full."""
    rank = F.dense_rank().over(Window.partitionBy("seq").orderBy(F.desc("frame_id")))
    return frames.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def errors(poses: DataFrame, truth: DataFrame) -> DataFrame:
    """Running n, mean_ape and max_ape of each sequence of a stream of poses against a table of true ends (seq, frame_id, x, y, z, qx ... qw). For output mode `complete` or `update`."""
    known = truth.select("seq", "frame_id", *[F.col(n).alias(f"g_{n}") for n in T.POSE])
    ends = poses.select("seq", "frame_id", *[F.col(f"e{n}").alias(n) for n in T.POSE])
    apart = ends.join(known, ["seq", "frame_id"]).withColumn("ape", A.norm(A.relative(T.pose(), T.pose("g_"))[1]))
    return apart.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.avg("ape").alias("mean_ape"), F.max("ape").alias("max_ape"))


def fan_out(stream: DataFrame, observers: list[Callable[[DataFrame, int], None]], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Every micro-batch is handed to all observers; every `seconds` a new one begins, or as soon as there are rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for f in observers:
            f(batch, number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer).start()


def replay(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of a folder of Parquet files, a number of files (frames) a micro-batch, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def describe(frames: dict[str, DataFrame]) -> DataFrame:
    """source, column and type of each named stream or table."""
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, df in frames.items() for f in df.schema.fields], "source string, column string, type string")
