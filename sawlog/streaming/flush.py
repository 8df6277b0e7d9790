"""Closing a stream: what waits for the watermark comes out when the input has ended.

A heartbeat is a row that has a time and nothing else. It moves the watermark like any row; the streaming
operators leave it out behind the watermark. One at the end of time closes every window, rule and interval.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sawlog.session import plain_checkpoints

END_OF_TIME = "9000-01-01 00:00:00"
MARKERS = ("line_id", "seq")


def watermarked(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    """The rows under a watermark, without heartbeats: rows with a time whose id is null."""
    marked = df.withWatermark(time_col, delay)
    ids = [c for c in MARKERS if c in df.columns]
    # The time is in the test so that it stays behind the watermark.
    return marked.where(F.col(ids[0]).isNotNull() | F.col(time_col).isNull()) if ids else marked


def _heartbeat(df: DataFrame, time_col: str, at: str) -> DataFrame:
    columns = [F.lit(at if f.name == time_col else None).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.sparkSession.range(1).select(*columns)


def run_to_end(lines: DataFrame, build: Callable[[DataFrame], DataFrame], place: str, time_col: str = "ts") -> DataFrame:
    """Run ``build(lines)`` over all that is there, then close it; the result is a table below ``place``.

    ``place`` is a folder all executors reach. Two runs share one checkpoint: the first reads the input, the second a
    heartbeat. After that the stream has ended: later rows would be late.
    """
    spark, beats = lines.sparkSession, f"{place}/beats"
    _heartbeat(lines, time_col, END_OF_TIME).limit(0).write.parquet(beats)
    stream = build(lines.unionByName(spark.readStream.schema(lines.schema).parquet(beats)))

    def run() -> None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state")
        writer.trigger(availableNow=True).start(f"{place}/out").awaitTermination()

    with plain_checkpoints(spark, place):
        run()
        _heartbeat(lines, time_col, END_OF_TIME).write.mode("append").parquet(beats)
        run()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def run_until_still(starts: list[Callable[[], StreamingQuery]], tries: int = 3, pause: float = 1.0) -> None:
    """Run streams side by side until the offsets of all stand still, then stop them.

    A stream that fails is started again and goes on from its checkpoint, so no row is lost or comes twice; the error
    of one that fails ``tries`` times without a batch between them is raised.
    """
    running, failed = [], [0] * len(starts)

    def ended(no: int) -> None:
        """Wait for what is there, and start the stream again where it failed."""
        while True:
            try:
                return running[no].processAllAvailable()
            except StreamingQueryException:
                failed[no] = 1 if running[no].lastProgress else failed[no] + 1
                if failed[no] >= tries:
                    raise
                running[no].stop()
                running[no] = starts[no]()

    try:
        for start in starts:
            running.append(start())
        # Batches may be bounded, so what is available is not read in one: go on until the offsets stand still.
        before, now = None, []
        while before != now:
            for no in range(len(running)):
                ended(no)
            time.sleep(pause)
            before, now = now, [(one.lastProgress or {}).get("sources", [{}])[0].get("endOffset") for one in running]
    finally:
        for one in running:
            one.stop()
