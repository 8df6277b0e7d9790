"""Text, NDJSON and rotated files; fan-out to several sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sawlog.functions.jsonfmt import log_json
from sawlog.functions.text import format_line
from sawlog.functions.times import duration_us


def text_lines(df: DataFrame) -> DataFrame:
    return df.select(format_line(F.col("ts"), F.col("source"), F.col("level"), F.col("message")).alias("value"))


def ndjson_column(df: DataFrame) -> Column:
    fields = F.col("fields") if "fields" in df.columns else F.create_map().cast("map<string,variant>")
    return log_json(F.col("ts"), F.col("level"), F.col("message"), F.col("source"), fields)


def write_text(df: DataFrame, path: str, mode: str = "append") -> None:
    text_lines(df).write.mode(mode).text(path)


def write_console(df: DataFrame) -> None:
    text_lines(df).write.format("console").option("truncate", "false").save()


def write_ndjson(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(ndjson_column(df).alias("value")).write.mode(mode).text(path)


# Files of up to this many bytes are put together in memory, as single records; a task holds no more than HELD_BYTES of them open.
WHOLE_BYTES, HELD_BYTES = 1 << 20, 64 << 20


def _whole(max_bytes: int):
    """Puts the lines of each task and day together to the contents of files, none over ``max_bytes`` but that of a single line."""

    def run(batches):
        held: dict = {}  # day: its size, its lines
        total = 0
        for batch in batches:
            days, values = [], []
            for day, size, value in zip(*(batch.column(c).to_pylist() for c in ("day", "size", "value"))):
                filled, lines = held.get(day, (0, []))
                if filled and filled + size > max_bytes:
                    days.append(day)
                    values.append("\n".join(lines))
                    total -= filled
                    filled, lines = 0, []
                lines.append(value)
                held[day] = (filled + size, lines)
                total += size
            if total > HELD_BYTES:
                days += held
                values += ["\n".join(lines) for _, lines in held.values()]
                held, total = {}, 0
            yield _records(values, days)
        yield _records(["\n".join(lines) for _, lines in held.values()], list(held))

    return run


def _records(values: list, days: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(days, pa.date32())], ["value", "day"])


def _rolled(max_bytes: int):
    """Numbers the files of each task and day, so that no file but one of a single line is over ``max_bytes``."""

    def run(batches):
        sizes: dict = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            names = []
            for day, size in zip(batch.column("day").to_pylist(), batch.column("size").to_pylist()):
                number, held = sizes.get(day, (0, 0))
                if held and held + size > max_bytes:
                    number, held = number + 1, 0
                sizes[day] = (number, held + size)
                names.append(f"{task}-{number}")
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("day"), pa.array(names, pa.string())], ["value", "day", "roll"])

    return run


def write_rotated(
    df: DataFrame, path: str, max_bytes: int = 0, compress: bool = False, max_age: str | int | None = None,
    now: datetime | None = None,
) -> None:
    """Formatted lines in files by day, rolled by size; days past ``max_age`` are dropped afterwards.

    With ``max_bytes`` no file is larger before compression, unless a single line is. Small files (up to ``WHOLE_BYTES``) are many, so each is
    written as one record and lies in the folder of its day; larger ones are in folders ``roll=...`` of it. The lines are computed once.
    """
    dated = df.select(
        format_line(F.col("ts"), F.col("source"), F.col("level"), F.col("message")).alias("value"),
        F.to_date("ts").alias("day"),
    )
    sized = dated.withColumn("size", F.octet_length("value") + 1)
    if 0 < max_bytes <= WHOLE_BYTES:
        records = sized.mapInArrow(_whole(max_bytes), "value string, day date")
        writer = records.write.option("maxRecordsPerFile", 1).partitionBy("day")
    elif max_bytes > 0:
        writer = sized.mapInArrow(_rolled(max_bytes), "value string, day date, roll string").write.partitionBy("day", "roll")
    else:
        writer = dated.write.partitionBy("day")
    writer = writer.mode("append")
    if compress:
        writer = writer.option("compression", "gzip")
    writer.text(path)
    if max_age is not None:
        drop_old_days(df.sparkSession, path, "day", now or datetime.now(timezone.utc), max_age)


def _cutoff(now: datetime, keep: str | int) -> float:
    utc = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    return utc.timestamp() - duration_us(keep) / 1e6


def cutoff_day(now: datetime, keep: str | int) -> str:
    return datetime.fromtimestamp(_cutoff(now, keep), timezone.utc).date().isoformat()


def _day_folders(spark: SparkSession, path: str, column: str):
    """The file system of a table, and its day folders ``(day, folder)``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    named = [(status.getPath().getName(), status.getPath()) for status in found]
    return fs, [(name.split("=", 1)[1], place) for name, place in named if name.startswith(f"{column}=")]


def drop_days(spark: SparkSession, path: str, column: str, days: list[str]) -> None:
    fs, folders = _day_folders(spark, path, column)
    for day, place in folders:
        if day in days:
            fs.delete(place, True)


def drop_old_days(spark: SparkSession, path: str, column: str, now: datetime, keep: str | int) -> list[str]:
    """Delete the day partitions of a table that ended before ``now - keep``; returns the days."""
    fs, folders = _day_folders(spark, path, column)
    cutoff, dropped = _cutoff(now, keep), []
    for day, place in folders:
        try:
            ended = datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp() + 86_400
        except ValueError:
            continue
        if ended <= cutoff:
            fs.delete(place, True)
            dropped.append(day)
    return sorted(dropped)


SWAP, READY = "_swap-", "_ready"


def replace_days(spark: SparkSession, path: str, column: str, rows: DataFrame, days: list[str]) -> None:
    """Put ``rows`` in the place of all that a table by day has on ``days``; a day without rows goes.

    The new days are written aside, in a folder that readers pass over. Once a mark says they are whole, each is switched by renaming. A stop before the
    mark changes nothing, and after it ``finish_swaps`` goes on where it stopped, so no row is lost.
    """
    swap = f"{path}/{SWAP}{uuid.uuid4().hex}"
    rows.write.partitionBy(column).parquet(f"{swap}/new")
    _mark(spark, f"{swap}/{READY}", days)
    finish_swaps(spark, path, column)


def _mark(spark: SparkSession, place: str, days: list[str]) -> None:
    """Writes the mark under another name first, so that it is there whole or not at all."""
    target = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = target.suffix(".draft")
    out = fs.create(draft, True)
    out.write(bytearray("\n".join(days).encode()))
    out.close()
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {place}")


def finish_swaps(spark: SparkSession, path: str, column: str) -> None:
    """Ends replacements of days that were stopped: those marked whole are gone through with, others are dropped."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    root = new_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def moved(source, target) -> None:
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot rename {source} to {target}")

    for status in fs.listStatus(root) if fs.exists(root) else []:
        swap = status.getPath()
        if not swap.getName().startswith(SWAP):
            continue
        mark = new_path(swap, READY)
        if fs.exists(mark):
            reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(mark), "UTF-8"))
            days = [line for line in iter(reader.readLine, None) if line]
            reader.close()
            for day in days:
                name = f"{column}={day}"
                place, new, old = new_path(root, name), new_path(swap, f"new/{name}"), new_path(swap, f"old/{name}")
                # The old day goes aside once only: a day that is in its place beside one that went aside is the new one.
                if fs.exists(place) and not fs.exists(old):
                    moved(place, old)
                if fs.exists(new):
                    moved(new, place)
        fs.delete(swap, True)


def write_all(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Write the same rows to each sink in turn; the first failure stops the rest.

    The rows are kept while this runs, so that they are computed once.
    """
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()
