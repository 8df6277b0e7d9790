"""Record layouts shared by sources, operators and sinks."""

from pyspark.sql import DataFrame, functions as F, types as T

# Fixed limits of the record format.
MAX_LINE_BYTES = 256 * 1024
MAX_FIELDS = 100

FIELDS_TYPE = "map<string,variant>"

ALERT_EVENT_COLUMNS = [
    "id", "rule_name", "severity", "message", "source", "count", "fired_at", "acknowledged_at",
]

RULE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("threshold", T.LongType()),
    T.StructField("window_us", T.LongType()),
    T.StructField("cooldown_us", T.LongType()),
])


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column_or_null(df: DataFrame, name: str, dtype: str):
    """The column if the frame has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
