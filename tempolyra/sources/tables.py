"""Service tables with fixed schemas, and event appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "jobs": _schema(
        id=S, status=S, stage=S, progress=I, original_video_name=S, video_size_bytes=L, video_sha256=S, client_key=S, lyrics_source=S, vocal_mode=S,
        error_code=S, error_message=S, client_submission_id=S, input_mode=S, source_upload_size_bytes=L, source_upload_sha256=S, created_at=TS, updated_at=TS,
    ),
    "upload_tickets": _schema(
        id=S, status=S, client_key=S, video_name=S, video_size_bytes=L, job_id=S, client_submission_id=S, created_at=TS, updated_at=TS, last_seen_at=TS
    ),
    "audit_events": _schema(id=L, action=S, target_type=S, target_id=S, outcome=S, details=S, created_at=TS),
    "event_logs": _schema(
        id=L, level=S, category=S, event=S, message=S, reference_type=S, reference_id=S, run_id=S, stage=S, component=S,
        duration_ms=D, request_id=S, schema_version=I, details=S, created_at=TS,
    ),
}
#: Values of columns that older tables lack.
DEFAULTS = {"jobs": {"input_mode": "VIDEO", "vocal_mode": "on"}, "event_logs": {"schema_version": 1}}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A service table by its fixed schema; columns that files lack read as null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """df with exactly the schema's columns, in order and type; missing ones take their default or null."""
    defaults = defaults or {}
    made = [
        (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return df.select(*made)


def normalised_events(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: level in upper and category in lower case, details as JSON with sorted
    keys (a map column) or as given."""
    rows = events.withColumns({"level": F.upper("level"), "category": F.lower("category")})
    if isinstance(rows.schema["details"].dataType, T.MapType):
        pairs = F.array_sort(F.map_entries(F.coalesce("details", F.create_map().cast("map<string,string>"))))
        rows = rows.withColumn("details", F.to_json(F.map_from_entries(pairs)))
    return rows.withColumn("details", F.coalesce("details", F.lit("{}")))


def append_events(events: DataFrame, path: str) -> None:
    """Appends to the log, partitioned by the date of created_at."""
    normalised_events(events).withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").parquet(path)
