"""Reading and writing the operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import COMMON_FIELDS, EVENT_FIELDS, EVENT_KINDS, PAYLOAD, SCHEMAS

#: Times in payloads, to the microsecond.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table with its declared schema."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}.parquet")


def _kinds_with(field: str, needed: bool = False) -> list[str]:
    return [k for k, (need, may) in EVENT_FIELDS.items() if field in need or (not needed and field in (*may, *COMMON_FIELDS))]


def decode_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_type, payload json) rows -> (good rows with typed payload columns, quarantined rows).

    A row is quarantined when its kind is unknown, its payload isn't an object, a value isn't of its field's type or a field is missing that its kind
    must have. Fields that a kind doesn't have are left out.
    """
    ddl = ", ".join(f"{c} {t}" for c, t in PAYLOAD.items())
    # out of an array of one: the tests below are not pushed under the parsing, which would be done anew for each of them
    parsed = raw.withColumn("p", F.explode(F.array(F.from_json("payload", ddl + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "timestampFormat": MICROS}))))
    kind = F.col("event_type")
    complete = F.lit(True)
    for c in PAYLOAD:
        if needs := _kinds_with(c, needed=True):
            complete = complete & (~kind.isin(*needs) | F.col(f"p.{c}").isNotNull())
    ok = F.coalesce(kind.isin(*EVENT_KINDS) & F.col("p").isNotNull() & F.col("p._bad").isNull() & F.trim("payload").startswith("{") & complete, F.lit(False))
    keep = [c for c in raw.columns if c not in (*PAYLOAD, "payload")]
    good = parsed.where(ok).select(*keep, *[F.when(kind.isin(*_kinds_with(c)), F.col(f"p.{c}")).alias(c) for c in PAYLOAD])
    return good, parsed.where(~ok).drop("p")


def encode_events(events: DataFrame) -> DataFrame:
    """Inverse of ``decode_events``: the columns that a row's kind has become one JSON object without null fields."""
    names = [c for c in PAYLOAD if c in events.columns]
    rest = [c for c in events.columns if c not in names]
    own = [F.when(F.col("event_type").isin(*_kinds_with(c)), F.col(c).cast(PAYLOAD[c])).alias(c) for c in names]
    return events.select(*rest, F.to_json(F.struct(*own), {"timestampFormat": MICROS}).alias("payload"))


def write_event_log(events: DataFrame, path: str) -> None:
    """Append events as files by day; nothing is overwritten."""
    day = F.to_date("occurred_at")
    events.withColumn("occurred_date", day).write.mode("append").partitionBy("occurred_date").parquet(path)


def write_bucketed_log(events: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The log as a table in buckets of streams, sorted by version: tails, heads, folds and joins with checkpoints in like buckets read it without a shuffle."""
    events.repartition(buckets, "stream_id").write.mode("overwrite").bucketBy(buckets, "stream_id").sortBy("stream_id", "version").option("path", path).saveAsTable(table)
    return events.sparkSession.table(table)


def upsert_projection(stored: DataFrame, new: DataFrame, key: str = "instance_id", keep: tuple[str, ...] = ("archived_at",)) -> DataFrame:
    """Rows of ``new`` replace stored ones, but the columns ``keep`` of a stored row stay."""
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()

    def pick(c: str):
        if c == key:
            return F.coalesce(f"n.{c}", f"s.{c}").alias(c)
        if c in keep:
            return F.when(is_old, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return both.select(*[pick(c) for c in stored.columns])


def replace_waits(stored: DataFrame, new: DataFrame, instances: DataFrame) -> DataFrame:
    """The waits of upserted instances are replaced by the new set."""
    return stored.join(instances.select("instance_id").distinct(), "instance_id", "left_anti").unionByName(new)


def upsert_checkpoints(checkpoints: DataFrame, order: str = "write_order") -> DataFrame:
    """One checkpoint per instance, that of the latest write."""
    w = Window.partitionBy("instance_id").orderBy(F.col(order).desc())
    return checkpoints.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_history(stored: DataFrame, new: DataFrame, order: str = "recorded_at") -> DataFrame:
    """History rows of new ids are added; a known id is ignored, of equal new ids the first counts."""
    w = Window.partitionBy("history_id").orderBy(order, *[c for c in new.columns if c not in ("history_id", order)])
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return stored.unionByName(first.join(stored.select("history_id"), "history_id", "left_anti").select(stored.columns))


def emit_outbox(published: DataFrame) -> DataFrame:
    """Published messages (outbox_record_id, instance_id, kind, payload) as outbox rows to be dispatched."""
    return published.select("outbox_record_id", "instance_id", "kind", "payload", F.lit("Pending").alias("state"), F.lit(0).alias("dispatch_attempt"), F.lit(None).cast("timestamp").alias("claimed_until"))
