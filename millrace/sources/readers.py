"""Sources: batch readers, their streaming twins, parsers of packed records, generators.

Streams read the same formats with ``maxFilesPerTrigger`` as admission control. Event
time comes from the data, or from ``epoch_times`` where a replay assigns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.text import int_or_zero, ip_pair


def lines(spark: SparkSession, path: str, stream: bool = False, files: int = 16) -> DataFrame:
    """(value): a record a line."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path) if stream else spark.read.text(path)


def numbers(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(value long): a number a line; other lines go."""
    return lines(spark, path, stream).select(F.col("value").try_cast("long").alias("value")).where("value IS NOT NULL")


def tweets(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(text) of JSON lines; objects without it go."""
    return json_text(lines(spark, path, stream))


def json_text(df: DataFrame, column: str = "value", field: str = "text", kind: str = "string") -> DataFrame:
    """A field of JSON objects in place of them; objects without it, or with one that isn't of the kind, go. Other columns stay."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.get_json_object(column, f"$.{field}").try_cast(kind).alias(field)).where(F.col(field).isNotNull())


def byte_ranges(df: DataFrame, size: int, column: str = "value") -> DataFrame:
    """(..., i, data): texts cut into ranges of ``size`` characters, numbered from 0, not at words; a shorter rest goes. Other columns stay."""
    others = [c for c in df.columns if c != column]
    n = F.floor(F.length(column) / F.lit(size)).cast("int")
    cut = df.where(n > 0).select(*others, column, F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return cut.select(*others, F.col("i").cast("long").alias("i"), F.substring(F.col(column), F.col("i") * size + 1, F.lit(size)).alias("data"))


def fixed_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(value binary): fixed-length records of binary files, read split by split."""
    rows = spark.sparkContext.binaryRecords(path, size).map(lambda b: (bytearray(b),))
    return spark.createDataFrame(rows, "value binary")


def _le(value: Column, at: int, n: int = 8) -> Column:
    """Little-endian signed integer at a byte offset."""
    h = F.hex(F.substring(value, at + 1, n))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(2 * n - 1, 0, -2)]), 16, -10).cast("long")


def _unsigned(value: Column, at: int) -> Column:
    """Little-endian unsigned integer of 4 bytes."""
    return _le(F.concat(F.substring(value, at + 1, 4), F.unhex(F.lit("00000000"))), 0)


def _text(value: Column, at: int, n: int) -> Column:
    return F.regexp_extract(F.decode(F.substring(value, at + 1, n), "ISO-8859-1"), "^[^\\x00]*", 0)


def _double(value: Column, at: int) -> Column:
    """IEEE double at a byte offset, built from its bits."""
    bits = _le(value, at)
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    size = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((fraction + 1.0) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(bits < 0, -size).otherwise(size)


def ad_events(df: DataFrame) -> DataFrame:
    """78-byte packed advertisement events."""
    v = F.col("value")
    return df.select(F.substring(v, 1, 16).alias("user_id"), F.substring(v, 17, 16).alias("page_id"), F.substring(v, 33, 16).alias("campaign_id"), _text(v, 48, 9).alias("ad_type"), _text(v, 57, 9).alias("event_type"), F.timestamp_millis(_le(v, 66)).alias("ts"), _unsigned(v, 74).alias("ip"))


def ad_texts(df: DataFrame) -> DataFrame:
    """136-byte packed advertisement events with ids as text, in the columns of ``ad_csv`` that they have."""
    v = F.col("value")
    out = df.select(*[_text(v, a, n).alias(c) for c, a, n in (("user_id", 0, 36), ("page_id", 36, 36), ("ad_id", 72, 36), ("ad_type", 108, 16), ("event_type", 124, 8))], _unsigned(v, 132).alias("ip"))
    return out.withColumn("num_event_type", F.when(F.col("event_type") == "view", 2).otherwise(0))


def bids(df: DataFrame) -> DataFrame:
    """32-byte packed bids."""
    v = F.col("value")
    return df.select(*[_le(v, 8 * i).alias(n) for i, n in enumerate(schemas.BID.names)])


def trips(df: DataFrame) -> DataFrame:
    """145-byte packed taxi trips."""
    v = F.col("value")
    cols = [_text(v, 0, 30), _text(v, 30, 30), _text(v, 60, 4), _le(v, 64), F.timestamp_seconds(_le(v, 72)), F.timestamp_seconds(_le(v, 80)), _le(v, 88), _le(v, 96), *[_double(v, a) for a in (104, 112, 120, 128, 136)], _le(v, 144, 1).cast("tinyint")]
    return df.select(*[c.alias(n) for c, n in zip(cols, schemas.TRIP.names)])


def round_trips(df: DataFrame) -> DataFrame:
    """40-byte samples: 32 bytes of ``ip-ip`` and a round-trip time, as (key, rtt)."""
    v = F.col("value")
    return df.select(ip_pair(_text(v, 0, 32)).alias("key"), _le(v, 32).alias("rtt"))


def ad_csv(df: DataFrame, column: str = "value") -> DataFrame:
    """Advertisement events of 7-field CSV lines; ids without dashes; num_event_type 2 for views, else 0."""
    parts = F.split(column, ",")
    cols = [F.translate(parts[i], "-", "") if n.endswith("_id") else parts[i] for i, n in enumerate(schemas.AD_CSV.names)]
    out = df.select(*[c.alias(n) for c, n in zip(cols, schemas.AD_CSV.names)])
    return out.withColumn("num_event_type", F.when(F.col("event_type") == "view", 2).otherwise(0))


def vehicle_reports(df: DataFrame, column: str = "value") -> DataFrame:
    """Linear Road lines of 15 integers; missing or unreadable ones are 0."""
    parts = F.split(column, ",")
    return df.select(*[int_or_zero(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))).alias(n) for i, n in enumerate(schemas.VEHICLE_FIELDS)])


def replicated(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """One stream as two of (key, value, ts), the value telling the side."""
    side = lambda n: df.select(F.col(value).alias("key"), F.lit(n).cast("long").alias("value"), "ts")
    return side(0), side(1)


def epoch_times(df: DataFrame, index: str, per_epoch: int, bundles: int, interval_ms: int, start: str, gap_ms: int = 0) -> DataFrame:
    """Adds ``ts`` as a replay assigns it: rows of a bundle share a time, epochs are an interval and a gap apart."""
    i = F.col(index)
    epoch, bundle = F.floor(i / per_epoch), F.floor((i % per_epoch) * bundles / per_epoch)
    ms = epoch * (interval_ms + gap_ms) + F.floor(bundle * interval_ms / bundles)
    return df.withColumn("ts", F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + ms.cast("long")))


def counter(spark: SparkSession, n: int, per_bundle: int = 1024, start: str = "2002-01-10", session_gap_ms: int = 0) -> DataFrame:
    """(value, ts): a counter, each bundle sharing a time."""
    return epoch_times(spark.range(n).withColumnRenamed("id", "value"), "value", per_bundle, 1, 1000, start, session_gap_ms)


def replayed(spark: SparkSession, path: str, schema: str, times: int, files: int = 16) -> DataFrame:
    """A folder of Parquet as a stream, ``times`` over: each pass is a source of its own, and ``pass`` tells it."""
    one = lambda i: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("pass", F.lit(i))
    out = one(0)
    for i in range(1, times):
        out = out.unionByName(one(i))
    return out


def rate(spark: SparkSession, per_batch: int) -> DataFrame:
    """(timestamp, value): an unbounded counter for load tests."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()


def generated_ads(spark: SparkSession, n: int, campaigns: int = 100, start: str = "2024-01-01") -> DataFrame:
    """Generated advertisement events: three event types in turn, campaigns by hash, shuffled by time."""
    i = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "purchase")]), (i % 3 + 1).cast("int"))
    ms = F.unix_millis(F.lit(start).cast("timestamp")) + F.pmod(F.xxhash64("id"), F.lit(n))
    return spark.range(n).select(F.pmod(F.xxhash64(i + 1), F.lit(campaigns)).alias("campaign_id"), F.lit("banner78").alias("ad_type"), kind.alias("event_type"), F.timestamp_millis(ms).alias("ts"), F.lit(0x01020304).cast("long").alias("ip"))


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A Parquet table; zone-less times become UTC times, as watermarks need them."""
    path = f"{sf_dir}/{name}.parquet"
    # A stream takes a pattern, which may stand for a folder or for one file.
    df = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*") if stream else spark.read.parquet(path)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])
