"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and rates over generated input: one JSON line.

queries: seconds of each query, after one run of it to warm up. rates: thousands (1,024) of records a second over
generated or repeated input of about $BENCH_ROWS records, generation included, after a small run to warm up.
first_result_ms: from a stream's start to its first window at the sink.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))

HEADLINE = ["ysb", "ysb_countbased", "ysb_lookup", "wordcount", "tokenize_wordcount", "grep_regex", "windowed_grep", "windowed_grep_literal", "distinct_lines", "interval_join", "netmon_rtt_sum", "tweet_sentiment", "sliding_sum", "session_window", "nyt_region_sum", "nexmark_q3", "lr_tolls", "lr_pipeline"]


def rates(spark, sf: str, rows: int) -> dict:
    """By pipeline, K records a second."""
    from pyspark.sql import functions as F

    from millrace.functions import text as T
    from millrace.operators import aggregates as A
    from millrace.operators import joins as J
    from millrace.sources import readers as S

    words = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    start = F.lit("2024-01-01").cast("timestamp")

    def timed(n):  # so many records, a million a second of event time
        return spark.range(n).withColumn("ts", F.timestamp_micros(F.unix_micros(start) + F.col("id")))

    def records(n, size):  # records of so many characters, repeated until about n
        cut = S.byte_ranges(words.select("doc_id", "text"), size, "text").cache()
        have = cut.count()
        again = cut.select(F.explode(F.sequence(F.lit(1), F.lit(max(1, n // have)))).alias("k"), "doc_id", "data")
        return again.withColumn("ts", F.timestamp_seconds(F.unix_seconds(start) + F.col("doc_id") % 60)), have * max(1, n // have)

    def ysb(n):
        ads = S.generated_ads(spark, n).where("event_type = 'view'")
        return A.keyed(ads, "1 second", ["campaign_id"], n=F.count("*")), n

    def wordcount(n):
        rows_, m = records(n // 20, 100)
        return A.keyed(rows_.select("ts", F.explode(T.words("data")).alias("word")), "1 second", ["word"], n=F.count("*")), m

    def windowed_grep(n):
        rows_, m = records(n // 40, 1000)
        return A.keyed(rows_.select("ts", F.explode(T.literal_found("data", "http://")).alias("found")), "1 second", ["found"], n=F.count("*")), m

    def distinct(n):
        rows_, m = records(n // 20, 100)
        return A.windowed(rows_, "1 second", n=F.countDistinct("data")), m

    def network_latency(n):
        rows_ = timed(n).select("ts", (F.xxhash64(F.col("id") % 1000)).alias("pair"), (F.col("id") % 977).alias("rtt"))
        return A.keyed(rows_, "1 second", ["pair"], total=F.sum("rtt")), n

    def interval_join(n):
        side = lambda salt: timed(n // 2).select(F.xxhash64("id", F.lit(salt)).alias("key"), F.col("id").alias("value"), "ts")
        return J.interval_join(side(1), side(1), "1 second"), n // 2 * 2

    def tweet_sentiment(n):
        rows_, m = records(n // 40, 200)
        lexicon = spark.createDataFrame([("the", 1), ("and", 2), ("was", -2), ("der", 3)], "word string, score int")
        return A.sliding_sum(T.token_scores(rows_.select("ts", "data"), "data", lexicon), "score", 2, "1 second"), m

    out = {}
    for f, share in ((ysb, 1), (wordcount, 1), (windowed_grep, 1), (distinct, 1), (network_latency, 1), (interval_join, 0.2), (tweet_sentiment, 1)):
        took = []
        for n in (rows // 50, rows):
            df, m = f(int(n * share))
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(m / 1024 / (time.time() - began))
        out[f.__name__] = round(took[-1], 1)
        spark.catalog.clearCache()
    return out


def latency(spark, sf: str) -> float:
    from pyspark.sql import functions as F

    from millrace.operators import aggregates as A
    from millrace.sources import readers as S
    from millrace.streaming import run

    views = run.watermarked(S.table(spark, sf, "events", stream=True)).where("event_type = 'view'")
    counts = A.keyed(views, "1 hour", [(F.col("user_id") % 10).alias("campaign")], n=F.count("*"))
    return min(run.first_result_ms(counts, tempfile.mkdtemp(prefix="bench-")) for _ in range(3))


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace.plans.catalogue import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        run(name)
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    more = {"rates": rates(spark, sf, int(os.environ.get("BENCH_ROWS", "20000000"))), "rates_unit": "K records/s", "first_result_ms": round(latency(spark, sf))}
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))} | more))
    spark.stop()


if __name__ == "__main__":
    main()
