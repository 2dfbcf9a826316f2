"""Registered queries: every operator and benchmark pipeline on the test tables, with DuckDB SQL beside it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import joins as J
from millrace.operators import road as R
from millrace.operators import user as U
from millrace.operators import windows as W
from millrace.sources import readers as S
from millrace.storage import scratch
from millrace.streaming import run as G

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Times leave without a zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events")


# ------------------------------------------------------------------ projections and filters


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey >= 1000")
def select_ge(spark, d):
    return S.table(spark, d, "lineitem").where("l_partkey >= 1000").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def filter_eq(spark, d):
    return _events(spark, d).where("event_type = 'view'").select("event_id", "user_id")


_AUCTIONS = (1007, 1201, 1319, 1487, 2001, 2019, 2087)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN {_AUCTIONS}")
def filter_in(spark, d):
    return S.table(spark, d, "lineitem").where(F.col("l_partkey").isin(*_AUCTIONS)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id FROM events WHERE event_type = 'signup'")
def filter_ad_type(spark, d):
    return _events(spark, d).where("event_type = 'signup'").select("event_id")


_REGION = "((l_partkey + 750) * 100 + 12345 * (l_suppkey + 1400) * 100) % 100 + (l_partkey * 31 + l_suppkey * 17) % 100"


@query(f"SELECT CAST({_REGION} AS BIGINT) AS region, CAST(trunc(l_quantity) AS BIGINT) AS distance FROM lineitem WHERE l_quantity > 5.0 AND l_returnflag LIKE 'R%'")
def filter_region_project(spark, d):
    rows = S.table(spark, d, "lineitem").where("l_quantity > 5.0 AND l_returnflag LIKE 'R%'")
    return rows.select(F.expr(_REGION).cast("long").alias("region"), F.col("l_quantity").cast("long").alias("distance"))


@query("SELECT user_id AS key, CAST(1 AS BIGINT) AS value FROM events")
def map_kv(spark, d):
    return U.map_columns(_events(spark, d), key=F.col("user_id"), value=F.lit(1).cast("long"))


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(f"SELECT l_partkey AS auction, {_CENTS} * 89 // 100 AS price FROM lineitem")
def nexmark_q1(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("auction"), F.expr(f"{_CENTS} * 89 div 100").alias("price"))


@query("SELECT event_id, CAST(trunc(value * 100) AS BIGINT) * 89 // 100 AS price FROM events")
def currency_project(spark, d):
    return _events(spark, d).select("event_id", F.expr("cast(value * 100 as bigint) * 89 div 100").alias("price"))


@query(f"SELECT l_partkey AS auction, {_CENTS} * 89 // 100 AS price FROM lineitem WHERE l_partkey IN {_AUCTIONS}")
def nexmark_q2(spark, d):
    rows = S.table(spark, d, "lineitem").where(F.col("l_partkey").isin(*_AUCTIONS))
    return rows.select(F.col("l_partkey").alias("auction"), F.expr(f"{_CENTS} * 89 div 100").alias("price"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract(spark, d):
    return S.json_text(_events(spark, d).select("event_id", "props"), "props", "k", "long")


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def tweet_text(spark, d):
    rows = S.table(spark, d, "conversations")
    lines = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("value"))
    return S.json_text(lines)


@query("SELECT CAST(0 AS INTEGER) AS type, CAST(l_orderkey AS INTEGER) AS time, CAST(l_partkey AS INTEGER) AS vid, CAST(l_linenumber AS INTEGER) AS speed, 0 AS qid FROM lineitem")
def csv_parse(spark, d):
    lines = S.table(spark, d, "lineitem").select(F.concat_ws(",", F.lit("0"), "l_orderkey", "l_partkey", "l_linenumber", F.lit("x")).alias("value"))
    return S.vehicle_reports(lines).select("type", "time", "vid", "speed", "qid")


@query("SELECT o_orderkey, o_custkey, c_mktsegment AS campaign FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, d):
    table = S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("campaign"))
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.lookup_join(rows, table, "o_custkey")


_IP = "(user_id % 256) || '.' || (event_id % 256) || '.7.1-' || (event_id // 256 % 256) || '.0.9.' || (user_id % 100)"
_PACKED = "(user_id % 256) + (event_id % 256) * 256 + 7 * 65536 + 16777216 + (event_id // 256 % 256) * 4294967296 + 9 * 281474976710656 + (user_id % 100) * 72057594037927936"


def _rtt(spark, d):
    rows = _events(spark, d)
    ends = F.concat_ws("-", F.concat_ws(".", F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7"), F.lit("1")), F.concat_ws(".", F.expr("event_id div 256 % 256"), F.lit("0"), F.lit("9"), F.col("user_id") % 100))
    return rows.select("event_id", "ts", T.ip_pair(ends).alias("pair"), (F.col("event_id") % 1000).alias("rtt"))


@query(f"SELECT event_id, CAST({_PACKED} AS BIGINT) AS pair FROM events")
def ip_pack(spark, d):
    return _rtt(spark, d).select("event_id", "pair")


@query("SELECT event_id + 1 AS event_id, value * 2 AS value FROM events")
def pardo_plus1(spark, d):
    class Plus(U.BatchFn):
        def process(self, batch: pd.DataFrame) -> pd.DataFrame:
            return batch.assign(event_id=batch.event_id + 1, value=batch.value * 2)

    return U.par_do(_events(spark, d).select("event_id", "value"), Plus(), "event_id long, value double")


@query("SELECT event_id, user_id + 1 AS user_id FROM events WHERE value IS NOT NULL AND event_type <> 'error'")
def update_cols(spark, d):
    rows = _events(spark, d)
    return U.update_columns(rows, where=F.col("value").isNotNull() & (F.col("event_type") != "error"), user_id=F.col("user_id") + 1).select("event_id", "user_id")


@query("SELECT 'left' AS side, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'right', event_id FROM events WHERE event_type = 'view'")
def split_fanout(spark, d):
    side = lambda name, kind: lambda e: e.where(F.col("event_type") == kind).select(F.lit(name).alias("side"), "event_id")
    a, b = U.split(_events(spark, d), side("left", "click"), side("right", "view"))
    return a.unionByName(b)


# ------------------------------------------------------------------ text


@query("SELECT word, count(*) AS n FROM (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*'))) AS word FROM documents) GROUP BY word")
def tokenize_wordcount(spark, d):
    return S.table(spark, d, "documents").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_INNER = "SELECT doc_id, unnest([x for x in s[2:len(s) - 1] if x <> '']) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) WHERE len(s) > 2"


@query(_INNER)
def split_lines(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(T.inner_lines("text")).alias("line"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}')) AS match FROM documents")
def grep_regex(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(T.matches("text", "[0-9]{4}")).alias("match"))


@query("SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '([0-9]{2})([0-9]{2})', 0), list_concat(regexp_extract_all(text, '([0-9]{2})([0-9]{2})', 1), regexp_extract_all(text, '([0-9]{2})([0-9]{2})', 2)))) AS match FROM documents")
def grep_groups(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(T.matches("text", "([0-9]{2})([0-9]{2})", 2)).alias("match"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n FROM documents WHERE contains(text, 'the')")
def grep_literal(spark, d):
    return S.table(spark, d, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", T.literal_matches("text", "the").alias("n"))


@query("SELECT doc_id, i, substr(text, i * 100 + 1, 100) AS data FROM (SELECT doc_id, text, unnest(range(0, length(text) // 100)) AS i FROM documents)")
def byte_ranges(spark, d):
    return S.byte_ranges(S.table(spark, d, "documents").select("doc_id", "text"), 100, "text")


@query("SELECT doc_id, unnest(['the' for x in range(0, (length(text) - length(replace(text, 'the', ''))) // 3)]) AS match FROM documents")
def grep_literal_records(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.explode(T.literal_found("text", "the")).alias("match"))


LEXICON = {"the": 1, "and": 2, "is": -1, "was": -2, "der": 3, "les": -3, "never met": 9}
_SCORE = "CAST(list_sum([CASE w " + " ".join(f"WHEN '{w}' THEN {s}" for w, s in LEXICON.items()) + " ELSE 0 END for w in regexp_split_to_array(coalesce(text, ''), '[ \\t]')]) AS BIGINT)"
_TS = "TIMESTAMP '2024-01-01' + to_seconds(doc_id % 3600)"


def _timed(spark, d):
    ts = F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, 0, doc_id % 3600)")
    return S.table(spark, d, "documents").select("doc_id", ts.alias("ts"), "text")


def _scored(spark, d):
    """Tokens with their scores: what is summed over them is summed over the documents."""
    lines = spark.createDataFrame([(f"{w}\t{s}",) for w, s in LEXICON.items()], "value string")
    return T.token_scores(_timed(spark, d).drop("doc_id"), "text", T.lexicon_lines(lines))


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents")
def lexicon_score(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.score(F.coalesce("text", F.lit("")), LEXICON).alias("score"))


@query("SELECT start, word, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 second', TIMESTAMP '2024-01-01' + to_seconds(doc_id % 3600), TIMESTAMP '1970-01-01') AS start, upper(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']*'))) AS word FROM documents) GROUP BY ALL")
def wordcount(spark, d):
    rows = _timed(spark, d).select("ts", F.explode(T.words("text")).alias("word"))
    return A.keyed(rows, "1 second", ["word"], n=F.count("*")).drop("end")


# ------------------------------------------------------------------ windows and aggregates


def _bucket(size: str, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{size}', {ts}, TIMESTAMP '1970-01-01')"


_HOUR = _bucket("1 hour")


@query(f"SELECT {_HOUR} AS start, {_HOUR} + INTERVAL '1 hour' AS \"end\", user_id % 10 AS key, count(*) AS n FROM events GROUP BY ALL")
def tumbling_count(spark, d):
    return A.keyed(_events(spark, d), "1 hour", [(F.col("user_id") % 10).alias("key")], n=F.count("*"))


@query(f"SELECT {_HOUR} AS start, {_HOUR} + INTERVAL '1 hour' AS \"end\", CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def tumbling_sum(spark, d):
    return A.windowed(_events(spark, d), "1 hour", total=F.sum("user_id"))


@query(f"SELECT {_bucket('1 hour', 'ts - INTERVAL 15 MINUTE')} + INTERVAL 15 MINUTE AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_origin(spark, d):
    w = W.fixed("ts", "1 hour", "15 minutes")
    return _events(spark, d).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""WITH a AS (SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS start, sum(user_id) AS total FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(start) FROM a), (SELECT max(start) FROM a), INTERVAL '5 minutes')) AS start)
SELECT start, start + INTERVAL '5 minutes' AS "end", CAST(coalesce(total, 0) AS BIGINT) AS total FROM g LEFT JOIN a USING (start)""")
def tumbling_sum_dense(spark, d):
    return A.dense(A.windowed(_events(spark, d), "5 minutes", total=F.sum("user_id")), "5 minutes", total=0)


@query(f"""SELECT start, start + INTERVAL '2 hours' AS "end", CAST(sum(user_id) AS BIGINT) AS total
FROM (SELECT user_id, unnest([{_HOUR}, {_HOUR} - INTERVAL '1 hour']) AS start FROM events) GROUP BY start""")
def sliding_sum(spark, d):
    return A.sliding_sum(_events(spark, d), "user_id", 2, "1 hour").select("start", "end", "total")


@query(f"SELECT epoch_us({_HOUR} + INTERVAL '1 hour') AS key, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def tvpair(spark, d):
    agg = A.windowed(_events(spark, d), "1 hour", total=F.sum("user_id"))
    return agg.select(A.end_micros().alias("key"), "total")


@query(f"SELECT epoch_us({_HOUR} + INTERVAL '1 hour') AS key, count(*) AS total FROM events GROUP BY {_HOUR}, event_type")
def tvpair_counts(spark, d):
    agg = A.keyed(_events(spark, d), "1 hour", ["event_type"], total=F.count("*"))
    return agg.select(A.end_micros().alias("key"), "total")


@query(f"SELECT {_bucket('1 day')} AS start, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def window_distinct(spark, d):
    return A.windowed(_events(spark, d), "1 day", n=F.countDistinct("user_id")).select("start", "n")


@query(f"SELECT {_bucket('1 day')} AS start, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1")
def window_distinct_set(spark, d):
    return A.windowed(_events(spark, d), "1 day", kinds=A.distinct_values("event_type")).select("start", "kinds")


@query(f"SELECT {_HOUR} AS start, list_sort(list(event_type)) AS kinds FROM events GROUP BY 1")
def window_bag(spark, d):
    return A.windowed(_events(spark, d), "1 hour", kinds=A.bag("event_type")).select("start", "kinds")


@query(f"""SELECT start, user_id, n, CAST(rank AS INTEGER) AS rank FROM (
SELECT start, user_id, n, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id) AS rank
FROM (SELECT {_bucket('1 day')} AS start, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 10""")
def topk_per_window(spark, d):
    agg = A.keyed(_events(spark, d), "1 day", ["user_id"], n=F.count("*"))
    return W.top_k(agg, 10, "start", "n", "user_id").select("start", "user_id", "n", "rank")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '1 hour' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS id FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1 hour' AS "end", count(*) AS n FROM s GROUP BY user_id, id""")
def session_window(spark, d):
    out = _events(spark, d).groupBy("user_id", W.session("ts", 3600).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", *W.session_bounds("w"), "n")


_COUNTED = "SELECT CAST(floor({rank} / 100) AS BIGINT) AS win_id, event_type, count(*) AS n FROM (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL"


@query(_COUNTED.format(rank="(rn - 1)"))
def count_window(spark, d):
    return W.count_windows(_events(spark, d), 100, ["ts", "event_id"]).groupBy("win_id", "event_type").agg(F.count("*").alias("n"))


@query(_COUNTED.format(rank="rn"))
def count_window_compat(spark, d):
    return W.count_windows(_events(spark, d), 100, ["ts", "event_id"], compat=True).groupBy("win_id", "event_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ joins


def _sides(spark, d):
    side = lambda kind: _events(spark, d).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), "ts")
    return side("view"), side("click")


_INTERVAL = """SELECT a.user_id AS key, a.event_id AS left_value, b.event_id AS right_value, a.ts AS left_ts, b.ts AS right_ts
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
AND b.ts >= a.ts - INTERVAL '2 hours' AND b.ts < a.ts + INTERVAL '2 hours'"""


@query(_INTERVAL)
def interval_join(spark, d):
    return J.interval_join(*_sides(spark, d), "2 hours")


@query("""SELECT a.user_id AS key, [0, 1] AS "values", b.ts AS ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL '1 hour' AND b.ts < a.ts + INTERVAL '1 hour'""")
def replicated_join(spark, d):
    return J.pair(J.interval_join(*S.replicated(_events(spark, d).select("user_id", "ts"), "user_id"), "1 hour"))


@query(_INTERVAL + " QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) = 1")
def interval_join_first(spark, d):
    return J.interval_join(*_sides(spark, d), "2 hours", first_match=True)


@query(f"SELECT key, [left_value, right_value] AS \"values\", right_ts AS ts FROM ({_INTERVAL})")
def join_pairs(spark, d):
    return J.pair(J.interval_join(*_sides(spark, d), "2 hours"))


_TWEET = f"""SELECT start + INTERVAL '120 seconds' AS "end", CAST(sum(score) AS BIGINT) AS total FROM
(SELECT {_SCORE} AS score, unnest([time_bucket(INTERVAL '60 seconds', {_TS}, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '60 seconds', {_TS}, TIMESTAMP '1970-01-01') - INTERVAL '60 seconds']) AS start FROM documents) GROUP BY start"""


@query(_TWEET)
def tweet_sentiment(spark, d):
    return A.sliding_sum(_scored(spark, d), "score", 2, "60 seconds").select("end", "total")


@query(f"SELECT epoch_us(a.\"end\") AS key, a.total AS left_total, b.total AS right_total FROM ({_TWEET}) a JOIN ({_TWEET}) b ON a.\"end\" = b.\"end\"")
def two_stream_window_join(spark, d):
    side = lambda name: A.sliding_sum(_scored(spark, d), "score", 2, "60 seconds").select(A.end_micros().alias("key"), F.col("total").alias(name))
    return side("left_total").join(side("right_total"), "key")


# ------------------------------------------------------------------ benchmark pipelines

_YSB = f"SELECT {_HOUR} AS start, {_HOUR} + INTERVAL '1 hour' AS \"end\", user_id % 10 AS campaign, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL"


@query(_YSB)
def ysb(spark, d):
    views = _events(spark, d).where("event_type = 'view'").select("ts", (F.col("user_id") % 10).alias("campaign"))
    return A.keyed(views, "1 hour", ["campaign"], n=F.count("*"))


@query("SELECT CAST((rn - 1) // 100 AS BIGINT) AS win_id, campaign, count(*) AS n FROM (SELECT user_id % 10 AS campaign, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view') GROUP BY ALL")
def ysb_countbased(spark, d):
    views = _events(spark, d).where("event_type = 'view'").select("ts", "event_id", (F.col("user_id") % 10).alias("campaign"))
    return W.count_windows(views, 100, ["ts", "event_id"]).groupBy("win_id", "campaign").agg(F.count("*").alias("n"))


@query(f"SELECT {_HOUR} AS start, c_mktsegment AS campaign, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY ALL")
def ysb_lookup(spark, d):
    table = S.table(spark, d, "customer").select(F.col("c_custkey").alias("ad_id"), F.col("c_mktsegment").alias("campaign"))
    views = _events(spark, d).where("event_type = 'view'").select("ts", F.col("user_id").alias("ad_id"))
    return A.keyed(J.lookup_join(views, table, "ad_id"), "1 hour", ["campaign"], n=F.count("*")).drop("end")


_TRIPS = f"(SELECT l_shipdate AS ts, CAST({_REGION} AS BIGINT) AS region, CAST(trunc(l_quantity) AS BIGINT) AS distance FROM lineitem WHERE l_quantity > 5.0 AND l_returnflag LIKE 'R%')"


def _trips(spark, d):
    rows = S.table(spark, d, "lineitem").where("l_quantity > 5.0 AND l_returnflag LIKE 'R%'")
    return rows.select(F.col("l_shipdate").alias("ts"), F.expr(_REGION).cast("long").alias("region"), F.col("l_quantity").cast("long").alias("distance"))


@query(f"SELECT {_bucket('7 days')} AS start, region, CAST(sum(distance) AS BIGINT) AS total FROM {_TRIPS} GROUP BY ALL")
def nyt_region_sum(spark, d):
    return A.keyed(_trips(spark, d), "7 days", ["region"], total=F.sum("distance")).drop("end")


@query(f"SELECT {_bucket('7 days')} AS start, region, count(*) AS trips, round(sum(distance) / count(*), 6) AS mean_distance FROM {_TRIPS} GROUP BY ALL")
def nyt_trips_avg(spark, d):
    return A.keyed(_trips(spark, d), "7 days", ["region"], trips=F.count("*"), mean_distance=F.round(F.sum("distance") / F.count("*"), 6)).drop("end")


@query(f"SELECT CAST((rn - 1) // 1000 AS BIGINT) AS win_id, CAST(sum(d) AS BIGINT) AS total FROM (SELECT CAST(trunc(l_quantity) AS BIGINT) AS d, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_quantity > 5.0 AND l_returnflag LIKE 'R%') GROUP BY 1")
def nyt_countbased(spark, d):
    rows = S.table(spark, d, "lineitem").where("l_quantity > 5.0 AND l_returnflag LIKE 'R%'").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("d"))
    # Lines share order and number, so the distance decides among them: rows alike in all three give the same totals in any order.
    return W.count_windows(rows, 1000, ["l_orderkey", "l_linenumber", "d"]).groupBy("win_id").agg(F.sum("d").alias("total"))


_BIDS = f"(SELECT {_bucket('7 days', 'l_shipdate')} AS start, l_partkey AS auction, {_CENTS} AS price FROM lineitem)"


def _bids(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("auction"), F.expr(_CENTS).alias("price"))


@query(f"SELECT start, CAST(max(n) AS BIGINT) AS most FROM (SELECT start, auction, count(*) AS n FROM {_BIDS} GROUP BY ALL) GROUP BY start")
def nexmark_q3(spark, d):
    counts = A.keyed(_bids(spark, d), "7 days", ["auction"], n=F.count("*"))
    return counts.groupBy("start").agg(F.max("n").alias("most"))


@query(f"SELECT start, max(price) AS price FROM {_BIDS} GROUP BY start")
def nexmark_q4(spark, d):
    return A.windowed(_bids(spark, d), "7 days", price=F.max("price")).drop("end")


@query(f"SELECT start, auction, count(*) AS n FROM {_BIDS} WHERE auction IN {_AUCTIONS} GROUP BY ALL")
def nexmark_input(spark, d):
    return A.keyed(_bids(spark, d).where(F.col("auction").isin(*_AUCTIONS)), "7 days", ["auction"], n=F.count("*")).drop("end")


@query(f"""SELECT time_bucket(INTERVAL '28 days', start, TIMESTAMP '1970-01-01') AS start, auction, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT start + INTERVAL '7 days' - INTERVAL '1 microsecond' AS start, auction, count(*) AS n FROM {_BIDS} WHERE auction IN {_AUCTIONS} GROUP BY ALL) GROUP BY ALL""")
def nexmark_input_sums(spark, d):
    counts = A.keyed(_bids(spark, d).where(F.col("auction").isin(*_AUCTIONS)), "7 days", ["auction"], keep_window=True, n=F.count("*"))
    return A.keyed(counts.select(F.window_time("window").alias("at"), "auction", "n"), "28 days", ["auction"], "at", n=F.sum("n")).drop("end")


@query(f"SELECT {_HOUR} AS start, CAST({_PACKED} AS BIGINT) AS pair, CAST(sum(event_id % 1000) AS BIGINT) AS total FROM events GROUP BY ALL")
def netmon_rtt_sum(spark, d):
    return A.keyed(_rtt(spark, d), "1 hour", ["pair"], total=F.sum("rtt")).drop("end")


_MINUTE = f"time_bucket(INTERVAL '60 seconds', {_TS}, TIMESTAMP '1970-01-01')"


@query(f"SELECT start, list_sort(list(m)) AS found FROM (SELECT {_MINUTE} AS start, unnest(regexp_extract_all(text, '[0-9]{{4}}')) AS m FROM documents) GROUP BY start")
def windowed_grep(spark, d):
    rows = _timed(spark, d).select("ts", F.explode(T.matches("text", "[0-9]{4}")).alias("m"))
    return A.windowed(rows, "60 seconds", found=A.bag("m")).drop("end")


@query(f"SELECT start, list_sort(list(m)) AS found FROM (SELECT {_MINUTE} AS start, unnest(['http://' for x in range(0, (length(text) - length(replace(text, 'http://', ''))) // 7)]) AS m FROM documents) GROUP BY start")
def windowed_grep_literal(spark, d):
    rows = _timed(spark, d).select("ts", F.explode(T.literal_found("text", "http://")).alias("m"))
    return A.windowed(rows, "60 seconds", found=A.bag("m")).drop("end")


@query(f"SELECT start, count(DISTINCT line) AS n FROM (SELECT time_bucket(INTERVAL '60 seconds', {_TS}, TIMESTAMP '1970-01-01') AS start, line FROM ({_INNER})) GROUP BY start")
def distinct_lines(spark, d):
    rows = _timed(spark, d).select("ts", F.explode(T.inner_lines("text")).alias("line"))
    return A.windowed(rows, "60 seconds", n=F.countDistinct("line")).drop("end")


# Vehicles: user_id; a report an event; they stand still for runs of events.
_VEHICLE = "user_id AS vid, event_id AS time, CASE WHEN (event_id // 1500 + user_id) % 3 = 0 THEN 0 ELSE 30 + event_id % 40 END AS speed, CASE WHEN (event_id // 1500 + user_id) % 3 = 0 THEN (user_id // 15) * 5280 ELSE event_id * 37 % 528000 END AS pos"


def _reports(spark, d):
    return _events(spark, d).selectExpr(*[x.strip() for x in _VEHICLE.replace("//", "div").split(", ")])


_STOPS = f"""r AS (SELECT {_VEHICLE} FROM events),
f AS (SELECT *, CASE WHEN speed = 0 AND lag(speed) OVER w = 0 AND lag(pos) OVER w = pos THEN 0 ELSE 1 END AS new, lead(time) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY vid ORDER BY time)),
i AS (SELECT *, sum(new) OVER (PARTITION BY vid ORDER BY time) AS island FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY vid, island ORDER BY time) AS k FROM i WHERE speed = 0),
stops AS (SELECT vid, min(pos) AS pos, min(pos) // 5280 AS seg, min(time) FILTER (k = 4) AS stopped_at, max_by(coalesce(nxt, -1), time) AS left_at FROM n GROUP BY vid, island HAVING count(*) >= 4)"""
_CRASHES = _STOPS + """,
net AS (SELECT pos, seg, tm, sum(d) AS d FROM (SELECT pos, seg, stopped_at AS tm, 1 AS d FROM stops UNION ALL SELECT pos, seg, left_at, -1 FROM stops WHERE left_at >= 0) GROUP BY ALL),
lev AS (SELECT pos, seg, tm, d, sum(d) OVER (PARTITION BY pos, seg ORDER BY tm) AS n FROM net),
turn AS (SELECT pos, seg, tm, n, lead(tm) OVER (PARTITION BY pos, seg ORDER BY tm) AS upto FROM lev WHERE (n >= 2) <> (n - d >= 2)),
crash AS (SELECT pos, seg, tm AS "from", upto AS "to" FROM turn WHERE n >= 2)"""
_SPEEDS = "speeds AS (SELECT pos // 5280 AS seg, time // 300 AS slot, count(*) AS reports, CAST(sum(speed) AS BIGINT) AS speed_sum FROM r GROUP BY ALL)"


@query(f"WITH {_STOPS} SELECT vid, pos, seg, stopped_at, nullif(left_at, -1) AS left_at FROM stops")
def lr_stops(spark, d):
    return R.stops(_reports(spark, d))


@query(f"WITH {_CRASHES} SELECT * FROM crash")
def lr_accidents(spark, d):
    return R.accidents(R.stops(_reports(spark, d)))


@query(f"WITH {_STOPS}, {_SPEEDS} SELECT * FROM speeds")
def lr_segment_avg(spark, d):
    return R.segment_speeds(_reports(spark, d))


@query(f"WITH {_CRASHES}, {_SPEEDS} SELECT seg, slot, reports AS toll_vehicles FROM speeds s WHERE speed_sum > 40 * reports AND NOT EXISTS (SELECT 1 FROM crash c WHERE c.seg = s.seg AND c.\"from\" < (slot + 1) * 300 AND (c.\"to\" IS NULL OR c.\"to\" > slot * 300))")
def lr_tolls(spark, d):
    rows = _reports(spark, d)
    return R.tolls(R.segment_speeds(rows), R.accidents(R.stops(rows)))


# Reports as lines of 15 integers, of which every fifth is no position report.
_TYPED = f"SELECT *, CASE WHEN time % 5 = 0 THEN 2 ELSE 0 END AS type FROM (SELECT {_VEHICLE} FROM events)"


def _lines(spark, d):
    rows = _reports(spark, d).select(F.when(F.col("time") % 5 == 0, 2).otherwise(0).alias("type"), "vid", "time", "speed", "pos")
    fields = ["type", "time", "vid", "speed", *[F.lit(0)] * 4, "pos", F.lit(-1), *[F.lit(0)] * 5]
    return S.vehicle_reports(rows.select(F.concat_ws(",", *fields).alias("value")))


@query(f"SELECT CAST(vid AS INTEGER) AS vid, CAST(time AS INTEGER) AS time, CAST(speed AS INTEGER) AS speed, CAST(pos AS INTEGER) AS pos FROM ({_TYPED}) WHERE type = 0")
def lr_position_reports(spark, d):
    return R.position_reports(_lines(spark, d)).select("vid", "time", "speed", "pos")


_TOLLED = f"SELECT seg, slot, reports AS toll_vehicles FROM speeds s WHERE speed_sum > 40 * reports AND NOT EXISTS (SELECT 1 FROM crash c WHERE c.seg = s.seg AND c.\"from\" < (slot + 1) * 300 AND (c.\"to\" IS NULL OR c.\"to\" > slot * 300))"


@query(f"WITH {_CRASHES.replace(f'SELECT {_VEHICLE} FROM events', f'SELECT * FROM ({_TYPED}) WHERE type = 0')}, {_SPEEDS}, toll AS ({_TOLLED}) SELECT TIMESTAMP '1970-01-01' + to_seconds((slot + 1) * 300) AS start, seg AS key, CAST(sum(toll_vehicles) AS BIGINT) AS total FROM toll GROUP BY ALL")
def lr_pipeline(spark, d):
    return R.toll_sums(R.position_reports(_lines(spark, d)), "1 second").drop("end")


# ------------------------------------------------------------------ sources


def _number(c, n: int = 8):
    """Little-endian bytes of a number."""
    h = F.lpad(F.hex(F.col(c) if isinstance(c, str) else c), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 15 - 2 * n, -2)]))


def _padded(c, n: int):
    return F.unhex(F.rpad(F.hex(c), 2 * n, "00"))


_BY_KIND = "SELECT {hour} AS start, user_id % 10 AS campaign, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL".format(hour=_HOUR)


@query(_BY_KIND)
def ysb_packed(spark, d):
    none = F.unhex(F.lit("00" * 16))
    campaign = F.concat(F.unhex(F.lit("00" * 8)), _number(F.col("user_id") % 10))
    value = F.concat(none, none, campaign, _padded(F.lit("banner78"), 9), _padded("event_type", 9), _number(F.unix_millis("ts")), _number(F.lit(0x01020304), 4))
    ads = S.ad_events(_events(spark, d).select(value.alias("value"))).where("event_type = 'view' AND ip = 16909060")
    return A.keyed(ads.select("ts", T.low_uint64(F.col("campaign_id")).cast("long").alias("campaign")), "1 hour", ["campaign"], n=F.count("*")).drop("end")


_LSDS = f"SELECT {_HOUR} AS start, c_mktsegment AS campaign, count(*) AS total FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY ALL"


def _campaigns(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ad_id"), F.col("c_mktsegment").alias("campaign"))


@query(_LSDS)
def ysb_csv(spark, d):
    line = F.concat_ws(",", F.unix_millis("ts"), F.lit("a-b"), F.lit("c-d"), F.concat_ws("-", F.lit(""), "user_id", F.lit("")), F.lit("banner78"), "event_type", F.lit("1.2.3.4"))
    ads = S.ad_csv(_events(spark, d).select(line.alias("value"))).where("num_event_type = 2 AND user_id = 'ab'")
    rows = J.lookup_join(ads.select(F.timestamp_millis(F.col("timestamp").cast("long")).alias("ts"), "ad_id"), _campaigns(spark, d), "ad_id")
    return A.keyed(rows, "1 hour", ["campaign"], total=F.sum(F.lit(1))).drop("end")


@query("SELECT c_mktsegment AS campaign, count(*) AS total FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY ALL")
def ysb_packed_texts(spark, d):
    ids = [_padded(F.lit("ab"), 36), _padded(F.lit("cd"), 36), _padded(F.col("user_id").cast("string"), 36)]
    value = F.concat(*ids, _padded(F.lit("banner78"), 16), _padded("event_type", 8), _number(F.lit(0x01020304), 4))
    ads = S.ad_texts(_events(spark, d).select(value.alias("value"))).where("num_event_type = 2 AND page_id = 'cd' AND ip = 16909060")
    return J.lookup_join(ads.select("ad_id"), _campaigns(spark, d), "ad_id").groupBy("campaign").agg(F.count("*").alias("total"))


@query(f"SELECT l_partkey AS auction, l_suppkey AS bidder, {_CENTS} AS price, l_orderkey AS \"dateTime\" FROM lineitem")
def nexmark_packed(spark, d):
    cols = ["l_partkey", "l_suppkey", F.expr(_CENTS), "l_orderkey"]
    return S.bids(S.table(spark, d, "lineitem").select(F.concat(*[_number(c) for c in cols]).alias("value")))


@query("SELECT TIMESTAMP '2002-01-10' + to_milliseconds((event_id // 1000) * 1500 + ((event_id % 1000) * 10 // 1000) * 100) AS ts, count(*) AS n FROM events GROUP BY ALL")
def replay_times(spark, d):
    return S.epoch_times(_events(spark, d).select("event_id"), "event_id", 1000, 10, 1000, "2002-01-10", 500).groupBy("ts").agg(F.count("*").alias("n"))


@query("SELECT TIMESTAMP '2002-01-10' + to_seconds(3 * ((i // 1024) // 3)) AS start, CAST(sum(i) AS BIGINT) AS total FROM range(10240) t(i) GROUP BY ALL")
def counter_sums(spark, d):
    return A.windowed(S.counter(spark, 10240), "3 seconds", total=F.sum("value")).drop("end")


@query("SELECT ['view', 'click', 'purchase'][i % 3 + 1] AS event_type, 'banner78' AS ad_type, count(*) AS n FROM range(10000) t(i) GROUP BY ALL")
def generated_kinds(spark, d):
    return S.generated_ads(spark, 10000).groupBy("event_type", "ad_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ user functions, topology


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def udaf_fold(spark, d):
    class Sum(A.Fold):
        def zero(self):
            return 0

        def add(self, state, values):
            return state + int(values.sum())

        def merge(self, a, b):
            return a + b

    return A.fold(_events(spark, d).select("event_type", "user_id"), Sum(), ["event_type"], "user_id", "total", "long")


@query(f"SELECT {_bucket('1 day')} AS start, user_id AS key, CAST(max(event_id) - min(event_id) AS BIGINT) AS spread FROM events GROUP BY ALL")
def keyed_reduce(spark, d):
    spread = A.reducer("long")(_spread)
    return A.keyed(_events(spark, d).select("ts", F.col("user_id").alias("key"), "event_id"), "1 day", ["key"], spread=spread("event_id")).drop("end")


def _spread(values: pd.Series) -> int | None:
    known = values.to_numpy()
    known = known[known == known]
    return int(known.max() - known.min()) if known.size else None


@query("SELECT event_id, user_id FROM events")
def identity(spark, d):
    return U.identity(_events(spark, d).select("event_id", "user_id"))


@query("SELECT event_type, user_id % 2 AS shard, count(*) AS n FROM events GROUP BY ALL")
def shard_counts(spark, d):
    return _events(spark, d).groupBy("event_type", F.pmod("user_id", F.lit(2)).alias("shard")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ streams


def _streamed(spark, df: DataFrame) -> DataFrame:
    return G.collected(df, scratch(spark), scratch(spark))


_CLOSED = "(SELECT max(ts) FROM events)"


@query(f"SELECT {_HOUR} AS start, {_HOUR} + INTERVAL '1 hour' AS \"end\", user_id % 10 AS campaign, count(*) AS n, count_if(event_type = 'view') AS views FROM events GROUP BY 1, 2, 3 HAVING {_HOUR} + INTERVAL '1 hour' <= {_CLOSED}")
def stream_tumbling(spark, d):
    rows = G.watermarked(S.table(spark, d, "events", stream=True))
    return _streamed(spark, A.keyed(rows, "1 hour", [(F.col("user_id") % 10).alias("campaign")], n=F.count("*"), views=F.count_if(F.col("event_type") == "view")))


@query(f"""SELECT start, start + INTERVAL '2 hours' AS "end", CAST(sum(user_id) AS BIGINT) AS total
FROM (SELECT user_id, unnest([{_HOUR}, {_HOUR} - INTERVAL '1 hour']) AS start FROM events) GROUP BY start HAVING start + INTERVAL '2 hours' <= {_CLOSED}""")
def stream_sliding(spark, d):
    rows = G.watermarked(S.table(spark, d, "events", stream=True))
    return _streamed(spark, A.sliding_sum(rows, "user_id", 2, "1 hour"))
