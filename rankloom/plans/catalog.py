"""Queries over the standard tables, one an operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import settings as S
from rankloom.functions import text as T
from rankloom.functions.vectors import cosine
from rankloom.operators import features as FT
from rankloom.operators import ranking as R
from rankloom.operators import retrieval as V
from rankloom.plans.fixtures import IC, SCORED, articles, clicks, impressions, table, vectors
from rankloom.sources import readers
from rankloom.sources.store import new_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r6(c: str, to: str | None = None):
    return F.round(F.col(c), 6).alias(to or c.rsplit(".", 1)[-1])


def parted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, those up to the cutoff, and the others."""
    rows = written(impressions(spark, sf), "impressions")  # every part and statistic below reads it
    early, late = R.split(rows, written(R.cutoff(rows.select("impression_id", "ts").distinct()), "cutoff"))
    return rows, early, late


def scored_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The early part, the later part, and the later part with the candidates' clicks in the early one as score."""
    _, fit, tune = parted(spark, sf)
    return fit, tune, tune.join(R.popularity(fit), "candidate_id", "left").withColumn("score", F.coalesce("clicks", F.lit(0)).cast("double")).drop("clicks")


def tune_scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_parts(spark, sf)[2]


# Text and parsing


@query("tsv_text_concat", "SELECT p_partkey AS article_id, coalesce(p_name, '') || ' ' || coalesce(p_type, '') AS text_lexical FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("article_id"), T.concat_nullsafe("p_name", "p_type").alias("text_lexical"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))"


@query("tokenize_counts", f"SELECT doc_id, CAST(len(x) AS INTEGER) AS n_tokens, CAST(len(list_distinct(x)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {TOKENS_SQL} AS x FROM documents)")
def _(spark, sf):
    docs = T.normalised(table(spark, sf, "documents").select("doc_id", "text"), "text")
    # one array for both counts: the generator keeps its expression from being repeated
    found = docs.select("doc_id", F.inline(F.array(F.struct(T.tokens(F.col("text")).alias("t")))))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("nfkc_tokens", "SELECT * FROM (VALUES (0, 'ﬁne ① Ａlpha éa ℌx', 'fine,alpha,éa,hx'), (1, 'ordinary wørds', 'ordinary,wørds'), (2, NULL, '')) t(id, text, terms)")
def _(spark, sf):
    """Compatibility characters of a few fixed texts: ligature, circled digit, full width, a combining accent, a fraktur letter."""
    rows = spark.createDataFrame([(0, "ﬁne ① Ａlpha éa ℌx"), (1, "ordinary wørds"), (2, None)], "id int, text string")
    decomposed = rows.withColumn("plain", F.regexp_replace("text", "é", "e\u0301"))
    found = T.normalised(decomposed, "plain")
    return found.select("id", "text", F.array_join(T.tokens(F.col("plain")), ",").alias("terms"))


@query("parse_impressions_roundtrip", f"WITH {IC} SELECT impression_id, 'P-' || candidate_id AS candidate_id, label, pos FROM ic")
def _(spark, sf):
    rows = impressions(spark, sf).groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_id", "label"))).alias("x"))
    line = F.array_join(F.transform("x", lambda x: F.concat(F.lit("P-"), x["candidate_id"].cast("string"), F.lit("-"), x["label"].cast("string"))), " ")
    parsed = rows.select("impression_id", F.posexplode(readers.parse_labelled(line)).alias("pos", "y"))
    return parsed.select("impression_id", "y.candidate_id", "y.label", "pos")


@query("parse_timestamp", "SELECT o_orderkey, o_orderdate AS ts FROM orders")
def _(spark, sf):
    written = F.date_format(F.col("o_orderdate"), "M/d/yyyy h:mm:ss a")
    return table(spark, sf, "orders").select("o_orderkey", readers.parse_time(written).alias("ts"))


@query("labels_from_membership", f"WITH {IC} SELECT impression_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(label) AS BIGINT) AS clicked FROM ic GROUP BY 1")
def _(spark, sf):
    lists = impressions(spark, sf).groupBy("impression_id").agg(F.collect_list("candidate_id").alias("inview"), F.collect_list(F.when(F.col("label") == 1, F.col("candidate_id"))).alias("clicked"))
    labels = readers.membership_labels(F.col("inview"), F.col("clicked"))
    return lists.select("impression_id", F.size(labels).alias("n"), F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + x).alias("clicked"))


# Scans and sinks: written to a folder of the session's own and read back


def _tsv_roundtrip(spark, sf, name: str, columns: list) -> str:
    path = new_path(spark, name)
    table(spark, sf, "part" if name == "articles" else "orders").select(*columns).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("scan_tsv_articles", "SELECT CAST(p_partkey AS VARCHAR) AS article_id, p_name || ' ' || p_type AS text_lexical, p_brand AS category FROM part")
def _(spark, sf):
    blank = F.lit("x")
    path = _tsv_roundtrip(spark, sf, "articles", ["p_partkey", "p_brand", blank, "p_name", "p_type", blank, blank, blank])
    return readers.tsv_articles(spark, path)


@query("scan_tsv_behaviors", f"WITH {IC} SELECT impression_id, CAST(user_id AS VARCHAR) AS user_id, ts AS timestamp, CAST(CASE WHEN impression_id % 3 = 0 THEN 0 ELSE impression_id % 3 END AS INTEGER) AS history_len, CAST(count(*) AS INTEGER) AS n, CAST(sum(label) AS BIGINT) AS clicked FROM ic GROUP BY 1, 2, 3")
def _(spark, sf):
    """Written as TSV and read: histories of 0 to 2 ids, an empty one as an empty field."""
    rows = impressions(spark, sf).groupBy("impression_id", "user_id", "ts").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_id", "label"))).alias("x"))
    history = F.array_join(F.slice(F.array(F.lit("N1"), F.lit("N-2")), 1, (F.col("impression_id") % 3).cast("int")), " ")
    items = F.array_join(F.transform("x", lambda x: F.concat(F.lit("N"), x["candidate_id"].cast("string"), F.lit("-"), x["label"].cast("string"))), " ")
    path = new_path(spark, "behaviors")
    rows.select("impression_id", "user_id", F.date_format("ts", "M/d/yyyy h:mm:ss a"), history, items).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    labels = F.aggregate("labels", F.lit(0).cast("long"), lambda s, v: s + v)
    return readers.tsv_behaviors(spark, path).select("impression_id", "user_id", "timestamp", "history_len", F.size("candidates").alias("n"), labels.alias("clicked"))


@query("parse_unlabeled", f"WITH {IC} SELECT impression_id, 'N' || candidate_id AS candidate_id, pos FROM ic")
def _(spark, sf):
    """Lists without labels, written as TSV and read."""
    rows = impressions(spark, sf).groupBy("impression_id", "user_id", "ts").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_id"))).alias("x"))
    items = F.array_join(F.transform("x", lambda x: F.concat(F.lit("N"), x["candidate_id"].cast("string"))), " ")
    path = new_path(spark, "unlabelled")
    rows.select("impression_id", "user_id", F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit(""), items).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return readers.tsv_behaviors(spark, path, labelled=False).filter("labels is null").select("impression_id", F.posexplode("candidates").alias("pos", "candidate_id"))


@query("scan_user_history", "SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'N' || min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def _(spark, sf):
    """Each user's history is that of the first row."""
    path = _tsv_roundtrip(spark, sf, "user-history", ["o_orderkey", "o_custkey", F.lit("11/15/2019 8:55:22 AM"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string"), F.lit(" N0")), F.lit("N1-0")])
    return readers.tsv_user_history(spark, path).select("user_id", F.col("history")[0].alias("first_id"))


@query("scan_session_ids", "SELECT o_orderkey AS impression_id, o_custkey AS user_id, o_orderdate AS timestamp, CAST(coalesce(n, 0) AS INTEGER) AS history_len, o_orderkey % 7 AS session_id, 1::BIGINT AS clicked FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) h ON h.user_id = o_custkey")
def _(spark, sf):
    """Parquet logs: the session's id stays on the row, history lengths come by a left join on the user."""
    behaviors, history = new_path(spark, "parquet-behaviors"), new_path(spark, "parquet-history")
    orders = table(spark, sf, "orders")
    orders.select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("impression_time"), F.array("o_orderkey", "o_custkey").alias("article_ids_inview"), F.array("o_orderkey").alias("article_ids_clicked"), (F.col("o_orderkey") % 7).alias("session_id")).write.parquet(behaviors)
    clicks(spark, sf).groupBy("user_id").agg(F.collect_list("article_id").alias("article_id_fixed")).write.parquet(history)
    rows = readers.parquet_behaviors(spark, behaviors, history)
    first = F.element_at("labels", 1).cast("long")
    return rows.select("impression_id", "user_id", "timestamp", "history_len", "session_id", first.alias("clicked"))


@query("scan_tsv_chunked", "SELECT o_orderkey AS impression_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) // 1000 AS chunk FROM orders")
def _(spark, sf):
    """A log in chunks of 1,000 rows by the row's number."""
    path = _tsv_roundtrip(spark, sf, "chunked", ["o_orderkey", "o_custkey", F.lit(""), F.lit(""), F.lit("")])
    raw = spark.read.schema(readers.BEHAVIORS_TSV).option("sep", "\t").csv(path)
    return readers.in_chunks(raw.select("impression_id", "user_id"), ["impression_id"], 1000).select("impression_id", "user_id", "chunk")


@query("scan_row_range", "SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 600")
def _(spark, sf):
    return readers.row_range(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 100, 500)


@query("scan_parquet_rowgroups", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
def _(spark, sf):
    """Splits of the file's row groups as micro-batches of a stream; each split's sums are appended, then added up."""
    from rankloom.streaming.chunks import in_batches

    sums = in_batches(spark, table(spark, sf, "events"), lambda df: df.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), files=4)
    return sums.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("scan_parquet_pruned", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000")
def _(spark, sf):
    return table(spark, sf, "orders").filter("o_totalprice > 1000").select("o_orderkey", "o_custkey")


@query("scan_engagement_history", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id, value AS read_time FROM events WHERE event_type = 'click'")
def _(spark, sf):
    c = clicks(spark, sf)
    lists = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "article_id", "read_time"))).alias("x"))
    pick = lambda name: F.transform("x", lambda s: s[name])
    path = new_path(spark, "history")
    lists.select("user_id", pick("article_id").alias("article_id_fixed"), pick("ts").alias("impression_time_fixed"), pick("read_time").alias("read_time_fixed"), pick("read_time").alias("scroll_percentage_fixed")).write.parquet(path)
    return readers.parquet_engagement(spark, path).select("user_id", "idx", "article_id", "read_time")


# Split and click statistics


@query("order_stat_cutoff", f"WITH {IC} SELECT cutoff FROM cut")
def _(spark, sf):
    return R.cutoff(impressions(spark, sf).select("impression_id", "ts").distinct())


@query("temporal_split_counts", f"WITH {IC} SELECT (SELECT count(*) FROM fit) AS n_fit, (SELECT count(*) FROM tune) AS n_tune")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    return fit.agg(F.count(F.lit(1)).alias("n_fit")).crossJoin(tune.agg(F.count(F.lit(1)).alias("n_tune")))


@query("intersect_fit_tune", f"WITH {IC} SELECT count(*) AS n_common FROM (SELECT impression_id FROM fit INTERSECT SELECT impression_id FROM tune)")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    return fit.select("impression_id").intersect(tune.select("impression_id")).agg(F.count(F.lit(1)).alias("n_common"))


@query("popularity_train", f"WITH {IC} SELECT * FROM pop")
def _(spark, sf):
    return R.popularity(parted(spark, sf)[1])


@query("first_seen", f"WITH {IC} SELECT * FROM seen")
def _(spark, sf):
    return R.first_seen(parted(spark, sf)[1])


HOURS_SQL = "(epoch_us({0}) - epoch_us({1})) / 3.6e9::DOUBLE"


@query("median_freshness", f"WITH {IC} SELECT round(quantile_cont({HOURS_SQL.format('ts', 'first_ts')}, 0.5), 6) AS median_freshness FROM fit JOIN seen USING (candidate_id)")
def _(spark, sf):
    fit = parted(spark, sf)[1]
    hours = R.hours_between(F.col("ts"), F.col("first_ts"))
    found = R.quantiles(fit.join(R.first_seen(fit), "candidate_id").select(hours.alias("hours")), "hours", {"median_freshness": 0.5})
    return found.select(r6("median_freshness"))


@query("split_summary", f"WITH {IC} SELECT count(*) AS n_rows, count(DISTINCT impression_id) AS n_impressions, count(DISTINCT user_id) AS n_users, min(ts) AS min_ts, max(ts) AS max_ts FROM fit")
def _(spark, sf):
    return parted(spark, sf)[1].agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("impression_id").alias("n_impressions"), F.countDistinct("user_id").alias("n_users"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


SESSION_SQL = """WITH a AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT event_id, {0} FROM b"""


@query("session_key", SESSION_SQL.format("CAST(k AS BIGINT) AS session_key"))
def _(spark, sf):
    return R.sessions(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "session_key")


@query("session_position", SESSION_SQL.format("CAST(row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - 1 AS INTEGER) AS session_position"))
def _(spark, sf):
    return R.sessions(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "session_position")


# Histories


@query("history_tail", f"WITH {IC} SELECT user_id, idx, article_id FROM tail")
def _(spark, sf):
    return R.history_tail(R.click_history(parted(spark, sf)[1])).select("user_id", "idx", "article_id")


@query("rank_decay_weight", f"WITH {IC} SELECT user_id, idx, round(w, 6) AS w FROM items")
def _(spark, sf):
    return R.history_tail(R.click_history(parted(spark, sf)[1])).select("user_id", "idx", F.round(R.rank_weight(F.col("idx"), F.col("n")), 6).alias("w"))


@query("time_decay_weight", f"SELECT event_id, round(power(0.5, greatest({HOURS_SQL.format('m', 'ts')}, 0) / 72.0), 6) AS w FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'click')")
def _(spark, sf):
    c = clicks(spark, sf).withColumn("m", F.max("ts").over(W.partitionBy("user_id")))
    return c.select("event_id", F.round(R.time_weight(F.col("ts"), F.col("m")), 6).alias("w"))


def profile(spark, sf):
    return R.category_profile(R.history_tail(R.click_history(parted(spark, sf)[1])), articles(spark, sf))


@query("category_counts", f"WITH {IC} SELECT user_id, category, cnt FROM prof")
def _(spark, sf):
    return profile(spark, sf).select("user_id", "category", "cnt")


@query("top_category", f"WITH {IC} SELECT * FROM topcat")
def _(spark, sf):
    return R.top_category(profile(spark, sf))


@query("category_match_frac", f"WITH {IC} SELECT user_id, category, round(cnt / n_known::DOUBLE, 6) AS frac FROM prof")
def _(spark, sf):
    return profile(spark, sf).select("user_id", "category", F.round(F.col("cnt") / F.col("n_known").cast("double"), 6).alias("frac"))


@query("category_match_recency", f"WITH {IC} SELECT user_id, category, round(weight / total_weight, 6) AS recency FROM prof")
def _(spark, sf):
    return profile(spark, sf).select("user_id", "category", F.round(F.col("weight") / F.col("total_weight"), 6).alias("recency"))


@query("nanmean_engagement", "SELECT user_id, round(coalesce(avg(CASE WHEN event_id % 7 <> 0 THEN value END), 0), 6) AS avg_read_time FROM events WHERE event_type = 'click' GROUP BY 1")
def _(spark, sf):
    c = clicks(spark, sf).withColumn("x", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("read_time")))
    return c.groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(~F.isnan("x"), F.col("x"))), F.lit(0.0)), 6).alias("avg_read_time"))


# Joins and sets


@query("join_left_histlen", f"WITH {IC}, h AS (SELECT DISTINCT user_id, n FROM hist) SELECT imp.impression_id, coalesce(h.n, 0) AS history_len FROM imp LEFT JOIN h USING (user_id)")
def _(spark, sf):
    rows, fit, _t = parted(spark, sf)
    lengths = R.click_history(fit).select("user_id", "n").distinct()
    return rows.select("impression_id", "user_id").distinct().join(lengths, "user_id", "left").select("impression_id", F.coalesce("n", F.lit(0)).alias("history_len"))


def two_lists(s: DataFrame) -> DataFrame:
    """Channel 0: an impression's candidates by popularity; channel 1: by position; the best three of each."""
    w = W.partitionBy("impression_id")
    a = s.select(F.col("impression_id").alias("query"), F.lit(0).alias("channel"), F.row_number().over(w.orderBy(F.desc("score"), "pos")).alias("rank"), F.col("candidate_id").alias("item"))
    b = s.select(F.col("impression_id").alias("query"), F.lit(1).alias("channel"), F.row_number().over(w.orderBy("pos")).alias("rank"), F.col("candidate_id").alias("item"))
    return a.unionByName(b).filter("rank <= 3")


POOL_SQL = SCORED + """,
two AS (SELECT impression_id AS query, 0 AS channel, place AS rank, candidate_id AS item FROM rk WHERE place <= 3
  UNION ALL SELECT impression_id, 1, pos + 1, candidate_id FROM rk WHERE pos < 3),
firsts AS (SELECT query, item, min(channel * 10 + rank) AS place0 FROM two GROUP BY 1, 2),
pool AS (SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY place0) - 1 AS INTEGER) AS pos FROM firsts)"""


@query("union_ordered_pool", f"WITH {POOL_SQL} SELECT * FROM pool")
def _(spark, sf):
    return R.pool_concat(two_lists(tune_scored(spark, sf)))


@query("positives_antijoin", f"WITH {POOL_SQL} SELECT t.impression_id AS query, t.candidate_id AS item FROM tune t WHERE t.label = 1 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.query = t.impression_id AND p.item = t.candidate_id)")
def _(spark, sf):
    lists = tune_scored(spark, sf)
    positives = lists.filter("label = 1").select(F.col("impression_id").alias("query"), F.col("candidate_id").alias("item"))
    return positives.join(R.pool_concat(two_lists(lists)), ["query", "item"], "left_anti")


def md5_sql(*parts: str) -> str:
    """``R.md5_share`` in DuckDB."""
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("pool_with_positives", f"""WITH {POOL_SQL}, sz AS (SELECT query, count(*) AS n FROM pool GROUP BY 1),
ms AS (SELECT t.impression_id AS query, t.candidate_id AS item FROM tune t WHERE t.label = 1 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.query = t.impression_id AND p.item = t.candidate_id)),
al AS (SELECT query, item, pos::DOUBLE AS spot FROM pool UNION ALL SELECT query, item, floor({md5_sql('query', 'item', S.SEED)} * (n + 1)) - 0.5 FROM ms JOIN sz USING (query))
SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY spot, item) - 1 AS INTEGER) AS pos FROM al""")
def _(spark, sf):
    lists = tune_scored(spark, sf)
    positives = lists.filter("label = 1").select(F.col("impression_id").alias("query"), F.col("candidate_id").alias("item"))
    return R.pool_with_positives(R.pool_concat(two_lists(lists)), positives)


@query("union_dedup_first", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return readers.union_first_wins("id", a, b)


# Fusion and ranks


@query("minmax_hybrid", f"WITH {SCORED}, mm AS (SELECT impression_id, candidate_id, score, pos, min(score) OVER w AS a, max(score) OVER w AS b, min(-pos) OVER w AS c, max(-pos) OVER w AS d FROM sc WINDOW w AS (PARTITION BY impression_id)) SELECT impression_id, candidate_id, round(0.5 * CASE WHEN b - a < 1e-12 THEN 0.5 ELSE (score - a) / (b - a) END + 0.5 * CASE WHEN d - c < 1e-12 THEN 0.5 ELSE (-pos - c) / (d - c)::DOUBLE END, 6) AS hybrid FROM mm")
def _(spark, sf):
    s = tune_scored(spark, sf).withColumn("other", -F.col("pos").cast("double"))
    return s.select("impression_id", "candidate_id", F.round(R.hybrid("score", "other"), 6).alias("hybrid"))


@query("score_ranks", f"WITH {SCORED} SELECT impression_id, candidate_id, CAST(place AS INTEGER) AS rank FROM rk")
def _(spark, sf):
    return tune_scored(spark, sf).select("impression_id", "candidate_id", R.score_rank("score").alias("rank"))


@query("rank_line", f"WITH {SCORED} SELECT impression_id, impression_id || ' [' || string_agg(CAST(place AS VARCHAR), ',' ORDER BY pos) || ']' AS line FROM rk GROUP BY 1")
def _(spark, sf):
    return R.rank_lines(tune_scored(spark, sf))


@query("position_norm", f"WITH {IC} SELECT impression_id, candidate_id, round(pos / greatest(count(*) OVER (PARTITION BY impression_id) - 1, 1)::DOUBLE, 6) AS position_norm FROM ic")
def _(spark, sf):
    return impressions(spark, sf).select("impression_id", "candidate_id", F.round(R.position_norm(), 6).alias("position_norm"))


# Metrics


@query("impressions_mrr_auc", f"WITH {SCORED} SELECT impression_id, round(auc, 6) AS auc, round(mrr, 6) AS mrr, round(ndcg5, 6) AS ndcg5, round(ndcg10, 6) AS ndcg10 FROM met")
def _(spark, sf):
    return R.impression_metrics(tune_scored(spark, sf)).select("impression_id", *[r6(c) for c in ("auc", "mrr", "ndcg5", "ndcg10")])


def _metric(name: str) -> None:
    @query(f"{name}_impression", f"WITH {SCORED} SELECT impression_id, round({name}, 6) AS {name} FROM met WHERE {name} IS NOT NULL")
    def _(spark, sf):
        return R.impression_metrics(tune_scored(spark, sf)).filter(F.col(name).isNotNull()).select("impression_id", r6(name))


for _name in ("auc", "mrr", "ndcg5", "ndcg10"):
    _metric(_name)

HEAD_SQL = "lim AS (SELECT quantile_cont(clicks, 0.8) AS h FROM pop), head AS (SELECT t.impression_id, max(CASE WHEN coalesce(p.clicks, 0) >= h THEN 1 ELSE 0 END) AS is_head FROM tune t LEFT JOIN pop p USING (candidate_id), lim WHERE t.label = 1 GROUP BY 1)"


def head_flags(fit: DataFrame, tune: DataFrame) -> DataFrame:
    pop = R.popularity(fit)
    limit = R.quantiles(pop, "clicks", {"h": 1 - S.HEAD_SHARE})
    rows = tune.filter("label = 1").join(pop, "candidate_id", "left").crossJoin(F.broadcast(limit))
    return rows.groupBy("impression_id").agg(F.max((F.coalesce("clicks", F.lit(0)) >= F.col("h")).cast("int")).alias("is_head"))


@query("head_tail", f"WITH {SCORED}, {HEAD_SQL} SELECT impression_id, is_head FROM head")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    return head_flags(fit, tune)


WARM_SQL = "hl AS (SELECT DISTINCT user_id, n FROM hist), warm AS (SELECT DISTINCT t.impression_id, CASE WHEN coalesce(n, 0) > 5 THEN 1 ELSE 0 END AS is_warm FROM tune t LEFT JOIN hl USING (user_id))"


def warm_flags(fit: DataFrame, tune: DataFrame) -> DataFrame:
    lengths = R.click_history(fit).select("user_id", "n").distinct()
    return tune.select("impression_id", "user_id").distinct().join(lengths, "user_id", "left").select("impression_id", (F.coalesce("n", F.lit(0)) > S.COLD_UP_TO).cast("int").alias("is_warm"))


@query("cold_warm", f"WITH {SCORED}, {WARM_SQL} SELECT * FROM warm")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    return warm_flags(fit, tune)


@query("metrics_by_slice", f"""WITH {SCORED}, {HEAD_SQL}, {WARM_SQL},
sl AS (SELECT m.*, unnest(['overall', CASE WHEN is_warm = 1 THEN 'warm' ELSE 'cold' END, CASE WHEN is_head = 1 THEN 'head' ELSE 'tail' END]) AS slice FROM met m JOIN head USING (impression_id) JOIN warm USING (impression_id)),
lg AS (SELECT slice, 'auc' AS metric, auc AS v FROM sl UNION ALL SELECT slice, 'mrr', mrr FROM sl UNION ALL SELECT slice, 'ndcg5', ndcg5 FROM sl UNION ALL SELECT slice, 'ndcg10', ndcg10 FROM sl)
SELECT slice, metric, round(avg(v), 6) AS mean, count(v) AS n FROM lg GROUP BY 1, 2""")
def _(spark, sf):
    fit, tune, lists = scored_parts(spark, sf)
    m = R.impression_metrics(lists).join(head_flags(fit, tune), "impression_id").join(warm_flags(fit, tune), "impression_id")
    slices = F.array(F.lit("overall"), F.when(F.col("is_warm") == 1, "warm").otherwise("cold"), F.when(F.col("is_head") == 1, "head").otherwise("tail"))
    return R.summary(m.withColumn("slice", F.explode(slices)), "slice").withColumn("mean", F.round("mean", 6))


@query("recall_at_k", f"WITH {SCORED}, b AS (SELECT impression_id, min(place) AS best FROM rk WHERE label = 1 GROUP BY 1), k AS (SELECT unnest([1, 3, 5]) AS k) SELECT k, round(avg(CASE WHEN best <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM b, k GROUP BY 1")
def _(spark, sf):
    ranked = tune_scored(spark, sf).withColumn("place", R.score_rank("score"))
    return R.hit_rate(ranked, (1, 3, 5)).withColumn("hit_rate", F.round("hit_rate", 6))


def best_three(lists: DataFrame) -> DataFrame:
    return lists.withColumn("place", R.score_rank("score")).filter("place <= 3")


def top_three(spark, sf):
    return best_three(tune_scored(spark, sf))


@query("novelty", f"WITH {SCORED}, tt AS (SELECT (SELECT sum(clicks) FROM pop) + (SELECT count(*) FROM part) AS total) SELECT impression_id, round(avg(-log2((coalesce(clicks, 0) + 1) / total::DOUBLE)), 6) AS novelty FROM rk LEFT JOIN pop USING (candidate_id), tt WHERE place <= 3 GROUP BY 1")
def _(spark, sf):
    fit, _, lists = scored_parts(spark, sf)
    catalog = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("catalog"))
    return R.novelty(best_three(lists).select("impression_id", "candidate_id"), R.popularity(fit), catalog).withColumn("novelty", F.round("novelty", 6))


@query("coverage", f"WITH {SCORED} SELECT count(DISTINCT candidate_id) AS items, round(count(DISTINCT candidate_id) / (SELECT count(*) FROM part)::DOUBLE, 6) AS coverage FROM rk WHERE place <= 3")
def _(spark, sf):
    catalog = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("catalog"))
    found = top_three(spark, sf).agg(F.countDistinct("candidate_id").alias("items"))
    return found.crossJoin(catalog).select("items", F.round(F.col("items") / F.col("catalog").cast("double"), 6).alias("coverage"))


@query("diversity", "WITH v AS (SELECT vec_id // 10 AS impression_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.impression_id, round(1 - avg(list_cosine_similarity(a.e, b.e)), 6) AS diversity FROM v a JOIN v b ON a.impression_id = b.impression_id AND a.vec_id <> b.vec_id GROUP BY 1")
def _(spark, sf):
    items = vectors(spark, sf).select(F.floor(F.col("id") / 10).alias("impression_id"), "vec")
    return R.diversity(items).withColumn("diversity", F.round("diversity", 6))


# Vectors


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    v = vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("vec").alias("vb"))
    return v.join(other, "id").select(F.col("id").alias("a"), "b", F.round(cosine(F.col("vec"), F.col("vb")), 6).alias("cosine"))


@query("knn_exact_topk", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.id AS query, v.id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s)
SELECT query, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10""")
def _(spark, sf):
    v = V.unit(vectors(spark, sf))
    q = v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query"), "vec")
    return V.knn_exact(q, v, 10).withColumn("score", F.round("score", 6))


@query("knn_ivf")
def _(spark, sf):
    v = V.unit(vectors(spark, sf))
    q = v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query"), "vec")
    clusters = max(1, min(S.CLUSTERS, v.count() // 40))
    return V.knn_ivf(q, v, 10, clusters=clusters, probe=max(1, clusters * S.PROBES // S.CLUSTERS))


@query("mean_pool", "SELECT label AS key, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1, 2")
def _(spark, sf):
    p = V.pooled(vectors(spark, sf).select(F.col("category").alias("key"), "vec"))
    return p.select("key", F.posexplode("vec").alias("d", "m")).withColumn("m", F.round("m", 6))


@query("weighted_mean_vec", "SELECT label AS key, CAST(d AS INTEGER) AS d, round(sum(w * x) / sum(w), 6) AS m FROM (SELECT label, 1.0::DOUBLE / (1 + vec_id) AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1, 2")
def _(spark, sf):
    items = vectors(spark, sf).select(F.col("category").alias("key"), "vec", (F.lit(1.0) / (1 + F.col("id"))).alias("weight"))
    return V.pooled(items, "weight").select("key", F.posexplode("vec").alias("d", "m")).withColumn("m", F.round("m", 6))


@query("hist_embed_sim", """WITH h AS (SELECT label AS user_id, vec_id, CAST(embedding AS DOUBLE[]) AS e, power(0.9, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1) AS w FROM embeddings),
m AS (SELECT user_id, d, sum(w * x) / sum(w) AS m FROM (SELECT user_id, w, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM h) GROUP BY 1, 2),
u AS (SELECT user_id, list(m ORDER BY d) AS u FROM m GROUP BY 1)
SELECT vec_id AS id, round(list_cosine_similarity(e, u), 6) AS sim FROM h JOIN u USING (user_id)""")
def _(spark, sf):
    w = W.partitionBy("category").orderBy(F.desc("id"))
    items = vectors(spark, sf).withColumn("weight", F.pow(F.lit(0.9), F.row_number().over(w) - 1.0))
    users = V.pooled(items.select(F.col("category").alias("key"), "vec", "weight"), "weight").withColumnRenamed("vec", "u")
    return items.join(users, items.category == users.key).select("id", F.round(cosine(F.col("vec"), F.col("u")), 6).alias("sim"))


@query("word2vec_train")
def _(spark, sf):
    return V.word2vec(articles(spark, sf), "article_id", "text_lexical").select("id", "vec")


# BM25

BM25_SQL = f"""tk AS (SELECT doc_id AS id, unnest({TOKENS_SQL}) AS term FROM documents),
tc AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2),
nd AS (SELECT count(*) AS n_docs FROM documents),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n_docs FROM nd) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tc GROUP BY 1 HAVING count(*) >= 2),
kn AS (SELECT tc.*, idf FROM tc JOIN idf USING (term)),
dl AS (SELECT id, sum(tf) AS dl FROM kn GROUP BY 1),
av AS (SELECT sum(dl) / (SELECT n_docs FROM nd)::DOUBLE AS avgdl FROM dl),
po AS (SELECT term, id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM kn JOIN dl USING (id), av),
qk AS (SELECT item_id AS query, unnest({TOKENS_SQL}) AS term FROM benchmark),
qc AS (SELECT query, term, count(*) AS qtf FROM qk GROUP BY 1, 2),
bs AS (SELECT query, id, sum(qtf * w) AS score FROM qc JOIN po USING (term) GROUP BY 1, 2)"""


def bm25(spark, sf):
    docs = table(spark, sf, "documents")
    counts = V.term_counts(docs, "doc_id", "text")
    idf = V.bm25_idf(counts, docs)
    return V.bm25_postings(counts, idf), V.term_counts(table(spark, sf, "benchmark"), "item_id", "text")


@query("bm25_idf", f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return V.bm25_idf(V.term_counts(docs, "doc_id", "text"), docs).select("term", "df", r6("idf"))


@query("bm25_doc_weight", f"WITH {BM25_SQL} SELECT id, round(sum(w), 4) AS weight FROM po GROUP BY 1")
def _(spark, sf):
    return bm25(spark, sf)[0].groupBy("id").agg(F.round(F.sum("w"), 4).alias("weight"))


@query("bm25_topk", f"WITH {BM25_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM bs) SELECT query, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 20")
def _(spark, sf):
    postings, q = bm25(spark, sf)
    return V.top_k(V.bm25_scores(q, postings), 20).withColumn("score", F.round("score", 6))


@query("bm25_candidates", f"WITH {BM25_SQL}, c AS (SELECT item_id AS query, d.doc_id AS id FROM benchmark JOIN documents d ON d.doc_id % 40 = item_id % 40) SELECT query, id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN bs USING (query, id)")
def _(spark, sf):
    postings, q = bm25(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 40).alias("k")).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("k")), "k").drop("k")
    return V.bm25_candidate_scores(asked, q, postings).withColumn("score", F.round("score", 6))


# Features, models, reports

FEATURE_SQL = IC + f""",
pos1 AS (SELECT impression_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, impression_id) AS p FROM (SELECT DISTINCT impression_id, user_id, ts FROM {{0}})),
pos2 AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, impression_id ROWS UNBOUNDED PRECEDING) AS k FROM pos1),
pos3 AS (SELECT impression_id, CAST(row_number() OVER (PARTITION BY user_id, k ORDER BY ts, impression_id) - 1 AS INTEGER) AS session_position FROM pos2),
hl AS (SELECT DISTINCT user_id, n FROM hist), us AS (SELECT user_id, max(n_known) AS n_known, max(total_weight) AS total_weight FROM prof GROUP BY 1),
med AS (SELECT quantile_cont({HOURS_SQL.format('ts', 'first_ts')}, 0.5) AS med FROM fit JOIN seen USING (candidate_id)),
ft AS (SELECT r.impression_id, r.user_id, r.candidate_id, r.label, coalesce(hl.n, 0) AS hist_len,
    coalesce(pr.cnt / us.n_known::DOUBLE, 0) AS hist_category_match_frac, coalesce(pr.weight / us.total_weight, 0) AS hist_category_match_recency, session_position,
    ln(1 + greatest(coalesce(clicks, 0) - {{1}}, 0)) AS popularity_log,
    coalesce({HOURS_SQL.format('r.ts', 'first_ts')}, med, 0) AS freshness_hours_raw,
    CAST(coalesce(a.p_brand = top_category, false) AS INTEGER) AS category_match, r.pos AS candidate_position,
    r.pos / greatest(count(*) OVER (PARTITION BY r.impression_id) - 1, 1)::DOUBLE AS candidate_position_norm
  FROM {{0}} r LEFT JOIN hl USING (user_id) LEFT JOIN us USING (user_id) LEFT JOIN topcat USING (user_id) LEFT JOIN part a ON a.p_partkey = r.candidate_id
    LEFT JOIN prof pr ON pr.user_id = r.user_id AND pr.category = a.p_brand LEFT JOIN pop ON pop.candidate_id = r.candidate_id LEFT JOIN seen ON seen.candidate_id = r.candidate_id
    LEFT JOIN pos3 ON pos3.impression_id = r.impression_id, med)"""
VAL_SQL, TRAIN_SQL = FEATURE_SQL.format("tune", "0"), FEATURE_SQL.format("fit", "CASE WHEN r.label = 1 THEN 1 ELSE 0 END")
ROUNDED = ("hist_category_match_frac", "hist_category_match_recency", "popularity_log", "freshness_hours", "freshness_hours_raw", "candidate_position_norm")


def feature_rows(spark, sf, mode: str) -> DataFrame:
    _, fit, tune = parted(spark, sf)
    return FT.feature_table(fit if mode == "train" else tune, fit, articles(spark, sf), mode)


@query("feature_table", f"""WITH {VAL_SQL} SELECT impression_id, user_id, candidate_id, label, hist_len, round(hist_category_match_frac, 6) AS hist_category_match_frac,
round(hist_category_match_recency, 6) AS hist_category_match_recency, session_position, round(popularity_log, 6) AS popularity_log, round(greatest(freshness_hours_raw, 0), 6) AS freshness_hours,
round(freshness_hours_raw, 6) AS freshness_hours_raw, category_match, candidate_position, round(candidate_position_norm, 6) AS candidate_position_norm FROM ft""")
def _(spark, sf):
    return feature_rows(spark, sf, "val").withColumns({c: F.round(c, 6) for c in ROUNDED})


FUSED_SQL = f"""{FEATURE_SQL.split(",\npos1 AS")[0]},
us_ AS (SELECT DISTINCT user_id FROM tune), imps AS (SELECT DISTINCT impression_id, user_id, ts FROM tune),
qt AS (SELECT t.user_id AS id, string_agg(coalesce(p_name, ''), ' ' ORDER BY idx) AS text FROM tail t JOIN us_ USING (user_id) LEFT JOIN part ON p_partkey = article_id GROUP BY 1),
atk AS (SELECT p_partkey AS id, unnest({TOKENS_SQL.replace('(text', '(p_name')}) AS term FROM part), atc AS (SELECT id, term, count(*) AS tf FROM atk GROUP BY 1, 2),
aidf AS (SELECT term, ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM atc GROUP BY 1 HAVING count(*) >= 2),
akn AS (SELECT atc.*, idf FROM atc JOIN aidf USING (term)), adl AS (SELECT id, sum(tf) AS dl FROM akn GROUP BY 1), aav AS (SELECT sum(dl) / (SELECT count(*) FROM part)::DOUBLE AS avgdl FROM adl),
apo AS (SELECT term, id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM akn JOIN adl USING (id), aav),
aqc AS (SELECT id AS query, term, count(*) AS qtf FROM (SELECT id, unnest({TOKENS_SQL}) AS term FROM qt) GROUP BY 1, 2),
abs_ AS (SELECT query, id, sum(qtf * w) AS score FROM aqc JOIN apo USING (term) GROUP BY 1, 2),
lex AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS place FROM abs_),
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
hv AS (SELECT user_id, idx, n, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM tail JOIN vec ON vec.id = article_id),
mv AS (SELECT user_id, list(m ORDER BY d) AS u FROM (SELECT user_id, d, avg(x) AS m FROM hv JOIN us_ USING (user_id) GROUP BY 1, 2) GROUP BY 1),
wv AS (SELECT user_id, list(m ORDER BY d) AS u FROM (SELECT user_id, d, sum(power(0.9, n - 1 - idx) * x) / sum(power(0.9, n - 1 - idx)) AS m FROM hv GROUP BY 1, 2) GROUP BY 1),
ner AS (SELECT user_id AS query, id, row_number() OVER (PARTITION BY user_id ORDER BY round(list_cosine_similarity(u, e), 9) DESC, id) AS place FROM mv, vec),
fl AS (SELECT query, id AS item, min(CASE WHEN c = 0 THEN place ELSE 1000 + place END) AS f FROM (SELECT query, id, place, 0 AS c FROM lex WHERE place <= {S.POOL_SIZE} UNION ALL SELECT query, id, place, 1 FROM ner WHERE place <= {S.POOL_SIZE}) GROUP BY 1, 2),
fp AS (SELECT query AS user_id, item, row_number() OVER (PARTITION BY query ORDER BY f, item) - 1 AS pos FROM fl),
own AS (SELECT impression_id, item, pos FROM imps JOIN fp USING (user_id)), szz AS (SELECT impression_id, count(*) AS n FROM own GROUP BY 1),
mis AS (SELECT t.impression_id, t.candidate_id AS item FROM tune t WHERE t.label = 1 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.impression_id = t.impression_id AND o.item = t.candidate_id)),
alls AS (SELECT impression_id, item, pos::DOUBLE AS spot FROM own UNION ALL SELECT impression_id, item, floor({md5_sql('impression_id', 'item', S.SEED)} * (n + 1)) - 0.5 FROM mis JOIN szz USING (impression_id)),
fin AS (SELECT impression_id, item AS candidate_id, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY spot, item) - 1 AS INTEGER) AS pos FROM alls),
fused AS (SELECT f.impression_id, i.user_id, i.ts, f.candidate_id, f.pos, CAST(coalesce(t.label, 0) AS INTEGER) AS label FROM fin f JOIN imps i USING (impression_id) LEFT JOIN tune t ON t.impression_id = f.impression_id AND t.candidate_id = f.candidate_id),
eng AS (SELECT user_id, avg(value) AS rd, avg(CASE WHEN event_id % 7 <> 0 THEN value / 2 END) AS sc FROM events WHERE event_type = 'click' GROUP BY 1),
pos1 AS{FEATURE_SQL.split(",\npos1 AS")[1].format("fused", "0").replace("{{", "{").replace("}}", "}")}"""


@query("feature_table_fused", f"""WITH {FUSED_SQL} SELECT ft.impression_id, ft.user_id, ft.candidate_id, ft.label, hist_len, round(hist_category_match_frac, 6) AS hist_category_match_frac,
round(hist_category_match_recency, 6) AS hist_category_match_recency, session_position, round(popularity_log, 6) AS popularity_log, round(greatest(freshness_hours_raw, 0), 6) AS freshness_hours,
round(freshness_hours_raw, 6) AS freshness_hours_raw, category_match, candidate_position, round(candidate_position_norm, 6) AS candidate_position_norm,
round(coalesce(list_cosine_similarity(u, e), 0), 6) AS hist_embed_sim, round(coalesce(rd, 0), 6) AS user_avg_read_time, round(coalesce(sc, 0), 6) AS user_avg_scroll_pct
FROM ft LEFT JOIN wv ON wv.user_id = ft.user_id LEFT JOIN vec ON vec.id = ft.candidate_id LEFT JOIN eng ON eng.user_id = ft.user_id""")
def _(spark, sf):
    """The later part's impressions over the fused pool of 100 + 100 with positives put in; all features."""
    _, fit, tune = parted(spark, sf)
    vecs = vectors(spark, sf).select("id", "vec")
    engagement = clicks(spark, sf).select("user_id", "read_time", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("read_time") / 2).alias("scroll"))
    ft = FT.fused_features(tune, fit, articles(spark, sf), vecs, engagement)
    return ft.withColumns({c: F.round(c, 6) for c in (*ROUNDED, "hist_embed_sim", "user_avg_read_time", "user_avg_scroll_pct")})


@query("popularity_log_loo", f"WITH {TRAIN_SQL} SELECT impression_id, candidate_id, round(popularity_log, 6) AS popularity_log FROM ft")
def _(spark, sf):
    return feature_rows(spark, sf, "train").select("impression_id", "candidate_id", r6("popularity_log"))


@query("freshness_clamped", f"WITH {VAL_SQL} SELECT impression_id, candidate_id, round(greatest(freshness_hours_raw, 0), 6) AS freshness_hours FROM ft")
def _(spark, sf):
    return feature_rows(spark, sf, "val").select("impression_id", "candidate_id", r6("freshness_hours"))


@query("leak_checks", f"""WITH {VAL_SQL}
SELECT 'candidate_lists' AS rule, count(*) AS violations FROM ic WHERE label NOT IN (0, 1) OR pos < 0
UNION ALL SELECT 'cutoff_order', count(*) FROM (SELECT max(ts) AS a FROM fit) x, (SELECT min(ts) AS b FROM tune) y WHERE a > b
UNION ALL SELECT 'empty_history_neutral', count(*) FROM ft WHERE hist_len = 0 AND (hist_category_match_frac <> 0 OR hist_category_match_recency <> 0)
UNION ALL SELECT 'fit_tune_partition', count(*) FROM (SELECT DISTINCT impression_id FROM ic EXCEPT (SELECT impression_id FROM fit UNION SELECT impression_id FROM tune))
UNION ALL SELECT 'fit_tune_overlap', count(*) FROM (SELECT impression_id FROM fit INTERSECT SELECT impression_id FROM tune)
UNION ALL SELECT 'first_seen_after_impression', count(*) FROM fit JOIN seen USING (candidate_id) WHERE first_ts > ts
UNION ALL SELECT 'negative_freshness_share', CAST(count(*) AS BIGINT) FROM ft WHERE freshness_hours_raw < 0
UNION ALL SELECT 'session_starts_at_zero', count(*) FROM (SELECT user_id FROM ft GROUP BY 1 HAVING min(session_position) <> 0)""")
def _(spark, sf):
    rows, fit, tune = parted(spark, sf)
    ft = written(FT.feature_table(tune, fit, articles(spark, sf), "val"), "leak-features")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    ends = fit.agg(F.max("ts").alias("a")).crossJoin(tune.agg(F.min("ts").alias("b"))).filter("a > b")
    whole = rows.select("impression_id").distinct().exceptAll(fit.select("impression_id").distinct().unionAll(tune.select("impression_id").distinct()))
    empty = ft.filter("hist_len = 0 and (hist_category_match_frac <> 0 or hist_category_match_recency <> 0)")
    starts = ft.groupBy("user_id").agg(F.min("session_position").alias("m")).filter("m <> 0")
    bad = rows.filter("label not in (0, 1) or pos < 0")
    both = fit.select("impression_id").intersect(tune.select("impression_id"))
    late = fit.join(R.first_seen(fit), "candidate_id").filter("first_ts > ts")
    found = {"candidate_lists": bad, "cutoff_order": ends, "empty_history_neutral": empty, "fit_tune_partition": whole, "fit_tune_overlap": both, "first_seen_after_impression": late, "negative_freshness_share": ft.filter("freshness_hours_raw < 0"), "session_starts_at_zero": starts}
    out = None
    for name, df in found.items():
        out = n(df, name) if out is None else out.unionByName(n(df, name))
    return out


@query("paired_delta", f"WITH {SCORED}, o AS (SELECT impression_id, sum(label / (pos + 1.0::DOUBLE)) / sum(label)::DOUBLE AS mrr FROM tune GROUP BY 1 HAVING sum(label) > 0) SELECT count(*) AS n, round(avg(met.mrr - o.mrr), 6) AS delta FROM met JOIN o USING (impression_id)")
def _(spark, sf):
    s = tune_scored(spark, sf).withColumn("other", -F.col("pos").cast("double"))
    a = R.impression_metrics(s).select("impression_id", F.col("mrr").alias("a"))
    b = R.impression_metrics(s, "other").select("impression_id", F.col("mrr").alias("b"))
    return a.join(b, "impression_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"))


POISSON_EDGES = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]


def poisson_sql(share: str) -> str:
    return "CASE " + " ".join(f"WHEN {share} < {edge!r} THEN {k}" for k, edge in enumerate(POISSON_EDGES)) + " ELSE 8 END"


ROUND_SHARE = f"(('0x' || substr(md5(concat_ws(':', CAST(impression_id AS VARCHAR), CAST(b // 4 AS VARCHAR), '{S.SEED}')), CAST(1 + 8 * (b % 4) AS BIGINT), 8))::BIGINT / 4294967296.0::DOUBLE)"
BOOT_SQL = f"bt AS (SELECT m.*, b, {poisson_sql(ROUND_SHARE)} AS w FROM {{0}} m, generate_series(0, {S.ROUNDS - 1}) r(b))"


@query("bootstrap_ci", f"WITH {SCORED}, ml AS (SELECT impression_id, mrr AS x FROM met), {BOOT_SQL.format('ml')}, bm AS (SELECT b, sum(w * x) / sum(w) AS m FROM bt WHERE w > 0 GROUP BY 1) SELECT (SELECT count(*) FROM ml) AS n, round((SELECT avg(x) FROM ml), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM bm")
def _(spark, sf):
    return R.bootstrap(R.impression_metrics(tune_scored(spark, sf)), [], "mrr").select("n", r6("mean"), r6("ci_low"), r6("ci_high"))


@query("paired_bootstrap", f"""WITH {SCORED}, om AS (SELECT impression_id, sum(label / (pos + 1.0::DOUBLE)) / sum(label)::DOUBLE AS mrr FROM tune GROUP BY 1 HAVING sum(label) > 0),
ml AS (SELECT impression_id, met.mrr - om.mrr AS x FROM met JOIN om USING (impression_id)), {BOOT_SQL.format('ml')}, bm AS (SELECT b, sum(w * x) / sum(w) AS m FROM bt WHERE w > 0 GROUP BY 1),
ci AS (SELECT quantile_cont(m, 0.025) AS a, quantile_cont(m, 0.975) AS z FROM bm)
SELECT 'mrr' AS metric, (SELECT count(*) FROM ml) AS n, round((SELECT avg(x) FROM ml), 6) AS delta, round(a, 6) AS ci_low, round(z, 6) AS ci_high, a > 0 OR z < 0 AS excludes_zero FROM ci""")
def _(spark, sf):
    s = tune_scored(spark, sf).withColumn("other", -F.col("pos").cast("double"))
    found = R.paired_bootstrap(R.impression_metrics(s), R.impression_metrics(s, "other")).filter("metric = 'mrr'")
    return found.select("metric", "n", r6("delta"), r6("ci_low"), r6("ci_high"), "excludes_zero")


@query("bootstrap_coverage", f"""WITH {SCORED}, tp AS (SELECT impression_id, candidate_id FROM rk WHERE place <= 3), nc AS (SELECT count(*)::DOUBLE AS catalog FROM part),
dr AS (SELECT r, count(DISTINCT candidate_id) AS f FROM tp, generate_series(0, 199) g(r) WHERE {md5_sql('impression_id', 'r', S.SEED)} < {1 - 2.718281828459045**-1!r} GROUP BY 1)
SELECT round((SELECT count(DISTINCT candidate_id) FROM tp) / catalog, 6) AS mean, round(quantile_cont(f, 0.025) / catalog, 6) AS ci_low, round(quantile_cont(f, 0.975) / catalog, 6) AS ci_high FROM dr, nc GROUP BY catalog""")
def _(spark, sf):
    found = R.bootstrap_coverage(top_three(spark, sf), table(spark, sf, "part").agg(F.count(F.lit(1)).alias("catalog")))
    return found.select(r6("mean"), r6("ci_low"), r6("ci_high"))


@query("gbt_train_score")
def _(spark, sf):
    train, test = feature_rows(spark, sf, "train"), feature_rows(spark, sf, "val")
    return FT.scored(FT.train_ranker(train, FT.FEATURES), test, FT.FEATURES).select("impression_id", "candidate_id", "score")


@query("ablation_incremental")
def _(spark, sf):
    return FT.incremental(feature_rows(spark, sf, "train"), feature_rows(spark, sf, "val"))


@query("position_removal")
def _(spark, sf):
    return FT.without_position(feature_rows(spark, sf, "train"), feature_rows(spark, sf, "val"))


LATENCY_SQL = "lat AS (SELECT avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max_ms, min(value) AS min_ms FROM events)"


@query("latency_percentiles", f"WITH {LATENCY_SQL} SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "p50", "p95", "p99", "max_ms", "min_ms")) + " FROM lat")
def _(spark, sf):
    report = FT.latency_report(table(spark, sf, "events"), "value")
    return report.select(*[r6(c) for c in report.columns])


@query("cost_qps", f"WITH {LATENCY_SQL} SELECT round(1000.0::DOUBLE / mean, 6) AS qps, round((0.05::DOUBLE / 3600) / (1000.0::DOUBLE / mean) * 1000, 9) AS cost_per_1000, CAST(ceil(1000.0::DOUBLE / (1000.0::DOUBLE / mean)) AS BIGINT) AS cores FROM lat")
def _(spark, sf):
    report = FT.cost_report(FT.latency_report(table(spark, sf, "events"), "value"))
    return report.select(r6("qps"), F.round("cost_per_1000", 9).alias("cost_per_1000"), "cores")


# More sources, sinks, filters, joins and reports, each over the standard tables


def roundtrip(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@query("sink_parquet", "SELECT p_partkey AS article_id, p_name AS text_lexical, p_brand AS category FROM part")
def _(spark, sf):
    return roundtrip(articles(spark, sf), "articles")


@query("sink_rank_lines", f"WITH {SCORED} SELECT impression_id || ' [' || string_agg(CAST(place AS VARCHAR), ',' ORDER BY pos) || ']' AS value FROM rk GROUP BY impression_id")
def _(spark, sf):
    path = new_path(spark, "lines")
    readers.write_rank_lines(R.rank_lines(tune_scored(spark, sf)), path)
    return spark.read.text(path)


@query("sink_json_report", f"WITH {SCORED} SELECT count(*) AS n, round(avg(mrr), 6) AS mrr FROM met")
def _(spark, sf):
    path = new_path(spark, "report")
    readers.write_report(R.impression_metrics(tune_scored(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mrr"), 6).alias("mrr")), path)
    return spark.read.schema("n long, mrr double").json(path)


@query("scan_history_lengths", f"WITH {IC} SELECT user_id, max(n) AS n FROM hist GROUP BY 1")
def _(spark, sf):
    return roundtrip(R.click_history(parted(spark, sf)[1]).groupBy("user_id").agg(F.max("n").alias("n")), "history").select("user_id", "n")


@query("scan_publish_times", "SELECT l_partkey AS article_id, min(l_shipdate) AS published_time FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Of two files the first one's row counts."""
    times = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("article_id")).agg(F.min("l_shipdate").alias("published_time"))
    one, two = new_path(spark, "publish-times"), new_path(spark, "publish-times")
    times.write.parquet(one)
    times.withColumn("published_time", F.lit(None).cast("timestamp_ntz")).write.parquet(two)
    return readers.parquet_publish_times(spark, one, two)


@query("scan_vectors", "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def _(spark, sf):
    return vectors(spark, sf).select("id", F.size("vec").alias("dim"))


@query("filter_positives", f"WITH {IC} SELECT impression_id, candidate_id FROM ic WHERE label = 1")
def _(spark, sf):
    return impressions(spark, sf).filter("label = 1").select("impression_id", "candidate_id")


@query("filter_valid_impression", f"WITH {IC} SELECT impression_id, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n FROM ic GROUP BY 1 HAVING sum(label) > 0 AND sum(label) < count(*)")
def _(spark, sf):
    return impressions(spark, sf).groupBy("impression_id").agg(F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n")).filter("positives > 0 and positives < n")


@query("carve_internal_validation", f"WITH {IC} SELECT impression_id, 'fit' AS part FROM fit GROUP BY 1 UNION ALL SELECT impression_id, 'tune' FROM tune GROUP BY 1")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    return fit.select("impression_id").distinct().withColumn("part", F.lit("fit")).unionByName(tune.select("impression_id").distinct().withColumn("part", F.lit("tune")))


@query("union_partition_check", f"WITH {IC}, both_ AS (SELECT impression_id, candidate_id FROM fit UNION ALL SELECT impression_id, candidate_id FROM tune) SELECT (SELECT count(*) FROM (SELECT impression_id, candidate_id FROM ic EXCEPT ALL SELECT * FROM both_)) AS missing, (SELECT count(*) FROM (SELECT * FROM both_ EXCEPT ALL SELECT impression_id, candidate_id FROM ic)) AS extra")
def _(spark, sf):
    rows, fit, tune = parted(spark, sf)
    both, whole = fit.select("impression_id", "candidate_id").unionAll(tune.select("impression_id", "candidate_id")), rows.select("impression_id", "candidate_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(whole.exceptAll(both), "missing").crossJoin(n(both.exceptAll(whole), "extra"))


@query("semi_join_clicked", f"WITH {IC} SELECT p_partkey AS article_id FROM part WHERE p_partkey IN (SELECT candidate_id FROM pop)")
def _(spark, sf):
    pop = R.popularity(parted(spark, sf)[1]).select(F.col("candidate_id").alias("article_id"))
    return articles(spark, sf).join(pop, "article_id", "left_semi").select("article_id")


@query("join_popularity", f"WITH {IC} SELECT p_partkey AS article_id, coalesce(clicks, 0) AS clicks FROM part LEFT JOIN pop ON candidate_id = p_partkey")
def _(spark, sf):
    pop = R.popularity(parted(spark, sf)[1]).withColumnRenamed("candidate_id", "article_id")
    return articles(spark, sf).join(pop, "article_id", "left").select("article_id", F.coalesce("clicks", F.lit(0)).alias("clicks"))


@query("topk_prefix10", f"WITH {SCORED} SELECT impression_id, candidate_id FROM rk WHERE place <= 10")
def _(spark, sf):
    return tune_scored(spark, sf).withColumn("place", R.score_rank("score")).filter("place <= 10").select("impression_id", "candidate_id")


@query("sample_rows", f"SELECT o_orderkey FROM orders ORDER BY {md5_sql('o_orderkey', S.SEED)}, o_orderkey LIMIT 200")
def _(spark, sf):
    return FT.sample_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200)


@query("sample_users", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {md5_sql('o_custkey', S.SEED)}, o_custkey LIMIT 50)")
def _(spark, sf):
    return FT.sample_users(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 50)


@query("stratified_holdout", f"WITH {IC} SELECT label, {md5_sql('impression_id', 'label', S.SEED)} < 0.1 AS held, count(*) AS n FROM ic GROUP BY 1, 2")
def _(spark, sf):
    rows = impressions(spark, sf)
    return FT.stratified_holdout(rows, "impression_id", "label").groupBy("label", "held").agg(F.count(F.lit(1)).alias("n"))


@query("query_build", f"""WITH {IC}, txt AS (SELECT user_id, string_agg(coalesce(p_name, ''), ' ' ORDER BY idx) AS query_text FROM tail LEFT JOIN part ON p_partkey = article_id GROUP BY 1),
hv AS (SELECT user_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM tail JOIN embeddings ON vec_id = article_id),
mv AS (SELECT user_id, sum(m * d) AS vec_sum FROM (SELECT user_id, d, avg(x) AS m FROM hv GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, query_text, round(coalesce(vec_sum, 0), 5) AS vec_sum FROM txt LEFT JOIN mv USING (user_id)""")
def _(spark, sf):
    """Each user's query: the window's texts, and its mean vector (here its sum weighted by dimension), zero without vectors."""
    texts, means = FT.user_queries(R.click_history(parted(spark, sf)[1]), articles(spark, sf), vectors(spark, sf))
    total = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return texts.join(means, "user_id", "left").select("user_id", "query_text", F.round(F.coalesce(total, F.lit(0.0)), 5).alias("vec_sum"))


@query("vectors_for", "SELECT p_partkey AS id, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dim FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def _(spark, sf):
    """The articles' vectors; without one, none."""
    return articles(spark, sf).select(F.col("article_id").alias("id")).join(vectors(spark, sf).select("id", "vec"), "id", "left").select("id", F.coalesce(F.size("vec"), F.lit(0)).alias("dim")).withColumn("dim", F.greatest("dim", F.lit(0)))


@query("embed_score_candidates", "SELECT a.vec_id AS query, a.vec_id * 2 AS id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS score FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id * 2")
def _(spark, sf):
    v = vectors(spark, sf)
    asked = v.select(F.col("id").alias("query"), (F.col("id") * 2).alias("id"), F.col("vec").alias("q"))
    return asked.join(v.select("id", "vec"), "id", "left").select("query", "id", F.round(cosine(F.col("q"), F.col("vec")), 6).alias("score"))


@query("rerank_report", f"""WITH {SCORED}, o AS (SELECT impression_id, sum(label / (pos + 1.0::DOUBLE)) / sum(label)::DOUBLE AS mrr FROM tune GROUP BY 1 HAVING sum(label) > 0)
SELECT 'clicks' AS method, round(avg(mrr), 6) AS mean, count(mrr) AS n FROM met UNION ALL SELECT 'given order', round(avg(mrr), 6), count(mrr) FROM o""")
def _(spark, sf):
    s = tune_scored(spark, sf)
    report = FT.rerank_report({"clicks": s, "given order": s.withColumn("score", -F.col("pos").cast("double"))})
    return report.filter("metric = 'mrr'").select("method", F.round("mean", 6).alias("mean"), "n")


@query("rerank_model")
def _(spark, sf):
    """Metrics of the later part's lists by the model, by clicks and as given, in one report."""
    fit, tune, lists = scored_parts(spark, sf)
    model = FT.train_ranker(written(feature_rows(spark, sf, "train"), "train-features"), FT.FEATURES)
    ranked = FT.scored(model, FT.feature_table(tune, fit, articles(spark, sf), "val"), FT.FEATURES)
    return FT.rerank_report({"model": ranked, "clicks": lists, "given order": lists.withColumn("score", -F.col("pos").cast("double"))})


@query("serving_score")
def _(spark, sf):
    _, fit, tune = parted(spark, sf)
    model = FT.train_ranker(feature_rows(spark, sf, "train"), FT.FEATURES)
    return FT.serve(model, tune, fit, articles(spark, sf), FT.FEATURES)


@query("serving_request")
def _(spark, sf):
    """Requests of the users of the later part: retrieval, features and the model's best ten."""
    _, fit, tune = parted(spark, sf)
    model = FT.train_ranker(written(FT.feature_table(fit, fit, articles(spark, sf), "train"), "train-features"), FT.FEATURES)
    return FT.serving_request(model, tune.select("user_id").distinct(), fit, articles(spark, sf), vectors(spark, sf).select("id", "vec"), FT.FEATURES, "2001-08-02 00:00:00")


@query("gbdt_rounds")
def _(spark, sf):
    """How many of the trees asked for the early stop leaves."""
    model = FT.train_ranker(written(feature_rows(spark, sf, "train"), "train-features"), FT.FEATURES)
    return spark.createDataFrame([(S.TREES, FT.rounds_used(model))], "asked int, used int")


@query("feature_columns", "SELECT unnest(['candidate_position', 'candidate_position_norm', 'category_match', 'freshness_hours', 'hist_category_match_frac', 'hist_category_match_recency', 'hist_len', 'popularity_log', 'session_position']) AS name")
def _(spark, sf):
    return spark.createDataFrame([(c,) for c in FT.feature_columns(feature_rows(spark, sf, "val"))], "name string")


@query("sink_parquet_incremental", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    """Chunk after chunk appended to one table, each exactly once."""
    from rankloom.streaming.chunks import append_chunks

    path = new_path(spark, "incremental")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    append_chunks(rows, path, files=5)
    append_chunks(rows, path, files=5)  # a second run after all chunks are in adds nothing
    return spark.read.parquet(path)


@query("sink_zip", f"WITH {SCORED} SELECT impression_id || ' [' || string_agg(CAST(place AS VARCHAR), ',' ORDER BY pos) || ']' AS line FROM rk GROUP BY impression_id")
def _(spark, sf):
    """One zip with one member on the shared store, read back from it."""
    lines, path = new_path(spark, "lines"), new_path(spark, "submission") + ".zip"
    readers.write_rank_lines(R.rank_lines(tune_scored(spark, sf)), lines)
    readers.write_zip(spark, lines, path, "prediction.txt")
    return readers.read_zip(spark, path, "prediction.txt")


@query("ablation_pair")
def _(spark, sf):
    return FT.ablation_pair(feature_rows(spark, sf, "train"), feature_rows(spark, sf, "val"))


@query("sink_model")
def _(spark, sf):
    from pyspark.ml.classification import GBTClassificationModel

    path = new_path(spark, "model")
    FT.train_ranker(feature_rows(spark, sf, "train"), FT.BASE).write().save(path)
    return FT.scored(GBTClassificationModel.load(path), feature_rows(spark, sf, "val"), FT.BASE)


@query("memory_report", f"WITH {BM25_SQL} SELECT 'postings' AS part, count(*) AS rows, count(*) * 12 AS bytes FROM po UNION ALL SELECT 'vectors', count(*), CAST(sum(4 * len(embedding)) AS BIGINT) FROM embeddings UNION ALL SELECT 'articles', count(*), CAST(sum(8 + strlen(p_name) + strlen(p_brand)) AS BIGINT) FROM part")
def _(spark, sf):
    """Rows and bytes of what serving keeps: postings (id and weight), vectors (floats), articles (id and UTF-8 texts)."""
    postings, _q = bm25(spark, sf)
    n = lambda name, df, size: df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).select(F.lit(name).alias("part"), "rows", F.col("bytes").cast("long").alias("bytes"))
    texts = F.lit(8) + F.octet_length("text_lexical") + F.octet_length("category")
    return n("postings", postings, F.lit(12)).unionByName(n("vectors", vectors(spark, sf), F.size("vec") * 4)).unionByName(n("articles", articles(spark, sf), texts))
