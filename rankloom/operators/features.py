"""The feature table, the boosted-tree ranker, ablations and the serving reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import settings as S
from rankloom.functions.vectors import cosine
from rankloom.operators import ranking as R
from rankloom.operators import retrieval as V
from rankloom.sources.store import written

BASE = ["hist_len", "popularity_log", "candidate_position_norm"]
GROUPS = {
    "history": ["hist_category_match_frac", "hist_category_match_recency"],
    "session_and_freshness": ["session_position", "freshness_hours"],
    "category": ["category_match"],
}
FEATURES = [*BASE, *[c for g in GROUPS.values() for c in g]]
POSITION = ["candidate_position", "candidate_position_norm"]


def feature_table(rows: DataFrame, train: DataFrame, articles: DataFrame, mode: str, vectors: DataFrame | None = None, engagement: DataFrame | None = None) -> DataFrame:
    """One row an (impression, candidate) of ``rows``; histories, clicks and first sightings come from ``train`` alone.

    mode "train": a click does not count towards its own item's popularity; "val", "serving": nothing is taken off. Serving
    has no labels to look at and clamps freshness like the others. With ``vectors`` (id, vec) there is hist_embed_sim, the cosine of
    the candidate and the user's weighted mean, 0 where either is missing; with ``engagement`` (user_id, read_time, scroll) there are user_avg_read_time
    and user_avg_scroll_pct, means without nulls and NaN, 0 without any.
    """
    history = R.click_history(train)
    profile = R.category_profile(R.history_tail(history), articles)
    users = history.groupBy("user_id").agg(F.max("n").alias("hist_len"))
    top = R.top_category(profile)
    whole = profile.groupBy("user_id").agg(F.max("n_known").alias("n_known"), F.max("total_weight").alias("total_weight"))
    seen = R.first_seen(train)
    raw = R.hours_between(F.col("ts"), F.col("first_ts"))
    median = R.quantiles(train.join(seen, "candidate_id").select(raw.alias("hours")), "hours", {"median_freshness": 0.5})
    impressions = rows.select("impression_id", "user_id", "ts").distinct()
    positions = R.sessions(impressions, "user_id", "ts", "impression_id").select("impression_id", "session_position")
    out = rows.join(users, "user_id", "left").join(whole, "user_id", "left").join(top, "user_id", "left")
    out = out.join(articles.select(F.col("article_id").alias("candidate_id"), "category"), "candidate_id", "left")
    out = out.join(profile.select("user_id", "category", "cnt", "weight"), ["user_id", "category"], "left")
    out = out.join(R.popularity(train), "candidate_id", "left").join(seen, "candidate_id", "left").join(positions, "impression_id", "left").crossJoin(F.broadcast(median))
    own = F.when(F.col("label") == 1, 1).otherwise(0) if mode == "train" else F.lit(0)
    more = []
    if vectors is not None:
        # vectors meet in the pairs that have both, once each, so that no row carries them
        pairs = rows.select("user_id", "candidate_id").distinct().join(vectors.select(F.col("id").alias("candidate_id"), "vec"), "candidate_id").join(user_vectors(history, vectors), "user_id")
        out = out.join(pairs.select("user_id", "candidate_id", cosine(F.col("vec"), F.col("user_vec")).alias("_sim")), ["user_id", "candidate_id"], "left")
        more.append(F.coalesce("_sim", F.lit(0.0)).alias("hist_embed_sim"))
    if engagement is not None:
        out = out.join(engagement_means(engagement), "user_id", "left")
        more += [F.coalesce("_read", F.lit(0.0)).alias("user_avg_read_time"), F.coalesce("_scroll", F.lit(0.0)).alias("user_avg_scroll_pct")]
    return _features(out, raw, own, R.position_norm(), more)


def _features(out: DataFrame, raw: Column, own: Column, norm: Column, more: list[Column]) -> DataFrame:
    """The columns of a feature table from what was looked up for its rows."""
    fresh = F.coalesce(raw, F.col("median_freshness"), F.lit(0.0))
    return out.select(
        "impression_id", "user_id", "candidate_id", "label",
        F.coalesce("hist_len", F.lit(0)).alias("hist_len"),
        F.coalesce(F.col("cnt") / F.col("n_known").cast("double"), F.lit(0.0)).alias("hist_category_match_frac"),
        F.coalesce(F.col("weight") / F.col("total_weight"), F.lit(0.0)).alias("hist_category_match_recency"),
        F.col("session_position"),
        F.log1p(F.greatest(F.coalesce("clicks", F.lit(0)) - own, F.lit(0)).cast("double")).alias("popularity_log"),
        F.greatest(fresh, F.lit(0.0)).alias("freshness_hours"), fresh.alias("freshness_hours_raw"),
        F.coalesce((F.col("category") == F.col("top_category")).cast("int"), F.lit(0)).alias("category_match"),
        F.col("pos").alias("candidate_position"), norm.alias("candidate_position_norm"), *more,
    )


def engagement_means(engagement: DataFrame) -> DataFrame:
    """(user_id, _read, _scroll): means without nulls and NaN."""
    real = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return engagement.groupBy("user_id").agg(real("read_time").alias("_read"), real("scroll").alias("_scroll"))


def user_vectors(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, user_vec): mean of the vectors of a user's window, weighted by rank; users without any are left out."""
    tail = R.history_tail(history).select("user_id", F.col("article_id").alias("id"), R.rank_weight(F.col("idx"), F.col("n")).alias("weight"))
    items = tail.join(vectors.select("id", "vec"), "id").select(F.col("user_id").alias("key"), "vec", "weight")
    return V.pooled(items, "weight").select(F.col("key").alias("user_id"), F.col("vec").alias("user_vec"))


def user_queries(history: DataFrame, articles: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a user's window: (user_id, query_text), its articles' texts, oldest first; (user_id, vec), the plain mean of their vectors, missing without any."""
    tail = R.history_tail(history).select("user_id", "idx", "article_id")
    lists = tail.join(articles, "article_id", "left").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text_lexical", F.lit("")).alias("t")))).alias("x"))
    texts = lists.select("user_id", F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("query_text"))
    means = V.pooled(tail.join(vectors.select(F.col("id").alias("article_id"), "vec"), "article_id").select(F.col("user_id").alias("key"), "vec")).withColumnRenamed("key", "user_id")
    return texts, means


def fused_pool(users: DataFrame, history: DataFrame, articles: DataFrame, vectors: DataFrame, k: int = S.POOL_SIZE) -> DataFrame:
    """Written table (query, item, pos): for each user of ``users`` the best ``k`` articles by BM25 of the history's texts, then the best ``k`` by cosine with
    its mean vector, each article at its first place. A user without history has no list of either kind.
    """
    texts, means = user_queries(history.join(users, "user_id", "left_semi"), articles, vectors)
    lexical = V.text_top_k(V.term_counts(texts, "user_id", "query_text"), articles.select("article_id", "text_lexical"), "article_id", "text_lexical", k)
    near = V.knn_exact(V.unit(means.select(F.col("user_id").alias("id"), "vec")).withColumnRenamed("id", "query"), V.unit(vectors), k)
    lists = lexical.select("query", F.lit(0).alias("channel"), F.col("place").alias("rank"), F.col("id").alias("item"))
    lists = lists.unionByName(near.select("query", F.lit(1).alias("channel"), F.col("place").alias("rank"), F.col("id").alias("item")))
    return written(R.pool_concat(lists), "fused-pool")


def fused_features(rows: DataFrame, train: DataFrame, articles: DataFrame, vectors: DataFrame, engagement: DataFrame, k: int = S.POOL_SIZE) -> DataFrame:
    """``feature_table`` in mode "val", with vectors and engagement, of the impressions of ``rows`` over their users' ``fused_pool``, each impression's positives put in
    where they are missing, at the places of ``pool_with_positives``.

    There are up to 2 ``k`` rows an impression, so none is shuffled or written before the result: what belongs to an item comes with the texts that hold it, what belongs to a
    user comes once, pools are arrays of a user, and they become rows last of all. Only impressions, queries and distinct texts are dealt out.
    """
    history = written(R.click_history(train), "history")
    stats = train.groupBy("candidate_id").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("clicks"), F.min("ts").alias("first_ts"))
    items = written(articles.select(F.col("article_id").alias("id"), "category").join(stats.withColumnRenamed("candidate_id", "id"), "id", "full"), "items")
    item = F.struct("id", "category", "clicks", "first_ts").alias("item")
    raw = R.hours_between(F.col("ts"), F.col("first_ts"))
    times = train.select("candidate_id", "ts").join(items.select(F.col("id").alias("candidate_id"), "first_ts"), "candidate_id")
    median = written(R.quantiles(times.select(raw.alias("hours")), "hours", {"median_freshness": 0.5}), "median")

    impressions = rows.select("impression_id", "user_id", "ts").distinct()
    positives = rows.filter("label = 1").select("impression_id", "user_id", F.col("candidate_id").alias("id")).distinct()
    given = positives.join(items, "id", "left").groupBy("impression_id").agg(F.collect_list(item).alias("positives"))
    asked = R.sessions(impressions, "user_id", "ts", "impression_id").join(given, "impression_id", "left")
    asked = written(asked.select("impression_id", "user_id", "ts", "session_position", F.coalesce("positives", F.array().cast(given.schema["positives"].dataType)).alias("positives")), "asked")

    own = written(history.join(asked.select("user_id").distinct(), "user_id", "left_semi"), "own-history")
    texts, means = user_queries(own, articles, vectors)
    lexical, members = V.text_groups(V.term_counts(texts, "user_id", "query_text"), articles.select("article_id", "text_lexical"), "article_id", "text_lexical", k)
    near = V.knn_exact(V.unit(means.select(F.col("user_id").alias("id"), "vec")).withColumnRenamed("id", "query"), V.unit(vectors), k)
    near = written(near.select(F.col("query").alias("user_id"), "id", "place"), "near")

    # a cosine for each user and item that both have a vector
    seen = members.join(vectors.select("id"), "id", "left_semi")
    mine = written(user_vectors(own, vectors), "user-vectors")
    pairs = lexical.select(F.col("query").alias("user_id"), "rep").join(mine.select("user_id"), "user_id", "left_semi").join(seen, "rep").select("user_id", "id")
    pairs = pairs.unionByName(near.select("user_id", "id")).unionByName(positives.select("user_id", "id")).distinct()
    pairs = pairs.join(vectors.select("id", "vec"), "id").join(mine, "user_id").select("user_id", F.struct("id", cosine(F.col("vec"), F.col("user_vec"))).alias("x"))
    sims = pairs.groupBy("user_id").agg(F.map_from_entries(F.collect_list("x")).alias("sims"))

    profile = written(R.category_profile(R.history_tail(own), articles), "profile")
    known = profile.groupBy("user_id").agg(F.max("n_known").alias("n_known"), F.max("total_weight").alias("total_weight"), F.map_from_entries(F.collect_list(F.struct("category", F.struct("cnt", "weight")))).alias("cats"))
    about = own.groupBy("user_id").agg(F.max("n").alias("hist_len")).join(known, "user_id", "left").join(R.top_category(profile), "user_id", "left")
    about = written(about.join(engagement_means(engagement), "user_id", "left").join(sims, "user_id", "left"), "about-users")

    # all by user and so many parts that a part's pools fit in memory; joins of the user's rows then need no further exchange
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), asked.count() // 4096)
    held = written(members.join(items, "id", "left").groupBy("rep").agg(F.collect_list(item).alias("held")), "text-items")
    scored = F.transform("held", lambda x: F.struct((-F.round("score", 9)).alias("s"), x["id"].alias("id"), x.alias("item")))
    first = lexical.repartition(parts, "query").join(held, "rep").select("query", scored.alias("x")).groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    second = near.join(items, "id", "left").repartition(parts, "user_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", item))).alias("y"))
    out = asked.repartition(parts, "user_id").join(first.select(F.col("query").alias("user_id"), "x"), "user_id", "left").join(second, "user_id", "left").join(about, "user_id", "left")
    none = F.array().cast(given.schema["positives"].dataType)
    more = F.when(F.col("y").isNull(), none).when(F.col("x").isNull(), F.col("y.item")).otherwise(F.filter("y.item", lambda e: ~F.array_contains(F.col("x.id"), e["id"])))
    out = out.withColumn("list", F.concat(F.coalesce(F.col("x.item"), none), more)).drop("x", "y").filter(F.size("list") > 0)
    out = out.withColumn("missing", F.filter("positives", lambda e: ~F.array_contains(F.col("list.id"), e["id"])))
    spot = lambda at, e: F.struct(at.cast("double").alias("at"), e["id"].alias("id"), e.alias("item"))
    placed = F.transform("missing", lambda e: spot(F.floor(R.md5_share(F.col("impression_id"), e["id"], F.lit(S.SEED)) * (F.size("list") + 1)) - 0.5, e))
    whole = F.sort_array(F.concat(F.transform("list", lambda e, i: spot(i, e)), placed))["item"]
    out = out.withColumn("list", F.when(F.size("missing") == 0, F.col("list")).otherwise(whole)).withColumn("_clicked", F.col("positives.id")).drop("missing", "positives")
    out = out.withColumn("_n", F.size("list")).select("*", F.posexplode("list").alias("pos", "item")).drop("list").select("*", F.col("item.id").alias("candidate_id"), "item.category", "item.clicks", "item.first_ts")
    out = out.withColumn("label", F.array_contains("_clicked", F.col("candidate_id")).cast("int")).crossJoin(F.broadcast(median))
    mine_of = F.try_element_at("cats", F.col("category"))
    out = out.withColumn("cnt", mine_of["cnt"]).withColumn("weight", mine_of["weight"])
    norm = F.col("pos") / F.greatest(F.col("_n") - 1, F.lit(1)).cast("double")
    return _features(out, raw, F.lit(0), norm, [F.coalesce(F.try_element_at("sims", F.col("candidate_id")), F.lit(0.0)).alias("hist_embed_sim"), F.coalesce("_read", F.lit(0.0)).alias("user_avg_read_time"), F.coalesce("_scroll", F.lit(0.0)).alias("user_avg_scroll_pct")])


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.fillna(0.0, columns))


def train_ranker(train: DataFrame, columns: list[str], trees: int = S.TREES, seed: int = S.SEED):
    """Boosted trees with a tenth of each label held out by hash for early stopping.

    No L2 term and no patience as in other libraries: it stops where the held-out loss no longer falls.
    """
    from pyspark.ml.classification import GBTClassifier

    held = F.pmod(F.xxhash64("impression_id", "candidate_id", F.lit(seed)), F.lit(10)) == 0
    data = matrix(train, columns).select("features", "label", held.alias("_held")).persist(StorageLevel.MEMORY_AND_DISK)  # every tree level reads it
    try:
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, stepSize=S.RATE, maxDepth=S.DEPTH, maxBins=256, seed=seed, validationIndicatorCol="_held").fit(data)
    finally:
        data.unpersist()


def scored(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """(impression_id, candidate_id, pos, label, score)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(matrix(df, columns))
    return out.select("impression_id", "candidate_id", F.col("candidate_position").alias("pos"), "label", vector_to_array("probability")[1].alias("score"))


def staged(train: DataFrame, test: DataFrame, stages: dict[str, list[str]], trees: int) -> dict[str, DataFrame]:
    """Written impression metrics of a model for each stage's columns."""
    train, test = written(train, "stage-train"), written(test, "stage-test")
    return {name: written(R.impression_metrics(scored(train_ranker(train, columns, trees), test, columns)), "stage-metrics") for name, columns in stages.items()}


def incremental(train: DataFrame, test: DataFrame, trees: int = S.TREES, rounds: int = S.ROUNDS) -> DataFrame:
    """(stage, metric, mean, n, delta, ci_low, ci_high, excludes_zero): a group of columns more at each stage, with the paired difference from the one before."""
    stages, columns = {"base": list(BASE)}, list(BASE)
    for name, more in GROUPS.items():
        columns = [*columns, *more]
        stages[f"+{name}"] = columns
    found = staged(train, test, stages, trees)
    names, out = list(found), None
    for i, name in enumerate(names):
        one = R.summary(found[name]).select(F.lit(name).alias("stage"), "metric", "mean", "n")
        gain = R.paired_bootstrap(found[name], found[names[max(i - 1, 0)]], rounds).select("metric", "delta", "ci_low", "ci_high", "excludes_zero")
        one = one.join(gain, "metric", "left").select("stage", "metric", "mean", "n", "delta", "ci_low", "ci_high", "excludes_zero")
        out = one if out is None else out.unionByName(one)
    return out


def without_position(train: DataFrame, test: DataFrame, trees: int = S.TREES, most: float = 0.05) -> DataFrame:
    """(auc_with, auc_without, gap, flagged)."""
    found = staged(train, test, {"with": FEATURES, "without": [c for c in FEATURES if c not in POSITION]}, trees)
    row = found["with"].agg(F.avg("auc").alias("auc_with")).crossJoin(found["without"].agg(F.avg("auc").alias("auc_without")))
    return row.withColumn("gap", F.col("auc_with") - F.col("auc_without")).withColumn("flagged", F.abs("gap") > most)


def latency_report(timings: DataFrame, ms: str) -> DataFrame:
    ends = R.quantiles(timings, ms, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return timings.agg(F.avg(ms).alias("mean"), F.max(ms).alias("max_ms"), F.min(ms).alias("min_ms")).crossJoin(ends).select("mean", "p50", "p95", "p99", "max_ms", "min_ms")


def cost_report(report: DataFrame, price_per_hour: float = 0.05, target_qps: float = 1000.0) -> DataFrame:
    qps = F.lit(1000.0) / F.col("mean")
    return report.select(qps.alias("qps"), (F.lit(price_per_hour / 3600.0) / qps * 1000.0).alias("cost_per_1000"), F.ceil(F.lit(target_qps) / qps).alias("cores"))


def feature_columns(df: DataFrame) -> list[str]:
    """All columns of a feature table that a model may read."""
    return [c for c in df.columns if c not in {"impression_id", "user_id", "candidate_id", "label", "freshness_hours_raw"}]


def sample_rows(df: DataFrame, key: str, n: int, seed: int = S.SEED) -> DataFrame:
    """A sampling operator: the n rows of least ``md5_share`` of their key, the same on every run and however the input is split."""
    return df.orderBy(R.md5_share(F.col(key), F.lit(seed)), key).limit(n)


def sample_users(df: DataFrame, user: str, n: int, seed: int = S.SEED) -> DataFrame:
    """A sampling operator: all rows of n users, those of least ``md5_share``; null users are never drawn."""
    return df.join(sample_rows(df.filter(F.col(user).isNotNull()).select(user).distinct(), user, n, seed), user, "left_semi")


def stratified_holdout(df: DataFrame, key: str, label: str, share: float = 0.1, seed: int = S.SEED) -> DataFrame:
    """Adds ``held``: about ``share`` of each label's rows, by ``md5_share``."""
    return df.withColumn("held", R.md5_share(F.col(key), F.col(label), F.lit(seed)) < share)


def serve(model, rows: DataFrame, train: DataFrame, articles: DataFrame, columns: list[str]) -> DataFrame:
    """(impression_id, line): the given lists scored with features in serving mode, as rank lines."""
    return R.rank_lines(scored(model, feature_table(rows, train, articles, "serving"), columns))


def ablation_pair(train: DataFrame, test: DataFrame, trees: int = S.TREES, rounds: int = S.ROUNDS) -> DataFrame:
    """(metric, n, delta, ci_low, ci_high, excludes_zero): the full model's metrics less those of the base features, paired by impression."""
    found = staged(train, test, {"full": FEATURES, "base": BASE}, trees)
    return R.paired_bootstrap(found["full"], found["base"], rounds)


def rounds_used(model) -> int:
    """How many trees the early stop left."""
    return model.getNumTrees


def serving_request(model, users: DataFrame, train: DataFrame, articles: DataFrame, vectors: DataFrame, columns: list[str], at: str, k: int = S.POOL_SIZE // 2, top: int = 10) -> DataFrame:
    """(user_id, candidate_id, place): requests from start to end at the time ``at``: each user's fused pool of k + k, features, the model's score, the best ``top``."""
    pool = fused_pool(users, R.click_history(train), articles, vectors, k)
    rows = pool.select(F.col("query").alias("impression_id"), F.col("query").alias("user_id"), F.to_timestamp_ntz(F.lit(at)).alias("ts"), F.col("item").alias("candidate_id"), "pos", F.lit(0).alias("label"))
    ranked = scored(model, feature_table(rows, train, articles, "serving", vectors), columns).withColumn("place", F.row_number().over(W.partitionBy("impression_id").orderBy(F.desc("score"), "pos")))
    return ranked.filter(F.col("place") <= top).select(F.col("impression_id").alias("user_id"), "candidate_id", "place")


def rerank_report(lists: dict[str, DataFrame]) -> DataFrame:
    """(method, metric, mean, n) of scored lists by method, in one plan."""
    out = None
    for name, one in lists.items():
        part = R.summary(R.impression_metrics(one)).select(F.lit(name).alias("method"), "metric", "mean", "n")
        out = part if out is None else out.unionByName(part)
    return out
