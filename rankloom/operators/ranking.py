"""Splits, click statistics, sessions, fusion and ranking metrics over (impression, candidate) rows.

Rows: impression_id, user_id, ts, candidate_id, pos, label. Windows are over impressions, users or items; what is global
is an aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import settings as S
from rankloom.sources.store import written


def md5_share(*parts: Column) -> Column:
    """A number from 0 to 1 (excluded) that the parts name: the first 32 bits of the MD5 of their strings joined by colons.

    Any engine has it, so what is drawn by it is the same everywhere and however the input is split.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def order_statistics(df: DataFrame, column: str, ranks: dict[str, Column], keep_n: bool = False) -> DataFrame:
    """One row: for each name the value of its 0-based rank, an expression of ``n``, the number of non-null values of ``column``; null without values. ``keep_n`` adds n.

    Values are counted and dealt out in ranges, whose sums tell which range holds a rank; only that range's distinct values are put in order.
    So no task orders more than a range, and the input is gone through once.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()), "value-counts")
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    upto = sizes.withColumn("_before", F.sum("_size").over(W.orderBy("_range")) - F.col("_size"))  # one row a range
    n = sizes.agg(F.sum("_size").alias("n"))
    asked = n.select(F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_k")) for name, rank in ranks.items()])).alias("x")).select("x.*")
    held = asked.join(upto, (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_size"))).select("_name", "_k", "_range", "_before")
    inside = ranged.join(F.broadcast(held), "_range").withColumn("_upto", F.sum("_n").over(W.partitionBy("_name").orderBy("_v")) + F.col("_before"))
    found = inside.filter((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k")))
    row = found.agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return row.crossJoin(F.broadcast(n)) if keep_n else row


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the quantile of its share, interpolated between neighbours, null without values; by ``order_statistics``."""
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    found = order_statistics(df, column, {f"{k}_a": F.floor(x) for k, x in at.items()} | {f"{k}_b": F.ceil(x) for k, x in at.items()}, keep_n=True)
    mix = lambda k: F.col(f"{k}_a") + (F.col(f"{k}_b") - F.col(f"{k}_a")) * (at[k] - F.floor(at[k]))
    return found.select(*[mix(k).alias(k) for k in shares])


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def cutoff(impressions: DataFrame, holdout: float = S.HOLDOUT) -> DataFrame:
    """One row (cutoff): the k-th smallest ts, k = clamp(half-even round(n (1 - holdout)), 0, n - 1)."""
    rank = F.least(F.greatest(F.bround(F.col("n") * F.lit(1 - holdout), 0), F.lit(0)), F.col("n") - 1)
    return order_statistics(impressions, "ts", {"cutoff": rank})


def split(df: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and all others (a null time is among these)."""
    both = df.crossJoin(F.broadcast(at))
    early = F.coalesce(F.col("ts") <= F.col("cutoff"), F.lit(False))
    return both.filter(early).drop("cutoff"), both.filter(~early).drop("cutoff")


def popularity(rows: DataFrame) -> DataFrame:
    return rows.filter("label = 1").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("clicks"))


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("candidate_id").agg(F.min("ts").alias("first_ts"))


def sessions(events: DataFrame, user: str, ts: str, tie: str, gap_minutes: int = S.SESSION_GAP_MINUTES) -> DataFrame:
    """Adds session_key (1, 2, ... of a user) and session_position (0-based): a gap over the limit begins a session."""
    w = W.partitionBy(user).orderBy(ts, tie)
    before = F.lag(ts).over(w)
    fresh = (before.isNull() | (micros(F.col(ts)) - micros(before) > gap_minutes * 60_000_000)).cast("int")
    keyed = events.withColumn("_new", fresh).withColumn("session_key", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return keyed.withColumn("session_position", F.row_number().over(W.partitionBy(user, "session_key").orderBy(ts, tie)) - 1)


def click_history(rows: DataFrame) -> DataFrame:
    """(user_id, idx, article_id, ts, n): a user's clicks, oldest first; n is how many."""
    w = W.partitionBy("user_id")
    clicked = rows.filter("label = 1").select("user_id", F.col("candidate_id").alias("article_id"), "ts", "impression_id", "pos")
    order = w.orderBy("ts", "impression_id", "pos")
    return clicked.select("user_id", (F.row_number().over(order) - 1).alias("idx"), "article_id", "ts", F.count(F.lit(1)).over(w).cast("int").alias("n"))


def history_tail(history: DataFrame, window: int = S.HISTORY_WINDOW) -> DataFrame:
    return history.filter(F.col("idx") >= F.col("n") - window)


def rank_weight(idx: Column, n: Column, window: int = S.HISTORY_WINDOW, decay: float = S.RANK_DECAY) -> Column:
    """decay ^ (places from the newest)."""
    return F.pow(F.lit(decay), (n - 1 - idx).cast("double"))


def time_weight(item: Column, reference: Column, half_life: float = S.HALF_LIFE_HOURS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(hours_between(reference, item), F.lit(0.0)) / half_life)


def category_profile(tail: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, category, cnt, weight, first_idx, n_known, total_weight): a user's window by known category."""
    w = W.partitionBy("user_id")
    items = tail.join(articles.select("article_id", "category"), "article_id", "left").withColumn("w", rank_weight(F.col("idx"), F.col("n")))
    items = items.withColumn("total_weight", F.sum("w").over(w))
    known = items.filter("category is not null").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("cnt"), F.sum("w").alias("weight"), F.min("idx").alias("first_idx"), F.first("total_weight").alias("total_weight"))
    return known.withColumn("n_known", F.sum("cnt").over(w))


def top_category(profile: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("cnt"), "first_idx")
    return profile.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("user_id", F.col("category").alias("top_category"))


def min_max(score: str, key: str = "impression_id") -> Column:
    w = W.partitionBy(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, F.lit(0.5)).otherwise((F.col(score) - low) / (high - low))


def hybrid(a: str, b: str) -> Column:
    return 0.5 * min_max(a) + 0.5 * min_max(b)


def score_rank(score: str, key: str = "impression_id") -> Column:
    return F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), "pos"))


def position_norm() -> Column:
    return F.col("pos") / F.greatest(F.count(F.lit(1)).over(W.partitionBy("impression_id")) - 1, F.lit(1)).cast("double")


def rank_lines(scored: DataFrame, score: str = "score") -> DataFrame:
    """(impression_id, line): "id [r1,r2,...]", ranks in the order in which candidates were given; a list of one gives [1]."""
    ranked = scored.withColumn("rank", score_rank(score))
    lists = ranked.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("x"))
    return lists.select("impression_id", F.concat(F.col("impression_id").cast("string"), F.lit(" ["), F.array_join(F.transform("x", lambda x: x["rank"].cast("string")), ","), F.lit("]")).alias("line"))


def pool_concat(lists: DataFrame) -> DataFrame:
    """(query, item, pos) of (query, channel, rank, item): channels one after the other, an item at its first place."""
    first = lists.groupBy("query", "item").agg(F.min(F.struct("channel", "rank")).alias("at"))
    return first.select("query", "item", (F.row_number().over(W.partitionBy("query").orderBy("at", "item")) - 1).alias("pos"))


def pool_with_positives(pool: DataFrame, positives: DataFrame, seed: int = S.SEED) -> DataFrame:
    """(query, item, pos): positives that are missing come in at places that ``md5_share`` of (query, item, seed) names."""
    size = pool.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    missing = positives.join(pool, ["query", "item"], "left_anti").join(size, "query")
    placed = missing.select("query", "item", (F.floor(md5_share(F.col("query"), F.col("item"), F.lit(seed)) * (F.col("n") + 1)) - 0.5).alias("at"))
    both = pool.select("query", "item", F.col("pos").cast("double").alias("at")).unionByName(placed)
    return both.select("query", "item", (F.row_number().over(W.partitionBy("query").orderBy("at", "item")) - 1).alias("pos"))


def impression_metrics(scored: DataFrame, score: str = "score") -> DataFrame:
    """(impression_id, auc, mrr, ndcg5, ndcg10) of impressions with a click; auc is null without both classes.

    One shuffle on the impression: ranks with ties averaged for AUC, ties by position for the others.
    """
    w = W.partitionBy("impression_id")
    ranked = scored.select("impression_id", "label", F.col(score).alias("s"), "pos")
    ranked = ranked.withColumns({
        "place": F.row_number().over(w.orderBy(F.desc("s"), "pos")),
        "ideal": F.row_number().over(w.orderBy(F.desc("label"), "pos")),
        "low": F.rank().over(w.orderBy("s")),
        "ties": F.count(F.lit(1)).over(W.partitionBy("impression_id", "s")),
    })
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    at = lambda place, k: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    p, n = F.sum("label").cast("double"), (F.count(F.lit(1)) - F.sum("label")).cast("double")
    average = F.col("low") + (F.col("ties") - 1) / F.lit(2.0).cast("double")
    return ranked.groupBy("impression_id").agg(
        F.when((p > 0) & (n > 0), (F.sum(average * F.col("label")) - p * (p + 1) / 2) / (p * n)).alias("auc"),
        (F.sum(F.col("label") / F.col("place").cast("double")) / p).alias("mrr"),
        (at("place", 5) / at("ideal", 5)).alias("ndcg5"),
        (at("place", 10) / at("ideal", 10)).alias("ndcg10"),
        F.sum("label").alias("_p"),
    ).filter("_p > 0").drop("_p")


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """(by..., metric, mean, n): long form, nulls left out."""
    names = ["auc", "mrr", "ndcg5", "ndcg10"]
    long = metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("x")).select(*by, "x.metric", "x.value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def hit_rate(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hit_rate, n) of (impression_id, place from 1, label): share of impressions with a click that have one in the top k."""
    per = ranked.filter("label = 1").groupBy("impression_id").agg(F.min("place").alias("best"))
    return per.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "best").groupBy("k").agg(F.avg((F.col("best") <= F.col("k")).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def novelty(lists: DataFrame, clicks: DataFrame, catalog: int | DataFrame) -> DataFrame:
    """(impression_id, novelty): mean -log2((clicks + 1) / (all clicks + catalog)) of its items."""
    total = clicks.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("all_clicks")).crossJoin(catalog if isinstance(catalog, DataFrame) else clicks.sparkSession.createDataFrame([(catalog,)], "catalog long"))
    rows = lists.join(clicks, "candidate_id", "left").crossJoin(F.broadcast(total))
    p = (F.coalesce("clicks", F.lit(0)) + 1) / (F.col("all_clicks") + F.col("catalog")).cast("double")
    return rows.groupBy("impression_id").agg(F.avg(-F.log2(p)).alias("novelty"))


def diversity(items: DataFrame) -> DataFrame:
    """(impression_id, diversity) of (impression_id, vec), unit length taken here: 1 - mean cosine of pairs; lists of two or more.

    By |sum of v|^2 - sum of |v|^2, so no pairs are made: one aggregate for each dimension.
    """
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = items.select("impression_id", F.transform("vec", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0))).alias("u"))
    dims = unit.select("impression_id", F.posexplode("u").alias("d", "x")).groupBy("impression_id", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    per = dims.groupBy("impression_id").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return per.filter("n >= 2").select("impression_id", (1 - (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1)).cast("double")).alias("diversity"))


def poisson_edges(most: int = 8) -> list[str]:
    """For 0, 1, ... of a Poisson(1) count: the eight hex digits below which 32 random bits stand for so many or fewer."""
    total, p, out = 0.0, 2.718281828459045**-1, []
    for k in range(most):
        total += p
        out.append(f"{math.ceil(total * (1 << 32)):08x}")
        p /= k + 1
    return out


def poisson_weight(digits: Column) -> Column:
    """The Poisson(1) count that eight hex digits name: digits compare as strings, no number is made of them."""
    weight = F.lit(8)
    for k, edge in reversed(list(enumerate(poisson_edges()))):
        weight = F.when(digits < edge, F.lit(k)).otherwise(weight)
    return weight


def bootstrap(values: DataFrame, by: list[str], column: str, rounds: int = S.ROUNDS, seed: int = S.SEED, level: float = 0.95) -> DataFrame:
    """(by..., n, mean, ci_low, ci_high): a Poisson bootstrap of the mean over rows (by..., impression_id, column), nulls left out.

    In each round an impression counts a Poisson(1) number of times, the same for all its rows (so differences are paired): a quarter of the MD5 of
    "impression:round // 4:seed" names it. Sums are taken before the shuffle: a task sends one row for each round and group.
    """
    some = values.filter(F.col(column).isNotNull()).select(*by, "impression_id", F.col(column).cast("double").alias("_x"))
    four = some.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 4))))
    four = four.withColumn("_h", F.md5(F.concat_ws(":", F.col("impression_id").cast("string"), F.col("_q").cast("string"), F.lit(str(seed)))))
    draws = F.inline(F.array(*[F.struct((F.col("_q") * 4 + i).alias("_b"), F.substring("_h", 8 * i + 1, 8).alias("_d")) for i in range(4)]))
    drawn = four.select(*by, "_x", draws).filter((F.col("_b") < rounds) & (F.col("_d") >= poisson_edges()[0])).withColumn("_w", poisson_weight(F.col("_d")))
    means = drawn.groupBy(*by, "_b").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1 - tail)).alias("ci_high"))
    whole = some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    return (whole.join(ends, by, "left") if by else whole.crossJoin(ends)).select(*by, "n", "mean", "ci_low", "ci_high")


def paired_bootstrap(one: DataFrame, other: DataFrame, rounds: int = S.ROUNDS, seed: int = S.SEED) -> DataFrame:
    """(metric, n, delta, ci_low, ci_high, excludes_zero) of two systems' ``impression_metrics``, paired by impression."""
    both = one.alias("a").join(other.alias("b"), "impression_id")
    names = ("auc", "mrr", "ndcg5", "ndcg10")
    long = both.select("impression_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"a.{m}") - F.col(f"b.{m}")).alias("d")) for m in names])).alias("x")).select("impression_id", "x.*")
    found = bootstrap(long, ["metric"], "d", rounds, seed).withColumnRenamed("mean", "delta")
    return found.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def bootstrap_coverage(lists: DataFrame, catalog: DataFrame, rounds: int = 200, seed: int = S.SEED) -> DataFrame:
    """(mean, ci_low, ci_high): share of the one-row ``catalog`` (catalog) recommended; replicates leave out about 37 % of impressions, so the interval lies low.

    An item is in a replicate if any of its impressions has a Poisson weight above 0: an or over bits of the replicates,
    62 to a long, aggregated before the shuffle.
    """
    bits, drawn_in = 62, 1 - 2.718281828459045**-1
    words = -(-rounds // bits)
    word = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(min(bits, rounds - i * bits) - 1)), F.lit(0).cast("long"), lambda s, b: s + F.when(md5_share(F.col("impression_id"), b + i * bits, F.lit(seed)) < drawn_in, F.pow(F.lit(2.0), b).cast("long")).otherwise(F.lit(0).cast("long")))
    drawn = lists.select("candidate_id", *[word(i).alias(f"w{i}") for i in range(words)])
    kept = drawn.groupBy("candidate_id").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(words)])
    flags = [F.sum(F.shiftrightunsigned(f"w{r // bits}", r % bits).bitwiseAND(F.lit(1))) for r in range(rounds)]
    row = kept.agg(F.count(F.lit(1)).alias("items"), F.array(*flags).alias("found")).crossJoin(F.broadcast(catalog.withColumn("catalog", F.col("catalog").cast("double"))))
    share = row.select((F.col("items") / F.col("catalog")).alias("mean"), "catalog", F.explode("found").alias("f"))
    return share.groupBy("mean", "catalog").agg(F.percentile("f", F.lit(0.025)).alias("a"), F.percentile("f", F.lit(0.975)).alias("b")).select("mean", (F.col("a") / F.col("catalog")).alias("ci_low"), (F.col("b") / F.col("catalog")).alias("ci_high"))
