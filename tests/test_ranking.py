"""Hand-computed cases of the ranking, history and parsing operators."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import ranking as R
from rankloom.sources import readers

T0 = dt.datetime(2020, 1, 1)


def scored(spark, lists):
    rows = [(i, p, label, float(s)) for i, (labels, scores) in enumerate(lists) for p, (label, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "impression_id long, pos int, label int, score double")


def test_metrics_of_small_lists(spark):
    lists = [([0, 1, 0], [0.1, 0.9, 0.5]), ([1, 0], [1, 1]), ([1, 1], [1, 2]), ([0, 0], [1, 2])]
    got = {r.impression_id: r for r in R.impression_metrics(scored(spark, lists)).collect()}
    assert (got[0].auc, got[0].mrr, got[0].ndcg5) == (1, 1, 1)
    assert (got[1].auc, got[1].mrr) == (0.5, 1)
    assert got[2].auc is None and got[2].mrr == pytest.approx(0.75)
    assert 3 not in got


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3)), min_size=2, max_size=8))
def test_auc_counts_pairs(spark, items):
    labels, scores = zip(*items, strict=True)
    got = R.impression_metrics(scored(spark, [(labels, scores)])).collect()
    pos, neg = [s for y, s in items if y], [s for y, s in items if not y]
    if not pos:
        assert not got
    elif not neg:
        assert got[0].auc is None
    else:
        assert got[0].auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))


def test_session_gap_of_exactly_the_limit_goes_on(spark):
    times = [T0, T0 + dt.timedelta(minutes=30), T0 + dt.timedelta(minutes=60, seconds=1)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id long, id long, ts timestamp_ntz")
    got = R.sessions(df, "user_id", "ts", "id").orderBy("id").collect()
    assert [r.session_position for r in got] == [0, 1, 0]


def test_decay_weights(spark):
    got = spark.range(3).select(R.rank_weight(F.col("id"), F.lit(3)).alias("w")).collect()
    assert [round(r.w, 6) for r in got] == [0.81, 0.9, 1]
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=72)), (T0 + dt.timedelta(hours=5), T0)], "a timestamp_ntz, b timestamp_ntz")
    assert [r.w for r in df.select(R.time_weight(F.col("a"), F.col("b")).alias("w")).collect()] == [0.5, 1]


def test_top_category_tie_takes_the_oldest(spark):
    tail = spark.createDataFrame([(1, 0, 10, 4), (1, 1, 20, 4), (1, 2, 20, 4), (1, 3, 10, 4)], "user_id long, idx int, article_id long, n int")
    articles = spark.createDataFrame([(10, "old"), (20, "new")], "article_id long, category string")
    assert R.top_category(R.category_profile(tail, articles)).collect()[0].top_category == "old"


def test_cutoff_rounds_half_to_even_and_keeps_ties(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(days=i)) for i in range(10)], "impression_id long, ts timestamp_ntz")
    at = R.cutoff(df)
    fit, tune = R.split(df, at)
    assert at.collect()[0].cutoff == T0 + dt.timedelta(days=8) and (fit.count(), tune.count()) == (9, 1)


def test_constant_scores_normalise_to_a_half(spark):
    got = scored(spark, [([0, 1], [3, 3])]).select(R.min_max("score").alias("x")).collect()
    assert [r.x for r in got] == [0.5, 0.5]


def test_parsing(spark):
    df = spark.createDataFrame([("A-1-0 N2-1", None, "11/15/2019 8:55:22 AM")], "i string, h string, t string")
    r = df.select(readers.parse_labelled(F.col("i")).alias("i"), readers.parse_history(F.col("h")).alias("h"), readers.parse_time(F.col("t")).alias("t")).collect()[0]
    assert [(x.candidate_id, x.label) for x in r.i] == [("A-1", 0), ("N2", 1)] and r.h == [] and r.t == dt.datetime(2019, 11, 15, 8, 55, 22)


def test_zip_has_one_member(spark, tmp_path):
    import zipfile

    lines = R.rank_lines(scored(spark, [([0, 1], [1, 2]), ([1], [5])]))
    readers.write_rank_lines(lines.orderBy("impression_id"), str(tmp_path / "lines"))
    readers.write_zip(spark, str(tmp_path / "lines"), str(tmp_path / "out.zip"), "prediction.txt")
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.namelist() == ["prediction.txt"] and sorted(z.read("prediction.txt").decode().split("\n"))[1:] == ["0 [2,1]", "1 [1]"]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(2000).select(F.col("id").alias("impression_id"), (F.col("id") % 10 / 10).alias("v"))
    r = R.bootstrap(df, [], "v", rounds=200).collect()[0]
    assert r.ci_low < r.mean < r.ci_high and r.n == 2000 and r.ci_high - r.ci_low < 0.1


def test_pairwise_diversity_identity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [1.0, 0.0])], "impression_id long, vec array<double>")
    got = {r.impression_id: r.diversity for r in R.diversity(df).collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(0) and 3 not in got and math.isfinite(got[1])


def test_order_statistics_and_quantiles_against_numpy(spark):
    import numpy as np

    from rankloom.operators import ranking as R

    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000), rng.integers(0, 3, 3000).astype(float), np.array([4.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        got = R.quantiles(df, "x", {"a": 0.0, "b": 0.137, "c": 0.5, "d": 0.99, "e": 1.0}).first()
        assert np.allclose(got, np.quantile(values, [0, 0.137, 0.5, 0.99, 1]))
    assert R.quantiles(spark.createDataFrame([], "x double"), "x", {"a": 0.5}).first().a is None


def test_poisson_bootstrap_has_the_spread_of_a_row_bootstrap(spark):
    import numpy as np

    from rankloom.operators import ranking as R

    rng = np.random.default_rng(2)
    x = rng.exponential(size=400)
    got = R.bootstrap(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "impression_id long, x double"), [], "x").first()
    means = [rng.choice(x, 400).mean() for _ in range(2000)]
    want = np.quantile(means, [0.025, 0.975])
    assert got.n == 400 and abs(got.mean - x.mean()) < 1e-9
    assert abs((got.ci_high - got.ci_low) / (want[1] - want[0]) - 1) < 0.15
