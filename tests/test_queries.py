"""Every query that has SQL gives the same rows as DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from rankloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def canonical(rows):
    show = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    pick = [names.index(c) for c in columns]
    assert canonical([r[c] for c in columns] for r in got.collect()) == canonical([r[i] for i in pick] for r in want.fetchall())


def test_word_vectors_are_whole_and_the_same_twice(spark):
    rows = QUERIES["word2vec_train"](spark, SF).collect()
    assert {len(r.vec) for r in rows} == {128} and len(rows) == len({r.id for r in rows})


def test_clustered_search_has_the_required_recall(spark):
    exact = {(r.query, r.id) for r in QUERIES["knn_exact_topk"](spark, SF).collect()}
    near = {(r.query, r.id) for r in QUERIES["knn_ivf"](spark, SF).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_blocks_of_queries_find_the_same_neighbours(spark):
    from rankloom.operators import retrieval as V
    from rankloom.plans.fixtures import vectors

    v = V.unit(vectors(spark, SF))
    q = v.filter("id % 50 = 0").selectExpr("id as query", "vec")
    found = [sorted((r.query, r.place, r.id) for r in V.knn_exact(q, v, 5, block=b).collect()) for b in (4096, 3)]
    assert found[0] == found[1] and V.knn_exact(q.limit(0), v, 5).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from rankloom.__main__ import STAGES, main

    assert {q for names in STAGES.values() for q in names} <= QUERIES.keys()
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", "popularity_train", "--data", SF, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(f"{tmp_path}/popularity_train").count() == QUERIES["popularity_train"](spark, SF).count()
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "--data", SF])


def test_a_stream_counts_each_batch_once(spark, tmp_path):
    from rankloom.streaming.chunks import append_chunks, in_batches

    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    sums = in_batches(spark, df, lambda b: b.groupBy("k").count(), files=3)
    assert {r.k: r["sum(count)"] for r in sums.groupBy("k").sum("count").collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
    for _ in range(2):
        append_chunks(df, f"{tmp_path}/t", files=3)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_equal_texts_are_scored_once_and_ranked_as_all(spark, monkeypatch):
    from rankloom.operators import retrieval as V

    texts = ["red bolt", "red ring", "old bolt", "red red ring", None, "", "tin", "tin cup cup"]
    docs = spark.createDataFrame([((i * 37) % 160, texts[i % 8]) for i in range(160)], "id long, text string")
    asked = spark.createDataFrame([(1, "red bolt ring"), (2, "cup"), (3, "bolt"), (4, "none"), (5, "red bolt old ring tin cup")], "id long, text string")
    counts, wanted = V.term_counts(docs, "id", "text"), V.term_counts(asked, "id", "text")
    every = V.bm25_scores(wanted, V.bm25_postings(counts, V.bm25_idf(counts, docs)))
    scored, scores = [], V.bm25_scores
    monkeypatch.setattr(V, "bm25_scores", lambda q, p: scored.append(p.select("id").distinct().count()) or scores(q, p))
    for k in (1, 7, 25, 200):
        want = sorted((r.query, r.place, r.id) for r in V.top_k(every, k).collect())
        assert sorted((r.query, r.place, r.id) for r in V.text_top_k(wanted, docs, "id", "text", k).collect()) == want
    assert max(scored) <= 6


def test_exact_search_is_one_job_however_many_blocks(spark, monkeypatch):
    import numpy as np

    from rankloom.operators import retrieval as V

    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 4)), 1)
    v = spark.createDataFrame([(i, x) for i, x in enumerate(vectors.tolist())], "id long, vec array<double>")
    q = v.filter("id % 2 = 0").withColumnRenamed("id", "query")
    monkeypatch.setattr(V, "written", lambda *a: pytest.fail("a pass for each block"))
    want = sorted((i, p + 1, int(j)) for i in range(0, 90, 2) for p, j in enumerate(np.lexsort((np.arange(90), -np.round(vectors[i] @ vectors.T, 9)))[:6]))
    for block, rows in ((4096, 16384), (7, 16384), (7, 11)):
        assert sorted((r.query, r.place, r.id) for r in V.knn_exact(q, v, 6, block=block, rows=rows).collect()) == want


def test_a_request_scores_each_text_once_and_splits_once(spark, monkeypatch):
    from rankloom import settings
    from rankloom.operators import retrieval as V
    from rankloom.plans import catalog

    parted, scores, calls, scored = catalog.parted, V.bm25_scores, [], []
    monkeypatch.setattr(settings, "TREES", 2)
    monkeypatch.setattr(catalog, "parted", lambda *a: calls.append(a) or parted(*a))
    monkeypatch.setattr(V, "bm25_scores", lambda q, p: scored.append(p.select("id").distinct().count()) or scores(q, p))
    found = QUERIES["serving_request"](spark, SF)
    assert found.count() > 0 and len(calls) == 1
    texts = spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().count()
    assert 0 < scored[0] <= texts < spark.read.parquet(f"{SF}/part.parquet").count()


def test_fused_rows_are_neither_shuffled_nor_written_before_the_result(spark, monkeypatch):
    from rankloom.operators import features as FT
    from rankloom.operators import retrieval as V
    from rankloom.plans.catalog import articles, clicks, parted, vectors

    kept, tables = [], []
    for module in (FT, V):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: kept.append(name) or tables.append(f(df, name)) or tables[-1])
    found = QUERIES["feature_table_fused"](spark, SF)
    rows = found.count()
    assert rows > 30_000
    assert max(t.count() for t in tables) < rows / 2
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    text = plan[plan.index("AdaptiveSparkPlan") :]
    assert text.count("Generate") == 1 and "Exchange" not in text[: text.index("Generate")].replace("BroadcastExchange", "")
    # impressions with positives of their own, without clicks, and of users without history; few places, so lists are cut
    _, fit, tune = parted(spark, SF)
    events = clicks(spark, SF).selectExpr("user_id", "read_time", "read_time as scroll")
    few = FT.fused_features(tune, fit, articles(spark, SF), vectors(spark, SF).select("id", "vec"), events, k=3)
    pool = FT.fused_pool(tune.select("user_id").distinct(), FT.R.click_history(fit), articles(spark, SF), vectors(spark, SF).select("id", "vec"), k=3)
    asked = tune.select("impression_id", "user_id").distinct()
    clicked = tune.filter("label = 1").selectExpr("impression_id as query", "candidate_id as item").distinct()
    want = FT.R.pool_with_positives(asked.withColumnRenamed("user_id", "query").join(pool, "query").selectExpr("impression_id as query", "item", "pos"), clicked)
    got = sorted((r.impression_id, r.candidate_position, r.candidate_id) for r in few.collect())
    assert got == sorted((r.query, r.pos, r.item) for r in want.collect()) and got
