"""BM25 and vector retrieval as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import settings as S
from rankloom.functions.text import is_term, normalised, raw_tokens, tokens
from rankloom.functions.vectors import dot
from rankloom.sources.store import written


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table (id, term, tf): texts are normalised and cut into terms once, whatever is worked out from the counts."""
    rows = normalised(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    terms = rows.select("id", F.explode(raw_tokens(F.col("text"))).alias("term")).filter(is_term(F.col("term")))
    return written(terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")


def bm25_idf(counts: DataFrame, docs: DataFrame, min_df: int = S.MIN_DF, copies: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) of terms in ``min_df`` documents or more; all documents count, empty ones too. An id of ``copies`` (id, copies) stands for so many."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    rows, times = (counts, F.count(F.lit(1))) if copies is None else (counts.join(copies, "id"), F.sum("copies"))
    df = rows.groupBy("term").agg(times.alias("df")).filter(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "n_docs")


def bm25_postings(counts: DataFrame, idf: DataFrame, k1: float = S.BM25_K1, b: float = S.BM25_B, copies: DataFrame | None = None) -> DataFrame:
    """Written table (term, id, w): lengths and their mean count terms of the vocabulary only. An id of ``copies`` (id, copies) stands for so many."""
    known = written(counts.join(idf.select("term", "idf", "n_docs"), "term"), "known-terms")
    lengths = known.groupBy("id").agg(F.sum("tf").alias("dl"))
    whole, times = (known, F.col("tf")) if copies is None else (known.join(copies, "id"), F.col("tf") * F.col("copies"))
    mean = whole.agg((F.sum(times) / F.first("n_docs").cast("double")).alias("avgdl"))
    rows = known.join(lengths, "id").crossJoin(F.broadcast(mean))
    tf = F.col("tf").cast("double")
    return written(rows.select("term", "id", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w")), "postings")


def bm25_scores(query_counts: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, id, score): sum of query term frequency x weight, an equi-join on the term with partial sums before the shuffle."""
    q = query_counts.select(F.col("id").alias("query"), "term", F.col("tf").alias("qtf"))
    return q.join(postings, "term").groupBy("query", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def bm25_candidate_scores(candidates: DataFrame, query_counts: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, id, score) of given ``candidates`` (query, id) alone, 0 without a common term: their terms are looked up, nothing else is scored."""
    q = query_counts.select(F.col("id").alias("query"), "term", F.col("tf").alias("qtf"))
    found = candidates.join(q, "query").join(postings, ["term", "id"]).groupBy("query", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))
    return candidates.join(found, ["query", "id"], "left").select("query", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Best k of each query, ties in the ``digits``-th decimal by id; the planner limits each group before the shuffle."""
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "id")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def unit(vectors: DataFrame) -> DataFrame:
    """(id, vec) at unit length, the norm 1e-9 at least."""
    size = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-9))
    return vectors.select("id", F.transform("vec", lambda x: x.cast("double") / size).alias("vec"))


def text_groups(query_counts: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Written (query, rep, score) of the distinct texts that hold any of the best ``k`` of all ``docs`` by BM25, and written (rep, id), the ids that can be among these.

    Each distinct text is scored once. Of equal texts the ``k`` least ids can be among the best, and a text can where fewer than ``k`` such ids have better ones.
    Queries are dealt out before they are scored, so where the postings are small enough to be broadcast no score is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = written(rows.groupBy("text").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct-texts")
    copies = texts.select(F.col("rep").alias("id"), "copies")
    counts = term_counts(texts, "rep", "text")
    scores = bm25_scores(query_counts.repartition("id"), bm25_postings(counts, bm25_idf(counts, docs, copies=copies), copies=copies))
    kept = F.least(F.col("copies"), F.lit(k))
    better = F.sum("_m").over(W.partitionBy("query").orderBy(F.desc("_s"))) - F.sum("_m").over(W.partitionBy("query", "_s"))
    near = scores.join(copies, "id").select("query", F.col("id").alias("rep"), "score", F.round("score", 9).alias("_s"), kept.alias("_m"))
    near = near.withColumn("_better", better).filter(F.col("_better") < k).select("query", "rep", "score")
    members = rows.join(texts.select("text", "rep"), "text").select("rep", "id")
    members = members.withColumn("_n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("_n") <= k).select("rep", "id")
    return written(near, "near-texts"), written(members, "text-members")


def text_top_k(query_counts: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(query, id, place): the best ``k`` of all ``docs`` by BM25, as ``top_k`` of ``bm25_scores`` has them, by ``text_groups``."""
    near, members = text_groups(query_counts, docs, id_col, text_col, k)
    return top_k(near.join(members, "rep").select("query", "id", "score"), k).select("query", "id", "place")


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, block: int = S.QUERY_BLOCK, rows: int = 16384) -> DataFrame:
    """(query, id, score, place): all of ``queries`` (query, vec), a stated set, against all ``vectors`` (id, vec), ties in the ninth decimal by id.

    Both are dealt out in blocks by a hash, of about ``block`` queries and ``rows`` vectors at most; each pair of blocks is a group of one job, which keeps the best k
    of its own.
    """
    import numpy as np
    import pyarrow as pa

    n, m = queries.count(), vectors.count()
    of_queries = max(1, -(-n // block), min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), n // 512))
    of_vectors = max(1, -(-m // rows))

    def dealt(df: DataFrame, key: str, own: str, number: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(number)).alias(own)
        return df.select(F.col(key).cast("long").alias(key), F.transform("vec", lambda x: x.cast("double")).alias("vec"), mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t: np.asarray(t.column("vec").combine_chunks().flatten()).reshape(t.num_rows, -1)
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            names, ids = np.asarray(left.column("query")), np.asarray(right.column("id"))
            asked, given = matrix(left), matrix(right).T
            for at in range(0, len(names), 512):
                score = np.round(asked[at : at + 512] @ given, 9)
                if len(ids) > k:
                    query, place = np.nonzero(score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None])  # with all ties of the k-th
                else:
                    query, place = (x.ravel() for x in np.indices(score.shape))
                found = score[query, place]
                order = np.lexsort((ids[place], -found, query))
                query, place, found = query[order], place[order], found[order]
                heads = np.searchsorted(query, np.arange(len(score)))
                best = np.arange(len(query)) - heads[query] < k
                out.append((names[at : at + 512][query[best]], ids[place[best]], found[best]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], names=["query", "id", "score"])

    one = dealt(queries, "query", "_q", of_queries, "_v", of_vectors).groupBy("_q", "_v")
    two = dealt(vectors, "id", "_v", of_vectors, "_q", of_queries).groupBy("_q", "_v")
    return top_k(one.cogroup(two).applyInArrow(run, "query long, id long, score double"), k)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int, clusters: int, probe: int, seed: int = S.SEED) -> DataFrame:
    """Top k by equi-joins on the nearest of ``clusters`` centroids, exact inside: first the ``probe`` nearest of a query, then every
    other that could hold a better one than the k-th found, by the angles to the centroid of the query and of its farthest member.

    ``queries`` and ``vectors`` have unit length, so that angles obey the triangle inequality and no neighbour is lost.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    model = KMeans(k=clusters, seed=seed, featuresCol="f").fit(vectors.select(array_to_vector("vec").alias("f")))
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = unit(spark.createDataFrame(found, "id int, vec array<double>")).withColumnRenamed("id", "cluster").withColumnRenamed("vec", "centre")
    near = lambda df, key: df.crossJoin(F.broadcast(centres)).withColumn("_c", dot(F.col("vec"), F.col("centre"))).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_c"), "cluster"))).select(key, "vec", "cluster", "_c", "_n")
    angle = lambda c: F.acos(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(-1.0)))
    asked = written(near(queries, "query").withColumnRenamed("vec", "qvec"), "asked")
    members = written(near(vectors, "id").filter("_n = 1").select("id", "vec", "cluster", F.col("_c").alias("_m")), "members")
    scores = lambda q: q.select("query", "qvec", "cluster").join(members, "cluster").select("query", "id", dot(F.col("qvec"), F.col("vec")).alias("score"))
    first = written(top_k(scores(asked.filter(F.col("_n") <= probe)), k).select("query", "id", "score"), "nearest")
    worst = first.groupBy("query").agg(F.min("score").alias("_worst"), F.count(F.lit(1)).alias("_found"))
    reach = members.groupBy("cluster").agg(F.min("_m").alias("_m"))
    best = F.cos(F.greatest(angle("_c") - angle("_m"), F.lit(0.0)))
    more = asked.filter(F.col("_n") > probe).join(F.broadcast(reach), "cluster").join(worst, "query", "left")
    more = more.filter(F.col("_found").isNull() | (F.col("_found") < k) | (best >= F.col("_worst") - 1e-6))
    return top_k(first.unionByName(scores(more)), k)


def pooled(items: DataFrame, weight: str | None = None) -> DataFrame:
    """(key, vec): mean of (key, vec) or weighted mean of (key, vec, weight), dimension by dimension."""
    w = F.col(weight) if weight else F.lit(1.0)
    dims = items.select("key", w.alias("w"), F.posexplode("vec").alias("d", "x")).groupBy("key", "d").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return dims.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("vec"))


def word2vec(docs: DataFrame, id_col: str, text_col: str, dim: int = S.W2V_DIM, window: int = S.W2V_WINDOW, min_count: int = S.W2V_MIN_COUNT, epochs: int = S.W2V_EPOCHS, seed: int = S.SEED, part_rows: int = 100_000) -> DataFrame:
    """(id, vec): skip-gram vectors of known tokens, averaged; documents without any get the mean of all.

    Trained in one part for every ``part_rows`` documents, whose vectors are averaged after each epoch.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = written(normalised(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", tokens(F.col("text")).alias("terms")), "terms")
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=max(1, rows.count() // part_rows), inputCol="terms", outputCol="v").fit(rows)
    words = model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
    found = pooled(rows.select(F.col("id").alias("key"), F.explode("terms").alias("term")).join(words, "term").select("key", "vec")).withColumnRenamed("key", "id")
    mean = pooled(found.select(F.lit(0).alias("key"), "vec")).select(F.col("vec").alias("mean"))
    return rows.select("id").join(found, "id", "left").crossJoin(F.broadcast(mean)).select("id", F.coalesce("vec", "mean").alias("vec"))
