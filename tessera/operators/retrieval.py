"""Retrieval: BM25 and dense vectors, fused by reciprocal ranks, with quality and topic adjustments.

All operators take a table of questions (``qid`` and more) and answer all of them at once. The questions go to
every task, which is why there may be at most 10,000 of them at a time; the corpus is never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import spread
from .graph import few


def term_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``term``, ``df``, ``dl``: in how many documents each term is, and in the row of the null term how many documents there are and how long they
    are together. One pass; to be stored for many questions."""
    base = spread(docs.select(text_col)).select(tokens(F.col(text_col)).alias("t")).where("t IS NOT NULL")
    of_term = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("dl")))
    of_all = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("t").alias("dl")))
    return base.select(F.inline_outer(F.concat(of_term, of_all))).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))


def bm25(docs: DataFrame, questions: DataFrame, *, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, statistics: DataFrame | None = None) -> DataFrame:
    """``qid``, ``id``, ``score`` of every document that has a term of the question (``questions``: qid, text).

    Okapi weights over the whole corpus; a negative idf becomes ``epsilon`` times the mean idf of the vocabulary. A term
    that the question repeats counts as often. The documents are reduced to the questions' terms before anything is
    shuffled; the vocabulary's statistics are one aggregation, or those stored before (see ``term_statistics``).
    """
    stats = term_statistics(docs, text_col) if statistics is None else statistics
    corpus = stats.where("term IS NULL").select(F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf0 = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = stats.where("term IS NOT NULL").crossJoin(F.broadcast(corpus.select("n_docs"))).select("term", "df", idf0.alias("raw_idf"))  # one row
    toks = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("toks")).where("toks IS NOT NULL")
    asked = few(questions, 10_000).select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    mean = terms.agg(F.avg("raw_idf").alias("mean_idf"))
    idf = F.when(F.col("raw_idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    weights = terms.join(F.broadcast(asked.select("term").distinct()), "term").crossJoin(F.broadcast(mean)).select("term", idf.alias("idf"))
    wanted = asked.agg(F.collect_set("term").alias("wanted"))  # the terms of the questions
    hits = toks.crossJoin(F.broadcast(wanted)).select("id", F.size("toks").alias("dl"), F.explode_outer(F.filter("toks", lambda t: F.array_contains("wanted", t))).alias("term")).where("term IS NOT NULL")
    tf = hits.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    scored = tf.join(F.broadcast(weights), "term").join(F.broadcast(asked), "term").crossJoin(F.broadcast(corpus.select("avgdl")))
    return scored.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null where one is null, all zero or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def dense(vectors: DataFrame, questions: DataFrame, *, id_col: str, vec_col: str, most: int | None = None, most_questions: int = 10_000) -> DataFrame:
    """``qid``, ``id``, ``score``: cosine of every usable vector to every question's vector (``questions``: qid, qvec). With ``most``, only rows
    that can be among a question's ``most`` best leave their batch (with some to spare for ties). Questions go to every task; more
    than ``most_questions`` raise an error."""
    asked = [(r["qid"], np.asarray(r["qvec"], np.float64)) for r in few(questions, most_questions).select("qid", "qvec").where("qvec IS NOT NULL").collect() if None not in r["qvec"]]
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(v) for _, v in asked if np.linalg.norm(v) > 0}:
        same = [(q, v / np.linalg.norm(v)) for q, v in asked if len(v) == size and np.linalg.norm(v) > 0]
        by_size[size] = ([q for q, _ in same], np.stack([v for _, v in same]))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)
    qid_type, id_type = questions.schema["qid"].dataType, vectors.schema[id_col].dataType
    qid_arrow = to_arrow_type(qid_type)

    def run(batches):
        for b in batches:
            col = b.column("_v")
            sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for size, (qids, q) in shared.value.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                x = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                norm = np.linalg.norm(x, axis=1)
                ok = np.isfinite(norm) & (norm > 0)
                at, x = at[ok], x[ok] / norm[ok][:, None]
                s = q @ x.T
                if most and s.shape[1] > most:
                    i, j = np.nonzero(s >= np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most, None] - 2e-6)
                else:
                    i, j = np.divmod(np.arange(s.size), max(1, s.shape[1]))
                yield pa.record_batch({"qid": pa.array(qids, qid_arrow).take(pa.array(i)), "id": b.column("id").take(pa.array(at[j])), "score": s[i, j]})

    schema = StructType([StructField("qid", qid_type), StructField("id", id_type), StructField("score", DoubleType())])
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).where("_v IS NOT NULL").mapInArrow(run, schema)


def top_k(scored: DataFrame, k: int, *, by: str = "qid", order: list[Column] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` with their rank from 1; ties by id."""
    order = order or [F.col("score").desc(), F.col("id")]
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def fuse(legs: list[DataFrame], *, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (qid, id, rank): ``qid``, ``id``, ``score``, ``best_leg``."""
    tagged = [leg.select("qid", "id", "rank", F.lit(i).alias("leg")) for i, leg in enumerate(legs)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("qid", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("best_leg"))


def adjust_quality(hits: DataFrame, *, suppressed: float = -999, cutoff: float = -0.5, downvotes: int = 3, up: float = 0.15, down: float = 0.25) -> DataFrame:
    """Drop suppressed and voted-down hits; add ``up`` or ``down`` times the quality to the score. A null quality is 0."""
    q, d = F.coalesce("quality_score", F.lit(0.0)), F.coalesce("downvote_count", F.lit(0))
    kept = hits.where(~((q <= suppressed) | ((q < cutoff) & (d >= downvotes))))
    return kept.withColumn("score", F.col("score") + F.when(q > 0, up * q).when(q < 0, down * q).otherwise(0.0))


def boost_topic(hits: DataFrame, *, factor: float = 1.18, plus: float = 0.01) -> DataFrame:
    """Raise hits whose ``topic`` is the one asked for (``wanted_topic``)."""
    same = F.col("wanted_topic").isNotNull() & F.col("topic").isNotNull() & (F.col("topic") == F.col("wanted_topic"))
    return hits.withColumn("score", F.when(same, F.col("score") * factor + plus).otherwise(F.col("score")))


def hybrid(chunks: DataFrame, questions: DataFrame, *, k: int = 20) -> DataFrame:
    """``qid``, ``rank``, ``id``, ``score``: the ``k`` best passages of each question (qid, text, qvec, wanted_topic, and perhaps only_topic).

    Both legs give 2k; BM25 hits without a positive score go after the cut. A question without any such hit keeps the cosines of its
    vector leg as scores. Passages on the wanted topic are raised; where ``only_topic`` is true no others count, in both legs
    and before any cut. ``chunks`` need id, content, embedding, quality_score, downvote_count and topic."""
    order = [F.round("score", 9).desc(), F.col("id")]  # sums in another order differ in the last digits
    limited = "only_topic" in questions.columns

    def within(scored: DataFrame) -> DataFrame:
        if not limited:
            return scored
        asked = questions.select("qid", F.col("wanted_topic").alias("_w"), F.col("only_topic").alias("_o"))
        on = scored.join(F.broadcast(asked), "qid").join(chunks.select("id", F.col("topic").alias("_t")), "id")
        return on.where(~F.coalesce("_o", F.lit(False)) | (F.col("_t") == F.col("_w"))).select("qid", "id", "score")

    sparse = top_k(within(bm25(chunks, questions, id_col="id", text_col="content")), 2 * k, order=order).where("score > 0")
    near = top_k(within(dense(chunks, questions, id_col="id", vec_col="embedding", most=None if limited else 2 * k)), 2 * k, order=order)
    worded = sparse.select("qid").distinct()
    alone = near.join(F.broadcast(worded), "qid", "left_anti").select("qid", "id", "score", F.struct(F.lit(0).alias("leg"), "rank").alias("best_leg"))  # at most as many as questions
    fused = fuse([near.join(F.broadcast(worded), "qid", "left_semi"), sparse]).unionByName(alone)
    fused = fused.join(chunks.select("id", "quality_score", "downvote_count", "topic"), "id")
    first = [F.round("score", 9).desc(), F.col("best_leg"), F.col("id")]  # of equal scores those of the vectors come first
    best = top_k(adjust_quality(fused), k, order=first, rank="_r").drop("_r")
    asked = questions.select("qid", "wanted_topic")
    return top_k(boost_topic(best.join(F.broadcast(asked), "qid")), k, order=first).select("qid", "rank", "id", "score")


def lexical_rerank(hits: DataFrame, questions: DataFrame, *, text_col: str, k: int = 5) -> DataFrame:
    """The default reranker: the share of the question's distinct terms that the passage has, then the former score."""
    asked = few(questions, 10_000).select("qid", F.array_distinct(tokens(F.col("text"))).alias("_q"))
    both = hits.join(F.broadcast(asked), "qid")
    overlap = F.size(F.array_intersect("_q", tokens(F.col(text_col)))) / F.greatest(F.size("_q"), F.lit(1))
    return top_k(both.withColumn("rerank_score", overlap), k, order=[F.col("rerank_score").desc(), F.round("score", 9).desc(), F.col("id")])


def all_terms(docs: DataFrame, questions: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Fallback search: documents that have every term of the question, ranked by how often. An approximation of a
    cover-density rank."""
    asked = few(questions, 10_000).select("qid", F.array_distinct(tokens(F.col("text"))).alias("_q")).where(F.size("_q") > 0)
    toks = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_t"))
    both = toks.crossJoin(F.broadcast(asked)).where(F.size(F.array_except("_q", "_t")) == 0)
    return both.select("qid", "id", F.size(F.filter("_t", lambda t: F.array_contains("_q", t))).alias("hits"))
