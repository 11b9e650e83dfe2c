"""Queries on the operators over passages, facts, vectors, the graph and feedback, with their SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import answers, chunking, dedup, retrieval, store, trust
from ..session import table
from ..streaming import pipelines
from .portable import INTENT_HITS

Q: dict = {}
SQL: dict[str, str] = {}

QUESTIONS = [(1, "why does the fuel pump trouble keep coming back", "fuel"), (2, "What torque is the spark plug set to?", "ignition"), (3, "noise measurement at the fence and the sound level", "vibration")]
_ASKED = "(VALUES " + ", ".join(f"({i}, '{t}', '{w}')" for i, t, w in QUESTIONS) + ") AS a(qid, text, wanted_topic)"


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid int, text string, wanted_topic string")


# --- text functions -----------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[​‌‍﻿]', '', 'g'), '(?m)^[ \t\-_=.]{4,}$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS clean FROM documents""")
def n1_boilerplate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_boilerplate(F.col("text")).alias("clean"))


@query("SELECT id, regexp_replace(lower(file_name), '[^a-z0-9_.]', '_', 'g') AS slug FROM file_inventory")
def n4_slug(spark, d):
    return table(spark, d, "file_inventory").select("id", tx.slug(F.col("file_name")).alias("slug"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS n_tokens, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))) AS n_distinct FROM documents")
def n5_tokens(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


_BEST = "greatest(" + ", ".join(f"h_{n}" for n in INTENT_HITS) + ")"


@query(
    "WITH d AS (SELECT doc_id, lower(text) AS q FROM documents), h AS (SELECT doc_id, " + ", ".join(f"{e} AS h_{n}" for n, e in INTENT_HITS.items()) + f" FROM d) SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN h_{n} = {_BEST} THEN '{n}'" for n in INTENT_HITS) + " END AS intent FROM h"
)
def n7_intent(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.intent_of(F.col("text")).alias("intent"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:rpm|torque|temperature|bar|psi|nm|compression ratio|fuel mixture|timing|clearance)(?:$|[^a-z0-9_])|°c') THEN 'spec_fast' WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:why|cause|won''t start|wont start|misfire|overheating|rough idle|fix|troubleshoot)(?:$|[^a-z0-9_])') THEN 'kg_fast' ELSE 'full_agent' END AS route FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def n8_route(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.route_of(F.col("text")).alias("route"))


_CONV = "(VALUES " + ", ".join(f"('{a}', '{b}', CAST({f!r} AS DOUBLE))" for a, b, f in vocab.CONVERSIONS) + ") AS c(a, b, f)"


@query(f"SELECT p_partkey, a AS unit_from, b AS unit_to, round(p_retailprice * f, 6) AS converted FROM part CROSS JOIN {_CONV}")
def n13_units(spark, d):
    pairs = spark.createDataFrame([(a, b) for a, b, _ in vocab.CONVERSIONS], "unit_from string, unit_to string")
    both = table(spark, d, "part").select("p_partkey", "p_retailprice").crossJoin(F.broadcast(pairs))  # a fixed list
    return both.select("p_partkey", "unit_from", "unit_to", tx.convert(F.col("p_retailprice"), F.col("unit_from"), F.col("unit_to")).alias("converted"))


@query(r"SELECT id, left(regexp_replace(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g'), 300) AS evidence FROM chunks")
def n16_evidence(spark, d):
    return table(spark, d, "chunks").select("id", tx.evidence(F.col("content")).alias("evidence"))


@query("SELECT doc_id, length(text) <= 300 AND (contains(lower(text), 'no information') OR contains(lower(text), 'not enough information') OR contains(lower(text), 'i don''t know') OR contains(lower(text), 'i do not know') OR contains(lower(text), 'cannot answer') OR contains(lower(text), 'unable to answer') OR contains(lower(text), 'insufficient context')) AS refusal, regexp_matches(text, '--[A-Z_]+-->') AS raw_graph FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def n26_detectors(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.looks_like_refusal(F.col("text")).alias("refusal"), tx.looks_like_raw_graph(F.col("text")).alias("raw_graph"))


@query("SELECT event_id, trim(regexp_replace('<think>' || props || '</think> ' || event_type, '(?s)<think>.*?</think>', '', 'g')) AS answer FROM events")
def n27_strip(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", tx.strip_reasoning(F.concat(F.lit("<think>"), "props", F.lit("</think> "), "event_type")).alias("answer"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def n25_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(content, '\[Table: [^\]]*\]|\[PAGE_BREAK:\d+\]', ' ', 'g'), '[ \t\n\r\f\x0B]*\|[ \t\n\r\f\x0B]*', ', ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS shown FROM chunks")
def n12_display(spark, d):
    return table(spark, d, "chunks").select("id", tx.display_text(F.col("content")).alias("shown"))


def n2_math_fold(spark, d):
    """Mathematical letters and signs of all chunks as plain ones."""
    return table(spark, d, "chunks").select("id", tx.fold_math("content").alias("folded"))


def x3_embed(spark, d):
    """Hashed-word vectors of all documents."""
    return table(spark, d, "documents").select("doc_id", F.transform(tx.hash_embedding(F.col("text")), lambda v: F.round(v, 6)).alias("vector"))


Q["n2_math_fold"], Q["x3_embed"] = n2_math_fold, x3_embed


# --- passages and facts -------------------------------------------------------------------------------------------

_CHUNKER = r"""
WITH d AS (SELECT parsed_id, regexp_replace(text, '\[PAGE_BREAK:\d+\]', '', 'g') AS t FROM parsed_docs),
w AS (SELECT parsed_id, t, pos FROM d, unnest(generate_series(0, length(t) - 1, 600)) AS u(pos) WHERE length(t) > 0),
e AS (SELECT parsed_id, pos, regexp_replace(substring(t, pos + 1, 700 + length(regexp_extract(substring(t, pos + 701, 150), '(?s)\A(.*?(?:[.!?](?:\s|\z)|\n\n))', 1))), '^\s+|\s+$', '', 'g') AS content FROM w)
SELECT parsed_id, CAST(row_number() OVER (PARTITION BY parsed_id ORDER BY pos) - 1 AS INT) AS chunk_index, CAST(pos AS INT) AS pos, content FROM e WHERE content <> ''"""
_PAGED = r"""
WITH b AS (SELECT parsed_id, regexp_extract_all(text, '\[PAGE_BREAK:(\d+)\]', 1) AS pages, regexp_split_to_array(text, '\[PAGE_BREAK:\d+\]') AS parts FROM parsed_docs),
s AS (SELECT parsed_id, CAST(pages[i] AS INT) AS page, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS INT) AS start, i FROM b, unnest(generate_series(1, len(pages))) AS u(i)),
c AS ("""


@query(_PAGED + _CHUNKER + ") SELECT c.*, coalesce((SELECT arg_max(page, i) FROM s WHERE s.parsed_id = c.parsed_id AND s.start <= c.pos), 1) AS page FROM c")
def x1_chunker(spark, d):
    return chunking.chunk_documents(table(spark, d, "parsed_docs"), ["parsed_id"], "text")


@query(_CHUNKER.replace("SELECT parsed_id, CAST(row_number", "SELECT parsed_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_characters FROM (SELECT parsed_id, CAST(row_number") + ") GROUP BY parsed_id")
def w6_sliding_chunks(spark, d):
    return x1_chunker(spark, d).groupBy("parsed_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_characters"))


@query(r"""WITH p AS (SELECT parsed_id, regexp_extract_all(text, '\[PAGE_BREAK:(\d+)\]', 1) AS pages, regexp_split_to_array(text, '\[PAGE_BREAK:\d+\]') AS parts FROM parsed_docs)
SELECT parsed_id, CAST(pages[i] AS INT) AS page, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS INT) AS start FROM p, unnest(generate_series(1, len(pages))) AS u(i)""")
def w7_offset_page(spark, d):
    return table(spark, d, "parsed_docs").select("parsed_id", F.inline(chunking.page_starts(F.col("text")))).select("parsed_id", "page", F.col("offset").alias("start"))


@query("""WITH t AS (SELECT parsed_id, unnest(tables) AS t FROM parsed_docs), r AS (SELECT parsed_id, t.name AS sheet, t.rows[1] AS h, t.units AS u, unnest(t.rows[2:]) AS c FROM t),
x AS (SELECT parsed_id, sheet, h, u, c, unnest(generate_series(2, len(c))) AS j FROM r)
SELECT parsed_id, sheet, coalesce(c[1], '') AS row_label, coalesce(h[j], '') AS col_label, coalesce(c[1], '') || '::' || coalesce(h[j], '') AS key, c[j] AS value, u[coalesce(h[j], '')] AS unit FROM x WHERE c[j] IS NOT NULL AND trim(c[j]) <> ''""")
def x5_facts(spark, d):
    return chunking.table_facts(table(spark, d, "parsed_docs"), ["parsed_id"])


@query("""WITH f AS (SELECT parsed_id, unnest(tables) AS t FROM parsed_docs), r AS (SELECT parsed_id, t.name AS sheet, t.rows[1] AS h, unnest(t.rows[2:]) AS c FROM f),
x AS (SELECT parsed_id, sheet, h, c, unnest(generate_series(2, len(c))) AS j FROM r)
SELECT parsed_id, sheet, coalesce(c[1], '') || '::' || coalesce(h[j], '') AS key, c[j] AS value FROM x WHERE c[j] IS NOT NULL AND trim(c[j]) <> '' AND contains(lower(coalesce(h[j], '')), 'torque')""")
def x18_spec(spark, d):
    return x5_facts(spark, d).where(F.contains(F.lower("col_label"), F.lit("torque"))).select("parsed_id", "sheet", "key", "value")


# --- retrieval ----------------------------------------------------------------------------------------------------

_BM25 = r"""
a AS (SELECT * FROM {asked}),
d AS (SELECT {id} AS id, list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda t: t <> '') AS toks FROM {table} WHERE {text} IS NOT NULL),
c AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
t AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d), tf AS (SELECT id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df, c), m AS (SELECT avg(raw_idf) AS mean_idf FROM raw),
i AS (SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * mean_idf ELSE raw_idf END AS idf FROM raw, m),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS term FROM a) GROUP BY ALL),
s AS (SELECT qid, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN i USING (term) JOIN q USING (term), c GROUP BY qid, id)"""
_DOCS_BM25 = "WITH " + _BM25.format(asked=_ASKED, id="doc_id", text="text", table="documents")


@query(_DOCS_BM25 + " SELECT qid, id, round(score, 6) AS score FROM s")
def x8_bm25(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), questions(spark), id_col="doc_id", text_col="text").select("qid", "id", F.round("score", 6).alias("score"))


@query(_DOCS_BM25 + ", r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 20 AND score > 0")
def t2_bm25_topk(spark, d):
    scored = retrieval.bm25(table(spark, d, "documents"), questions(spark), id_col="doc_id", text_col="text")
    return retrieval.top_k(scored, 20, order=[F.round("score", 6).desc(), F.col("id")]).where("score > 0").select("qid", "rank", "id", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"WITH q AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS id, round({_COS.format(a='embedding', b='qvec')}, 6) AS score FROM embeddings, q), r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, rank, id, score FROM r WHERE rank <= 10")
def t1_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    scored = retrieval.dense(e, asked, id_col="vec_id", vec_col="embedding").withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 10).select("qid", "rank", "id", "score")


def _ask_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks as the retriever needs them, and the questions with the vector of the first chunk on their topic."""
    chunks = table(spark, d, "chunks").select("id", "content", "embedding", "quality_score", "downvote_count", F.col("metadata.topic").alias("topic"), F.col("metadata.filename").alias("filename"), F.col("metadata.page").alias("page"), "doc_id")
    usable = chunks.where((F.size("embedding") == 64) & F.exists("embedding", lambda e: e != 0))
    first = usable.groupBy(F.col("topic").alias("wanted_topic")).agg(F.min_by("embedding", "id").alias("qvec"))
    return chunks, questions(spark).join(F.broadcast(first), "wanted_topic", "left")


_HYBRID = (
    "WITH "
    + _BM25.format(asked=_ASKED, id="id", text="content", table="chunks")
    + f""",
sp AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s), sparse AS (SELECT qid, id, rank FROM sp WHERE rank <= 40 AND score > 0),
u AS (SELECT * FROM chunks WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0),
v AS (SELECT qid, wanted_topic, (SELECT arg_min(embedding, id) FROM u WHERE metadata.topic = wanted_topic) AS qvec FROM a),
ds AS (SELECT qid, id, {_COS.format(a="embedding", b="qvec")} AS score FROM u, v WHERE qvec IS NOT NULL), dn AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ds), dense AS (SELECT qid, id, rank FROM dn WHERE rank <= 40),
f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score, min(leg * 1000000 + rank) AS best FROM (SELECT *, 1 AS leg FROM sparse UNION ALL SELECT *, 0 FROM dense) GROUP BY qid, id),
k AS (SELECT f.qid, f.id, f.best, metadata.topic AS topic, CAST(score AS DOUBLE) + CASE WHEN coalesce(quality_score, 0) > 0 THEN 0.15 * quality_score WHEN coalesce(quality_score, 0) < 0 THEN 0.25 * quality_score ELSE 0 END AS score FROM f JOIN chunks USING (id) WHERE NOT (coalesce(quality_score, 0) <= -999 OR (coalesce(quality_score, 0) < -0.5 AND coalesce(downvote_count, 0) >= 3))),
c1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, best, id) AS r FROM k),
b AS (SELECT c1.qid, c1.id, c1.best, CASE WHEN c1.topic = a.wanted_topic THEN c1.score * 1.18 + 0.01 ELSE c1.score END AS score FROM c1 JOIN a USING (qid) WHERE r <= 20)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, best, id) AS rank, id, round(score, 6) AS score FROM b"""
)


@query(_HYBRID)
def x9_hybrid(spark, d):
    chunks, asked = _ask_chunks(spark, d)
    return retrieval.hybrid(chunks, asked).select("qid", "rank", "id", F.round("score", 6).alias("score"))


_TOPICAL = [(1, "why does the fuel pump trouble keep coming back", "fuel", True), (2, "What torque is the spark plug set to?", "ignition", False), (4, "zzqx vrrkly", "vibration", False), (5, "noise measurement", "nothing", True)]
_TOPICAL_SQL = (
    _HYBRID.replace(_ASKED, "(VALUES " + ", ".join(f"({i}, '{t}', '{w}', {o})" for i, t, w, o in _TOPICAL) + ") AS a(qid, text, wanted_topic, only_topic)")
    .replace("FROM s), sparse AS", "FROM s JOIN a USING (qid) JOIN chunks c USING (id) WHERE NOT a.only_topic OR c.metadata.topic = a.wanted_topic), sparse AS")
    .replace("SELECT qid, wanted_topic, (SELECT", "SELECT qid, wanted_topic, only_topic, (SELECT")
    .replace("FROM u, v WHERE qvec IS NOT NULL)", "FROM u, v WHERE qvec IS NOT NULL AND (NOT only_topic OR u.metadata.topic = wanted_topic))")
    .replace("dense AS (SELECT qid, id, rank FROM dn WHERE rank <= 40)", "dense AS (SELECT qid, id, rank FROM dn WHERE rank <= 40), word AS (SELECT DISTINCT qid FROM sparse)")
    .replace("AS id, row_number()", "AS id, row_number()")
    .replace("(SELECT *, 1 AS leg FROM sparse UNION ALL SELECT *, 0 FROM dense) GROUP BY qid, id)", "(SELECT *, 1 AS leg FROM sparse UNION ALL SELECT *, 0 FROM dense WHERE qid IN (SELECT qid FROM word)) GROUP BY qid, id UNION ALL SELECT qid, id, ds.score, dense.rank FROM dense JOIN ds USING (qid, id) WHERE qid NOT IN (SELECT qid FROM word))")
)


@query(_TOPICAL_SQL)
def x9_topical(spark, d):
    """Questions that want one topic only, and one without any known word."""
    chunks, _ = _ask_chunks(spark, d)
    usable = chunks.where((F.size("embedding") == 64) & F.exists("embedding", lambda e: e != 0))
    first = usable.groupBy(F.col("topic").alias("wanted_topic")).agg(F.min_by("embedding", "id").alias("qvec"))
    asked = spark.createDataFrame(_TOPICAL, "qid int, text string, wanted_topic string, only_topic boolean").join(F.broadcast(first), "wanted_topic", "left")
    return retrieval.hybrid(chunks, asked).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def j11_rrf_union(spark, d):
    chunks, asked = _ask_chunks(spark, d)
    order = [F.round("score", 9).desc(), F.col("id")]
    sparse = retrieval.top_k(retrieval.bm25(chunks, asked, id_col="id", text_col="content"), 40, order=order)
    near = retrieval.top_k(retrieval.dense(chunks, asked, id_col="id", vec_col="embedding"), 40, order=order)
    return retrieval.fuse([near, sparse]).select("qid", "id", F.round("score", 9).alias("score"))


Q["j11_rrf_union"] = j11_rrf_union
SQL["j11_rrf_union"] = (_HYBRID[: _HYBRID.index(",\nf AS")] + " SELECT qid, id, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 9) AS score FROM (SELECT qid, id, rank FROM dense UNION ALL SELECT qid, id, rank FROM sparse) GROUP BY qid, id").strip()


@query(
    "WITH h AS ("
    + _HYBRID.replace("round(score, 6) AS score FROM b", "score FROM b")
    + r"""), o AS (SELECT h.qid, h.id, h.score, CAST(len(list_intersect(a.w, regexp_split_to_array(lower(c.content), '\s+'))) AS DOUBLE) / len(a.w) AS overlap FROM h JOIN chunks c USING (id) JOIN (SELECT qid, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS w FROM """
    + _ASKED
    + """) a USING (qid)) SELECT qid, rank, id, round(overlap, 6) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, round(score, 9) DESC, id) AS rank FROM o) x WHERE rank <= 5"""
)
def x10_rerank(spark, d):
    chunks, asked = _ask_chunks(spark, d)
    hits = retrieval.hybrid(chunks, asked).join(chunks.select("id", "content"), "id")
    return retrieval.lexical_rerank(hits.withColumnRenamed("rank", "former_rank"), questions(spark), text_col="content").select("qid", "rank", "id", F.round("rerank_score", 6).alias("rerank_score"))


_WORDS = "(VALUES (1, 'fuel pump'), (2, 'the sound level'), (3, 'spark')) AS a(qid, text)"


@query(f"""WITH q AS (SELECT qid, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {_WORDS}), d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS t FROM documents)
SELECT qid, id, CAST(len(list_filter(t, lambda x: list_contains(w, x))) AS INT) AS hits FROM d, q WHERE list_has_all(t, w)""")
def x11_all_terms(spark, d):
    asked = spark.createDataFrame([(1, "fuel pump"), (2, "the sound level"), (3, "spark")], "qid int, text string")
    return retrieval.all_terms(table(spark, d, "documents"), asked, id_col="doc_id", text_col="text")


# --- vectors and duplicates ---------------------------------------------------------------------------------------


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS.format(a='a.embedding', b='b.embedding')} >= 0.4")
def j13_sim_pairs(spark, d):
    return dedup.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", least=0.4)


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS qid, e.vec_id AS id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS c FROM embeddings e, q WHERE e.vec_id <> q.vec_id) SELECT qid, id AS nearest, c AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) = 1")
def j14_nearest1(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    s = retrieval.dense(e, asked, id_col="vec_id", vec_col="embedding").where("id <> qid").withColumn("score", F.round("score", 6))
    best = s.groupBy("qid").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("qid", (-F.col("b.i")).alias("nearest"), F.col("b.score").alias("cosine"))


# greedy keeping one row after the other; only rows with a partner can be dropped
_GREEDY = f"""
WITH RECURSIVE v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n FROM chunks WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0),
u AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v, n FROM v),
p AS (SELECT b.id, list(a.id ORDER BY a.id) AS before FROM u a JOIN u b ON a.id < b.id AND a.n = b.n AND list_dot_product(a.v, b.v) >= 0.98 GROUP BY b.id),
s AS (SELECT id, before, row_number() OVER (ORDER BY id) AS i FROM p),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS dropped UNION ALL
      SELECT s.i, CASE WHEN len(list_filter(before, lambda b: NOT list_contains(dropped, b))) > 0 THEN list_append(dropped, s.id) ELSE dropped END FROM g JOIN s ON s.i = g.i + 1),
z AS (SELECT dropped FROM g ORDER BY i DESC LIMIT 1), f AS (SELECT unnest(dropped) AS id FROM z),
o AS (SELECT p.id, min(b) AS owner FROM (SELECT id, unnest(before) AS b FROM p) p WHERE b NOT IN (SELECT id FROM f) GROUP BY p.id),
k AS (SELECT c.id, f.id IS NULL AS kept, CASE WHEN f.id IS NULL THEN c.id ELSE o.owner END AS kept_as FROM chunks c LEFT JOIN f USING (id) LEFT JOIN o USING (id))"""


@query(_GREEDY + " SELECT id, kept, kept_as FROM k")
def x4_dedup(spark, d):
    """Chunks kept when near-duplicates (cosine 0.98) of an earlier one are dropped."""
    chunks = table(spark, d, "chunks")
    return dedup.greedy_keep(chunks.select("id"), dedup.similar_pairs(chunks, "id", "embedding", least=0.98), dedup.members(chunks, "id", "embedding"))


@query(_GREEDY + ", t AS (SELECT kept_as AS id, unnest(source_refs) AS r FROM chunks JOIN k USING (id)) SELECT k.id, CAST(count(DISTINCT (r.filename, r.page, r.topic)) FILTER (r IS NOT NULL) AS INT) AS n_refs FROM k LEFT JOIN t ON t.id = k.id WHERE k.kept AND k.id IN (SELECT kept_as FROM k JOIN chunks USING (id) WHERE source_refs IS NOT NULL) GROUP BY k.id")
def u3_ref_union(spark, d):
    """References of kept chunks together with those of their duplicates."""
    chunks = table(spark, d, "chunks")
    merged = dedup.merge_refs(chunks.select("id", "source_refs"), x4_dedup(spark, d), "source_refs")
    return merged.select("id", F.size("source_refs").alias("n_refs"))


# --- trust --------------------------------------------------------------------------------------------------------

_M = r"((\d+(?:[.,]\d+)?)\s*(" + "|".join(sorted(vocab.UNIT_RANGES, key=len, reverse=True)) + r"))([^\p{L}\d]|$)"
_RANGE = " OR ".join(f"(unit = '{u}' AND value BETWEEN {lo} AND {hi})" for u, (lo, hi) in vocab.UNIT_RANGES.items())
_NEAR = " OR ".join(f"contains(near, '{w}')" for w in vocab.SPEC_CONTEXT)
_MEASURES = rf"""
WITH k AS (SELECT id, doc_id, metadata.topic AS topic, content, string_split(regexp_replace(content, '{_M}', chr(1) || '\1\4', 'g'), chr(1)) AS parts FROM chunks WHERE regexp_matches(content, '{_M}')),
p AS (SELECT id, doc_id, topic, content, parts[i] AS part, CAST(list_sum(list_transform(parts[1:i-1], lambda x: length(x))) AS INT) AS pos FROM k, unnest(generate_series(2, len(parts))) AS u(i)),
m AS (SELECT id, doc_id, topic, pos, regexp_extract(part, '^{_M}', 2) AS number, regexp_extract(part, '^{_M}', 3) AS unit, CAST(replace(regexp_extract(part, '^{_M}', 2), ',', '.') AS DOUBLE) AS value,
      lower(substring(content, greatest(pos + 1 - 80, 1), least(pos, 80) + length(regexp_extract(part, '^{_M}', 1)) + 80)) AS near FROM p),
f AS (SELECT * FROM m WHERE ({_RANGE}) AND ({_NEAR}))"""


@query(_MEASURES + " SELECT id, doc_id, pos, number, value, unit FROM f")
def x19_measures(spark, d):
    """Plausible measures in all chunks."""
    return trust.measures(table(spark, d, "chunks"), ["id", "doc_id"], "content")


_CONFLICTS = (
    _MEASURES
    + """, w AS (SELECT topic, lower(unit) AS unit, doc_id, number, value, row_number() OVER (PARTITION BY topic, lower(unit), doc_id ORDER BY id, pos) AS r FROM f),
c AS (SELECT topic, unit, count(DISTINCT doc_id) AS n_sources, count(DISTINCT number) AS n_values, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS spread FROM w WHERE r <= 2 GROUP BY topic, unit),
x AS (SELECT * FROM c WHERE n_sources >= 2 AND n_values > 1 AND (spread >= 5 OR spread / high > 0.03))"""
)


def _chunk_measures(spark, d) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "doc_id", "content", F.col("metadata.topic").alias("topic"))
    return trust.measures(chunks, ["id", "doc_id", "topic"], "content")


@query(_CONFLICTS + " SELECT topic, unit, n_sources, n_values, low, high, spread FROM x")
def x19_conflicts(spark, d):
    """Units in which the documents on one topic give different numbers, over the measures of all chunks."""
    return trust.conflicts(_chunk_measures(spark, d), group="topic", source="doc_id", order=["id", "pos"])


@query(_CONFLICTS + ", s AS (SELECT topic, lower(unit) AS unit, min((id, pos)) AS seen FROM f GROUP BY topic, lower(unit)) SELECT topic, unit, spread, CAST(no AS INT) AS no FROM (SELECT x.*, row_number() OVER (PARTITION BY x.topic ORDER BY s.seen, x.unit) AS no FROM x JOIN s ON s.unit = x.unit AND s.topic = x.topic) y WHERE no <= 3")
def t10_first_conflicts(spark, d):
    """Of each topic's conflicts the three whose unit its chunks name first."""
    m = _chunk_measures(spark, d)
    seen = m.groupBy("topic", F.lower("unit").alias("unit")).agg(F.min(F.struct("id", "pos")).alias("seen"))
    return trust.first_conflicts(trust.conflicts(m, group="topic", source="doc_id", order=["id", "pos"]), group="topic", first_seen=seen).select("topic", "unit", "spread", "no")


@query(r"""SELECT c.id, CASE WHEN trim(coalesce(c.content, '')) = '' THEN false ELSE len(list_filter(regexp_extract_all(c.content, '\d{3,}(?:[.,]\d+)?|\d+[.,]\d+'), lambda n: len(list_filter(coalesce(p.texts, []), lambda t: contains(t, n))) = 0)) = 0 END AS grounded
FROM chunks c LEFT JOIN (SELECT doc_id, list(text) FILTER (text IS NOT NULL) AS texts FROM parsed_docs GROUP BY doc_id) p ON p.doc_id = c.doc_id""")
def x20_grounded(spark, d):
    return trust.grounded_in(table(spark, d, "chunks"), table(spark, d, "parsed_docs"), key="id", doc="doc_id", draft_col="content", text_col="text")


@query(r"SELECT id, regexp_matches(coalesce(content, ''), '(?i)\d\s*(?:" + "|".join(trust.CHECKED_UNITS) + r")(?:[^\p{L}\p{N}_]|$)') AS checked FROM chunks")
def x20_gate(spark, d):
    """Whether a chunk has numbers with units, so that grounding is checked."""
    return table(spark, d, "chunks").select("id", trust.worth_checking(F.col("content")).alias("checked"))


# --- answers ------------------------------------------------------------------------------------------------------


def _hits(spark, d) -> DataFrame:
    chunks, asked = _ask_chunks(spark, d)
    return retrieval.hybrid(chunks, asked).join(chunks.select("id", "content", "filename", "page", "doc_id"), "id")


@query(
    "WITH h AS ("
    + _HYBRID.replace("round(score, 6) AS score FROM b", "score FROM b")
    + r"""), q AS (SELECT qid, list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(text, '[?!.,;:]', ' ', 'g')), '\s+')), lambda t: length(t) >= 3) AS w FROM """
    + _ASKED
    + r"""), c AS (SELECT h.qid, h.id, h.rank, c.content, q.w, row_number() OVER (PARTITION BY h.qid ORDER BY len(list_filter(q.w, lambda t: contains(lower(c.content), t))) DESC, h.rank, h.id) AS no FROM h JOIN chunks c USING (id) JOIN q USING (qid)),
s AS (SELECT qid, no, id, w, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda z: trim(z) <> '') AS p FROM c WHERE no <= 3)),
n AS (SELECT *, len(list_filter(w, lambda t: contains(lower(s), t))) AS n FROM s)
SELECT qid, CAST(no AS INT) AS source_no, id, trim(s) AS sentence, CAST(n AS INT) AS overlap FROM n QUALIFY row_number() OVER (PARTITION BY qid, no ORDER BY n DESC, least(length(s), 280) DESC, i) = 1"""
)
def x21_extractive(spark, d):
    return answers.extract_answer(_hits(spark, d), questions(spark), text_col="content")



@query("WITH h AS (" + _HYBRID + r") SELECT qid, rank AS no, h.id, coalesce(metadata.filename, 'unknown') || coalesce(', p. ' || CAST(metadata.page AS VARCHAR), '') AS label, left(regexp_replace(content, '[ \t\n\r\f\x0B]+', ' ', 'g'), 200) AS snippet FROM h JOIN chunks USING (id)")
def x22_citations(spark, d):
    return answers.citations(_hits(spark, d))


# --- feedback and stores ------------------------------------------------------------------------------------------

_FEEDBACK = "(SELECT CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS vote, [event_id % 1000 + 1, event_id % 777 + 1] AS chunk_ids FROM events)"


def _feedback(spark, d) -> DataFrame:
    vote = F.when(F.col("event_type") == "error", -1).when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0)
    return table(spark, d, "events").select(vote.alias("vote"), F.array(F.col("event_id") % 1000 + 1, F.col("event_id") % 777 + 1).alias("chunk_ids"))


@query(f"SELECT chunk_id, count(*) AS n_votes, CAST(sum(vote) AS BIGINT) AS total, CAST(sum(CASE WHEN vote = -1 THEN 1 ELSE 0 END) AS BIGINT) AS downvotes FROM (SELECT vote, unnest(chunk_ids) AS chunk_id FROM {_FEEDBACK} WHERE vote <> 0) GROUP BY chunk_id")
def j7_votes_unnest(spark, d):
    return store.votes_per_chunk(_feedback(spark, d))


@query(f"""WITH v AS (SELECT chunk_id, count(*) AS n, sum(vote) AS t, sum(CASE WHEN vote = -1 THEN 1 ELSE 0 END) AS dn FROM (SELECT vote, unnest(chunk_ids) AS chunk_id FROM {_FEEDBACK} WHERE vote <> 0) GROUP BY chunk_id)
SELECT id, round(CASE WHEN id % 97 = 0 THEN -999.0 WHEN coalesce(vote_count, 0) + coalesce(n, 0) > 0 THEN (coalesce(quality_score, 0) * coalesce(vote_count, 0) + coalesce(t, 0)) / (coalesce(vote_count, 0) + coalesce(n, 0)) ELSE coalesce(quality_score, 0) END, 6) AS quality_score, CAST(coalesce(vote_count, 0) + coalesce(n, 0) AS BIGINT) AS vote_count, CAST(coalesce(downvote_count, 0) + coalesce(dn, 0) AS BIGINT) AS downvote_count FROM chunks LEFT JOIN v ON chunk_id = id""")
def k8_vote_update(spark, d):
    chunks = table(spark, d, "chunks").select("id", "quality_score", "vote_count", "downvote_count")
    got = store.quality_after_votes(chunks, j7_votes_unnest(spark, d), chunks.where("id % 97 = 0"))
    return got.withColumn("quality_score", F.round("quality_score", 6))


@query("SELECT id, batch_id, relative_path, status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, relative_path ORDER BY id DESC) AS rn FROM file_inventory) WHERE rn = 1")
def k3_inventory_upsert(spark, d):
    f = table(spark, d, "file_inventory").select("id", "batch_id", "relative_path", "status")
    return store.upsert(f.where("id % 2 = 0"), f.where("id % 2 = 1"), keys=["batch_id", "relative_path"], order=F.col("id"))


@query("SELECT parsed_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY parsed_id) + coalesce((SELECT max(version) FROM parsed_docs o WHERE o.doc_id = p.doc_id), 0) AS version FROM parsed_docs p")
def k2_register_version(spark, d):
    p = table(spark, d, "parsed_docs").select("parsed_id", "doc_id", "version")
    return store.register_versions(p, p, key="doc_id", order=["parsed_id"]).select("parsed_id", "doc_id", F.col("version").cast("bigint").alias("version"))


@query("SELECT doc_id, source FROM documents JOIN (SELECT source AS source, length(source) AS l FROM (SELECT source FROM mix_targets UNION SELECT split_part(source, '_', 1) FROM mix_targets)) t(source, l) ON starts_with(lower(filename), t.source) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) = 1".replace("doc_id, source FROM", "doc_id, t.source FROM"))
def j8_prefix_longest(spark, d):
    t = table(spark, d, "mix_targets").select("source")
    prefixes = t.union(t.select(F.split_part("source", F.lit("_"), F.lit(1)))).distinct()  # a fixed list of sources
    docs = table(spark, d, "documents").select("doc_id", F.lower("filename").alias("name"))
    hit = docs.join(F.broadcast(prefixes), F.startswith("name", F.col("source")))
    return hit.groupBy("doc_id").agg(F.max_by("source", F.length("source")).alias("source"))


@query("SELECT f.id, coalesce(n.n, 0) AS n_chunks FROM file_inventory f LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) n ON n.doc_id = regexp_replace(lower(f.file_name), '[^a-z0-9_.]', '_', 'g')")
def j16_slug_counts(spark, d):
    n = table(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, d, "file_inventory").select("id", tx.slug(F.col("file_name")).alias("doc_id")).join(n, "doc_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query("WITH p AS (SELECT id, regexp_replace(string_split(coalesce(relative_path, ''), '/')[1], '^[0-9.\\-_ ]+', '') AS folder, relative_path FROM file_inventory) SELECT p.id, CASE WHEN NOT contains(coalesce(relative_path, ''), '/') OR folder = '' THEN 'Unsorted' ELSE coalesce(t.preset, folder) END AS topic FROM p LEFT JOIN (VALUES " + ", ".join(f"('{t}')" for t in vocab.TOPIC_FOLDERS) + ") t(preset) ON replace(replace(replace(replace(lower(t.preset), 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss') = replace(replace(replace(replace(lower(folder), 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss')")
def f15_topic_path(spark, d):
    fold = lambda c: F.replace(F.translate(F.lower(c), "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    presets = spark.createDataFrame([(t,) for t in vocab.TOPIC_FOLDERS], "preset string")
    path = F.coalesce("relative_path", F.lit(""))
    f = table(spark, d, "file_inventory").select("id", path.alias("path"), F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(1)), r"^[0-9.\-_ ]+", "").alias("folder"))
    got = f.join(F.broadcast(presets), fold(F.col("preset")) == fold(F.col("folder")), "left")
    return got.select("id", F.when(~F.contains("path", F.lit("/")) | (F.col("folder") == ""), "Unsorted").otherwise(F.coalesce("preset", "folder")).alias("topic"))


@query("SELECT id, doc_id FROM chunks WHERE contains(lower(content), 'fuel') OR contains(lower(content), 'pump') OR contains(lower(content), 'trouble')")
def f11_lexical_gate(spark, d):
    low = F.lower("content")
    terms = tx.relevance_terms("fuel pump trouble")
    return table(spark, d, "chunks").where(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))).select("id", "doc_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS last_error FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w5_last_by_role(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    pick = lambda t: F.last(F.when(F.col("event_type") == t, F.col("value")), True).over(w)
    return table(spark, d, "events").select("event_id", pick("purchase").alias("last_purchase"), pick("error").alias("last_error"))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events")
def w8_carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")), True).over(w).alias("state"))


# --- streams, run as batches --------------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s_tumbling(spark, d):
    return pipelines.tumbling(table(spark, d, "events"))


@query("SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS b FROM events) GROUP BY ALL")
def s_sliding(spark, d):
    return pipelines.sliding(table(spark, d, "events"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def s_dedup_watermark(spark, d):
    return pipelines.distinct_events(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")).select("event_id", "user_id", "event_type")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
