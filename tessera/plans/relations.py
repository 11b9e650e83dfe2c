"""Queries on the graph as a table: edges between extracted nodes and of the built-in graph, paths, views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import answers, graph, normalize, rules
from ..session import spread, table
from .portable import _SEED

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- the table of edges -------------------------------------------------------------------------------------------

_RELATION = "CASE concat_ws('>', {a}, {b}) " + " ".join(f"WHEN '{s}>{d}' THEN '{r}'" for (s, d), r in graph.RELATION_OF.items()) + " END"
_AHEAD, _BACK = _RELATION.format(a="a_type", b="b_type"), _RELATION.format(a="b_type", b="a_type")
EDGES_SQL = f"""
n AS (SELECT id, CASE WHEN lower(trim(type)) IN ({quoted(vocab.NODE_TYPES)}) THEN lower(trim(type)) ELSE 'unknown' END AS type, trim(name) AS name, props.doc_id AS doc_id, props.source_chunk_id AS chunk, props.page AS page, props.confidence AS confidence, props.extraction_method AS method FROM graph_nodes WHERE trim(name) <> ''),
beside AS (
    SELECT a.type AS a_type, a.name AS a_name, b.type AS b_type, b.name AS b_name, a.doc_id, a.chunk, a.page, a.confidence AS c1, b.confidence AS c2, a.method FROM n a JOIN n b ON a.chunk = b.chunk AND a.id < b.id
    UNION ALL
    SELECT * FROM (SELECT type, name, lead(type) OVER w AS b_type, lead(name) OVER w AS b_name, doc_id, chunk, page, confidence, lead(confidence) OVER w AS c2, method FROM n WHERE doc_id IS NOT NULL AND page IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY id)) x WHERE b_name IS NOT NULL),
r AS (SELECT *, {_AHEAD} AS ahead, {_BACK} AS back FROM beside),
e0 AS (
    SELECT CASE WHEN ahead IS NULL AND back IS NOT NULL THEN b_type ELSE a_type END AS src_type, CASE WHEN ahead IS NULL AND back IS NOT NULL THEN b_name ELSE a_name END AS src, coalesce(ahead, back, 'RELATED_TO') AS relation,
           CASE WHEN ahead IS NULL AND back IS NOT NULL THEN a_type ELSE b_type END AS dst_type, CASE WHEN ahead IS NULL AND back IS NOT NULL THEN a_name ELSE b_name END AS dst, doc_id, chunk, page, least(coalesce(c1, c2), coalesce(c2, c1)) AS confidence, method FROM r
    UNION ALL
    SELECT src_type, src, relation, dst_type, dst, NULL, NULL, NULL, 0.95, 'manual_seed' FROM {_SEED}),
e AS (SELECT e0.*, c.topic FROM e0 LEFT JOIN (SELECT id, metadata.topic AS topic FROM chunks) c ON c.id = e0.chunk)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = "props."
    return table(spark, d, "graph_nodes").select("id", "type", "name", F.col(p + "doc_id").alias("doc_id"), F.col(p + "source_chunk_id").alias("chunk"), F.col(p + "page").alias("page"), F.col(p + "confidence").alias("confidence"), F.col(p + "extraction_method").alias("method"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the extracted nodes, and those of the built-in graph; with the topic of their chunk."""
    own = graph.node_edges(nodes(spark, d))
    _, seed = graph.seed_graph(spark)
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    seed = seed.select("src_type", "src", "relation", "dst_type", "dst", null("doc_id", "string"), null("chunk", "bigint"), null("page", "int"), "confidence", F.col("extraction_method").alias("method"))
    topic = table(spark, d, "chunks").select(F.col("id").alias("chunk"), F.col("metadata.topic").alias("topic"))
    return own.unionByName(seed).join(topic, "chunk", "left")


_WITH = "WITH " + EDGES_SQL


@query(_WITH + " SELECT src_type, src, relation, dst_type, dst, doc_id, chunk, page, round(confidence, 6) AS confidence, method, topic FROM e")
def x14_node_edges(spark, d):
    return edges(spark, d).select("src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk", "page", F.round("confidence", 6).alias("confidence"), "method", "topic")


@query(_WITH + " SELECT DISTINCT src_type, src, relation, dst_type, dst, doc_id, chunk FROM e WHERE contains(lower(src), 'fuel') OR contains(lower(dst), 'fuel')")
def j1_neighbourhood(spark, d):
    e = edges(spark, d).select("src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk")
    return graph.neighbourhood(e, F.contains(F.lower("name"), F.lit("fuel")))


@query(_WITH + " SELECT a.src AS symptom, a.dst AS cause, b.dst AS fix FROM e a LEFT JOIN e b ON b.src_type = a.dst_type AND b.src = a.dst AND b.relation = 'FIXED_BY' WHERE a.relation = 'CAUSED_BY'")
def j2_diagnostic_left_path(spark, d):
    return graph.diagnostic_paths(edges(spark, d))


@query(_WITH + " SELECT a.src AS first, b.src AS second, b.dst AS third FROM e a JOIN e b ON b.src = a.dst AND b.src_type = 'cause' AND b.dst_type = 'fix' WHERE a.src_type = 'symptom' AND a.dst_type = 'cause'")
def j3_typed_path(spark, d):
    return graph.typed_paths(edges(spark, d), ("symptom", "cause", "fix"))


@query(_WITH + " SELECT g.src AS first, a.src AS second, a.dst AS third FROM e g JOIN e a ON g.dst = a.src AND g.dst_type = a.src_type AND a.relation = 'CAUSED_BY' WHERE g.relation = 'HAS_SYMPTOM'")
def j4_guarded_path(spark, d):
    return graph.relation_paths(edges(spark, d), "HAS_SYMPTOM", "CAUSED_BY")


@query(_WITH + ", x AS (SELECT src_type AS type, src AS name FROM e UNION ALL SELECT dst_type, dst FROM e WHERE NOT (src_type = dst_type AND src = dst)) SELECT type, name, count(*) AS degree FROM x GROUP BY type, name")
def j12_degree(spark, d):
    return graph.degrees(edges(spark, d))


@query(_WITH + ", x AS (SELECT src_type AS type, src AS name FROM e UNION ALL SELECT dst_type, dst FROM e WHERE NOT (src_type = dst_type AND src = dst)), g AS (SELECT type, name, count(*) AS degree FROM x GROUP BY type, name) SELECT * FROM g ORDER BY degree DESC, type, name LIMIT 10")
def a8_top_connected(spark, d):
    return graph.quality_report(edges(spark, d))[2].select("type", "name", "degree")


@query(_WITH + " SELECT relation, count(*) AS n FROM e GROUP BY relation")
def a8_relations(spark, d):
    return graph.quality_report(edges(spark, d))[0]


@query(_WITH + " SELECT count(*) AS n_edges, round(avg(confidence), 3) AS avg_confidence, round(100 * count(doc_id) / count(*), 1) AS doc_pct, round(100 * count(chunk) / count(*), 1) AS chunk_pct FROM e")
def a8_edge_coverage(spark, d):
    return graph.quality_report(edges(spark, d))[1]


@query(f"SELECT lower(concat_ws('|', coalesce(src_type, ''), coalesce(src, ''), relation, coalesce(dst_type, ''), coalesce(dst, ''), coalesce(doc_id, ''), coalesce(CAST(chunk AS VARCHAR), ''))) AS edge_key FROM ({_WITH} SELECT * FROM e) x")
def n24_edge_key(spark, d):
    e = edges(spark, d)
    return e.select(tx.edge_key(*[F.col(c) for c in ("src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk")]).alias("edge_key"))


@query(f"SELECT id, CASE WHEN lower(trim(type)) IN ({quoted(vocab.NODE_TYPES)}) THEN lower(trim(type)) ELSE 'unknown' END AS node_type, CASE WHEN replace(upper(trim(name)), ' ', '_') IN ({quoted(vocab.RELATIONS)}) THEN replace(upper(trim(name)), ' ', '_') ELSE 'RELATED_TO' END AS relation FROM graph_nodes")
def n23_coerced(spark, d):
    return table(spark, d, "graph_nodes").select("id", tx.node_type(F.col("type")).alias("node_type"), tx.relation(F.col("name")).alias("relation"))


@query(f"WITH g AS (SELECT lower(trim(name)) AS name, count(*) AS n FROM graph_nodes WHERE trim(name) <> '' GROUP BY ALL) SELECT s.src_type, s.src, s.relation, s.dst_type, s.dst, coalesce(a.n, 0) AS src_nodes, coalesce(b.n, 0) AS dst_nodes FROM {_SEED} LEFT JOIN g a ON a.name = lower(s.src) LEFT JOIN g b ON b.name = lower(s.dst)")
def x15_seed(spark, d):
    """The built-in edges, and how many extracted nodes have the names at their ends."""
    _, e = graph.seed_graph(spark)
    n = table(spark, d, "graph_nodes").where(F.trim("name") != "").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.count("*").alias("n"))
    e = e.select("src_type", "src", "relation", "dst_type", "dst")
    for end in ("src", "dst"):
        e = e.join(n.select(F.col("k").alias(f"_{end}"), F.col("n").alias(f"{end}_nodes")), F.lower(end) == F.col(f"_{end}"), "left").drop(f"_{end}")
    return e.na.fill(0, ["src_nodes", "dst_nodes"])


# --- questions to the graph ---------------------------------------------------------------------------------------

_HINTS = "[" + quoted(vocab.TERM_HINTS) + "]"
_TERMS = f"list_filter({_HINTS}, lambda h: contains(q, h)) || CASE WHEN contains(q, 'misfiring') THEN ['misfire'] ELSE [] END || list_filter(regexp_extract_all(q, '[a-z0-9][a-z0-9_-]{{3,}}'), lambda w: NOT list_contains([{quoted(vocab.TERM_STOPS)}], w))[1:8]"
_FIRST_TEN = "list_filter(t, lambda x, i: list_position(t, x) = i)[1:10]"


@query(f"SELECT doc_id, array_to_string({_FIRST_TEN}, ', ') AS terms FROM (SELECT doc_id, {_TERMS} AS t FROM (SELECT doc_id, coalesce(lower(text), '') AS q FROM documents))")
def n10_query_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.query_terms(F.col("text")), ", ").alias("terms"))


GRAPH_QUESTIONS = [(1, "Why does the Brackhaven stand overheat, is the fuel filter blocked?"), (2, "What causes misfiring with a fouled spark plug?"), (3, "Which bearing has play at the big-end?"), (4, "magnet of the flywheel")]
_ASKED = "(VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in GRAPH_QUESTIONS) + ") AS a(qid, text)"
_PATHS = """,
p0 AS (
    SELECT a.src || ' --CAUSED_BY--> ' || a.dst || CASE WHEN b.dst IS NULL THEN '' ELSE ' --FIXED_BY--> ' || b.dst END AS path, 'diagnostic_path' AS kind, CASE WHEN b.dst IS NULL THEN a.confidence ELSE b.confidence END AS confidence
    FROM e a LEFT JOIN e b ON b.src_type = a.dst_type AND b.src = a.dst AND b.relation = 'FIXED_BY' WHERE a.relation = 'CAUSED_BY'
    UNION ALL SELECT src || ' (' || src_type || ') --' || relation || '--> ' || dst || ' (' || dst_type || ')', 'neighborhood', confidence FROM e),
p AS (SELECT path, min(kind) AS kind, max(confidence) AS confidence FROM p0 GROUP BY path)"""


@query(
    _WITH
    + _PATHS
    + f""", a AS (SELECT qid, {_FIRST_TEN} AS terms FROM (SELECT qid, {_TERMS} AS t FROM (SELECT qid, lower(text) AS q FROM {_ASKED}))),
h AS (SELECT qid, path, kind, confidence, CAST(len(list_filter(terms, lambda t: contains(lower(path), t))) AS INT) AS hits FROM p, a),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, coalesce(confidence, 0) DESC, path) AS rank FROM h WHERE hits > 0)
SELECT qid, CAST(rank AS INT) AS rank, path, kind, hits, round(confidence, 6) AS confidence FROM k WHERE rank <= 5"""
)
def x16_kg_context(spark, d):
    asked = spark.createDataFrame(GRAPH_QUESTIONS, "qid int, text string")
    got = graph.ranked_paths(graph.all_paths(edges(spark, d)), asked)
    return got.withColumn("confidence", F.round("confidence", 6))


@query(_WITH + _PATHS + " SELECT path, kind, round(confidence, 6) AS confidence FROM p")
def u1_paths(spark, d):
    return graph.all_paths(edges(spark, d)).select("path", "kind", F.round("confidence", 6).alias("confidence"))


_VIEW = _WITH + """, v AS (SELECT DISTINCT type, name, doc_id FROM n), s AS (SELECT * FROM e WHERE (confidence IS NULL OR confidence >= 0.6 OR method = 'manual_seed'){more}
    AND EXISTS (SELECT 1 FROM v WHERE v.type = src_type AND v.name = src{doc}) AND EXISTS (SELECT 1 FROM v WHERE v.type = dst_type AND v.name = dst{doc}))"""


@query(_VIEW.format(more=" AND method <> 'manual_seed'", doc="") + " SELECT src_type, src, relation, dst_type, dst, doc_id, chunk FROM s")
def x25_view_edges(spark, d):
    n = graph.clean_nodes(nodes(spark, d))
    return graph.graph_view(n, edges(spark, d), min_confidence=0.6, include_seed=False)[1].select("src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk")


@query(_VIEW.format(more=" AND topic = 'fuel'", doc="") + " SELECT DISTINCT v.type, v.name FROM v JOIN (SELECT src_type AS type, src AS name FROM s UNION SELECT dst_type, dst FROM s) x USING (type, name)")
def x25_view_nodes(spark, d):
    n = graph.clean_nodes(nodes(spark, d))
    return graph.graph_view(n, edges(spark, d), min_confidence=0.6, topic="fuel")[0]


# --- extraction from passages -------------------------------------------------------------------------------------


@query()
def x13_rules(spark, d):
    """The relations that the sentences and tables of all chunks state, between known entities."""
    entities = table(spark, d, "canonical_entities").where("list_name = 'name'").select("type", "canonical_name", "aliases")
    _, seed = graph.seed_graph(spark)
    built_in = seed.select(F.col("src_type").alias("type"), F.col("src").alias("canonical_name")).union(seed.select("dst_type", "dst")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return rules.rule_edges(table(spark, d, "chunks"), ["id"], "content", entities.unionByName(built_in))


_UNITS_SQL = "|".join(sorted(vocab.RULE_UNITS, key=len, reverse=True))
_SENTENCES_SQL = r"(SELECT id, trim(unnest(regexp_split_to_array(regexp_replace(content, '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), '\n+'))) AS s FROM chunks)"
_PART_SQL = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in vocab.RULE_PARTS) + r")\b"


@query(
    rf"""WITH s AS (SELECT DISTINCT id, s, nullif(regexp_extract(s, '{_PART_SQL}'), '') AS part, regexp_extract_all(s, '(?i)((?:[±+-]\s*)?\b\d+(?:[.,]\d+)?\s*(?:{_UNITS_SQL}))(?:[^\p{{L}}\p{{N}}_/]|$)', 1) AS specs FROM {_SENTENCES_SQL} WHERE s <> '')
SELECT DISTINCT id, coalesce(part, '') AS part, trim(x) AS spec FROM (SELECT id, part, unnest(specs) AS x FROM s)"""
)
def x13_specs(spark, d):
    f = rules.facts(table(spark, d, "chunks"), ["id"], "content")
    return f.select("id", F.coalesce("part", F.lit("")).alias("part"), F.explode("specs").alias("spec")).distinct()


def _names(spark, d) -> DataFrame:
    c = table(spark, d, "canonical_entities").where("list_name = 'name' AND canonical_name IS NOT NULL")
    return c.select("type", F.col("canonical_name").alias("name"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias IS NOT NULL")


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(
    f"""WITH t AS (SELECT DISTINCT type, canonical_name AS name, ' ' || array_to_string({_WORDS_SQL.format('alias')}, ' ') || ' ' AS g FROM (SELECT type, canonical_name, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS alias FROM canonical_entities WHERE list_name = 'name')),
c AS (SELECT id, ' ' || array_to_string({_WORDS_SQL.format("coalesce(content, '')")}, ' ') || ' ' AS w FROM chunks) SELECT DISTINCT id, type, name FROM c JOIN t ON contains(w, g) WHERE length(g) > 2"""
)
def x14_mentions(spark, d):
    return graph.mentions(table(spark, d, "chunks"), ["id"], "content", _names(spark, d))


_G_ENGINE = r"\b\p{Lu}[\p{L}-]+\s*\p{Lu}?\d{3,4}\p{L}?\b"
_G_SPEC = r"(?i)((?:[±+-]\s*)?\b\d+(?:[.,]\d+)?\s*(?:" + "|".join(sorted(vocab.GRAPH_UNITS, key=len, reverse=True)) + r"))(?:[^\p{L}\p{N}_/]|$)"
_CO = {("engine", "part"): "HAS_PART", ("engine", "spec"): "HAS_SPEC", ("part", "spec"): "HAS_SPEC", ("part", "procedure"): "REQUIRES_PROCEDURE", ("part", "warning"): "RELATED_TO", ("symptom", "cause"): "CAUSED_BY", ("cause", "fix"): "FIXED_BY"}


@query(
    rf"""WITH m AS ({SQL['x14_mentions']} UNION SELECT id, 'engine', trim(regexp_replace(unnest(regexp_extract_all(content, '{_G_ENGINE}')), '\s+', ' ', 'g')) FROM chunks
UNION SELECT id, 'spec', trim(regexp_replace(unnest(regexp_extract_all(content, '{_G_SPEC}', 1)), '\s+', ' ', 'g')) FROM chunks),
p AS (SELECT a.type AS src_type, a.name AS src, CASE concat_ws('>', a.type, b.type) {' '.join(f"WHEN '{s}>{d}' THEN '{r}'" for (s, d), r in _CO.items())} END AS relation, b.type AS dst_type, b.name AS dst FROM m a JOIN m b USING (id) WHERE a.type <> b.type OR a.name <> b.name)
SELECT src_type, src, relation, dst_type, dst, count(*) AS n_chunks FROM p WHERE relation IS NOT NULL GROUP BY ALL"""
)
def x14_cooccur(spark, d):
    """Edges between listed entities, engines and numbers with units that occur in one chunk, with their number of chunks."""
    chunks = table(spark, d, "chunks")
    found = graph.mentions(chunks, ["id"], "content", _names(spark, d)).unionByName(graph.pattern_mentions(chunks, ["id"], "content")).distinct()
    return graph.co_occurrence(found, ["id"], rules=_CO).groupBy("src_type", "src", "relation", "dst_type", "dst").agg(F.count("*").alias("n_chunks"))


_GRAPH_PART_SQL = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in vocab.GRAPH_PARTS) + r")\b"
_GRAPH_SPEC_SQL = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:" + "|".join(sorted(vocab.GRAPH_UNITS, key=len, reverse=True)) + r")(?:[^\p{L}\p{N}_/]|$)"
_SCORE_SQL = (
    "CASE WHEN trim(t) = '' THEN 0.0 ELSE "
    + " + ".join(f"CASE WHEN contains(lower(t), '{w}') THEN {v} ELSE 0.0 END" for w, v in vocab.KG_WEIGHTS.items())
    + rf" + CASE WHEN kind = 'table' THEN 3.0 ELSE 0.0 END + CASE WHEN regexp_matches(t, '{_GRAPH_PART_SQL}') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(t, '{_GRAPH_SPEC_SQL}') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(t, '\b\p{{Lu}}[\p{{L}}-]+\s*\p{{Lu}}?\d{{3,4}}\p{{L}}?\b') THEN 1.0 ELSE 0.0 END END"
)
_SCORED_SQL = f"SELECT id, doc_id, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM (SELECT id, doc_id, coalesce(content, '') AS t, metadata.chunk_type AS kind FROM chunks)"


def _scored(spark, d) -> DataFrame:
    return spread(table(spark, d, "chunks").select("id", "doc_id", "content", "metadata.chunk_type")).select("id", "doc_id", graph.passage_score(F.col("content"), F.coalesce(F.col("chunk_type") == "table", F.lit(False))).alias("score"))


@query("SELECT id, score FROM (" + _SCORED_SQL + ")")
def x12_kg_score(spark, d):
    return _scored(spark, d).select("id", "score")


@query(f"""WITH s AS ({_SCORED_SQL}), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS rn FROM s)
SELECT id, doc_id, score FROM r WHERE n <= 40 OR (best > 0 AND score > 0 AND rn <= 40) OR (best <= 0 AND rn <= 5)""")
def t7_topn_fallback(spark, d):
    return graph.select_passages(_scored(spark, d), doc="doc_id", order="id")


# --- names --------------------------------------------------------------------------------------------------------


def _kinds_sql(name: str, units: list[str], letter: str) -> str:
    number, cut_up = r"^\d+(?:[.,]\d+)?$", r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$|^\d+(?:\.\d+){1,5}$"
    pages = "|".join(w.replace(".", "[.]") for w in normalize.PAGE_WORDS)
    kind = (
        rf"CASE WHEN regexp_matches(t, '^\d{{4}}$') THEN 'Y' WHEN regexp_matches(t, '{number}') THEN 'N' WHEN regexp_matches(t, '{cut_up}') THEN 'X' WHEN t IN ('+', '-', '±') THEN 'S' "
        rf"WHEN regexp_matches(t, '^m\d+(?:x\d+(?:[.,]\d+)?)?$') THEN 'T' WHEN t IN ({quoted(units)}) THEN '{letter}' WHEN t IN ({quoted(normalize.MONTHS)}) THEN 'M' WHEN t IN ({quoted(normalize.PAGE_WORDS)}) THEN 'P' WHEN regexp_matches(t, '^(?:{pages})\d+$') THEN 'PN' ELSE 'w' END"
    )
    return f"array_to_string(list_transform(regexp_extract_all(lower({name}), '{normalize._TOKEN}'), lambda t: {kind}), '')"


CLEANED = r"regexp_replace(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g')), '^[ :;,.()\[\]{}]+|[ :;,.()\[\]{}]+$', '', 'g')"
NOISY = f"(length(n) < 2 OR {_kinds_sql('n', normalize.LONE_UNITS, 'U')} IN ({quoted(sorted(normalize._NOISE_KINDS | {'PY', 'SY'}))}) OR " + " OR ".join(f"contains(lower(n), '{p}')" for p in normalize.PHRASES) + ")"
SPECIFIC = f"({_kinds_sql('n', normalize.SPEC_UNITS, 'V')} IN ({quoted(sorted(normalize._SPEC_KINDS | {'YV', 'SYV', 'SSNV', 'SSYV'}))}))"
ENGINE_SQL = r"(regexp_matches(lower(n), 'two[- ]stroke engine') OR regexp_matches(n, '^\p{Lu}[\p{L}-]*\s*\p{Lu}?\d{3,4}\p{L}?\b'))"


@query(f"SELECT id, {NOISY} AS noise, {SPECIFIC} AS spec, {ENGINE_SQL} AS engine FROM (SELECT id, {CLEANED} AS n FROM graph_nodes)")
def n19_noise(spark, d):
    return table(spark, d, "graph_nodes").select("id", normalize.is_noise(F.col("name")).alias("noise"), normalize.is_spec(F.col("name")).alias("spec"), normalize.is_engine(F.col("name")).alias("engine"))


_KEY = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')), '^[ :;,.()\[\]{{}}]+|[ :;,.()\[\]{{}}]+$', '', 'g')), '[\-_]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT {_KEY.format(c='a')} AS k, type AS t, min(canonical_name) AS c FROM (SELECT type, canonical_name, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS a FROM canonical_entities WHERE list_name = 'name') GROUP BY ALL),
b AS (SELECT id, {CLEANED} AS n, lower(trim(coalesce(type, 'unknown'))) AS p, {_KEY.format(c='name')} AS k FROM graph_nodes),
j AS (SELECT b.id, a.t, a.c, row_number() OVER (PARTITION BY b.id ORDER BY CASE WHEN a.t = b.p THEN -1 WHEN a.t = 'part' THEN 0 WHEN a.t = 'system' THEN 1 WHEN a.t = 'symptom' THEN 2 WHEN a.t = 'cause' THEN 3 WHEN a.t = 'fix' THEN 4 ELSE 5 END, a.t, a.c) AS rn FROM b JOIN a ON a.k = b.k AND a.k <> ''),
r AS (SELECT b.*, j.t, j.c, {SPECIFIC} AS spec, CASE WHEN n = '' THEN 'empty' WHEN {NOISY} AND NOT {SPECIFIC} THEN 'noise' ELSE '' END AS reason FROM b LEFT JOIN j ON j.id = b.id AND j.rn = 1)
SELECT id, CASE WHEN reason <> '' THEN '' WHEN spec THEN n ELSE coalesce(c, upper(left(n, 1)) || substring(n, 2)) END AS canonical, CASE WHEN reason <> '' THEN p WHEN spec THEN 'spec' ELSE coalesce(t, p) END AS node_type, reason FROM r""")
def n21_normalize(spark, d):
    return normalize.normalize_entities(table(spark, d, "graph_nodes"), table(spark, d, "canonical_entities").where("list_name = 'name'"), key_cols=["id"], name_col="name", type_col="type")


@query(f"""WITH a AS (SELECT {_KEY.format(c='a')} AS k, min(type) AS t FROM (SELECT type, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS a FROM canonical_entities WHERE list_name = 'name') GROUP BY ALL),
b AS (SELECT id, {CLEANED} AS n, {_KEY.format(c='name')} AS k, lower(concat_ws(' ', {CLEANED}, props.doc_id)) AS c FROM graph_nodes)
SELECT id, CASE WHEN n = '' OR ({NOISY} AND NOT {SPECIFIC}) THEN 'unknown' WHEN {SPECIFIC} THEN 'spec' WHEN t IS NOT NULL THEN t WHEN {ENGINE_SQL} THEN 'engine' WHEN regexp_matches(c, 'procedure|inspect|check|replace|clean|adjust') THEN 'procedure' WHEN regexp_matches(c, 'warning|caution|danger|achtung') THEN 'warning' ELSE 'unknown' END AS kind FROM b LEFT JOIN a ON a.k = b.k AND b.k <> ''""")
def n22_classified(spark, d):
    known = normalize.alias_table(table(spark, d, "canonical_entities").where("list_name = 'name'")).groupBy("alias_key").agg(F.min("alias_type").alias("known"))
    n = table(spark, d, "graph_nodes").select("id", "name", F.col("props.doc_id").alias("context"), normalize.lookup_key(F.col("name")).alias("alias_key"))
    return n.join(known, "alias_key", "left").select("id", normalize.classify(F.col("name"), F.col("context"), F.col("known")).alias("kind"))


# --- enrichment and formulas --------------------------------------------------------------------------------------

_E_PART = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in vocab.PART_WORDS) + r")\b"
_E_TAG = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in vocab.TAG_WORDS) + r")\b"
_E_SPEC = r"(?i)\b(\d+\.?\d*\s*(?:" + "|".join(sorted(vocab.SPEC_UNITS, key=len, reverse=True)) + r"))(?:[^\p{L}\p{N}_]|$)"
_E_ENGINE = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+\s+\p{Lu}?\d{3,4}\p{L}*)(?:[^\p{L}\p{N}_]|$)"
_OF = "list_transform(regexp_extract_all(content, '{p}', {g}), lambda n: {{'type': '{t}', 'name': {n}}})"


@query(f"""WITH f AS (SELECT id, {_OF.format(g=1, p=_E_ENGINE, t='engine', n='trim(n)')} || {_OF.format(g=0, p=_E_PART, t='part', n='lower(n)')} || {_OF.format(g=1, p=_E_SPEC, t='spec', n='trim(n)')} AS l FROM chunks WHERE length(content) >= 80),
g AS (SELECT id, l, list_transform(l, lambda e: lower(e.name)) AS k FROM f), o AS (SELECT id, list_filter(l, lambda e, i: list_position(k, lower(e.name)) = i)[1:20] AS l FROM g)
SELECT id, CAST(i AS INT) AS no, l[i].type AS type, l[i].name AS name FROM o, unnest(generate_series(1, len(l))) AS u(i)""")
def x2_entities(spark, d):
    found, _ = answers.entities(F.col("content"))
    return table(spark, d, "chunks").select("id", F.posexplode_outer(found).alias("p", "e")).where("e IS NOT NULL").select("id", (F.col("p") + 1).alias("no"), "e.type", "e.name")


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '{_E_TAG}'), lambda n: lower(n))))[1:8], ', ') AS tags FROM chunks WHERE length(content) >= 80")
def x2_tags(spark, d):
    _, tags = answers.entities(F.col("content"))
    return table(spark, d, "chunks").where(F.length("content") >= 80).select("id", F.array_join(tags, ", ").alias("tags"))


@query(f"""WITH f AS (SELECT id, l, list_transform(l, lambda e: lower(e.name)) AS k FROM (SELECT id, {_OF.format(g=1, p=_E_ENGINE, t='engine', n='trim(n)')} || {_OF.format(g=0, p=_E_PART, t='part', n='lower(n)')} || {_OF.format(g=1, p=_E_SPEC, t='spec', n='trim(n)')} AS l FROM chunks WHERE length(content) >= 80)),
o AS (SELECT unnest(list_filter(l, lambda e, i: list_position(k, lower(e.name)) = i)[1:20]) AS e FROM f)
SELECT kind, name, n FROM (SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS r FROM (SELECT e.type AS kind, lower(e.name) AS name FROM o UNION ALL SELECT 'tag', unnest(metadata.tags) FROM chunks) GROUP BY kind, name) WHERE r <= 30""")
def a7_array_freq(spark, d):
    """The 30 most frequent entities of each kind, and tags."""
    from pyspark.sql import Window

    chunks = table(spark, d, "chunks")
    found, _ = answers.entities(F.col("content"))
    every = chunks.select(F.inline_outer(found)).where("name IS NOT NULL").select(F.col("type").alias("kind"), F.lower("name").alias("name")).unionByName(chunks.select(F.lit("tag").alias("kind"), F.explode("metadata.tags").alias("name")))
    n = every.groupBy("kind", "name").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))).where("r <= 30").drop("r")


def stored_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas of all chunks with the document, topic and title of each."""
    c = table(spark, d, "chunks")
    f = answers.formulas(c, ["id"], "content")
    return f.join(c.select("id", "doc_id", F.col("metadata.topic").alias("topic"), F.col("metadata.source_title").alias("source_title")), "id")


@query()
def x6_formulas(spark, d):
    """Formulas in all documents and chunks, with their context."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_id"), "text")
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("source_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    return answers.formulas(docs.unionByName(chunks), ["source_table", "row_id"], "text")


def _folded_sql(c: str) -> str:
    """Mathematical letters and signs as plain ones."""
    import unicodedata

    letters = {chr(i): unicodedata.normalize("NFKC", chr(i)) for i in range(0x1D400, 0x1D800) if len(unicodedata.normalize("NFKC", chr(i))) == 1 and unicodedata.normalize("NFKC", chr(i)) != chr(i)}
    out = f"translate({c}, '{''.join(letters)}', '{''.join(letters.values())}')"
    signs = vocab.GREEK | vocab.FORMULA_SIGNS | {chr(0x2080 + i): f"_{i}" for i in range(10)} | {"²": "^2", "³": "^3", "¹": "^1"}
    for a, b in signs.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _tidy_sql(c: str) -> str:
    out = rf"regexp_replace({c}, '^[ ,.;]+|[ ,.;]+$', '', 'g')"
    for a, b in tx._FORMULA_REPAIRS:
        if "(?=" in a:  # the other engine looks ahead
            a, b = a.replace("(?=", "(").replace("(])", "(])"), "$1 * $2"
            out = f"regexp_replace({out}, '{a}', '{b.replace('$', chr(92))}', 'g')"
        out = f"regexp_replace({out}, '{a}', '{b.replace('$', chr(92))}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '\s*=\s*', ' = ', 'g'), '\s+', ' ', 'g'), ' ')"


_FORMULAS_SQL = rf"""WITH l AS (SELECT id, trim(unnest(string_split(t, chr(10))), ' ') AS l FROM (SELECT id, {_folded_sql('content')} AS t FROM chunks WHERE regexp_matches(content, '=|\\') OR regexp_matches(content, '{answers.MARKER}'))),
f AS (SELECT id, unnest(regexp_extract_all(l, '{answers.COMMAND}')) AS f, true AS is_latex FROM l
      UNION ALL SELECT id, f, false FROM (SELECT id, unnest(regexp_extract_all(l, '{answers.NAME}\s*=\s*{answers.EXPRESSION}')) AS f FROM l) WHERE regexp_matches(f, '{answers._OPERATOR}')
      UNION ALL SELECT id, l, false FROM l WHERE contains(l, '=') AND length(l) <= 240 AND regexp_matches(l, '{answers._OPERATOR}')
      UNION ALL SELECT id, left(l, 240), false FROM l WHERE regexp_matches(l, '{answers.MARKER}')),
g AS (SELECT id, formula, bool_or(is_latex) AS is_latex FROM (SELECT id, {_tidy_sql('f')} AS formula, is_latex FROM f) x WHERE length(formula) >= 5 GROUP BY id, formula)"""


@query(_FORMULAS_SQL + " SELECT id, formula, is_latex FROM g")
def x6_chunk_formulas(spark, d):
    """Formulas of all chunks."""
    return stored_formulas(spark, d).select("id", "formula", "is_latex")


@query(_FORMULAS_SQL + " SELECT coalesce(c.metadata.topic, 'Unsorted') AS topic, count(*) AS n FROM g JOIN chunks c USING (id) GROUP BY ALL")
def a10_formula_topics(spark, d):
    """Formulas by topic."""
    return stored_formulas(spark, d).groupBy(F.coalesce("topic", F.lit("Unsorted")).alias("topic")).agg(F.count("*").alias("n"))


@query()
def x24_formula_search(spark, d):
    """The newest formulas for questions about some."""
    asked = spark.createDataFrame([(1, "What is the formula for eta?", None), (2, "show me the equation of beta", "fuel"), (3, "", None)], "qid int, text string, topic string")
    return answers.search_formulas(stored_formulas(spark, d), asked)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
