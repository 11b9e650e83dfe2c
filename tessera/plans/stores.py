"""Queries on stored tables and their changes, on figures, files and gaps, and on streams run as batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import answers, chunking, graph, language_profile, store, trust
from ..session import table
from ..streaming import pipelines
from . import knowledge, relations
from .relations import quoted

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


# --- citations of several kinds -----------------------------------------------------------------------------------


@query(f"""WITH g AS ({relations.SQL["x16_kg_context"].replace(relations._ASKED, knowledge._ASKED)}), c AS ({knowledge.SQL["x22_citations"]}), u AS (SELECT qid, 0 AS leg, rank, kind, path AS label FROM g UNION ALL SELECT qid, 1, no, 'chunk', label FROM c)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY leg, rank, label) AS INT) AS no, kind, label FROM u""")
def x22_numbered(spark, d):
    """Graph paths and passages that each question's answer cites, numbered through."""
    asked = knowledge.questions(spark)
    paths = graph.ranked_paths(graph.all_paths(relations.edges(spark, d)), asked).select("qid", "rank", "kind", F.col("path").alias("label"))
    hits = knowledge.x22_citations(spark, d).select("qid", F.col("no").alias("rank"), F.lit("chunk").alias("kind"), "label")
    return answers.number_citations(paths, hits)


# --- batches, nodes and edges -------------------------------------------------------------------------------------

@query(f"""SELECT p.parsed_id, coalesce(c.n_chunks, 0) + coalesce(len(p.tables), 0) AS n_chunks, coalesce(f.n, 0) AS n_facts FROM parsed_docs p
LEFT JOIN ({knowledge.SQL["w6_sliding_chunks"]}) c USING (parsed_id) LEFT JOIN (SELECT parsed_id, count(*) AS n FROM ({knowledge.SQL["x5_facts"]}) GROUP BY parsed_id) f USING (parsed_id)""")
def k1_store_batch(spark, d):
    """Passages and facts that the batch of all parsed documents adds, by document."""
    docs = table(spark, d, "parsed_docs")
    got = store.store_batch(docs, ["parsed_id"], "text")
    n = lambda t, c: got[t].groupBy("parsed_id").agg(F.count("*").alias(c))
    both = docs.select("parsed_id").join(n("chunks", "n_chunks"), "parsed_id", "left").join(n("facts", "n_facts"), "parsed_id", "left")
    return both.select("parsed_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


_FIELDS = ("doc_id", "source_chunk_id", "page", "confidence", "extraction_method")


@query("SELECT type, name, " + ", ".join(f"arg_max(props.{f}, id) FILTER (props.{f} IS NOT NULL) AS {f}" for f in _FIELDS) + " FROM graph_nodes GROUP BY type, name")
def k4_node_upsert(spark, d):
    """Nodes merged by type and name, of each property the last value."""
    n = table(spark, d, "graph_nodes").select("id", "type", "name", *[F.col(f"props.{f}").alias(f) for f in _FIELDS])
    return graph.merge_nodes(n, "id", list(_FIELDS))


_KEY = "lower(concat_ws('|', coalesce(src_type, ''), coalesce(src, ''), relation, coalesce(dst_type, ''), coalesce(dst, ''), coalesce(doc_id, ''), coalesce(CAST(chunk AS VARCHAR), '')))"


@query(f"SELECT DISTINCT edge_key FROM (WITH {relations.EDGES_SQL} SELECT {_KEY} AS edge_key FROM e)")
def k5_edge_insert(spark, d):
    """The built-in edges and those of extracted nodes, each key once."""
    e = relations.edges(spark, d).drop("topic")
    key = tx.edge_key(*[F.col(c) for c in ("src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk")])
    got = graph.add_edges(e.where("method = 'manual_seed'"), e.where("method <> 'manual_seed' OR method IS NULL"), key, ["src_type", "src", "relation", "dst_type", "dst", "doc_id", "chunk"])
    return got.select("edge_key").distinct()


_IMAGES = "(SELECT DISTINCT doc_id, i.page AS page, i.image_index AS image_index, i.caption AS caption FROM (SELECT doc_id, unnest(images) AS i FROM parsed_docs))"


def _images(spark, d) -> DataFrame:
    return table(spark, d, "parsed_docs").select("doc_id", F.inline("images")).distinct()


def _chunk_places(spark, d) -> DataFrame:
    return table(spark, d, "chunks").select("id", "doc_id", F.col("metadata.page").alias("page"), F.col("metadata.chunk_index").alias("chunk_index"))


@query(f"""WITH i AS (SELECT * FROM {_IMAGES} WHERE doc_id NOT IN (SELECT doc_id FROM parsed_docs WHERE version >= 2 AND doc_id IS NOT NULL)),
p AS (SELECT doc_id, metadata.page AS page, arg_min(id, (coalesce(metadata.chunk_index, 0), id)) AS id FROM chunks WHERE metadata.page IS NOT NULL GROUP BY doc_id, metadata.page), f AS (SELECT doc_id, min(id) AS id FROM chunks GROUP BY doc_id)
SELECT i.*, CASE WHEN i.page IS NOT NULL THEN coalesce(p.id, f.id) END AS chunk_id FROM i LEFT JOIN p ON p.doc_id = i.doc_id AND p.page = i.page LEFT JOIN f ON f.doc_id = i.doc_id""")
def k6_images(spark, d):
    """Images of documents that have none stored (stored are those with a second version), linked to the nearest chunk."""
    docs = table(spark, d, "parsed_docs")
    return store.add_images(docs.where("version >= 2").select("doc_id"), docs, _chunk_places(spark, d)).select("doc_id", "page", "image_index", "caption", "chunk_id")


@query(f"""WITH i AS (SELECT * FROM {_IMAGES}), h AS (SELECT id, doc_id, metadata.page AS page FROM chunks WHERE metadata.chunk_type = 'prose'),
a AS (SELECT h.id, row_number() OVER (PARTITION BY h.id ORDER BY i.page, i.image_index) AS no, i.page, i.image_index, i.caption FROM h JOIN i ON i.doc_id = h.doc_id AND i.page = h.page),
b AS (SELECT h.id, row_number() OVER (PARTITION BY h.id ORDER BY i.page, i.image_index) AS no, i.page, i.image_index, i.caption FROM h JOIN i ON i.doc_id = h.doc_id WHERE h.id NOT IN (SELECT id FROM a))
SELECT id, CAST(no AS INT) AS no, page, image_index, caption FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x WHERE no <= 3""")
def j18_figures(spark, d):
    """Up to three figures of each prose chunk's page, or else of its document."""
    hits = table(spark, d, "chunks").where("metadata.chunk_type = 'prose'").select("id", "doc_id", F.col("metadata.page").alias("page"))
    return store.figures_for(hits, _images(spark, d))


@query("""WITH c AS (SELECT doc_id, count(*) AS n_chunks, max(metadata.filename) AS filename, min(metadata.lang) AS lang FROM chunks GROUP BY doc_id),
m AS (SELECT doc_id, max(version) AS version, CAST(sum(coalesce(len(images), 0)) AS BIGINT) AS n_images FROM parsed_docs GROUP BY doc_id) SELECT c.doc_id, c.n_chunks, c.filename, c.lang, coalesce(m.version, 1) AS version, coalesce(m.n_images, 0) AS n_images FROM c LEFT JOIN m ON m.doc_id = c.doc_id""")
def j6_documents_list(spark, d):
    c = table(spark, d, "chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("metadata.filename").alias("filename"), F.min("metadata.lang").alias("lang"))
    m = table(spark, d, "parsed_docs").groupBy("doc_id").agg(F.max("version").alias("version"), F.sum(F.when(F.col("images").isNull(), 0).otherwise(F.size("images"))).alias("n_images"))
    return c.join(m, "doc_id", "left").select("doc_id", "n_chunks", "filename", "lang", F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


@query("SELECT extension, n, bytes FROM (SELECT extension, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_inventory GROUP BY extension) x ORDER BY n DESC, extension NULLS LAST LIMIT 40")
def a3_top_extensions(spark, d):
    """The forty most frequent extensions."""
    return table(spark, d, "file_inventory").groupBy("extension").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("n"), F.asc_nulls_last("extension")).limit(40)


# --- turns, feedback and gaps -------------------------------------------------------------------------------------


def _turns(spark, d, when: str) -> DataFrame:
    return table(spark, d, "events").where(when).select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("role"), F.col("props").alias("content"))


_TURNS_SQL = "SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, ts, event_id) - 1 AS INT) AS turn, event_type AS role, props AS content FROM events"


def _conversations(spark, d) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("at")
    old = _turns(spark, d, "event_id % 2 = 0").withColumn("turn", F.row_number().over(w) - 1)
    return store.append_turns(old, _turns(spark, d, "event_id % 2 = 1"))


@query(_TURNS_SQL)
def k7_append_turns(spark, d):
    """Conversations to which the odd events are appended as new turns."""
    return _conversations(spark, d)


@query(f"SELECT k, session_id, turn, role FROM (SELECT k, t.*, row_number() OVER (PARTITION BY k, session_id ORDER BY turn DESC) AS r FROM ({_TURNS_SQL}) t CROSS JOIN (VALUES (4), (6)) v(k)) x WHERE r <= k")
def w4_last_turns(spark, d):
    """The four and the six last turns of each conversation."""
    turns = _conversations(spark, d).drop("content")
    four, six = (store.last_turns(turns, most=k).select(F.lit(k).alias("k"), "session_id", "turn", "role") for k in (4, 6))
    return four.unionByName(six)


_CORRECTED = "(SELECT doc_id, filename AS question, CASE WHEN doc_id % 7 = 0 THEN '  ' || source || ' ' END AS correction FROM documents)"


@query(f"SELECT content, quality_score, vote_count, source_type FROM (SELECT trim(correction) AS content, 1.0 AS quality_score, 1 AS vote_count, 'expert_correction' AS source_type FROM {_CORRECTED} WHERE length(trim(correction)) > 10 UNION ALL SELECT content, round(quality_score, 6), vote_count, 'document' FROM chunks) x")
def k9_corrections(spark, d):
    """Chunks together with corrections that became chunks."""
    feedback = table(spark, d, "documents").select(F.col("filename").alias("question"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), "source", F.lit(" "))).alias("correction"))
    chunks = table(spark, d, "chunks").select("content", F.round("quality_score", 6).alias("quality_score"), "vote_count", F.lit("document").alias("source_type"))
    return store.add_corrections(chunks, feedback, least=10)


@query("SELECT id, doc_id, table_name FROM (SELECT id, doc_id, 'chunks' AS table_name FROM chunks UNION ALL SELECT reading_id, doc_id, 'sheet_readings' FROM sheet_readings UNION ALL SELECT parsed_id, doc_id, 'parsed_docs' FROM parsed_docs) x WHERE NOT EXISTS (SELECT 1 FROM parsed_docs p WHERE p.version >= 2 AND p.doc_id = x.doc_id)")
def k10_cascade_delete(spark, d):
    """What is left in the tables that hold a document's rows when all documents with a second version go."""
    p = table(spark, d, "parsed_docs")
    tabs = {"chunks": table(spark, d, "chunks").select("id", "doc_id"), "sheet_readings": table(spark, d, "sheet_readings").select(F.col("reading_id").alias("id"), "doc_id"), "parsed_docs": p.select(F.col("parsed_id").alias("id"), "doc_id")}
    left, _ = store.delete_documents(tabs, p.where("version >= 2"))
    out = [df.select("id", "doc_id", F.lit(n).alias("table_name")) for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("WITH x AS (SELECT doc_id FROM parsed_docs WHERE version >= 2) SELECT 'chunks' AS table_name, count(*) AS n_deleted FROM chunks WHERE doc_id IN (SELECT doc_id FROM x) UNION ALL SELECT 'sheet_readings', count(*) FROM sheet_readings WHERE doc_id IN (SELECT doc_id FROM x) UNION ALL SELECT 'parsed_docs', count(*) FROM parsed_docs WHERE doc_id IN (SELECT doc_id FROM x)")
def k10_deleted(spark, d):
    p = table(spark, d, "parsed_docs")
    return store.delete_documents({n: table(spark, d, n).select("doc_id") for n in ("chunks", "sheet_readings", "parsed_docs")}, p.where("version >= 2"))[1]


_GAP_LOG = "(SELECT filename AS question, coalesce(source, 'none') AS reason, doc_id % 3 = 0 AS resolved, doc_id AS seq FROM documents WHERE filename IS NOT NULL)"


@query(f"SELECT question, reason FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY seq DESC) AS r FROM {_GAP_LOG}) x WHERE r = 1 AND NOT resolved")
def k12_open_gaps(spark, d):
    """Entries of a log of gaps, by file, whose last state is open."""
    log = table(spark, d, "documents").where("filename IS NOT NULL").select(F.col("filename").alias("question"), F.coalesce("source", F.lit("none")).alias("reason"), (F.col("doc_id") % 3 == 0).alias("resolved"), F.col("doc_id").alias("seq"))
    return store.open_gaps(log)


@query(f"SELECT q.qid, 'Question: ' || q.text || chr(10) || chr(10) || 'Answer: ' || q.qid || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(s.sources, 'none') AS report FROM {knowledge._ASKED.replace(' AS a(', ' AS q(')} LEFT JOIN (SELECT qid, string_agg('[' || no || '] ' || label, chr(10) ORDER BY no, label) AS sources FROM ({knowledge.SQL['x22_citations']}) GROUP BY qid) s ON s.qid = q.qid")
def k13_report(spark, d):
    """Answers with their numbered sources as text."""
    asked = knowledge.questions(spark)
    given = asked.select("qid", F.col("text").alias("question"), F.concat(F.lit("Answer: "), F.col("qid").cast("string")).alias("answer"))
    return store.answer_report(given, knowledge.x22_citations(spark, d))


@query("SELECT id, coalesce(vote_count, 0) AS vote_count, coalesce(downvote_count, 0) AS downvote_count, round(coalesce(quality_score, 0.0), 6) AS quality_score, coalesce(nullif(regexp_extract(metadata.filename, '\\.([^.]+)$', 1), ''), 'unknown') AS file_type FROM chunks")
def k14_backfill(spark, d):
    """Counters and file types that older chunks lack."""
    c = table(spark, d, "chunks").select("id", "vote_count", "downvote_count", "quality_score", F.nullif(F.regexp_extract("metadata.filename", r"\.([^.]+)$", 1), F.lit("")).alias("file_type"))
    got = store.missing_columns(c, {"vote_count": F.lit(0), "downvote_count": F.lit(0), "quality_score": F.lit(0.0), "file_type": F.lit("unknown")})
    return got.withColumn("quality_score", F.round("quality_score", 6))


_Q17 = [(1, "why does the trouble keep coming back with the fuel pump"), (2, "noise measurement at the fence and the level of the sound")]
_ASKED17 = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _Q17) + ") AS a(qid, text)"
_WORDS17 = "list_filter(list_distinct(regexp_split_to_array(lower({t}), '\\s+')), lambda w: w <> '' AND NOT list_contains([" + quoted(vocab.GAP_STOPS) + "], w))"


@query(f"""WITH a AS (SELECT qid, {_WORDS17.format(t='text')} AS w FROM {_ASKED17}), g AS (SELECT doc_id, uploaded_at, {_WORDS17.format(t='text')} AS w FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY uploaded_at DESC NULLS LAST, doc_id DESC LIMIT 100)),
h AS (SELECT qid, doc_id, uploaded_at, len(list_intersect(a.w, g.w)) AS shared FROM a, g)
SELECT qid, doc_id, shared, CAST(no AS INT) AS no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY uploaded_at DESC NULLS LAST, doc_id DESC) AS no FROM h WHERE shared >= 3) x WHERE no <= 3""")
def j17_word_overlap(spark, d):
    """Of the hundred newest texts the three newest that share three uncommon words with a question."""
    words = lambda c: F.filter(F.array_distinct(tx.tokens(c)), lambda w: ~w.isin(vocab.GAP_STOPS))
    newest = table(spark, d, "documents").where("text IS NOT NULL").orderBy(F.desc_nulls_last("uploaded_at"), F.desc("doc_id")).limit(100).select("doc_id", "uploaded_at", words(F.col("text")).alias("g"))
    asked = spark.createDataFrame(_Q17, "qid int, text string").select("qid", words(F.col("text")).alias("w"))
    both = newest.crossJoin(F.broadcast(asked)).withColumn("shared", F.size(F.array_intersect("w", "g")).cast("bigint")).where("shared >= 3")  # a hundred rows by the questions
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("uploaded_at"), F.desc("doc_id"))
    return both.withColumn("no", F.row_number().over(w)).where("no <= 3").select("qid", "doc_id", "shared", "no")


_LOOKUPS = [(1, "torque", None), (2, "temp", "fuel"), (3, "rpm", "manual"), (4, "nothing like it", None)]


@query(f"""WITH f AS (SELECT doc_id, x.* FROM ({knowledge.SQL["x5_facts"]}) x JOIN parsed_docs USING (parsed_id)), a AS (SELECT * FROM (VALUES (1, 'torque', NULL), (2, 'temp', 'fuel'), (3, 'rpm', 'manual'), (4, 'nothing like it', NULL)) v(qid, k, engine))
SELECT qid, CAST(no AS INT) AS no, doc_id, sheet, key, value FROM (SELECT a.qid, f.*, row_number() OVER (PARTITION BY qid ORDER BY key, doc_id, value, sheet, parsed_id) AS no FROM f JOIN a ON contains(lower(f.key), a.k) AND (a.engine IS NULL OR contains(lower(f.row_label), a.engine) OR contains(lower(f.doc_id), a.engine))) x WHERE no <= 20""")
def x18_lookup(spark, d):
    """Cells of tables by what their key has, and their row or document."""
    docs = table(spark, d, "parsed_docs")
    facts = chunking.table_facts(docs, ["parsed_id", "doc_id"])
    asked = spark.createDataFrame(_LOOKUPS, "qid int, key string, engine string")
    return store.spec_lookup(facts, asked).select("qid", "no", "doc_id", "sheet", "key", "value")


# --- files --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT doc_id, metadata.filename AS filename FROM parsed_docs), h AS (SELECT p.*, f.id, f.status, f.error, f.created_at FROM p LEFT JOIN file_inventory f ON lower(f.file_name) = lower(p.filename) OR f.file_name = p.doc_id)
SELECT doc_id, filename, status, error FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, filename ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM h) x WHERE r = 1""")
def j19_latest_match(spark, d):
    return store.latest_job(table(spark, d, "parsed_docs").select("doc_id", F.col("metadata.filename").alias("filename")), table(spark, d, "file_inventory"))


def _filtered(files: DataFrame, *, topic: str | None = None, supported: bool | None = None, largest: int | None = None, extensions: list[str] | None = None) -> DataFrame:
    given = lambda v, c: None if v is None else c
    return store.optional(files, given(topic, F.col("topic") == topic), given(supported, F.col("supported") == supported), given(largest, F.col("size_bytes") <= F.lit(largest)), given(extensions, F.col("extension").isin(extensions or [])))


_CASES = [(1, {}), (2, {"topic": "Propeller"}), (3, {"supported": True, "largest": 5_000_000}), (4, {"topic": "CAD", "supported": True, "extensions": [".pdf", "pdf", ".docx"]}), (5, {"largest": 0})]
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_CASES_SQL = "(VALUES " + ", ".join(f"({i}, {_lit(c.get('topic'))}, {_lit(c.get('supported'))}, {_lit(c.get('largest'))}, {'[' + quoted(c['extensions']) + ']' if 'extensions' in c else 'NULL'})" for i, c in _CASES) + ") AS c(no, topic, supported, largest, extensions)"


@query(f"SELECT c.no, f.id FROM file_inventory f JOIN {_CASES_SQL} ON (c.topic IS NULL OR f.topic = c.topic) AND (c.supported IS NULL OR f.supported = c.supported) AND (c.largest IS NULL OR f.size_bytes <= c.largest) AND (c.extensions IS NULL OR list_contains(c.extensions, f.extension))")
def f7_optional_filters(spark, d):
    """Files under five sets of conditions, in which those not given don't count."""
    files, out = table(spark, d, "file_inventory"), None
    for no, case in _CASES:
        got = _filtered(files, **case).select(F.lit(no).alias("no"), "id")
        out = got if out is None else out.unionByName(got)
    return out


_PAGES = [(1, 50, 0), (2, 1000, 10), (3, 0, -5), (4, 30, 90)]


@query(" UNION ALL ".join(f"(SELECT {i} AS no, id, file_name FROM file_inventory ORDER BY id LIMIT {max(1, min(n, 200))} OFFSET {max(0, o)})" for i, n, o in _PAGES))
def f12_clamped_page(spark, d):
    """Pages whose limits and offsets are brought into range."""
    out = None
    for no, limit, offset in _PAGES:
        got = store.page_of(table(spark, d, "file_inventory"), [F.col("id")], limit=limit, offset=offset).select(F.lit(no).alias("no"), "id", "file_name")
        out = got if out is None else out.unionByName(got)
    return out


@query("""WITH r AS (SELECT id, CASE WHEN NOT coalesce(supported, false) THEN 'unsupported' WHEN size_bytes IS NULL OR size_bytes = 0 THEN 'missing_file' WHEN size_bytes > 20000000 THEN 'too_large' WHEN status = 'ingested' THEN 'already_ingested' END AS reason FROM file_inventory),
n AS (SELECT id, reason, row_number() OVER (PARTITION BY reason IS NULL ORDER BY id) AS rn FROM r) SELECT id, CASE WHEN reason IS NULL AND rn > 100 THEN 'over_max' ELSE reason END AS reason, reason IS NULL AND rn <= 100 AS selected FROM n""")
def f13_selection_cascade(spark, d):
    return store.select_files(table(spark, d, "file_inventory"), most=100)


@query("SELECT user_id, round(coalesce(avg(value) FILTER (value >= 0), 100.0), 6) AS mean, coalesce(avg(value) FILTER (value >= 0), 100.0) < 60 AS low FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE value END AS value FROM events) x GROUP BY user_id")
def a17_page_confidence(spark, d):
    """Mean confidence of the words of a page; here pages are users and words their events, those of errors unread."""
    words = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")).alias("conf"))
    return trust.page_confidence(words, page=["user_id"], conf="conf").withColumn("mean", F.round("mean", 6))


@query("SELECT relation, id, name FROM (SELECT t.relation, g.id, g.name, row_number() OVER (PARTITION BY t.relation ORDER BY g.id) AS r, t.most FROM graph_nodes g JOIN (VALUES ('part', 20), ('symptom', 10), ('fix', 5)) t(relation, most) ON g.type = t.relation) x WHERE r <= most")
def t8_ordered_limits(spark, d):
    """The first 20 parts, 10 symptoms and 5 fixes, in order of their ids."""
    g, out = table(spark, d, "graph_nodes"), None
    for kind, most in (("part", 20), ("symptom", 10), ("fix", 5)):
        got = g.where(F.col("type") == kind).orderBy("id").limit(most).select(F.lit(kind).alias("relation"), "id", "name")
        out = got if out is None else out.unionByName(got)
    return out


# --- text functions -----------------------------------------------------------------------------------------------

_LEFT = "nullif(trim(regexp_replace(regexp_replace(q, '(?:^|\\b)(?:{w})(?:\\b|$)', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_SYMPTOM_CASES = " ".join("WHEN contains(q, '{}') THEN '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in vocab.SYMPTOM_NAMES.items())


@query("SELECT id, coalesce(CASE " + _SYMPTOM_CASES + " END, " + _LEFT.format(w="|".join(vocab.QUESTION_WORDS)) + ", name) AS symptom FROM (SELECT id, name, lower(name) AS q FROM graph_nodes)")
def n9_symptom(spark, d):
    return table(spark, d, "graph_nodes").select("id", tx.symptom_of(F.col("name")).alias("symptom"))


@query("SELECT doc_id, coalesce(" + _LEFT.format(w="|".join(w.replace("'", "''") for w in vocab.FORMULA_WORDS)) + ", trim(filename)) AS term FROM (SELECT doc_id, filename, replace(lower(coalesce(filename, '')), '?', ' ') AS q FROM (SELECT doc_id, 'What is the formula for ' || filename || '?' AS filename FROM documents))")
def n11_formula_term(spark, d):
    q = F.concat(F.lit("What is the formula for "), "filename", F.lit("?"))
    return table(spark, d, "documents").select("doc_id", tx.formula_term(q).alias("term"))


_PAIRS = [("°C", "°F"), ("°F", "°C"), ("K", "°C"), ("°C", "K"), ("bar", "psi"), ("kg", "s"), ("rpm", "rpm"), ("furlong", "mm")]


@query("SELECT o_orderkey, p.a AS unit_from, p.b AS unit_to, round(CASE WHEN p.no = 1 THEN v * 9 / 5 + 32 WHEN p.no = 2 THEN (v - 32) * 5 / 9 WHEN p.no = 3 THEN v - 273.15 WHEN p.no = 4 THEN v + 273.15 WHEN p.no = 5 THEN v * 14.5038 WHEN p.no = 7 THEN v END, 6) AS converted FROM (SELECT o_orderkey, o_totalprice AS v FROM orders) x CROSS JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS, 1)) + ") p(no, a, b)")
def n13_temperatures(spark, d):
    """Temperatures in other units, and pairs between which there is no conversion."""
    pairs = spark.createDataFrame(_PAIRS, "unit_from string, unit_to string")
    both = table(spark, d, "orders").select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(pairs))  # a fixed list
    return both.select("o_orderkey", "unit_from", "unit_to", tx.convert(F.col("o_totalprice"), F.col("unit_from"), F.col("unit_to")).alias("converted"))


@query(r"SELECT event_id, TRY_CAST(json_extract_string(regexp_extract(regexp_replace('<think>{' || event_type || '</think> Sure: ' || props || ' done', '(?s)<think>.*?</think>', ''), '(?s)\{.*\}'), '$.k') AS INT) AS k FROM events")
def n27_salvaged_json(spark, d):
    """The object within an answer that has other words around it."""
    said = F.concat(F.lit("<think>{"), "event_type", F.lit("</think> Sure: "), "props", F.lit(" done"))
    return table(spark, d, "events").select("event_id", F.get_json_object(tx.salvaged_json(said), "$.k").try_cast("int").alias("k"))


@query(r"SELECT id, regexp_replace(lower(regexp_replace(file_name, '\.[^.]*$', '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}.\-]', '_', 'g') AS stem, regexp_replace(lower(batch_id), '[^a-z0-9_.]', '_', 'g') AS batch FROM file_inventory")
def n4_stem_slug(spark, d):
    return table(spark, d, "file_inventory").select("id", tx.stem_slug(F.col("file_name")).alias("stem"), tx.slug(F.col("batch_id")).alias("batch"))


@query("SELECT reading_id, CASE WHEN lower(trim(u, ' ')) IN ('c', '?c', '°c') THEN '°C' WHEN lower(trim(u, ' ')) IN ('f', '?f', '°f') THEN '°F' ELSE trim(u, ' ') END AS unit FROM (SELECT reading_id, regexp_extract(temperature_deg_c, '[^0-9.,]*$') AS u FROM sheet_readings)")
def n14_unit_name(spark, d):
    return table(spark, d, "sheet_readings").select("reading_id", tx.unit_name(F.regexp_extract("temperature_deg_c", r"[^0-9.,]*$", 0)).alias("unit"))


@query("SELECT id, concat_ws(', ', coalesce(metadata.source_title, doc_id), 'p. ' || CAST(metadata.page AS VARCHAR), 'chunk ' || CAST(id AS VARCHAR)) AS label FROM chunks")
def n28_source_label(spark, d):
    return table(spark, d, "chunks").select("id", tx.source_label(F.col("metadata.source_title"), F.col("doc_id"), F.col("metadata.page"), F.col("id")).alias("label"))


@query("SELECT id, 'job-' || strftime(created_at, '%Y%m%d-%H%M%S') AS job, strftime(modified_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM file_inventory")
def n29_dates(spark, d):
    return table(spark, d, "file_inventory").select("id", tx.job_stamp(F.col("created_at")).alias("job"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(language_profile.sql("documents", "doc_id", "text"))
def s11_language(spark, d):
    """The language of a text by its commonest words."""
    return table(spark, d, "documents").select("doc_id", language_profile.language_of(F.col("text")).alias("lang"))


# --- streams, run as batches --------------------------------------------------------------------------------------

_DELTA = "CASE WHEN event_type = 'error' THEN '<think>' || props WHEN event_type = 'signup' THEN 'so</think>' ELSE event_type || ' ' END"


@query(f"""WITH d AS (SELECT user_id, event_id, string_agg({_DELTA}, '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM events),
v AS (SELECT user_id, event_id, length(p) AS n, regexp_replace(regexp_replace(p, '(?s)<think>.*?(?:</think>|$)', '', 'g'), '<[a-z]{{0,5}}$', '') AS seen FROM d)
SELECT event_id, substring(seen, coalesce(lag(length(seen)) OVER (PARTITION BY user_id ORDER BY n, event_id), 0) + 1) AS shown FROM v""")
def y5_visible_tokens(spark, d):
    """A stream of answer parts without what stands between think marks, which may come in different parts."""
    delta = F.when(F.col("event_type") == "error", F.concat(F.lit("<think>"), "props")).when(F.col("event_type") == "signup", "so</think>").otherwise(F.concat("event_type", F.lit(" ")))
    parts = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", delta.alias("delta"))
    return pipelines.visible_parts(parts, session="user_id", order="at", delta="delta").select("event_id", "shown")


@query("SELECT parsed_id, s.no AS no, s.stage AS stage, s.percent AS percent FROM parsed_docs CROSS JOIN (VALUES " + ", ".join(f"({i}, '{s}', {p})" for i, (s, p) in enumerate(pipelines.STAGES)) + ") s(no, stage, percent)")
def y3_progress(spark, d):
    """The steps that ingesting each document reports."""
    return pipelines.progress(table(spark, d, "parsed_docs").select("parsed_id"), ["parsed_id"])


@query(f"""WITH c AS ({knowledge.SQL['x22_citations']}), h AS (SELECT qid, 0 AS seq, 'thinking' AS event, text AS data FROM {knowledge._ASKED} UNION ALL SELECT qid, no, 'delta', label || ': ' || snippet FROM c UNION ALL SELECT qid, 1000, 'done', CAST(count(*) AS VARCHAR) || ' sources' FROM c GROUP BY qid) SELECT qid, CAST(seq AS INT) AS seq, event, data FROM h""")
def y2_answer_events(spark, d):
    """The events of answering each question, in order."""
    return pipelines.answer_events(knowledge.questions(spark), knowledge.x22_citations(spark, d))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
