"""Queries whose SQL both engines run as it stands: catalogue, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from ..functions import vocab
from ..operators.graph import seed_values_sql


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CATEGORY = "CASE " + " ".join(f"WHEN ext IN ({_in(v)}) THEN '{k}'" for k, v in vocab.CATEGORIES.items()) + " ELSE 'unknown' END"
_SEED = f"(VALUES {seed_values_sql()}) AS s(src_type, src, relation, dst_type, dst)"
_TRIGGERS = " ".join(f"WHEN contains(q, '{t}') THEN '{v}'" for t, v in vocab.TOPIC_TRIGGERS)
_HITS = {name: " + ".join("CASE WHEN contains(q, '" + w.replace("'", "''") + "') THEN 1 ELSE 0 END" for w in words) for name, words in vocab.INTENT_TRIGGERS}
_FOLDERS = "(VALUES " + ", ".join(f"('{t}')" for t in vocab.TOPIC_FOLDERS) + ") AS p(preset)"

QUERIES: dict[str, str] = {
    # --- filters ---
    "f1_ilike_substring": "SELECT id, name, type FROM graph_nodes WHERE name ILIKE '%jet%'",
    "f2_ilike_any": "SELECT id, name FROM graph_nodes WHERE name ILIKE '%pump%' OR name ILIKE '%valve%' OR name ILIKE '%seal%'",
    "f3_or_matrix": "SELECT id, name, props.doc_id AS doc_id FROM graph_nodes WHERE contains(lower(concat_ws(' ', name, type, props.doc_id, props.extraction_method)), 'rule') OR contains(lower(concat_ws(' ', name, type, props.doc_id, props.extraction_method)), 'ignition')",
    "f4_or_columns": "SELECT reading_id, doc_id, sheet, parameter FROM sheet_readings WHERE contains(lower(coalesce(parameter, '')), 'load') OR contains(lower(coalesce(sheet, '')), 'torque') OR contains(lower(coalesce(doc_id, '')), 'fuel')",
    "f5_in_list": "SELECT id, file_name, status FROM file_inventory WHERE extension IN ('.pdf', '.docx', '.PDF', 'pdf', 'docx') AND status IS NOT NULL",
    "f6_struct_path": "SELECT id, doc_id, metadata.page AS page FROM chunks WHERE metadata.topic = 'fuel' AND metadata.source_title IS NOT NULL",
    "f8_quality_gate": "SELECT id, quality_score, downvote_count FROM chunks WHERE NOT (coalesce(quality_score, 0) <= -999 OR (coalesce(quality_score, 0) < -0.5 AND coalesce(downvote_count, 0) >= 3))",
    "f9_low_quality": "SELECT id, round(quality_score, 6) AS quality_score, downvote_count FROM chunks WHERE quality_score < -0.2 OR downvote_count >= 2",
    "f10_graph_filters": "SELECT id, type, name FROM graph_nodes WHERE (props.confidence >= 0.6 OR props.confidence IS NULL OR props.extraction_method = 'manual_seed') AND props.extraction_method IS NOT NULL AND type = 'part'",
    "f14_ext_class": f"""
        WITH e AS (SELECT id, replace(lower(coalesce(extension, '')), '.', '') AS ext FROM file_inventory)
        SELECT id, ext, {_CATEGORY} AS category, ext IN ({_in(vocab.PARSED)}) AS supported, ext IN ({_in(vocab.CONVERTED)}) AS needs_converter,
               CASE WHEN ext IN ({_in(vocab.PARSED)}) THEN NULL WHEN {_CATEGORY} = 'cad_engineering' THEN 'metadata_only_cad' WHEN {_CATEGORY} = 'archives' THEN 'metadata_only_archive' ELSE 'unsupported_extension' END AS skipped_reason FROM e""",
    # --- joins ---
    "j5_nearest_fallback": """
        WITH i AS (SELECT p.parsed_id, p.doc_id, p.version FROM parsed_docs p),
        m AS (SELECT doc_id, metadata.page AS page, min(id) AS id FROM chunks GROUP BY doc_id, metadata.page),
        f AS (SELECT doc_id, min(id) AS id FROM chunks GROUP BY doc_id)
        SELECT i.parsed_id, coalesce(m.id, f.id) AS chunk_id FROM i LEFT JOIN m ON m.doc_id = i.doc_id AND m.page = 1 LEFT JOIN f ON f.doc_id = i.doc_id""",
    "j9_semi": "SELECT id, name FROM graph_nodes g WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.id = g.props.source_chunk_id AND c.quality_score > 0)",
    "j10_anti": "SELECT f.id, f.file_name FROM file_inventory f WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.metadata.filename = f.file_name)",
    "j15_job_items": "SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "j_full_outer": """
        WITH a AS (SELECT metadata.topic AS topic, count(*) AS n FROM chunks GROUP BY metadata.topic), b AS (SELECT metadata.topic AS topic, count(*) AS n FROM parsed_docs GROUP BY metadata.topic)
        SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.n, 0) AS n_chunks, coalesce(b.n, 0) AS n_docs FROM a FULL JOIN b ON a.topic = b.topic""",
    "j_star": """
        SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""",
    # --- aggregates ---
    "a1_scalar": "SELECT count(*) AS n, coalesce(CAST(sum(size_bytes) AS BIGINT), 0) AS bytes FROM file_inventory",
    "a2_conditional": "SELECT category, count(*) AS n, CAST(sum(CASE WHEN supported THEN 1 ELSE 0 END) AS BIGINT) AS supported, CAST(sum(CASE WHEN needs_converter THEN 1 ELSE 0 END) AS BIGINT) AS converter, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS bytes FROM file_inventory GROUP BY category",
    "a3_grouping_sets": """
        SELECT topic, category, extension, status, CAST(grouping(topic) * 8 + grouping(category) * 4 + grouping(extension) * 2 + grouping(status) AS INT) AS level, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes
        FROM file_inventory GROUP BY GROUPING SETS ((topic), (category), (extension), (status), ())""",
    "a_cube": "SELECT category, status, count(*) AS n, CAST(grouping(category) + 2 * grouping(status) AS INT) AS level FROM file_inventory GROUP BY CUBE (category, status)",
    "a_rollup": "SELECT topic, extension, count(*) AS n, CAST(grouping(topic) + 2 * grouping(extension) AS INT) AS level FROM file_inventory GROUP BY ROLLUP (topic, extension)",
    "a_having": "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10",
    "a4_distinct": "SELECT count(DISTINCT topic) AS topics, count(DISTINCT extension) AS extensions, count(DISTINCT batch_id) AS batches, count(DISTINCT relative_path) AS paths FROM file_inventory",
    "a5_min_max_struct": "SELECT doc_id, max(metadata.page) AS last_page, min(metadata.filename) AS filename, max(metadata.topic) AS topic FROM chunks GROUP BY doc_id",
    "a6_dashboard": """
        SELECT c.n AS chunks, c.tables AS table_chunks, c.low AS low_quality, c.votes AS votes, d.n AS documents, p.n AS parsed, f.n AS files, f.supported AS supported_files, g.n AS nodes, s.n AS readings
        FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN metadata.chunk_type = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum(CASE WHEN quality_score < -0.2 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(vote_count) AS BIGINT) AS votes FROM chunks) c
        CROSS JOIN (SELECT count(*) AS n FROM documents) d CROSS JOIN (SELECT count(DISTINCT doc_id) AS n FROM parsed_docs) p
        CROSS JOIN (SELECT count(*) AS n, CAST(sum(CASE WHEN supported THEN 1 ELSE 0 END) AS BIGINT) AS supported FROM file_inventory) f
        CROSS JOIN (SELECT count(*) AS n FROM graph_nodes) g CROSS JOIN (SELECT count(*) AS n FROM sheet_readings) s""",
    "a8_coverage": "SELECT type, props.extraction_method AS method, count(*) AS n, round(avg(props.confidence), 3) AS avg_confidence, round(100.0 * count(props.page) / count(*), 1) AS page_coverage FROM graph_nodes GROUP BY type, props.extraction_method",
    "a9_topic_catalog": f"""
        WITH u AS (SELECT preset AS topic, 0 AS chunks, 0 AS files, 0 AS bytes FROM {_FOLDERS}
                   UNION ALL SELECT coalesce(metadata.topic, 'Unsorted'), 1, 0, 0 FROM chunks
                   UNION ALL SELECT coalesce(topic, 'Unsorted'), 0, 1, coalesce(size_bytes, 0) FROM file_inventory)
        SELECT topic, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM u GROUP BY topic""",
    "a12_vote_mean": """
        WITH v AS (SELECT user_id AS chunk_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 END AS vote FROM events)
        SELECT chunk_id, count(vote) AS n_votes, round(coalesce(avg(CAST(vote AS DOUBLE)), 0), 6) AS quality, CAST(sum(CASE WHEN vote = -1 THEN 1 ELSE 0 END) AS BIGINT) AS downvotes FROM v GROUP BY chunk_id""",
    "a13_key_conflict": """
        WITH k AS (SELECT doc_id, sheet, parameter FROM sheet_readings WHERE value_rpm IS NOT NULL GROUP BY doc_id, sheet, parameter HAVING min(value_rpm) <> max(value_rpm))
        SELECT r.reading_id, r.doc_id, r.sheet, r.parameter, r.value_rpm FROM sheet_readings r JOIN k ON k.doc_id = r.doc_id AND k.sheet = r.sheet AND k.parameter = r.parameter WHERE r.value_rpm IS NOT NULL""",
    "a15_specs_summary": "SELECT doc_id, count(*) AS n_readings, count(DISTINCT sheet) AS sheets, count(DISTINCT parameter) AS parameters, count(value_rpm) AS speeds, count(torque_nm) AS torques FROM sheet_readings GROUP BY doc_id",
    "a16_reason_hist": "SELECT coalesce(skipped_reason, '(selected)') AS reason, count(*) AS n, CAST(sum(CASE WHEN skipped_reason IS NULL THEN coalesce(size_bytes, 0) ELSE 0 END) AS BIGINT) AS selected_bytes FROM file_inventory GROUP BY coalesce(skipped_reason, '(selected)')",
    # --- windows ---
    "w1_rank": "SELECT id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY quality_score DESC NULLS LAST, id) AS rank, round(1.0 / (60 + row_number() OVER (PARTITION BY doc_id ORDER BY quality_score DESC NULLS LAST, id)), 9) AS score FROM chunks",
    "w2_latest_version": "SELECT parsed_id, doc_id, version FROM (SELECT parsed_id, doc_id, version, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, parsed_id DESC) AS rn FROM parsed_docs) x WHERE rn = 1",
    "w3_first2": "SELECT reading_id, doc_id, sheet, value_rpm FROM (SELECT reading_id, doc_id, sheet, value_rpm, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY recorded_at, reading_id) AS rn FROM sheet_readings) x WHERE rn <= 2",
    "w9_topk_per_group": "SELECT id, doc_id, page FROM (SELECT id, doc_id, metadata.page AS page, row_number() OVER (PARTITION BY doc_id, metadata.page ORDER BY id) AS rn FROM chunks WHERE metadata.page IS NOT NULL) x WHERE rn <= 3",
    "w10_versions": "SELECT doc_id AS document_id, filename, row_number() OVER (PARTITION BY filename ORDER BY uploaded_at, doc_id) AS version_no FROM documents",
    "w_lag_lead": "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events",
    "w_running": "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM orders",
    # --- sorts and limits ---
    "t5_nulls_paging": "SELECT doc_id, n FROM (SELECT doc_id, count(*) AS n FROM sheet_readings GROUP BY doc_id) x ORDER BY n DESC NULLS LAST, doc_id NULLS LAST LIMIT 50 OFFSET 10",
    "t9_offset_paging": "SELECT id, name, type FROM graph_nodes ORDER BY id LIMIT 100 OFFSET 100",
    # --- set operations ---
    "u1_union_dedupe": "SELECT name FROM graph_nodes WHERE type = 'part' UNION SELECT canonical_name FROM canonical_entities WHERE type = 'part'",
    "u2_bag_union": "SELECT doc_id FROM chunks UNION ALL SELECT doc_id FROM parsed_docs",
    "u4_intersect": "SELECT name FROM graph_nodes INTERSECT SELECT canonical_name FROM canonical_entities",
    "u5_except": "SELECT canonical_name FROM canonical_entities EXCEPT SELECT name FROM graph_nodes",
    # --- scalar functions ---
    "n6_topic": f"WITH d AS (SELECT doc_id, lower(text) AS q FROM documents) SELECT doc_id, CASE {_TRIGGERS} END AS topic FROM d",
    "n15_confidence": "SELECT id, round(greatest(0.0, least(1.0, props.confidence)), 6) AS confidence FROM graph_nodes WHERE props.confidence IS NOT NULL",
    "n17_left_coalesce": "SELECT id, left(coalesce(content, ''), 120) AS head, lower(coalesce(lang, 'unknown')) AS lang FROM chunks",
    # --- windows of time, as batches ---
    "s_session": """
        WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM g)
        SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events FROM s GROUP BY user_id, session_no""",
}
INTENT_HITS = _HITS
