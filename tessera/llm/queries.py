"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, entities, knn, language, mixing, packing, scan_noise, splitting, subjects, tokens
from .common import sample_rows


def _texts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("parsed_docs", table(spark, d, "parsed_docs"), "parsed_id", "text"), ("chunks", table(spark, d, "chunks"), "id", "content")]


# --- 1 ---


def p1_pieces(spark: SparkSession, d: str, limit: int = 850, overlap: int = 100) -> DataFrame:
    """All pieces of parsed_docs and chunks; tables stay whole."""
    out = None
    for name, df, key, text in _texts(spark, d):
        whole = None
        if name == "chunks":
            df = df.select(F.col(key), F.col(text), (F.coalesce(F.col("metadata.chunk_type"), F.lit("")) == "table").alias("is_table"))
            whole = F.col("is_table")
        got = splitting.split_items(df, [key], text, limit=limit, overlap=overlap, whole_when=whole)
        got = got.select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), "piece_no", "n_pieces", "start", "repeated", "piece")
        out = got if out is None else out.unionByName(got)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0 AND n_pieces > 1").select("source_table", "row_id")


P1_FOUND_SQL = r"""
SELECT 'parsed_docs' AS source_table, parsed_id AS row_id FROM parsed_docs
WHERE length(regexp_replace(text, '\[PAGE_BREAK:\d+\]', '', 'g')) > 850
UNION ALL
SELECT 'chunks', id FROM chunks
WHERE metadata.chunk_type = 'prose' AND length(regexp_replace(content, '\[PAGE_BREAK:\d+\]', '', 'g')) > 850
"""

# step by step: of each window the last boundary of the strongest kind
P1_PIECES_SQL = r"""
WITH RECURSIVE b AS (
    SELECT source_table, row_id, t, length(t) AS n, length(t) <= 850 OR is_table AS whole FROM (
        SELECT 'parsed_docs' AS source_table, parsed_id AS row_id, regexp_replace(text, '\[PAGE_BREAK:\d+\]', '', 'g') AS t, false AS is_table FROM parsed_docs
        UNION ALL SELECT 'chunks', id, regexp_replace(content, '\[PAGE_BREAK:\d+\]', '', 'g'), coalesce(metadata.chunk_type, '') = 'table' FROM chunks) x
    WHERE length(t) > 0),
p AS (
    SELECT source_table, row_id, 0 AS piece_no, 0 AS pos, CASE WHEN whole THEN n ELSE coalesce(
        nullif(length(regexp_extract(left(t, 850), '(?s)^.{0,841}\S[ \t\r]?\n[ \t\r]{0,5}\n')), 0),
        nullif(length(regexp_extract(left(t, 850), '(?s)^.*[.!?…][)\]»”“"'']{0,3}\s')), 0),
        nullif(length(regexp_extract(left(t, 850), '(?s)^.*\S\s')), 0), 850) END AS len FROM b
    UNION ALL
    SELECT source_table, row_id, piece_no + 1, pos + len, CASE WHEN n - pos - len <= 750 THEN n - pos - len ELSE coalesce(
        nullif(length(regexp_extract(w, '(?s)^.{0,741}\S[ \t\r]?\n[ \t\r]{0,5}\n')), 0),
        nullif(length(regexp_extract(w, '(?s)^.*[.!?…][)\]»”“"'']{0,3}\s')), 0),
        nullif(length(regexp_extract(w, '(?s)^.*\S\s')), 0), 750) END
    FROM (SELECT p.*, b.n, substring(b.t, pos + len + 1, 750) AS w FROM p JOIN b USING (source_table, row_id) WHERE pos + len < b.n) q),
c AS (SELECT source_table, row_id, piece_no, pos, substring(t, pos + 1, len) AS own, count(*) OVER (PARTITION BY source_table, row_id) AS n_pieces,
             coalesce(lag(substring(t, pos + 1, len)) OVER (PARTITION BY source_table, row_id ORDER BY piece_no), '') AS before FROM p JOIN b USING (source_table, row_id)),
r AS (SELECT *, CASE WHEN length(before) <= 100 THEN before WHEN length(regexp_replace(right(before, 100), '(?s)^\S*\s+(\S)', '\1')) >= 50 THEN regexp_replace(right(before, 100), '(?s)^\S*\s+(\S)', '\1') ELSE right(before, 100) END AS again FROM c)
SELECT source_table, row_id, CAST(piece_no AS INT) AS piece_no, CAST(n_pieces AS INT) AS n_pieces, CAST(pos - length(again) AS INT) AS start, CAST(length(again) AS INT) AS repeated, again || own AS piece FROM r
"""

# --- 2 ---


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected fields of chunks and file_inventory with the restored text."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("source_table"), F.col("id").alias("row_id"), "content", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("relative_path"))
    files = table(spark, d, "file_inventory").select(F.lit("file_inventory").alias("source_table"), F.col("id").alias("row_id"), F.lit(None).cast("string").alias("content"), "file_name", "relative_path")
    return encoding.find_garbled(chunks.unionByName(files), ["source_table", "row_id"], ["content", "file_name", "relative_path"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("source_table", "row_id", "field_name")


# --- 3 ---


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Running text of the rows of parsed_docs and chunks (without tables) that show scan noise."""
    docs = table(spark, d, "parsed_docs").select(F.lit("parsed_docs").alias("source_table"), F.col("parsed_id").alias("row_id"), "text")
    chunks = table(spark, d, "chunks").where("coalesce(metadata.chunk_type, '') <> 'table'").select(F.lit("chunks").alias("source_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    return scan_noise.repair_scans(docs.unionByName(chunks), ["source_table", "row_id"], "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_repaired(spark, d).select("source_table", "row_id")


# --- 4 ---


def p4_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The meant entry (0: none) of every name and type of graph_nodes."""
    return entities.map_nodes(table(spark, d, "graph_nodes"), table(spark, d, "canonical_entities"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_mapped(spark, d).where("NOT literal").select("node_id", "field_name", "ref_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that the list has no entry for, with the number of their rows."""
    return p4_mapped(spark, d).where("ref_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))


# --- 6 ---

LANGUAGE_SAMPLE = 1500  # labelled rows of each table to fit the classifiers on


def _labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_id"), "text", "lang")
    chunks = table(spark, d, "chunks").where("metadata.chunk_type = 'prose'").select(F.lit("chunks").alias("source_table"), F.col("id").alias("row_id"), F.col("content").alias("text"), "lang")
    return docs.unionByName(chunks).withColumn("label", language.normal_label(F.col("lang")))


def language_model(spark: SparkSession, d: str) -> language.CodeModel:
    rows = _labelled_texts(spark, d).where(F.col("label").isin(*language.LABELS) & F.col("text").isNotNull())
    parts = [sample_rows(rows.where(F.col("source_table") == t).select("row_id", "text", F.col("label").alias("lang")), F.col("row_id"), LANGUAGE_SAMPLE) for t in ("documents", "chunks")]
    return language.fit_languages(pd.concat(parts, ignore_index=True))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one language of all documents and prose chunks."""
    return language.label_languages(_labelled_texts(spark, d), ["source_table", "row_id", "label"], "text", language_model(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the rows whose label is missing or wrong, and of those in several languages."""
    by_row = p6_segments(spark, d).where("counts").groupBy("source_table", "row_id", "label").agg(F.array_sort(F.collect_set("segment_lang")).alias("langs"))
    odd = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return by_row.where(odd).select("source_table", "row_id", F.explode("langs").alias("lang"))


# --- 7 ---


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other chunks of every chunk with a usable vector."""
    near = knn.neighbours(table(spark, d, "chunks"), "id", "embedding")
    return near.select("id", F.posexplode("near").alias("p", "z")).select("id", (F.col("p") + 1).alias("rank"), F.col("z.id").alias("neighbour_id"), F.col("z.cosine").alias("cosine"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.neighbours(table(spark, d, "chunks"), "id", "embedding", least_cosine=0.9 - 1e-6)  # lists are cut after the search, before they are shuffled
    pairs = near.select("id", F.explode(F.filter("near", lambda z: z["cosine"] >= 0.9)).alias("z"))
    return pairs.select(F.least("id", "z.id").alias("id_a"), F.greatest("id", "z.id").alias("id_b")).distinct()


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall against the exact answer for the rows whose id is divisible by 100: the part of each one's found
    neighbours that are at least as similar as the exact tenth."""
    chunks = table(spark, d, "chunks")
    exact = knn.exact_tenth(chunks, "id", "embedding", F.col("id") % 100 == 0)
    near = knn.neighbours(chunks, "id", "embedding").where("id % 100 = 0")
    got = near.join(exact, "id").select(F.size(F.filter("near", lambda z: z["cosine"] >= F.col("tenth") - 2e-6)).alias("hits"), "n_exact")
    return got.agg(F.count("*").alias("n_queries"), F.round(F.sum("hits") / F.sum("n_exact"), 4).alias("recall"))


# --- 8 ---


def p8_pack(spark: SparkSession, d: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    sizes = tokens.count_tokens(table(spark, d, "documents"), ["doc_id"], "text", vocabulary=vocabulary)
    return packing.pack_items(sizes, "doc_id", "n_tokens").withColumnsRenamed({"first": "first_token", "size": "n_tokens"})


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least number possible by size alone, and the unused room."""
    per = p8_pack(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("n_containers"), F.ceil(F.sum("used") / 2048).alias("least_possible"), F.round(1 - F.sum("used") / (F.count("*") * 2048), 6).alias("unused_share"))


# --- 9 ---


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text")
    return mixing.mix(sizes, table(spark, d, "mix_targets"), key_col="doc_id", source_col="source", size_col="n_tokens")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, by output shard and position."""
    return _mixed(spark, d)[0].withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares by source."""
    return _mixed(spark, d)[1]


# --- 10 ---

SUBJECT_SAMPLE = 6000  # passages with weak labels to fit on
KNOWN_SAMPLE = 3000  # documents with known subjects to calibrate on


def subject_model(spark: SparkSession, d: str) -> subjects.SubjectModel:
    names = [r.subject for r in table(spark, d, "subject_areas").select("subject").where("subject IS NOT NULL").distinct().collect()]  # a fixed list of ten
    topic, address = F.lower(F.trim(F.col("metadata.topic"))), F.lower(F.col("metadata.filename"))
    chunks = table(spark, d, "chunks").where("metadata.chunk_type = 'prose' AND content IS NOT NULL").where(topic.isin(*names)).select(F.col("id"), F.col("content").alias("text"), topic.alias("topic"), F.lit(None).cast("string").alias("address"))
    docs = table(spark, d, "parsed_docs").where("text IS NOT NULL").where(topic.isin(*names) | F.col("metadata.topic").isNull()).select(F.col("parsed_id").alias("id"), "text", topic.alias("topic"), address.alias("address"))
    weak = pd.concat([sample_rows(chunks, F.col("id"), SUBJECT_SAMPLE * 3 // 4), sample_rows(docs, F.col("id"), SUBJECT_SAMPLE // 4)], ignore_index=True)
    weak["subject"] = [subjects.weak_label(t, a, names) for t, a in zip(weak["topic"], weak["address"])]
    labels = table(spark, d, "subject_labels").where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    picked = labels.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(KNOWN_SAMPLE)
    known = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(picked), "doc_id").toPandas()  # at most KNOWN_SAMPLE rows
    return subjects.fit_subjects(weak[weak["subject"].notna()], known, names)


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of all documents with their shares."""
    return subjects.label_subjects(table(spark, d, "documents"), ["doc_id"], "text", subject_model(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "subject_labels").select("doc_id").where("doc_id IS NOT NULL").distinct()
    return p10_subjects(spark, d).join(labelled, "doc_id", "left_anti").select("doc_id", "subject")


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and share of the corpus by subject; texts on none count as '(none)'."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    got = docs.join(p10_subjects(spark, d), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject"))
    return got.agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_characters"), F.round(F.avg("share"), 6).alias("avg_share"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_found": p2_found,
        "p2_restored": p2_restored,
        "p3_found": p3_found,
        "p3_repaired": p3_repaired,
        "p4_found": p4_found,
        "p4_mapped": p4_mapped,
        "p4_unmatched": p4_unmatched,
        "p6_found": p6_found,
        "p6_segments": p6_segments,
        "p7_found": p7_found,
        "p7_neighbours": p7_neighbours,
        "p7_recall": p7_recall,
        "p8_pack": p8_pack,
        "p8_fill": p8_fill,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_subjects": p10_subjects,
        "p10_makeup": p10_makeup,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_pieces": P1_PIECES_SQL}
