"""Changes to stored tables as new tables: batches of passages, images, turns, versions, upserts, votes, suppression, deletion and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers, chunking
from .graph import few


def register_versions(stored: DataFrame, new: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """``new`` with ``version``: one more than the key's greatest in ``stored``, counted up in order."""
    last = stored.groupBy(key).agg(F.max("version").alias("_last"))
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.drop("version").join(last, key, "left").withColumn("version", F.coalesce("_last", F.lit(0)) + row).drop("_last")


def upsert(stored: DataFrame, new: DataFrame, *, keys: list[str], order: Column) -> DataFrame:
    """``stored`` and ``new`` with the last row by ``order`` for each key; of equal ones those of ``new`` win."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc_nulls_last(), F.desc("_new")))).where("_r = 1").drop("_r", "_new")


def delete_documents(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the doomed documents, rows deleted by table). Graph nodes are for the caller to keep."""
    left = {n: t.join(doomed.select(key).distinct(), key, "left_anti") for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.join(doomed.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(n).alias("table_name"), "n_deleted")
        counts = c if counts is None else counts.unionByName(c)
    return left, counts


def votes_per_chunk(feedback: DataFrame) -> DataFrame:
    """``chunk_id``, ``n_votes``, ``total``, ``downvotes`` from feedback rows (vote, chunk_ids): votes other than 1 and -1 don't count."""
    return feedback.where("vote IN (1, -1)").select("vote", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n_votes"), F.sum("vote").alias("total"), F.count_if(F.col("vote") == -1).alias("downvotes"))


def quality_after_votes(chunks: DataFrame, votes: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Chunks with the mean of their former quality and the new votes; a suppressed chunk stays at -999."""
    n, q = F.coalesce("vote_count", F.lit(0)), F.coalesce("quality_score", F.lit(0.0))
    got = chunks.join(votes, chunks["id"] == votes["chunk_id"], "left").join(suppressed.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left")
    total, more = F.coalesce("total", F.lit(0)), F.coalesce("n_votes", F.lit(0))
    mean = F.when(n + more > 0, (q * n + total) / (n + more)).otherwise(q)
    return got.select("id", F.when(F.col("_s"), F.lit(-999.0)).otherwise(mean).alias("quality_score"), (n + more).alias("vote_count"), (F.coalesce("downvote_count", F.lit(0)) + F.coalesce("downvotes", F.lit(0))).alias("downvote_count"))


def corrections_as_chunks(feedback: DataFrame, *, least: int = 20) -> DataFrame:
    """Corrections of more than ``least`` characters as chunks of full quality: content, quality_score, vote_count, source_type,
    original_question."""
    text = F.trim("correction")
    return feedback.where(F.length(text) > least).select(text.alias("content"), F.lit(1.0).alias("quality_score"), F.lit(1).alias("vote_count"), F.lit("expert_correction").alias("source_type"), F.col("question").alias("original_question"))


def open_gaps(log: DataFrame) -> DataFrame:
    """Questions whose last entry in the log (question, reason, resolved, seq) isn't resolved."""
    last = log.groupBy("question").agg(F.max_by(F.struct("reason", "resolved"), "seq").alias("l"))
    return last.where("NOT l.resolved").select("question", F.col("l.reason").alias("reason"))


def answer_report(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """``qid``, ``report``: question, answer and numbered sources as text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "label"))), lambda c: F.concat(F.lit("["), c["no"].cast("string"), F.lit("] "), c["label"])), "\n")
    listed = citations.groupBy("qid").agg(lines.alias("sources"))
    return answers.join(listed, "qid", "left").select("qid", F.concat(F.lit("Question: "), "question", F.lit("\n\n"), "answer", F.lit("\n\nSources:\n"), F.coalesce("sources", F.lit("none"))).alias("report"))


def store_batch(docs: DataFrame, key_cols: list[str], text_col: str) -> dict[str, DataFrame]:
    """What a batch of parsed documents adds to the store: ``chunks`` (passages, and tables as one passage each), ``formulas`` of the passages
    and ``facts`` of the tables. All from one lineage, so that they are of one batch."""
    prose = chunking.chunk_documents(docs, key_cols, text_col).select(*key_cols, "chunk_index", "page", F.lit("prose").alias("chunk_type"), F.lit(None).cast("string").alias("table_name"), "content")
    tabs = chunking.chunk_tables(docs, key_cols).select(*key_cols, F.col("table_no").alias("chunk_index"), F.lit(None).cast("int").alias("page"), F.lit("table").alias("chunk_type"), "table_name", "content")
    return {"chunks": prose.unionByName(tabs), "formulas": answers.formulas(prose, [*key_cols, "chunk_index"], "content"), "facts": chunking.table_facts(docs, key_cols)}


def nearest_chunk(places: DataFrame, chunks: DataFrame, *, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """``places`` with ``chunk_id``: the first chunk (id, ``doc``, ``page``, chunk_index) of the same page, else the document's first; null for a place
    without a page. Each document's chunks are reduced to one a page before the join."""
    first_of_page = chunks.where(F.col(page).isNotNull()).groupBy(doc, page).agg(F.min_by("id", F.struct(F.coalesce("chunk_index", F.lit(0)), "id")).alias("_p"))
    first_of_doc = chunks.groupBy(doc).agg(F.min("id").alias("_d"))
    got = places.join(first_of_page, [doc, page], "left").join(first_of_doc, doc, "left")
    return got.withColumn("chunk_id", F.when(F.col(page).isNotNull(), F.coalesce("_p", "_d"))).drop("_p", "_d")


def add_images(stored: DataFrame, docs: DataFrame, chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """New image rows (``doc``, ``page``, ``image_index``, ``caption``, ``chunk_id``) of documents that have none stored yet."""
    fresh = docs.join(stored.select(doc).distinct(), doc, "left_anti").select(doc, F.inline("images")).distinct()
    return nearest_chunk(fresh, chunks, doc=doc)


def figures_for(hits: DataFrame, images: DataFrame, *, most: int = 3) -> DataFrame:
    """For each hit (id, doc_id, page) up to ``most`` images (doc_id, page, image_index, caption) of its page, or of its document if its page has
    none: ``id``, ``no``, ``page``, ``image_index``, ``caption``."""
    w = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("page", "image_index"))
    by_page = images.withColumn("no", w("doc_id", "page")).where(F.col("no") <= most)
    by_doc = images.withColumn("no", w("doc_id")).where(F.col("no") <= most).withColumnRenamed("page", "image_page")
    own = hits.select("id", "doc_id", "page").join(by_page, ["doc_id", "page"]).select("id", "no", "page", "image_index", "caption")
    rest = hits.select("id", "doc_id").join(own.select("id").distinct(), "id", "left_anti")
    return own.unionByName(rest.join(by_doc, "doc_id").select("id", "no", F.col("image_page").alias("page"), "image_index", "caption"))


def append_turns(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations (session_id, turn, role, content) with new turns (session_id, at, role, content) after those that are there, in order of ``at``."""
    last = stored.groupBy("session_id").agg(F.max("turn").alias("_last"))
    no = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "role", "content"))
    added = new.join(last, "session_id", "left").withColumn("turn", F.coalesce(F.col("_last") + 1, F.lit(0)) + no - 1)
    return stored.select("session_id", "turn", "role", "content").unionByName(added.select("session_id", "turn", "role", "content"))


def last_turns(turns: DataFrame, *, most: int = 4) -> DataFrame:
    """The ``most`` last turns of each conversation."""
    return turns.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where(F.col("_r") <= most).drop("_r")


def add_corrections(chunks: DataFrame, feedback: DataFrame, *, least: int = 20) -> DataFrame:
    """Chunks (content, quality_score, vote_count, source_type) and the corrections among ``feedback`` that are long enough, as chunks."""
    new = corrections_as_chunks(feedback, least=least)
    return chunks.unionByName(new.select("content", "quality_score", "vote_count", "source_type"))


def missing_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns that older ones lack, and their nulls filled by ``defaults``."""
    return rows.withColumns({c: (F.coalesce(c, v) if c in rows.columns else v) for c, v in defaults.items()})


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet all conditions that are given; None stands for one that isn't."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def page_of(df: DataFrame, order: list, *, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in ``order``: ``limit`` from 1 to ``most``, ``offset`` from 0."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def select_files(files: DataFrame, *, most: int = 500, largest: int = 20_000_000) -> DataFrame:
    """``id``, ``reason``, ``selected``: the first reason against ingesting a file, and the first ``most`` by id of those without. The last id selected comes from
    a top-k over all tasks; nothing is put in one order."""
    why = (
        F.when(~F.coalesce("supported", F.lit(False)), "unsupported")
        .when(F.col("size_bytes").isNull() | (F.col("size_bytes") == 0), "missing_file")
        .when(F.col("size_bytes") > largest, "too_large")
        .when(F.col("status") == "ingested", "already_ingested")
    )
    judged = files.select("id", why.alias("reason"))
    last = judged.where("reason IS NULL").orderBy("id").limit(most).agg(F.max("id").alias("_last"))
    got = judged.crossJoin(F.broadcast(last))  # one row
    late = F.col("reason").isNull() & (F.col("id") > F.col("_last"))
    return got.select("id", F.when(late, "over_max").otherwise(F.col("reason")).alias("reason"), (F.col("reason").isNull() & ~late).alias("selected"))


def latest_job(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_id``, ``filename``, ``status``, ``error``: of each document (doc_id, filename) the latest file whose name is its own, regardless of case, or its id. The
    either-or is two keys of an equi join."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    d = docs.select("doc_id", "filename").distinct().select("*", F.explode(F.array(key("any case", F.lower("filename")), key("exact", F.col("doc_id")))).alias("k"))
    f = files.select("id", "status", "error", "created_at", F.explode(F.array(key("any case", F.lower("file_name")), key("exact", F.col("file_name")))).alias("k")).where("k.name IS NOT NULL")
    hit = d.join(f, "k").groupBy("doc_id", "filename").agg(F.max_by(F.struct("status", "error"), F.struct("created_at", "id")).alias("j"))
    return docs.select("doc_id", "filename").distinct().join(hit, ["doc_id", "filename"], "left").select("doc_id", "filename", "j.status", "j.error")


def spec_lookup(facts: DataFrame, asked: DataFrame, *, most: int = 20) -> DataFrame:
    """``qid``, ``no`` and the columns of ``facts`` (doc_id, row_label, key ...): for each look-up (qid, key, engine or null) up to ``most`` facts whose key has
    ``key`` and whose row or document has ``engine``, regardless of case, by key, document and value. Look-ups go to every task; there may be 10,000."""
    has = lambda c, x: F.contains(F.lower(c), F.lower(x))
    q = few(asked, 10_000).select("qid", F.col("key").alias("_key"), F.col("engine").alias("_engine"))
    hit = facts.join(F.broadcast(q), has(F.col("key"), F.col("_key")) & (F.col("_engine").isNull() | has(F.concat_ws("\n", "row_label", "doc_id"), F.col("_engine"))))
    w = Window.partitionBy("qid").orderBy("key", "doc_id", "value", "sheet")
    return hit.withColumn("no", F.row_number().over(w)).where(F.col("no") <= most).select("qid", "no", *facts.columns)
