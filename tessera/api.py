"""One function for each query route: DataFrames in, DataFrames out. A store is a folder of tables as the queries' folders are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import topic_of
from .operators import answers, graph, retrieval, rules, store
from .plans import knowledge, relations
from .session import table
from .sources import files


class Store:
    """The tables of a store, and what can be asked of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _asked(self, questions: list[str], topic: str | None = None) -> DataFrame:
        rows = [(i, q, topic) for i, q in enumerate(questions, 1)]
        return self.spark.createDataFrame(rows, "qid int, text string, wanted_topic string")

    # --- inventory ---

    def scan(self, root: str, most: int = 50_000) -> DataFrame:
        """POST /inventory/scan"""
        return files.scan_files(self.spark, root, most=most)

    def inventory(self, *, batch_id: str | None = None, topic: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """GET /inventory"""
        given = lambda v, c: None if v is None else F.col(c) == v
        found = store.optional(self.table("file_inventory"), given(batch_id, "batch_id"), given(topic, "topic"), given(status, "status"))
        return store.page_of(found, [F.col("id")], limit=limit, offset=offset)

    def inventory_summary(self, by: str, most: int = 40) -> DataFrame:
        """GET /inventory/summary: files and bytes by topic, category, extension or status."""
        return self.table("file_inventory").groupBy(by).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("n"), by).limit(most)

    def select_for_ingest(self, most: int = 500) -> DataFrame:
        """POST /inventory/ingest-selected: which files, and why not the others."""
        return store.select_files(self.table("file_inventory"), most=most)

    # --- questions ---

    def search(self, questions: list[str], *, topic: str | None = None, k: int = 20) -> DataFrame:
        """GET /search: passages by their words and, where the questions have vectors, by these."""
        chunks, _ = knowledge._ask_chunks(self.spark, self.folder)
        asked = self._asked(questions, topic).withColumn("qvec", F.lit(None).cast("array<float>")).withColumn("only_topic", F.lit(topic is not None))
        asked = asked.withColumn("wanted_topic", F.coalesce("wanted_topic", topic_of(F.col("text"))))
        return retrieval.hybrid(chunks, asked, k=k)

    def ask(self, questions: list[str], *, topic: str | None = None) -> DataFrame:
        """POST /ask: the sentences that answer each question best."""
        hits = self.search(questions, topic=topic).join(self.table("chunks").select("id", "content"), "id")
        return answers.extract_answer(hits, self._asked(questions), text_col="content")

    def cite(self, questions: list[str]) -> DataFrame:
        """The citations of an answer."""
        c = self.table("chunks").select("id", "content", F.col("metadata.filename").alias("filename"), F.col("metadata.page").alias("page"))
        return answers.citations(self.search(questions).join(c, "id"))

    # --- specifications, documents, administration ---

    def specs(self, q: str | None = None, *, doc_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """GET /specs: cells of tables whose key, row or document has ``q``."""
        f = knowledge.x5_facts(self.spark, self.folder).join(self.table("parsed_docs").select("parsed_id", "doc_id"), "parsed_id")
        has = None if q is None else F.contains(F.lower(F.concat_ws("\n", "key", "row_label", "doc_id")), F.lit(q.lower()))
        found = store.optional(f, has, None if doc_id is None else F.col("doc_id") == doc_id)
        return store.page_of(found, [F.col("doc_id"), F.col("sheet"), F.col("key"), F.col("value")], limit=limit, offset=offset)

    def specs_summary(self) -> DataFrame:
        """GET /specs/summary"""
        f = knowledge.x5_facts(self.spark, self.folder)
        return f.groupBy("parsed_id").agg(F.count("*").alias("n_facts"), F.count_distinct("sheet").alias("sheets"), F.count_distinct("key").alias("keys"))

    def documents(self) -> DataFrame:
        """GET /documents: documents with their chunks, images and last version."""
        n = self.table("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("metadata.filename").alias("filename"))
        p = self.table("parsed_docs").groupBy("doc_id").agg(F.max("version").alias("version"), F.sum(F.coalesce(F.size("images"), F.lit(0))).alias("n_images"))
        return n.join(p, "doc_id", "left").withColumn("version", F.coalesce("version", F.lit(1)))

    def without_document(self, doc_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
        """DELETE /documents/{id}: the tables without it, and how many rows go."""
        doomed = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        return store.delete_documents({n: self.table(n) for n in ("chunks", "parsed_docs", "sheet_readings")}, doomed)

    def low_quality(self, limit: int = 50) -> DataFrame:
        """GET /admin/low-quality-chunks"""
        c = self.table("chunks").where("quality_score < -0.2 OR downvote_count >= 2").select("id", "quality_score", "downvote_count")
        return store.page_of(c, [F.col("quality_score").asc_nulls_last(), F.col("id")], limit=limit)

    def suppress(self, ids: list[int]) -> DataFrame:
        """POST /admin/chunks/{id}/suppress"""
        c = self.table("chunks").select("id", "quality_score")
        return c.withColumn("quality_score", F.when(F.col("id").isin(ids), -999.0).otherwise(F.col("quality_score")))

    def feedback(self, votes: DataFrame) -> DataFrame:
        """POST /feedback: the chunks' quality after votes (vote, chunk_ids)."""
        c = self.table("chunks").select("id", "quality_score", "vote_count", "downvote_count")
        return store.quality_after_votes(c, store.votes_per_chunk(votes), c.where("quality_score <= -999"))

    def doc_debug(self) -> DataFrame:
        """GET /admin/doc-debug"""
        return store.latest_job(self.table("parsed_docs").select("doc_id", F.col("metadata.filename").alias("filename")), self.table("file_inventory"))

    # --- entities, formulas and the graph ---

    def entities(self, doc_id: str | None = None) -> DataFrame:
        """GET /entities"""
        found, _ = answers.entities(F.col("content"))
        c = store.optional(self.table("chunks"), None if doc_id is None else F.col("doc_id") == doc_id)
        return c.select(F.inline(found)).groupBy("type", "name").agg(F.count("*").alias("n"))

    def chunk(self, chunk_id: int) -> DataFrame:
        """GET /chunks/{id}"""
        return self.table("chunks").where(F.col("id") == chunk_id)

    def images(self, chunk_id: int) -> DataFrame:
        """GET /chunks/{id}/images"""
        hit = self.chunk(chunk_id).select("id", "doc_id", F.col("metadata.page").alias("page"))
        return store.figures_for(hit, self.table("parsed_docs").select("doc_id", F.inline("images")).distinct())

    def formulas(self, q: str = "", *, topic: str | None = None, most: int = 20) -> DataFrame:
        """GET /formulas/search"""
        asked = self.spark.createDataFrame([(1, q, topic)], "qid int, text string, topic string")
        return answers.search_formulas(relations.stored_formulas(self.spark, self.folder), asked, most=most)

    def formula_summary(self) -> DataFrame:
        """GET /formulas/summary"""
        return relations.a10_formula_topics(self.spark, self.folder)

    def graph(self, **filters) -> tuple[DataFrame, DataFrame]:
        """GET /graph: see ``graph_view``."""
        own = graph.clean_nodes(relations.nodes(self.spark, self.folder)).select("type", "name", "doc_id")
        built_in = graph.seed_graph(self.spark)[0].withColumn("doc_id", F.lit(None).cast("string"))
        return graph.graph_view(own.unionByName(built_in), relations.edges(self.spark, self.folder), **filters)

    def diagnostic_paths(self, questions: list[str], most: int = 5) -> DataFrame:
        """GET /graph/diagnostic-paths"""
        return graph.ranked_paths(graph.all_paths(relations.edges(self.spark, self.folder)), self._asked(questions), most=max(1, min(most, 20)))

    def graph_quality(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """GET /graph/quality"""
        return graph.quality_report(relations.edges(self.spark, self.folder))

    def stated_rules(self) -> DataFrame:
        """What ingesting adds to the graph by rules."""
        return rules.rule_edges(self.table("chunks"), ["id"], "content")

    def topics(self) -> DataFrame:
        """GET /topics"""
        c = self.table("chunks").groupBy(F.coalesce("metadata.topic", F.lit("Unsorted")).alias("topic")).agg(F.count("*").alias("chunks"))
        f = self.table("file_inventory").groupBy(F.coalesce("topic", F.lit("Unsorted")).alias("topic")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
        return c.join(f, "topic", "full").na.fill(0)
