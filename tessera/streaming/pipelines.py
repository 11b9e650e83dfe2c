"""Streams of documents and events. Each takes a streaming (or static) DataFrame and returns one, so that a batch run gives
the result to expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents


def read_parquet_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream, with the schema of those already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, *, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type, accepted up to ``late`` behind the newest."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, *, width: str = "1 hour", slide: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("string").alias("start"), "n")


def distinct_events(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each event id once, as far as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def visible_parts(parts: DataFrame, *, session: str, order: str, delta: str) -> DataFrame:
    """``parts`` with ``shown``: what each part adds to the answer that a reader sees, without what stands between think marks. A mark may be
    cut anywhere between parts: what may still become one is held back. A session's parts are one answer and stay together."""
    w = Window.partitionBy(session).orderBy(order)
    so_far = F.array_join(F.collect_list(F.coalesce(delta, F.lit(""))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "")
    seen = F.regexp_replace(F.regexp_replace(so_far, r"(?s)<think>.*?(?:</think>|$)", ""), r"<[a-z]{0,5}$", "")
    return parts.withColumn("_seen", seen).withColumn("shown", F.substr("_seen", F.coalesce(F.lag(F.length("_seen")).over(w), F.lit(0)) + 1)).drop("_seen")


#: Stages of ingesting a document with their percentages.
STAGES = [("received", 10), ("parsed", 22), ("normalised", 35), ("chunked", 50), ("embedded", 65), ("deduplicated", 78), ("stored", 88), ("graph", 95), ("done", 100)]


def progress(docs: DataFrame, key_cols: list[str]) -> DataFrame:
    """The progress events of ingesting each document: ``key_cols``, ``no``, ``stage``, ``percent``."""
    steps = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(s).alias("stage"), F.lit(p).alias("percent")) for i, (s, p) in enumerate(STAGES)])
    return docs.select(*key_cols, F.inline(steps))


def answer_events(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """``qid``, ``seq``, ``event``, ``data``: that a question is being thought about, its cited passages one by one, and how many there were."""
    event = lambda df, seq, name, data: df.select("qid", seq.cast("int").alias("seq"), F.lit(name).alias("event"), data.alias("data"))
    done = citations.groupBy("qid").agg(F.count("*").alias("n"))
    first = event(questions, F.lit(0), "thinking", F.col("text"))
    return first.unionByName(event(citations, F.col("no"), "delta", F.concat("label", F.lit(": "), "snippet"))).unionByName(event(done, F.lit(1000), "done", F.concat(F.col("n").cast("string"), F.lit(" sources"))))


def ingest_documents(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, key_cols: list[str], text_col: str):
    """Chunk documents as they come and hand each batch to ``sink`` (batch, batch id), exactly once per batch id. Ends when all
    that is there has been read."""

    def batch(df: DataFrame, n: int) -> None:
        sink(chunk_documents(df, key_cols, text_col), n)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
