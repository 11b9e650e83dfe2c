"""The knowledge graph: seed, co-occurrence in passages, merging, paths, views and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import node_type, query_terms, relation, word_pattern
from ..session import cut, spread
from .rules import quantity_pattern

NODE = "type string, name string"
EDGE = "src_type string, src string, relation string, dst_type string, dst string, confidence double, extraction_method string"


def seed_edges() -> list[tuple[str, str, str, str, str]]:
    """Seed edges as (src_type, src, relation, dst_type, dst)."""
    v = vocab
    rows = [("engine", "Two-Stroke Engine", "HAS_SYSTEM", "system", s) for s in v.SYSTEM_PARTS]
    rows += [("system", s, "HAS_PART", "part", p) for s, parts in v.SYSTEM_PARTS.items() for p in parts]
    rows += [("engine", "Two-Stroke Engine", "HAS_SYMPTOM", "symptom", s) for s in v.SYMPTOM_CAUSES]
    rows += [("symptom", s, "CAUSED_BY", "cause", c) for s, causes in v.SYMPTOM_CAUSES.items() for c in causes]
    rows += [("cause", c, "FIXED_BY", "fix", f) for c, fixes in v.CAUSE_FIXES.items() for f in fixes]
    rows.append(("system", "Maintenance", "REQUIRES_PROCEDURE", "procedure", "Scheduled Maintenance"))
    rows.append(("system", "Certification / Testing", "TESTED_BY", "test", "Endurance Test"))
    return rows


def seed_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the built-in diagnostic graph."""
    edges = spark.createDataFrame([(*e, 0.95, "manual_seed") for e in seed_edges()], EDGE)
    nodes = edges.select(F.col("src_type").alias("type"), F.col("src").alias("name")).union(edges.select("dst_type", "dst")).distinct()
    return nodes, edges


def seed_values_sql() -> str:
    """The seed edges as the rows of a VALUES clause."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ",\n".join("(" + ", ".join(map(q, e)) + ")" for e in seed_edges())


def diagnostic_paths(edges: DataFrame, symptoms: Column | None = None) -> DataFrame:
    """``symptom``, ``cause``, ``fix`` (null where a cause has none): symptom -CAUSED_BY-> cause (-FIXED_BY-> fix)?"""
    first = edges.where("relation = 'CAUSED_BY'").select(F.col("src").alias("symptom"), F.col("dst_type").alias("_ct"), F.col("dst").alias("cause"))
    if symptoms is not None:
        first = first.where(symptoms)
    second = edges.where("relation = 'FIXED_BY'").select(F.col("src_type").alias("_ct"), F.col("src").alias("cause"), F.col("dst").alias("fix"))
    return first.join(second, ["_ct", "cause"], "left").select("symptom", "cause", "fix")


def neighbourhood(edges: DataFrame, match: Column) -> DataFrame:
    """Edges with an end whose name matches; ``match`` is an expression on the column ``name``."""
    hit = edges.withColumn("name", F.col("src")).where(match).drop("name").unionByName(edges.withColumn("name", F.col("dst")).where(match).drop("name"))
    return hit.dropDuplicates()


def degrees(edges: DataFrame) -> DataFrame:
    """``type``, ``name``, ``degree``; an edge from a node to itself counts once. One aggregation, no OR join."""
    ends = F.array_distinct(F.array(F.struct(F.col("src_type").alias("type"), F.col("src").alias("name")), F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("name"))))
    return edges.select(F.explode(ends).alias("n")).groupBy(F.col("n.type").alias("type"), F.col("n.name").alias("name")).agg(F.count("*").alias("degree"))


_ENGINE = r"\b\p{Lu}[\p{L}-]+\s*\p{Lu}?\d{3,4}\p{L}?\b"


def passage_score(text: Column, is_table: Column, weights: dict[str, float] = vocab.KG_WEIGHTS) -> Column:
    """How much a passage promises for extraction: weights of its words, 3 for a table, 2 for a part, 2 for a number with a unit
    and 1 for an engine. Blank passages promise nothing."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    parts = [F.when(low.contains(w), F.lit(v)).otherwise(0.0) for w, v in weights.items()]
    more = F.when(is_table, 3.0).otherwise(0.0)
    for pattern, v in (("(?i)" + word_pattern(vocab.GRAPH_PARTS), 2.0), (quantity_pattern(vocab.GRAPH_UNITS), 2.0), (_ENGINE, 1.0)):
        more = more + F.when(t.rlike(pattern), v).otherwise(0.0)
    return F.when(F.trim(t) == "", 0.0).otherwise(reduce(lambda a, b: a + b, parts) + more)


def select_passages(scored: DataFrame, *, doc: str, order: str, most: int = 40, few: int = 5) -> DataFrame:
    """Per document its ``most`` best passages of a positive score; all of them in a document of ``most`` or fewer; ``few`` if none has
    one. The best come out of a bounded aggregate for each document, not of sorting it whole."""
    scored = cut(scored)  # narrow rows, used three times
    per = scored.groupBy(doc).agg(F.count("*").alias("_n"), F.max("score").alias("_best"))
    ranked = scored.withColumn("_rn", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), order))).where(F.col("_rn") <= most)
    small = scored.join(per.where(F.col("_n") <= most).select(doc), doc).select(*scored.columns)
    large = ranked.join(per.where(F.col("_n") > most).select(doc, "_best"), doc).where(((F.col("_best") > 0) & (F.col("score") > 0)) | ((F.col("_best") <= 0) & (F.col("_rn") <= few)))
    return small.unionByName(large.select(*scored.columns))


def mentions(passages: DataFrame, key_cols: list[str], text_col: str, terms: DataFrame) -> DataFrame:
    """``key_cols``, ``type``, ``name``: terms (type, name, alias) that occur in a passage as whole words, under their names.

    Runs of words of the passage, as long as the terms are, meet the terms in an equi join, so the cost doesn't grow with
    the vocabulary times the corpus."""
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    vocabulary = terms.select("type", "name", split(F.col("alias")).alias("_w")).where(F.size("_w") > 0)
    vocabulary = vocabulary.select("type", "name", F.array_join("_w", " ").alias("_g"), F.size("_w").alias("_n")).dropDuplicates()
    lengths = sorted(r["_n"] for r in vocabulary.select("_n").distinct().collect())  # lengths of terms in words
    words = spread(passages.select(*key_cols, text_col)).select(*key_cols, split(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    grams = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    all_grams = F.array_distinct(F.concat(*[F.col("_w") if n == 1 else grams(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    return words.select(*key_cols, F.explode_outer(all_grams).alias("_g")).join(vocabulary, "_g").select(*key_cols, "type", "name").distinct()


def pattern_mentions(passages: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``type``, ``name``: engines and numbers with units that occur in a passage."""
    text = F.col(text_col)
    found = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda n: F.struct(F.lit(kind).alias("type"), F.trim(F.regexp_replace(n, r"\s+", " ")).alias("name")))
    hit = spread(passages.select(*key_cols, text_col)).where(text.rlike(r"\d"))
    return hit.select(*key_cols, F.inline_outer(F.array_distinct(F.concat(found("engine", _ENGINE), found("spec", quantity_pattern(vocab.GRAPH_UNITS)))))).where("name IS NOT NULL")


def co_occurrence(found: DataFrame, key_cols: list[str], *, rules: dict[tuple[str, str], str], confidence: float = 0.78) -> DataFrame:
    """Edges between entities of one passage, by the types at their ends. Every passage is joined with itself only, and
    its distinct entities are few."""
    a = found.select(*key_cols, F.col("type").alias("src_type"), F.col("name").alias("src"))
    b = found.select(*key_cols, F.col("type").alias("dst_type"), F.col("name").alias("dst"))
    kind = F.create_map(*[F.lit(x) for (s, d), r in rules.items() for x in (f"{s}>{d}", r)])
    pairs = a.join(b, key_cols).withColumn("relation", F.try_element_at(kind, F.concat("src_type", F.lit(">"), "dst_type")))
    return pairs.where(F.col("relation").isNotNull() & ((F.col("src_type") != F.col("dst_type")) | (F.col("src") != F.col("dst")))).withColumn("confidence", F.lit(confidence)).withColumn("extraction_method", F.lit("regex"))


def merge_nodes(nodes: DataFrame, order_col: str, fields: list[str]) -> DataFrame:
    """One node per (type, name): for each field the last value that isn't null, by ``order_col``."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order_col))).alias(f) for f in fields]
    return nodes.groupBy("type", "name").agg(*last)


def add_edges(stored: DataFrame, new: DataFrame, key: Column, place: list[str] | None = None) -> DataFrame:
    """``stored`` and those of ``new`` whose key isn't there yet, one per key; nor is one added whose columns ``place`` (ends, relation,
    document and chunk) are all equal to a stored one's, nulls included."""
    old = stored.withColumn("edge_key", key)
    fresh = new.withColumn("edge_key", key).dropDuplicates(["edge_key"]).join(old.select("edge_key"), "edge_key", "left_anti")
    if place:
        other = old.select(*[F.col(c).alias(f"_o_{c}") for c in place]).distinct()
        fresh = fresh.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in place]), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


# --- edges between extracted nodes --------------------------------------------------------------------------------

#: relation of an edge by the types at its ends
RELATION_OF = {
    ("engine", "system"): "HAS_SYSTEM", ("system", "part"): "HAS_PART", ("engine", "part"): "HAS_PART", ("engine", "symptom"): "HAS_SYMPTOM", ("symptom", "cause"): "CAUSED_BY", ("cause", "fix"): "FIXED_BY",
    ("engine", "spec"): "HAS_SPEC", ("part", "spec"): "HAS_SPEC", ("part", "procedure"): "REQUIRES_PROCEDURE", ("engine", "test"): "TESTED_BY", ("spec", "source"): "MENTIONED_IN",
}


def relate(a_type: Column, b_type: Column) -> Column:
    """(relation, whether the second node is its source) of two nodes found beside each other."""
    kind = F.create_map(*[F.lit(x) for (s, d), r in RELATION_OF.items() for x in (f"{s}>{d}", r)])
    ahead, back = (F.try_element_at(kind, F.concat(x, F.lit(">"), y)) for x, y in ((a_type, b_type), (b_type, a_type)))
    return F.struct(F.coalesce(ahead, back, F.lit("RELATED_TO")).alias("relation"), (ahead.isNull() & back.isNotNull()).alias("swap"))


def node_edges(nodes: DataFrame) -> DataFrame:
    """Edges between nodes (id, type, name, doc_id, chunk, page, confidence, method) taken from one chunk, and between a node and the
    next one of its document's page: ``src_type``, ``src``, ``relation``, ``dst_type``, ``dst``, ``doc_id``, ``chunk``, ``page``, ``confidence`` (the lower one), ``method`` (the first node's)."""
    n = nodes.where(F.trim("name") != "").select("id", node_type(F.col("type")).alias("type"), F.trim("name").alias("name"), "doc_id", "chunk", "page", "confidence", "method")
    b = n.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "type", "name", "confidence")], F.col("chunk"))
    together = n.where("chunk IS NOT NULL").join(b, "chunk").where("id < b_id").select("id", "type", "name", "doc_id", "chunk", "page", "confidence", "method", "b_type", "b_name", "b_confidence")
    w = Window.partitionBy("doc_id", "page").orderBy("id")
    after = n.where("doc_id IS NOT NULL AND page IS NOT NULL").select("*", *[F.lead(c).over(w).alias(f"b_{c}") for c in ("type", "name", "confidence")]).where("b_name IS NOT NULL").select(*together.columns)
    both = together.unionByName(after).withColumn("r", relate(F.col("type"), F.col("b_type")))
    turn = lambda x, y: F.when(F.col("r.swap"), F.col(y)).otherwise(F.col(x))
    return both.select(turn("type", "b_type").alias("src_type"), turn("name", "b_name").alias("src"), F.col("r.relation").alias("relation"), turn("b_type", "type").alias("dst_type"), turn("b_name", "name").alias("dst"), "doc_id", "chunk", "page", F.least("confidence", "b_confidence").alias("confidence"), "method")


# --- paths and views ----------------------------------------------------------------------------------------------


def typed_paths(edges: DataFrame, types: tuple[str, str, str]) -> DataFrame:
    """``first``, ``second``, ``third``: two edges in a row between nodes of the given types."""
    a, b, c = types
    one = edges.where((F.col("src_type") == a) & (F.col("dst_type") == b)).select(F.col("src").alias("first"), F.col("dst").alias("second"))
    two = edges.where((F.col("src_type") == b) & (F.col("dst_type") == c)).select(F.col("src").alias("second"), F.col("dst").alias("third"))
    return one.join(two, "second").select("first", "second", "third")


def relation_paths(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``first``, ``second``, ``third``: an edge of the relation ``first`` and one of ``second`` from its end, which has the same type and name."""
    one = edges.where(F.col("relation") == first).select(F.col("src").alias("first"), F.col("dst_type").alias("_t"), F.col("dst").alias("second"))
    two = edges.where(F.col("relation") == second).select(F.col("src_type").alias("_t"), F.col("src").alias("second"), F.col("dst").alias("third"))
    return one.join(two, ["_t", "second"]).select("first", "second", "third")


def all_paths(edges: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``confidence``, ``evidence_doc``: diagnostic paths and single edges as text, each once with its best confidence."""
    e = edges.select("src_type", "src", "relation", "dst_type", "dst", "confidence", "doc_id")
    caused = e.where("relation = 'CAUSED_BY'")
    fixed = e.where("relation = 'FIXED_BY'").select(F.col("src_type").alias("dst_type"), F.col("src").alias("dst"), F.col("dst").alias("fix"), F.col("confidence").alias("c2"), F.col("doc_id").alias("d2"))
    long = caused.join(fixed, ["dst_type", "dst"], "left")
    arrow = lambda a, r, b: F.concat(a, F.lit(" --"), r, F.lit("--> "), b)
    path = F.when(F.col("fix").isNull(), arrow(F.col("src"), F.lit("CAUSED_BY"), F.col("dst"))).otherwise(F.concat(arrow(F.col("src"), F.lit("CAUSED_BY"), F.col("dst")), F.lit(" --FIXED_BY--> "), "fix"))
    diagnostic = long.select(path.alias("path"), F.lit("diagnostic_path").alias("kind"), F.when(F.col("fix").isNull(), F.col("confidence")).otherwise(F.col("c2")).alias("confidence"), F.when(F.col("fix").isNull(), F.col("doc_id")).otherwise(F.col("d2")).alias("doc_id"))
    typed = lambda n, t: F.concat(n, F.lit(" ("), t, F.lit(")"))
    single = e.select(arrow(typed(F.col("src"), F.col("src_type")), F.col("relation"), typed(F.col("dst"), F.col("dst_type"))).alias("path"), F.lit("neighborhood").alias("kind"), "confidence", "doc_id")
    return diagnostic.unionByName(single).groupBy("path").agg(F.min("kind").alias("kind"), F.max("confidence").alias("confidence"), F.min("doc_id").alias("doc_id"))


def ranked_paths(paths: DataFrame, questions: DataFrame, *, most: int = 5, most_questions: int = 10_000) -> DataFrame:
    """``qid``, ``rank``, ``path``, ``kind``, ``hits``, ``confidence``: each question's paths with most of its terms (see ``query_terms``), then by confidence, then by
    path. Questions go to every task; more than ``most_questions`` raise an error. The best of a question come from each task's own best."""
    asked = few(questions, most_questions).select("qid", query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    low = F.lower("path")
    scored = paths.crossJoin(F.broadcast(asked)).select("qid", "path", "kind", F.size(F.filter("terms", lambda t: F.contains(low, t))).alias("hits"), "confidence").where("hits > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc(F.coalesce("confidence", F.lit(0.0))), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "rank", "path", "kind", "hits", "confidence")


def few(df: DataFrame, most: int) -> DataFrame:
    """``df``, after making sure that it has at most ``most`` rows and so may go to every task."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; ask in batches")
    return df


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a name, their types of the vocabulary and names trimmed, as edges have them."""
    return nodes.where(F.trim("name") != "").withColumns({"type": node_type(F.col("type")), "name": F.trim("name")})


def graph_view(nodes: DataFrame, edges: DataFrame, *, node_type: str | None = None, edge_type: str | None = None, doc_id: str | None = None, topic: str | None = None, min_confidence: float = 0.4, method: str | None = None, include_seed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a view of the graph shows. Edges need both ends among the nodes and, unless they are seeds, a confidence
    that is unknown or at least ``min_confidence``; with a type or document asked for, both ends among the nodes of it. Of the nodes those
    at a shown edge stay; without a topic all do if no edge is shown. ``nodes``: type, name, doc_id; ``edges``: as ``node_edges``, topic."""
    picked = nodes.select("type", "name", "doc_id")
    if node_type:
        picked = picked.where(F.col("type") == node_type)
    if doc_id:
        picked = picked.where(F.col("doc_id") == doc_id)
    seed = F.col("method") == "manual_seed"
    shown = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence) | seed)
    for col, value in (("relation", edge_type), ("doc_id", doc_id), ("topic", topic), ("method", method)):
        if value:
            shown = shown.where(F.col(col) == value)
    if not include_seed:
        shown = shown.where(~seed)
    ends = (picked if node_type or doc_id else nodes).select("type", "name").distinct()
    for end in ("src", "dst"):
        shown = shown.join(ends.select(F.col("type").alias(f"{end}_type"), F.col("name").alias(end)), [f"{end}_type", end], "left_semi")
    at = shown.select(F.col("src_type").alias("type"), F.col("src").alias("name")).union(shown.select("dst_type", "dst")).distinct()
    kept = picked.join(at, ["type", "name"], "left_semi")
    if not topic:
        nothing = shown.agg((F.count("*") == 0).alias("_none"))
        kept = kept.unionByName(picked.crossJoin(F.broadcast(nothing)).where("_none").drop("_none"))  # one row
    return kept.select("type", "name").distinct(), shown


def quality_report(edges: DataFrame, *, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges by relation, coverage in one row, the ``most`` nodes with most edges)."""
    by_relation = edges.groupBy("relation").agg(F.count("*").alias("n"))
    share = lambda c: F.round(100 * F.count(c) / F.count("*"), 1)
    coverage = edges.agg(F.count("*").alias("n_edges"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), share("doc_id").alias("doc_pct"), share("chunk").alias("chunk_pct"))
    top = degrees(edges).orderBy(F.desc("degree"), "type", "name").limit(most)
    return by_relation, coverage, top


def vocabulary_edges(edges: DataFrame) -> DataFrame:
    """Edges with types and relations of the vocabulary."""
    return edges.withColumns({"src_type": node_type(F.col("src_type")), "dst_type": node_type(F.col("dst_type")), "relation": relation(F.col("relation"))})
