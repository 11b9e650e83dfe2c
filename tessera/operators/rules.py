"""Facts that sentences state: causes, remedies, specifications, intervals, warnings and the rows of trouble tables.

Sentences that have a cue word are taken apart side by side, without regard to the others; only what a remedy refers to
(the last cause or problem stated before it in its passage) is carried along, in a window over the passage's own cue
sentences. The ends of the stated relations are then looked up in the list of known entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import evidence, word_pattern
from ..session import spread
from .normalize import normalize_entities

TRIPLE = "array<struct<src_type:string,src:string,relation:string,dst_type:string,dst:string>>"
_NONE = "array<string>"

_PART = "(?i)" + word_pattern(vocab.RULE_PARTS)
_ACTION = "(?i)" + word_pattern(vocab.ACTIONS)
_WARNING = "(?i)" + word_pattern(vocab.WARNINGS)
_ENGINE = r"\b\p{Lu}\p{Ll}+\s+\p{Lu}?\d{3,4}\p{L}*\b"
_INTERVAL = r"(?i)(?<![\p{L}\p{N}_])(?:(?:every|after)\s+\d+\s+hours?|" + "|".join(w.replace(" ", r"\s+") for w in vocab.INTERVALS) + r")(?![\p{L}\p{N}_])"


def quantity_pattern(units: list[str]) -> str:
    """A number, perhaps with a sign, and one of ``units``, which ends where no letter or digit follows."""
    return r"(?i)(?:[±+-]\s*)?(?<![\p{L}\p{N}_.,])\d+(?:[.,]\d+)?\s*(?:" + "|".join(sorted(units, key=len, reverse=True)) + r")(?![\p{L}\p{N}_/])"


_SPEC = quantity_pattern(vocab.RULE_UNITS)
#: Verbs that tie a cause to its effect: (verb with its helpers, whether the cause stands before it)
_VERBS = ((r"(?i)\s(?:may\s+)?causes?\s", True), (r"(?i)\s(?:(?:may\s+be|is)\s+)?caused\s+by\s", False))
_LABELS = "|".join(w.replace(" ", r"\s+") for w in [*vocab.CAUSE_LABELS, *vocab.REMEDY_LABELS])
_CUE = rf"(?i)caus|{_LABELS}|{'|'.join(vocab.ACTIONS)}|{'|'.join(vocab.WARNINGS)}|{'|'.join(vocab.INTERVALS)}|\d\s*(?:{'|'.join(vocab.RULE_UNITS)})"


def sentences(passages: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``pos``, ``s``: sentences and lines of each passage, without blank ones."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"([.!?])\s+", "$1\n"), r"\n+")
    return passages.select(*key_cols, F.posexplode_outer(parts).alias("pos", "s")).select(*key_cols, "pos", F.trim("s").alias("s")).where("s <> ''")


def _clause(c: Column, last: bool) -> Column:
    """The part of ``c`` beside a verb, up to a full stop, semicolon or colon, at most 80 characters."""
    parts = F.split(c, r"[.;:]")
    return F.trim(F.right(F.element_at(parts, -1), F.lit(80))) if last else F.trim(F.left(F.element_at(parts, 1), F.lit(80)))


def _after_label(s: Column, labels: list[str], most: int) -> Column:
    """What a label such as "Cause:" introduces, null if there is none."""
    got = F.regexp_extract(s, "(?i)" + word_pattern(labels).removesuffix(r"(?![\p{L}\p{N}_])") + rf"\s*:\s*([^.;]{{3,{most}}})", 1)
    return F.nullif(F.trim(got), F.lit(""))


def near_symptom(s: Column) -> Column:
    """The first of the usual symptoms that a text names."""
    low = F.lower(s)
    return F.try_element_at(F.filter(F.array(*[F.lit(w) for w in vocab.NEAR_SYMPTOMS]), lambda w: F.contains(low, w)), F.lit(1))


def entity_text(c: Column) -> Column:
    """The name in a stated end: a usual symptom in it, else its words without labels and fillers; null if nothing useful is left."""
    bare = F.regexp_replace(c, rf"(?i)^\s*(?:{_LABELS})\s*:\s*", "")
    words = F.regexp_replace(F.regexp_replace(bare, "(?i)" + word_pattern(vocab.FILLERS), " "), r"\s+", " ")
    name = F.coalesce(near_symptom(bare), F.left(F.regexp_replace(words, r"^[ .,:;]+|[ .,:;]+$", ""), F.lit(80)))
    return F.when((F.length(name) >= 2) & ~F.lower(name).isin(vocab.VAGUE), name)


def first_part(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, _PART, 0), F.lit(""))


def _stated(s: Column) -> Column:
    """(effect, cause) that a sentence states, null if none."""
    out = None
    for verb, cause_first in _VERBS:
        sides = F.split(s, verb, 2)
        before, after = _clause(F.element_at(sides, 1), True), _clause(F.try_element_at(sides, F.lit(2)), False)
        effect, cause = (after, before) if cause_first else (before, after)
        hit = F.when((F.size(sides) == 2) & (F.length(before) >= 3) & (F.length(after) >= 3), F.struct(F.coalesce(near_symptom(effect), effect).alias("effect"), cause.alias("cause")))
        out = hit if out is None else F.coalesce(out, hit)
    label = _after_label(s, vocab.CAUSE_LABELS, 80)
    return F.coalesce(out, F.when(label.isNotNull(), F.struct(F.coalesce(near_symptom(s), F.lit("Diagnostic Symptom")).alias("effect"), label.alias("cause"))))


def _remedies(s: Column) -> Column:
    """Remedies as (fix, part): every action with the part or the words that follow it, also under the other actions that the
    sentence joins by "or" or "and", and what a label introduces."""
    named = F.array_compact(F.array(*[F.when(s.rlike(rf"(?i)\b(?:or|and)\s+{a}\b"), F.lit(a)) for a in vocab.ACTIONS]))

    def of_action(m: Column) -> Column:
        own, rest = F.lower(F.regexp_extract(m, r"^\S+", 0)), F.regexp_replace(m, r"^\S+\s+", "")
        target = F.coalesce(first_part(rest), rest)
        return F.transform(F.array_union(F.array(own), named), lambda a: F.struct(F.concat(F.initcap(a), F.lit(" "), target).alias("fix"), first_part(target).alias("part")))

    matches = F.regexp_extract_all(s, F.lit(_ACTION + r"\s+[^.;,]{2,70}"), F.lit(0))
    label = _after_label(s, vocab.REMEDY_LABELS, 90)
    labelled = F.when(label.isNotNull(), F.array(F.struct(label.alias("fix"), first_part(label).alias("part")))).otherwise(F.array().cast("array<struct<fix:string,part:string>>"))
    return F.concat(F.flatten(F.transform(matches, of_action)), labelled)


def facts(passages: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``pos``, ``s`` and what each cue sentence states: ``stated`` (effect, cause), ``remedies``, ``part``, ``engines``, ``specs``, ``interval``,
    ``action``, ``warns``. Null passages and sentences without a cue give no row."""
    s = F.col("s")
    some = spread(passages.select(*key_cols, text_col).where(F.col(text_col).isNotNull()))
    cued = sentences(some.where(F.col(text_col).rlike(_CUE)), key_cols, text_col).where(s.rlike(_CUE))
    return cued.select(
        *key_cols,
        "pos",
        "s",
        _stated(s).alias("stated"),
        F.when(s.rlike(_ACTION) | s.rlike(rf"(?i)(?:{_LABELS})\s*:"), _remedies(s)).otherwise(F.array().cast("array<struct<fix:string,part:string>>")).alias("remedies"),
        first_part(s).alias("part"),
        F.regexp_extract_all(s, F.lit(_ENGINE), F.lit(0)).alias("engines"),
        F.transform(F.regexp_extract_all(s, F.lit(_SPEC), F.lit(0)), lambda z: F.trim(z)).alias("specs"),
        F.nullif(F.regexp_extract(s, _INTERVAL, 0), F.lit("")).alias("interval"),
        F.coalesce(F.try_element_at(F.filter(F.array(*[F.lit(a) for a in vocab.ACTIONS]), lambda a: F.contains(F.lower(s), a)), F.lit(1)), F.lit("inspect")).alias("action"),
        s.rlike(_WARNING).alias("warns"),
    )


def _edge(src_type: Column | str, src: Column, relation: str, dst_type: str, dst: Column) -> Column:
    return F.struct((F.lit(src_type) if isinstance(src_type, str) else src_type).alias("src_type"), src.alias("src"), F.lit(relation).alias("relation"), F.lit(dst_type).alias("dst_type"), dst.alias("dst"))


def trouble_rows(passages: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``evidence``, ``triples``: causes and fixes from tables with a header of trouble words: lines of three cells or more
    after the first such line."""
    head = "(?i)" + "|".join(vocab.TROUBLE_HEADERS)
    cells = lambda line: F.filter(F.transform(F.split(line, r"\s*\|\s*|\t+"), lambda z: F.trim(z)), lambda x: x != "")
    rows = F.filter(F.transform(F.split(F.col(text_col), r"\r?\n"), cells), lambda c: F.size(c) >= 3)
    tabs = passages.where(F.col(text_col).rlike(head) & F.col(text_col).rlike(r"[|\t]")).select(*key_cols, rows.alias("r"))
    first = F.array_position(F.transform("r", lambda c: F.array_join(c, " ").rlike(head)), True)
    body = tabs.withColumn("first", first.cast("int")).where("first > 0").select(*key_cols, F.explode(F.slice("r", F.col("first") + 1, F.size("r"))).alias("c"))
    c = lambda i: F.element_at("c", i)
    triples = F.array(_edge("symptom", entity_text(c(1)), "CAUSED_BY", "cause", entity_text(c(2))), _edge("cause", entity_text(c(2)), "FIXED_BY", "fix", entity_text(c(3))))
    return body.select(*key_cols, evidence(F.array_join("c", " | ")).alias("evidence"), triples.cast(TRIPLE).alias("triples"))


def stated_triples(passages: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``key_cols``, ``src_type``, ``src``, ``relation``, ``dst_type``, ``dst``, ``evidence``, ``confidence``, ``extraction_method``: all relations as stated, ends not yet looked up.

    A remedy belongs to the last cause stated in its passage up to its own sentence, or to the problem if that statement has no
    useful cause; without either it gives no FIXED_BY. Numbers with units belong to the sentence's first part and its engines, or
    else to their source; intervals to a procedure of the part or of maintenance; a warning to the part."""
    before = Window.partitionBy(*key_cols).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    f = facts(passages, key_cols, text_col).withColumn("last", F.last("stated", True).over(before))
    none = F.array().cast(TRIPLE)
    some = lambda cond, a: F.when(cond, a.cast(TRIPLE)).otherwise(none)
    effect, cause, part = entity_text(F.col("last.effect")), entity_text(F.col("last.cause")), F.col("part")
    owner_type = F.when(cause.isNotNull(), "cause").otherwise("symptom")
    fixes = F.flatten(F.transform("remedies", lambda r: F.array(_edge(owner_type, F.coalesce(cause, effect), "FIXED_BY", "fix", entity_text(r["fix"])), _edge("fix", entity_text(r["fix"]), "RELATED_TO", "part", r["part"]))))
    of_part = F.transform("specs", lambda x: _edge("part", part, "HAS_SPEC", "spec", x))
    of_engine = F.flatten(F.transform("engines", lambda e: F.transform("specs", lambda x: _edge("engine", e, "HAS_SPEC", "spec", x))))
    alone = F.transform("specs", lambda x: _edge("spec", x, "MENTIONED_IN", "source", F.lit("Source Chunk")))
    procedure = F.concat(F.initcap("action"), F.lit(" "), F.coalesce(part, F.lit("Procedure")))
    every = F.concat(
        some(F.col("stated").isNotNull(), F.array(_edge("symptom", entity_text(F.col("stated.effect")), "CAUSED_BY", "cause", entity_text(F.col("stated.cause"))))),
        fixes.cast(TRIPLE),
        some(part.isNotNull(), of_part),
        of_engine.cast(TRIPLE),
        some(part.isNull() & (F.size("engines") == 0), alone),
        some(F.col("interval").isNotNull(), F.array(_edge(F.when(part.isNotNull(), "part").otherwise("system"), F.coalesce(part, F.lit("Maintenance")), "REQUIRES_PROCEDURE", "procedure", procedure), _edge("procedure", procedure, "HAS_SPEC", "spec", F.col("interval")))),
        some(F.col("warns") & part.isNotNull(), F.array(_edge("part", part, "RELATED_TO", "warning", F.lit("Technical Warning")))),
    )
    said = f.select(*key_cols, evidence(F.col("s")).alias("evidence"), every.alias("triples"))
    both = said.withColumns({"confidence": F.lit(0.82), "extraction_method": F.lit("rule")}).unionByName(trouble_rows(passages, key_cols, text_col).withColumns({"confidence": F.lit(0.9), "extraction_method": F.lit("table")}))
    out = both.select(*key_cols, "evidence", "confidence", "extraction_method", F.inline_outer("triples")).where("src IS NOT NULL AND dst IS NOT NULL")
    return out.select(*key_cols, "src_type", "src", "relation", "dst_type", "dst", "evidence", "confidence", "extraction_method")


def resolve_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``edges`` with both ends replaced by the entities they stand for; edges with an end that is noise go. Every distinct end is
    looked up once."""
    ends = edges.select(F.col("src_type").alias("t"), F.col("src").alias("n")).union(edges.select("dst_type", "dst")).distinct()
    known = normalize_entities(ends, entities, key_cols=["t", "n"], name_col="n", type_col="t").where("reason = ''").select("t", "n", "canonical", "node_type")
    out = edges
    for end in ("src", "dst"):
        k = known.select(F.col("t").alias(f"{end}_type"), F.col("n").alias(end), F.col("canonical").alias("_c"), F.col("node_type").alias("_t"))
        out = out.join(k, [f"{end}_type", end]).drop(end, f"{end}_type").withColumnsRenamed({"_c": end, "_t": f"{end}_type"})
    return out.select(*edges.columns)


def rule_edges(passages: DataFrame, key_cols: list[str], text_col: str, entities: DataFrame | None = None) -> DataFrame:
    """The stated relations of all passages between known entities (type, canonical_name, aliases; default: the built-in graph's)."""
    if entities is None:
        from .graph import seed_graph

        entities = seed_graph(passages.sparkSession)[0].select("type", F.col("name").alias("canonical_name"), F.array().cast(_NONE).alias("aliases"))
    return resolve_ends(stated_triples(passages, key_cols, text_col), entities)
