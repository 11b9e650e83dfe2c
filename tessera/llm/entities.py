"""Freely typed values mapped to a reference list, by token-level repair and soft TF-IDF.

Each distinct token of the values is joined to the reference vocabulary by edit distance (through shared deletion
variants or, for long ones, shared parts, not by comparing all pairs); the repaired tokens of a value then rank the
complete entries. Values, tokens, words and entries are tables throughout, so neither side has a greatest size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..session import cut

# Words that carry no meaning in a name.
STOP = frozenset("the a an of to der die das den dem des ein eine le la les l un une du de d el los las il lo gli i".split())
_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"})
# Words that tell which piece of a thing is meant and not another thing.
QUALIFIERS = frozenset("assy assembly left right front rear upper lower links rechts vorn hinten lh rh no nr qty pcs stk complete komplett kpl gauche droit droite x".split())
#: Signs that look alike, which count half as an edit.
_ALIKE = {frozenset(p) for p in ("1l", "1i", "0o", "il", "5s", "8b", "ce", "nu", "ft", "6b", "!i", "!l", "vu", "gq")}


def fold(text: str) -> str:
    """Lower case, composed, umlauts spelled out, other accents off."""
    t = unicodedata.normalize("NFC", text).lower().translate(_FOLD)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def tokens_of(text: str | None) -> list[str]:
    """Tokens in order. A full stop stays at the token it follows (it may be cut short); k440 gives k and 440."""
    out = []
    for w in re.findall(r"[a-z0-9!]+(?:-?\.)?", fold(text or "")):
        w = w.lstrip("!").replace("-.", ".")
        m = re.fullmatch(r"([a-z]{1,3})(\d{2,})", w)
        out += [m[1], m[2]] if m else ([w] if w.strip("!.") else [])
    return out


def reach(n: int) -> int:
    """Edits allowed for a token of ``n`` characters."""
    return 0 if n < 3 else 1 if n < 4 else 2


def deletions(token: str) -> list[str]:
    """The token with up to ``reach`` characters left out: two tokens within that distance share one of these."""
    if token.isdigit():
        return [token]
    out = {token}
    for k in range(1, reach(len(token.rstrip("."))) + 1):
        out.update("".join(c for i, c in enumerate(token) if i not in gone) for gone in combinations(range(len(token)), k))
    return sorted(out)


SHORT, PIECES = 18, 5  # up to SHORT characters tokens meet by deletions, from SHORT - 1 on by pieces


def _pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a word of ``n`` characters; two edits, be they swaps across a border, leave one whole."""
    return [(n * i // PIECES, n * (i + 1) // PIECES - n * i // PIECES) for i in range(PIECES)]


def word_keys(word: str, token: bool = True) -> list[str]:
    """Under which keys a word of the reference stands: deletion variants of it and, if it is a ``token`` and not an entry
    written as one, of its shortened beginnings; for a long one its parts."""
    forms = [word, *((word + ".", *(word[:k] + "." for k in range(3, min(13, len(word))))) if token else ())]
    out = {d for f in forms if len(f.rstrip(".")) <= SHORT for d in deletions(f)}
    if len(word) >= SHORT - 1:
        out.update(f"{len(word)}:{i}:{word[a : a + m]}" for i, (a, m) in enumerate(_pieces(len(word))))
    return sorted(out)


def token_keys(token: str) -> list[str]:
    """Under which keys the words near a token stand."""
    bare = token.rstrip(".")
    out = set(deletions(token)) if len(bare) <= SHORT else set()
    if len(bare) >= SHORT - 1:
        for n in range(max(SHORT - 1, len(bare) - 2), len(bare) + 3):
            for i, (a, m) in enumerate(_pieces(n)):
                out.update(f"{n}:{i}:{bare[z : z + m]}" for z in range(max(0, a - 2), a + 3))
    return sorted(out)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> float:
    """Optimal string alignment distance; look-alike signs cost half, swapped neighbours 1."""
    prev2, prev = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            sub = 0.0 if x == y else 0.5 if frozenset((x, y)) in _ALIKE else 1.0
            best = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + sub)
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 1)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def likeness(token: str, word: str) -> float:
    """0 to 1, how well ``token`` stands for the vocabulary word ``word``: by edits, or as its shortened beginning."""
    if token.isdigit() or word.isdigit():
        return float(token == word)
    bare = token.rstrip(".")
    n = max(len(bare), len(word))
    d = edits(bare, word)
    got = 1 - d / n if d <= max(1.0, 0.4 * n) and d <= 2.5 else 0.0
    if token.endswith(".") and 2 <= len(bare) < len(word):
        d = edits(bare, word[: len(bare)])
        if d <= (1 if len(bare) >= 3 else 0):
            got = max(got, 0.95 - 0.2 * d)
    return got if got >= 0.5 else 0.0


def form_of(text: str) -> tuple[list[str], list[int]]:
    """Tokens of an entry and, for each, the number of the blank-separated part it stands in."""
    pieces = [(t.rstrip("."), g) for g, part in enumerate(re.split(r"\s+", text or "")) for t in tokens_of(part)]
    return [t for t, _ in pieces], [g for _, g in pieces]


def soft_score(tokens: list[str], words: list[str], groups: list[int], idf: list[float], repaired: dict[str, dict[str, float]]) -> float:
    """Soft TF-IDF of a value's ``tokens`` with an entry's ``words``. Every word of the value that carries meaning must stand for a
    word of the entry, and the other way round: a further word makes it another thing."""
    pairs = sorted(((s, -abs(i - j), i, j) for i, t in enumerate(tokens) for j, x in enumerate(words) if (s := repaired.get(t, {}).get(x))), reverse=True)
    used_i, used_j, dot, short = set(), set(), 0.0, set()
    for s, _, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            dot += s * idf[j] ** 2
            if tokens[i].endswith("."):
                short.add(groups[j])
    for i, t in enumerate(tokens):
        bare = t.rstrip(".")
        if i not in used_i and not (bare in STOP or bare in QUALIFIERS or len(bare) == 1 or re.fullmatch(r"\d{1,2}x?", bare)):
            return 0.0  # a word that the entry doesn't have
    for j, w in enumerate(words):
        if j not in used_j and groups[j] not in short and (w.isdigit() or w not in STOP and len(w) > 1):
            return 0.0  # a word of the entry that is missing
    own = sum(v**2 for v in idf)
    mine = sum(idf[j] ** 2 for j in used_j) + sum(0.1 for i in range(len(tokens)) if i not in used_i)
    return dot / math.sqrt(own * mine) if own and mine else 0.0


def rank(tokens: list[str], repaired: dict[str, dict[str, float]], forms: list[dict], *, least: float = 0.72) -> list[tuple[int, str, float]]:
    """(ref_id, kind, score) of the entries among ``forms``, best first, those from ``least`` on."""
    best: dict[tuple[int, str], float] = {}
    joined = "".join(t.rstrip(".") for t in tokens)
    for f in forms:
        words, glued = list(f["words"]), f["glued"]
        score = soft_score(tokens, words, list(f["groups"]), list(f["idf"]), repaired)
        if abs(len(joined) - len(glued)) <= 3 and (len(tokens) != len(words) or score == 0):
            d = edits(joined, glued)
            if d <= max(1.0, 0.2 * len(glued)):
                score = max(score, 0.98 - d / max(len(glued), len(joined)))
        key = (f["ref_id"], f["kind"])
        if score >= least and score > best.get(key, 0):
            best[key] = score
    return sorted(((*key, round(s, 6)) for key, s in best.items()), key=lambda x: (-x[2], x[0]))


_STRINGS = ArrayType(StringType())
_keys_of_token = F.pandas_udf(lambda s: pd.Series([token_keys(t) for t in s]), _STRINGS)
_keys_of_word = F.pandas_udf(lambda w, t: pd.Series([word_keys(x, y) for x, y in zip(w, t)]), _STRINGS)
_likeness = F.pandas_udf(lambda a, b: pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64"), DoubleType())
_split = F.pandas_udf(lambda s: pd.Series([tokens_of(x) for x in s]), _STRINGS)
_form = F.pandas_udf(lambda s: pd.DataFrame([form_of(x) for x in s], columns=["words", "groups"]), StructType([StructField("words", _STRINGS), StructField("groups", ArrayType(IntegerType()))]))


def reference_forms(entries: DataFrame) -> DataFrame:
    """The forms of a reference list (ref_id, list_name, type, canonical_name, aliases): ``list_name``, ``form`` (struct of ref_id, kind,
    words, groups, glued, idf), once for each entry's name and aliases. Entries without id or name are left out."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    raw = entries.where("ref_id IS NOT NULL AND canonical_name <> ''").select("ref_id", "list_name", F.col("type").alias("kind"), F.explode(names).alias("text")).where("text IS NOT NULL")
    forms = raw.withColumn("f", _form("text")).where(F.size("f.words") > 0)
    forms = cut(forms.groupBy("ref_id", "list_name", "kind", F.col("f.words").alias("words")).agg(F.min("f.groups").alias("groups")))
    df = forms.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    weights = df.crossJoin(F.broadcast(forms.agg(F.count("*").alias("n")))).select("w", F.log(1 + F.col("n") / F.col("k")).alias("idf"))  # one row
    long = forms.select("*", F.posexplode("words").alias("j", "w")).join(weights, "w")
    full = long.groupBy("ref_id", "list_name", "kind", "words", "groups").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "idf"))), lambda z: z["idf"]).alias("idf"))
    return full.select("list_name", F.struct("ref_id", "kind", "words", "groups", F.array_join("words", "").alias("glued"), "idf").alias("form"))


def repair_tokens(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """``token``, ``words`` (array of word and likeness): every distinct ``token`` with the words of ``forms`` near it. Tokens and words
    meet on shared keys, in a join, and are verified by edit distance."""
    own = forms.select(F.explode("form.words").alias("word"), F.lit(True).alias("t")).unionByName(forms.select(F.col("form.glued").alias("word"), F.lit(False).alias("t"))).groupBy("word").agg(F.max("t").alias("t"))
    vocabulary = own.select("word", F.explode(_keys_of_word("word", "t")).alias("key"))
    near = tokens.select("token", F.explode(_keys_of_token("token")).alias("key")).join(vocabulary, "key").select("token", "word").distinct()
    return near.withColumn("s", _likeness("token", "word")).where("s > 0").groupBy("token").agg(F.collect_list(F.struct("word", "s")).alias("words"))


def map_values(values: DataFrame, forms: DataFrame, *, list_col: str, value_col: str) -> DataFrame:
    """Every distinct (``list_col``, ``value_col``) that isn't null or blank with ``ranked``, an array of (ref_id, kind, score), best
    first and empty where the list has no such entry. Spellings that differ in case, accents, marks or spaces only
    are ranked once. Values, tokens and entries meet in joins. Duplicates, an empty table and extra columns are fine; the extra columns aren't returned."""
    raw = values.select(F.col(list_col).alias("list_name"), F.col(value_col).alias("value")).where(_filled("value")).distinct()
    keyed = cut(raw.withColumn("tokens", _split("value")).withColumn("key", F.concat_ws(" ", "list_name", F.concat_ws(" ", "tokens"))))
    once = keyed.groupBy("key").agg(F.first("list_name").alias("list_name"), F.first("tokens").alias("tokens"))
    long = once.select("key", "list_name", F.explode(F.array_distinct("tokens")).alias("token"))
    found = cut(long.join(repair_tokens(long.select("token").distinct(), forms), "token"))
    by_word = forms.select("list_name", F.explode(F.array_distinct(F.concat("form.words", F.array("form.glued")))).alias("word"), "form")
    asked = found.select("key", "list_name", F.explode("words.word").alias("word")).distinct().join(by_word, ["list_name", "word"])
    asked = asked.groupBy("key").agg(F.collect_set("form").alias("forms"))
    found = found.groupBy("key").agg(F.collect_list(F.struct("token", "words")).alias("repaired"))  # a value's own tokens

    def ranks(tokens: pd.Series, repaired: pd.Series, forms: pd.Series) -> pd.Series:
        out = []
        for toks, rep, fs in zip(tokens, repaired, forms):
            by = {r["token"]: {w["word"]: w["s"] for w in r["words"]} for r in rep}
            out.append([{"ref_id": r, "kind": k, "score": s} for r, k, s in rank(list(toks), by, list(fs))])
        return pd.Series(out, dtype=object)

    ranked_type = "array<struct<ref_id:bigint,kind:string,score:double>>"
    ranked = once.join(found, "key").join(asked, "key").select("key", F.pandas_udf(ranks, ranked_type)("tokens", "repaired", "forms").alias("ranked"))
    return keyed.join(ranked, "key", "left").select("list_name", "value", F.coalesce("ranked", F.array().cast(ranked_type)).alias("ranked"))


def _filled(col: str):
    return F.col(col).isNotNull() & (F.trim(F.regexp_replace(col, r"\s+", " ")) != "")


def found_aliases(nodes: DataFrame, name_map: DataFrame, type_map: DataFrame, entries: DataFrame, *, least_rows: int = 4, least_share: float = 0.5) -> DataFrame:
    """The aliases that the list lacks: type spellings near no entry whose rows have names of one type. As further entries
    (ref_id, list_name, type, canonical_name, aliases) of the list. The lower 90 % bound of that type's share among the
    spelling's rows with a known name must exceed ``least_share``. Counted over all rows."""
    types = entries.where("list_name = 'type' AND ref_id IS NOT NULL").groupBy(F.col("canonical_name").alias("kind")).agg(F.min("ref_id").alias("ref_id"))
    names = name_map.select(F.col("value").alias("name"), F.explode(F.array_distinct("ranked.kind")).alias("kind"))
    open_types = type_map.where(F.size("ranked") == 0).select(F.col("value").alias("type"))
    votes = nodes.select("type", "name").groupBy("type", "name").count().join(open_types, "type").join(names, "name")
    votes = votes.groupBy("type", "kind").agg(F.sum("count").alias("n"))
    total = votes.groupBy("type").agg(F.sum("n").alias("total"), F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.max("n").alias("n"))
    p, n = F.col("n") / F.col("total"), F.col("total")
    z = 1.28
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    sure = total.where((n >= least_rows) & (low > least_share)).join(types, "kind")
    return sure.select("ref_id", F.lit("type").alias("list_name"), "kind", F.col("type").alias("canonical_name"), F.lit(None).cast("array<string>").alias("aliases")).withColumnRenamed("kind", "type")


def map_nodes(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """``node_id``, ``field_name``, ``value``, ``ref_id`` (0: the list has none), ``score``, ``literal`` for every name and type of
    ``nodes`` that isn't null or blank. Of entries of one name the row's own type decides; without one, the first.

    Type spellings near no entry are ranked again with the aliases found in the corpus (see ``found_aliases``)."""
    kind = F.when(F.col("list_name") == "type", F.col("canonical_name")).otherwise(F.col("type"))
    entries = canonical.select("ref_id", "list_name", kind.alias("type"), "canonical_name", "aliases")
    forms = cut(reference_forms(entries))
    fields = nodes.select(F.col("id").alias("node_id"), "type", "name")
    long = fields.select("node_id", "type", F.inline(F.array(F.struct(F.lit("name").alias("field_name"), F.col("name").alias("value")), F.struct(F.lit("type").alias("field_name"), F.col("type").alias("value"))))).where(_filled("value"))
    mapped = cut(map_values(long, forms, list_col="field_name", value_col="value"))
    type_map, name_map = mapped.where("list_name = 'type'"), mapped.where("list_name = 'name'")
    aliases = cut(reference_forms(found_aliases(nodes, name_map, type_map, entries)))
    again = map_values(type_map.where(F.size("ranked") == 0), aliases, list_col="list_name", value_col="value").where(F.size("ranked") > 0)
    types = type_map.join(again.select("value", F.col("ranked").alias("found")), "value", "left").select("list_name", "value", F.coalesce("found", "ranked").alias("ranked"))
    types = cut(types)
    own = types.where(F.size("ranked") > 0).select(F.col("value").alias("type"), F.get("ranked.kind", 0).alias("own_kind"))
    literal = entries.where("ref_id IS NOT NULL").select(F.col("list_name").alias("field_name"), F.col("canonical_name").alias("value"), F.lit(True).alias("literal")).distinct()
    known = name_map.unionByName(types).withColumnRenamed("list_name", "field_name").join(literal, ["field_name", "value"], "left")
    rows = long.join(known, ["field_name", "value"]).join(own, "type", "left")
    top = F.try_element_at("ranked.score", F.lit(1))
    ties = F.filter("ranked", lambda r: r["score"] >= top - 1e-9)
    fitting = F.filter(ties, lambda r: (F.col("field_name") == "name") & (r["kind"] == F.col("own_kind")))
    meant = F.coalesce(F.try_element_at(fitting, F.lit(1))["ref_id"], F.try_element_at("ranked.ref_id", F.lit(1)), F.lit(0))
    return rows.select("node_id", "field_name", "value", meant.cast("bigint").alias("ref_id"), F.coalesce(top, F.lit(0.0)).alias("score"), F.coalesce("literal", F.lit(False)).alias("literal"))
