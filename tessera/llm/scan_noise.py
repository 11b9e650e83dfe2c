"""Text from scanned pages: running headers, page numbers, words broken at line ends and misread characters.

Headers are lines that repeat, give or take misread characters and numbers, at page edges of the corpus; page numbers
are recognised by their form. Broken words are joined and misread ones replaced by what the corpus's own vocabulary
knows. Both statistics cover all rows. Word counts stay in tables: every text gets by join what it needs of them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..session import cut
from .common import over_batches

_HYPHENS = "-‐¬­—"
# Words before page numbers.
_PAGE_WORDS = ("seite", "page", "página", "pagina", "pág.", "pag.", "p.", "s.", "folio", "blatt")
_OF = r"(?:von|of|de|di|sur|/)"
#: A line that holds a page number and nothing else. Words may have one misread letter; that is checked by page_line.
PAGE_LINE = (
    r"(?iu)^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\d{1,4}\]|\d{1,4}(?:\s*/\s*\d{1,4})?"
    r"|(\p{L}[\p{L}\d!]{2,6}|p\.|s\.|pág\.|pag\.)\s*\d{1,4}(?:\s*(?:von|of|de|di|sur|/)\s*\d{1,4})?)\s*$"
)
_PAGE_LINE = re.compile(PAGE_LINE.replace(r"[\p{L}\d!]", r"[^\W_!]|!").replace(r"\p{L}", r"[^\W\d_]").replace("(?iu)", "(?i)").replace("[^\\W_!]|!{2,6}", "(?:[^\\W_]|!){2,6}"))
_MARK = re.compile(r"\[PAGE_BREAK:\d+\]")
_AFTER_SUSPENDED = frozenset("und oder bzw sowie and or y o e ed et ou".split())

# Steps from a line to its signature, the same in Java and Python: (pattern, replacement).
_SIGNATURE = (
    (r"\s+", " "),
    (r"(?<![a-zà-ÿ])\d+(?![a-zà-ÿ])", "#"),
    (r"[1!|í]", "i"),
    ("0", "o"),
    ("5", "s"),
    ("6", "b"),
    ("[ée]", "c"),
    ("rn", "m"),
    ("[rl]i", "n"),
    ("[uhvü]", "n"),
    ("[il]", "i"),
    ("[ft]", "t"),
)


def signature(line: str) -> str:
    s = re.sub(r"\s{2,}\d{1,4}\s*$", "", line).strip().lower()
    for a, b in _SIGNATURE:
        s = re.sub(a, b, s)
    return s


def _signature_col(line: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(line, r"\s{2,}\d{1,4}\s*$", "")))
    for a, b in _SIGNATURE:
        s = F.regexp_replace(s, a, b)
    return s


def page_line(line: str) -> bool:
    """Whether the line is a page number: alone, between dashes, in brackets, or after a word for page."""
    m = _PAGE_LINE.match(line)
    if not m:
        return False
    word = (m[1] or "").lower()
    return not word or word in _PAGE_WORDS or any(len(word) == len(p) and sum(a != b for a, b in zip(word, p)) <= 1 for p in _PAGE_WORDS if len(p) > 3)


def may_be_header(line: str) -> bool:
    """A short line that starts like a title and doesn't end like a sentence or a broken word."""
    t = line.strip()
    return 5 <= len(t) <= 70 and t[0].isupper() and t[-1] not in ".!?,;:" + _HYPHENS and len(t.split()) >= 2


_LINES = r"\n|\[PAGE_BREAK:\d+\]"
#: A superset of the lines that may_be_header, but for rare blanks at their ends
_TITLE_JAVA = r"^\s*\p{Lu}.*[^.!?,;:\-‐¬­—\s]\s*$"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, _LINES), lambda x: F.trim(x) != "")


def _title(line: Column) -> Column:
    return (F.length(line) <= 76) & F.contains(F.trim(line), F.lit(" ")) & line.rlike(_TITLE_JAVA)


def header_signatures(texts: DataFrame, text_col: str, *, least_edges: int = 3, least_share: float = 0.4) -> DataFrame:
    """``s``: signatures of running headers, which are lines that stand at least ``least_edges`` times next to a page number
    (or carry one at their end), between different lines, and that in at least ``least_share`` of all their occurrences.
    Counted over all rows, in one aggregation."""
    is_page = lambda x: F.coalesce(x.rlike(PAGE_LINE), F.lit(False))
    rows = texts.select(_lines(F.col(text_col)).alias("l")).where(F.size("l") > 1)
    pages = rows.withColumn("p", F.transform("l", is_page))
    parts = F.transform("l", lambda x, i: F.struct(x.alias("x"), (F.coalesce(F.get("p", i - 1), F.lit(False)) | F.coalesce(F.get("p", i + 1), F.lit(False)) | x.rlike(r"\S\s{2,}\d{1,4}\s*$")).alias("e"), F.get("p", i).alias("p"), F.xxhash64(F.get("l", i - 1), F.get("l", i + 1)).alias("around")))
    got = pages.select(F.explode(parts).alias("z")).where(~F.col("z.p") & _title(F.col("z.x")))
    counted = got.groupBy(_signature_col(F.col("z.x")).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col("z.e").cast("int")).alias("edges"), F.approx_count_distinct(F.when(F.col("z.e"), F.col("z.around"))).alias("contexts"))
    return counted.where((F.col("contexts") >= least_edges) & (F.col("edges") >= least_edges) & (F.col("edges") >= least_share * F.col("n"))).select("s")


def _parts(s: Column, n: Column, shifts: tuple[int, ...] = (0,)) -> Column:
    """The thirds of a header of ``n`` characters, as keys: one of them is left whole by two edits. With ``shifts``, what may
    be these thirds in a line that is a few characters longer or shorter."""
    third = F.floor(n / 3).cast("int")
    part = lambda i, z: F.concat_ws("\t", F.lit(i), F.substr(s, F.greatest(F.lit(1), third * i + 1 + z), third if i < 2 else n - 2 * third))
    return F.array_distinct(F.array(*[part(i, z) for i in range(3) for z in shifts]))


def near_headers(met: DataFrame, headers: DataFrame) -> DataFrame:
    """The ``s`` of ``met`` of ten characters or more that are within two edits of a header (s) with the same first two characters. They
    meet in a join on beginning, length and an unchanged third."""
    begin = F.left("s", F.lit(2)).alias("b")
    known = headers.where(F.length("s") >= 8).select(F.col("s").alias("right"), begin, F.length("s").alias("n"))
    lengths = F.explode(F.sequence(F.length("s") - 2, F.length("s") + 2)).alias("n")
    some = met.where(F.length("s") >= 10).select("s", begin, lengths).join(known.select("b", "n").distinct(), ["b", "n"])
    keys = known.select("right", "b", "n", F.explode(_parts(F.col("right"), F.col("n"))).alias("k"))
    pairs = some.select("s", "b", "n", F.explode(_parts(F.col("s"), F.col("n"), (-2, -1, 0, 1, 2))).alias("k")).join(keys, ["b", "n", "k"])
    return pairs.where(F.levenshtein("s", "right", 2) >= 0).select("s").distinct()


def header_lines(texts: DataFrame, headers: DataFrame) -> DataFrame:
    """``_h``, ``s``: for every text (``_h``, ``_text``) the signatures of those of its lines that are headers of ``headers`` (s), or within
    two edits of one. By joins of distinct signatures."""
    own = texts.select("_h", F.explode(_lines(F.col("_text"))).alias("x")).where(_title(F.col("x"))).select("_h", _signature_col(F.col("x")).alias("s")).distinct()
    met = own.select("s").distinct()
    return own.join(met.join(headers, "s", "left_semi").unionByName(near_headers(met, headers)).distinct(), "s").select("_h", "s")


_WORD_JAVA = r"(?<![\p{L}\d])\p{L}+(?:[-'’]\p{L}+)*(?![\p{L}\d])"


#: Runs of all characters that words and tokens consist of or are judged by
_RUN_JAVA = r"[\p{L}\p{N}_!'’/.\-]+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_RUN_JAVA), F.lit(0))


def run_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``run`` (lower case), ``n``: every run of word characters with its count over all rows. Words and tokens are taken from the
    distinct runs, so the texts are gone through once."""
    return texts.select(F.explode(_runs(F.col(text_col))).alias("run")).where(F.col("run").rlike(r"\p{L}")).groupBy("run").agg(F.count("*").alias("n"))


def word_counts(runs: DataFrame) -> DataFrame:
    """``w``, ``n``: every word of the runs (run, n) with its count."""
    return runs.select(F.explode(F.regexp_extract_all("run", F.lit(_WORD_JAVA), F.lit(0))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))


_CLASSES = str.maketrans({"1": "i", "!": "i", "|": "i", "l": "i", "í": "i", "ì": "i", "0": "o", "ó": "o", "ò": "o", "5": "s", "6": "b", "8": "b", "ß": "b", "e": "c", "é": "c", "è": "c", "f": "t", "u": "n", "v": "n", "ú": "n", "ù": "n"})


def skeleton(word: str) -> str:
    """The word with letters that reading machines confuse made one."""
    s = word.lower().replace("rn", "m").replace("cl", "d").replace("li", "h").replace("ri", "n").replace("ii", "n").replace("ü", "n").replace("vv", "w")
    return s.translate(_CLASSES)


def plain(word: str) -> str:
    """Without accents: a word that differs only in these isn't misread but spelled or decoded otherwise."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def swapped(a: str, b: str) -> bool:
    """Whether a is b with two neighbouring letters swapped."""
    if len(a) != len(b):
        return False
    off = [i for i in range(len(a)) if a[i] != b[i]]
    return len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]


_TOKEN = re.compile(r"(?<![\w/\-!.])(?=[\w!]*[^\W\d_])[\w!]*[^\W\d_][\w!]*(?:['’][\w!]*\w)?(?![\w/\-\u0300-\u036f])")
_BROKEN = re.compile(rf"([^\W\d_](?:[\w!'’])*)[{_HYPHENS}][ \t]*$")
_NEXT = re.compile(r"^\s*([\w!'’]+)")


@dataclass
class Repairer:
    """Repairs texts with what ``knows`` was given of the corpus's headers and vocabulary."""

    def __post_init__(self) -> None:
        self.knows(())

    def knows(self, hints) -> None:
        """What the vocabulary says on the next text: see ``text_hints``."""
        parts = [h.split("\t") for h in hints]
        self.readings = {p[1]: p[2] for p in parts if p[0] == "r"}
        self.pairs = {(p[1], p[2]): tuple(map(int, p[3:])) for p in parts if p[0] == "j"}
        self.headers = {p[1] for p in parts if p[0] == "h"}

    def reading(self, token: str) -> str | None:
        """The word that a misread token stands for, None if it isn't misread."""
        out = self.readings.get(token.lower())
        return self._cased(token, out) if out else None

    @staticmethod
    def _cased(token: str, word: str) -> str:
        if token.isupper() and len(token) > 3:
            return word.upper()
        return word[0].upper() + word[1:] if token[0].isupper() else word

    def joined(self, head: str, sign: str, tail: str) -> str | None:
        """How ``head``, a hyphen at a line end and ``tail`` go together: in one word, with the hyphen, or (None) not."""
        a, b = head.lower(), tail.lower()
        if sign != "-":
            return head + tail
        one, two, near = self.pairs.get((a, b), (0, 0, 0))
        if b in _AFTER_SUSPENDED and one == 0:
            return None
        one = one or near * 0.5
        if two > one:
            return f"{head}-{tail}"
        if one == 0 and (tail[0].isupper() or tail[0].isdigit()):
            return f"{head}-{tail}"
        return head + tail

    def lines(self, text: str) -> tuple[list[str], int, int]:
        """The lines without page numbers, marks and headers, and how many headers and numbers went."""
        out, headers, pages = [], 0, 0
        for line in _MARK.sub("\n", text).split("\n"):
            if page_line(line):
                pages += 1
            elif self.headers and may_be_header(line) and signature(line) in self.headers:
                headers += 1
            else:
                out.append(line)
                continue
            # the gap that the removed line stood in isn't a paragraph's end
            if not out or out[-1] != "\x00":
                out.append("\x00")
        return out, headers, pages

    def repair(self, text: str) -> tuple[str, int, int, int, int]:
        """(running text, headers, page numbers, words joined, characters' words corrected)."""
        lines, headers, pages = self.lines(text)
        paragraphs: list[str] = []
        now, gap, joined = "", False, 0
        for i, line in enumerate(lines):
            if line == "\x00":
                gap = True
                continue
            if not line.strip():
                ended = not now or now.rstrip()[-1:] in ".!?:…”“»\"" or not (gap or _gap_ahead(lines, i))
                if ended and now:
                    paragraphs.append(now)
                    now = ""
                continue
            if now and (m := _BROKEN.search(now)) and (n := _NEXT.match(line)):
                sign = now.rstrip()[-1]
                got = self.joined(m[1], sign, n[1])
                if got is None:
                    now = now.rstrip() + " " + line.strip()
                else:
                    joined += "-" not in got[len(m[1]) : len(m[1]) + 1]
                    now = now[: m.start()] + got + line[n.end() :].rstrip()
            else:
                now = f"{now.rstrip()} {line.strip()}" if now else line.strip()
            gap = False
        if now:
            paragraphs.append(now)
        body = "\n\n".join(paragraphs)
        misread = {t: r for t in _TOKEN.findall(body) if (r := self.reading(t)) is not None} if self.readings else {}
        # short words that look like others aren't proof by themselves
        if not (headers or pages or joined) and not any(len(t) >= 5 or re.search(r"\w[\d!]|[\d!]\w", t) for t in misread):
            misread = {}
        fixed = 0
        if misread:

            def put(m: re.Match) -> str:
                nonlocal fixed
                fixed += m[0] in misread
                return misread.get(m[0], m[0])

            body = _TOKEN.sub(put, body)
        return body, headers, pages, joined, fixed


def _gap_ahead(lines: list[str], i: int) -> bool:
    while i < len(lines) and not lines[i].strip("\x00 \t\r"):
        if lines[i] == "\x00":
            return True
        i += 1
    return False


class Prober(Repairer):
    """Goes through a text as a repairer does, and notes what it will have to ask the vocabulary."""

    def ask(self, text: str) -> tuple[list[tuple[str, str]], list[str]]:
        """Pairs (head, tail) broken at a hyphen, and the tokens that joining them can make, all in lower case."""
        self.pairs_met, self.made, self.ends = set(), set(), []
        body = self.repair(text)[0] + " "
        self.made.update(set(_TOKEN.findall(body)).difference(_TOKEN.findall(_MARK.sub("\n", text) + " ")))
        return sorted(self.pairs_met), sorted({t.lower() for t in self.made})

    def joined(self, head: str, sign: str, tail: str) -> str:
        # a line of one broken word only: the head depends on how the word before it was joined
        heads = [head, *(e for e in self.ends if head != e and head.endswith(e.lstrip("_0123456789!'’")))]
        for h in heads:
            if sign == "-" and (letters := re.search(r"[^\W\d_].*", h)):
                self.pairs_met.add((letters[0].lower(), tail.lower()))
            self.made.update(_TOKEN.findall(f"{h}{tail} "))
        self.ends = [tail, *(h + tail for h in heads)]
        return head + tail


#: A superset of _TOKEN's matches, and with _variants also of what it matches at a text's end or before a stroke.
_TOKEN_JAVA = r"(?<![\p{L}\p{N}_/\-!.])[\p{L}\p{N}_!]+(?:['’][\p{L}\p{N}_!]+)?"
#: A line end after a hyphen
_BREAK_JAVA = rf"[{_HYPHENS}][\s\p{{Z}}\x85]*(?:\n|\[PAGE_BREAK:)"

#: A text with a line that may be a page number
_PAGE_ANYWHERE = r"(?:\A|\n|\[PAGE_BREAK:\d+\])" + PAGE_LINE.replace("(?iu)^", "(?iu)").removesuffix("$") + r"(?:\z|\n|\[PAGE_BREAK:)"


def _variants(t: Column) -> Column:
    """A token and its beginnings at which a match may end."""
    cuts = [F.regexp_replace(t, p, "") for p in (r"['’].*$", r"!+$", r"![^!]*$", r"!.*$")]
    return F.when(t.rlike("[!'’]"), F.array_distinct(F.array(t, *cuts))).otherwise(F.array(t))


def _askable(t: Column) -> Column:
    return (F.length(t) >= 3) & t.rlike(r"\p{L}") & ~t.rlike(r"\p{Nd}\p{Nd}|^\p{N}|!$")


@F.pandas_udf(StringType())
def _skeleton(words: pd.Series) -> pd.Series:
    return words.map(skeleton)


@F.pandas_udf(BooleanType())
def _misreadable(words: pd.Series, rights: pd.Series) -> pd.Series:
    letters = words.map(lambda w: sum(c.isalpha() for c in w))
    ok = [n >= 2 and n >= 0.5 * len(w) and not swapped(w, r) and plain(w) != plain(r) for w, r, n in zip(words, rights, letters)]
    return pd.Series(ok, index=words.index, dtype=bool)


def readings(tokens: DataFrame, counts: DataFrame, known: DataFrame, *, least_count: int, ratio: int = 20) -> DataFrame:
    """``w``, ``right``: the misread ones of the distinct ``tokens`` (w) with the word they stand for, which occurs ``ratio`` times as
    often as the token itself (five times that for short ones). Under ``least_count`` times, a token is no word of its own:
    misreadings come once or twice too."""
    met = tokens.withColumn("k", _skeleton("w")).join(known, "k").where("right != w").join(counts.select("w", F.when(F.col("n") >= least_count, F.col("n")).alias("own")), "w", "left")
    need = F.when(F.length("w") >= 5, ratio).otherwise(5 * ratio) * F.greatest(F.coalesce("own", F.lit(0)).cast("double"), F.lit(0.15))
    return met.where(F.col("right_n") >= need).where(_misreadable("w", "right")).select("w", "right")


def text_hints(texts: DataFrame, runs: DataFrame, counts: DataFrame, headers: DataFrame, *, least_count: int = 3, small: int = 200_000) -> DataFrame:
    """``_h``, ``_hints``: for every text (``_h``: its hash, ``_text``) that needs any, "h, signature" for its headers, "r, token, word" for its
    misread tokens and "j, head, tail, count joined, count with hyphen, count of the nearest word" for its broken words, tab-separated.

    All distinct lines and the tokens of all distinct ``runs`` of the texts are looked up in all of ``headers`` and ``counts`` by
    joins; a word is a reading from ``least_count`` on, however large the corpus is. ``small`` only says up to where the runs
    with a misread token are sent to the texts instead of shuffled with them."""
    lines = cut(header_lines(texts, headers))

    def probe(batches):
        tool = Prober()

        def one(b: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for t, x in zip(b["_text"].tolist(), b["x"].tolist()):
                tool.knows(() if x is None else x)
                rows.append(tool.ask(t))
            return pd.DataFrame({"_h": b["_h"], "pairs": [["\t".join(p) for p in r[0]] for r in rows], "made": [r[1] for r in rows]})

        yield from over_batches(one)(batches)

    of_text = lines.groupBy("_h").agg(F.collect_list(F.concat_ws("\t", F.lit("h"), "s")).alias("x"))  # a text's own lines
    broken = texts.where(F.col("_text").rlike(_BREAK_JAVA)).join(of_text, "_h", "left")
    broken = cut(broken.mapInPandas(probe, "_h string, pairs array<string>, made array<string>"))
    own = runs.select("run", F.explode(F.regexp_extract_all("run", F.lit(_TOKEN_JAVA), F.lit(0))).alias("t")).select("run", F.explode(_variants(F.col("t"))).alias("w")).where(_askable(F.col("w")))
    made = broken.select("_h", F.explode("made").alias("t")).select("_h", F.explode(_variants(F.col("t"))).alias("w")).where(_askable(F.col("w")))
    known = counts.where(F.col("n") >= least_count).groupBy(_skeleton("w").alias("k")).agg(F.max(F.struct("n", "w")).alias("b")).select("k", F.col("b.w").alias("right"), F.col("b.n").alias("right_n"))
    known = cut(known)
    found = cut(readings(own.select("w").unionByName(made.select("w")).distinct(), counts, known, least_count=least_count))
    hint = F.concat_ws("\t", F.lit("r"), "w", "right").alias("x")
    bad = cut(own.join(found, "w").select("run", hint).groupBy("run").agg(F.collect_set("x").alias("xs")))  # a run's own tokens
    bad = F.broadcast(bad) if bad.count() <= small else bad
    misread = texts.select("_h", F.explode(F.array_distinct(_runs(F.col("_text")))).alias("run")).join(bad, "run").select("_h", F.explode("xs").alias("x"))
    misread = misread.unionByName(made.join(found, "w").select("_h", hint))

    pairs = broken.select("_h", F.explode("pairs").alias("p"))
    both = pairs.select("p").distinct().withColumns({"one": F.regexp_replace("p", "\t", ""), "two": F.regexp_replace("p", "\t", "-")}).withColumn("k", _skeleton("one"))
    for c in ("one", "two"):
        both = both.join(counts.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    both = both.join(known, "k", "left").select("p", *(F.coalesce(c, F.lit(0)).cast("string").alias(c) for c in ("n_one", "n_two", "right_n")))
    broken_words = pairs.join(both, "p").select("_h", F.concat_ws("\t", F.lit("j"), "p", "n_one", "n_two", "right_n").alias("x"))
    headed = lines.select("_h", F.concat_ws("\t", F.lit("h"), "s").alias("x"))
    return misread.unionByName(broken_words).unionByName(headed).groupBy("_h").agg(F.collect_set("x").alias("_hints"))


def repair_scans(df: DataFrame, key_cols: list[str], text_col: str, *, corpus: DataFrame | None = None, least_count: int = 3) -> DataFrame:
    """Rows whose text shows scan noise, with the repaired running text: ``key_cols``, ``repaired``, ``n_headers``,
    ``n_page_numbers``, ``n_joined``, ``n_corrected``. Vocabulary and headers come from all rows of ``corpus`` (default: ``df``).

    Aggregations of words, tokens and line signatures, joins of distinct ones, and one join of the texts with their
    hints; texts that have neither hints nor what looks like a page number or a broken word stay in the JVM. Null, empty and clean texts give no row; equal rows come out alike; columns other than keys and text aren't
    returned; an empty table gives an empty result.
    """
    whole = corpus is None
    corpus = df if whole else corpus
    base = corpus.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    headers = cut(header_signatures(base, "_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key_cols).schema), "repaired string, n_headers int, n_page_numbers int, n_joined int, n_corrected int"])
    rows = df.select(*key_cols, F.col(text_col).alias("_text")).where(F.col("_text") != "").withColumn("_h", F.md5("_text"))
    runs = cut(run_counts(base, "_text"))
    own = runs if whole else cut(run_counts(rows, "_text"))
    hints = text_hints(rows.select("_h", "_text"), own, cut(word_counts(runs)), headers, least_count=least_count)

    def run(batches):
        tool = Repairer()

        def one(b: pd.DataFrame) -> pd.DataFrame:
            at, rows = [], []
            for i, (t, x) in enumerate(zip(b["_text"].tolist(), b["_hints"].tolist())):
                tool.knows(() if x is None else x)
                got = tool.repair(t)
                if any(got[1:]):
                    at.append(i)
                    rows.append(got)
            out = b[key_cols].iloc[at].reset_index(drop=True)
            for k, name in enumerate(("repaired", "n_headers", "n_page_numbers", "n_joined", "n_corrected")):
                out[name] = [r[k] for r in rows] if k == 0 else pd.array([r[k] for r in rows], dtype="int32")
            return out

        yield from over_batches(one)(batches)

    odd = F.col("_hints").isNotNull() | F.col("_text").rlike(_BREAK_JAVA) | F.col("_text").rlike(_PAGE_ANYWHERE)
    return rows.join(hints, "_h", "left").where(odd).drop("_h").mapInPandas(run, schema)
