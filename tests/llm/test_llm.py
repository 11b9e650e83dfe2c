"""Small cases of every operator of the subpackage: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import encoding, entities, knn, language, mixing, packing, scan_noise, splitting, subjects, tokens
from tessera.llm.common import sentences

SMALL = "/root/testdata/sf0.001"


# --- 1 ---


def test_pieces(spark):
    texts = ["short", "", None, "para one. " * 60 + "\n\n" + "Second para. " * 80, "x" * 3000, "ä[PAGE_BREAK:3]" * 900, "word " * 20000, "short"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, t string, piece string")
    rows = splitting.split_items(df, ["id"], "t").orderBy("id", "piece_no").collect()
    by = {i: [r for r in rows if r.id == i] for i in range(len(texts))}
    assert [len(by[i]) for i in (0, 1, 2, 7)] == [1, 0, 0, 1] and by[0][0].piece == "short"
    for i in (3, 4, 5, 6):
        text, seen = texts[i].replace("[PAGE_BREAK:3]", ""), 0
        assert len(by[i]) == by[i][0].n_pieces > 1
        for r in by[i]:
            assert len(r.piece) <= 850 and text[r.start : r.start + len(r.piece)] == r.piece  # nothing changed
            assert r.start + r.repeated == seen and (r.piece_no == 0 or 50 <= r.repeated <= 100)
            seen += len(r.piece) - r.repeated
        assert seen == len(text)
    assert by[3][0].piece.rstrip().endswith(".") and all(p.piece.startswith("word") or p.piece.startswith(" ") for p in by[6])
    assert len(by[4][0].piece) == 850 and all(len(r.piece) == 850 for r in by[4][:-1])  # no boundary: full pieces
    odd = ["ab cd " * 20 + "y" * 700 + " " + "ef gh. " * 60, "one. " * 20 + "\n \n" + "two three " * 100, "x " * 10 + "\n\n" + "word " * 400]
    got = splitting.split_items(spark.createDataFrame(list(enumerate(odd)), "id int, t string"), ["id"], "t").orderBy("id", "piece_no").collect()
    first = {r.id: r.piece for r in got if r.piece_no == 0}
    assert first[0].startswith("ab cd " * 20 + "y" * 700 + " ") and first[1].endswith("\n \n") and first[2] == "x " * 10 + "\n\n"
    assert all(r.piece[-1:].isspace() or r.piece_no == r.n_pieces - 1 for r in got)  # no word cut where it needn't be
    whole = splitting.split_items(df, ["id"], "t", whole_when=F.col("id") == 4).where("id = 4").collect()
    assert len(whole) == 1 and len(whole[0].piece) == 3000
    assert splitting.split_items(df.limit(0), ["id"], "t").count() == 0


# --- 2 ---

CLEAN = {w: 5 for w in "für geprüft Größe après déjà más también città perché naïve façade Übersicht Prüfstand zurück hätte été où niño señal".split()}


def test_chains_invert():
    for word in ("Prüfstand", "après", "señal", "Größe"):
        for chain in encoding.CHAINS:
            g = encoding.garble(word, chain)
            if g and g != word and chain != ("lost",):
                back = encoding.invert(g, chain)
                if chain[-1] == "lower":
                    assert back is None or back.lower() == word.lower()
                else:
                    assert back == word, chain


def test_garbled(spark):
    model = encoding.fit_chain_model(CLEAN)
    tool = encoding.Restorer(model)
    assert tool.text("Der PrÃ¼fstand war geprÃ¼ft.")[:2] == (True, "Der Prüfstand war geprüft.")
    assert tool.text("Pr├╝fstand zur├╝ck")[:2] == (True, "Prüfstand zurück") and tool.text("dÃƒÂ©jÃƒÂ  vu")[0]
    assert tool.text("der Pr�fstand")[:2] == (True, None)
    for fine in ("São Bento, ÂGE, ½ Gas, Δp ≤ ¼ bar, Ø 3 mm ∞", "Завод «Искра»", "Prüfstand", "“the plug”, – 5 °C ±0,4", "plain", "└── zylinder"):
        assert tool.text(fine)[0] is False, fine
    df = spark.createDataFrame([(1, "fÃ¼r", None, "x"), (2, None, None, "x"), (3, "", "ok", "x"), (4, "für", "déjÃ\xa0", "x"), (1, "fÃ¼r", None, "x"), (5, "a" * 50000 + " zurÃ¼ck", None, "x")], "id int, a string, b string, restored string")
    got = encoding.find_garbled(df, ["id"], ["a", "b"], model=model).collect()
    assert sorted((r.id, r.field_name) for r in got) == [(1, "a"), (1, "a"), (4, "b"), (5, "a")] and {r.restored for r in got if r.id == 1} == {"für"}
    assert encoding.find_garbled(df.limit(0), ["id"], ["a", "b"]).count() == 0


def test_originals_are_looked_up_over_all_rows(spark):
    """An original outside the training words counts, and a garbled word isn't sound for occurring."""
    df = spark.createDataFrame([("Gehäuse",)] * 6 + [("Gehõuse",), ("Gehõuse",), ("größer",)], "t string")
    model = encoding.fit_chain_model(CLEAN)
    got = {r.w: (r.restored, r.chain) for r in encoding.judged_words(encoding.word_counts(df.unionByName(spark.createDataFrame([("σ",)] * 3 + [("å",), ("kürzer",)], "t string")), ["t"]), model).collect()}
    assert got == {"Gehõuse": ("Gehäuse", "cp1252>cp850")}  # a sign as frequent as a letter it might come from is itself
    found = encoding.find_garbled(df.withColumn("id", F.monotonically_increasing_id()).withColumn("w", F.lit("clash")), ["id"], ["t"], model=model).collect()
    assert [(r.garbled, r.restored) for r in found] == [("Gehõuse", "Gehäuse")] * 2
    model = encoding.replace(model, lexicon={"gehäuse": 6, "gehõuse": 2})
    p = np.full(len(encoding.CHAINS) + 1, 0.001)
    p[encoding.CHAINS.index(("cp1252", "cp850"))] = 0.9
    judge = encoding.Restorer(model).judge
    assert judge("Gehõuse", p)[:2] == (True, "Gehäuse") and judge("Gehäuse", p)[0] is False
    assert encoding.Restorer(encoding.replace(model, lexicon={"gehäuse": 6, "gehõuse": 4})).judge("Gehõuse", p)[0] is False


def test_classifier_held_out():
    rng = np.random.default_rng(2)
    words = sorted({f"{a}{c}{b}" for a in ("Pr", "ge", "ma", "lo") for c in "äöüßéèàñçóí" for b in ("fung", "ter", "no", "lle")})
    rng.shuffle(words)
    model = encoding.fit_chain_model({w: 1 for w in words[:100]})
    tool, hits, n = encoding.Restorer(model), 0, 0
    for w in words[100:]:
        for chain in encoding.CHAINS[:8]:
            g = encoding.garble(w, chain)
            if g and g != w:
                n += 1
                hits += tool.text(g)[1] == w
    assert hits / n > 0.9


# --- 3 ---


def test_scan_repair(spark):
    body = ["The spark plug was replaced and the engine ran well again.", "Nobody expected the pump to depend so strongly on the valve.", "The details were agreed on the phone after the second inspection."]
    rows = [(i, " ".join(body)) for i in range(40)]
    rows += [(100 + i, f"The spark plug was re-\nplaced and the\nTECHNICAL BULLETIN 12-B\n– {i} –\nengine ran we1l again. Nobody {'expccted' if i == 3 else 'expected'} the pump here.") for i in range(6)]
    rows += [(200, "A list:\n- nut M8\n- washer 12x5\nPart code: l0-I1-O0"), (201, "The spark plug was\nreplaced and the engine\nran well again."), (202, "Nobody exepcted the pump."), (203, None), (204, ""), (205, "Ein-\nund Ausbau"), (100, "The engine ran we1l again today\nPage 4 of 9\nand the pump.")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("repaired", F.lit("clash"))
    got = scan_noise.repair_scans(df, ["id"], "t").collect()
    assert {r.id for r in got} == {100, 101, 102, 103, 104, 105}
    r = next(r for r in got if r.id == 103)
    assert r.repaired == "The spark plug was replaced and the engine ran well again. Nobody expected the pump here." and (r.n_headers, r.n_page_numbers, r.n_joined) == (1, 1, 1) and r.n_corrected == 2
    assert scan_noise.repair_scans(df.limit(0), ["id"], "t").count() == 0
    assert [scan_noise.page_line(x) for x in ("Seite 3 von 9", "[12]", "12 / 30", "Se1te 4", "then 5 Nm", "358.", "[1] cf. note")] == [True, True, True, True, False, False, False]


def test_rare_words_of_a_large_corpus(spark):
    """Words under a millionth of the corpus are words too: as readings, as what they are, and joined."""
    filler = spark.range(80).select(F.col("id").cast("int").alias("id"), F.repeat(F.lit("The valve opens and the pump runs on. "), 12_500).alias("t"))  # 8 million words
    rows = [(1000 + i, f"The zwischenwelle turns {i}. Hans went home with an e-mailer.") for i in range(5)] + [(2000 + i, "Das Haus steht.") for i in range(60)]
    rows += [(1, "The zwischenwe1le turns.\n– 4 –\nHans went home by day."), (2, "He bought an e-\nmailer and more"), (3, "A zwischen-\nwe1le turns here.")]
    got = {r.id: r.repaired for r in scan_noise.repair_scans(filler.unionByName(spark.createDataFrame(rows, "id int, t string")), ["id"], "t").collect()}
    assert got == {1: "The zwischenwelle turns. Hans went home by day.", 3: "A zwischenwelle turns here."}


def test_headers_within_two_edits(spark):
    rng = np.random.default_rng(8)
    headers = ["technical bulletin # b", "maintcnancc manual kxx", "servicc", "abcdefgh", "short h"]
    lines = list(headers)
    for h in headers:
        for _ in range(30):
            v = list(h)
            for _ in range(int(rng.integers(1, 4))):
                i = int(rng.integers(0, len(v)))
                v[i : i + int(rng.integers(0, 2))] = ["z"] if rng.random() < 0.6 else []
            lines.append("".join(v))

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (old := row) is None else [i] + [min(old[j] + (x != y), old[j + 1] + 1) for j, y in enumerate(b)]
            for j in range(1, len(b) + 1):
                row[j] = min(row[j], row[j - 1] + 1)
        return row[-1]

    want = {s for s in lines if s in headers or (len(s) >= 10 and any(len(h) >= 8 and s[:2] == h[:2] and abs(len(s) - len(h)) <= 2 and far(s, h) <= 2 for h in headers))}
    sigs = spark.createDataFrame([(s,) for s in set(lines)], "s string")
    near = scan_noise.near_headers(sigs, spark.createDataFrame([(h,) for h in headers], "s string"))
    assert {r.s for r in near.collect()} | set(headers) & set(lines) == want


def test_hints_cover_chains_of_breaks():
    tool = scan_noise.Prober()
    pairs, made = tool.ask("the cyl-\nin-\nder ran")
    assert set(pairs) == {("cyl", "in"), ("cylin", "der"), ("in", "der")} and {"cylin", "cylinder", "inder"} <= set(made)


# --- 4 ---

LIST = [
    (1, "type", "part", "part", ["parts", "Bauteil"]), (4, "type", "symptom", "symptom", []), (5, "type", "cause", "cause", ["Ursache"]),
    (101, "name", "part", "Main Jet", ["Hauptdüse"]), (102, "name", "symptom", "Vapour Lock", ["vapor lock"]), (103, "name", "cause", "Vapour Lock", ["vapor lock"]), (104, "name", "part", "Big-End Bearing", []), (105, "name", "engine", "K-440 Twin", ["K440 Twin"]), (106, "name", "part", "Reed Cage", []), (107, "name", "part", "Tuned Pipe", []),
]


def test_mapping(spark):
    canon = spark.createDataFrame(LIST, "ref_id bigint, list_name string, type string, canonical_name string, aliases array<string>")
    names = ["Main Jet", "main  jte", "MAINJET", "Hauptduese", "Haup. Jet", "Jet, Main", "Main Jet assy", "Main Jet Spanner", "Big. Bearing", "K 440 TWIN", "Reed Cage Puller", "", None, "  ", "tbd", "Tuned Pipe no. 3", "Tuned Pine"]
    nodes = [(i, "part", n) for i, n in enumerate(names)] + [(50, "Symptom", "vapour lokc"), (51, "Ursache", "Vapor Lock"), (52, None, "Vapor Lock"), (53, "xx", "Main Jet"), (54, "prt", "x" * 5000), (0, "part", "Main Jet")]
    nodes += [(60 + i, "Teil", n) for i, n in enumerate(("Main Jet", "Reed Cage", "Tuned Pipe", "Big-End Bearing", "Main Jet", "Tuned Pipe"))]
    df = spark.createDataFrame(nodes, "id bigint, type string, name string").withColumn("ref_id", F.lit(9)).withColumn("score", F.lit("clash"))
    got = {(r.node_id, r.field_name): (r.ref_id, r.literal) for r in entities.map_nodes(df, canon).collect()}
    want = {0: 101, 1: 101, 2: 101, 3: 101, 5: 101, 6: 101, 7: 0, 8: 104, 9: 105, 10: 0, 14: 0, 15: 107, 16: 107}
    assert {i: got[i, "name"][0] for i in want} == want
    assert not any((i, "name") in got for i in (11, 12, 13)) and got[0, "name"][1] is True and got[1, "name"][1] is False
    assert got[50, "name"][0] == 102 and got[51, "name"][0] == 103 and got[52, "name"][0] in (102, 103)
    assert got[50, "type"][0] == 4 and got[51, "type"][0] == 5 and got[53, "type"][0] == 0 and got[54, "type"][0] == 1 and got[54, "name"][0] == 0
    assert got[60, "type"][0] == 1  # learned from the names
    assert entities.map_nodes(df, canon).where("node_id = 0 AND field_name = 'name'").count() == 2
    assert entities.map_nodes(df.limit(0), canon).count() == 0
    assert entities.map_nodes(df, canon.limit(0)).where("ref_id <> 0").count() == 0


def test_deletions_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        w = "".join(rng.choice(list("abcdefgh"), size=rng.integers(4, 9)))
        v = list(w)
        for _ in range(2):
            k = rng.integers(0, 3)
            i = int(rng.integers(0, len(v)))
            if k == 0 and len(v) > 4:
                del v[i]
            elif k == 1:
                v.insert(i, "z")
            else:
                v[i] = "z"
        assert set(entities.deletions(w)) & set(entities.deletions("".join(v)))
    for n in (16, 17, 18, 19, 25, 80, 300):  # short and long words meet under their keys
        for _ in range(60):
            w = "".join(rng.choice(list("abcdefghijklmnop"), size=n))
            v = list(w)
            for _ in range(2):
                i = int(rng.integers(0, len(v) - 1))
                kind = rng.integers(0, 4)
                if kind == 3:
                    v[i], v[i + 1] = v[i + 1], v[i]
                else:
                    v[i : i + int(rng.integers(0, 2))] = ["z"] if kind else []
            assert set(entities.word_keys(w)) & set(entities.token_keys("".join(v))), (w, "".join(v))


# --- 6 and 10 ---


def test_sentences():
    assert sentences("Report no. 528 is here. See Fig. 82.7 there. It is z. B. fine! Is it? Yes.") == ["Report no. 528 is here.", "See Fig. 82.7 there.", "It is z. B. fine!", "Is it?", "Yes."]
    assert sentences("") == [] and sentences(None) == [] and sentences("one\ntwo\n\nthree") == ["one two", "three"]
    assert sentences("Vor dem 25. Versuch wurde es geändert.") == ["Vor dem 25. Versuch wurde es geändert."]


def test_codewords():
    c = language.codewords(5)
    assert c.shape == (5, 15) and min((c[i] != c[j]).sum() for i in range(5) for j in range(i)) == 8


@pytest.fixture(scope="module")
def lang_model():
    rows = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    label = {n: k for k, names in language.LABELS.items() for n in names}
    rows["lang"] = rows["lang"].map(lambda x: label.get((x or "").lower()))
    rows = rows[rows["lang"].notna()]
    return language.fit_languages(rows.iloc[::2][["text", "lang"]]), rows.iloc[1::2]


def test_languages_held_out(lang_model):
    model, held = lang_model
    got = language.Labeller(model).texts(held["text"].tolist())
    right = [lab in {s[2] for s in stretches} for lab, stretches in zip(held["lang"], got) if stretches]
    assert sum(right) / len(right) > 0.9  # some labels are wrong by design


def test_language_rows(spark, lang_model):
    model, _ = lang_model
    de, en = "Der Motor läuft nach der Prüfung wieder ruhig. Die Pumpe war leider undicht und wurde getauscht. ", "The engine runs smoothly again after the test. The pump was leaking and has been replaced. "
    df = spark.createDataFrame([(1, de), (2, en + de), (3, None), (4, ""), (5, "123 456"), (6, en * 2000), (7, en.split(". ")[0] + ". " + de), (1, de)], "id int, t string").withColumn("confidence", F.lit("clash"))
    got = language.label_languages(df, ["id"], "t", model).collect()
    langs = lambda i: [r.segment_lang for r in got if r.id == i and r.counts]
    assert langs(1) == ["de", "de"] and langs(2) == ["en", "de"] and langs(3) == langs(4) == langs(5) == [] and set(langs(6)) == {"en"} and langs(7) == ["de"]
    assert all(0 <= r.confidence <= 1 for r in got)
    sure = language.label_languages(df.where("id = 2"), ["id"], "t", model, least_confidence=1.1).collect()
    assert [r.counts for r in sure].count(True) == 1  # only the main language counts by itself
    assert language.label_languages(df.limit(0), ["id"], "t", model).count() == 0
    labels = spark.createDataFrame([(x,) for x in ("EN", "en-GB", "Deutsch", " ", None, "n/a", "pt", "fr_CA")], "l string").select(language.normal_label(F.col("l")).alias("c"))
    assert [r.c for r in labels.collect()] == ["en", "en", "de", None, None, None, "pt", "fr"]


def test_subjects(spark):
    weak = pd.DataFrame([("The spark plug fires late. The coil is weak today. Please hand in comments soon.", "ignition"), ("The fuel pump leaks badly. The main jet is blocked again. Please hand in comments soon.", "fuel")] * 40, columns=["text", "subject"])
    known = pd.DataFrame([("The spark plug fires late. The fuel pump leaks badly.", ["ignition", "fuel"]), ("The coil is weak today.", ["ignition"]), ("Please hand in comments soon.", [])], columns=["text", "subjects"])
    model = subjects.fit_subjects(weak, known, ["ignition", "fuel"])
    df = spark.createDataFrame([(1, "The coil is weak today. The main jet is blocked again."), (2, "Please hand in comments soon."), (3, None), (4, ""), (5, "The spark plug fires late. " * 3000), (5, "The spark plug fires late. " * 3)], "id int, t string").withColumn("subject", F.lit("clash"))
    got = subjects.label_subjects(df, ["id"], "t", model).collect()
    assert sorted((r.id, r.subject) for r in got) == [(1, "fuel"), (1, "ignition"), (5, "ignition"), (5, "ignition")]
    assert subjects.label_subjects(df.limit(0), ["id"], "t", model).count() == 0
    assert subjects.weak_label(None, "Manual_fuel_01.pdf", ["fuel"]) == "fuel" and subjects.weak_label("Fuel ", "x", ["fuel"]) == "fuel" and subjects.weak_label("other", "fuel", ["fuel"]) is None
    assert subjects.fit_subjects(weak.iloc[:0], known.iloc[:0], ["a"]).shares([[["x", "y", "z"]]]).tolist() == [[0.0]]


# --- 7 ---


def test_graph_search():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = knn.build(x[:2500])
    assert [len(a) for a in g.links] == sorted((len(a) for a in g.links), reverse=True) and len(g.links) > 1 and all((a < len(a)).all() for a in g.links)
    exact = np.argsort(-(g.x @ g.x.T - 3 * np.eye(2500, dtype=np.float32)), axis=1)[:, :10]
    own, _ = g.search_own(10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(own, exact)]) > 0.97 and (own != np.arange(2500)[:, None]).all()
    got, _ = g.search(x[2500:], 10)
    exact = np.argsort(-(x[2500:] @ g.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, exact)]) > 0.95
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in g.links[0])  # no link twice
    for n in (0, 1, 2, 5):
        g = knn.build(x[:n])
        own, _ = g.search_own(10)
        assert own.shape == (n, 10) and all(set(r) - {-1} == set(range(n)) - {i} for i, r in enumerate(own)) and set(g.search(x[:1], 10)[0][0]) - {-1} == set(range(n))


def test_nested_centres():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = knn.fit_router(x, 4000, k=10, shard_rows=40, most_cells=10)
    assert len(r.centres) == 10 and len(r.residual) == 10
    row, shard, part, home = r.visits(x, np.arange(4000))
    assert (np.bincount(row[home]) == 1).all() and len(row) > 4000 and shard.max() < 100
    best = np.argsort(-(x @ x.T - 3 * np.eye(4000)), axis=1)[:, :10]
    own = np.full(4000, -1)
    own[row[home]] = shard[home]
    seen = [set() for _ in range(4000)]
    for i, s in zip(row, shard):
        seen[i].add(s)
    assert np.mean([own[j] in seen[i] for i in range(4000) for j in best[i]]) > 0.85


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    x[100:140] = x[0]  # copies, more than k
    x[140:143] = x[1] * 2.5  # the same direction
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [1.0] * 5, "x"), (903, [float("nan")] * 8, "x"), (904, [None] + [1.0] * 7, "x")]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, near string")
    got = {r.id: [(round(z.cosine, 5), z.id) for z in r.near] for r in knn.neighbours(df, "id", "v", dim=8, shard_rows=120, sample_rows=300).collect()}
    assert set(got) == set(range(700))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (n @ n.T).round(5)
    hits = sum(sum(c >= sorted(np.delete(s[i], i))[-10] - 1e-5 for c, _ in got[i]) for i in got)
    assert hits / 7000 > 0.95 and all(i not in [j for _, j in got[i]] and len(got[i]) == 10 for i in got)
    assert [j for _, j in got[120]] == [0, *range(100, 109)] and {j for c, j in got[1] if c == 1} == {140, 141, 142}
    assert knn.neighbours(df.limit(0), "id", "v", dim=8).count() == 0
    assert knn.neighbours(df.where("id < 1"), "id", "v", dim=8).first().near == []
    tenth = {r.id: r.tenth for r in knn.exact_tenth(df, "id", "v", F.col("id") % 100 == 0, dim=8).collect()}
    assert all(abs(tenth[i] - sorted(np.delete(s[i], i))[-10]) < 1e-4 for i in (200, 300))


# --- 8 ---


def _least(sizes, cap):
    """Fewest containers by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= sizes[i]
                go(i + 1, rooms)
                rooms[j] += sizes[i]
        rooms.append(cap - sizes[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cap = int(rng.integers(10, 40))
        sizes = rng.integers(1, cap + 1, size=int(rng.integers(1, 9))).tolist()
        fixed, rest = packing.reduce_by_dominance(sizes, cap)
        assert sorted([s for c in fixed for s in c] + rest) == sorted(sizes) and all(sum(c) <= cap for c in fixed)
        assert len(fixed) + _least(rest, cap) == _least(sizes, cap)


def test_packing(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(1, 900, size=3000))] + [(5000, 5000), (5001, 2048), (5002, 4096), (5003, 0), (5004, None), (7, 100)]
    df = spark.createDataFrame(rows, "id bigint, n int").withColumn("size", F.lit("clash"))
    got = packing.pack_items(df, "id", "n", group_items=800).toPandas()
    used = got.groupby("container_id")["size"].sum()
    assert used.max() <= 2048 and got["size"].sum() == sum(n or 0 for _, n in rows) and used.sum() / (2048 * len(used)) > 0.99
    assert got[got["id"] == 5000].sort_values("piece_no")[["first", "size"]].values.tolist() == [[0, 2048], [2048, 2048], [4096, 904]] and (got["id"] == 7).sum() == 2
    assert len(got[got["id"].between(0, 2999)]) == 3001 and not got["id"].isin([5003, 5004]).any()
    assert packing.pack_items(df.limit(0), "id", "n").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a b " * 40000), (5, "<|endoftext|>")], "id int, t string").withColumn("n_tokens", F.lit("clash"))
    got = {r.id: r.n_tokens for r in tokens.count_tokens(df, ["id"], "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 80000 and got[5] > 1


# --- 9 ---


def test_splitting_tree():
    q = np.array([100, 37, 3])
    leaves = mixing.split_quotas(q, 7, 1)
    assert leaves.sum(axis=0).tolist() == q.tolist() and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 1 + 2 and (leaves >= 0).all()
    assert mixing.split_quotas(np.zeros(0, np.int64), 3, 1).shape == (3, 0)


def test_mixing(spark):
    rows = [(i, "Big-Source " if i % 2 else "big_source", 10 + i % 7) for i in range(4000)] + [(10000 + i, "small", 20) for i in range(60)] + [(20000, None, 5), (20001, "stranger", 5), (20002, "small", None), (20003, "small", 0), (10001, "small", 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n int").withColumn("shard", F.lit("clash"))
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 4), ("nothing", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, targets, key_col="doc_id", source_col="source", size_col="n", shards=7, blocks=128)
    got, sh = drawn.toPandas(), {r.source: r for r in shares.collect()}
    assert abs(sh["small"].actual_share - 1 / 3) < 0.01 and abs(sh["big_source"].actual_share - 2 / 3) < 0.01 and sh["nothing"].drawn == 0 and sh["nothing"].target_share == 0.1
    assert sh["stranger"].target_share is None and sh["(none)"].available == 5 and sh["small"].most_copies == 4
    uses = got.groupby(["doc_id", "source"]).size()
    assert uses[uses.index.get_level_values(1) == "big_source"].max() == 1 and got[got["source"] == "small"].groupby(["doc_id", "copy_no"]).size().max() <= 2
    assert got["shard"].nunique() == 7 and all(sorted(g["position"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("shard"))
    again = mixing.mix(df, targets, key_col="doc_id", source_col="source", size_col="n", shards=7, blocks=128)[0].toPandas()
    assert set(map(tuple, again.values)) == set(map(tuple, got.values))
    none, empty = mixing.mix(df.limit(0), targets, key_col="doc_id", source_col="source", size_col="n")
    assert none.count() == 0 and {r.drawn for r in empty.collect()} == {0}
    fixed = mixing.mix(df, targets, key_col="doc_id", source_col="source", size_col="n", total=30000.0)[1]
    assert {r.source: r.drawn for r in fixed.collect()}["small"] <= 4 * 1220


# --- queries ---


def test_queries_have_the_columns_asked_for(spark):
    from tessera.llm import queries

    q = queries.queries()
    want = {"p1_found": ["source_table", "row_id"], "p2_found": ["source_table", "row_id", "field_name"], "p3_found": ["source_table", "row_id"], "p4_found": ["node_id", "field_name", "ref_id"], "p6_found": ["source_table", "row_id", "lang"], "p7_found": ["id_a", "id_b"], "p10_found": ["doc_id", "subject"]}
    for name, cols in want.items():
        df = q[name](spark, SMALL)
        assert df.columns == cols and df.count() == df.distinct().count() > 0, name
    assert set(queries.oracle_sql()) <= set(q)
