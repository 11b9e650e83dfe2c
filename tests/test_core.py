import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.units import header_unit, numbers_of, parse_unit, pick_number, remark_units, split_cell
from tessera.operators import answers, chunking, dedup, graph, normalize, quantities, retrieval, rules, store, trust
from tessera.plans import knowledge
from tessera.sources import files
from tessera.streaming import pipelines

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "unit, quantity, factor, common",
    [("rpm", "speed", 1, True), ("min-1", "speed", 1, True), ("1/min", "speed", 1, True), ("U/min", "speed", 1, True), ("krpm", "speed", 1000, False), ("Hz", "speed", 60, False), ("rad/s", "speed", 9.549297, False),
     ("N·m", "torque", 1, True), ("N_m", "torque", 1, True), ("Newtonmeter", "torque", 1, True), ("mkg", "torque", 9.80665, False), ("kp·cm", "torque", 0.0980665, False), ("lb-in", "torque", 0.112985, False), ("ozf-in", "torque", 0.0070616, False),
     ("Grad Celsius", "temperature", 1, True), ("K", "temperature", 1, False), ("deg F", "temperature", 5 / 9, False), ("hPa", "pressure", 0.001, False), ("PS", "power", 0.735499, False), ("1/100 mm", "length", 0.01, False), ("thou", "length", 0.0254, False), ("oz", "mass", 0.0283495, False)],
)
def test_units(unit, quantity, factor, common):
    u = parse_unit(unit)
    assert u.quantity == quantity and u.factor == pytest.approx(factor, rel=1e-5) and u.common == common


def test_unit_texts():
    assert parse_unit("socket used") is None and parse_unit("") is None and parse_unit(None) is None
    assert header_unit("Torque, kgf·m").factor == pytest.approx(9.80665) and header_unit("Régime") is None
    assert list(remark_units("temps are Kelvin")) == ["temperature"] and remark_units("1/2 in socket used") == {} and "length" not in remark_units("repeat")
    assert split_cell("34.5 1/s") == ("34.5", "1/s") and split_cell("> 427,6 F") == ("427,6", "F") and split_cell("Step 6") is None and split_cell("—") is None
    assert numbers_of("1.234,5") == [1234.5] and numbers_of("1,234") == [1.234, 1234.0]
    assert pick_number("4,497", "speed", 1, 0) == 4497 and pick_number("1,35", "torque", 1, 0) == 1.35


DOCS = "parsed_id bigint, doc_id string, version int, text string, tables array<struct<name:string,rows:array<array<string>>,units:map<string,string>>>"
READ = "reading_id bigint, doc_id string, sheet string, parameter string, value_rpm string, torque_nm string, temperature_deg_c string, remark string"


def test_quantities(spark):
    docs = spark.createDataFrame(
        [(1, "d", 1, "", [("S", [["Item", "Speed [rps]", "Torque", "T [°C]"], ["a", "10", "2 kpm", "5"], ["b", None, "", "x"]], {"Torque": "kpm"})]), (2, "d", 2, None, [("S", [["Item", "Speed", "Torque"], ["a", "1", "2"]], {"Speed": "Hz"}), (None, [], None)]), (3, None, None, None, None)], DOCS
    )
    read = spark.createDataFrame(
        [(1, "d", "S", "p", "10", "1,5", "300 K", None), (2, None, "S", "p", "1500 rpm", "n/a", None, "Torque in cNm"), (3, "d", "S", "p", "~20 1/s", "250", "20", "Drehmoment: cNm"), (3, "d", "S", "p", "~20 1/s", "250", "20", "Drehmoment: cNm"), (4, None, None, None, None, None, None, None)], READ
    )
    got = {(r.reading_id, r.field_name): (r.value, r.converted) for r in quantities.sheet_values(read, docs).collect()}
    assert got[1, "value_rpm"] == (600.0, True)  # the newest version's header says Hz
    assert got[1, "torque_nm"] == (1.5, False) and got[1, "temperature_deg_c"][0] == pytest.approx(26.85)
    assert got[2, "value_rpm"] == (1500.0, False) and (2, "torque_nm") not in got
    assert got[3, "value_rpm"] == (1200.0, True) and got[3, "torque_nm"] == (2.5, True)
    assert quantities.sheet_values(read, docs).where("reading_id = 3").count() == 6
    tabs = {(r.parsed_id, r.t, r.r, r.c): (r.value, r.converted) for r in quantities.table_values(docs).collect()}
    assert tabs[1, 0, 1, 1] == (600.0, True) and tabs[1, 0, 1, 2][0] == pytest.approx(19.6133) and tabs[1, 0, 1, 3] == (5.0, False)
    none = docs.limit(0)
    assert quantities.table_values(none).count() == 0 and quantities.sheet_values(read.limit(0), none).count() == 0
    clash = docs.withColumn("value", F.lit(1)).withColumn("unit", F.lit("x")).withColumn("raw", F.lit(1))
    assert quantities.table_values(clash).count() == len(tabs)


def test_text_functions(spark):
    one = lambda c, **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in k.items())).select(c.alias("r")).first().r
    assert one(tx.clean_boilerplate(F.col("t")), t="a\n-----\n\n\n\nb  c") == "a\n\nb c"
    assert one(tx.topic_of(F.col("t")), t="What torque specs are available?") == "Drehmomente" and one(tx.topic_of(F.col("t")), t="nothing") is None
    assert one(tx.convert(F.col("v"), F.col("a"), F.col("b")), v=1.0, a="kW", b="hp") == 1.34102
    assert one(tx.convert(F.col("v"), F.col("a"), F.col("b")), v=100.0, a="°C", b="°F") == 212.0
    assert one(tx.convert(F.col("v"), F.col("a"), F.col("b")), v=5.0, a="rpm", b="rpm") == 5.0 and one(tx.convert(F.col("v"), F.col("a"), F.col("b")), v=5.0, a="kg", b="s") is None
    assert one(tx.route_of(F.col("t")), t="why does it misfire") == "kg_fast" and one(tx.route_of(F.col("t")), t="torque of bolts") == "spec_fast" and one(tx.route_of(F.col("t")), t=None or "hello") == "full_agent"
    assert one(tx.intent_of(F.col("t")), t="fix and repair and clean") == "diagnostic_fix"
    assert one(tx.slug(F.col("t")), t="Meßblatt 1.PDF") == "me_blatt_1.pdf" and one(tx.stem_slug(F.col("t")), t="Meßblatt 1.PDF") == "meßblatt_1"
    assert one(tx.fold_math(F.col("t")), t="𝜂ₑ₂ ≤ 𝐀²×3 für Größe") == "etae_2 ≤ A^2*3 für Größe" and one(tx.formula_spaces(F.col("t")), t="a=b*c") == "a = b * c"
    assert one(tx.strip_reasoning(F.col("t")), t="<think>x\ny</think> ok") == "ok" and one(tx.looks_like_raw_graph(F.col("t")), t="A --CAUSED_BY--> B")


def _chunks_of(text, size=700, overlap=100, reach=150):
    import re

    text, out = re.sub(r"\[PAGE_BREAK:\d+\]", "", text), []
    for pos in range(0, len(text), size - overlap):
        end = pos + size
        if m := re.search(r"(?s)\A(.*?(?:[.!?](?:\s|\Z)|\n\n))", text[end : end + reach]):
            end += len(m[1])
        piece = text[pos:end].strip(" \t\r\n\f\v")
        if piece:
            out.append((pos, piece))
    return out


def test_chunker(spark):
    texts = ["word " * 500, "", None, "A. " * 900, "x[PAGE_BREAK:2]" + "Sentence one. Two?\n\n" * 120, "y" * 5000, " \n "]
    got = chunking.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text").orderBy("id", "chunk_index").collect()
    for i, t in enumerate(texts):
        assert [(r.pos, r.content) for r in got if r.id == i] == (_chunks_of(t) if t else [])
    assert all(len(r.content) <= 850 for r in got) and {r.page for r in got if r.id == 4} == {1, 2}


def test_tables_and_facts(spark):
    rows = [["Parameter", "Value [rpm]", "Torque [Nm]", "Temperature [deg C]"], ["Max Power", "6500", "40", ""], ["Idle", "2000", None, "90"]]
    df = spark.createDataFrame([(1, "d", 1, "", [("sheet", rows, {"Value [rpm]": "rpm"})])], DOCS)
    facts = {r.key: (r.value, r.unit) for r in chunking.table_facts(df, ["parsed_id"]).collect()}
    assert facts == {"Max Power::Value [rpm]": ("6500", "rpm"), "Max Power::Torque [Nm]": ("40", None), "Idle::Value [rpm]": ("2000", "rpm"), "Idle::Temperature [deg C]": ("90", None)}
    assert chunking.chunk_tables(df, ["parsed_id"]).first().content == "[Table: sheet]\nParameter | Value [rpm] | Torque [Nm] | Temperature [deg C]\nMax Power | 6500 | 40 | \nIdle | 2000 |  | 90\nUnits: Value [rpm]=rpm"


def test_fusion_quality_topic(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 3, 2)], "qid int, id int, rank int")
    got = {r.id: r.score for r in retrieval.fuse([a, b]).collect()}
    assert got[1] == pytest.approx(2 / 61) and len(got) == 3 and got[2] == pytest.approx(1 / 62)
    hits = spark.createDataFrame([(1, 0.5, -0.8, 3), (2, 0.5, 0.5, 0), (3, 0.5, None, None), (4, 0.5, -999.0, 0)], "id int, score double, quality_score double, downvote_count int")
    assert {r.id: round(r.score, 6) for r in retrieval.adjust_quality(hits).collect()} == {2: 0.575, 3: 0.5}
    boosted = spark.createDataFrame([(1, 0.5, "x", "x"), (2, 0.51, "y", "x"), (3, 0.1, None, None)], "id int, score double, topic string, wanted_topic string")
    s = {r.id: r.score for r in retrieval.boost_topic(boosted).collect()}
    assert s[1] == pytest.approx(0.6) and s[1] > s[2] and s[3] == 0.1


def test_dedup_equals_going_through(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base + rng.normal(size=(40, 8)) * 0.15, base + rng.normal(size=(40, 8)) * 0.15])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = dedup.similar_pairs(df, "id", "v", least=0.97, cell_rows=20)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.97}
    kept = []
    for i in range(120):
        if not any(s[i, j] >= 0.97 for j in kept):
            kept.append(i)
    got = {r.id: (r.kept, r.kept_as) for r in dedup.greedy_keep(df.select("id"), pairs).collect()}
    assert [i for i in range(120) if got[i][0]] == kept and got[901] == (True, 901)
    assert all(got[i][1] == min(j for j in kept if s[i, j] >= 0.97) for i in range(120) if not got[i][0])


def test_graph(spark):
    nodes, edges = graph.seed_graph(spark)
    assert nodes.count() == 63 and edges.count() == 79
    paths = graph.diagnostic_paths(edges)
    assert paths.count() == 31 and paths.where("symptom = 'Misfire'").count() == 4
    df = spark.createDataFrame([(1, "Engine misfire may be caused by spark plug fouling. Clean or replace the spark plug."), (2, None), (3, "Nothing here.")], "id int, t string")
    got = {(r.src, r.relation, r.dst) for r in rules.rule_edges(df, ["id"], "t").collect()}
    assert ("Misfire", "CAUSED_BY", "Spark Plug Fouling") in got and ("Spark Plug Fouling", "FIXED_BY", "Clean Spark Plug") in got and ("Spark Plug Fouling", "FIXED_BY", "Replace Spark Plug") in got
    loop = spark.createDataFrame([("a", "x", "R", "a", "x", 1.0, "rule"), ("a", "x", "R", "b", "y", 1.0, "rule")], graph.EDGE)
    assert {(r.name, r.degree) for r in graph.degrees(loop).collect()} == {("x", 2), ("y", 1)}


def test_trust(spark):
    df = spark.createDataFrame([(1, "6500 rpm", "runs at 6500"), (2, "7000 rpm", "runs at 6500"), (3, "ratio 12.8", "12.8 to one"), (4, "", "x"), (5, None, None), (6, "no numbers", None)], "id int, d string, s string")
    assert [r.g for r in df.orderBy("id").select(trust.grounded(F.col("d"), F.col("s")).alias("g")).collect()] == [True, False, True, False, False, True]
    said = spark.createDataFrame([(1, "a", "The maximum limit is 220 °C."), (2, "b", "Maximum 210 °C limit."), (3, "c", "In 2013 on page 42 of 150 cycles"), (4, "d", None)], "id int, source string, t string")
    got = trust.conflicts(trust.measures(said, ["id", "source"], "t").withColumn("g", F.lit(1)), group="g", source="source", order=["id", "pos"]).collect()
    assert len(got) == 1 and got[0].spread == 10 and got[0].n_sources == 2


def test_conflicts_of_all_chunks(spark, tmp_path):
    rows = [(1, "a", "The maximum limit is 220 °C.", ("t1",)), (2, "b", "Maximum 210 °C limit.", ("t1",)), (3, "c", "Maximum 300 °C limit.", ("t2",)), (4, "c", "Rated pressure 3.5 bar.", ("t2",)), (5, "a", None, ("t2",)), (6, "d", "Rated pressure 4,1 bar.", ("t2",))]
    spark.createDataFrame(rows, "id long, doc_id string, content string, metadata struct<topic:string>").write.parquet(f"{tmp_path}/chunks.parquet")
    got = knowledge.Q["x19_conflicts"](spark, str(tmp_path)).collect()
    assert sorted((r.topic, r.unit, r.n_sources, r.low, r.high) for r in got) == [("t1", "°c", 2, 210, 220), ("t2", "bar", 2, 3.5, 4.1)]


def test_store_and_answers(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2)], "doc_id string, version int")
    new = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12)], "doc_id string, at int")
    assert sorted((r.doc_id, r.version) for r in store.register_versions(old, new, key="doc_id", order=["at"]).collect()) == [("a", 3), ("a", 4), ("b", 1)]
    hits = spark.createDataFrame([(1, 1, 7, "The pump is loud. The fuel pump leaks at the seal.", "f", 3)], "qid int, rank int, id int, content string, filename string, page int")
    asked = spark.createDataFrame([(1, "why does the fuel pump leak?")], "qid int, text string")
    assert answers.extract_answer(hits, asked, text_col="content").first().sentence == "The fuel pump leaks at the seal."
    assert answers.citations(hits).first().label == "f, p. 3"
    f = answers.formulas(spark.createDataFrame([(1, "eta = W_out / Q_in\nand \\frac{a}{b} here"), (2, None)], "id int, t string"), ["id"], "t")
    assert {r.is_latex for r in f.collect()} == {True, False}


def test_parsers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Item,Speed [rpm]\nx,5\n")
    (tmp_path / "b.url").write_text("[InternetShortcut]\nURL=https://example.org/x\n")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>H</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(buf.getvalue())
    got = {r.filename: r for r in files.parse_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"].tables[0].units == {"Speed [rpm]": "rpm"} and got["b.url"].text == "https://example.org/x"
    assert got["c.docx"].status == "parse_error" and got["d.pdf"].status == "needs_pdf_library" and got["e.docx"].text == "Hello" and got["e.docx"].tables[0].rows == [["H"]]
    assert {r.file_name for r in files.scan_files(spark, str(tmp_path)).collect()} == {"a.csv", "b.url", "c.docx", "d.pdf", "e.docx"}


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i % 7, t + datetime.timedelta(minutes=9 * i), "click", 1.0) for i in range(40)], "event_id int, ts timestamp, event_type string, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    q = pipelines.tumbling(pipelines.read_parquet_stream(spark, str(tmp_path / "ev"))).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, pipelines.tumbling(ev).collect()))
    spark.createDataFrame([(1, "Some text. " * 100)], "id int, text string").write.parquet(str(tmp_path / "docs"))
    seen = []
    q = pipelines.ingest_documents(pipelines.read_parquet_stream(spark, str(tmp_path / "docs")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp2"), key_cols=["id"], text_col="text")
    q.awaitTermination(120)
    assert len(seen) == 2


def test_entry_without_llm(spark):
    from tessera.plans import registry

    q, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    got = q["x9_hybrid"](spark, DATA)
    assert got.columns == ["qid", "rank", "id", "score"] and got.count() > 0


def test_plans_push_down(spark):
    from tessera.plans import registry

    plan = registry.queries()["f6_struct_path"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(metadata.topic)" in plan and "content" not in plan.split("ReadSchema")[-1]


def test_normalize(spark):
    from tessera.operators import normalize

    ents = spark.createDataFrame([("part", "Spark Plug", ["plug", "Zündkerze"]), ("symptom", "Overheating", []), ("cause", "Overheating", None)], "type string, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([(1, "part", " Zündkerze: "), (2, "x", "July 2013"), (3, None, "700°C"), (4, "cause", "overheating"), (5, None, "OVERHEATING"), (6, "part", ""), (7, "part", None), (8, "part", "reed block"), (9, None, "150 hours"), (10, None, "page 12")], "id int, type string, name string")
    got = {r.id: (r.canonical, r.node_type, r.reason) for r in normalize.normalize_entities(names, ents, key_cols=["id"], name_col="name", type_col="type").collect()}
    assert got[1] == ("Spark Plug", "part", "") and got[2][2] == "noise" and got[3] == ("700°C", "spec", "") and got[4][1] == "cause" and got[5][1] == "symptom"
    assert got[6][2] == got[7][2] == "empty" and got[8] == ("Reed block", "part", "") and got[9][1] == "spec" and got[10][2] == "noise"


def test_more_text_and_store(spark):
    df = spark.createDataFrame([("Why is the engine overheating?",), ("what is the wear",)], "q string")
    assert [r.s for r in df.select(tx.symptom_of(F.col("q")).alias("s")).collect()] == ["overheating", "wear"]
    v = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(tx.hash_embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and v[1].v is None and v[2].v is None
    fb = spark.createDataFrame([("q", "  a correction that is long enough  "), ("q", "short"), ("q", None)], "question string, correction string")
    assert store.corrections_as_chunks(fb).count() == 1
    log = spark.createDataFrame([("a", "x", False, 1), ("a", "x", True, 2), ("b", "y", False, 3)], "question string, reason string, resolved boolean, seq int")
    assert [r.question for r in store.open_gaps(log).collect()] == ["b"]
    rep = store.answer_report(spark.createDataFrame([(1, "q?", "a.")], "qid int, question string, answer string"), spark.createDataFrame([(1, 2, "g"), (1, 1, "f")], "qid int, no int, label string"))
    assert rep.first().report.endswith("[1] f\n[2] g")


def test_stated_rules(spark):
    table = "Symptom | Cause | Remedy\nRough Idle | Blocked Jet | Clean Carburetor\nhard starting | incorrect mixture | adjust mixture\nshort | row"
    rows = [(1, "Check the reed valve every 50 hours. Warning: the fuel pump gets hot."), (2, "The spark plug gap is 0,7 mm and the Rotax 582 gives 40 kW at 6500 rpm."), (3, table), (4, "Pressure is 5 bar. Nothing else."), (5, None), (6, ""), (7, "Overheating is caused by carbon buildup. Some words. Remedy: decarbonize exhaust."), (8, "Clean the filter."), (9, "The engine is caused by system.")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("src", F.lit("clash"))
    got = {(r.id, r.src_type, r.src, r.relation, r.dst_type, r.dst) for r in rules.rule_edges(df.drop("src"), ["id"], "t").collect()}
    assert (1, "part", "Reed Valve", "REQUIRES_PROCEDURE", "procedure", "Check reed valve") in got and (1, "procedure", "Check reed valve", "HAS_SPEC", "spec", "Every 50 hours") in got
    assert (1, "part", "Fuel Pump", "RELATED_TO", "warning", "Technical Warning") in got
    assert (2, "part", "Spark Plug", "HAS_SPEC", "spec", "0,7 mm") in got and (2, "engine", "Rotax 582", "HAS_SPEC", "spec", "6500 rpm") in got
    assert (3, "symptom", "Rough Idle", "CAUSED_BY", "cause", "Blocked Jet") in got and (3, "cause", "Blocked Jet", "FIXED_BY", "fix", "Clean Carburetor") in got and (3, "symptom", "Hard Starting", "CAUSED_BY", "cause", "Incorrect Mixture") in got
    assert (4, "spec", "5 bar", "MENTIONED_IN", "source", "Source Chunk") in got
    assert (7, "symptom", "Overheating", "CAUSED_BY", "cause", "Carbon Buildup") in got and (7, "cause", "Carbon Buildup", "FIXED_BY", "fix", "Decarbonize Exhaust") in got
    assert not any(g[0] in (5, 6, 9) or g[0] == 8 and g[3] == "FIXED_BY" for g in got)
    assert rules.rule_edges(df.drop("src").limit(0), ["id"], "t").count() == 0


def test_graph_view_and_paths(spark):
    n = spark.createDataFrame([("symptom", "Misfire", "a"), ("cause", "Weak Spark", "a"), ("fix", "Check Ignition", "b"), ("part", "Lonely", "a")], "type string, name string, doc_id string")
    e = spark.createDataFrame(
        [("symptom", "Misfire", "CAUSED_BY", "cause", "Weak Spark", "a", 1, 0.9, "rule", "t"), ("cause", "Weak Spark", "FIXED_BY", "fix", "Check Ignition", "b", 2, 0.3, "rule", None), ("cause", "Weak Spark", "FIXED_BY", "fix", "Gone", "a", 2, None, "rule", "t"), ("cause", "Weak Spark", "FIXED_BY", "fix", "Check Ignition", None, None, 0.1, "manual_seed", None)],
        "src_type string, src string, relation string, dst_type string, dst string, doc_id string, chunk int, confidence double, method string, topic string",
    )
    names = lambda df: {r.name for r in df.collect()}
    shown, edges = graph.graph_view(n, e)
    assert edges.count() == 2 and names(shown) == {"Misfire", "Weak Spark", "Check Ignition"}
    assert names(graph.graph_view(n, e, node_type="symptom")[0]) == {"Misfire"} and graph.graph_view(n, e, node_type="symptom")[1].count() == 0
    assert names(graph.graph_view(n, e, doc_id="a")[0]) == {"Misfire", "Weak Spark"} and names(graph.graph_view(n, e, topic="none")[0]) == set()
    assert graph.graph_view(n, e, include_seed=False, min_confidence=0.0)[1].count() == 2
    asked = spark.createDataFrame([(1, "Why does it misfire, weak spark?"), (2, "Hello"), (3, None)], "qid int, text string")
    got = graph.ranked_paths(graph.all_paths(e), asked).orderBy("qid", "rank").collect()
    assert {r.qid for r in got} == {1} and got[0].hits == 3 and got[0].confidence == 0.9 and got[-1].hits == 2 and any(r.path.startswith("Misfire --CAUSED_BY--> Weak Spark --FIXED_BY-->") for r in got)
    with pytest.raises(ValueError):
        graph.few(asked, 2)
    upper = spark.createDataFrame([("a", "x", "R", "b", "y", "d", 1)], "src_type string, src string, relation string, dst_type string, dst string, doc_id string, chunk int")
    key = F.concat_ws("|", "src", "dst", "doc_id")
    more = upper.unionByName(upper.withColumn("src", F.lit("z"))).unionByName(upper.withColumn("doc_id", F.lit(None)))
    assert graph.add_edges(upper, more, key, upper.columns).count() == 3


def test_names(spark):
    df = spark.createDataFrame([("July 2013",), ("2013",), ("12/03/2014",), ("1.2.3",), ("-5,3",), ("page 12",), ("p12",), ("kg",), ("x",), ("Table of Contents",), ("±5 mm",), ("M8x1,25",), ("2000 rpm",), ("K440 Twin",), ("Two-Stroke Engine",), ("clean jets",), (None,), ("",)], "n string")
    got = df.select("n", normalize.is_noise(F.col("n")).alias("noise"), normalize.is_spec(F.col("n")).alias("spec"), normalize.classify(F.col("n"), F.lit(""), F.lit(None).cast("string")).alias("kind")).collect()
    assert {r.n for r in got if r.noise} == {"July 2013", "2013", "12/03/2014", "1.2.3", "-5,3", "page 12", "p12", "kg", "x", "Table of Contents", None, ""}
    assert {r.n for r in got if r.spec} == {"±5 mm", "M8x1,25", "2000 rpm"}
    kinds = {r.n: r.kind for r in got}
    assert kinds["±5 mm"] == "spec" and kinds["K440 Twin"] == kinds["Two-Stroke Engine"] == "engine" and kinds["clean jets"] == "procedure" and kinds["kg"] == kinds[None] == "unknown"


def test_close_pairs_in_cells():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 6)) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, _ = dedup.close_pairs(x, 0.97, block=64)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.97, 1))
    assert sorted(zip(i, j)) == sorted(zip(a, b))


def test_copies_are_one_point(spark):
    rows = [(i, [1.0, 0.001 * (i % 2)]) for i in range(20)] + [(50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = dedup.similar_pairs(df, "id", "v")
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    got = {r.id: (r.kept, r.kept_as) for r in dedup.greedy_keep(df.select("id"), pairs, dedup.members(df, "id", "v")).collect()}
    assert {i for i in got if got[i][0]} == {0, 50, 51, 52} and all(got[i][1] == 0 for i in range(20))
    assert dedup.similar_pairs(df.limit(0), "id", "v").count() == 0


def _grouped(n, seed, groups=8, width=64):
    """Rows of length one around some centres, as wide within a group as passages of one topic are."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] * 0.0875 + rng.normal(size=(n, width)) * 0.095
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng


def test_close_pairs_cost_no_more_than_all_products():
    import time

    import numpy as np

    x, rng = _grouped(6000, 4)
    x = np.concatenate([x, x[:500] + rng.normal(size=(500, 64)) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    began, want = time.process_time(), set()
    for lo in range(0, len(x), 500):
        i, j = np.nonzero(x[lo : lo + 500] @ x.T >= 0.98)
        want |= {(a, b) for a, b in zip(i + lo, j) if a < b}
    direct, began = time.process_time() - began, time.process_time()
    i, j, _ = dedup.close_pairs(x, 0.98)
    took = time.process_time() - began
    assert set(zip(i, j)) == want and len(i) == len(want) >= 500
    assert took < 2.5 * direct  # cells around rows at random took 4 to 12 times as long


@pytest.mark.parametrize("kind, least", [("float", 0.98), ("double", 0.9), ("float", 0.3)])
def test_similar_pairs_across_cells_and_parts(spark, kind, least):
    import math

    import numpy as np

    x, rng = _grouped(500, 6, groups=3, width=16)
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, 16)) * 0.04]).astype(np.float32 if kind == "float" else np.float64)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    centres, expected = dedup._parting(np.unique(y, axis=0), 1e6, math.sqrt(2 - 2 * 0.98), 64)
    assert len(centres) > 1 and expected.sum() < 3e6
    df = spark.createDataFrame([(7 * i - 900, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None)], f"id bigint, v array<{kind}>")
    got = dedup.similar_pairs(df, "id", "v", least=least, cell_rows=30).collect()
    s = y @ y.T
    want = {(7 * i - 900, 7 * j - 900): s[i, j] for i, j in zip(*np.nonzero(np.triu(s >= least, 1)))}
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-6 for r in got)


def _rows_out(plan, name):
    """Rows that the nodes of this name gave, in a plan that ran."""
    kind = plan.nodeName()
    if kind == "AdaptiveSparkPlan":
        return _rows_out(plan.executedPlan(), name)
    if "QueryStage" in kind:
        return _rows_out(plan.plan(), name)
    own = plan.metrics().apply("pythonNumRowsReceived").value() if kind == name else 0
    return own + sum(_rows_out(plan.children().apply(i), name) for i in range(plan.children().size()))


def test_references_of_many_groups(spark):
    import numpy as np

    x, rng = _grouped(3000, 8)
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 64)) * 0.005])
    rows = [(i, [float(v) for v in r], [f"file {i % 3000 % 7}", f"page {i}"]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, refs array<string>")
    pairs = dedup.similar_pairs(df, "id", "v", cell_rows=1000)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, 3000 + i) for i in range(300)]
    assert len(x) <= _rows_out(pairs._jdf.queryExecution().executedPlan(), "MapInPandas") < 2 * len(x)  # not nearly every row to each cell
    merged = dedup.merge_refs(df.select("id", "refs"), dedup.greedy_keep(df.select("id"), pairs, dedup.members(df, "id", "v")), "refs")
    want = {i: [f"file {i % 7}", f"page {i}"] + [f"page {3000 + i}"] * (i < 300) for i in range(3000)}
    assert {r.id: r.refs for r in merged.collect()} == want


@pytest.mark.parametrize("block_pairs, most", [(1_000_000, 2), (40, 20)])
def test_long_chains_take_few_rounds(spark, monkeypatch, block_pairs, most):
    import random

    rng, cut, cuts = random.Random(9), dedup.cut, []
    chain = [(i, i + 1) for i in range(80)]
    some = {tuple(sorted(rng.sample(range(1000, 1060), 2))) for _ in range(120)} | {(5, 1001), (80, 1002)}
    monkeypatch.setattr(dedup, "cut", lambda df: cuts.append(1) or cut(df))
    pairs, ids = chain + sorted(some), [*range(82), *range(1000, 1062)]
    keep = dedup.greedy_keep(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(rng.sample(pairs, len(pairs)), "a bigint, b bigint"), **({} if block_pairs == 1_000_000 else {"block_pairs": block_pairs}))
    got, want = {r.id: (r.kept, r.kept_as) for r in keep.collect()}, {}
    for i in ids:
        owner = min((a for a, b in pairs if b == i and want[a][0]), default=None)
        want[i] = (owner is None, i if owner is None else owner)
    assert got == want and len(cuts) <= most  # one round for each row of the chain before


def test_enrichment_and_formulas(spark):
    text = "The report on transport says: Rotax 582 has a Main Jet and a fuel pump, 5 bar and 5 BAR at 20 °C. Endurance test by EASA; the jet was fine again and again."
    ents, tags = answers.entities(F.col("t"))
    r = spark.createDataFrame([(text,), ("short fuel pump",), (None,)], "t string").select(ents.alias("e"), tags.alias("g")).collect()
    assert [tuple(x) for x in r[0].e] == [("engine", "Rotax 582"), ("part", "main jet"), ("part", "fuel pump"), ("part", "jet"), ("spec", "5 bar"), ("spec", "20 °C")] and r[0].g == ["easa", "endurance", "test"]
    assert r[1].e == [] and r[2].e == [] and r[2].g == []
    t = "One. Two here. The rule:\neta = W_out / Q_in\nholds. Always so. Never else.\n\\frac{a}{b} again. Equation 4: work is force times way"
    f = {x.formula: x for x in answers.formulas(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string"), ["id"], "t").collect()}
    assert "eta = W_out / Q_in" in f and f["eta = W_out / Q_in"].context_before == "Two here. The rule:" and not f["eta = W_out / Q_in"].is_latex
    assert any(x.is_latex for x in f.values()) and any("force times way" in k for k in f)
    stored = spark.createDataFrame([(1, "eta = a / b", "x", "y", "t1"), (2, "b = 3", "about eta", "", "t2")], "id int, formula string, context_before string, context_after string, topic string")
    asked = spark.createDataFrame([(1, "what is the formula for eta?", None), (2, "eta", "t1")], "qid int, text string, topic string")
    assert [(x.qid, x.id) for x in answers.search_formulas(stored, asked).orderBy("qid", "rank").collect()] == [(1, 2), (1, 1), (2, 1)]


def test_grounded_by_number(spark):
    drafts = spark.createDataFrame([(1, "d", "at 6500 and 12.8"), (2, "d", "at 7000"), (3, "d", ""), (4, "e", "no numbers"), (5, None, "at 500"), (6, "f", "year 123")], "id int, doc_id string, t string")
    sources = spark.createDataFrame([("d", "runs at 6500"), ("d", "or 12.8"), ("d", None)], "doc_id string, s string")
    got = {r.id: r.grounded for r in trust.grounded_in(drafts, sources, key="id", doc="doc_id", draft_col="t", text_col="s").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_slides_and_page_readers(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f'<p:sld {ns}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr>{par("Cooling")}</p:sp><p:sp>{par("Some text on this slide")}</p:sp><a:tbl><a:tr><a:tc>{par("T [°C]")}</a:tc></a:tr><a:tr><a:tc>{par("90")}</a:tc></a:tr></a:tbl></p:sld>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {ns}>{par('These notes are long enough to be kept.')}</p:notes>")
    (tmp_path / "02_CAD").mkdir()
    (tmp_path / "02_CAD" / "s.pptx").write_bytes(buf.getvalue())
    (tmp_path / "x.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "y.png").write_bytes(b"pixels")
    readers = {"pdf": lambda data: data.decode().split("\x0c"), "png": lambda data: ["read"]}
    got = {r.filename: r for r in files.parse_files(spark, str(tmp_path), page_readers=readers, captioner=lambda data: "a pump").collect()}
    assert got["s.pptx"].text.split("\n")[:2] == ["Title: Cooling", "Some text on this slide"] and "Notes: These notes" in got["s.pptx"].text and got["s.pptx"].tables[0].rows == [["T [°C]"], ["90"]]
    assert got["x.pdf"].text == "[PAGE_BREAK:1]one\n[PAGE_BREAK:2]two" and got["y.png"].text.endswith("[Figure p.1/1]: a pump")
    inv = {r.file_name: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert inv["s.pptx"].topic == "CAD" and inv["x.pdf"].topic == "Unsorted" and inv["s.pptx"].category == "presentations" and files.scan_files(spark, str(tmp_path), most=2).count() == 2


def test_more_stores(spark):
    files_ = spark.createDataFrame([(i, True, 10, None) for i in range(6)] + [(10, False, 10, None), (11, True, 0, None), (12, True, 99_000_000, None), (13, True, 5, "ingested"), (14, None, None, None)], "id int, supported boolean, size_bytes bigint, status string")
    got = {r.id: (r.reason, r.selected) for r in store.select_files(files_, most=4).collect()}
    assert [i for i in got if got[i][1]] == [0, 1, 2, 3] and got[5] == ("over_max", False) and got[10][0] == got[14][0] == "unsupported" and got[11][0] == "missing_file" and got[12][0] == "too_large" and got[13][0] == "already_ingested"
    old = spark.createDataFrame([("s", 0, "user", "a")], "session_id string, turn int, role string, content string")
    new = spark.createDataFrame([("s", 5, "user", "c"), ("s", 4, "assistant", "b"), ("t", 1, "user", "x")], "session_id string, at int, role string, content string")
    assert sorted((r.session_id, r.turn, r.content) for r in store.append_turns(old, new).collect()) == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("t", 0, "x")]
    assert store.page_of(files_, [F.col("id")], limit=0, offset=-3).count() == 1
    parts = spark.createDataFrame([(1, 1, "Hi <thi"), (1, 2, "nk>secret"), (1, 3, " more</th"), (1, 4, "ink> there"), (1, 5, " a < b")], "s int, i int, d string")
    shown = [r.shown for r in pipelines.visible_parts(parts, session="s", order="i", delta="d").orderBy("i").collect()]
    assert "".join(shown) == "Hi  there a < b" and shown[0] == "Hi "


def test_routes(spark):
    from tessera.api import Store

    s = Store(spark, DATA)
    assert s.inventory(limit=5).count() == 5 and s.inventory_summary("topic").count() > 1 and s.select_for_ingest().count() == s.table("file_inventory").count()
    assert s.search(["fuel pump trouble"]).count() > 0 and s.ask(["Why is the fuel pump loud?"]).count() > 0 and s.cite(["fuel pump"]).count() > 0
    assert s.specs(limit=3).count() == 3 and s.specs("no such thing").count() == 0 and s.documents().count() > 1 and s.low_quality().count() > 0 and s.doc_debug().count() > 1
    assert s.entities().count() > 1 and s.chunk(1).count() == 1 and s.formula_summary().count() > 0 and s.formulas("").count() > 0
    nodes, edges = s.graph(min_confidence=0.5)
    assert nodes.count() > 10 and edges.count() > 10 and s.diagnostic_paths(["misfire and weak spark"]).count() == 5 and s.topics().count() > 1


def test_spec_lookup(spark):
    facts = spark.createDataFrame([("d", "Max", "Torque [Nm]", "Max::Torque [Nm]", "40"), ("fuel_book", "Idle", "Torque", "Idle::Torque", "3"), ("d", None, "T", "T", "9")], "doc_id string, row_label string, col_label string, key string, value string").withColumn("sheet", F.lit("s"))
    asked = spark.createDataFrame([(1, "TORQUE", None), (2, "torque", "fuel"), (3, "none", None)], "qid int, key string, engine string")
    got = sorted((r.qid, r.no, r.value) for r in store.spec_lookup(facts, asked, most=1).collect())
    assert got == [(1, 1, "3"), (2, 1, "3")] and store.spec_lookup(facts.limit(0), asked).count() == 0


def test_broken_optional_package_is_not_hidden(tmp_path, monkeypatch):
    import importlib.util
    import subprocess
    import sys

    code = "import sys, importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('tessera.llm') else f(n, *a); import __spark_entry__ as e; assert not any(k.startswith('p1_') for k in e.queries())"
    root = importlib.util.find_spec("tessera").submodule_search_locations[0].rsplit("/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


def test_small_inputs_are_spread(spark, tmp_path):
    from tessera.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() < 4 and spread(one.where("id > 3")).rdd.getNumPartitions() == 4
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped and spread(spark.range(3).coalesce(1)).count() == 3
    many = one.repartition(9)
    many.write.parquet(str(tmp_path / "many"))
    read = spark.read.option("mergeSchema", "false").parquet(str(tmp_path / "many"))
    assert read.rdd.getNumPartitions() < 4 or spread(read) is read
