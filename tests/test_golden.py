"""Literal cases of the operators."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telar.functions.arrays import running_sums
from telar.functions.chunks import pack_paragraphs, split_recursively
from telar.functions.money import clean_currency, normalize_header
from telar.functions.text import chunk_id, normalize_line, page_numbers, table_to_markdown
from telar.operators import compliance, graph, ingest, nearest, retrieval, risk, tech, timeline


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_currency(spark):
    cases = {
        "$ 1.500,00": 1500, "1,500.00 USD": 1500, "(500)": -500, "€ 2.345,67": 2345.67, "1'234'567.89": 1234567.89, "-$1,234.56": -1234.56, "N/A": None, "-": None, "": None, "1.500": 1500,
        "1500.5": 1500.5, "1,234": 1234, "1.234.567": 1234567, "1,234,567.89": 1234567.89, "−7": -7, "s/d": None, "abc": None, None: None, "$-5": 5, "12,5": 12.5, "1,2,3": 123, ".": None}
    assert one(spark, [(k,) for k in cases], "v string", clean_currency(F.col("v"))) == list(cases.values())


def test_headers_and_lines(spark):
    assert one(spark, [("Precio Unitario ($)",), ("",), (None,), ("Año  __ x",)], "v string", normalize_header(F.col("v"))) == ["precio_unitario", "column", "column", "año_x"]
    lines = ["Page 1", "página 42", "5 de 10", "3/10", " 7 ", None, "Anexo 12/05/2024", "a   b"]
    assert one(spark, [(x,) for x in lines], "v string", normalize_line(F.col("v"))) == ["", "", "", "", "", "", "Anexo /2024", "a b"]


def test_page_ranges(spark):
    rows = [("5-10", 20), ("15", 20), ("1,3,5-7", 6), ("all", 3), ("x", 5), ("9-2", 20), ("0-2", 5), (None, 5), ("30", 9)]
    assert one(spark, rows, "s string, m int", page_numbers(F.col("s"), F.col("m"))) == [[5, 6, 7, 8, 9, 10], [15], [1, 3, 5, 6], [1, 2, 3], None, None, [1, 2], None, None]


def test_markdown(spark):
    rows = [([["H1", "H2"], ["a|b", None], ["x"], ["1", "2", "3"]],), ([],), (None,)]
    got = one(spark, rows, "r array<array<string>>", table_to_markdown(F.col("r")))
    assert got == ["| H1 | H2 |\n| --- | --- |\n| a\\|b |  |\n| x |  |\n| 1 | 2 |", "", ""]


def test_noise(spark):
    pages = [("d", i, f"Company Name\nContent page {i}\nbody {chr(97 + i)}bcdef") for i in range(5)] + [("e", 1, None), ("f", 1, "Company Name")]
    df = spark.createDataFrame(pages, "source_file string, page_number int, text string")
    noise = ingest.detect_noise(df)
    assert {tuple(r) for r in noise.collect()} == {("d", "Company Name"), ("d", "Content")}
    left = {(r["source_file"], r["page_number"]): r["text"] for r in ingest.remove_noise(df, noise).collect()}
    assert left[("d", 1)] == "body bbcdef" and left[("e", 1)] is None and left[("f", 1)] == "Company Name"


def test_chunks(spark):
    assert pack_paragraphs("a\n\nb\n\nc", 100) == ["a\n\nb\n\nc"]
    long = pack_paragraphs("This is a sentence. " * 20, 50)
    assert len(long) > 1 and all(len(c) < 100 for c in long) and pack_paragraphs(None, 5) == []
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "x. ", "\n\n", "longerword", "\n", "é! "]) for _ in range(rng.randrange(60)))
        flat = "".join(text.split())
        assert "".join("".join(pack_paragraphs(text, 30)).split()) == flat
        parts = split_recursively(text, 30, 8) if text else []
        assert all(len(p) <= 30 for p in parts)
        at = 0
        for p in parts:  # every piece stands in the text, in order
            at = text.find(p.split("\n\n")[0].split(" ")[0], 0)
            assert at >= 0
    got = spark.createDataFrame([("s", 1, "x" * 300)], "s string, p int, c string").select(chunk_id(F.col("s"), F.col("p"), F.col("c"))).first()[0]
    import hashlib

    assert got == hashlib.md5(f"s:1:{'x' * 100}".encode()).hexdigest()[:12]


@pytest.mark.parametrize("risks,score,rec", [
    ([("high", 0.9)], 86.5, "GO"), ([("low", 0.6), ("medium", 0.4)], 96.8, "GO"), ([("low", 0.2), ("critical", 1.0)], 0.0, "NO_GO"), ([("high", 0.9), ("medium", 0.7)], 83.0, "GO"), ([("high", 1.0)] * 3, 55.0, "REVIEW")])
def test_risk(spark, risks, score, rec):
    rows = [(1, i, f"risk {i}", "financial", s, p) for i, (s, p) in enumerate(risks)]
    df = spark.createDataFrame(rows, "tender_id long, seq long, description string, category string, severity string, probability double")
    out = risk.score_tenders(df)
    r = out.first()
    assert (r["total_score"], r["recommendation"]) == (score, rec)
    g = risk.gate(out).first()
    assert (g["risk_level"], g["gate_passed"]) == ({"GO": "low", "REVIEW": "high", "NO_GO": "critical"}[rec], rec != "NO_GO")


def test_rollup_of_nothing(spark):
    v = spark.createDataFrame([], "tender_id long, seq long, status string, severity string")
    r = compliance.roll_up(v, spark.createDataFrame([(1,)], "tender_id long")).first()
    assert r["overall_status"] == "compliant" and r["showstoppers"] == []


def test_verdicts(spark):
    replies = [("```json\n{\"status\": \"Partial\"}\n```", "debe"), ("so: {\"status\": \"compliant\", \"severity_detected\": \"desirable\"} end", "x"), ("broken", "may"), (None, "x")]
    df = spark.createDataFrame(replies, "reply string, requirement_text string")
    got = [(r["parsed"], r["status"], r["severity"]) for r in compliance.failed_verdicts(compliance.parse_verdicts(df)).collect()]
    assert got == [(True, "partial", "mandatory"), (True, "compliant", "desirable"), (False, "missing_info", "mandatory"), (False, "missing_info", "mandatory")]


def test_timeline(spark):
    text = "La propuesta debe entregarse 15/05/2024.\n30 días después de la adjudicación\nduración 12 meses\na los 5 días de la entrega\n15 de Marzo\n2 semanas antes de la entrega final\n10 días después de fecha de entrega"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = timeline.resolve(timeline.events(docs, F.lit("2024-04-01").cast("date")), "2024-04-01").collect()
    dates = {r["original"]: r["event_date"] for r in got}
    day = datetime.date
    assert dates["15/05/2024"] == day(2024, 5, 15) and dates["15 de Marzo"] == day(2025, 3, 15)
    assert dates["30 días después de la adjudicación"] == day(2024, 5, 1)
    assert dates["2 semanas antes de la entrega final"] is None
    assert dates["10 días después de fecha de entrega"] == day(2024, 5, 25)
    assert timeline.project_duration(timeline.durations(docs)).first()[:] == (1, 360, 12.0)


def test_tech(spark):
    docs = spark.createDataFrame([(1, "We require Python 3.11 and PostgreSQL database with React frontend."), (2, "Legacy system uses Java 8."), (3, None), (4, "asp.net y C#9, .NET")], "doc_id long, text string")
    got = {(r["doc_id"], r["name"]): (r["level"], r["version"]) for r in tech.entities(docs, ["doc_id"]).collect()}
    assert got[(1, "Python")] == ("mandatory", "3.11") and got[(2, "Java")] == ("forbidden", "8") and (1, "React") in got and (4, ".NET") in got and (4, "ASP.NET") in got
    assert len(tech.SURFACES) == 163


def test_cycles(spark):
    rng = np.random.default_rng(5)
    edges = [(g, f"n{a}", f"n{b}") for g in range(6) for a in range(6) for b in range(6) if rng.random() < 0.35]
    df = spark.createDataFrame(edges, "graph_id int, source string, target string")
    got = {(r["graph_id"], tuple(r["path"])) for r in graph.cycles(df, 5).collect()}
    want = set()
    have = set(edges)

    def walk(g, path):
        if (g, path[-1], path[0]) in have:
            want.add((g, tuple(path)))
        for b in range(6):
            n = f"n{b}"
            if len(path) < 5 and n > path[0] and n not in path and (g, path[-1], n) in have:
                walk(g, [*path, n])

    for g in range(6):
        for a in range(6):
            walk(g, [f"n{a}"])
    assert got == want


def test_cycles_of_any_length(spark):
    rng = np.random.default_rng(6)
    ring = [(0, f"n{a}", f"n{(a + 1) % 9}") for a in range(9)]
    have = {*ring, (1, "a", "b"), (2, "a", "a"), *((3, f"n{a}", f"n{b}") for a in range(8) for b in range(8) if rng.random() < 0.4)}
    want = set()

    def walk(g, path):
        for _, a, b in have:
            if (_, a) == (g, path[-1]) and b == path[0]:
                want.add((g, tuple(path), "high" if len(path) <= 3 else "medium"))
            elif (_, a) == (g, path[-1]) and b > path[0] and b not in path:
                walk(g, [*path, b])

    for g, a in {(g, a) for g, a, _ in have}:
        walk(g, [a])
    assert max(len(p) for g, p, _ in want if g == 3) > 6 and (0, tuple(f"n{k}" for k in range(9)), "medium") in want
    got = [(r["graph_id"], tuple(r["path"]), r["severity"]) for r in graph.cycles(spark.createDataFrame(sorted(have), "graph_id int, source string, target string")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_mmr_and_filters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = chunks.filter("id < 3").withColumnRenamed("id", "query_id")
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        s = x @ x[q]
        cand = sorted(range(60), key=lambda i: (-s[i], i))[:12]
        picked = []
        while len(picked) < 4:
            picked.append(max((c for c in cand if c not in picked), key=lambda c: round(0.5 * s[c] - 0.5 * max([x[c] @ x[p] for p in picked], default=0), 12)))
        got = [r["id"] for r in retrieval.mmr(chunks, queries).filter(F.col("query_id") == q).orderBy("rank").collect()]
        assert got == picked
    with pytest.raises(ValueError):
        retrieval.metadata_filter({"a": {"$near": 1}})


def test_grades(spark):
    df = spark.createDataFrame([(1, 5, "1:relevant\n2:not_relevant\n9:relevant\nx:relevant\n3:irrelevant")], "query_id long, n int, reply string")
    assert [(r["idx"], r["relevant"]) for r in retrieval.parse_grades(df).orderBy("line").collect()] == [(1, True), (2, False), (3, True)]


def test_files(spark, tmp_path):
    from telar.sources import files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"text")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    got = {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in ingest.check_files(files.read_manifest(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": None, "b.pdf": "no PDF header", "c.txt": "not a .pdf name"}


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(n, [rng.randrange(50) for _ in range(n)]) for n in (0, 1, 2, 3, 10, 99, 1000)] + [(-1, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "n int, x array<int>").select("n", running_sums(F.col("x"))).collect()}
    assert got == {n: x if x is None else np.cumsum(x).tolist() for n, x in rows}
    text = "java, " * 20_000
    got = spark.createDataFrame([(text,)], "text string").select(tech.hits(F.col("text"), tech.pattern()).alias("h")).first()["h"]
    assert [h["offset"] for h in got] == list(range(0, 120_000, 6))


@pytest.mark.parametrize("cluster_rows, cell, block", [(256, 4096, 2048), (20, 4096, 2048), (40, 7, 3)])
def test_top_k(spark, monkeypatch, cluster_rows, cell, block):
    monkeypatch.setattr(nearest, "CELL", cell)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 6)).astype(np.float32)  # many ties
    x[200:] = x[200]  # one vector in a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = chunks.filter("id % 20 = 0 OR id = 999").withColumnRenamed("id", "query_id")
    u = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300)
    for k in (7, 120):
        want = {(q, i, r) for q in range(0, 300, 20) for r, i in enumerate(sorted(range(300), key=lambda i: (-round(float(u[i] @ u[q]), 10), i))[:k], 1)}
        assert {(r["query_id"], r["id"], r["rank"]) for r in retrieval.top_k(chunks, asked, k, cluster_rows).collect()} == want
    assert retrieval.top_k(chunks, asked.limit(0)).count() == 0 and retrieval.top_k(chunks.limit(0), asked).count() == 0


def test_few_clusters_are_visited(spark):
    """Rows round 40 centres: a search visits few clusters, and finds what a full scan finds."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16))).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    asked = chunks.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    corpus = nearest.clustered(chunks, 20)
    report = nearest.visit_report(corpus, asked, 5).collect()
    assert len(report) == 40 and all(r["visited"] >= 1 for r in report) and np.mean([r["visited"] / r["clusters"] for r in report]) < 0.2
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(q, i) for q in range(0, 2000, 50) for i in sorted(range(2000), key=lambda i: (-round(float(u[i] @ u[q]), 12), i))[:5]}
    assert {(r["query_id"], r["id"]) for r in nearest.search(corpus, asked, 5).collect()} == want


def replayed(times, seconds):
    last, out = None, []
    for t in times:
        out.append(last is not None and t - last <= seconds)
        last = last if out[-1] else t
    return out


def test_replay_of_pauses(spark):
    rng = random.Random(4)
    times = sorted(rng.randrange(4000) for _ in range(300))
    rows = [("k", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), i) for i, t in enumerate(times)]
    out = retrieval.ttl_replay(spark.createDataFrame(rows, "question_key string, ts timestamp, seq long"), 30).collect()
    assert [r["hit"] for r in sorted(out, key=lambda r: r["seq"])] == replayed(times, 30)


def test_repeats_over_batches(spark, tmp_path):
    from telar.streaming import jobs

    rng = random.Random(9)
    times = sorted(rng.sample(range(100_000), 90))
    base = datetime.datetime(2024, 1, 1)
    for part in range(3):
        rows = [("k", base + datetime.timedelta(seconds=t)) for t in times[part * 30 : part * 30 + 30]]
        spark.createDataFrame(rows, "question_key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("question_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.drop_repeats(stream, 3600), str(tmp_path / "out"), str(tmp_path / "mark"))
    kept = sorted(r["ts"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [base + datetime.timedelta(seconds=t) for t, hit in zip(times, replayed(times, 3600)) if not hit]
