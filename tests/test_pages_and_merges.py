"""Page numbers in two phases, keyed upserts, merged graphs, stacks by category."""

import collections
import random

from pyspark.sql import functions as F

from telar.operators import graph, ingest, tech
from telar.sources.files import settled
from telar.streaming import jobs


def test_page_numbers(spark):
    """One source with most pages, one with one page, one without a name; the plan has no window over a source's texts."""
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 900)
    rows = [("hot" if k < 700 else rng.choice(["a", "b", None]), i, f"text {i}") for k, i in enumerate(ids[:-1])] + [("single", ids[-1], "t")]
    df = spark.createDataFrame(rows, "source_file string, doc_id long, text string").repartition(5)
    got = {(r["source_file"], r["doc_id"]): (r["page_number"], r["text"]) for r in ingest.number_pages(df, "doc_id").collect()}
    by = collections.defaultdict(list)
    for s, i, _ in rows:
        by[s].append(i)
    assert got == {(s, i): (n, f"text {i}" if s != "single" else "t") for s, own in by.items() for n, i in enumerate(sorted(own), 1)}
    assert ingest.number_pages(df.limit(0), "doc_id").count() == 0


def test_page_limit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2), (None, 3)], "source_file string, page_number int")
    got = {(r["source_file"], r["page_number"]): r["accepted"] for r in ingest.limit_pages(df, 2).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("b", 1): True, (None, 1): False, (None, 2): False, (None, 3): False}


def test_upserts_can_be_replayed(spark, tmp_path):
    keep = jobs.upsert(str(tmp_path / "counts"))
    batches = [[("a", 2), ("b", 1)], [("a", 5)], [("c", 1), (None, 4)]]
    read = lambda: {r["source"]: r["chunks"] for r in jobs.latest(spark.read.parquet(str(tmp_path / "counts")), ["source"]).collect()}
    for k, b in enumerate(batches):
        keep(spark.createDataFrame(b, "source string, chunks long"), k)
    assert read() == {"a": 5, "b": 1, "c": 1, None: 4}
    keep(spark.createDataFrame(batches[1], "source string, chunks long"), 1)  # done again
    assert read() == {"a": 5, "b": 1, "c": 1, None: 4}


def test_counts_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"),) for _ in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.live_counts(stream), str(tmp_path / "out"), str(tmp_path / "mark"), "update")
    got = {r["source"]: r["chunks"] for r in jobs.latest(spark.read.parquet(str(tmp_path / "out")), ["source"]).collect()}
    assert got == collections.Counter(s for s, in rows)


TRIPLES = "graph_id int, seq int, subject string, subject_type string, relation string, object string, object_type string, confidence double"


def test_sections_merge_with_what_is_kept(spark):
    """Winners of sections, kept one by one, are those of all triples in order; the old triples aren't in the plan."""
    rng = random.Random(3)
    name = lambda: f"Node {rng.choice('abcd')}"
    sections = [[(rng.randrange(3), k, name(), rng.choice(["risk", "clause"]), rng.choice(["blocks", "requires"]), name(), "milestone", rng.random()) for k in range(25)] for _ in range(3)]
    tables = [spark.createDataFrame(s, TRIPLES) for s in sections]
    nodes, edges = (settled(f(tables[0])) for f in (graph.node_winners, graph.edge_winners))
    for k, t in enumerate(tables[1:], 1):
        nodes, edges = settled(graph.merged_nodes(nodes, graph.node_winners(t, k))), settled(graph.merged_edges(edges, graph.edge_winners(t, k)))
    whole = spark.createDataFrame([(g, 100 * k + s, *r) for k, rows in enumerate(sections) for g, s, *r in rows], TRIPLES)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(graph.shown_nodes(nodes)) == plain(graph.nodes(whole)) and plain(graph.shown_edges(edges)) == plain(graph.edges(whole))
    assert "Scan ExistingRDD" not in edges._jdf.queryExecution().toString()


def test_mermaid_of_an_empty_graph(spark):
    t = spark.createDataFrame([(1, 0, "A", "risk", "blocks", "B", "clause", 0.5)], TRIPLES)
    graphs = spark.createDataFrame([(1,), (2,), (2,)], "graph_id int")
    got = dict(map(tuple, graph.mermaid(graph.nodes(t), graph.edges(t), graphs=graphs).collect()))
    assert got == {1: 'graph TD\n    a[/"A"\\]\n    b["B"]\n    a -->|blocks| b', 2: "graph TD\n    empty[No nodes]"}
    assert graph.edges(t).select(graph.mermaid_edge().alias("e"), graph.mermaid_edge(F.lit("own")).alias("f")).first()[:] == ("a -->|BLOCKS| b", "a -->|own| b")


def test_stacks_by_category(spark):
    text = "El sistema debe usar Java 17.\nSe requiere PostgreSQL.\nProhibido MySQL en la entrega, evitar MySQL.\n"
    found = tech.entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"])
    got = {r["category"]: (r["names"], r["total"]) for r in tech.by_category(found, ["doc_id"]).collect()}
    assert got == {"language": (["Java"], 1), "database": (["PostgreSQL", "MySQL"], 2)}
