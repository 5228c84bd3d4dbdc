"""Timelines of long documents and cycles of larger graphs against plain versions."""

import datetime
import random
import time

import pytest

from telar.operators import graph, timeline

DAY = datetime.date(2024, 4, 1)
SCHEMA = "doc_id long, seq int, original string, event_date date, confidence double, offset_days int, dependency string, is_relative boolean, description string"


def plain_resolve(rows):
    """The days of one document's rows, in order, by looking through all dated rows before."""
    dated, out = [], {}
    for seq, day, offset, dep, relative, text in sorted(rows, key=lambda r: r[0]):
        low = (dep or "").lower()
        if relative and low and offset is not None:
            first = DAY if any(w in low for w in timeline.ANCHOR_WORDS) else next((d for t, d in dated if low in t), None)
            day = first and first + datetime.timedelta(days=offset)
        out[seq] = day
        if day is not None:
            dated.append((text.lower(), day))
    return out


def test_chains_of_events(spark):
    rng = random.Random(3)
    names = ["Kickoff", "kick", "Entrega final", "final", "Obra", "a", "Firma del acta", "obra gruesa", "", None]
    rows = []
    for doc in range(60):
        for seq in range(rng.randrange(1, 25)):
            relative = rng.random() < 0.6
            day = None if relative and rng.random() < 0.8 else rng.choice([None, datetime.date(2024, 5, rng.randrange(1, 30))])
            text = f"{rng.choice(['Evento', 'FASE'])}: {rng.choice(names) or ''} {rng.choice(names) or ''}"
            rows.append((doc if doc else None, seq, "x", day, 0.8, rng.choice([None, 3, -7, 40]), rng.choice(names), relative, text))
    got = {(r["doc_id"], r["seq"]): r["event_date"] for r in timeline.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), str(DAY)).collect()}
    want = {}
    for doc in {r[0] for r in rows}:
        want |= {(doc, k): v for k, v in plain_resolve([(r[1], r[3], r[5], r[6], r[7], r[8]) for r in rows if r[0] == doc]).items()}
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_a_long_document(spark):
    """20,000 events of one document, each after the one before: resolved in order, in seconds."""
    n = 20_000
    rows = [(1, k, "x", DAY if k == 0 else None, 0.8, 1 if k % 50 else 0, f"hito {k - 1:05d}", k > 0, f"Evento: hito {k:05d}") for k in range(n)]
    began = time.time()
    got = timeline.resolve(spark.createDataFrame(rows, SCHEMA), str(DAY)).filter("event_date IS NOT NULL").count()
    assert got == n and time.time() - began < 20


def walked(edges, longest=None):
    after = {}
    for a, z in edges:
        after.setdefault(a, set()).add(z)
    out = set()

    def walk(path):
        for z in after.get(path[-1], ()):
            if z == path[0]:
                out.add(tuple(path))
            elif z > path[0] and z not in path and len(path) != longest:
                walk([*path, z])

    for a in after:
        walk([a])
    return out


@pytest.mark.parametrize("small", [50, 0])
def test_cycles_of_components(spark, small):
    """Within one task and by growing paths: the same cycles, with and without a longest length."""
    rng = random.Random(4)
    graphs = {g: {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(rng.randrange(1, 16))} for g in range(8)}
    df = spark.createDataFrame([(g, a, z) for g, e in graphs.items() for a, z in e], "graph_id int, source string, target string").repartition(3)
    for longest in (None, 1, 3):
        got = [(r["graph_id"], tuple(r["path"])) for r in graph.cycles(df, longest, small=small).collect()]
        want = {(g, p) for g, e in graphs.items() for p in walked(e, longest)}
        assert len(got) == len(want) and set(got) == want


def test_a_large_graph_without_cycles(spark):
    """200 nodes and very many walks, but no cycle: nothing is grown. A ring of 14 nodes is found by growing."""
    rng = random.Random(5)
    down = {(f"n{a:03d}", f"n{b:03d}") for a in range(200) for b in rng.sample(range(a + 1, 201), min(4, 200 - a))}
    ring = {(f"r{a:02d}", f"r{(a + 1) % 14:02d}") for a in range(14)}
    df = spark.createDataFrame([(1, a, z) for a, z in down] + [(2, a, z) for a, z in ring], "graph_id int, source string, target string")
    began = time.time()
    assert graph.cycles(df.filter("graph_id = 1")).count() == 0 and time.time() - began < 60
    assert [(r["graph_id"], len(r["path"])) for r in graph.cycles(df, small=10).collect()] == [(2, 14)]
