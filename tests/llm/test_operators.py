"""The training-data operators against brute force, on hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from cases import ITEMS, SCHEMA, SECRET, rows
from pyspark.sql import functions as F

from telar.llm import matching
from telar.llm import op1_token_counts as op1
from telar.llm import op2_license_scan as op2
from telar.llm import op3_secret_scan as op3
from telar.llm import op4_near_dedup as op4
from telar.llm import op5_quality_rules as op5
from telar.llm import op6_bpe_codec as op6
from telar.llm import op7_decontaminate as op7
from telar.llm import op8_language_id as op8
from telar.llm import op9_chat_format as op9
from telar.llm import op10_suffix_dedup as op10
from telar.llm.common import IdFilter, Scratch, drop_ids
from telar.llm.components import components

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_components(spark, scratch):
    rng = random.Random(5)
    path, star, last = range(0, 60), range(100, 160), range(200, 240)
    edges = [(i, i + 1) for i in path[:-1]] + [(100, i) for i in star] + [(239, i) for i in last] + [(i, i) for i in range(300, 303)]
    edges += [(rng.randrange(400, 520), rng.randrange(400, 520)) for _ in range(75)] + [(i, j) for i in range(600, 620) for j in range(600, 620)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::4]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b", scratch).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.label].add(r.node)
    want = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            want[root(a)] |= {a, b}
    assert len(got) == sum(map(len, groups.values())) and all(k in v for k, v in groups.items())
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b", scratch).count() == 0


def test_token_counts(docs, empty, library):
    want = collections.Counter()
    for i, t, *_ in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert bag(op1.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert op1.count_tokens(empty).count() == 0


def test_merging(library):
    c = op1.TokenCounter(limit=50)
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "'s", "1", ".", "日", "<|endoftext|>", "zz", " "]) for _ in range(rng.randrange(40)))
        assert c(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_codec(docs, empty, scratch, library):
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert bag(op6.encode_decode(docs, scratch, outputs=False), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    whole = op6.encode_decode(docs, scratch)
    assert all(r["decoded"] == t for r in whole.filter("doc_id = 13").collect() for i, t, *_ in ROWS if i == 13)
    assert op6.encode_decode(empty, scratch, outputs=False).count() == 0


def test_codec_joins(library):
    c = op6.Codec()
    rng = random.Random(2)
    for _ in range(60):
        t = " ".join(rng.choice(["alpha", "beta,", "gam\nma", "é", "it's", "", "12", "日本", "<|endoftext|>", "x" * 40]) for _ in range(rng.randrange(400)))
        data, start, cores = t.encode(), 0, {}
        for k, end in enumerate(op6.cuts(data)):
            a, z = op6.core(data[start:end])
            if z and rng.random() < 0.6:
                cores[k] = np.array(c.encode(data[start + a : start + z].decode()), np.int32)
            start = end
        assert c.with_cores(t, cores) == library.encode(t, add_special_tokens=False).ids


def test_codec_repairs(library, monkeypatch):
    """Cores cut anywhere, within words and beside white space: every wrong join is repaired, in short and in long texts."""
    monkeypatch.setattr(op6, "core", lambda data: (len(data) // 3, 2 * len(data) // 3) if len(data) > 9 and data.isascii() else (0, 0))
    c = op6.Codec()
    repaired, counted = c.repaired, []
    c.repaired = lambda *a: counted.append(1) or repaired(*a)
    rng = random.Random(6)
    for n in (40, 400, 4000):
        for words in (["alpha", "beta,", "gam\nma", "it's", "", "12", "x" * 40], ["x" * 3000, "don't", "  "], ["\n", " ", "1"]):
            t = " ".join(rng.choice(words) for _ in range(n))
            data, start, cores = t.encode(), 0, {}
            for k, end in enumerate(op6.cuts(data)):
                a, z = op6.core(data[start:end])
                if z and rng.random() < 0.5:
                    cores[k] = np.array(c.encode(data[start + a : start + z].decode()), np.int32)
                start = end
            assert c.with_cores(t, cores) == library.encode(t, add_special_tokens=False).ids
    assert counted


def spans_of(text):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(docs, empty, scratch):
    out = op3.scan_secrets(docs, scratch)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        s = spans_of(t or "")
        n = [sum(o == k for _, o, _ in s) for k in range(3)]
        want[(i, *n, sha(",".join(f"{op3.KINDS[o]}:{a}:{z}" for a, o, z in s)))] += 1
    assert bag(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    by = {r["doc_id"]: r for r in out.collect()}
    assert "owned:" in by[19]["spans"] and by[17]["n_copied"] > 0  # one owner holds the loose word, two hold the others
    red = op3.redact_secrets(docs, scratch)
    assert red.columns == docs.columns and red.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in red.collect()}
    assert texts[17] == "[SECRET]\" and [SECRET], token: xyz then [SECRET]" and texts[13] == ROWS[13][1] and texts[0] is None
    assert op3.scan_secrets(empty, scratch).count() == 0 and op3.redact_secrets(empty, scratch).count() == 0


def test_ownership(spark, scratch):
    value = "token=abcdefgh12345678"
    df = spark.createDataFrame([(i, f"{value} d{i}", f"o{i % 4}") for i in range(12)] + [(99, "token=zzzz9999yyyy", "o1")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in op3.scan_secrets(df, scratch).collect()}
    assert got[99] == (1, 0) and all(got[i] == (0, 1) for i in range(12))


def test_repositories(spark, scratch):
    """One owner's value in many repositories is an example, too."""
    rows = [(i, f"token=abcdefgh12345678 d{i}", "o") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, want in ((7, (1, 0)), (6, (0, 1))):
        assert {(r["n_live"], r["n_copied"]) for r in op3.scan_secrets(df, scratch, max_repos=most).collect()} == {want}


def test_very_many_secrets_in_a_text(spark, scratch):
    import time

    text = "".join(f"token={k:08d}é Zx9Qw8Er7Ty6Ui5Op4As{k:06d} " + "deadbeef" * 5 * (k % 5 == 0) + " " for k in range(100_000))
    df = spark.createDataFrame([(1, text, "s"), (2, None, "s")], "doc_id long, text string, source string")
    began = time.time()
    row = op3.scan_secrets(df, scratch).filter("doc_id = 1").first()
    want = spans_of(text)
    assert (row["n_assign"], row["n_hex"]) == (100_000, 20_000) and row["base_sha256"] == sha(",".join(f"{op3.KINDS[o]}:{a}:{z}" for a, o, z in want))
    owned = [(s["start"], s["end"]) for s in row["found"] if s["ord"] == 3]
    assert owned == [m.span() for m in re.finditer(r"[A-Za-z0-9_-]{20,}", text) if re.search("[A-Z]", m[0])]
    red = op3.redact_secrets(df, scratch).filter("doc_id = 1").first()["text"]
    every = sorted([(a, z) for a, _, z in want] + owned)
    out, at = [], 0
    for a, z in every:
        out += [text[at:a], "[SECRET]"]
        at = z
    assert red == "".join([*out, text[at:]])
    assert time.time() - began < 120


def sets_of(table, size=2):
    out = []
    for i, t, *_ in table:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((i, frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    return out


def groups(table, size=2):
    sets = sets_of(table, size)
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for j, (_, a) in enumerate(sets):
        for k, (_, b) in enumerate(sets[:j]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[root(j)] = root(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs, empty, scratch):
    cols = "doc_id", "n_shingles", "component_id", "kept"
    assert bag(op4.near_duplicates(docs, scratch), *cols) == groups(ROWS)
    assert op4.near_duplicates(empty, scratch).count() == 0
    kept = op4.keep_one(docs, scratch)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _, k in groups(ROWS) if k}


def test_near_duplicate_chains(spark, scratch, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 8)  # several blocks of one label and shared ones
    monkeypatch.setattr(matching, "SMALL", 10)
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    table = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        table.append((i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert bag(op4.near_duplicates(df, scratch), "doc_id", "n_shingles", "component_id", "kept") == groups(table)


def test_near_duplicates_write_few_files(spark, monkeypatch):
    files, scratch = [], Scratch(spark)
    monkeypatch.setattr(scratch, "write", lambda df, *a, f=scratch.write, **b: files.append(len((out := f(df, *a, **b)).inputFiles())) or out)
    hot = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(i, " ".join(f"w{i % 40}x{k}" for k in range(60)) + f" {i}") for i in range(80)], "doc_id long, text string")
        got = op4.near_duplicates(df, scratch).groupBy("component_id").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(i, 2) for i in range(40)]
    assert len(files) > 10 and max(files[1:]) <= 4, files  # the first is as the documents are split; partitions of small tables are merged


def test_near_duplicates_without_ids(spark, scratch):
    text = " ".join(f"w{k}" for k in range(60))
    near, near2, lone = text.replace("w9 ", "x "), text + " y", " ".join(f"v{k}" for k in range(50))
    table = [(5, text), (9, text), (None, text), (7, near), (None, lone), (None, lone + " z"), (None, "odd one"), (None, None), (3, None)]
    table += [(30, "a " + lone.replace("v", "q")), (None, lone.replace("v", "q")), (20, lone.replace("v", "q") + " a"), (None, near2)]
    n = {t: len(s) for (_, t), (_, s) in zip(table, sets_of(table))}
    want = {5: 5, 9: 5, 7: 5, 3: 3, 30: 20, 20: 20, text: 5, near2: 5, lone.replace("v", "q"): 20}
    df = spark.createDataFrame(table, "doc_id long, text string")
    rows = collections.Counter((i, n[t], want.get(t if i is None else i), i is None or want[i] == i) for i, t in table)
    assert bag(op4.near_duplicates(df, scratch), "doc_id", "n_shingles", "component_id", "kept") == rows
    assert sorted((r[0] or 0, r[1] or "") for r in op4.keep_one(df, scratch).collect()) == sorted((i or 0, t or "") for i, t in table if i not in (9, 7, 30))
    # only the row without an id ties the other two: each differs from it by less than from the other
    words = [f"u{k}" for k in range(60)]
    left, right = list(words), list(words)
    left[10] = left[20] = "l"
    right[40] = right[50] = "r"
    table = [(2, " ".join(left)), (1, " ".join(right)), (None, " ".join(words))]
    got = op4.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), scratch)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got.collect()} == {2: (1, False), 1: (1, True), None: (1, True)}


def test_ids_with_two_texts(spark, scratch):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    table = [(5, a), (5, b), (2, a + " z"), (3, b)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in op4.near_duplicates(df, scratch).collect())
    assert got == collections.Counter([(5, 2), (5, 3), (2, 2), (3, 3)])


def test_keep_one_loses_no_group(spark, scratch):
    """Ids repeated, null and with several texts: every set of shingles keeps a row or is linked with one that does."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    table = [(5, a), (6, a), (5, b), (2, b)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(map(tuple, op4.keep_one(df, scratch).collect())) == [(2, b), (5, a)]
    rng = random.Random(9)
    bases = [" ".join(f"{c}{rng.randrange(10**6)}" for k in range(40)) for c in "abcdefgh"]
    table = [(rng.choice([None, *range(12)]), rng.choice(bases) + rng.choice(["", " z", " y z"])) for _ in range(90)] + [(3, None), (4, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in op4.keep_one(df, scratch).collect()]
    group = lambda t: (t or "")[:8]
    assert {group(t) for _, t in kept} == {group(t) for _, t in table}
    for g in {group(t) for _, t in table} - {""}:
        own = [(i, t) for i, t in table if group(t) == g]
        least = min((i for i, _ in own if i is not None), default=None)
        assert sorted((x for x in kept if group(x[1]) == g), key=repr) == sorted((x for x in own if x[0] in (None, least)), key=repr)


def test_names_that_operators_use(spark, scratch):
    """Columns of any name come through the stages as they were."""
    a = " ".join(f"a{k}" for k in range(60))
    names = ["__key", "__maybe", "__slot", "__bucket", "__text", "__bits", "key", "maybe", "node", "id", "hits", "n_words"]
    table = [(1, a, "s"), (2, a + " z", "s"), (3, SECRET, "s")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in table], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    kept = op4.keep_one(df, scratch)
    assert kept.columns == df.columns and sorted(tuple(r)[3:] for r in kept.collect()) == [tuple(range(len(names)))] * 2
    red = op3.redact_secrets(df, scratch)
    assert red.columns == df.columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in red.collect())
    some = [n for n in names if n not in ("hits", "n_words")]
    items = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"), (2, "q r s")], "item_id long, text string")
    out = op7.decontaminate(df.select("doc_id", "text", *some), items, block_words=5, scratch=scratch).collect()
    assert [r["__key"] for r in out] == [0] * 3 and sum(len(r["hits"]) > 0 for r in out) == 2


def test_template_texts(spark, scratch, monkeypatch):
    """1,500 texts that share a template of 100 words and have 70 of their own: no links, few ties, no long work."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template = words(100)
    table = [(i, " ".join(template[:50] + words(70) + template[50:])) for i in range(1500)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    ties, pivoted = [], matching.pivoted
    monkeypatch.setattr(matching, "pivoted", lambda *a: (ties.append(x := pivoted(*a)), x)[1])
    assert op4.near_duplicates(df, scratch).filter("component_id <> doc_id").count() == 0
    assert ties[0][0].count() < 1000


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    got = matching.intersections(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_quality(spark, docs, empty, scratch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    out = op5.assess(docs, labels, scratch)
    want = collections.Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert bag(out, "doc_id", *op5.STATS[:5], "base_failed") == want
    assert out.filter("kept AND base_failed").count() == 0
    assert op5.assess(empty, labels, scratch).count() == 0 and op5.assess(docs, labels.limit(0), scratch).count() == len(ROWS)


def test_forest_finds_odd_rows():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (400, 4)), np.full((4, 4), 9.0)])
    s = op5.IsolationForest(x).score(x)
    assert s[400:].min() > np.quantile(s[:400], 0.99)


def path_length(tree, row):
    feature, cut, child, length = tree
    at = 0
    while feature[at] >= 0:
        at = child[at] + int(row[feature[at]] >= cut[at])
    return length[at]


def test_verdicts_by_brute_force(spark, scratch):
    """Scores from path lengths walked one by one, the threshold by trying every bin, and the verdict, for few and for many labelled rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    table = [(i, " ".join(word() + rng.choice(["", ",", ".", "#$%" * (i % 11 == 0)]) for _ in range(70))) for i in range(80)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    stats = {i: op5.statistics(t) for i, t in table}
    for n in (0, 1, 2, 15, 16, 17, 80):
        marks = {i: int(i % 11 > 0) for i in range(n)}
        labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
        got = {r["doc_id"]: r for r in op5.assess(df, labels, scratch, clean_loss=0.05).collect()}
        fine = [i for i, s in stats.items() if not (s[0] < 50 or 100 * s[4] > 50 * s[0])]
        used = [i for i in fine if i in marks] or fine
        if n > 2 or not n:
            assert len({round(r["anomaly"], 9) for r in got.values()}) > 1
        else:
            assert {r["anomaly"] for r in got.values()} == {0.5}
        good, bad = ([int(got[i]["anomaly"] * 2000) for i in fine if marks.get(i) == q] for q in (1, 0))
        limits = [b for b in range(2001) if b in bad and good and sum(g >= b for g in good) <= 0.05 * len(good)]
        limit = min(limits) / 2000 if limits else 1.01
        assert all(r["kept"] == (i in fine and r["anomaly"] < limit) for i, r in got.items()), n
        assert len(used) >= min(n, 1)
    x = op5.features(np.array(list(stats.values())))
    forest = op5.IsolationForest(x)
    mean = [np.mean([path_length(t, row) for t in forest.trees]) for row in x]
    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    assert np.allclose(forest.score(x), 2.0 ** (-np.array(mean) / c))


def test_quality_separates(spark, sf_dir, scratch):
    d, labels = (spark.read.parquet(f"{sf_dir.rsplit('sf', 1)[0]}sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = op5.assess(d, labels, scratch).join(labels, "doc_id")
    r = j.agg(F.avg(F.when((F.col("quality") == 1) & ~F.col("base_failed"), F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert r[0] >= 0.99 and r[1] <= 0.1


def contaminated(table, items, window=10):
    word = lambda t: op7.WORD.findall(op7.fold(t or ""))
    found = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            found[tuple(w[k : k + n])].add(i)
    out = collections.Counter()
    for i, t, *_ in table:
        w, hit, own = word(t), set(), set()
        for n in {len(p) for p in found}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in found:
                    hit.update(range(k, k + n))
                    own |= found[p]
        out[(i, len(w), len(hit), ",".join(sorted(map(str, own))))] += 1
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 10])
def test_decontamination(spark, docs, empty, scratch, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = op7.decontaminate(docs, items, block_words=block_words, scratch=scratch)
    got = out.select("doc_id", "n_words", F.aggregate("hits", F.lit(0), lambda a, s: a + s["z"] - s["a"]).alias("n"), F.array_join(F.array_sort("items"), ",").alias("i"), "text", "cuts")
    assert bag(got, "doc_id", "n_words", "n", "i") == contaminated(ROWS, ITEMS)
    cut = next(r for r in got.collect() if r["doc_id"] == 21)
    assert [cut["text"][s["a"] : s["z"]] for s in cut["cuts"]] == ["the item has twelve words of which ten in a row must match exactly"]
    assert op7.decontaminate(empty, items, block_words=block_words, scratch=scratch).count() == 0
    assert op7.decontaminate(docs, items.limit(0), scratch=scratch).filter(F.size("hits") > 0).count() == 0
    twice = op7.decontaminate(docs, items.unionByName(items), block_words=block_words, scratch=scratch)
    line = F.array_join(F.array_sort("items"), ",")
    assert bag(twice.withColumn("items", line), "doc_id", "items") == bag(out.withColumn("items", line), "doc_id", "items")


def test_fm_index():
    rng = np.random.default_rng(4)
    for _ in range(20):
        runs = [rng.integers(1, 5, rng.integers(1, 60)) for _ in range(6)]
        index = op7.FMIndex(runs, 4, sample=3)
        phrases = rng.integers(1, 5, (30, 3))
        lo, hi = index.search(phrases)
        for p, a, z in zip(phrases, lo, hi):
            want = sorted(int(index.starts[r]) + k for r, run in enumerate(runs) for k in range(len(run) - 2) if (run[k : k + 3] == p).all())
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_language(spark, docs, empty, sf_dir):
    d = spark.read.parquet(f"{sf_dir.rsplit('sf', 1)[0]}sf0.01/documents.parquet")
    out = op8.identify(d).filter(op8.fold_of("doc_id") == 1)
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count()
    got = {r["doc_id"]: r["lang_pred"] for r in op8.identify(docs).collect()}
    assert got[0] == got[1] == got[22] == "und" and got[7] in ("en", "fr")
    assert op8.identify(empty).count() == 0
    r = op8.identify(docs.withColumn("lang", F.lit(None).cast("string"))).agg(F.max("lang_pred"), F.max("score")).first()
    assert tuple(r) == ("und", 0.0)


def test_letters():
    score = op8.Model(["de", "en"], np.zeros((1, op8.DIM // 8), np.uint8), np.ones((1, 2), np.float32)).scorer()
    assert score(["²½", "12 _", "", None, "ª", "日"])[0] == ["und", "und", "und", "und", "de", "de"]


def test_kernel_by_brute_force(spark, scratch):
    rng = random.Random(14)
    langs = {"a": "abcde ", "b": "cdefg ", "c": "fghij "}
    table = [(i, "".join(rng.choice(langs["abc"[i % 3]]) for _ in range(60)), "abc"[i % 3]) for i in range(120)]
    grams = []
    for _, t, _ in table:
        b = t.encode()
        grams.append({int((c + (n << 28)) * 2654435761 % 2**32) >> 18 for n in (1, 2, 3) for k in range(len(b) - n + 1) for c in [int.from_bytes(b[k : k + n], "big")]})
    k = lambda x, y: (len(x & y) / (len(x) * len(y)) ** 0.5) ** 2
    x = op8.presence([t for _, t, _ in table])
    assert np.allclose(op8.kernel(x, x[:9]), [[k(p, q) for q in grams[:9]] for p in grams], atol=1e-5)
    model = op8.fit(spark.createDataFrame(table, "doc_id long, text string, lang string"), scratch, "doc_id", "text", "lang", 300, 5)
    marks = np.unpackbits(model.bits, axis=1).astype(bool)
    marks = [set(np.flatnonzero(m).tolist()) for m in marks]
    assert len(marks) == 15 and all(m in grams for m in marks)
    import zlib

    learnt = [j for j, (i, _, _) in enumerate(table) if zlib.crc32(str(i).encode()) % 3 != 1]
    K = np.array([[k(grams[j], m) for m in marks] for j in learnt])
    y = np.array([[1.0 if table[j][2] == lang else -1.0 for lang in "abc"] for j in learnt])
    w = np.array([1 / sum(table[h][2] == table[j][2] for h in learnt) for j in learnt])[:, None]
    own = np.array([[k(p, q) for q in marks] for p in marks])
    want = np.linalg.solve(K.T @ (w * K) + 1e-3 * own + 1e-8 * np.eye(15), K.T @ (w * y))
    assert np.allclose(K @ want, K @ model.alpha, atol=2e-3)


def test_chats(spark):
    hard = [r"\### Assistant: </turn> ok", "", "a\\", " </turn>\n", "### x: y", "日本 ###\\###", None]
    rows = [(c, t, [None, "user", "assistant", "sys: ### tem"][(c + t) % 4], hard[(c * 3 + t) % 7]) for c in range(9) for t in range(c)] + [(1, 0, "assistant", "tie"), (None, None, "assistant", "lost")]
    out = op9.digests(op9.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {}
    for c in {r[0] for r in rows}:
        t = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in t if r == "assistant")
        want[c] = (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss), len(op9.marked_turns(t)))
    assert {r[0]: tuple(r)[1:] for r in out} == want
    assert op9.digests(op9.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_rewriting_template():
    def last_only(turns):
        return "".join(f"[{r}|{t if k == len(turns) - 1 or r == 'user' else '...'}]" for k, (r, t) in enumerate(turns))

    got = op9.locate(last_only, [("user", "hi"), ("assistant", "long answer"), ("user", "more"), ("assistant", "end")])
    assert got["rewrote"] == [2] and got["out"] == "[user|hi][assistant|...][user|more][assistant|end]"
    assert [got["out"][a:z] for a, z in got["texts"]] == ["hi", "", "more", "end"]
    long = [("assistant" if k % 2 else "user", f"text {k} ###") for k in range(90)]
    for template in (op9.marked_turns, lambda turns: "<s>" + "".join(f"{k}:{r}={t};" for k, (r, t) in enumerate(turns))):
        got = op9.locate(template, long)
        assert not got["rewrote"] and [op9.unescape(got["out"][a:z]) for a, z in got["texts"]] == [t for _, t in long]
        assert "".join(got["out"][a:z] for a, z in got["spans"]) == got["out"] == template(long)
    plain = op9.locate(op9.marked_turns, [("user", " </turn>"), ("assistant", "a")])
    assert not plain["rewrote"] and [op9.unescape(plain["out"][a:z]) for a, z in plain["texts"]] == [" </turn>", "a"]


def test_templates_get_true_prefixes():
    long = [("assistant" if k % 2 else "user", f"text {k}") for k in range(40)]
    plain = lambda turns: "".join(f"[{r}|{t}]" for r, t in turns)

    def strict(turns):
        if not turns or [r for r, _ in turns] != [r for r, _ in long[: len(turns)]]:
            raise ValueError("roles must alternate from user on")
        return plain(turns)

    def folded(turns):  # shows a heading at 30 turns, and never again
        return ("# half\n" if len(turns) == 30 else "") + plain(turns)

    def early_and_late(turns):  # the turns at 3 and 25 rewrite the first text
        return plain([("user", "*" * ((len(turns) > 3) + (len(turns) > 25))), *turns[1:]])

    def at_twenty(turns):  # rewrites history at 20 turns only
        return plain([("user", "*") if len(turns) == 20 else turns[0], *turns[1:]])

    assert op9.locate(at_twenty, long[:30])["rewrote"] == [19, 20]
    folded.each = lambda turn: plain([turn])  # declared wrongly for the prefix of 30 turns
    got = op9.locate(strict, long)
    assert not got["rewrote"] and [got["out"][a:z] for a, z in got["texts"]] == [t for _, t in long]
    assert op9.locate(folded, long)["rewrote"] == [29, 30]
    at_twenty.each = lambda turn: plain([turn])  # and for that of 20
    assert op9.locate(at_twenty, long[:30])["rewrote"] == [19, 20]
    del folded.each
    assert op9.locate(folded, long)["rewrote"] == [29, 30]
    assert op9.locate(early_and_late, long)["rewrote"] == [3, 25]


def removed(table, length):
    data = [(i, (t or "").encode()) for i, t, *_ in table]
    n = collections.Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = collections.Counter()
    for i, x in data:
        hit = np.zeros(len(x) + 1, int)
        for k in range(len(x) - length + 1):
            if n[x[k : k + length]] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        c = np.cumsum(hit)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~c].tobytes()
        out[(i, len(x), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), sha(kept))] += 1
    return out


@pytest.mark.parametrize("widest", [48 << 20, 2000])
def test_repeats(docs, empty, scratch, widest):
    got = op10.remove_repeats(docs, scratch, outputs=False, widest=widest)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(ROWS, 400)
    assert op10.remove_repeats(empty, scratch, widest=widest).count() == 0


def test_repeats_round_a_passage(spark, scratch):
    """One passage of 390 bytes in many surroundings: single windows differ, some surroundings are shared too."""
    rng = random.Random(21)
    passage, around = "".join(rng.choice("abcdefgh ") for _ in range(390)), ["".join(rng.choice("xyz") for _ in range(20)) for _ in range(9)]
    table = [(i, rng.choice(around) * 30 + passage + rng.choice(around) * rng.randrange(1, 30)) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    for widest in (1 << 20, 600, 1):
        got = op10.remove_repeats(df, scratch, outputs=False, widest=widest)
        assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(table, 400)


def test_repeats_count_bytes_not_words(spark, scratch):
    """Passages of 55 words in several documents each: those of 399 bytes stay whole, those of 400 go; at a length of 399 all go."""
    rng = random.Random(22)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passages = [words(55) + "x" * (n - 384) for n in (399, 400) for _ in range(3)]
    table = [(k * 10 + i, chr(200 + i) + words(20) + str(i) + p + str(i) + words(20)) for k, p in enumerate(passages) for i in range(4)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    for length, first in ((400, 3), (399, 0)):
        got = op10.remove_repeats(df, scratch, outputs=False, length=length)
        assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(table, length)
        assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {i: len(passages[i // 10]) if i // 10 >= first else 0 for i, _ in table}


def test_licences(spark, docs, empty, scratch):
    comment = lambda t: "\n".join("# " + x for x in t.split("\n"))
    files = [
        ("r/LICENSE", "Released under the MIT License.\nx"), ("r/a/f.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore"), ("r/a/g.txt", "plain"), ("r/b/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
        ("r/b/c/d/h.txt", None), ("q/z.txt", "a license to kill"), (None, "All rights reserved."), ("top.txt", ""), ("r/LICENSE", "Licensed under CC BY-NC 4.0. Released under the MIT License."),
        ("x/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + op2.MIT + op2.AS_IS), ("x/y/z/w.py", "import os"), ("x/y/g.py", comment(op2.templates()[-1][2]) + "\n"),
        ("x/b.c", comment("Copyright Some Body\n\n" + op2.BSD_2 + op2.BSD_NAMES + op2.BSD_AS_IS) + "\nint main() { return 0; }\n" * 40), ("x/b2.c", op2.BSD_2 + op2.BSD_AS_IS), ("x/i.c", op2.ISC),
        ("x/a.c", "/*\n * " + op2.APACHE_HEADER.replace("\n", "\n * ") + "\n */\nint x;\n" + "int y;\n" * 50),
        ("x/n.c", comment(next(t for n, _, t, _ in op2.templates() if n == "GPL-3.0")) + "\n\n" + "code and more code\n" * 30), ("x/l.c", "Released under the Foo License."), ("x/p.c", "all the rights of man")]
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, licence string")
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in op2.scan_licences(df, scratch).collect()}
    assert got[1] == ("Apache-2.0", "own") and got[4] == ("GPL-3.0", "inherited") and got[2][1] == "inherited" and got[5] == (None, "none") and got[6] == ("Proprietary", "own") and got[7] == (None, "none")
    assert got[9] == ("MIT", "own") and got[10] == ("MIT", "inherited") and got[12] == ("BSD-3-Clause", "own") and got[13] == ("BSD-2-Clause", "own") and got[14] == ("ISC", "own")
    assert got[15] == ("Apache-2.0", "own") and got[16] == ("GPL-3.0", "own") and got[17] == got[18] == ("MIT", "inherited")
    assert op2.scan_licences(df.limit(0), scratch).count() == 0


def test_licence_titles_tags_and_denials(spark, scratch):
    probes = [
        ("# SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "GPL-3.0"), ("/* SPDX-License-Identifier: LGPL-2.1-only */", "LGPL-2.1"),
        ("<!-- SPDX-License-Identifier: CC-BY-NC-4.0 -->", "CC-BY-NC-4.0"), ("# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("MIT License\n\nCopyright (c) 2020 X", "MIT"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"), ("BSD 3-Clause License", "BSD-3-Clause"),
        ("This is not released under the MIT License.", None), ("It isn't licensed under the GNU General Public License, version 3.", None), ("Released under the MIT License.\nDo not remove this line.", "MIT"),
        ("a driver's license is not a title", None), ("the spdx list of identifiers", None)]
    df = spark.createDataFrame([(i, f"d{i}/LICENSE", t) for i, (t, _) in enumerate(probes)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in op2.scan_licences(df, scratch).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(probes)} == dict(probes)


def test_licences_by_brute_force(spark, scratch):
    """Every unit against every template with dictionaries, and every ancestor tried in turn."""
    import math

    rng = random.Random(16)
    every = op2.templates()
    lines = [t.split("\n")[0] for _, _, t, _ in every] + ["Not released under the MIT License.", "never", "the code of this work", "any kind of words", "", "#", "all rights", "x y z"]
    files = [(i, "/".join(rng.choice("ab") for _ in range(rng.randrange(4))) + "/" * rng.randrange(2) + rng.choice(["LICENSE", "f.txt"]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    files += [(200 + i, "full/f.txt", t) for i, (_, _, t, _) in enumerate(every)]

    def units(text):
        raw = text.split("\n")
        out = [text, *raw, *re.split(r"\n[ \t]*(?=\n)", text), *re.split(r"\n(?=\n)", "\n".join(x if op2.words(x) else "" for x in raw))]
        return [op2.words(u) for u in out]

    known = {w for _, need, t, bar in every for w in [*need, *op2.words(t), *bar]}
    listed = {i: [collections.Counter(u) for u in units(t)] for i, _, t in files}
    got = op2.scan_licences(spark.createDataFrame(files, "doc_id long, path string, text string"), scratch).collect()
    # the operator's own weights: the counts of its units
    m = op2.matcher(spark.createDataFrame([(t,) for _, _, t in files], "text string"))
    vocabulary = sorted(w.encode() for w in known)
    idf = {w.decode(): float(x) for w, x in zip(vocabulary, m.idf)}
    vector = lambda c: {w: n * idf[w] for w, n in c.items() if w in known}
    size = lambda c: math.sqrt(sum(v * v for v in vector(c).values()) + sum(n for w, n in c.items() if w not in known) * m.most**2)
    models = [(name, need, bar, vector(c), size(c), c) for name, need, t, bar in every for c in [collections.Counter(op2.words(t))]]
    own = {}
    for i, cs in listed.items():
        best = [(-sum(kn.values()), -round(sum(v * y.get(w, 0) for w, v in vector(c).items()) / (size(c) * ny), 4), name) for c in cs if size(c) for name, need, bar, y, ny, kn in models if all(w in c for w in need) and not any(w in c for w in bar)]
        best = [b for b in best if b[1] <= -0.7]
        own[i] = min(best)[1:] if best else (0, None)
    for r in got:
        x, name = own[r["doc_id"]]
        assert r["own_licence"] == name or (r["own_licence"] and name and abs(r["cosine"] + x) < 1e-3), (r, own[r["doc_id"]])
    speaks = {}
    for r in got:
        folder, _, file = (r["path"].rpartition("/") if "/" in r["path"] else ("", "", r["path"]))
        if file == "LICENSE" and r["own_licence"]:
            speaks[folder] = min(speaks.get(folder, (9, "")), (-r["cosine"], r["own_licence"]))
    for r in got:
        folder, want = r["path"].rpartition("/")[0], r["own_licence"]
        while not want:
            want = speaks.get(folder, (0, None))[1]
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert r["licence"] == want and r["origin"] == ("own" if r["own_licence"] else "inherited" if want else "none"), (r, want)


def test_id_filter(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    flagged = IdFilter(keys, "k", buckets=4).flag(spark.range(3000).withColumnRenamed("id", "k"), F.col("k"), "maybe")
    assert flagged.filter("k % 3 = 0 AND NOT maybe").count() == 0 and flagged.filter("maybe").count() < 1300
    left = drop_ids(spark.range(100).withColumnRenamed("id", "k"), keys, "k")
    assert sorted(r["k"] for r in left.collect()) == [k for k in range(100) if k % 3]
