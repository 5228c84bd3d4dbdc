"""Source divergence, Merkle manifest and n-gram Jaccard join against brute force on hard cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from cases import SCHEMA, rows

from telar.llm import op11_source_divergence as op11
from telar.llm import op12_merkle_manifest as op12
from telar.llm import op13_ngram_jaccard as op13
from telar.llm.common import Scratch

ROWS = rows()
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark)


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- source divergence


def divergences(rows, min_docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, lang, source in rows]
    df = collections.Counter((g, w) for g, _, ws in docs for w in set(ws))
    kept = collections.defaultdict(list)
    for (g, w), n in sorted(df.items()):
        if n >= min_docs:
            kept[g].append(w)
    counts = collections.defaultdict(collections.Counter)
    for g, s, ws in docs:
        for key in ((g, s), (g, None)):
            counts[key].update(w for w in ws if df[g, w] >= min_docs)
    p = {}
    for (g, s), c in counts.items():
        whole = sum(c.values()) + 2 * len(kept[g])
        p[g, s] = {w: 1 + 10**9 * (c[w] + 2) // whole for w in kept[g]}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for g, s in p:
        if s is None:
            continue
        pairs = [(-sum(f(p[g, s][w], p[g, o][w]) for w in kept[g]), o.encode()) for h, o in p if h == g and o not in (None, s)]
        terms = [(-f(p[g, s][w], p[g, None][w]), w.encode()) for w in kept[g] if counts[g, s][w] and p[g, s][w] > p[g, None][w]]
        out += [(g, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(pairs), 1)]
        out += [(g, s, "term", w.decode(), -v, r) for r, (v, w) in enumerate(sorted(terms)[:10], 1)]
    return collections.Counter(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("block_bytes", [op11.BLOCK_BYTES, 300])
def test_divergence(docs, empty, scratch, block_bytes):
    """Kept terms in two documents or more; with a small bound on the broadcast there are several passes."""
    got = bag(op11.source_divergence(docs, scratch, min_docs=2, block_bytes=block_bytes), *COLUMNS)
    assert got == divergences([(r[1], r[2], r[3]) for r in ROWS], 2) and sum(got.values()) > 40
    assert op11.source_divergence(empty, scratch).count() == 0


def test_divergence_of_many_terms(spark, scratch, monkeypatch):
    """Several shards a language, several blocks of sources, counts handed on early, terms of other alphabets."""
    for name, value in (("SHARD", 16), ("PIECE", 5), ("HELD", 40), ("SOURCES", 3), ("MOST_TERMS", 50)):
        monkeypatch.setattr(op11, name, value)
    rng = random.Random(3)
    word = lambda: rng.choice(["", "É", "日", "ß"]) + rng.choice("abcdefgh") + rng.choice("ijklmnop")
    table = [(" ".join(word() for _ in range(rng.randrange(60))), rng.choice(["de", "fr", None]), rng.choice("uvwxyz")) for _ in range(300)] + [(None, "lone", "u"), ("", "lone", "v")]
    df = spark.createDataFrame(table, "text string, lang string, source string").repartition(4)
    assert bag(op11.source_divergence(df, scratch), *COLUMNS) == divergences(table, 10)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        table = op11.PerfectHash.read(op11.PerfectHash.build(h).bytes())
        assert sorted(table.slots(h).tolist()) == list(range(len(h)))
        other = table.slots(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
        assert ((other >= -1) & (other < max(len(h), 1))).all()


def test_exact_shares():
    rng = random.Random(2)
    for whole in (1, 7, 10**9 + 7, 8 * 10**15):
        c = [rng.randrange(max(1, whole - 2)) for _ in range(50)]
        assert op11.share(np.array(c), whole).tolist() == [1 + 10**9 * (x + 2) // whole for x in c]


# ---- Merkle manifest


def manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(part, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))

    def reduced(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            h = levels[-1]
            levels.append([sha("".join(h[i : i + 2])) for i in range(0, len(h), 2)])
        return levels

    trees = {lang: reduced([x[2] for x in sorted(own, key=lambda x: x[:3])]) for lang, own in by.items()}
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = reduced([trees[x][-1][0] for x in langs])
    out = []
    for lang, own in by.items():
        for i, (_, _, h, r) in enumerate(sorted(own, key=lambda x: x[:3])):
            changed = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else h
            siblings, now = [], changed
            for levels, at in ((trees[lang], i), (top, langs.index(lang))):
                for level in levels[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [x for k, x in enumerate(pair) if k != at % 2]
                    pair[at % 2] = now
                    now, at = sha("".join(pair)), at // 2
            out.append((r[0], h, trees[lang][-1][0], top[-1][0], sha("".join(siblings)), now, now == top[-1][0]))
    return collections.Counter(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(docs, empty, scratch):
    want = manifest(ROWS)
    got = bag(op12.merkle_manifest(docs, scratch), *NAMES)
    assert got == want and not all(k[-1] for k in got)
    assert op12.merkle_manifest(empty, scratch).count() == 0


@pytest.mark.parametrize("fan", [4, 1024])
def test_manifest_of_odd_runs(spark, scratch, fan):
    """Runs of every length, ids far apart, negative, null and repeated, one document alone in its language."""
    rng = random.Random(fan)
    ids = [*range(63, 67), *range(65530, 65540), -1, -64, -65, 2**62, -(2**62), 5, None, None, 7, 7, 7]
    table = [(i, f"text {k}", lang, rng.choice(["s", None]), rng.choice([k, None])) for lang, n in (("a", 1), ("b", 2), (None, 3), ("é", len(ids)), ("", 17)) for k, i in enumerate(ids[:n])]
    table += [(9, "same", "é", "s", 1)] * 5
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert bag(op12.merkle_manifest(df, scratch, fan), *NAMES) == manifest(table)


# ---- n-gram Jaccard join


def sets_of(rows, size):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    grams = lambda w: {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    return [grams(words(t)) for _, t in rows]


def jaccard(rows, size=4, percent=85):
    sets = sets_of(rows, size)
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            top[root(a)] = root(b)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return collections.Counter((doc_id, len(sets[i]), first[root(i)]) for i, (doc_id, _) in enumerate(rows))


FIELDS = ("doc_id", "n_shingles", "component_id")


def test_jaccard(docs, empty, scratch):
    out = op13.jaccard_components(docs, scratch)
    assert out.columns == list(FIELDS)
    assert bag(out, *FIELDS) == jaccard([r[:2] for r in ROWS])
    assert op13.jaccard_components(empty, scratch).count() == 0


def near_texts(rng):
    """Copies by edits of every number, chains of edits, templates with parts of their own, short texts."""
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return w

    texts = [words(rng.randrange(1, 12)) for _ in range(25)]
    base = words(120)
    texts += [edited(base, rng.randrange(5)) for _ in range(60)]
    chain = words(200)
    for _ in range(25):
        texts.append(chain)
        chain = edited(chain, 3)
    template = words(80)
    texts += [template + words(rng.randrange(5, 60)) for _ in range(60)]
    long = words(700)
    texts += [edited(long, rng.randrange(25)) for _ in range(20)]
    some = [t[: rng.randrange(1, len(t))] for t in rng.sample(texts, 20)]
    return [" ".join(t) for t in texts + some + texts[::9]]


@pytest.mark.parametrize("rare, long", [(op13.RARE, op13.LONG), (2, 30)])
def test_jaccard_of_near_texts(spark, scratch, rare, long):
    rng = random.Random(rare)
    table = [(None if i % 17 == 3 else i, t) for i, t in enumerate(near_texts(rng))]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = bag(op13.jaccard_components(df, scratch, rare=rare, long=long), *FIELDS)
    assert got == jaccard(table)
    assert len({c for _, _, c in got}) < len(table) - 60


def test_linked_sets_share_a_key():
    """Every pair of linked sets has a key in common, whatever the classes; sets without common elements share none."""
    rng = np.random.default_rng(4)
    for rare, long in ((16, 256), (1, 40), (3, 1000)):
        sets = []
        for _ in range(30):
            base = rng.integers(1, 1 << 62, rng.integers(1, 90))
            for _ in range(6):
                keep = base[rng.random(len(base)) > rng.random() * 0.15]
                sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 62, rng.integers(0, 4))])))
        h, df = np.unique(np.concatenate(sets), return_counts=True)
        keys = []
        for s in sets:
            d = df[np.searchsorted(h, s)]
            keys.append(set(op13.prefix_keys(d[d > 1], s[d > 1], len(s), 85, rare, long).tolist()))
        linked = 0
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and (len(sets[a]) != both or len(sets[b]) != both):
                linked += 1
                assert keys[a] & keys[b]
            elif not both:
                assert not keys[a] & keys[b]
        assert linked > 20
