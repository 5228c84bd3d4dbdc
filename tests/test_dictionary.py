"""The automaton finds what the pattern of all entries finds."""

import random
import re
import time

from pyspark.sql import functions as F

from telar.functions.dictionary import Dictionary
from telar.operators import tech


def by_pattern(text, entries):
    every = "|".join(re.escape(e) for e in sorted(entries, key=lambda e: (-len(e), e)))
    return [(m[0], m.start()) for m in re.finditer(rf"(?i)(?<!\w)(?:{every})(?!\w)", text)]


def test_like_the_pattern():
    rng = random.Random(1)
    for _ in range(400):
        entries = {"".join(rng.choice("ab .#é") for _ in range(rng.randrange(1, 5))) for _ in range(6)}
        text = "".join(rng.choice("aAbB  .#éÉ_1日") for _ in range(rng.randrange(60)))
        assert Dictionary(entries).find(text) == by_pattern(text, entries), (entries, text)


def test_like_spark(spark):
    rng = random.Random(2)
    surfaces = [s for s, *_ in tech.SURFACES]
    texts = [(k, " ".join(rng.choice([rng.choice(surfaces), rng.choice(surfaces).upper(), "texto", "(", ",", "v2", "java-8", "\n"]) for _ in range(rng.randrange(30)))) for k in range(200)]
    df = spark.createDataFrame([*texts, (900, None), (901, ""), (902, "İ java ß PYTHON3")], "doc_id long, text string")
    one = sorted(map(tuple, tech.mentions(df, ["doc_id"]).select("doc_id", "raw", "offset").collect()))
    two = sorted(map(tuple, df.withColumn("h", tech.hits(F.col("text"), tech.pattern())).select("doc_id", F.inline("h")).collect()))
    assert one == two and len(one) > 1000


def test_twenty_thousand_entries():
    """A hundred times as many entries cost little more time."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 12)))
    many = {word() for _ in range(20_000)}
    text = " ".join(word() for _ in range(40_000))
    times = []
    for entries in (set(list(many)[:200]), many):
        d = Dictionary(entries)
        began = time.process_time()
        found = d.find(text)
        times.append(time.process_time() - began)
        assert [r for r, _ in found] == [w for w in text.split(" ") if w in entries]
    assert times[1] < 10 * times[0] + 1
