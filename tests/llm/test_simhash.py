"""SimHash groups against brute force over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cairnspark.llm import simhash
from cairnspark.llm.components import components
from tests.conftest import SF

ROWS = [
    (1, "The cat sat on the mat and ran off to see what was new in town"), (2, "the CAT sat on the mat and ran off to see what was new in town"), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "One"), (8, "one two"),
    (9, "one\x1ctwo three"), (9, "one\x1ctwo three"), (None, "no id at all here"), (10, "no id at all here"), (None, "alone without an id at all"), (11, "Äé ß 中文 ЖЖ x y z"), (12, "word " * 4000), (13, "word\n" * 4001),
]
SCHEMA = "doc_id long, text string, fingerprint string, component string, code int"


def brute_print(text, words):
    found = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    """The smallest member of each one's component, by all pairs."""
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in root:
        for y in root:
            if x < y and (x ^ y).bit_count() <= distance and (a := find(x)) != (b := find(y)):
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def brute(rows, words, distance):
    prints = [brute_print(t, words) for _, t in rows]
    group = brute_groups(set(prints), distance)
    least = {g: min((d for (d, _), p in zip(rows, prints, strict=True) if d is not None and group[p] == g), default=None) for g in set(group.values())}
    return sorted(((d, f"{p:016x}", least[group[p]]) for (d, _), p in zip(rows, prints, strict=True)), key=str)


def check(spark, rows, words, distance):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, simhash.simhash_groups(docs, words, distance).collect()), key=str) == brute(rows, words, distance)


def test_odd_rows(spark):
    check(spark, ROWS, 3, 2)
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_near_copies(spark, distance):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for j in range(8):
            rows.append((i * 10 + j, " ".join(text)))
            text[rng.randrange(len(text))] = "other"
    check(spark, rows, 3, distance)


def test_slices_of_long_texts(monkeypatch):
    texts = ["a bc  def\tg " * 30, "x" * 200, "y " + "z" * 70 + " q", "", " " * 99, "ab", "ab cd"]
    whole = [simhash.fingerprint(t.encode(), 3) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert whole == [simhash.fingerprint(t.encode(), 3) for t in texts]
    assert [x % (1 << 64) for x in whole] == [brute_print(t, 3) for t in texts]


@pytest.mark.parametrize(("distance", "full"), [(0, 64), (1, 64), (1, 3), (2, 64), (2, 3)])
def test_links_of_dense_balls(spark, monkeypatch, distance, full):
    """All pairs, where cells are small and where they are over-full; the largest difference discards no link."""
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(distance)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}))
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fingerprint long")
    got = {r.node % (1 << 64): r.component for r in components(simhash.links(nodes, distance)).collect() if r.node % (1 << 64) in prints}
    want = brute_groups(prints, distance)
    same = {}
    for x in prints:
        same.setdefault(got.get(x, simhash._signed(x)), set()).add(want[x])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_pivot_tables_discard_what_is_far(spark):
    rng = random.Random(1)
    nodes = [(simhash._signed(rng.getrandbits(64)),) for _ in range(300)]
    table = simhash.pivot_table(spark.createDataFrame(nodes, "fingerprint long"), 6)
    pairs = table.alias("x").join(table.alias("y"), F.col("x.fingerprint") < F.col("y.fingerprint"))
    left = pairs.where(simhash._largest_difference("x", "y") <= 2).count()
    assert left < 0.001 * 300 * 299 / 2


def test_query_on_the_smallest_tables(spark):
    from cairnspark.llm.queries import op11_pivot_simhash

    got = sorted(map(tuple, op11_pivot_simhash(spark, SF).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows, 3, 2)
