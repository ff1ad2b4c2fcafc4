"""Collocations against brute force, summaries against true counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairnspark.llm import collocations

SCHEMA = "doc_id long, lang string, text string, phrase string, rank int, salt int, f long"


def brute(rows, most, least, percent, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    found = []
    for lang, counts in f.items():
        longs = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = set()
        for q, b in longs.items():
            for size in range(2, len(q)):
                drop |= {p for i in range(len(q) - size + 1) if 100 * b >= percent * longs[p := q[i : i + size]]}
        rows = []
        for p, a in longs.items():
            if p not in drop:
                score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(found)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "Ä", "ß", "a", "b", "中文", "x\x1cy", "long" * 9]
    gaps, ends = [" ", " ", " ", "\t", "  "], [". ", ", ", "\n", "! ", "\r\n", ""]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), (None, "und und und"), ("und", "und und und"), ("fr", "..,;:!?")]
    for _ in range(docs):
        text = ""
        for _ in range(rng.randrange(1, 12)):
            text += "".join(w + rng.choice(gaps) for w in rng.choices(words, range(12, 0, -1), k=rng.randrange(1, 9))) + rng.choice(ends)
        rows.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return rows


@pytest.mark.parametrize(("least", "top", "most", "small"), [(10, 2000, 3, False), (10, 2000, 3, True), (3, 7, 4, True), (2, 5, 2, False)])
def test_against_brute_force(spark, monkeypatch, least, top, most, small):
    """Also with tiny windows, many flushes and partitions, and summaries that overflow."""
    if small:
        for name, value in (("CHUNK", 64), ("FLUSH", 50), ("MASS", 256), ("CAPACITY", 8), ("FILTER_BITS", 1 << 15)):
            monkeypatch.setattr(collocations, name, value)
    rows = made(least)
    docs = spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA).repartition(2)
    got = sorted(map(tuple, collocations.collocations(docs, most, least, 50, top).collect()))
    assert got == brute(rows, most, least, 50, top) and got


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1)], SCHEMA)).count() == 0


def test_summaries_keep_every_frequent_key():
    """Capacity over mass / least: at most that many counters, no key of ``least`` is lost, and deductions stay below it."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        stream = np.concatenate([rng.integers(0, 400, 900), rng.zipf(1.4, 900) % 300]).astype(np.uint32)
        rng.shuffle(stream)
        summary = collocations.Summary(len(stream) // 10 + 1, 10)
        for part in np.split(stream, range(37, len(stream), 37)):
            keys, counts = np.unique(part, return_counts=True)
            summary.add(keys, counts.astype(np.uint8))
            assert summary.deducted < 10
        true = Counter(stream.tolist())
        kept = set(summary.survivors().tolist())
        assert {k for k, c in true.items() if c >= 10} <= kept and len(summary.keys) <= summary.capacity
        assert all(c <= int(summary.counts[summary.keys == k].sum()) + summary.deducted for k, c in true.items())


def test_windows_are_cut_anywhere(monkeypatch):
    """Phrases of a long text are the same whatever the window; a word may be longer than one."""
    text = "a bb  ccc\td " * 40 + "z" * 300 + " e f. g h " + "q" * 64 + " " + "r" * 63 + "," + "a bb c" + " " * 500 + "d" + "\t." * 200 + " e"

    def phrases():
        batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
        return Counter((n, t) for w, langs in collocations.windows(batch, 3) for n, at, _ in w.phrases(collocations._salts(langs), 3) for t in w.texts(n, at))

    whole = phrases()
    for chunk in (16, 64, 65, 200):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        assert phrases() == whole
