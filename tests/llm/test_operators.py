"""The corpus operators against brute force, on tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import backoff, exact_dedup, fertility, jaccard_join, mixing, packing, string_kernel, token_counts, token_shards, toxicity
from cairnspark.llm.encoders import _tokenizer, byte_level
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n_tokens int, node long"
WORDS = "the cat sat on a mat and then it ran off to see what was new in town today".split()
BASE = " ".join(WORDS * 4)
ROWS = [
    (1, "Hello, World! It's <|endoftext|> fine\n\n two  lines\t\x1c here", "en", "a"), (2, "hello, world! it's <|endoftext|> fine\n\n two  lines\t\x1c here", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, BASE, "en", "a"), (6, BASE, "en", "a"), (6, BASE, "en", "a"), (7, BASE + " extra", "fr", "b"),
    (None, "null id here", "de", "a"), (8, "12 34 %%", "de", None), (9, "word " * 3000, "en", "a"), (10, "Äé ß 中文 ЖЖ", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, 2) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return [*_tokenizer("byte_bpe_50k.json").encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", ["", " ", "a\t\n\nb", "x\x1c y", "don't.<|endoftext|>  b\n", "a  b \n c", "é!?. x"])
def test_unit_encoder_is_the_library(text):
    assert list(byte_level("byte_bpe_50k.json").encode(text)) == ids_of(text)[:-1]


def test_long_texts_and_words_hash_as_short_ones(monkeypatch):
    from cairnspark.llm import words
    import pyarrow as pa

    texts = pa.array(["Ab cd " * 40, None, "x" * 200, "y" * 63 + " z", " " * 90, ""])
    whole = [v[b[i] : b[i + 1]].tolist() for _, v, b in words.hashed_words(texts) for i in range(len(b) - 1)]
    monkeypatch.setattr(words, "CHUNK", 64)
    assert whole == [v[b[i] : b[i + 1]].tolist() for _, v, b in words.hashed_words(texts) for i in range(len(b) - 1)]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), np.array([0]), np.array([5, 5, 5]), np.sort(rng.integers(0, 10**7, 1000))):
        ef = token_shards.EliasFano.from_bytes(token_shards.EliasFano.encode(values).to_bytes())
        assert values.tolist() == [ef.select(i) for i in range(len(values))] == ef.select_range(0, len(values)).tolist()
        for a, b in ((0, 1), (3, 70), (63, 64), (64, 129), (999, 1000), (5, 2000), (7, 7)):
            assert ef.select_range(a, b).tolist() == values[a:b].tolist()


def test_shard_documents():
    arrays = [np.arange(n, dtype="<u2") for n in (3, 0, 70, 1, 5) * 40]
    for ids in ([None] * 5 + list(range(10, 205)), [None] * 200, list(range(-5, 195))):
        shard = token_shards.Shard(token_shards.pack_shard(ids, arrays))
        got = list(shard.documents(block=64))
        assert [g[0] for g in got] == ids and all(g[2].tolist() == a.tolist() == shard.document(i).tolist() for i, (g, a) in enumerate(zip(got, arrays, strict=True)))
        assert [g[1] for g in got] == [shard.span(i)[0] for i in range(200)]


def test_token_shards(docs, empty):
    got = sorted(token_shards.token_shards(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    texts = Counter((r[0], len(ids_of(r[1])), crc(ids_of(r[1]))) for r in ROWS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == texts
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert token_shards.token_shards(empty).count() == 0


def test_pretokens_are_counted_once(docs, monkeypatch):
    """Several blocks and ranges; each distinct pre-token meets the library once, in one range."""
    monkeypatch.setattr(token_counts, "RANGE_WORDS", 1)
    rows = docs.unionByName(docs)
    blocks = token_counts._blocks(rows.select("doc_id", "text", F.octet_length("text").alias("n_bytes")).fillna(0, ["n_bytes"]), "word_bpe_49k.json", 7, 50)
    assert blocks.count() > 3
    asked = blocks.select("block", F.explode(F.arrays_zip("ranges", "words")).alias("a")).select("block", "a.ranges", "a.words").collect()
    where = {}
    for r in asked:
        for w in zlib.decompress(r.words).decode().split("\n"):
            where.setdefault(w, set()).add(r.ranges)
    assert all(len(ranges) == 1 for ranges in where.values()) and set(where) == {w for _, t, *_ in ROWS for w in token_counts.WORDS(t or "")}
    got = Counter(map(tuple, token_counts.count_tokens(rows, block_bytes=50).collect()))
    assert got == Counter({k: 2 * n for k, n in Counter(map(tuple, token_counts.count_tokens(docs).collect())).items()})
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):  # pieces may span white space: whole texts are counted
        counter = token_counts.word_pieces(name)
        assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, name).collect()} == {(i, counter.count(t or "")) for i, t, *_ in ROWS}


def test_token_counts(docs, empty):
    tokenizer = _tokenizer("word_bpe_49k.json")
    want = Counter((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in ROWS)
    assert Counter(map(tuple, token_counts.count_tokens(docs).collect())) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, 64).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()
        assert sum(r.length for r in rows) <= 64
    whole = {i: ids_of(t) for i, t, *_ in ROWS}
    assert all(crc(whole[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t, *_ in ROWS)
    assert packing.pack(empty).count() == 0


def test_local_search_empties_a_bin():
    lengths = [6, 2, 5, 3, 4]
    bins = packing.Bins([[6, 2], [5, 3], [4]], 10)
    bins.search()
    after = bins.contents()
    assert len(after) == 2 and sorted(x for b in after for x in b) == sorted(lengths) and bins.steps.total()
    assert max(map(sum, after)) <= 10


@pytest.mark.parametrize("lengths", [[], [1], [7] * 50, list(range(1, 65)) * 5, [64, 64, 33, 31, 1]])
def test_packed_lengths_stay(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(x for b in bins.contents() for x in b) == sorted(lengths) and all(sum(b) <= 64 for b in bins.contents())
    squares = lambda bs: sum(sum(b) ** 2 for b in bs)
    order = np.random.default_rng(1).permutation(len(lengths))
    assert squares(bins.contents()) >= squares(packing.arrival_fit([lengths[i] for i in order], 64))


def test_packing_reaches_its_bound(spark, monkeypatch):
    """Exchanges do part of the packing, and few sequences are more than the bound; also where slots stand for several pieces."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = packing.stored(packing.cut_documents(rows), "test-pieces")
    lengths = [r.length for r in pieces.select("length").collect()]
    least = -(-sum(lengths) // 2048)
    assert packing.Slots(Counter(lengths), 2048).bins.steps.total() > 100
    for slots in (packing.SLOTS, 300):
        got = packing.place(pieces, 2048, slots).collect()
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append(r)
        assert sorted(r.length for r in got) == sorted(lengths)
        assert len(bins) <= least * (1.01 if slots > len(lengths) else 1.05)
        for b in bins.values():
            b.sort(key=lambda r: r.offset)
            assert [r.offset for r in b] == np.cumsum([0, *[r.length for r in b]])[:-1].tolist() and sum(r.length for r in b) <= 2048


def test_exact_dedup(docs, empty):
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    by_id = {i: norm(t) for i, t, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        own = groups[by_id[r.doc_id]]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_inserts_and_compacts(spark):
    """Several inserts, levels that are compacted, filters without false negatives; as if all rows came at once."""
    rng = np.random.default_rng(2)
    rows = [(bytes([int(rng.integers(0, 40))]) * 4, int(rng.integers(0, 99)) if k % 9 else None, k) for k in range(300)]
    for keep, fanout in (("max", 2), ("min", 3)):
        index = exact_dedup.DigestIndex(keep, fanout)
        for b in range(7):
            index.insert(spark.createDataFrame(rows[b * 45 : (b + 1) * 45], "digest binary, doc_id long, tag long"))
            assert all(len(runs) < fanout for runs in index.levels.values())
        assert index.compactions >= 2 and max(index.levels) >= 1
        for run in index.runs():
            bits = 1 << 15
            assert exact_dedup.filtered(run.rows, exact_dedup.bitmaps(run.rows, bits), bits).where("not __inside").count() == 0
            assert run.rows.count() == run.rows.select("digest").distinct().count()
        got = {bytes(r.digest): (r.doc_id, r.n) for r in index.merged().rows.collect()}
        want = {}
        for d, i, _ in rows:
            want.setdefault(d, []).append(i)
        best = max if keep == "max" else min
        assert got == {d: (best((i for i in own if i is not None), default=None), len(own)) for d, own in want.items()}


def test_bytes_decide_where_digests_collide(spark):
    rows = [(1, "aa"), (2, "AA"), (3, "bb"), (4, "ccc"), (None, "bb"), (5, None), (6, ""), (3, "bb"), (7, "dddd")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.length(text).cast("string").cast("binary")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table, digest=weak).collect())
    assert got == Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, True), (3, 3, 3, False), (None, 3, 3, False), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)])


def test_no_column_name_clashes(spark):
    """Columns that the operators use inside are carried as they are."""
    names = "id hash row digest kept_id kept_digest group_size kind_id kind_hash is_first __id __digest __row __hash __sampled __copies __source __weight __inside".split()
    rows = spark.createDataFrame([(i, f"some text {i % 3} " * 9, "en", "a", *("x" + n for n in names)) for i in range(6)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for found in (exact_dedup.drop_copies(rows), jaccard_join.keep_one(rows), mixing.sample_mix(rows, budget=1.0)):
        assert found.columns == rows.columns
        kept = found.collect()
        assert kept and all(r[n] == "x" + n for r in kept for n in names)


@pytest.mark.parametrize("hot", [4_096, 2])
def test_similar_groups(spark, empty, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    texts = {i: " ".join(f"w{i % 7}_{k}" if k != i else f"odd{i}" for k in range(60)) for i in range(40)}
    texts |= {50: None, 51: "", 52: "a b", 53: "A B", 54: texts[0], 55: "b a"}
    rows = spark.createDataFrame([*texts.items(), (54, texts[0])], "doc_id long, text string")
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    group = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(rows, 3, 80).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in texts}
    assert jaccard_join.similar_groups(empty, 3, 80).count() == 0
    assert jaccard_join.keep_one(rows, 3, 80).columns == rows.columns


@pytest.mark.parametrize("hot", [4_096, 3])
def test_shingles_that_most_sets_share(spark, monkeypatch, hot):
    """Every set is made of few words that all others use too, so prefixes are hot: dealt over keys and cells of a grid, the links are those of all pairs."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(18)]
    texts = {i: " ".join(rng.choice(words, int(rng.integers(5, 14)), replace=False)) for i in range(150)}
    sets, group = {i: set(t.split()) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])]
    while any(group[a] != group[b] for a, b in links):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert 20 < len(set(group.values())) < 150
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame([*texts.items()], "doc_id long, text string"), 1, 70).collect()}
    assert got == group


def test_shingles_of_the_same_sets_make_their_pairs_once(spark, monkeypatch):
    """Of shingles 10 to 12, which sets 1 and 2 have, the first stands for all; 30 is of one component alone; 21 has other sets than 20."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    had = {10: {1: 4, 2: 0}, 11: {1: 5, 2: 1}, 12: {1: 9, 2: 7}, 20: {1: 6, 2: 2, 3: 0}, 21: {1: 7, 3: 1}, 30: {3: 2, 4: 0}}
    rows = [(token, node, place, min(node, 3)) for token, places in had.items() for node, place in places.items()]
    named = spark.createDataFrame(rows, "token long, node long, place int, component long").repartition(3)
    assert {tuple(r) for r in jaccard_join._several(named).collect()} == {(10, 1), (20, 2), (21, 1)}


def test_backoff_automaton(spark, docs, empty):
    from math import log10

    rows = docs.withColumn("held_out", F.coalesce(F.col("doc_id") == 7, F.lit(False)))
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    train = [low(t) for i, t, *_ in ROWS if i != 7]
    counts = [Counter(tuple(d[k : k + n]) for d in train for k in range(len(d) - n + 1)) for n in range(1, 5)]
    n, v = sum(counts[0].values()), len(counts[0])

    def walk(d, order):
        """One token after the other: the longest history that is a state, failing to shorter ones."""
        known = total = base = 0.0
        for k, w in enumerate(d):
            p = p1 = (counts[0][w,] + 0.1) / (n + 0.1 * (v + 1))
            for m in range(1, min(order - 1, k) + 1):
                h = tuple(d[k - m : k])
                p = (counts[m][*h, w] + 2 * p) / (counts[m - 1][h] + 2)
            known, base, total = known + (counts[0][w,] > 0), base + log10(p1), total + log10(p)
        return known, base, total

    for order, size in ((3, 6_000_000), (3, 1), (1, 100), (2, 100), (4, 100)):
        got = {(r.doc_id, r.n_tokens): r for r in backoff.score_corpus(rows, order, block_bytes=size).collect()}
        for i, t, *_ in ROWS:
            d = low(t)
            r, (known, base, total) = got[i, len(d)], walk(d, order)
            assert r.train_tokens == n and r.n_known == known and r.held_out == (i == 7)
            assert r.base_score == pytest.approx(base, abs=1e-5) and r.score == pytest.approx(total, abs=1e-5)
    assert backoff.score_corpus(empty.withColumn("held_out", F.lit(False))).count() == 0


def test_blocks_and_ranges_meet_in_steps(spark, docs, monkeypatch, tmp_path):
    """However many steps, the rows are the same; what a block sends stays the same as blocks multiply, where one step would square it."""
    rows = docs.withColumn("held_out", F.coalesce(F.col("doc_id") == 7, F.lit(False)))
    want = Counter(map(tuple, backoff.score_corpus(rows).collect()))
    for fan in (1, 2, 3):
        assert Counter(map(tuple, backoff.score_corpus(rows, block_bytes=1, fan_bits=fan).collect())) == want
    monkeypatch.setattr(token_counts, "RANGE_WORDS", 1)
    want = Counter(map(tuple, token_counts.count_tokens(docs).collect()))
    for fan in (2, 5):
        assert Counter(map(tuple, token_counts.count_tokens(docs, block_bytes=50, fan_bits=fan).collect())) == want

    def parts(texts: int) -> list[int]:
        sent = []
        keep = backoff.stored
        monkeypatch.setattr(backoff, "stored", lambda df, name: sent.append(keep(df, name)) or sent[-1])
        words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.xxhash64("id", i).cast("string")))
        table = spark.range(0, texts, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit(False).alias("held_out"))
        backoff.score_corpus(table.repartition(texts), 1, block_bytes=1, fan_bits=2)
        monkeypatch.setattr(backoff, "stored", keep)
        return [df.count() for df in sent]  # blocks, parts of each step but the last, answers

    (few, *small), (many, *large) = parts(16), parts(64)
    assert (few, many, len(small), len(large)) == (16, 64, 2, 3)
    assert max(large[:-1]) <= 4 * many and max(small[:-1]) <= 4 * few


def test_packed_numbers():
    for x in (np.zeros(0, np.uint64), np.array([0, 1, 255, 256, 2**56 - 1], np.uint64), np.arange(1000, dtype=np.uint64) ** 5):
        assert backoff.unpacked(backoff.packed(x)).tolist() == backoff.unpacked_keys(backoff.packed_keys(x)).tolist() == x.tolist()


def test_fertility(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in fertility.fertility(docs).collect()}
    for i, t, *_ in ROWS:
        w = [x.decode() for x in (t or "").encode().split()]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i, len(w)]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert fertility.fertility(empty).count() == 0


def test_every_letter_counts_for_the_script():
    """Letters that evenly spaced places would miss: every other one of a text, and all but the places looked at before."""
    assert fertility.script_of("aя" * 40 + "яя" * 40) == "cyrillic"
    assert fertility.script_of(("a" + "я" * 9) * 64) == "cyrillic"
    assert fertility.script_of("ab1я") == "latin"
    assert fertility.script_of("12 !") == "none" == fertility.script_of("")


def test_fertility_bands(spark):
    """Each band rejects what passes the base rules: encoded text, noise of rare characters, few tokens; hardly any other document is."""
    rng = np.random.default_rng(4)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    planted = {
        -1: " ".join("".join(rng.choice(letters, 60)) for _ in range(80)),
        -2: " ".join("".join(map(chr, rng.integers(0x12000, 0x12300, 5))) for _ in range(80)),
        -3: " ".join("ha" * k for k in range(1, 90)),
    }
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in fertility.fertility(rows.unionByName(spark.createDataFrame([(i, t, "en") for i, t in planted.items()], rows.schema))).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i in planted)
    others = [r for i, r in got.items() if i not in planted and not r.base_failed]
    assert sum(not r.kept for r in others) <= 0.01 * len(others)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for i, t in texts.items():
        lines = t.split("\n")
        seen = [x for x in lines if x.strip(fertility.SPACES)]
        assert got[i].n_symbols == sum(t.count(c) for c in "#*$%&|<>") and got[i].n_dup_lines == len(seen) - len(set(seen))


def test_every_language_is_learned(spark):
    """More languages than a fixed number, one text that a third of all rows repeat; a text without a twin is enough."""
    alphabets = [chr(0x4E00 + 40 * k) for k in range(230)]
    text = lambda k, j: " ".join(chr(ord(alphabets[k]) + (7 * j + i) % 40) * 3 for i in range(12))
    rows = [(k * 10 + j, text(k, j), f"l{k:03d}") for k in range(230) for j in range(3)] + [(9000 + i, text(0, 0), "l000") for i in range(345)]
    model = string_kernel.fit_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_texts=460)
    assert model.classes == sorted(f"l{k:03d}" for k in range(230))


def test_language_id(spark, docs, empty):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = string_kernel.language_id(rows, F.col("doc_id") % 3 == 1).where("held_out").join(rows.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    odd = {r.doc_id: r.lang_pred for r in string_kernel.language_id(docs, F.lit(False)).collect()}
    assert odd[3] == odd[4] == odd[8] == "und" and odd[5] in ("en", "fr", "de")
    assert string_kernel.language_id(empty, F.lit(False)).count() == 0


def test_toxicity(spark, empty):
    rows = [(i, f"{'vile ' if i % 4 == 0 else ''}some words {i} and more {i % 5}") for i in range(400)] + [(400, None), (401, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels, F.col("doc_id") % 3 == 1).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and got[400].score == got[401].score < 0.7
    assert toxicity.toxicity(empty, labels, F.col("doc_id") < 0).count() == 0


def test_toxicity_on_tables_with_nulls_repeats_and_clashes(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 1), (None, 1), (8, None), (9, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    none = toxicity.toxicity(docs, labels.where("false"), F.lit(False)).collect()
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)
    assert toxicity.drop_toxic(docs, labels.where("false"), F.lit(False)).count() == len(ROWS)
    assert toxicity.drop_toxic(empty, labels, F.lit(False)).columns == docs.columns


def test_chosen_rates(spark):
    """Rates that leave no weight lose to those that learn; the loss is that of rows which weren't fitted."""
    table = spark.createDataFrame([(i, f"{'vile ' if i % 4 == 0 else ''}some words {i} and more {i % 5}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(table, labels)
    fitted, compared = ([r for r in rows if (zlib.crc32(r[0]) % 4 == 0) == side] for side in (False, True))
    got = {(r.alpha, r.l1): r for r in toxicity.choose_rates(table, labels, (1.0, 2.0), (8.0, 1e6)).collect()}
    assert len(got) == 4 and fitted and compared
    for (alpha, l1), r in got.items():
        model = toxicity.ToxicityModel.fit(fitted, alpha=alpha, l1=l1)
        table = np.zeros(1 << toxicity.BITS)
        table[model.at] = model.weights
        p = [1 / (1 + np.exp(-table[toxicity._unpacked(s)].sum() - model.intercept)) for s, _ in compared]
        assert r.log_loss == pytest.approx(-np.mean([np.log(x if y else 1 - x) for x, (_, y) in zip(p, compared, strict=True)])) and r.weights == len(model.at)
    assert max(got[a, 8.0].log_loss for a in (1.0, 2.0)) < min(got[a, 1e6].log_loss for a in (1.0, 2.0))


def test_toxicity_on_held_out_labels(spark):
    """A floor under what was measured on sf0.1, whose training part has few toxic rows; no rate is chosen by it."""
    from cairnspark.llm.queries import op5_ftrl_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kinds = Counter((r.toxic, r.predicted) for r in op5_ftrl_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect())
    assert kinds[1, 1] >= 0.7 * (kinds[1, 1] + kinds[1, 0]) and kinds[0, 1] <= 0.05 * (kinds[1, 1] + kinds[0, 1])


def test_mixing(docs, empty):
    cells = {("a", "x", "t"): 90.0, ("a", "y", "t"): 10.0, ("b", "x", "t"): 50.0, ("b", "y", "t"): 50.0}
    w = mixing.rake(cells, [{"a": 0.3, "b": 0.7}, {"x": 0.5, "y": 0.5}, {}])
    assert w["a", "x", "t"] + w["a", "y", "t"] == pytest.approx(0.3) and w["a", "x", "t"] + w["b", "x", "t"] == pytest.approx(0.5)
    p = mixing.probabilities(cells, w, 0.4)
    assert sum(p[k] * cells[k] for k in cells) == pytest.approx(80, rel=1e-6)
    got = mixing.mixing(docs).collect()
    assert len(got) == len(ROWS) and {r.source for r in got} == {"a", "b", "(rest)"}  # the null source has few tokens and is pooled
    assert mixing.mixing(empty).count() == 0 and mixing.sample_mix(docs).columns == docs.columns


def test_mix_meets_its_targets(spark):
    """One source and language rule, so that rare cells are wanted more often than they have documents."""
    rows = [(i, f"w{i} " * 19 + "end.", "en" if i % 50 else "es", f"s{i % 7}" if i % 9 == 0 else "hot") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for targets in (None, {"source": {"hot": 0.2}, "lang": {"en": 0.4, "es": 0.6}}):
        found = mixing.marginals(table, targets).collect()
        assert max(abs(r.expected - r.target) for r in found) < 1e-6 and max(abs(r.expected - r.natural) for r in found) > 0.05
        assert max(abs(r.drawn - r.target) for r in found) < 0.02
        drawn = Counter(r.source for r in mixing.sample_mix(table, targets=targets).collect())  # all texts have 20 tokens
        assert {r.value: r.drawn for r in found if r.dimension == "source"} == pytest.approx({k: n / drawn.total() for k, n in drawn.items()})
        assert drawn.total() == pytest.approx(0.8 * len(rows), rel=0.02)


def test_mix_pools_no_value_where_none_is_to_be(spark, monkeypatch):
    """A hot source and a tail of 100, each under a two-hundredth of the tokens; raked by the driver and by Spark."""
    rows = [(i, f"w{i} " * 9 + "end.", ["en", "es", "is"][0 if i % 5 else 2 if i % 25 else 1], "hot" if i % 3 else f"s{i % 300}", f"t{i % 2}") for i in range(6000)]
    table = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, topic string")
    one = {r.doc_id: r for r in mixing.mixing(table, min_share=0.0).collect()}
    assert {(r.doc_id, r.lang, r.source, r.topic) for r in one.values()} == {(r[0], *r[2:]) for r in rows} | {(None, "(none)", "(none)", "(none)")}
    shares = mixing.marginals(table, min_share=0.0).collect()
    assert sum(r.dimension == "source" for r in shares) == 102 and max(abs(r.expected - r.target) for r in shares) < 1e-6
    for name in ("rake", "rake_table"):  # two rounds, equal in both, are enough to compare them
        monkeypatch.setattr(mixing, name, partial(getattr(mixing, name), rounds=2))
    one, other = ({r.doc_id: r for r in mixing.mixing(table, min_share=0.0, collected=n).collect()} for n in (mixing.COLLECTED, 4))
    assert other.keys() == one.keys()
    assert all(other[i].weight == pytest.approx(one[i].weight, rel=1e-6, abs=1e-12) and other[i].expected == pytest.approx(one[i].expected, rel=1e-6) for i in one)


def test_keep_one_decides_by_row(spark):
    """Null ids that link with an id, with each other or with nothing; an id with two texts; repeated rows."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [
        (1, text("a")), (None, near("a")), (None, text("clean")),  # a null id linked to an id; a clean null id stays
        (5, near("a")), (5, text("b")), (6, near("b")), (None, text("b")),  # an id with two texts: the second one is its group's first
        (None, text("c")), (None, near("c")), (None, text("c")),  # a group without ids keeps one row
        (9, text("d")), (9, text("d")), (9, near("d")), (10, text("d")),  # repeats of the smallest id: one row
        (11, None), (11, None), (None, ""),  # no shingles: all stay
    ]
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80).collect())
    groups = Counter((i, t.split()[0] if t else t) for i, t in kept.elements())
    assert groups == Counter({(1, "a0"): 1, (None, "clean0"): 1, (5, "b0"): 1, (None, "c0"): 1, (9, "d0"): 1, (11, None): 2, (None, ""): 1})


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before wrote, on the smallest tables with planted copies, near copies, nulls and empty texts."""
    import re

    from corpus_pipeline import COLUMNS, STAGES

    from cairnspark.llm.common import stored
    from cairnspark.llm.queries import QUERIES

    words_of = re.compile(r"[^\x20\x09-\x0D]+")

    def lower(text):
        return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")

    table = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    ids = [r.doc_id for r in table.orderBy("doc_id").select("doc_id").collect()]
    one = table.where(F.col("doc_id") == ids[3]).first()
    planted = [(ids[-1] + 1, one.text.upper()), (ids[-1] + 2, one.text), (ids[-1] + 3, one.text + " tail"), (ids[-1] + 4, None), (ids[-1] + 5, "")]
    docs = table.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], table.schema))
    scores = {r.doc_id: r.predicted for r in next(q for n, q in QUERIES.items() if n.startswith("op5_"))(spark, SF).collect()}

    out, seen = docs, []
    for _, stage in STAGES:
        out = stored(stage(spark, out, SF), "stage-test")
        seen.append(out)
    before = [docs, *seen[:-1]]
    assert all(s.columns == list(COLUMNS) for s in seen[:-1])
    rows = [[tuple(r) for r in s.collect()] for s in (*before, seen[-1])]

    assert {r[0] for r in rows[1]} & set(ids) == {i for i in ids if not scores[i]}
    last = {}
    for r in rows[1]:
        last[lower(r[1])] = max(last.get(lower(r[1]), -1), r[0])
    assert sorted(r[0] for r in rows[2]) == sorted(last.values())

    sets = {}
    for r in rows[2]:
        w = words_of.findall(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(sets) > len({root(i) for i in sets})
    assert sorted(r[0] for r in rows[3]) == sorted({root(i) for i in sets})

    assert set(rows[4]) <= set(rows[3]) and rows[4]
    texts, pieces, sequences = {r[0]: ids_of(r[1]) for r in rows[4]}, Counter(), {}
    for r in seen[-1].collect():
        assert r.ids_crc32 == crc(texts[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == Counter({i: n * len(texts[i]) for i, n in Counter(r[0] for r in rows[4]).items()})
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_blocks_and_shards_of_empty_texts_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 50)
    monkeypatch.setattr(token_shards, "SHARD_DOCS", 70)
    monkeypatch.setattr(token_shards, "READ_DOCS", 16)
    monkeypatch.setattr("cairnspark.llm.common.BATCH_ROWS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "").alias("text"))
        blocks = token_counts._blocks(rows.withColumn("n_bytes", F.lit(0).cast("long")), "word_bpe_49k.json", 16, 1 << 24)
        assert blocks.select(F.max(F.size("doc_id"))).first()[0] <= 70 and blocks.select(F.sum(F.size("doc_id"))).first()[0] == 400
        manifest = token_shards.write_shards(rows, f"file://{tmp_path}/shards", "byte_bpe_50k.json", shards=2)
        assert manifest.agg(F.max("n_docs")).first()[0] <= 70
        found = token_shards.read_shards(manifest, f"file://{tmp_path}/shards").orderBy("doc_id").collect()
        assert [(r.doc_id, r.start, r.n_tokens) for r in found] == [(i, i, 1) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_language_sample_is_bounded(spark, monkeypatch):
    """More languages than texts, and few languages with many: never more than max_texts reach the driver, and each language has its share."""
    seen = []
    monkeypatch.setattr(string_kernel.StringKernel, "fit", lambda texts, langs, *a, **k: seen.append(Counter(langs)))
    many = spark.range(3000).select(F.concat(F.lit("text number "), F.col("id")).alias("text"), (F.col("id") % 1000).cast("string").alias("lang"))
    few = many.withColumn("lang", (F.col("text").substr(-1, 1).cast("int") % 3).cast("string"))
    string_kernel.fit_language_id(many, max_texts=200)
    string_kernel.fit_language_id(many, max_texts=2500)
    string_kernel.fit_language_id(few, per_language=50, max_texts=120)
    assert [sum(c.values()) for c in seen] == [200, 2000, 120] and [set(c.values()) for c in seen] == [{1}, {2}, {40}]
