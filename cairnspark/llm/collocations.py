"""Phrase collocation mining (13): mergeable Misra-Gries summaries for each hash partition, then exact counts.

A first pass hashes every contiguous phrase and deals its counts over partitions of the hash space. Each partition keeps a
Misra-Gries summary whose capacity exceeds its mass divided by the least frequency, so every phrase that is frequent
enough survives. A second pass counts the survivors by their text; what only seemed frequent falls away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, stored
from cairnspark.llm.words import mixed

#: Characters that end a word within a piece, and those that end a piece.
_GAP, _PIECE = b" \t", b".,;:!?\n\v\f\r"
_IS_PIECE = np.isin(np.arange(256), list(_PIECE))
_IS_WORD = ~np.isin(np.arange(256), list(_GAP + _PIECE))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = np.random.default_rng(20250113).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are cut at once, a longer word aside.
CHUNK = 1 << 20
#: Phrases whose hashes a task gathers before it counts them.
FLUSH = 1 << 22
#: Phrases, repeats included, that a partition of the hash space has on average.
MASS = 1 << 22
#: Counters of a summary; it has to exceed MASS divided by the least frequency.
CAPACITY = 1 << 20
#: Most bits of the filter of survivors that goes to every task: 16 MB. A survivor has 16 bits as long as they fit;
#: in a filter that is fuller more phrases are counted by their text and then fall away, which costs time alone.
FILTER_BITS = 1 << 27
_ROW = 1 << 15
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        for name, x in (("up", _STEP), ("down", _BACK)):
            row = np.full(max(n, CHUNK + 1), x, np.uint64)
            row[0] = 1
            _power[name] = np.cumprod(row)
    return _power["up"][:n], _power["down"]


class Window:
    """The words of some bytes: where they start and end, 64-bit values, and a number that is the same within a piece of a text only."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, new_from: int = 0):
        self.data = data = _LOWER[data]
        word, edge = _IS_WORD[data], np.zeros(len(data) + 1, bool)
        edge[edges] = True
        before, after = np.concatenate([[False], word]), np.concatenate([word, [False]])
        self.starts, self.ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
        self.values = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.row = np.searchsorted(edges, self.starts, side="right") - 1
        self.piece = np.cumsum(_IS_PIECE[data])[self.starts] + self.row if len(data) else self.row
        #: Phrases count where their last word does, from this one on; the words before were in the window before.
        self.first_new = int(np.searchsorted(self.starts, new_from))

    def phrases(self, salts: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, first words, hashes) of all phrases of 1 to ``most`` words; ``salts`` are those of the rows' languages."""
        h = mixed(self.values ^ salts[self.row])
        for n in range(1, most + 1):
            count = len(self.values) - n + 1
            if count <= 0:
                return
            if n > 1:
                h = mixed(h[:count] * _NEXT + self.values[n - 1 :])
            at = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :])
            at = at[at + n > self.first_new]
            yield n, at, h[at]

    def tail(self, words: int) -> np.ndarray:
        """The last words with one byte after each: a space, or a full stop where the piece ends."""
        some = range(max(0, len(self.starts) - words), len(self.starts))
        ends = [bool(_IS_PIECE[self.data[self.ends[i] : self.starts[i + 1] if i + 1 < len(self.starts) else None]].any()) for i in some]
        return np.frombuffer(b"".join(self.data[self.starts[i] : self.ends[i]].tobytes() + (b"." if end else b" ") for i, end in zip(some, ends, strict=True)), np.uint8)

    def texts(self, n: int, at: np.ndarray) -> list[str]:
        """The phrases of ``n`` words that start at the words ``at``, joined by single spaces."""
        plain = np.ones(len(at), bool)
        for k in range(n - 1):
            plain &= (self.starts[at + k + 1] - self.ends[at + k] == 1) & (self.data[self.ends[at + k]] == 32)
        whole = self.data.tobytes()
        spans = zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), plain.tolist(), strict=True)
        return [(whole[a:b] if p else b" ".join(whole[a:b].split())).decode() for a, b, p in spans]


def windows(batch: pa.RecordBatch, most: int) -> Iterator[tuple[Window, pa.Array]]:
    """The windows of ``batch`` (lang, text, of about CHUNK bytes or one text), and the languages of their rows."""
    langs = pc.fill_null(batch.column(0), "und")
    column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) <= CHUNK:
        yield Window(data, offsets[:-1] - offsets[0]), langs
        return
    for row in range(len(column)):
        text = data[offsets[row] - offsets[0] : offsets[row + 1] - offsets[0]]
        lead, at = np.zeros(0, np.uint8), 0
        while at < len(text):
            stop = min(len(text), at + CHUNK)
            while stop < len(text) and _IS_WORD[text[stop - 1]]:  # a window ends after a gap
                gaps = np.flatnonzero(~_IS_WORD[text[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                stop = min(len(text), stop + CHUNK)
            window = Window(np.concatenate([lead, text[at:stop]]), np.zeros(1, np.int64), len(lead))
            yield window, langs.slice(row, 1)
            lead, at = window.tail(most - 1), stop


def _salts(langs: pa.Array) -> np.ndarray:
    import xxhash

    kinds = langs.dictionary_encode()
    values = np.array([xxhash.xxh64_intdigest(x.encode()) for x in kinds.dictionary.to_pylist()] or [0], np.uint64)
    return values[kinds.indices.to_numpy(zero_copy_only=False)]


def _place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of a hash, and the 32 bits that name it there."""
    part = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    return part, (h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)


def partial_counts(docs: DataFrame, most: int, bits: int) -> DataFrame:
    """part, keys, counts (binary): the phrases of FLUSH phrases that a task met one after the other, one row for each partition of the hash space."""
    names, kinds = ["part", "keys", "counts"], [pa.int64(), pa.binary(), pa.binary()]

    def scan(batches):
        held: list[np.ndarray] = []
        size = 0

        def counted():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            times = -(-counts // 255)  # a count is a byte; a larger one is several entries
            last = np.cumsum(times) - 1
            small = np.full(int(times.sum()), 255, np.uint8)
            small[last] = counts - 255 * (times - 1)
            part, name = _place(np.repeat(keys, times), bits)
            cuts = np.flatnonzero(np.diff(part)) + 1
            groups = [part[np.concatenate([[0], cuts])].astype(np.int64)]
            payload = [[x.tobytes() for x in np.split(y, cuts)] for y in (name.astype("<u4"), small)]
            for at in range(0, len(groups[0]), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 64], k) for x, k in zip((groups[0], *payload), kinds, strict=True)], names)

        for batch in by_bytes(batches, 1, CHUNK):
            for window, langs in windows(batch, most):
                for _, _, h in window.phrases(_salts(langs), most):
                    held.append(h)
                    size += len(h)
                if size >= FLUSH:
                    yield from counted()
                    held, size = [], 0
        if size:
            yield from counted()

    return docs.transform(map_arrow, scan, "part long, keys binary, counts binary")


class Summary:
    """A mergeable Misra-Gries summary. A key's true count is at most its counter plus ``deducted``, also where it has no counter."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.deducted = capacity, least, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size >= self.capacity:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.held)])
        self.held, self.size = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        if len(self.keys) > self.capacity:
            # Where a partition has more mass than was planned, the summary grows, so that it never deducts ``least`` in all.
            place = len(self.keys) - self.capacity - 1
            less = min(int(np.partition(self.counts, place)[place]), self.least - 1 - self.deducted)
            self.deducted += less
            self.counts = self.counts - less
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]

    def survivors(self) -> np.ndarray:
        """All keys with a true count of ``least`` or more, and few others."""
        self.merge()
        return self.keys[self.counts + self.deducted >= self.least]


def frequent_hashes(partial: DataFrame, least: int, partitions: int) -> DataFrame:
    """part, keys (binary) of the phrases that may be there ``least`` times or more."""
    capacity = max(CAPACITY, MASS // least + 1)

    def summarise(batches):
        summary, at = Summary(capacity, least), None

        def ended():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([summary.survivors().tobytes()], pa.binary())], ["part", "keys"])

        for batch in batches:
            for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != at:
                    if at is not None:
                        yield ended()
                    summary, at = Summary(capacity, least), part
                summary.add(np.frombuffer(keys.as_buffer(), "<u4").copy(), np.frombuffer(counts.as_buffer(), np.uint8).copy())
        if at is not None:
            yield ended()

    dealt = partial.repartition(partitions, "part").sortWithinPartitions("part")
    return stored(dealt.transform(map_arrow, summarise, "part long, keys binary"), "frequent-phrases")


def _slots(part: np.ndarray, name: np.ndarray, size: int) -> np.ndarray:
    return (mixed((part << np.uint64(32)) ^ name) & np.uint64(size - 1)).astype(np.int64)


def _filter(found: DataFrame) -> np.ndarray:
    """A bitmap of the survivors, packed; FILTER_BITS at most."""
    count = found.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    size = min(FILTER_BITS, max(_ROW, 1 << (16 * (count // 4)).bit_length()))

    def slots(batches):
        for batch in batches:
            for part, keys in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                names = np.frombuffer(keys.as_buffer(), "<u4").astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_slots(np.uint64(part), names, size))], ["slot"])

    rows = found.transform(map_arrow, slots, "slot long").groupBy(F.floor(F.col("slot") / _ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("slot") % _ROW).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():
        bits[r["row"] * _ROW // 8 : (r["row"] + 1) * _ROW // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def exact_counts(docs: DataFrame, most: int, bits: int, survivors: np.ndarray, least: int) -> DataFrame:
    """lang, phrase, f of the phrases that are there ``least`` times or more; with a null phrase, how many words the language has."""
    shared = docs.sparkSession.sparkContext.broadcast(survivors)  # FILTER_BITS at most
    size = len(survivors) * 8

    def count(batches):
        bitmap = shared.value
        totals: dict[tuple[str, str | None], int] = {}

        def flush():
            langs, phrases = zip(*totals, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(totals.values(), pa.int64())], ["lang", "phrase", "f"])

        for batch in by_bytes(batches, 1, CHUNK):
            for window, langs in windows(batch, most):
                names = langs.to_pylist()
                for n, at, h in window.phrases(_salts(langs), most):
                    if n == 1:
                        for row, words in enumerate(np.bincount(window.row[at], minlength=len(names)).tolist()):
                            if words:
                                totals[names[row], None] = totals.get((names[row], None), 0) + words
                    slot = _slots(*_place(h, bits), size)
                    known = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    _, first, times = np.unique(h[known], return_index=True, return_counts=True)
                    at = at[known[first]]
                    for row, phrase, more in zip(window.row[at].tolist(), window.texts(n, at), times.tolist(), strict=True):
                        key = names[row], phrase
                        totals[key] = totals.get(key, 0) + more
                if len(totals) >= 100_000:
                    yield flush()
                    totals = {}
        if totals:
            yield flush()

    counted = docs.transform(map_arrow, count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(counted.where(F.col("phrase").isNull() | (F.col("f") >= least)), "phrase-counts")


def top_per_group(rows: DataFrame, group: str, order: list[Column], top: int, salt: Column, salts: int) -> DataFrame:
    """The first ``top`` rows of each group, with their ``rank``: first within salted shares of a group, then of what those leave."""
    from pyspark.sql import Window as W

    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(salts))).withColumn("rank", place(group, "salt")).where(F.col("rank") <= top)
    return some.withColumn("rank", place(group)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words of ``docs`` (lang, text).

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
    a is the phrase's count, overlaps included, ``least`` or more; n counts all words. A cut after k words gives l and r, the counts
    of its parts, and floor(1000000 a a / (l r)), in exact decimals; the lowest-scoring cut counts, the smallest k of equals.
    Phrases within a longer one that is there ``inside_percent`` % as often or more fall away.

    Phrases are told apart by their text; hashes only choose which are counted, and no frequent one is lost. A null language
    is ``und``; null and empty texts have no words; repeated rows count each; ties go by count, then by the phrase's bytes;
    other columns are ignored; an empty table gives no rows. Long texts are cut in windows; memory follows the longest word.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    phrases = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * max_words // 6
    bits = max(0, math.ceil(math.log2(max(1, phrases / MASS))))
    found = frequent_hashes(partial_counts(docs, max_words, bits), least, 1 << bits)
    counts = exact_counts(docs, max_words, bits, _filter(found), least)

    words = F.split("phrase", " ")
    long = counts.where(F.col("phrase").isNotNull() & (F.size(words) > 1)).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    known = counts.where("phrase is not null")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    spans = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))))
    within = long.where(F.size("words") > 2).select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    salts = max(1, math.isqrt(counts.count() // top))
    best = top_per_group(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.col("phrase"), salts)
    totals = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), c AS (
  SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY ALL
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), q AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE f >= 10 AND contains(phrase, ' ')
), k AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, len(w))) AS k FROM q)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN c l ON l.lang = k.lang AND l.phrase = k.x JOIN c r ON r.lang = k.lang AND r.phrase = k.y
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), z AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM q WHERE len(w) = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n USING (lang) LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE z.a IS NULL OR 100 * z.a < 50 * b.a
QUALIFY rank <= 2000
"""
