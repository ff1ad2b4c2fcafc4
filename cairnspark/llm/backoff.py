"""LM scoring (6): a weighted backoff automaton over smoothed n-grams, gathered block by block.

The model is as large as the corpus and never sits in one place. Documents are gathered into blocks as they
lie in the table; each block asks, once for every distinct n-gram it has, how often the training documents have it; hash
ranges of n-grams add the counts up and answer where other blocks have contributed. With the answers a block builds the
states, arcs and failure arcs that its texts can reach, and runs its texts through them from left to right.

Blocks and ranges both grow with the input, so they meet in steps: a block asks at most 2^FAN_BITS nodes, each of which
adds up one range for one group of blocks and asks in turn, for all of them, nodes of finer ranges and larger groups.
The last nodes have one range for all blocks, and the answers go back the same way. A node holds about as many n-grams
as a block at every step, and there are log2(blocks) / FAN_BITS steps: one up to 50 GB of text, two up to 400 TB.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, even_steps, leading_bits, map_arrow, stored

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
END = b"\n"  # no word has it
#: Bits of an n-gram's key: of 10^9 n-grams about one in 10^8 shares another one's key.
KEY_BITS = 56
#: Bytes of text in a block, about; one longer text is a block of its own.
BLOCK_BYTES = 6_000_000
#: Documents of a block; their texts may be empty.
BLOCK_DOCS = 100_000
#: Bits of ranges, and of groups of blocks, that one step of asking tells apart. With 13 a block's parts have some 100 n-grams
#: and take about 29 % more bytes than with 9, while a further step would send all of them again.
FAN_BITS = 13
_BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, sizes array<long>, words binary, tokens binary"
#: From the block or node ``source``, to the node of an order, a group of blocks and a range (bucket).
_PARTS = "order int, grp long, bucket int, source long, keys binary, counts binary, tokens long, types long"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, byte planes apart, compressed: planes of small numbers' high bytes vanish."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, bits: int, prefix: int = 0, known: int = 0) -> np.ndarray:
    """Where each hash range of ``bits`` bits begins among sorted keys that all begin with the ``known`` bits of ``prefix``, and their end."""
    first, last = prefix << (bits - known), (prefix + 1) << (bits - known)
    inner = np.searchsorted(keys, np.arange(first + 1, last, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
    return np.concatenate([[0], inner, [len(keys)]])


class BlockTexts:
    """The documents of a block as one row: distinct words as 64-bit values, and each token as a number among them. Bounded by the block's text."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {END: 0}
        self.doc_ids: list = []
        self.held_out: list[bool] = []
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id, text: str | None, held_out: bool) -> None:
        numbers = self.numbers
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        self.tokens.append(np.fromiter([*(numbers.setdefault(w, len(numbers)) for w in words), 0], np.uint32, len(words) + 1))
        self.doc_ids.append(doc_id)
        self.held_out.append(held_out)

    def batch(self, block: int) -> pa.RecordBatch:
        import xxhash
        import zstandard

        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        tokens = np.concatenate(self.tokens).astype("<u4")
        planes = zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes())
        row = (block, self.doc_ids, self.held_out, [len(t) for t in self.tokens], words.tobytes(), planes)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], _names(_BLOCKS))


class BlockGrams:
    """The n-grams of a block's documents: for each order their sorted distinct keys, each token's place among them (-1: too near the
    start), and their counts in the block's training documents."""

    def __init__(self, words: bytes, tokens: bytes, sizes: list[int], held_out: list[bool], order: int):
        import zstandard

        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.uint8).reshape(4, -1)
        word = np.frombuffer(words, np.uint64)[np.ascontiguousarray(planes.T).view("<u4").ravel()]
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        train = np.repeat(~np.array(held_out, bool), self.sizes)
        depth = np.arange(len(word)) - np.repeat(self.starts, self.sizes)
        self.keys, self.places, self.counts = [], [], []
        key = word
        for n in range(1, order + 1):
            if n > 1:
                longer = np.zeros_like(word)
                longer[1:] = (key[:-1] ^ (key[:-1] >> np.uint64(32))) * _A + word[1:] * _B
                key = longer
            usable = np.flatnonzero(depth >= n - 1)
            keys, inverse = np.unique(key[usable] >> np.uint64(64 - KEY_BITS), return_inverse=True)
            places = np.full(len(word), -1, np.int32)
            places[usable] = inverse
            self.keys.append(keys)
            self.places.append(places)
            self.counts.append(np.bincount(inverse[train[usable]], minlength=len(keys)).astype(np.int64))


class BackoffAutomaton:
    """States, arcs and failure arcs of the n-grams of a block, from their counts in all training documents.

    A state is a history of up to order - 1 tokens that training documents have; the root is the empty one. From a
    state h an arc leads to each token w that follows it there, with log10 P(w|h) as its weight; where there is none, the
    failure arc leads to the state of the history without its first token, with log10(k / (c(h) + k)) as its weight. The
    root has an arc for every token. P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); P(w|h) = (c(hw) + k P(w|shorter h)) / (c(h) + k).
    An arc of the longest n-grams leads to the state of their last order - 1 tokens.
    """

    def __init__(self, grams: BlockGrams, tokens: int, types: int, k: float):
        self.order, self.places, self.counts = len(grams.keys), grams.places, grams.counts
        self.weight, self.failure, self.shorter = [], [], []  # by order and n-gram: of its arc, of its state's failure arc, where that leads
        probability = None
        for n, (places, counts) in enumerate(zip(grams.places, grams.counts, strict=True), 1):
            if n == 1:
                shorter = np.zeros(len(counts), np.int32)
                probability = (counts + 0.1) / (tokens + 0.1 * (types + 1))
            else:
                at = np.flatnonzero(places >= 0)
                shorter, history = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
                shorter[places[at]] = grams.places[n - 2][at]
                history[places[at]] = grams.places[n - 2][at - 1]
                probability = (counts + k * probability[shorter]) / (grams.counts[n - 2][history] + k)
            self.weight.append(np.log10(probability))
            self.failure.append(np.log10(k / (counts + k)))
            self.shorter.append(shorter)

    def _step(self, at: np.ndarray, order: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Reads the token at each place from each state (``state`` among those of ``order``; both are moved on); the weights, failure arcs included."""
        out = np.zeros(len(at))
        after, moved = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for n in range(self.order, 1, -1):
            here = np.flatnonzero(order == n - 1)
            if not len(here):
                continue
            arc = self.places[n - 1][at[here]]
            there = self.counts[n - 1][arc] > 0
            found, arc = here[there], arc[there]
            out[found] += self.weight[n - 1][arc]
            after[found], moved[found] = (n, arc) if n < self.order else (n - 1, self.shorter[n - 1][arc])
            order[found] = -1
            failed = here[~there]
            out[failed] += self.failure[n - 2][state[failed]]
            state[failed] = self.shorter[n - 2][state[failed]]
            order[failed] = n - 2
        here = np.flatnonzero(order == 0)
        arc = self.places[0][at[here]]
        out[here] += self.weight[0][arc]
        known = self.counts[0][arc] > 0
        after[here], moved[here] = known & (self.order > 1), arc
        order[:], state[:] = after, moved
        return out

    def traverse(self, starts: np.ndarray, sizes: np.ndarray, stretch: int = 256) -> np.ndarray:
        """The weight of each token on the path of its text, all texts side by side from left to right.

        A state depends on order - 1 tokens at most, so a long text is run in stretches: each is led in from
        the root by the order - 1 tokens before it, whose weights don't count.
        """
        parts = -(-sizes // stretch)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lead = np.where(number > 0, self.order - 1, 0)
        begin = np.repeat(starts, parts) + number * stretch - lead
        length = np.minimum(np.repeat(sizes, parts) - number * stretch, stretch) + lead
        by_length = np.argsort(-length, kind="stable")
        begin, length, lead = begin[by_length], length[by_length], lead[by_length]
        order, state = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        out = np.zeros(int(sizes.sum()))
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, side="left"))
            at = begin[:active] + t
            weights = self._step(at, order[:active], state[:active])
            counted = t >= lead[:active]
            out[at[counted]] = weights[counted]
        return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(_KINDS), _KINDS, strict=True)], _names(_PARTS))


def _asked(order: int, group: int, source: int, keys: np.ndarray, counts: np.ndarray, bits: int, prefix: int = 0, known: int = 0) -> pa.Table:
    """What a block or node asks: its keys and counts, a part for each range."""
    edges, first = bucket_edges(keys, bits, prefix, known), prefix << (bits - known)
    parts = [(first + b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)).tolist()]
    return _table([(order, group, b, source, packed_keys(keys[at]), packed(counts[at]), 0, 0) for b, at in parts])


class Node:
    """The parts that came to a node: their distinct keys, and the sums of their counts."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.keys = [unpacked_keys(x) for x in table.column("keys").to_pylist()]
        self.counts = [unpacked(x).astype(np.int64) for x in table.column("counts").to_pylist()]
        self.distinct, self.inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.totals = np.bincount(self.inverse, np.concatenate(self.counts), len(self.distinct)).astype(np.int64)

    def answers(self) -> list[tuple]:
        """For each part the totals that differ from its own counts."""
        rows, at = [], 0
        for n, bucket, source, x, c in zip(*(self.table.column(x).to_pylist() for x in ("order", "bucket", "source")), self.keys, self.counts, strict=True):
            total = self.totals[self.inverse[at : at + len(x)]]
            at += len(x)
            more = total != c
            if more.any():
                # who asked has the same keys in the same order: a bit for each tells which ones get a total
                rows.append((n, 0, bucket, source, np.packbits(more).tobytes(), packed(total[more]), 0, 0))
        return rows


def _take(counts: np.ndarray, edges: np.ndarray, place: int, more: bytes, given: bytes) -> None:
    """Writes the totals of one answer over the counts that were asked for in the range at ``place``."""
    at = slice(edges[place], edges[place + 1])
    differ = np.unpackbits(np.frombuffer(more, np.uint8))[: at.stop - at.start].astype(bool)
    counts[at][differ] = unpacked(given)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    def gather(batches):
        number, block, held = TaskContext.get().partitionId() << 32, BlockTexts(), 0
        for batch in by_bytes(batches, 1):
            for doc_id, text, held_out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block.add(doc_id, text, bool(held_out))
            held += batch.column(1).nbytes
            if held >= block_bytes or len(block.doc_ids) >= BLOCK_DOCS:
                yield block.batch(number)
                number, block, held = number + 1, BlockTexts(), 0
        if block.doc_ids:
            yield block.batch(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    return stored(rows.transform(map_arrow, gather, _BLOCKS), "lm-blocks")


def score_corpus(docs: DataFrame, order: int = 3, k: float = 2.0, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    ``docs`` has doc_id, text and held_out; rows where held_out is false are learned from. Tokens are words
    and one end for each document. Null text counts as empty: its end alone. Repeated rows and null ids
    are documents of their own; other columns are ignored; an empty table gives no rows. If nothing is
    learned, every token has probability 1 under the base, as its formula says for N = V = 0.
    """
    blocks = _blocks(docs, block_bytes)
    bits = max(1, (max(1, blocks.count()) - 1).bit_length())

    def grams_of(row: dict) -> BlockGrams:
        return BlockGrams(row["words"], row["tokens"], row["sizes"], row["held_out"], order)

    steps = even_steps(bits, fan_bits)
    told = list(accumulate(steps))

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = grams_of(row)
                for n, (keys, counts) in enumerate(zip(grams.keys, grams.counts, strict=True), 1):
                    yield from _asked(n, row["grp"], row["block"], keys, counts, told[0]).to_batches()

    def ask_on(step: int):
        def ask(table: pa.Table) -> pa.Table:
            order_, group, bucket = (table.column(x)[0].as_py() for x in ("order", "grp", "bucket"))
            node = Node(table)
            return _asked(order_, group >> steps[step], group, node.distinct, node.totals, told[step], bucket, told[step - 1])

        return ask

    def answer(table: pa.Table) -> pa.Table:
        node = Node(table)
        totals = (table.column("order")[0].as_py(), 0, 0, -1, b"", b"", int(node.totals.sum()), int((node.totals > 0).sum()))
        return _table([*node.answers(), totals])

    def answer_back(step: int):
        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            node, bucket = Node(left), left.column("bucket")[0].as_py()
            edges, first = bucket_edges(node.distinct, told[step], bucket, told[step - 1]), bucket << steps[step]
            for part, more, given in zip(*(right.column(x).to_pylist() for x in ("part", "keys", "counts")), strict=True):
                _take(node.totals, edges, part - first, more, given)
            return _table(node.answers())

        return answer

    place = ["order", "grp", "bucket"]
    asks = [blocks.withColumn("grp", leading_bits("block", bits - told[0])).transform(map_arrow, ask, _PARTS)]
    for step in range(1, len(steps)):
        asks[-1] = stored(asks[-1], "ngrams-asked")
        asks.append(asks[-1].groupBy(*place).applyInArrow(ask_on(step), _PARTS))
    answers = stored(asks[-1].groupBy(*place).applyInArrow(answer, _PARTS), "ngram-counts")
    sums = answers.where("source = -1 and order = 1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = grams_of(row)
        edges = [bucket_edges(keys, told[0]) for keys in grams.keys]
        for n, bucket, more, given in zip(*(right.column(x).to_pylist() for x in ("order", "bucket", "keys", "counts")), strict=True):
            _take(grams.counts[n - 1], edges[n - 1], bucket, more, given)
        grams.keys = [None] * order  # places and counts are all that is needed from here on
        automaton = BackoffAutomaton(grams, tokens, types, k)
        arcs = automaton.traverse(grams.starts, grams.sizes)
        known, base = grams.counts[0][grams.places[0]] > 0, automaton.weight[0][grams.places[0]]
        sums = [np.add.reduceat(x, grams.starts) for x in (known.astype(np.int64), base, arcs)]
        n = len(grams.sizes)
        columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(grams.sizes), pa.array(sums[0]), pa.array(np.full(n, tokens)), pa.array(np.round(sums[1], 6)), pa.array(np.round(sums[2], 6))]
        return pa.Table.from_arrays(columns, _names(SCORES))

    answers = answers.where("source >= 0")
    for step in range(len(steps) - 1, 0, -1):
        given = answers.select("order", F.col("source").alias("grp"), F.shiftright("bucket", steps[step]).alias("bucket"), F.col("bucket").alias("part"), "keys", "counts")
        answers = asks[step - 1].groupBy(*place).cogroup(given.groupBy(*place)).applyInArrow(answer_back(step), _PARTS)
    given = answers.select(F.col("source").alias("block"), "order", "bucket", "keys", "counts")
    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, SCORES)


SQL = r"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS ws
  FROM documents
), f AS (SELECT doc_id, {fold} AS held_out FROM documents
), t AS (SELECT doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d JOIN f USING (doc_id)
), b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS h, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM t
), c1 AS (SELECT w, count(*) AS c FROM b WHERE NOT held_out GROUP BY w
), c2 AS (SELECT h, w, count(*) AS c FROM b WHERE NOT held_out AND h IS NOT NULL GROUP BY h, w
), c3 AS (SELECT g, h, w, count(*) AS c FROM b WHERE NOT held_out AND g IS NOT NULL GROUP BY g, h, w
), z AS (SELECT sum(c) AS n, count(*) AS v FROM c1
), p AS (
  SELECT b.doc_id, b.held_out, coalesce(c1.c, 0) AS c, (coalesce(c1.c, 0) + 0.1::DOUBLE) / (z.n + 0.1::DOUBLE * (z.v + 1)) AS p1, z.n,
    coalesce(ch.c, 0) AS ch, coalesce(c2.c, 0) AS chw, coalesce(cgh.c, 0) AS cgh, coalesce(c3.c, 0) AS cghw
  FROM b CROSS JOIN z LEFT JOIN c1 ON c1.w = b.w LEFT JOIN c1 ch ON ch.w = b.h LEFT JOIN c2 ON c2.h = b.h AND c2.w = b.w
  LEFT JOIN c2 cgh ON cgh.h = b.g AND cgh.w = b.h LEFT JOIN c3 ON c3.g = b.g AND c3.h = b.h AND c3.w = b.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10((cghw + 2.0::DOUBLE * (chw + 2.0::DOUBLE * p1) / (ch + 2.0::DOUBLE)) / (cgh + 2.0::DOUBLE))), 6) AS score
FROM p GROUP BY doc_id, held_out
"""
