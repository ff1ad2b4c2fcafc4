"""Token counts (4): pieces once per distinct pre-token, joined to per-document pre-token frequencies, and summed without ids.

A block of documents names its distinct pre-tokens once, and each of its documents has their frequencies as numbers
into that list. Hash ranges of pre-tokens count the pieces of each distinct one, for all blocks, and answer
every block with a list of counts; a block's documents are then products of frequencies and counts.

Blocks and ranges both grow with the input, so they meet in steps: a block asks at most 2^FAN_BITS nodes, each of which
has one range for one group of blocks and asks in turn, once for all of them, nodes of finer ranges and larger groups.
The last nodes have one range for all blocks and count; the answers go back the same way.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, even_steps, leading_bits, map_arrow, stored
from cairnspark.llm.encoders import WORDS, word_pieces

#: Bytes of text whose documents share a list of distinct pre-tokens.
BLOCK_BYTES = 16 << 20
#: Documents of a block; their texts may be empty.
BLOCK_DOCS = 100_000
#: Distinct pre-tokens, counted once for each block that has them, that a hash range has at most, about.
RANGE_WORDS = 1_000_000
#: Bits of ranges, and of groups of blocks, that one step of asking tells apart: one step up to 160 GB of text, two beyond.
FAN_BITS = 13
_BLOCKS = "block long, doc_id array<long>, n_bytes array<long>, kinds array<int>, whole array<long>, words array<binary>, ranges array<int>, sizes array<int>, places binary, times binary"


def in_ranges(words: list[str], bits: int) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """The order of distinct pre-tokens by hash range of ``bits`` bits, then by text; the ranges that have any, where each begins and all end, and each range's words compressed."""
    import xxhash

    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) >> np.uint64(64 - bits)
    order = sorted(range(len(words)), key=lambda i: (hashed[i], words[i]))
    ranges, starts = np.unique(hashed[order], return_index=True)
    edges = [*starts.tolist(), len(words)]
    packed = [zlib.compress("\n".join(words[i] for i in order[a:b]).encode("utf-8", "surrogatepass"), 1) for a, b in zip(edges, edges[1:], strict=False)]
    return order, ranges.astype(np.int32).tolist(), edges, packed


def unpacked(words: bytes) -> list[str]:
    return zlib.decompress(words).decode("utf-8", "surrogatepass").split("\n")


class Block:
    """The documents of a block: for each its distinct pre-tokens, as numbers in order of first sight, and how often it has them."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.doc_ids: list = []
        self.n_bytes: list[int] = []
        self.kinds: list[int] = []  # distinct pre-tokens of each document
        self.whole: list[int] = []  # tokens of texts that can't be counted by pre-tokens
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id, n_bytes: int, words: list[str], whole: int) -> None:
        numbers = self.numbers
        seen = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
        places, times = np.unique(seen, return_counts=True)
        self.doc_ids.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.whole.append(whole)
        self.kinds.append(len(places))
        self.places.append(places.astype(np.uint32))
        self.times.append(times.astype(np.uint32))

    def row(self, block: int, bits: int) -> tuple:
        """One row: the lists, and the distinct pre-tokens by hash range, each range sorted and compressed."""
        order, ranges, edges, packed = in_ranges(list(self.numbers), bits)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        places = rank[np.concatenate(self.places)] if self.places else np.zeros(0, np.uint32)
        times = np.concatenate(self.times) if self.times else np.zeros(0, np.uint32)
        return (block, self.doc_ids, self.n_bytes, self.kinds, self.whole, packed, ranges, np.diff(edges).tolist(), zlib.compress(places.astype("<u4").tobytes(), 1), zlib.compress(times.astype("<u4").tobytes(), 1))


def _blocks(docs: DataFrame, tokenizer: str, bits: int, block_bytes: int) -> DataFrame:
    def tally(batches):
        counter, number = word_pieces(tokenizer), TaskContext.get().partitionId() << 32
        block, held = Block(), 0

        def batch_of(rows):
            schema = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(rows, schema, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in by_bytes(batches, 1):
            for doc_id, text, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                alone = counter.whole or any(" " in s for s in counter.special)
                block.add(doc_id, n, WORDS(text) if text and not alone else [], counter.count(text) if text and alone else 0)
                held += n
            if held >= block_bytes or len(block.doc_ids) >= BLOCK_DOCS:
                yield batch_of(block.row(number, bits))
                block, held, number = Block(), 0, number + 1
        if block.doc_ids:
            yield batch_of(block.row(number, bits))

    return stored(docs.transform(map_arrow, tally, _BLOCKS), "pretoken-blocks")


def _answered(table: pa.Table, count) -> pa.Table:
    """For each part that came to a node, the counts of its words."""
    counts = [zlib.compress(np.array([count(w) for w in unpacked(words)], "<u4").tobytes(), 1) for words in table.column("words").to_pylist()]
    return pa.table([table.column("source"), table.column("range"), pa.array(counts, pa.binary())], ["source", "range", "counts"])


def _answers(blocks: DataFrame, tokenizer: str, steps: list[int]) -> DataFrame:
    """(block, range, counts): pieces of the pre-tokens that a block has in a range, each distinct one counted once for all blocks."""
    known = list(accumulate(steps))
    place = ["grp", "range"]

    def words_of(table: pa.Table) -> list[str]:
        return sorted(set().union(*map(unpacked, table.column("words").to_pylist())))

    def ask_on(step: int):
        def ask(table: pa.Table) -> pa.Table:
            group = table.column("grp")[0].as_py()
            _, ranges, _, packed = in_ranges(words_of(table), known[step])
            return pa.table([pa.array([x] * len(ranges), pa.int64()) for x in (group, group >> steps[step])] + [pa.array(ranges, pa.int32()), pa.array(packed, pa.binary())], ["source", "grp", "range", "words"])

        return ask

    def answer(table: pa.Table) -> pa.Table:
        counter, counted = word_pieces(tokenizer), {}

        def count(word: str) -> int:
            if word not in counted:
                counted[word] = counter.count(word)
            return counted[word]

        return _answered(table, count)

    def answer_back(step: int):
        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            words = words_of(left)
            order, ranges, _, _ = in_ranges(words, known[step])
            given = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True))
            counts = np.concatenate([np.frombuffer(zlib.decompress(given[r]), "<u4") for r in ranges]).tolist()
            return _answered(left, dict(zip((words[i] for i in order), counts, strict=True)).__getitem__)

        return answer

    asked = blocks.select("block", F.explode(F.arrays_zip("ranges", "words")).alias("a"))
    asks = [asked.select(F.col("block").alias("source"), leading_bits("block", sum(steps) - known[0]).alias("grp"), F.col("a.ranges").alias("range"), F.col("a.words").alias("words"))]
    for step in range(1, len(steps)):
        asks.append(asks[-1].groupBy(*place).applyInArrow(ask_on(step), "source long, grp long, range int, words binary"))
        if step < len(steps) - 1:
            asks[-1] = stored(asks[-1], "pretokens-asked")
    answers = asks[-1].groupBy(*place).applyInArrow(answer, "source long, range int, counts binary")
    for step in range(len(steps) - 1, 0, -1):
        given = answers.select(F.col("source").alias("grp"), F.shiftright("range", steps[step]).alias("range"), F.col("range").alias("part"), "counts")
        answers = asks[step - 1].groupBy(*place).cogroup(given.groupBy(*place)).applyInArrow(answer_back(step), "source long, range int, counts binary")
    return answers.withColumnRenamed("source", "block")


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs``.

    A pre-token, here a run without white space, is encoded once for the whole table; each document's frequencies
    are joined to the counts and summed. A pre-token that holds a special string is counted by the library,
    with its default handling of such strings. For vocabularies whose pieces may span white space the library
    counts the whole text.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # A block has a new pre-token every 20 bytes or so; the ranges grow with the input, and so stay bounded.
    steps = even_steps(max(4, (-(-total // (20 * RANGE_WORDS)) - 1).bit_length()), fan_bits)
    blocks = _blocks(rows, tokenizer, steps[0], block_bytes)
    answers = _answers(blocks, tokenizer, steps)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        given = dict(zip(right.column("range").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([np.frombuffer(zlib.decompress(given[r]), "<u4") for r in row["ranges"]]).astype(np.int64) if row["ranges"] else np.zeros(0, np.int64)
        places, times = (np.frombuffer(zlib.decompress(row[c]), "<u4") for c in ("places", "times"))
        pieces = np.concatenate([[0], np.cumsum(counts[places] * times)]).astype(np.int64)
        ends = np.cumsum(row["kinds"], dtype=np.int64)
        n_tokens = pieces[ends] - pieces[ends - np.array(row["kinds"], np.int64)] + np.array(row["whole"], np.int64)
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    held = blocks.select("block", "doc_id", "n_bytes", "kinds", "whole", "ranges", "places", "times")
    counted = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
