"""Best-fit packing (9): swap-based local search over slots, each of which stands for many pieces of about one length.

Pieces are ranked by length and dealt, in that order, into slots of equally many pieces (linear grouping). A slot
is as long as its longest piece, so whatever packs the slots packs all pieces: a bin of slots is as many
sequences as a slot has pieces. There are at most ``SLOTS`` slots however large the input, and up to that many
pieces every slot is one piece. Slots are placed as they come, in a scattered order, by best fit, and then moved and exchanged between
underfull bins until bins are empty.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.common import by_bytes, map_arrow, shuffle_partitions, stored
from cairnspark.llm.encoders import byte_level

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Slots that the local search packs at once, on the driver: bounds its memory and time whatever the input.
SLOTS = 4_096


class Bins:
    """Bins of lengths under one capacity, with what is needed to find exchanges: the sums that would fill a bin, and who wants them."""

    def __init__(self, contents: list[list[int]], capacity: int):
        self.capacity = capacity
        self.items = [Counter(c) for c in contents]
        self.fill = [sum(c) for c in contents]
        self.wants: dict[int, dict[tuple[int, int], None]] = {}  # sum -> (bin, length it gives back for it, 0: none): the bin is full then
        self.under: set[int] = set()
        self.steps: Counter = Counter()
        self._table = None
        for b in range(len(self.items)):
            self._enter(b)

    def _enter(self, b: int) -> None:
        self._table = None
        if 0 < self.fill[b] < self.capacity:
            self.under.add(b)
            for x in (0, *self.items[b]):
                self.wants.setdefault(x + self.capacity - self.fill[b], {})[b, x] = None

    def _leave(self, b: int) -> None:
        self.under.discard(b)
        for x in (0, *self.items[b]):
            self.wants[x + self.capacity - self.fill[b]].pop((b, x), None)

    def _pairs(self, giver: int) -> list[tuple[int, int]]:
        own = sorted(self.items[giver], reverse=True)
        return [(a, c) for i, a in enumerate(own) for c in own[i:] if a != c or self.items[giver][a] > 1]

    def exchange(self, giver: int, taker: int, gives: tuple[int, ...], gets: int) -> None:
        """Moves ``gives`` from one bin to the other, and ``gets`` (0: nothing) back."""
        self.steps["move" if not gets and len(gives) == 1 else "two moves" if not gets else "one for one" if len(gives) == 1 else "two for one"] += 1
        self._leave(giver)
        self._leave(taker)
        self.items[giver].subtract(gives)
        self.items[taker].update(gives)
        if gets:
            self.items[giver][gets] += 1
            self.items[taker][gets] -= 1
        net = sum(gives) - gets
        self.fill[giver] -= net
        self.fill[taker] += net
        self.items[giver], self.items[taker] = +self.items[giver], +self.items[taker]
        self._enter(giver)
        self._enter(taker)

    def exact(self, giver: int) -> tuple[int, tuple[int, ...], int] | None:
        """An exchange of one or else two of the giver's pieces, the longest ones first, that fills another bin which is at least as full."""
        for offers in ([(a,) for a in sorted(self.items[giver], reverse=True)], self._pairs(giver)):
            for gives in offers:
                total, best, gain = sum(gives), None, 0
                for b, x in self.wants.get(total, ()):
                    if total - x > gain and b != giver and self.fill[b] >= self.fill[giver]:
                        best, gain = (b, gives, x), total - x
                if best:
                    return best
        return None

    def near(self, giver: int) -> tuple[int, tuple[int, ...], int] | None:
        """Of the moves and one-for-one exchanges, else of those that give two, into a bin at least as full, the one that raises the sum of squared fills the most."""
        if self._table is None:
            rows = [(b, x, self.capacity - self.fill[b]) for b in sorted(self.under) for x in (0, *self.items[b])]
            self._table = np.array(rows, np.int64).reshape(-1, 3).T
        bins, back, room = self._table
        ahead = self.capacity - room - self.fill[giver]
        other = (bins != giver) & (ahead >= 0)
        for offers in ([(a,) for a in self.items[giver]], self._pairs(giver)):
            best, most = None, 0
            for gives in {sum(g): g for g in offers}.values():
                net = sum(gives) - back
                gain = np.where(other & (net > 0) & (net <= room), net * (ahead + net), 0)
                k = int(gain.argmax())
                if gain[k] > most:
                    best, most = (int(bins[k]), gives, int(back[k])), int(gain[k])
            if best:
                return best
        return None

    def search(self) -> None:
        """Empties bins: the emptier one gives, fuller ones take, so every step raises the sum of squared fills.

        Rounds go through all underfull bins, the emptiest ones first. It ends when the bins are at their lower
        bound, or when a whole round found no step. Of equal bins that can't give, one is tried in a round.
        """
        least = -(-sum(self.fill) // self.capacity)
        left, moved = sum(f > 0 for f in self.fill), True
        while moved and left > least:
            moved, tried = False, set()
            queue = [(self.fill[b], b) for b in self.under]
            heapq.heapify(queue)
            while queue and left > least:
                fill, giver = heapq.heappop(queue)
                content = tuple(sorted(self.items[giver].items()))
                if giver not in self.under or fill != self.fill[giver] or content in tried:
                    continue
                found = self.exact(giver) or self.near(giver)
                if found is None:
                    tried.add(content)
                    continue
                self.exchange(giver, *found)
                moved = True
                left -= self.fill[giver] == 0
                for b in (giver, found[0]):
                    if b in self.under:
                        heapq.heappush(queue, (self.fill[b], b))

    def contents(self) -> list[list[int]]:
        return [sorted(c.elements(), reverse=True) for c in self.items if c]


def arrival_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the order of ``lengths``: each goes to the open bin with the least room that is enough, else to a new one."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # ascending (room, bin)
    for n in lengths:
        k = bisect.bisect_left(rooms, (n, 0))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        if room > n:
            bisect.insort(rooms, (room - n, b))
    return bins


def pack_lengths(lengths: list[int], capacity: int, seed: int = 1) -> Bins:
    """Best fit in a scattered order, as documents arrive, then local search."""
    order = np.random.default_rng(seed).permutation(len(lengths))
    bins = Bins(arrival_fit([lengths[i] for i in order], capacity), capacity)
    bins.search()
    return bins


class Slots:
    """Where the piece of each rank goes: ranks are by length, longest first, ``share`` of them to a slot."""

    def __init__(self, histogram: dict[int, int], capacity: int, slots: int = SLOTS):
        total = sum(histogram.values())
        self.share = max(1, -(-total // slots))
        self.before, lengths, rank = {}, [], 0
        for n in sorted(histogram, reverse=True):
            self.before[n] = rank
            first = -(-rank // self.share)  # slots that begin within this length
            rank += histogram[n]
            lengths += [n] * (-(-rank // self.share) - first)
        self.bins = pack_lengths(lengths, capacity)
        places: dict[int, list[tuple[int, int]]] = {}
        for b, content in enumerate(self.bins.contents()):
            for k, n in enumerate(content):
                places.setdefault(n, []).append((b, k))
        self.bin, self.place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for slot, n in enumerate(lengths):
            self.bin[slot], self.place[slot] = places[n].pop()


def cut_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Each document's pieces: whole where it fits, else full pieces after a first one with the rest; ``tag`` tells rows apart."""

    def cut(batches):
        encoder, tag = byte_level(tokenizer), TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4")
        for batch in by_bytes(batches, 1):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.encode(text or "").astype("<u4"), end])
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    tag += 1
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b]), tag), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "tag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, cut, PIECES + ", tag long")


def place(pieces: DataFrame, capacity: int, slots: int = SLOTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table) by packing the slots of their lengths."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = Slots(histogram, capacity, slots)
    before, share, bins, places = plan.before, plan.share, plan.bin, plan.place

    # A rank within each length, from ranks within small salted parts and the parts' sizes.
    salts = max(shuffle_partitions(spark), -(-max(histogram.values(), default=1) // 20_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("tag"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("tag")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            kinds, inverse = np.unique(length, return_inverse=True)
            rank = rank + np.array([before[int(n)] for n in kinds], np.int64)[inverse]
            slot = rank // share
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bins[slot] * share + rank % share), pa.array(places[slot])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "place"])

    placed = ranked.transform(map_arrow, assign, PIECES + ", sequence_id long, place long")
    # Pieces of a slot differ in length where it spans two lengths: offsets come from the pieces themselves.
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as it can.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one end id. Repeated rows are packed each by itself; null ids stay null;
    other columns are ignored; an empty table gives no rows.
    """
    return place(stored(cut_documents(docs, capacity, tokenizer, end_id), "pieces"), capacity)
