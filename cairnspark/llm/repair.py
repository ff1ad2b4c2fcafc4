"""Conversation structure repair (12): lightest derivations of a legal conversation.

An item (rows read, state of the role grammar) is deduced from others by keeping, changing, deleting or inserting a turn.
Items are popped from an agenda by (cost, rows read, audit): each deduction raises the first two together, and of equally
cheap derivations of one item none is a prefix of the other, so the order of audits stays as they grow and an item is
final when it is popped. Long conversations are cut into chunks, each solved from every state; chunks are then joined.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import map_arrow, shuffle_partitions, stored

#: Rows and characters of a chunk; one longer text is a chunk of its own.
CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 22
SPACE = " \t\n\v\f\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant. Each allows one of user and assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
CHANGE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn that is kept, or None where it isn't allowed."""
    if initial == "s":
        return SYSTEM if state == START else None
    return FOLLOWS[state] if initial == "ssua"[FOLLOWS[state]] else None


def lightest(initials: Sequence[str], faults: Sequence[int], start: int) -> list[tuple[int, str] | None]:
    """The (cost, audit) of the lightest derivation from ``start`` over all rows, for each state at their end."""
    n = len(initials)
    final: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(n + 1)]
    agenda = [(0, 0, "", start)]
    while agenda:
        cost, row, audit, state = heapq.heappop(agenda)
        if final[row][state] is not None:
            continue
        final[row][state] = cost, audit
        after = FOLLOWS[state]
        heapq.heappush(agenda, (cost + INSERT, row, audit + "I", after))
        if row == n:
            continue
        fault = faults[row]
        heapq.heappush(agenda, (cost + DELETE, row + 1, audit + "D", state))
        if fault not in (BLANK, DUPLICATE):
            more = UNFINISHED if fault == TRUNCATED else 0
            heapq.heappush(agenda, (cost + CHANGE + more, row + 1, audit + "R", after))
            if (kept := kept_state(state, initials[row])) is not None:
                heapq.heappush(agenda, (cost + more, row + 1, audit + "K", kept))
    return final[n]


def replayed(roles: Sequence[str], texts: Sequence[str], audit: str, state: int) -> Iterator[str]:
    """The lines ``role:text`` that the edits of ``audit`` leave."""
    row = 0
    for edit in audit:
        if edit in "IR":
            state = FOLLOWS[state]
            yield f"{NAMES[state]}:{texts[row] if edit == 'R' else ''}"
        elif edit == "K":
            state = kept_state(state, roles[row][:1])
            yield f"{roles[row]}:{texts[row]}"
        row += edit != "I"


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, chosen by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user. Null roles and texts become one space; a null in the key reads as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    role, text = F.when(kind == 4, "user").otherwise(text_of("role")), text_of("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"), F.explode(times).alias("time"))
    return made.where("kind <> 0").select("conv_id", "turn", "role", "text")


def _marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and whether the same role and text are there with an earlier turn; only groups of equal rows are joined back."""
    mark, place = F.md5(F.col("text").cast("binary")), F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({"mark": mark, "place": place})
    firsts = rows.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("conv"), F.col("role").alias("of"), F.col("mark").alias("equal"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("of")) & (F.col("mark") == F.col("equal"))
    return stored(rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later")), "turns")


_CHUNKS = (
    "conv_id long, part long, chunk long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "first_turn long, last_turn long, turns long, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _chunks(marked: DataFrame) -> DataFrame:
    """Runs of a conversation's rows in order, with what they count and the lightest derivations through them; costs and audits are by state before * 4 + state after."""
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in _CHUNKS.split(", ")]

    def cut(batches):
        part, chunk, conv, before, begun = TaskContext.get().partitionId(), 0, None, None, False
        rows: list[tuple[int | None, str, str, int]] = []
        chars, first = 0, False
        out: list[tuple] = []

        def ended():
            nonlocal rows, chars, chunk, first
            initials, faults = [r[1][:1] for r in rows], [r[3] for r in rows]
            turns = [r[0] for r in rows if r[0] is not None]
            tables = [lightest(initials, faults, s) if s == START or not first else [None] * 4 for s in range(4)]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            counts = [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
            ends = (turns[0], turns[-1]) if turns else (None, None)
            flat = [x for t in tables for x in t]
            out.append((conv, part, chunk, *counts, illegal, initials[0], initials[-1], *ends, len(set(turns)), [x and x[0] for x in flat], [x and x[1] for x in flat], [r[1] for r in rows], [r[2] for r in rows]))
            rows, chars, chunk, first = [], 0, chunk + 1, False

        def batch_of():
            nonlocal out
            columns, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[0] != conv or len(rows) >= CHUNK_ROWS or chars + len(row[3]) > CHUNK_CHARS):
                    ended()
                    if len(out) >= 64 or chars > CHUNK_CHARS:
                        yield batch_of()
                if not begun or row[0] != conv:
                    # what a partition begins with may go on from the one before; what comes later begins here
                    conv, first, begun = row[0], begun, True
                text = row[3].strip(SPACE)
                fault = BLANK if not text else DUPLICATE if row[4] or row[:4] == before else TRUNCATED if text[-1] not in ".!?" else NONE
                before = row[:4]
                rows.append((row[1], row[2], row[3], fault))
                chars += len(row[3])
        if rows:
            ended()
        if out:
            yield batch_of()

    order = ["conv_id", "turn", "role"]
    dealt = marked.repartitionByRange(shuffle_partitions(marked.sparkSession), *order, F.substring("text", 1, 16)).sortWithinPartitions(*order, "text")
    return stored(dealt.select("conv_id", "turn", "role", "text", "later").transform(map_arrow, cut, _CHUNKS), "chunks")


class Path:
    """A derivation through some chunks: the one before, and the edits of the last."""

    __slots__ = ("before", "cost", "audit", "chunk", "state")

    def __init__(self, before: Path | None, cost: int, audit: str, chunk: tuple[int, int], state: int):
        self.before, self.cost, self.audit, self.chunk, self.state = before, cost, audit, chunk, state

    def lighter(self, other: Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b:
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _composed(chunks: DataFrame) -> DataFrame:
    """For each conversation a row without a chunk (its counts, cost and audit) and one for each chunk (its edits and the state before them)."""
    schema = "conv_id long, part long, chunk long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, state int"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def join(batches):
        conv, begun = None, False
        paths: list[Path | None] = []
        counts, turns, ends, last_role = [0] * 4, 0, [None, None], ""
        out: list[tuple] = []

        def ended():
            best = None
            for path in (paths[START], paths[ASSISTANT]):
                if path is not None and (best is None or path.lighter(best)):
                    best = path
            steps, at = [], best
            while at is not None and at.chunk is not None:
                steps.append(at)
                at = at.before
            out.extend((conv, *s.chunk, *[None] * 6, s.audit, s.state) for s in steps)
            gaps = ends[1] - ends[0] + 1 - turns if ends[0] is not None else 0
            out.append((conv, None, None, gaps, *counts, best.cost, "".join(s.audit for s in reversed(steps)), None))

        def batch_of():
            nonlocal out
            columns, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        ended()
                        if len(out) >= 512:
                            yield batch_of()
                    conv, begun = row["conv_id"], True
                    paths, counts, turns, ends, last_role = [Path(None, 0, "", None, START), None, None, None], [0] * 4, 0, [None, None], None
                after: list[Path | None] = [None] * 4
                for s, path in enumerate(paths):
                    for t in range(4):
                        if path is not None and row["costs"][4 * s + t] is not None:
                            new = Path(path, path.cost + row["costs"][4 * s + t], row["audits"][4 * s + t], (row["part"], row["chunk"]), s)
                            if after[t] is None or new.lighter(after[t]):
                                after[t] = new
                paths = after
                counts = [a + row[k] for a, k in zip(counts, _COUNTS, strict=True)]
                counts[3] += last_role is not None and last_role + row["first_role"] not in ("su", "ua", "au")
                last_role = row["last_role"]
                if row["turns"]:
                    turns += row["turns"] - (row["first_turn"] == ends[1])
                    ends = [row["first_turn"] if ends[0] is None else ends[0], row["last_turn"]]
        if begun:
            ended()
        if out:
            yield batch_of()

    lean = chunks.drop("roles", "texts")
    dealt = lean.repartition(shuffle_partitions(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return stored(dealt.transform(map_arrow, join, schema), "derivations")


def _hashed(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv, repaired_sha256: the lines of each conversation, hashed as they come."""
    lines = chunks.select("conv_id", "part", "chunk", "roles", "texts").join(chosen.select("part", "chunk", "audit", "state"), ["part", "chunk"])

    def digest(batches):
        conv, sha, empty = None, None, True
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if sha is None or row["conv_id"] != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, empty = row["conv_id"], hashlib.sha256(), True
                for line in replayed(row["roles"], row["texts"], row["audit"], row["state"]):
                    sha.update((line if empty else "\n" + line).encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    dealt = lines.repartition(shuffle_partitions(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "roles", "texts", "audit", "state")
    return dealt.transform(map_arrow, digest, "conv long, repaired_sha256 string")


def _is(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of ``turns``
    (conv_id, turn, role, text), and of ``conversations`` (conv_id) where it is given.

    A conversation's rows go by turn (null first, then by role and text where turns are equal). Edits: Keep, Rerole to user or
    assistant (3), Delete (4; required for blank and repeated rows), Insert an empty user or assistant turn (3); a truncated row that
    stays costs 3 more. The cheapest edits that leave roles ``(s?(ua)+)?`` are taken, of equals the least audit.

    Null roles and texts count as one space; a null conv_id is a conversation of its own; turns of another role, or an empty
    one, can't be kept as they are; repeated rows are repeated turns; other columns are ignored; a conversation without rows
    has zeros, no audit and the hash of nothing; empty tables give no rows. Rows are dealt by (conversation, turn), so
    a long conversation lies in many tasks; its chunks' derivations meet in one, and its text passes through one for its hash, a chunk at a time.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    chunks = _chunks(_marked(turns))
    found = _composed(chunks)
    ids = (turns if conversations is None else conversations.select("conv_id").unionByName(turns.select("conv_id"))).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = found.where("chunk is null").select(F.col("conv_id").alias("conv0"), "gaps", *_COUNTS, "cost", "audit")
    rows = ids.join(whole, _is("conv_id", "conv0"), "left").join(_hashed(chunks, found.where("chunk is not null")), _is("conv_id", "conv"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS doc_id FROM conversations
), k AS (SELECT conv_id, turn, role, text, {crc} % 20 AS kind FROM o
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT * FROM k WHERE kind <> 0 UNION ALL SELECT * FROM k WHERE kind = 3)
), i AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER w AS p, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM i
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id
), e AS (SELECT * FROM (VALUES ('K'), ('R'), ('D')) t(edit), (VALUES (''), ('I'), ('II')) u(ins)
), g AS (
  SELECT conv_id, 0::BIGINT AS i, 3 * length(ins)::BIGINT AS cost, ins AS audit, CASE ins WHEN '' THEN '0' WHEN 'I' THEN 'u' ELSE 'a' END AS state FROM c, (VALUES (''), ('I'), ('II')) u(ins)
  UNION ALL
  SELECT conv_id, i, cost, audit, state FROM (
    SELECT conv_id, i, cost, audit, CASE length(ins) WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 'u' THEN 'a' ELSE 'u' END ELSE CASE s WHEN 'u' THEN 'u' ELSE 'a' END END AS state FROM (
      SELECT g.conv_id, f.i, g.cost + 3 * length(ins) + CASE edit WHEN 'D' THEN 4 ELSE CASE edit WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 3 THEN 3 ELSE 0 END END AS cost, g.audit || edit || ins AS audit, ins,
        CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND r = 's' THEN 's' WHEN state = 'u' THEN 'a' ELSE 'u' END AS s
      FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1, e
      WHERE edit = 'D' OR (fault NOT IN (1, 2) AND (edit = 'R' OR (r = 's' AND state = '0') OR (r = 'a' AND state = 'u') OR (r = 'u' AND state <> 'u'))))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), b AS (SELECT g.conv_id, g.cost, g.audit FROM g JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = c.n AND state IN ('0', 'a') QUALIFY row_number() OVER (PARTITION BY g.conv_id ORDER BY g.cost, g.audit) = 1
), s AS (SELECT conv_id, pos, substr(audit, pos, 1) AS edit, length(translate(left(audit, pos), 'I', '')) AS i, length(translate(left(audit, pos), 'D', '')) - length(translate(audit, 'D', '')) % 2 AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM b)
), l AS (
  SELECT s.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos) AS lines
  FROM s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE edit <> 'D' GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
