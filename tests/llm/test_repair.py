"""Conversation repair against an enumeration of all edits, and against relaxation on longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cairnspark.llm import repair
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, audit string, state string"


def faults_of(rows):
    seen, found = set(), []
    for _, role, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]", "", text)
        found.append(1 if not t else 2 if (role, text) in seen else 3 if t[-1] not in ".!?" else 0)
        seen.add((role, text))
    return found


def enumerated(rows, faults):
    """The least (cost, audit, lines) of every way to edit, with up to two insertions in each place."""
    inserted = [[], [("I", "user", "", 3)], [("I", "assistant", "", 3)], *([("I", a, "", 3), ("I", b, "", 3)] for a in ("user", "assistant") for b in ("user", "assistant"))]
    options = [inserted]
    for (_, role, text), fault in zip(rows, faults, strict=True):
        more = 3 if fault == 3 else 0
        edits = [[("D", None, None, 4)]] + ([] if fault in (1, 2) else [[("K", role, text, more)], [("R", "user", text, 3 + more)], [("R", "assistant", text, 3 + more)]])
        options += [edits, inserted]
    best = None
    for way in itertools.product(*options):
        steps = [s for group in way for s in group]
        if re.fullmatch(r"(s?(ua)+)?", "".join(s[1][:1] or "-" for s in steps if s[1] is not None), re.S):
            got = sum(s[3] for s in steps), "".join(s[0] for s in steps), "\n".join(f"{s[1]}:{s[2]}" for s in steps if s[1] is not None)
            best = got if best is None else min(best, got)
    return best


def relaxed(rows, faults):
    """The same by relaxing all items until nothing changes."""
    best = {(0, ""): (0, "", "")}
    changed = True
    while changed:
        changed = False
        for (i, state), (cost, audit, lines) in list(best.items()):
            new = []
            after = "a" if state == "u" else "u"
            name = "assistant" if after == "a" else "user"
            line = lambda role, text, lines=lines: lines + "\n" * bool(lines) + f"{role}:{text}"
            new.append(((i, after), (cost + 3, audit + "I", line(name, ""))))
            if i < len(rows):
                _, role, text = rows[i]
                new.append(((i + 1, state), (cost + 4, audit + "D", lines)))
                if faults[i] not in (1, 2):
                    more = 3 if faults[i] == 3 else 0
                    new.append(((i + 1, after), (cost + 3 + more, audit + "R", line(name, text))))
                    if role[:1] == after or (role[:1] == "s" and state == ""):
                        new.append(((i + 1, role[:1]), (cost + more, audit + "K", line(role, text))))
            for item, weight in new:
                if item not in best or weight[:2] < best[item][:2]:
                    best[item] = weight
                    changed = True
    return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)


def brute(turns, ids, solve):
    """Rows (conv_id, turn, role, text) as they are after damage."""
    found = []
    for conv in ids:
        rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in turns if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = faults_of(rows)
        named = [r[0] for r in rows if r[0] is not None]
        gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = solve(rows, faults)
        found.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(found, key=str)


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def made(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, size in enumerate(sizes):
        for turn in range(size):
            rows.append((conv or None, rng.choice([None, turn, turn, turn, turn + 1]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "U"]), rng.choice(["yes.", "no", "what?", "", " \t", None, f"t{turn}.", f"t{turn}", "end. \n"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_every_edit_of_short_conversations(spark):
    rows = made(1, [3] * 60 + [1] * 20 + [2] * 20)
    ids = {r[0] for r in rows}
    assert sorted(map(tuple, repair.repair(frame(spark, rows)).collect()), key=str) == brute(rows, ids, enumerated)


@pytest.mark.parametrize("chunk", [256, 3, 1])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    """Also where a conversation's rows lie in several partitions and its chunks have a row each."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rows = made(2, [40, 90, 7, 1, 5, 12, 60])
    ids = {r[0] for r in rows}
    assert sorted(map(tuple, repair.repair(frame(spark, rows)).collect()), key=str) == brute(rows, ids, relaxed)


def test_damage_and_conversations_without_rows(spark):
    rows = made(3, [4] * 80 + [1] * 60)
    ids = {r[0] for r in rows}
    after = list(damaged(rows))
    df = frame(spark, rows)
    assert sorted(map(tuple, repair.damage(df).collect()), key=str) == sorted(after, key=str)
    got = sorted(map(tuple, repair.repair(repair.damage(df), df).collect()), key=str)
    assert got == brute(after, ids, relaxed) and any(g[7] == "" for g in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0
    assert [tuple(r) for r in repair.repair(empty, frame(spark, [(7, 1, "user", "x.")])).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_the_smallest_tables(spark):
    from cairnspark.llm.queries import op12_lightest_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op12_lightest_repair(spark, SF).collect()), key=str)
    assert got == brute(list(damaged(rows)), {r[0] for r in rows}, relaxed)
