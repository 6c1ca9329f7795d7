import hashlib
import heapq
import random
import re

import pytest

from qrelia.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, part int, cost string, at int, begin int"


def frame(spark, rows):
    """Conversation rows with columns whose names clash with results."""
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], SCHEMA)


def in_order(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())

    filled = [(t, " " if a is None else a, " " if x is None else x) for t, a, x in rows]
    return sorted(filled, key=key)


def brute(rows):
    """Cheapest repair by uniform-cost search over edit strings, with no tables and no states."""
    rows = in_order(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        fault = ""
        if not re.search("[^\x20\x09-\x0d]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif not re.search("[.!?][\x20\x09-\x0d]*\\Z", text):
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            break
        if not re.fullmatch("s?(ua)*u?", shape) or (i, shape[-1:]) in closed:
            continue
        closed.add((i, shape[-1:]))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape, out))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + role[:1], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, shape + name[0], (*out, f"{name}:{text}")))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, shape + name[0], (*out, f"{name}:")))
    starts = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def random_conversations(seed, n):
    rng = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "User", "u", "assist", "élu"]
    texts = ["Hello.", "Well?", "cut off", "", None, " \t\n\x0b", "é!", "done. \n", "a" * 5000 + "."] + [f"text {i}." for i in range(12)]
    rows = []
    for c in range(n):
        length = rng.choice([1, 2, 3, 5, 8, 13])
        for k in range(length):
            turn = rng.choice([k, k, k, k, k + 3, None])
            rows.append((None if c == 0 else c, turn, rng.choice(roles), rng.choice(texts)))
    return rows + rows[::9]  # some rows twice


def brute_all(rows):
    by_id = {}
    for c, *rest in rows:
        by_id.setdefault(c, []).append(tuple(rest))
    return sorted(((c, *brute(r)) for c, r in by_id.items()), key=lambda r: (r[0] is not None, r[0] or 0))


def digests(df, **limits):
    got = cr.conversation_digests(cr.repair_conversations(df, **limits)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def test_repairs_against_search(spark):
    rows = random_conversations(1, 250)
    assert digests(frame(spark, rows)) == brute_all(rows)


@pytest.mark.parametrize("long_rows,block_rows", [(0, 1), (2, 3)])
def test_long_conversations_in_stretches(spark, long_rows, block_rows):
    rows = random_conversations(2, 60)
    got = digests(frame(spark, rows).repartition(5), long_rows=long_rows, block_rows=block_rows)
    assert got == brute_all(rows)


def test_long_by_bytes(spark):
    rows = random_conversations(3, 40)
    assert digests(frame(spark, rows), long_bytes=4000, block_rows=4) == brute_all(rows)


def test_one_conversation_with_many_rows(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "tool"]), f"{k % 700} text{rng.choice('.. x')}") for k in range(3000)]
    rows += [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    df = frame(spark, rows)
    assert digests(df) == digests(df, long_rows=10**9)
    parts = cr.repair_conversations(df).where("conv_id = 7")
    assert parts.count() > 100 and parts.where("size(turns) > 1").isEmpty()


def test_whatever_the_split_the_cell_is_the_same():
    rng = random.Random(9)
    for _ in range(200):
        cells = [cr.row_cell(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(2, 9))]
        whole = cr.span_cell(cells)
        for k in range(1, len(cells)):
            assert cr.combine(cr.span_cell(cells[:k]), cr.span_cell(cells[k:])) == whole


def test_named_cases(spark):
    def judge(*rows):
        df = frame(spark, [(1, k, r, t) for k, (r, t) in enumerate(rows)])
        return digests(df)[0][6:8]

    assert judge(("user", "a."), ("assistant", "b.")) == (0, "KK")
    assert judge(("system", "s.")) == (2, "D")
    assert judge(("user", "a."), ("user", "b.")) == (1, "KR")
    assert judge(("assistant", "a.")) == (2, "D")
    assert judge(("user", "a."), ("assistant", "b")) == (4, "DD")
    assert judge(("user", "a."), ("assistant", "b."), ("user", "c."), ("assistant", "d"), ("user", "e."), ("assistant", "f.")) == (4, "KKDDKK")


def test_dropped_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", False), (None, 0, "user", "a.", False)], "conv_id long, turn long, role string, text string, here boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert digests(rows, present="here") == [(None, 0, 0, 0, 0, 0, 0, "", empty), (1, 0, 0, 0, 0, 0, 0, "", empty)]
    assert digests(frame(spark, [])) == []


def test_damage(spark):
    rows = [(c, t, "assistant", "one. two! three?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = {}
    for r in cr.damage(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    from zlib import crc32

    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        h = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: (role, text, False), 1: (role, "", True), 2: (role, re.sub("[.!?]", "", text), True), 4: ("user", text, True)}.get(h, (role, text, True))
        assert got[c, t] == [want] * (2 if h == 3 else 1)
