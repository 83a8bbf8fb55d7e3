import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from staffline.llm import turns
from staffline.llm.queries import op12_conversation_repair
from .conftest import SF, pairs

ACCEPT = re.compile("(s?(ua)+)?")
COLS = ("conv_id", *turns.COUNTS, "audit", "repaired_sha256")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # 0 and 3 accept


def search(rows):
    """rows: (initial, fault). Least cost, then least audit, by best-first search over the language."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        for t in "ua":
            if (q, t) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[q, t]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if (q, initial) in NEXT:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, NEXT[q, initial]))
                for t in "ua":
                    if (q, t) in NEXT:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, NEXT[q, t]))


def enumerated(rows):
    """The same by trying every edit of every row and every insertion of up to two rows between."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    edits = [[(3, "D", "")] if f in ("blank", "duplicate") else
             [(3, "D", "")] + [(f == "truncated", "K", r)] + [(2 + (f == "truncated"), "R", t) for t in "ua"] for r, f in rows]
    for es in itertools.product(*edits):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            told = gaps[0] + "".join(e[2] + g for e, g in zip(es, gaps[1:], strict=True))
            if ACCEPT.fullmatch(told) and not any(r not in "sua" and e[1] == "K" for (r, _), e in zip(rows, es, strict=True)):
                made = (sum(e[0] for e in es) + 2 * sum(map(len, gaps)),
                        "I" * len(gaps[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(es, gaps[1:], strict=True)))
                best = made if best is None or made < best else best
    return best


def cases(most, n, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        yield [(rnd.choice("ssuuaax"), rnd.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randrange(most + 1))]


def test_cheapest_edits_equal_every_edit_tried():
    for rows in cases(3, 60):
        assert turns.cheapest([(r, f) for r, f in rows]) == search(rows) == enumerated(rows), rows


def test_cheapest_edits_equal_search():
    for rows in cases(14, 600, seed=2):
        assert turns.cheapest(rows) == search(rows), rows


def test_equal_tops_accept_the_same():
    r = turns.Repairer()
    seen, todo = {(0,)}, [(0,)]
    while todo:  # every stack that can arise, against the one that stands for its top
        stack = todo.pop()
        for t in "sua$":
            mine, its = r.lr.advance(stack, t), r.lr.advance(r.stacks[stack[-1]], t)
            assert (mine is None) == (its is None)
            if mine and t != "$" and mine not in seen:
                assert len(mine) < 6
                seen.add(mine)
                todo.append(mine)
    assert len(seen) >= len(r.stacks) == len({s[-1] for s in seen})


def brute(rows):
    """rows: (conv, turn, role, text); the contract read plainly."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        found[conv] += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    out = []
    for conv, got in found.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in got:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = search([(r[:1], f) for (_, r, _), f in zip(got, faults, strict=True)])
        made, q, rest = [], 0, iter(got)
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if q == 2 else "user"
            q = NEXT[q, role[:1]]
            made.append(f"{role}:{row[2] if row else ''}")
        ts = {r[0] for r in got if r[0] is not None}
        gaps = max(ts) - min(ts) + 1 - len(ts) if ts else 0
        illegal = sum(a[1][:1] + b[1][:1] not in turns.LEGAL for a, b in zip(got, got[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def random_rows(n, convs, seed):
    rnd = random.Random(seed)
    texts = ["Hi.", "ok", "", " \t", "Why? ", "é!\n", "No. no", None, "x" * 3000 + "."]
    return [(rnd.choice([*range(convs), None]), rnd.choice([*range(8), None]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
             rnd.choice(texts) if rnd.random() < 0.6 else f"row {rnd.random()}.") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, part int")


@pytest.mark.parametrize("n, convs", [(300, 60), (300, 1)])
def test_equals_the_contract(spark, n, convs):
    rows = random_rows(n, convs, seed=n + convs)
    assert pairs(turns.repair_damaged(frame(spark, rows).repartition(3)), *COLS) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK_ROWS", 7)
    rnd = random.Random(5)
    rows = [(5, t, rnd.choice(["user", "assistant", "user", "assistant", "tool"]), rnd.choice(["a.", "b", f"t{t}!"])) for t in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {t}.") for c in (1, 9) for t in range(4)] + rows[:50]
    assert pairs(turns.repair_damaged(frame(spark, rows).repartition(5)), *COLS) == brute(rows)


def test_empty_table(spark):
    out = turns.repair_damaged(frame(spark, []))
    assert out.columns == list(COLS) and out.count() == 0


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert pairs(op12_conversation_repair(spark, SF), *COLS) == brute(rows)


def test_intact_rows_are_kept(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!")]
    got = pairs(turns.repair_conversations(turns.intact(frame(spark, rows))), *COLS)
    assert got[0][1:8] == (0, 0, 0, 0, 0, 0, "KKK")
