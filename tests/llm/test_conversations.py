import hashlib
import itertools
import random
import re
import zlib

import pytest

from surfaceworks.llm import conversations
from surfaceworks.llm.queries import op13_conversations

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """All edits up to two insertions at a place, by exhaustive search over prefixes: [(cost, audit)] least first."""
    out = []
    ahead = [(0, "", "", 0)]  # cost, audit, roles, rows read
    best = {}
    while ahead:
        cost, audit, roles, at = ahead.pop()
        state = roles[-2:] if len(roles) > 1 else roles
        key = (at, state, len(roles) > 1)
        ahead_cost = best.get(key)
        if ahead_cost is not None and ahead_cost < cost:
            continue
        best[key] = min(cost, best.get(key, cost))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        steps = []
        if at < len(rows):
            initial, fault = rows[at]
            steps.append((4, "D", "", 1))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps += [(more, "K", initial, 1), (3 + more, "R", "u", 1), (3 + more, "R", "a", 1)]
        if not audit.endswith("II"):
            steps += [(3, "I", "u", 0), (3, "I", "a", 0)]
        for c, e, r, n in steps:
            if re.fullmatch("s?(ua)*u?", roles + r):
                ahead.append((cost + c, audit + e, roles + r, at + n))
    return min(out)


def brute(table):
    out = {}
    by = {}
    for conv, turn, role, text in table:
        s = lambda x: " " if x is None else str(x)
        role, text = s(role), s(text)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        rows = by.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = cheapest([(r[1][:1] or "x", f) for r, f in zip(rows, faults, strict=True)])
        lines, at = [], 0
        for e in audit:
            expected = "assistant" if lines and lines[-1][0] == "u" else "user"
            if e == "I":
                lines.append(f"{expected}:")
            else:
                _, role, text = rows[at]
                at += 1
                if e != "D":
                    lines.append(f"{expected if e == 'R' else role}:{text}")
        n = lambda f: faults.count(f)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answers(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def table(seed, conversations_, most):
    r = random.Random(seed)
    texts = ["Hi.", "Hi.", "ok", "What?", "", " \t", None, "so it goes!", "a longer line.\nwith more", "ünï。", "x . "]
    rows = []
    for conv in [None, *range(conversations_)]:
        for turn in range(r.randint(1, most)):
            if r.random() < 0.9:
                rows.append((conv, r.choice([turn, turn, turn, turn + 40]) if turn else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    return rows


@pytest.mark.parametrize("signature", ["", "s", "ua", "su", "x", "-", "au", "uua", "sua", "usa", "SUA", "s-", "aua", "uau", "ssuaua", "xX-uA", "uuuu", "aaaa", "asxu", "uaS", "-s-a-u-"])
def test_solve(signature):
    rows = [("x" if c == "-" else c.lower(), "blank" if c == "-" else "truncated" if c.isupper() else "") for c in signature]
    assert conversations.solve(signature) == cheapest(rows)


def test_solve_long_signatures():
    assert conversations.solve("ua" * 50_000 + "u") == (3, "K" * 100_001 + "I")


def test_repair_against_brute_force(spark):
    rows = table(5, 150, 7)
    unique = {(c, t): (c, t, *rest) for c, t, *rest in rows}.values()  # one row for each turn, then repeated turns too
    for some in (list(unique), rows):
        df = spark.createDataFrame(some, ROWS)
        assert answers(conversations.repair(conversations.damaged(df))) == brute(some)


def test_one_conversation_with_most_rows(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", "same." if i % 3 else f"row {i}") for i in range(3000)] + [(8, 0, "user", "Hi.")]
    got = answers(conversations.repair(conversations.damaged(spark.createDataFrame(rows, ROWS)).repartition(5)))
    assert set(got) == {7, 8} and got[7][2] > 1500
    edits = re.sub("I", "", got[7][6])
    kinds = [zlib.crc32(f"7:{i}".encode()) % 20 for i in range(3000)]
    assert len(edits) == 3000 - kinds.count(0) + kinds.count(3)


def test_odd_tables(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], ROWS))).count() == 0
    odd = spark.createDataFrame([(1, 1, "user", "Hi. " * 50_000, "x", 1), (1, 1, "user", "Hi. " * 50_000, "x", 1), (1, 2, None, None, None, None), (-(1 << 62), -(1 << 63), "u", "!", "", 2), (-(1 << 62), (1 << 63) - 1, "a", "!", "", 2)], ROWS + ", audit string, copies int")
    got = answers(conversations.repair(conversations.damaged(odd)))
    assert got == {c: v if c > 0 else (got[c][0], *v[1:]) for c, v in brute([tuple(r)[:4] for r in odd.collect()]).items()}


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi.")], ROWS).selectExpr("*", "1 AS copies")
    r = conversations.repair(rows, keep_rows=True).first()
    assert (r.cost, r.audit) == (6, "IKKI")
    assert [tuple(x) for x in r.repaired] == [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(op13_conversations(spark, d)) == brute(rows)
