"""op12 against exhaustive search, against its SQL, and in blocks against itself whole."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barwright.llm import repair as R

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def every_audit(rows):
    """(least cost, least audit, lines) of rows (role, text), from all edit sequences, each state with a dictionary of all its audits."""
    seen, current = set(), {0: {"": (0, ())}}

    def put(out, state, audit, cost, lines):
        if cost < out.setdefault(state, {}).get(audit, (1 << 30,))[0]:
            out[state][audit] = (cost, lines)

    def inserted(current):
        out, layer = {s: dict(d) for s, d in current.items()}, current
        for _ in range(3):
            more = {}
            for state, audits in layer.items():
                to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                for audit, (cost, lines) in audits.items():
                    put(more, to, audit + "I", cost + 2, (*lines, {2: "user:", 3: "assistant:"}[to]))
            for state, audits in more.items():
                for audit, (cost, lines) in audits.items():
                    put(out, state, audit, cost, lines)
            layer = more
        return out

    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out = {}
        for state, audits in inserted(current).items():
            for audit, (cost, lines) in audits.items():
                put(out, state, audit + "D", cost + 3, lines)
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if kept:
                    put(out, kept, audit + "K", cost + extra, (*lines, f"{role}:{text}"))
                to, other = (3, "assistant") if state == 2 else (2, "user")
                put(out, to, audit + "R", cost + 2 + extra, (*lines, f"{other}:{text}"))
        current = out
    cost, audit, lines = min((c, a, x) for s in (0, 3) for a, (c, x) in inserted(current).get(s, {}).items())
    return counts, cost, audit, "\n".join(lines)


def brute(rows, harm):
    """Per conversation the expected columns, from rows (conv_id, turn, role, text)."""
    out, left = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        names = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{names[0]}:{names[1]}".encode()) % 20 if harm else 99
        left[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else names[2], "" if kind == 1 else re.sub("[.!?]", "", names[3]) if kind == 2 else names[3],
                        turn)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, found in left.items():
        found.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [r[4] for r in found if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        counts, cost, audit, text = every_audit([r[2:4] for r in found])
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(frame):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(12)
    texts = ["Fine.", "Cut", "Same!", "", " \t\n", "Ends? ", "Ünï 文.", "no break "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "ubuntu"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(0, 6))]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", None), (None, None, None, None), (None, None, "user", "Hello."), (None, 3, "assistant", "Yes.")]
    rows += [(900, 1, "user", "A."), (900, 1, "user", "A."), (900, 1, "assistant", "B."), (900, 5, "user", "C"), (900, -4, "system", "S.")]
    rows += [(901, None, "user", "Only."), (902, 7, "system", "Alone."), (903, 1, "assistant", "x" * 100_000 + ".")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_least_audit_of_every_start_in_any_blocks():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("uuaasx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        whole = R.Paths(0)
        for row in rows:
            whole.row(*row)
        whole.inserts()
        want = min((p[0], p[1].text()) for p in (whole.best[0], whole.best[3]) if p)
        for cuts in ((2,), (1, 3), (0, 4, 5)):
            blocks, audits = [], []
            for a, b in zip((0, *cuts), (*cuts, len(rows))):
                starts = [R.Paths(s) for s in range(4)]
                for path in starts:
                    for row in rows[a:b]:
                        path.row(*row)
                texts = [[p and p[1].text() for p in path.best] for path in starts]
                blocks.append(([p and p[0] for path in starts for p in path.best],
                               [x and sorted(filter(None, row)).index(x) if x else (0 if x == "" else None) for row in texts for x in row]))
                audits.append(texts)
            cost, steps = R.choose(blocks)
            assert (cost, "".join(t[p][q] for t, (p, q) in zip(audits, steps)) + R.TAIL[steps[-1][1]]) == want


def test_equal_costs_compare_by_the_common_prefix():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("DI") for _ in range(rng.randint(0, 40))) for _ in range(2))
        shared = "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 40)))
        root = R.Node(None, "")
        for x in shared:
            root = R.Node(root, x)
        x, y = root, root
        for letter in a:
            x = R.Node(x, letter)
        for letter in b:
            y = R.Node(y, letter)
        assert (x.text(), R.less(x, y), R.less(y, x)) == (shared + a, a < b, b < a)


def test_colliding_hashes_are_caught(monkeypatch):
    monkeypatch.setattr(R, "MODULUS", 3)
    rng = random.Random(9)
    for _ in range(300):
        nodes = []
        for text in ("".join(rng.choice("DIK") for _ in range(rng.randint(0, 12))) for _ in range(2)):
            node = R.Node(None, "")
            for letter in text:
                node = R.Node(node, letter)
            nodes.append((text, node))
        (a, x), (b, y) = nodes
        assert R.less(x, y) == (a < b)


def test_odd_rows_are_brute_force_whole_and_in_blocks(spark, odd):
    extra = frame(spark, odd).withColumns({"id": F.lit("x"), "result": F.lit(1), "seg": F.lit(2)})
    want, want_harmed = brute(odd, False), brute(odd, True)
    assert result(R.repair(extra)) == want
    assert result(R.repair(R.damaged(extra), copies_col="copies")) == want_harmed
    assert result(R.repair(R.damaged(extra), copies_col="copies", block_rows=2)) == want_harmed
    assert result(R.repair(extra.repartition(5), block_bytes=1)) == want


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(1, t // 3 if t % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"Text {t}."])) for t in range(900)]
    whole = R.repaired(sorted([(t, r, x, 1) for _, t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])), True)
    got = R.repair(frame(spark, rows), block_rows=40).first()
    assert {c: got[c] for c in (*COLUMNS, "repaired")} == {c: whole[c] for c in (*COLUMNS, "repaired")}


def test_sql_says_the_same(spark, sf, odd):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd)
    con.execute(f"INSERT INTO conversations SELECT conv_id + 10000, turn, role, text FROM '{sf}/conversations.parquet'")
    sql = {r[0]: tuple(r[1:]) for r in con.execute(R.SQL).fetchall()}
    both = odd + [(None if c is None else c + 10000, t, r, x) for c, t, r, x in given]
    assert result(R.repair(R.damaged(frame(spark, both)), copies_col="copies", keep=())) == sql
    assert result(R.op12_repair_conversations(spark, sf)) == result(R.repair(R.damaged(frame(spark, given)), copies_col="copies"))


def test_no_rows(spark):
    assert R.repair(frame(spark, []), keep=()).count() == 0
    gone = R.repair(frame(spark, [(1, 1, "user", "x")]).withColumn("copies", F.lit(0)), copies_col="copies").first()
    assert tuple(gone[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
