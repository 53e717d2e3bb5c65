from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import conversation_repair as c
from tallygrid.llm import edit_search as e
from tallygrid.llm.queries.op13 import digested, op13_conversation_repair

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
KIND = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """All edits of a few rows, (cost, audit, roles); rows are (initial, fault)."""
    best = (4 * len(rows), "D" * len(rows))
    stack = [(0, 0, "", "", 0)]
    while stack:
        i, cost, audit, roles, inserted = stack.pop()
        if cost > best[0]:
            continue
        if i == len(rows) and LEGAL.fullmatch(roles):
            best = min(best, (cost, audit))
        if inserted < 3:
            stack += [(i, cost + 3, audit + "I", roles + r, inserted + 1) for r in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            stack.append((i + 1, cost + 4, audit + "D", roles, 0))
            if fault not in (e.BLANK, e.DUPLICATE):
                extra = 3 * (fault == e.TRUNCATED)
                stack.append((i + 1, cost + extra, audit + "K", roles + initial, 0))
                stack += [(i + 1, cost + 3 + extra, audit + "R", roles + r, 0) for r in "ua"]
    return best


def some_rows(rng, n):
    return [(rng.choice("uuaasx"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search_equals_all_edits(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 4):
        rows = some_rows(rng, n)
        assert e.search(rows) == brute(rows)


@pytest.mark.parametrize("seed", range(20))
def test_chained_blocks_equal_one_search(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(1, 60))
    chain, at = e.Chain(), 0
    while at < len(rows):
        size = rng.randint(1, 9)
        chain.add(e.ways(rows[at:at + size], False))
        at += size
    assert chain.best() == e.search(rows)


def test_bounds_never_exceed_a_completion():
    rows = some_rows(random.Random(5), 4)
    bounds = e.suffix_bounds(rows, e.ACCEPTED)
    for i in range(len(rows) + 1):
        assert bounds[i][e.START] <= brute(rows[i:])[0]


def rebuild(rows, audit):
    """Lines of the repaired conversation by the audit."""
    out, state, at = [], "", 0
    for edit in audit:
        spoken = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append((spoken, ""))
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else spoken, text))
        state = out[-1][0][:1]
    assert at == len(rows) and LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    return "\n".join(f"{r}:{t}" for r, t in out)


def expected(rows):
    """A conversation's report from its ordered ``(turn, role, text)``."""
    seen, facts, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = (e.BLANK if not bare else e.DUPLICATE if (role, text) in seen
                 else e.FINE if bare[-1] in ".!?" else e.TRUNCATED)
        seen.add((role, text))
        counts[fault] += 1
        facts.append((role[:1], fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit = e.search(facts)
    sha = hashlib.sha256(rebuild([r[1:] for r in rows], audit).encode()).hexdigest()
    return gaps, *counts[1:], illegal, cost, audit, sha


def damage(rows):
    """The stated damage, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        said = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = crc32(said.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {k: sorted(v, key=order) for k, v in out.items()}


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_id(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}


@pytest.mark.skipif(not Path(SF).exists(), reason="no supplied tables")
def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()
    want = {k: expected(v) for k, v in damage([tuple(r) for r in rows]).items()}
    assert by_id(op13_conversation_repair(spark, SF)) == want
    assert any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


ROWS = [
    (1, None, None, None), (1, None, "user", "Hi."), (1, 3, "assistant", "Ho"), (1, 3, "user", "Hi."),
    (2, 0, "", "x"), (2, 5, "system", "S."), (2, 6, "user", "\x0b\x0c"), (2, 9, "user", "Q?"),
    (None, 0, "user", "A."), (None, None, "assistant", "B!"),
    (3, 0, "assistant", "Ü" * 200_000), (4, 1, "user", ""), (5, 0, "user", "Same."),
    (5, 0, "user", "Same."), (5, 0, "user", "Same."),
]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_defined_cases(spark, block, tmp_path):
    df = spark.createDataFrame(ROWS, KIND).withColumns(
        {n: F.lit("other") for n in ("digest", "kind", "block", "copies", "audit")})
    want = {k: expected(v) for k, v in damage(ROWS).items()}
    got = by_id(digested(c.repair(c.damaged(df), df, block=block)))
    assert got == want


def test_long_conversation_in_many_blocks(spark):
    rng = random.Random(2)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]),
             rng.choice(["Yes.", "no", f"t{i}.", f"u{i}", " "])) for i in range(900)]
    rows += [(i, 0, "user", "Hello.") for i in range(100, 140)]
    df = spark.createDataFrame(rows, KIND).repartition(7)
    want = {k: expected(v) for k, v in damage(rows).items()}
    assert by_id(digested(c.repair(c.damaged(df), df, block=16))) == want


def test_real_output(spark):
    df = spark.createDataFrame([(1, 0, "user", "Q?"), (1, 1, "user", "R?")], KIND)
    rows = c.repair(df).collect()
    assert rows[0]["audit"] == "KR" and rows[0]["position"] is None
    assert [(r["position"], r["edit"], r["role"], r["text"]) for r in rows[1:]] == [
        (0, "K", "user", "Q?"), (1, "R", "assistant", "R?")]
    assert c.repair(df.limit(0)).count() == 0
