"""Conversation repair against SQL, a shortest path by exhaustion, and long runs."""

import hashlib
import random

import duckdb
import pytest
from compare import connect, difference

from tenura.llm import conversations as C

TURNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit) by keeping every cheapest edit text per state; rows are (initial, must go, truncated)."""

    def least(found):
        return {q: {x for x in v if x[0] == min(y[0] for y in v)} for q, v in found.items()}

    def inserted(found):
        out = {q: set(v) for q, v in found.items()}
        for q, v in found.items():
            for n in (1, 2, 3):
                q = FOLLOWS[q]
                out.setdefault(q, set()).update((c + 3 * n, a + "I" * n) for c, a in v)
        return least(out)

    found = {"": {(0, "")}}
    for initial, gone, open_ in rows:
        new = {}
        for q, v in inserted(found).items():
            for c, a in v:
                new.setdefault(q, set()).add((c + 4, a + "D"))
                if not gone:
                    to = FOLLOWS[q]
                    new.setdefault(to, set()).add((c + 3 + 3 * open_, a + "R"))
                    if initial == to or (q == "" and initial == "s"):
                        new.setdefault(initial, set()).add((c + 3 * open_, a + "K"))
        found = least(new)
    found = inserted(found)
    return min(min(found[q]) for q in ("", "a") if q in found)


def runs_of(rows):
    runs = []
    for initial, gone, open_ in rows:
        symbol = C.GONE if gone else 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + open_
        runs.append((symbol, runs.pop()[1] + 1 if runs and runs[-1][0] == symbol else 1))
    return tuple(runs)


def test_runs_cost_what_exhaustion_finds():
    rng = random.Random(3)
    for _ in range(1500):
        rows = []
        for _ in range(rng.randint(0, 8)):
            rows += [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.3)] * rng.choice([1, 1, 1, 2, 5])
        rows = rows[:13]
        assert C.solved(runs_of(rows)) == cheapest(rows)


def test_powers_cross_a_run_like_its_rows():
    for symbol in range(9):
        for n in (1, 2, 3, 7, 64, 100):
            after = C.END
            for _ in range(n):
                after = C.onto(C.power(symbol, 0), after)
            assert C.crossed(symbol, n, C.END) == after


def plain_repair(rows):
    """(cost, audit, hash) of damaged rows (role, text) in order."""
    seen, marks = set(), []
    for role, text in rows:
        bare = text.strip(C.BLANKS)
        gone = not bare or (role, text) in seen
        seen.add((role, text))
        marks.append((role[:1], gone, bool(bare) and bare[-1] not in ".!?"))
    cost, audit = C.solved(runs_of(marks))
    out, state, left = [], C.START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit in "IR":
            state = C.NEXT[state]
            out.append(f"{C.NAMES[state]}:{text}")
        elif edit == "K":
            state = C.SYSTEM if role.startswith("s") else C.NEXT[state]
            out.append(f"{role}:{text}")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def against_sql(spark, rows, schema=TURNS):
    df = spark.createDataFrame(rows, schema)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    assert difference(C.repaired(df), con, C.SQL) is None


def test_table(spark, folder):
    assert difference(C.query(spark, folder), connect(folder), C.SQL) is None


def test_nulls_ties_and_odd_roles(spark):
    rng = random.Random(5)
    texts = ["", " \t\n", None, "Yes.", "No", "a!b?c.", "é。", "Yes. \x0b", " ", "x" * 3000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(0, 6)):
            turn = rng.choice([turn, turn, turn, 3, None])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s"]), rng.choice(texts)))
    against_sql(spark, rows + rows[:10])


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi.", "x", 3, "D", 9), (1, 1, "assistant", "Yes.", None, 1, "K", 9)]
    against_sql(spark, rows, TURNS + ", audit string, place long, symbol string, n long")


def test_empty_table(spark):
    assert C.repaired(spark.createDataFrame([], TURNS)).collect() == []


def test_a_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(1000) if spark.range(1).selectExpr(f"crc32('7:{t}') % 20").first()[0] == 0)
    row = C.repaired(spark.createDataFrame([(7, turn, "user", "Hi.")], TURNS)).first()
    assert row[1:7] == (0,) * 6 and row.audit == "" and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("same", [False, True])
def test_a_hot_conversation(spark, same):
    """A third of all rows in one conversation, over many tasks; with equal rows too."""
    rng = random.Random(8)
    rows = [(1, 7 if same else t, rng.choice(["user", "assistant"]), "Same." if same else rng.choice(["A.", f"t {t}.", f"cut {t}"])) for t in range(6000)]
    rows += [(t, 0, "user", "Hi.") for t in range(2, 300)]
    df = spark.createDataFrame(rows, TURNS)
    got = C.repaired(df).where("conv_id = 1").first()
    order = sorted(((x.turn, x.role, hashlib.sha256(x.text.encode()).hexdigest(), x) for x in C.damaged(df).where("conv_id = 1").collect()), key=lambda x: x[:3])
    want = plain_repair([(x.role, x.text) for *_, x in order for _ in range(x.copies)])
    assert (got.cost, got.audit, got.repaired_sha256) == want
