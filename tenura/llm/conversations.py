"""Conversation structure repair by dynamic programming over runs of equal symbols.

A conversation is a sequence of role/fault symbols. The cheapest edits that give it the form of an optional system turn and
then pairs of user and assistant turns are a shortest path through four states. What one symbol does to the costs of
the states is a 4 x 4 matrix over (min, +), so a run of n equal symbols is its n-th power: runs are collapsed first, and
each is crossed by the binary powers of its matrix, which are kept for all conversations. Then the choices
are unrolled run by run, halving each, for the audit: among the cheapest edits the first in ASCII order.

Rows are reduced to symbols and repeated rows to counts before anything is gathered; rows of one conversation are dealt to as many
tasks as the order by (conversation, turn) spreads them over, and only their runs meet in one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, keep, table

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FAR = 1 << 60
ACCEPTED = (START, ASSISTANT)
#: The state that a user or assistant turn leads to; the same turn is the only one allowed besides a first system turn.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A symbol is 2 * role + fault for roles s, u, a, other and faults none, truncated; GONE must be deleted.
ROLES = "sua"
GONE = 8
#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# The algebra of runs


def _insert_costs() -> Matrix:
    rows = []
    for state in range(STATES):
        costs = [FAR] * STATES
        cost, at = 0, state
        while cost < costs[at]:
            costs[at] = cost
            cost, at = cost + INSERT, NEXT[at]
        rows.append(tuple(costs))
    return tuple(rows)


INSERTS = _insert_costs()


def times(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(min(x[i][k] + y[k][j] for k in range(STATES)) for j in range(STATES)) for i in range(STATES))


def onto(x: Matrix, v: Vector) -> Vector:
    """The costs to the end before a step, from those after it."""
    return tuple(min(x[i][k] + v[k] for k in range(STATES)) for i in range(STATES))


def kept_state(state: int, symbol: int) -> int | None:
    """The state after keeping a row of this symbol, if its role may stand there."""
    role = symbol >> 1
    if role == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if role == (1 if NEXT[state] == USER else 2) else None


def edits(symbol: int) -> Matrix:
    """What a row of this symbol costs from state to state, without insertions."""
    rows = [[FAR] * STATES for _ in range(STATES)]
    for state in range(STATES):
        rows[state][state] = DELETE
        if symbol != GONE:
            extra = UNFINISHED * (symbol & 1)
            to = kept_state(state, symbol)
            if to is not None:
                rows[state][to] = min(rows[state][to], KEEP + extra)
            rows[state][NEXT[state]] = min(rows[state][NEXT[state]], REROLE + extra)
    return tuple(map(tuple, rows))


@functools.cache
def power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2 ** bit rows of a symbol, each after any insertions."""
    return times(INSERTS, edits(symbol)) if bit == 0 else times(power(symbol, bit - 1), power(symbol, bit - 1))


def crossed(symbol: int, n: int, after: Vector) -> Vector:
    """Costs to the end before a run of n equal symbols."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            after = onto(power(symbol, bit), after)
    return after


def _end() -> Vector:
    return tuple(min(INSERTS[s][t] for t in ACCEPTED) for s in range(STATES))


END = _end()


def _unrolled(symbol: int, n: int, state: int, after: Vector, out: list[str]) -> int:
    """Append the edits of a run from a state on, first in ASCII order; the state behind it."""
    todo = [(n, after)]
    while todo:
        n, after = todo.pop()
        if n > 1:  # the first part is as good as the costs at its end, which come from the second
            half = 1 << ((n - 1).bit_length() - 1)
            todo.append((half, after))
            todo.append((n - half, crossed(symbol, half, after)))
            continue
        before = onto(power(symbol, 0), after)
        while True:
            left = before[state]
            if DELETE + after[state] == left:
                out.append("D")
                break
            if INSERT + before[NEXT[state]] == left:
                out.append("I")
                state = NEXT[state]
                continue
            extra = UNFINISHED * (symbol & 1)
            to = kept_state(state, symbol)
            if to is not None and KEEP + extra + after[to] == left:
                out.append("K")
                state = to
                break
            out.append("R")
            state = NEXT[state]
            break
    return state


@functools.lru_cache(1 << 14)
def _short(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return solved(runs)


def solved(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """(cost, audit) of a conversation given as runs (symbol, rows)."""
    costs = [END]
    for symbol, n in reversed(runs):
        costs.append(crossed(symbol, n, costs[-1]))
    costs.reverse()
    out: list[str] = []
    state = START
    for (symbol, n), after in zip(runs, costs[1:]):
        state = _unrolled(symbol, n, state, after, out)
    while state not in ACCEPTED:
        out.append("I")
        state = NEXT[state]
    return costs[0][START], "".join(out)


def repair(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    return _short(runs) if len(runs) <= 32 and all(n < 64 for _, n in runs) else solved(runs)


# Rows


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of "conv_id:turn" names; copies is 2 for a repeated row.

    A null conv_id, turn, role or text reads as one space; the key columns stay null.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def narrowed(rows: DataFrame) -> DataFrame:
    """Damaged rows without their texts, equal ones counted: (conv_id, turn, role, digest, blank, open, n)."""
    bare = F.rtrim("text", F.lit(BLANKS))
    last = F.right(bare, F.lit(1))
    slim = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("open"), "copies",
    )
    keys = ["conv_id", "turn", "role", "digest", "blank", "open"]
    return slim.groupBy(*keys).agg(F.sum("copies").alias("n"))


def symbols(rows: DataFrame) -> DataFrame:
    """Adds `symbol` and `again` to counted rows: their own symbol, and whether role and text were seen at an earlier turn.

    The search for earlier turns is dealt by conversation, role and text.
    """
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(earlier) > 1
    initial = F.substring("role", 1, 1)
    role = F.lit(3)
    for i, name in enumerate(ROLES):
        role = F.when(initial == name, F.lit(i)).otherwise(role)
    return rows.withColumns({"again": again, "initial": initial, "role_no": role})


SEGMENTS = (
    "conv_id long, null_id boolean, place long, runs array<struct<symbol:int,n:long>>, first string, last string, illegal long, "
    "blank long, duplicate long, truncated long, low long, high long, turns long"
)
FINE = {"su", "ua", "au"}


def segments(rows: DataFrame) -> DataFrame:
    """The runs of each conversation, in as many rows as tasks hold parts of it, with what the counts need."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        own: dict | None = None
        done: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "role_no", "blank", "open", "again", "n", "place")]
            for key, turn, initial, role, blank, open_, again, n, place in zip(*columns):
                if own is None or own["conv_id"] != key:
                    if own is not None:
                        done.append(own)
                    own = {
                        "conv_id": key, "null_id": key is None, "place": place, "runs": [], "first": initial, "last": None, "illegal": 0,
                        "blank": 0, "duplicate": 0, "truncated": 0, "low": None, "high": None, "turns": 0,
                    }
                if turn is not None:
                    own["turns"] += turn != own["high"]
                    own["low"], own["high"] = turn if own["low"] is None else own["low"], turn
                if own["last"] is not None:
                    own["illegal"] += own["last"] + initial not in FINE
                own["illegal"] += (n - 1) * (initial + initial not in FINE)
                own["last"] = initial
                gone = blank or again
                for symbol, count in ((GONE if gone else 2 * role + open_, 1), (GONE, n - 1)):
                    if not count:
                        continue
                    if own["runs"] and own["runs"][-1]["symbol"] == symbol:
                        own["runs"][-1]["n"] += count
                    else:
                        own["runs"].append({"symbol": symbol, "n": count})
                own["blank"] += n if blank else 0
                own["duplicate"] += 0 if blank else n - (not again)
                own["truncated"] += open_ and not gone
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow())
                done = []
        if own is not None:
            done.append(own)
        yield pa.RecordBatch.from_pylist(done, schema=_arrow())

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return dealt.mapInArrow(run, SEGMENTS)


def _arrow() -> pa.Schema:
    run = pa.list_(pa.struct([("symbol", pa.int32()), ("n", pa.int64())]))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), run, pa.string(), pa.string(), *[pa.int64()] * 7]
    return pa.schema(list(zip([f.split()[0] for f in SEGMENTS.split(", ")], kinds)))


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audited(parts: DataFrame) -> DataFrame:
    """Per conversation its counts, the cost and the audit. Its parts come in order; only their runs are held."""

    def solve(key, held: list[dict]) -> dict:
        runs: list[tuple[int, int]] = []
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        low = high = last = None
        turns = 0
        for part in held:
            for r in part["runs"]:
                if runs and runs[-1][0] == r["symbol"]:
                    runs[-1] = r["symbol"], runs[-1][1] + r["n"]
                else:
                    runs.append((r["symbol"], r["n"]))
            for name in total:
                total[name] += part[name]
            if last is not None:
                total["illegal"] += last + part["first"] not in FINE
            last = part["last"]
            if part["low"] is not None:
                turns += part["turns"] - (part["low"] == high)
                low, high = part["low"] if low is None else low, part["high"]
        cost, audit = repair(tuple(runs))
        gaps = 0 if low is None else high - low + 1 - turns
        return {"conv_id": key, "gaps": gaps, **total, "cost": cost, "audit": audit}

    kinds = [pa.int64()] * 7 + [pa.string()]
    schema = pa.schema(list(zip([f.split()[0] for f in REPAIRED.split(", ")], kinds)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for part in batch.to_pylist():
                if held and held[0]["conv_id"] != part["conv_id"]:
                    done.append(solve(held[0]["conv_id"], held))
                    held = []
                held.append(part)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([solve(held[0]["conv_id"], held)], schema=schema)

    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    return dealt.mapInArrow(run, REPAIRED)


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the audit is applied to the texts as they stream by, in order.

    SHA-256 of a conversation is one sequence, so a conversation's texts pass through one task, a batch at a time: nothing of
    them is held but the hash.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, digests = [], []
        key, audit, at, state, sha, begun = None, "", 0, START, None, False

        def line(role: str, text: str) -> None:
            nonlocal begun
            if begun:
                sha.update(b"\n")
            sha.update(role.encode() + b":" + text.encode())
            begun = True

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                line(NAMES[state], "")
                at += 1

        def finish() -> None:
            if sha is not None:
                inserted()
                keys.append(key)
                digests.append(sha.hexdigest())

        for batch in batches:
            for own, audit_, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")]):
                if audit_ is not None:
                    finish()
                    key, audit, at, state, sha, begun = own, audit_, 0, START, hashlib.sha256(), False
                    continue
                for _ in range(copies):
                    inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        state = SYSTEM if role[:1] == "s" else NEXT[state]
                        line(role, text)
                    elif edit == "R":
                        state = NEXT[state]
                        line(NAMES[state], text)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(keys, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})
            keys, digests = [], []
        finish()
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(keys, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})

    none = F.lit(None)
    heads = audits.select("conv_id", "audit", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    lines = rows.select("conv_id", none.cast("string").alias("audit"), "turn", "role", "text", "copies")
    both = heads.unionByName(lines).withColumn("digest", F.when(F.col("audit").isNull(), F.sha2("text", 256)))
    # The audit first, then the rows in the order that the symbols were read in.
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "audit", "role", "text", "copies").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text), a null one included: faults, cheapest repair, hash of the result.

    Rows go by turn, nulls first; rows of one turn by role and then by the SHA-256 of their text, which is also what tells texts
    apart; a repeated row follows its original. Rows without a conv_id are one conversation. Empty and null texts are blank, roles
    other than s..., u..., a... can only be rewritten or deleted. A conversation that loses all rows has zeros, an empty
    audit and the hash of nothing. An empty table gives no rows; other columns, whatever their names, are not read. Very
    long texts are hashed whole; very long conversations are held as runs only.
    """
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations)
    counted = keep(symbols(narrowed(rows)), "turn-symbols")
    audits = keep(audited(segments(counted)), "audits")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = audits.join(hashed(rows, audits).withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")))
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def query(spark, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "conversations"))


#: The same in SQL: a shortest path over rows, one row at a time.
SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT keyed.*, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)]), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faults AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
follows(q, t, name) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserts AS (SELECT q, q AS t, 0 AS c, '' AS tail, '' AS said FROM follows
    UNION ALL SELECT i.q, f.t, i.c + 3, i.tail || 'I', i.said || f.name || ':' || chr(10)
    FROM inserts i JOIN follows f ON i.t = f.q WHERE i.c < 9),
edits AS (
    SELECT f.q, f.q AS t, 'D' AS e, 4 AS c, CAST(NULL AS VARCHAR) AS initial, CAST(NULL AS VARCHAR) AS name FROM follows f
    UNION ALL SELECT q, t, 'K', 0, t, NULL FROM follows
    UNION ALL SELECT '', 's', 'K', 0, 's', NULL
    UNION ALL SELECT q, t, 'R', 3, NULL, name FROM follows),
walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS best FROM faults
    UNION ALL
    SELECT w.conv_id, f.i, e.t, min({'c': w.best.c + s.c + e.c + CASE WHEN e.e <> 'D' AND f.cut THEN 3 ELSE 0 END,
        'a': w.best.a || s.tail || e.e, 'r': w.best.r || s.said ||
        CASE WHEN e.e = 'D' THEN '' ELSE coalesce(e.name, f.role) || ':' || f.text || chr(10) END})
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN inserts s ON s.q = w.q JOIN edits e ON e.q = s.t
    WHERE (e.e = 'D' OR NOT (f.blank OR f.again)) AND (e.initial IS NULL OR e.initial = left(f.role, 1))
    GROUP BY w.conv_id, f.i, e.t),
ends AS (SELECT w.conv_id, min({'c': w.best.c + s.c, 'a': w.best.a || s.tail, 'r': w.best.r || s.said}) AS best
    FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
    JOIN inserts s ON s.q = w.q WHERE s.t IN ('', 'a') GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
    coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost,
    coalesce(e.best.a, '') AS audit, sha256(CASE WHEN coalesce(e.best.r, '') = '' THEN '' ELSE left(e.best.r, -1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
