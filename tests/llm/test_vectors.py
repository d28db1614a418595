"""Exact top-k and embedding near-duplicates against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenura.llm import neardup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def rows_with_oddities(n=300, dims=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.15 * rng.standard_normal(dims)
        rows.append((i, [float(x) for x in v], i % 3, "x"))
    rows[10] = (10, None, 1, "x")
    rows[20] = (20, [0.0] * dims, 2, "x")
    rows[21] = (21, [float("nan")] * dims, 2, "x")
    rows[22] = (22, [None] + [1.0] * (dims - 1), 2, "x")
    rows[23] = (23, [math.inf] * dims, 2, "x")
    rows[24] = (24, rows[25][1], 1, "x")
    rows[30] = (30, rows[30][1], None, "x")
    rows[31] = (31, [1.0, 2.0], 1, "x")
    rows[32] = (32, [], 1, "x")
    for i in range(100, 140):  # copies of one vector
        rows[i] = (i, rows[100][1], 0, "x")
    return rows


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_matches_brute_force(spark):
    rows = rows_with_oddities()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    vectors = topk.quantised(df)
    found = topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, query_block=2, row_block=16).collect()
    f32 = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _, _ in rows if fine(v)}
    expected = []
    for q in sorted(i for i in f32 if i % 50 == 0):
        scores = sorted((-int(f32[q] @ v), i) for i, v in f32.items() if i != q and len(v) == len(f32[q]))
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, found)) == expected


def test_top_k_bounds_prune_and_large_values_stay_exact():
    rng = np.random.default_rng(0)
    scale = np.repeat([400.0, 20.0, 2.0, 1.0], 16)[:, None]
    columns = (rng.standard_normal((64, 3000)) * scale).astype(np.int64)
    own = columns[:, :4].copy()
    best = topk._Best(4, 5)
    work = topk.search_block(np.arange(4), own, np.arange(3000), columns, best)
    assert work < 0.6 * own.shape[1] * columns.size
    for q in range(4):
        scores = own[:, q] @ columns
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:5]
        assert best.ids[q].tolist() == order and best.score[q].tolist() == scores[order].tolist()
    big = np.array([[3_000_000_000, 3_000_000_001, -5]])
    best = topk._Best(1, 5)
    topk.search_block(np.array([9]), np.array([[1_000_000_007]]), np.arange(3), big, best)
    assert best.score[0].tolist() == [1_000_000_007 * 3_000_000_001, 1_000_000_007 * 3_000_000_000, -5_000_000_035]


def test_tasks_name_a_query_alike_and_ids_may_occur_twice():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-99, 99, (40, 6))
    places = [(100, 7), (101, 3), (102, 9), (103, 3)]  # place and id
    queries = pd.DataFrame([(key, place, vectors[i].tolist()) for i, (place, key) in enumerate(places)], columns=["vec_id", "rank", "v"])
    blocks = topk.query_blocks(queries, 3)
    assert [len(ids) for ids, *_ in blocks] == [3, 1]
    rows = pd.DataFrame([(1000 + j, v.tolist()) for j, v in enumerate(vectors)], columns=["vec_id", "v"])
    found = pd.concat([x for task in (0, 1) for x in topk.search_rows([rows[task::2][:9], rows[task::2][9:]], blocks, 5, 8)])
    assert set(zip(found["place"], found["query_id"])) == set(places)
    for i, (place, _) in enumerate(places):
        own = found[found["place"] == place].sort_values(["score", "vec_id"], ascending=[False, True])[:5]
        scores = sorted((-int(vectors[i] @ v), 1000 + j) for j, v in enumerate(vectors))[:5]
        assert list(zip(-own["score"], own["vec_id"])) == scores


def test_rounds_of_queries_give_what_one_gives(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(5)], 1, "") for i in range(300)] + [(None, [1.0] * 5, 1, ""), (40, [0.5] * 5, 1, "")]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA).repartition(3))
    queries = vectors.where("vec_id % 20 = 0")
    one = sorted(map(tuple, topk.top_k(queries, vectors).collect()))
    assert len(one) == 16 * 5 and one == sorted(map(tuple, topk.top_k(queries, vectors, query_block=3, round_=4).collect()))


def test_top_k_of_nothing(spark):
    empty = topk.quantised(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(empty, empty).collect() == []
    one = topk.quantised(spark.createDataFrame([(50, [1.0], 1, "x")], SCHEMA))
    assert topk.top_k(one, one).collect() == []


def brute_links(rows, threshold=0.93):
    usable = [(i, v, g) for i, v, g, _ in rows if fine(v) and g is not None and any(v)]
    links = {i: set() for i, *_ in rows}
    unit = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in usable]
    unit = [(i, v / np.linalg.norm(v), g) for i, v, g in unit]
    for a, (i, v, g) in enumerate(unit):
        for j, w, h in unit[:a]:
            if g == h and len(v) == len(w) and v @ w >= threshold:
                links[i].add(j)
                links[j].add(i)
    smallest = {}
    for i in sorted(links):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in smallest:
                smallest[x] = i
                stack.extend(links[x])
    return {i: (len(links[i]), smallest[i], smallest[i] == i) for i in links}


@pytest.mark.parametrize("chunk", [1024, 8])
def test_near_duplicates_match_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(neardup.link_counts, "__defaults__", (chunk,))
    rows = rows_with_oddities()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = neardup.near_duplicates(df, passes=8, window=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute_links(rows)
    assert len(found) == len(rows)


def test_near_duplicates_recall_on_the_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label, "") for r in df.collect()]
    expected = brute_links(rows)
    found = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, window=32).collect()}
    truth = sum(n for n, *_ in expected.values())
    assert all(found[i] <= expected[i][0] for i in found)
    assert truth == 0 or sum(found.values()) >= 0.9 * truth


def planted(n, pairs, cosine, seed=0, shared=0.0, width=64):
    """Vectors of one label with pairs at the given cosine; `shared` is the cosine between any two others."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(width)
    base /= np.linalg.norm(base)
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(shared) * base + np.sqrt(1 - shared) * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        other = rng.standard_normal(width)
        other -= other @ x[2 * i] * x[2 * i]
        x[2 * i + 1] = cosine * x[2 * i] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    return x


@pytest.mark.parametrize("shared", [0.0, 0.5])
def test_planted_pairs_far_beyond_the_window_are_found(spark, shared):
    """Pairs just above the threshold in a label many times as large as the window, with as many passes as it asks for."""
    x = planted(12_000, 500, 0.933, shared=shared)
    order = np.random.default_rng(1).permutation(len(x))
    rows = [(int(i), [float(c) for c in x[k]], 1, "") for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    links = int((np.triu(x[order] @ x[order].T, 1) >= 0.93).sum())
    found = neardup.near_duplicates(df, window=32).agg(F.sum("n_links")).first()[0] // 2
    assert links >= 500 and links * 0.95 <= found <= links


def test_more_vectors_ask_for_more_passes():
    asked = [neardup.passes_for(n) for n in (0, 10, 5_000, 10**6, 10**9)]
    assert asked == sorted(asked) and asked[0] == neardup.LEAST_PASSES and asked[-1] > 2 * asked[2]
    assert neardup.passes_for(10**6, 0.99) < neardup.passes_for(10**6, 0.93) < neardup.passes_for(10**6, 0.8)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), passes=2).collect() == []
