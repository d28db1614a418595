"""The Jaccard join against brute force."""

import re

import numpy as np
import pytest

from tenura.llm import hashing, jaccard

SCHEMA = "doc_id long, text string, n int, id long, component string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 4:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def brute(rows):
    sets = {}
    for key, text, *_ in rows:
        if key is not None:
            sets[key] = shingles(text)
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed, n=260, vocabulary=400):
    """Unrelated texts, chains of small edits, copies, a passage many texts share, and odd cases."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = list(rng.choice(words, 40))
    rows = []
    seeds = [list(rng.choice(words, rng.integers(20, 120))) for _ in range(6)]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            t = list(rng.choice(words, rng.integers(1, 90)))
        elif kind == 1:
            t = list(rng.choice(words, rng.integers(1, 30))) + passage + list(rng.choice(words, rng.integers(0, 12)))
        else:
            base = seeds[rng.integers(len(seeds))]
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = rng.choice(words)
            if kind == 4:
                seeds[rng.integers(len(seeds))] = t  # drift: chains whose ends do not link directly
        rows.append((int(i), " ".join(t), 1, 1, "x"))
    rows += [
        (1000, None, 1, 1, "x"), (1001, "", 1, 1, "x"), (1002, " \t\n", 1, 1, "x"),
        (1003, "One two", 1, 1, "x"), (1004, "one  TWO\n", 1, 1, "x"), (1005, "one two three", 1, 1, "x"),
        (1006, "É é É é", 1, 1, "x"), (1007, "é é é é", 1, 1, "x"), (1008, "a\x0bb\x0cc d", 1, 1, "x"),
        (1009, "a b c d", 1, 1, "x"), (1010, "a b\x85c d", 1, 1, "x"), (None, rows[0][1], 1, 1, "x"),
        (2, rows[2][1], 1, 1, "x"), (2, rows[2][1], 1, 1, "x"), (900, rows[3][1], 1, 1, "x"),
    ]
    return rows


@pytest.mark.parametrize("seed,lane", [(0, 1 << 15), (1, 5), (2, 5)])
def test_components_match_brute_force(spark, seed, lane):
    rows = corpus(seed)
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(3), lane=lane).collect()
    assert len(found) == len(rows)
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert len({c for _, c in expected.values()}) < len(expected) - 20


def test_table_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert found == brute(rows)


def test_nothing_to_join(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []
    one = jaccard.join(spark.createDataFrame([(4, None, 1, 1, "x")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4)]


def test_sets_equal_plain_shingles():
    texts = ["A b c d e a b c d", None, "", "x", "x y z", "a b c d", "q " * 9, "B C D e"]
    sets = jaccard.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(t) & shingles(u))


def test_bounds_are_exact():
    for n in range(1, 60):
        for m in range(n, 60):
            least = next(o for o in range(n + m + 1) if 100 * o >= 85 * (n + m - o))
            assert jaccard.needed(n, m) == least
            if least <= n:
                assert least >= n - jaccard.prefix_length(n) + 1 and least >= m - jaccard.prefix_length(m) + 1


def test_bitmaps_rule_out_no_link_and_most_others(spark):
    """Bitmaps grow with the sets; those of a pair may differ in length."""
    rng = np.random.default_rng(3)
    sets, pairs, links = {}, [], set()
    for k, n in enumerate((3, 200, 500, 512, 513, 1000, 1030, 4000, 8200)):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64)
        near = np.concatenate([base[: n - n // 12], rng.integers(0, 1 << 63, n // 20, dtype=np.int64)])
        for j, x in enumerate((base[:n], near, base[n // 2 : n // 2 + n])):
            sets[3 * k + j] = np.unique(x)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = sets[3 * k + a], sets[3 * k + b]
            pairs.append((3 * k + a, 3 * k + b, len(x), len(y)))
            if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
                links.add(pairs[-1][:2])
    bits = [(k, jaccard._bitmap(x).tolist()) for k, x in sets.items()]
    assert len(bits[0][1]) == 2048 // 64 and len(bits[-3][1]) == 65536 // 64
    found = jaccard.allowed(
        spark.createDataFrame(pairs, "a long, b long, na int, nb int"), spark.createDataFrame(bits, "id long, bits array<long>"), 85
    )
    left = {(r.a, r.b) for r in found.collect()}
    assert links and links <= left and len(left - links) <= 2
    uneven = [p[:2] for p in pairs if len(bits[p[0]][1]) != len(bits[p[1]][1])]
    assert uneven


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 90001}" for i in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5 w6"), (4, "x" * 3_000_000)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1][1] == found[2][1] == 1 and found[3][1] == 3 and found[4] == (1, 4)


def test_windows_hash_like_one(monkeypatch):
    text = "Ab cd\tef  " * 300 + "long" * 500 + " end é "
    whole = hashing.words_of(np.frombuffer(text.encode(), np.uint8))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(hashing, "WINDOW", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, hashing.words_of(np.frombuffer(text.encode(), np.uint8))))


def unlike(n=400, seed=5):
    """Texts that share a rare word run with two others each, and nothing else; two of them are near copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(int(rng.integers(20, 60)))]
        for run in (i // 3, (i + 1) // 3 + n):
            at = int(rng.integers(len(own)))
            own[at:at] = [f"r{run}y{k}" for k in range(4)]
        rows.append((i, " ".join(own)))
    return [*rows, (n, rows[0][1] + " end")]


def test_shingles_are_stored_of_likely_pairs_only(spark, monkeypatch):
    """Candidates are as many as share a shingle; what is stored of all of them is their bitmaps."""
    stored = {}

    def spy(df, label, keep=jaccard.keep):
        out = keep(df, label)
        stored.setdefault(label, []).append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(jaccard, "keep", spy)
    rows = unlike()
    found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 0 if i == 400 else i for i, _ in rows}
    shingled = [n for kinds in stored.values() for columns, n in kinds if "shingles" in columns]
    assert sum(shingled) < 40 and any("bits" in columns for kinds in stored.values() for columns, _ in kinds)


def test_short_lists_keep_only_members_that_can_link():
    rng = np.random.default_rng(8)
    sizes = np.array([2, 3, 1, 9, 40, 3, 5])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = int(sizes.sum())
    ids, n = rng.integers(0, 30, total), rng.integers(20, 60, total)
    pos = rng.integers(0, 9, total)
    used = np.where(sizes > 2, sizes, 0)
    found = jaccard._partnered(ids, n, pos, starts, used, 85)
    expected = np.zeros(total, bool)
    for a, k in zip(starts, used):
        for i in range(a + 1, a + k):
            expected[i] = any(ids[i] != ids[j] and jaccard.open_pair(n[i], pos[i], n[j], pos[j], 85) for j in range(a + 1, a + k))
    assert np.array_equal(found, expected) and 0 < found.sum() < total
    assert not jaccard._partnered(ids[:0], n[:0], pos[:0], starts[:0], used[:0], 85).any()


def test_lists_of_texts_that_cannot_link_are_not_kept(spark, monkeypatch):
    """Unlike texts that share a shingle make no list to look through again, however many there are."""
    lists = []

    def spy(df, label, keep=jaccard.keep):
        out = keep(df, label)
        if label == "stars":
            lists.append(out.where("kind = 1").count())
        return out

    monkeypatch.setattr(jaccard, "keep", spy)
    shared = " ".join(f"s{k}" for k in range(4))
    rows = [(i, " ".join(f"o{i}x{k}" for k in range(10 * 2**i)) + " " + shared) for i in range(6)]
    found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(6)} and lists == [0]
