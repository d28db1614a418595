"""Packing against plain best fit and an exact optimum; sharding against its law and the curve's definition."""

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tenura.llm import packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, rank int"


def expanded(counts, runs):
    """(bin, offset, length) of every item."""
    out = []
    for length, _, items, first, per, offset in runs.tolist():
        out += [(first + i // per, offset + (i % per) * length, length) for i in range(items)]
    return out


def checked(counts, capacity):
    runs, bins = packing.packed_runs(np.array(counts), capacity)
    placed = expanded(counts, runs)
    assert sorted(x for *_, x in placed) == [k for k, n in enumerate(counts) for _ in range(n)]
    by_class = {}
    for length, first, items, *_ in runs.tolist():
        assert by_class.get(length, 0) == first
        by_class[length] = first + items
    ends = {}
    for at, offset, length in sorted(placed):
        assert ends.get(at, 0) == offset
        ends[at] = offset + length
    assert all(x <= capacity for x in ends.values()) and set(ends) == set(range(bins))
    return bins


def best_fit(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(capacity - x)
    return len(room)


def optimum(lengths, capacity):
    """Fewest bins, by dynamic programming over subsets."""
    best = {0: (1, 0)}
    n = len(lengths)
    for mask in range(1, 1 << n):
        best[mask] = min(
            (b, u + x) if u + x <= capacity else (b + 1, x)
            for i, x in enumerate(lengths)
            if mask >> i & 1
            for b, u in [best[mask ^ (1 << i)]]
        )
    return best[(1 << n) - 1][0] if n else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_places_every_item_and_is_no_worse_than_its_bound(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    assert checked(counts, 40) <= best_fit(lengths, 40) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimal_packing(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    taken = packing.reduced(counts, 20)
    rest = [k for k, n in enumerate(counts.tolist()) for _ in range(n)]
    assert sum(n for _, n in taken) + optimum(rest, 20) == optimum(lengths, 20)


def test_many_equal_items_are_placed_in_bulk():
    counts = np.zeros(2049, np.int64)
    counts[[3, 500, 700, 1024, 2048]] = [10**9, 10**8, 10**8 + 1, 7, 5]
    runs, bins = packing.packed_runs(counts)
    assert len(runs) < 200
    assert bins <= 1.05 * (counts * np.arange(2049)).sum() / 2048 + 1


def test_documents_are_cut_and_packed(spark):
    text = "The quick brown fox's idea, it's 42!\n\nŁódź \x1f x  y\t<|endoftext|>ok " + "ÀÉ" * 60
    rows = [(1, text, "en", "a", 1, 7, 7), (2, None, None, None, None, 7, 7), (3, "", "en", "a", 0, 7, 7)]
    rows += [(4, "word " * 5000, "en", "a", 1, 7, 7), (5, "x" * 9000, "en", "b", 1, 7, 7), (None, "null key", "en", "a", 1, 7, 7)]
    rows += [(6, text, "en", "a", 1, 7, 7)] * 3
    found = packing.pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    expected = []
    for key, text, *_ in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((key, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    own = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(map(str, own)) == sorted(map(str, expected))
    ends = {}
    for at, offset, length in sorted((r.sequence_id, r.offset, r.length) for r in found):
        assert ends.get(at, 0) == offset
        ends[at] = offset + length
    assert max(ends.values()) <= 2048


def test_word_coder_equals_the_tokenizer(spark, folder):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for text, ids in zip(texts, packing.WordCoder(packing.tokenizer_path()).texts(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(cells, [f"c{i}" for i in range(n)])
        df = df.select("*", sharding.hilbert_index([df[f"c{i}"].cast("int") for i in range(n)], bits).alias("h"))
        path = [tuple(r)[:n] for r in df.orderBy("h").collect()]
        assert sorted(r.h for r in df.collect()) == list(range(1 << n * bits))
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def test_shards_keep_their_law(spark):
    rows = [(i, f"text {i % 40}" * (i % 7), ["en", "de", None][i % 3], f"src{i % 9}", i, 1, 2) for i in range(310)]
    rows += [(400, None, None, None, None, 1, 2), (5, rows[5][1], "de", "src5", 5, 1, 2), (None, "é", "en", "b", 1, 1, 2)]
    found = sharding.document_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    places = {}
    for r in found:
        places.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in places.values()]
    assert set(places) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    size = {str(k): (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows}
    assert all(size[str(r.doc_id)] == (r.size, r.text_crc32) for r in found)
    order = [(r.hilbert, r.text_crc32) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_equal_texts_of_equal_metadata_are_one_run(spark):
    rows = [(i, f"text number {i}", ["en", "de"][i % 2], f"src{i % 5}", 1, 1, 2) for i in range(240)]
    rows += [(1000 + i, "one text held by many", "en", "src1", 1, 1, 2) for i in range(120)]
    rows += [(2000 + i, "one text held by many", "fr", "src4", 1, 1, 2) for i in range(6)]
    found = sorted(sharding.document_shards(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: (r.shard, r.slot))
    for low, high in ((1000, 2000), (2000, 3000)):
        places = [i for i, r in enumerate(found) if low <= r.doc_id < high]
        assert places == list(range(places[0], places[0] + len(places)))
    assert len({r.shard for r in found if 1000 <= r.doc_id < 2000}) <= -(-120 // (366 // 24)) + 1


def test_few_rows_and_none(spark):
    few = sharding.document_shards(spark.createDataFrame([(1, "a", "en", "s", 1, 1, 2)] * 3, DOCS)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.document_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i, 1, 2) for i in range(50)], DOCS)
    sharding.write_shards(docs, sharding.document_shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_a_worker_keeps_one_large_thing_and_tasks_of_other_kinds_drop_it():
    from tenura.llm import common

    common.drop_kept()
    made = []
    for key in ("a", "a", "b", "b"):
        assert common.kept(key, lambda: made.append(key) or key) == key
    assert made == ["a", "b"] and list(common._KEPT) == ["b"]
    assert list(common.tidied(iter, keeps=True)([1, 2])) == [1, 2] and list(common._KEPT) == ["b"]
    assert list(common.tidied(iter)([1, 2])) == [1, 2] and not common._KEPT


def test_a_coder_holds_few_bytes_and_its_ids_are_right_when_words_push_each_other_out(monkeypatch):
    held = packing.WordCoder(packing.tokenizer_path()).table
    assert sum(x.nbytes for x in (*held.marks, held.at, held.n, held.ids)) <= 32 << 20
    monkeypatch.setattr(packing, "WORD_SLOTS", 16)
    monkeypatch.setattr(packing, "WORD_IDS", 64)
    small = packing.WordCoder(packing.tokenizer_path())
    texts = [" ".join(f"word{i * j} plain, text." for j in range(1, 40)) for i in range(20)]
    for _ in range(2):
        for text, ids in zip(texts, small.texts(texts)):
            assert ids.tolist() == small.tokenizer.encode(text.lower(), add_special_tokens=False).ids
