"""The pipeline against a plain version of each stage, and its contract on odd tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tenura.llm import langid, packing, toxicity  # noqa: E402
from tenura.llm.common import held_out  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = COLUMNS + ", score double, found string, doc string, n int"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_survivors(rows):
    """Smallest doc_id of every component of texts with Jaccard similarity of 0.8 or more."""
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    keys = sorted(sets)
    top = {k: k for k in keys}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root(a) != root(b):
                ra, rb = root(a), root(b)
                top[max(ra, rb)] = min(ra, rb)
    return {k for k in keys if root(k) == k}


def test_run_equals_the_plain_stages(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    network = langid.train_network(documents.where(~held_out(F.col("doc_id"), 3, 1)))
    rows = documents.collect()
    found = langid.Pool(network).documents([r.text for r in rows])
    rows = [r for r, n, s, w in zip(rows, *found) if n != "und" and s >= network.least - 0.5 / w**0.5]

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    learned = sorted(
        (r.doc_id, r.text, labels[r.doc_id])
        for r in rows
        if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5
    )
    model = toxicity.train([t for _, t, _ in learned], np.array([y for *_, y in learned]))
    rows = [r for r in rows if model.score(r.text, {})[0] < 0.5]
    survivors = plain_survivors(rows)

    coder = packing.WordCoder(packing.tokenizer_path())
    expected = {}
    for r in rows:
        if r.doc_id in survivors:
            ids = coder.tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
            expected[r.doc_id] = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
    found = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in found} == {
        (k, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, parts in expected.items() for i, p in enumerate(parts)
    }
    assert len(found) == sum(map(len, expected.values()))
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_stages_keep_columns_and_survive_odd_rows(spark, folder):
    real = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    extra = real.select("*", F.lit(1.0).alias("score"), F.lit("x").alias("found"), F.lit("y").alias("doc"), F.lit(3).alias("n"))
    odd = [
        (None, "the of and thing", "en", None, 1, None, None, None, None),
        (None, "the of and thing", "en", None, 1, None, None, None, None),
        (9001, None, None, None, None, None, None, None, None),
        (9002, "", "en", "s", 0, 1.0, "a", "b", 1),
        (9003, "12 34 !!", "en", "s", 8, 1.0, "a", "b", 1),
        (9004, "the of and " * 30_000, "en", "s", 1, 1.0, "a", "b", 1),
    ]
    docs = extra.unionByName(spark.createDataFrame(odd + odd[-1:], MORE))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == extra.columns
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(None) == 1 and kept.count(9004) <= 1
    assert not {9001, 9002, 9003} & set(kept)


def test_the_language_stage_rejects_what_is_like_no_learned_text(spark, folder):
    real = spark.read.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 900)) for _ in range(3)]
    strange = noise + [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 5,
        "Η ζωή είναι ωραία και ο ήλιος λάμπει κάθε μέρα στην πόλη. " * 5,
        "全ての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。" * 4,
        "asdf jkl; qwer uiop zxcv bnm, " * 20,
    ]
    odd = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(strange)], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, real.unionByName(odd), folder).collect()}
    clean = {r.doc_id for r in real.where("text rlike '[A-Za-z]'").collect()}
    assert kept == clean


def test_equal_ids_with_different_texts_stay_and_missing_ids_are_compared(spark, folder):
    one, two = "This is the first of two texts that share an id by accident.", "Another text altogether, which nobody would call a copy of it."
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, one), (1, two), (1, two), (2, long), (None, long), (None, "Alone and without an id, said in a few words."), (None, long + " end")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], COLUMNS).repartition(3)
    docs.write.mode("overwrite").parquet(path := folder_of(spark))
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, spark.read.parquet(path), folder).collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (2, long), (None, "Alone and without an id, said in a few words.")], key=str)


@pytest.mark.parametrize("marks", [1 << 19, 0])
def test_no_text_is_shuffled_to_keep_one_of_each_group(spark, folder, monkeypatch, marks):
    """The rows that stay are told by a bit each; tables with more words than `MARKS` are joined by a shuffle, with the same result."""
    rows = [(i // 2 if i % 7 else None, f"text {i % 150} has words of its own {i % 150} a b {i % 150}", "en", "s", i) for i in range(300)]
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(path := folder_of(spark))
    monkeypatch.setattr(corpus_pipeline, "MARKS", marks)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    try:
        found = corpus_pipeline.distinct(spark, spark.read.parquet(path), folder)
        plan = found._jdf.queryExecution().executedPlan().toString()
        kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("hashpartitioning" in plan) == (marks == 0)
    ids = {}
    for key, text, *_ in rows:
        ids.setdefault(text, []).append(key)
    assert kept == sorted(((min((k for k in v if k is not None), default=None), t) for t, v in ids.items()), key=str)


def folder_of(spark):
    from tenura.session import new_path

    return new_path(spark, "pipeline-test")


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []
