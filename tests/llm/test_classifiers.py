"""Language, toxicity and quality: gradients against differences, plain evaluations, edge cases, held-out accuracy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import langid, quality, toxicity
from tenura.llm.common import bounded_batches, class_sample, held_out, letter_words

DOCS = "doc_id long, text string, lang string, source string, score double, toxic int, quality int"
ODD = [
    (1, None, "en", None, 0.0, 1, 1),
    (2, "", "en", "s", 0.0, 1, 1),
    (3, "12 34 -- !!", None, "s", 0.0, 1, 1),
    (None, "the cat", "en", "s", 0.0, 1, 1),
    (5, "x" * 200_000, "en", "s", 0.0, 1, 1),
    (6, "word " * 60_000, "en", "s", 0.0, 1, 1),
    (7, "same text.", "en", "s", 0.0, 1, 1),
    (7, "same text.", "en", "s", 0.0, 1, 1),
    (8, "中文   \U0001f600 \x00", "en", "s", 0.0, 1, 1),
]


def numeric(f, x, at, step):
    old = x[at]
    x[at] = old + step
    up = f()
    x[at] = old - step
    down = f()
    x[at] = old
    return (up - down) / (2 * step)


def test_backpropagation_through_time_matches_differences():
    net = langid.ByteNetwork(["a", "b", "c"], hidden=4, seed=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    words, labels = [b"hello", b"abc", b"zz", "süß".encode()], np.array([0, 1, 2, 1])
    _, grads = net.gradients(words, labels)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        places = np.argwhere(np.abs(g) > 1e-3) if name[0] == "x" else np.argwhere(np.ones(g.shape))
        for at in map(tuple, rng.permutation(places)[:6]):
            expected = numeric(lambda: net.gradients(words, labels)[0], net.weights[name], at, 1e-2)
            assert g[at] == pytest.approx(expected, rel=0.05, abs=2e-4), (name, at)


def test_word_scores_do_not_depend_on_company():
    net = langid.ByteNetwork(["a", "b"], seed=1)
    words = [b"one", b"seventeen", b"x" * 70, "ñandú".encode()]
    together = net.word_scores(words)
    alone = np.concatenate([net.word_scores([w]) for w in words])
    assert np.allclose(together, alone, atol=1e-5)
    assert np.allclose(net.label_bytes([b"one"])[0].mean(0), together[0], atol=1e-5)


@pytest.fixture(scope="module")
def network(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return langid.train_network(docs.where(~held_out(F.col("doc_id"), 3, 1)), words=20_000)


def test_language_held_out_accuracy(spark, folder, network):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(held_out(F.col("doc_id"), 3, 1))
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, network).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([found[k] == truth[k] for k in truth]) >= 0.95


def test_language_of_odd_texts(spark, network):
    found = langid.identify(spark.createDataFrame(ODD, DOCS), network).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[3].score == 0.0
    assert all(r.lang_pred in [*network.languages, "und"] and 0 <= r.score <= 1 for r in found)
    none = langid.identify(spark.createDataFrame(ODD, DOCS), None).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.train_network(spark.createDataFrame([], DOCS)) is None
    assert langid.identify(spark.createDataFrame([], DOCS), network).collect() == []


def test_every_letter_byte_is_labelled(network):
    text = "Être ou, ne pas."
    data = text.lower().encode()
    spans = langid.language_spans(network, text)
    covered = {i for a, b, _ in spans for i in range(a, b)}
    assert b"".join(data[i : i + 1] for i in sorted(covered)) == b"".join(letter_words(text))


def test_toxicity_learns_from_documents_and_locates(spark):
    rng = np.random.default_rng(0)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(rng.integers(1, 9))]
        if i % 5 == 0:
            sentences[rng.integers(len(sentences))] += " " + rng.choice(["rotten", "rotting", "vile"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(i % 5 == 0))
    model = toxicity.train(texts[:200], np.array(labels[:200]))
    scores = [model.score(t, {})[0] for t in texts[200:]]
    assert [int(s >= 0.5) for s in scores] == labels[200:]
    text = "Alpha beta. You rotten thing! Gamma delta."
    assert [text[a:b].strip() for a, b, _ in model.offending(text)] == ["You rotten thing!"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text)], "doc_id long, text string")
    assert [(r.doc_id, r.sentence.strip()) for r in toxicity.locate(docs, model).collect()] == [(1, "You rotten thing!")]


def test_long_sentences_are_cut_and_word_order_does_not_matter():
    words, starts = toxicity.instances("a " * 50 + ". b c\n\nd")
    assert len(words) == 53 and starts.tolist() == [0, 24, 48, 50, 52]
    assert toxicity.instances("... !")[1].tolist() == []


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_texts(spark, folder, module):
    docs = spark.createDataFrame(ODD, DOCS)
    column = toxicity.toxicity_column if module is toxicity else quality.quality_column
    texts = ["good words here"] * 20 + ["BAD!! BAD!! BAD!!"] * 20
    model = module.train(texts, np.array([1] * 20 + [0] * 20), steps=30)
    for m in (model, None):
        found = docs.select("doc_id", column(m, F.col("text")).alias("f")).select("doc_id", "f.*").collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 7}) == 1
    assert docs.limit(0).select(column(model, F.col("text"))).collect() == []


def test_attention_gradients_match_differences():
    texts = ["One two three. Four " * 20, "", "x", "LOUD!! " * 50]
    model = quality.train(texts, np.array([1, 0, 1, 0]), steps=3)
    x, owner = quality.passages(texts)
    y, weight = np.array([1.0, 0, 1, 0]), np.full(4, 0.25)
    _, grads = model.gradients(x, owner, y, weight)
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:5]:
            expected = numeric(lambda: model.gradients(x, owner, y, weight)[0], model.weights[name], at, 1e-4)
            assert g[at] == pytest.approx(expected, rel=1e-3, abs=1e-6)


def test_passage_counts_match_a_plain_loop():
    texts = ["Ab cd! ef\n12 ab ab " * 9, None, "", "  ", "one", "é É x|y " * 40]
    x, owner = quality.passages(texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        own = x[owner == i]
        assert len(own) == max(1, -(-len(words) // 32))
        for k, row in enumerate(own):
            part = words[32 * k : 32 * k + 32]
            if not part:
                assert not row.any()
                continue
            n = sum(map(len, part))
            assert row[2] == pytest.approx(sum(c in b"0123456789" for w in part for c in w) / n, abs=1e-6)
            assert row[12] == pytest.approx(len(set(part)) / len(part), abs=1e-6)
            before = words[: 32 * k]
            again = sum(w in before or w in part[:j] for j, w in enumerate(part))
            assert row[13] == pytest.approx(again / len(part), abs=1e-6)


def test_quality_held_out_accuracy(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out(F.col("doc_id"), 4, 2)
    model = quality.train_quality(docs, labels, held)
    scored = docs.where(held).select("doc_id", quality.quality_column(model, F.col("text")).alias("f"))
    rows = scored.join(labels, "doc_id").select("f.score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) >= 0.85


def test_language_scores_match_a_plain_evaluation(network):
    """Byte by byte, one word and one state at a time."""
    texts = ["Être ou ne pas être.", "The thing of the and", "x", "Straße über alles " * 3, "日本語のテキスト " + "é" * 700, "12 ! ab"]
    names, scores, counts = langid.Pool(network).documents(texts)
    w, h = network.weights, network.hidden

    def states(codes, d):
        state, out = np.zeros(h), []
        for c in codes:
            x = w[f"x{d}"][c].astype(float)
            z, r = (1 / (1 + np.exp(-(x[i * h : (i + 1) * h] + state @ w[f"u{d}"][:, i * h : (i + 1) * h]))) for i in (0, 1))
            new = np.tanh(x[2 * h :] + r * (state @ w[f"u{d}"][:, 2 * h :]))
            state = new + z * (state - new)
            out.append(state)
        return out

    def word_logs(word):
        total = np.zeros(len(network.languages))
        for piece in langid.pieces(word, langid.PIECE):
            for f, b in zip(states(piece, "f"), states(piece[::-1], "b")[::-1]):
                logits = np.concatenate([f, b]) @ w["o"] + w["c"]
                total += logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        return total / len(word)

    for text, name, score, count in zip(texts, names, scores, counts):
        logs = np.array([word_logs(x) for x in letter_words(text)])
        best = int(logs.sum(0)[: network.learned].argmax())
        shares = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
        assert (name, count) == (network.languages[best], sum(-(-len(x) // 12) for x in letter_words(text))) and score == pytest.approx(shares[:, best].mean(), abs=2e-4)


def test_pieces_end_between_characters():
    word = ("aé日" * 40).encode()
    for longest in (4, 7, 24, 48):
        parts = langid.pieces(word, longest)
        assert b"".join(parts) == word and all(0 < len(p) <= longest and p.decode() for p in parts)
    assert langid.pieces(b"abc", 48) == [b"abc"]


def test_training_uses_all_pieces_of_a_word(spark, monkeypatch):
    """A script without spaces: what stands far behind in a sentence teaches as well as its beginning."""
    seen = []
    monkeypatch.setattr(langid.ByteNetwork, "train", lambda self, words, labels: seen.extend(words))
    rows = [(i, "一" * 40 + "二" * 40, "zh", "s", 80) for i in range(9)] + [(100 + i, "plain words here", "en", "s", 16) for i in range(9)]
    langid.train_network(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    learned = [w for w in seen if "二".encode() in w]
    assert learned and all(len(w) <= langid.LEARNED_PIECE for w in seen)


def test_toxicity_scores_match_a_plain_noisy_or():
    rng = np.random.default_rng(2)
    texts = [". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "vile", "rotten"], rng.integers(1, 30), p=[0.4, 0.3, 0.28, 0.01, 0.01])) for _ in range(rng.integers(1, 12))) for _ in range(60)]
    labels = np.array([int("vile" in t) for t in texts])
    model = toxicity.train(texts, labels, steps=60)
    for text in [*texts, "", "!?", "one", "vile"]:
        sentences = [s.split() for s in re.split("[.!?\n]", text.lower()) if s.split()]
        chunks = [s[a : a + 24] for s in sentences for a in range(0, len(s), 24)]
        stay = 1.0
        for chunk in chunks:
            evidence = sum(model.weights.get(f, 0.0) for w in chunk for f in {w.encode(), *(w.encode()[:k] + b"*" for k in (4, 5) if len(w) > k)})
            z = model.bias + evidence - np.log(len(chunks)) * np.exp(-evidence)
            stay *= 1 - 1 / (1 + np.exp(-z))
        assert model.score(text, {})[0] == pytest.approx(1 - stay, abs=1e-9)


def test_toxicity_gives_no_constant_and_no_alarm_to_long_harmless_texts():
    texts = ["Harmless sentence of words. " * n for n in (1, 2, 5, 9)] * 10 + ["Harmless sentence. Vile thing. " * 2] * 10
    model = toxicity.train(texts, np.array([0] * 40 + [1] * 10))
    scores = [model.score("Harmless sentence of words. " * n, {})[0] for n in (1, 10, 1000, 100_000)]
    assert all(0 < s < 0.5 for s in scores) and len(set(scores)) == 4
    assert model.score("Harmless sentence. " * 1000 + "Vile thing.", {})[0] > max(scores)


def test_quality_scores_match_a_plain_attention():
    texts = ["One two three. Four " * 20, "", "x", "LOUD!! " * 50, None, "a b c " * 200]
    model = quality.train([t or "" for t in texts], np.array([1, 0, 1, 0, 0, 1]), steps=20)
    x, owner = quality.passages(texts)
    scores, _, shares = model.score(texts)
    w = model.weights
    for i in range(len(texts)):
        rows = [np.clip((row - model.mean) / model.scale, -6, 6) for row in x[owner == i]]
        hidden = [np.tanh(row @ w["W"] + w["b"]) for row in rows]
        e = [float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]) for h in hidden]
        weights = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
        logit = sum(a * h for a, h in zip(weights, hidden)) @ w["c"] + w["d"][0]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-5, abs=1e-6)
        assert np.allclose(shares[owner == i], weights, atol=1e-5)


def test_class_sample_is_bounded_and_repeats(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("y"))
    first = class_sample(df, "y", "doc_id", 150)
    counts = {r.y: r["count"] for r in first.groupBy("y").count().collect()}
    assert 90 < counts[0] < 220 and 90 < counts[1] <= 200
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in first.repartition(3).collect())


def test_toxicity_holds_few_bytes_of_words_that_never_come_again():
    model = toxicity.SentenceModel({b"rotten": 9.0, b"long*": 9.0, b"longw*": 1.0}, -5.0)
    text = "rotten thing. " + " ".join(f"longword{chr(97 + i % 26) * 5000}{chr(97 + i // 26) * 9}" for i in range(400))
    cache: dict[bytes, float] = {}
    scores = [model.score(text, cache) for _ in range(2)]
    assert scores[0] == scores[1] == model.score(text, {})
    words, starts = toxicity.instances(text)
    evidence = np.add.reduceat([model.word(w) for w in words], starts)
    assert np.allclose(model.instance_scores(text, cache), toxicity.logits(model.bias, evidence, np.log(len(starts))))
    assert {b"rotten", b"thing"} <= set(cache) and sum(map(len, cache)) < 10_000


def test_text_is_scanned_a_few_rows_at_a_time_unless_the_user_chose(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        bounded_batches(spark)
        assert int(spark.conf.get(name)) <= 1000
        spark.conf.set(name, "2048")
        bounded_batches(spark)
        assert spark.conf.get(name) == "2048"
    finally:
        spark.conf.set(name, before)
