"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words and of the document's length: a sentence without evidence is the less
likely to offend the more sentences there are, so that harmless sentences do not add up in long texts, and evidence lifts that
discount. A document is toxic if any sentence is, so its probability is the noisy-or of its sentences. Weights are
trained through the same noisy-or from document labels; afterwards the sentence probabilities locate what offends.

Very long texts are scored like all others; those beyond `common.LONGEST_LEARNED` characters do not teach. Repeated rows are scored
and sampled as rows; a doc_id that `labels` repeats teaches once per label row. Null and empty texts score 0, ties stay ties,
empty tables give no rows, and columns of other names are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, drop_kept, give_back, held_out, labelled_sample, slices, table

DOCS_PER_CLASS = 1500
INSTANCE_WORDS = 24
PREFIXES = (4, 5)
VOCABULARY = 200_000
FALSE_ALARMS = 0.002
#: Words whose weights a task holds, none of more bytes than `LONGEST_HELD`: about 45 MB at most.
CACHE_WORDS = 200_000
LONGEST_HELD = 64
#: Lower-cased UTF-8: sentence ends become line feeds, other ASCII that is no letter becomes a space.
ENDS = b".!?\n"
WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+[.!?]*")
SENTENCES = bytes(10 if b in ENDS else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def instances(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and the place where each instance starts: a sentence, or `INSTANCE_WORDS` words of a long one."""
    sentences = [s.split() for s in text.lower().encode().translate(SENTENCES).split(b"\n")]
    words = [w for s in sentences for w in s]
    n = np.fromiter(map(len, sentences), np.int64, len(sentences))
    n = n[n > 0]
    first = np.repeat(np.cumsum(n) - n, n)
    return words, np.flatnonzero((np.arange(len(words)) - first) % INSTANCE_WORDS == 0)


def features(word: bytes) -> list[bytes]:
    """The word itself and its first bytes, so that unseen endings of a known stem count too."""
    return [word] + [word[:k] + b"*" for k in PREFIXES if len(word) > k]


def logits(bias: float, evidence: np.ndarray, discount: np.ndarray | float) -> np.ndarray:
    """Of instances with some evidence in documents whose log number of instances is `discount`."""
    return bias + evidence - discount * np.exp(-evidence)


@dataclass
class SentenceModel:
    weights: dict[bytes, float]
    bias: float

    def word(self, word: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def instance_scores(self, text: str, cache: dict[bytes, float]) -> np.ndarray:
        """The logit of every instance of a text. `cache` keeps the weights of its words but the long ones, which seldom come again."""
        words, starts = instances(text)
        if not words:
            return np.zeros(0)
        new = set(words).difference(cache)
        for w in new:
            cache[w] = self.word(w)
        values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        for w in new:
            if len(w) > LONGEST_HELD:
                del cache[w]
        return logits(self.bias, np.add.reduceat(values, starts), np.log(len(starts)))

    def score(self, text: str | None, cache: dict[bytes, float]) -> tuple[float, int]:
        """The document's probability and the number of instances at one half or more."""
        z = self.instance_scores(text, cache) if text else np.zeros(0)
        return float(-np.expm1(-np.logaddexp(0, z).sum())), int((z >= 0).sum())

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) in characters of the instances that reach `least`, the same ones that the score rests on."""
        z = self.instance_scores(text, {}) if text else np.zeros(0)
        _, starts = instances(text or "")
        chosen = np.flatnonzero(z >= np.log(least / (1 - least)))
        if not len(chosen):
            return []
        spans = [m.span() for m in WORD.finditer(text)]  # with the marks that follow
        ends = np.append(starts[1:], len(spans))
        return [(spans[starts[i]][0], spans[ends[i] - 1][1], float(1 / (1 + np.exp(-z[i])))) for i in chosen]


def train(texts: list[str], labels: np.ndarray, steps: int = 200, support: float = 0.3) -> SentenceModel:
    """Weights by projected Adam on the noisy-or likelihood; both classes weigh the same.

    Weights are never negative: words can offend, but no number of harmless words makes up for one that does. An L1
    penalty worth `support` toxic documents keeps out words that a few toxic documents happen to share.
    """
    parsed = [instances(t) for t in texts]
    seen: Counter[bytes] = Counter()
    for words, _ in parsed:
        seen.update({f for w in set(words) for f in features(w)})
    names = [f for f, n in seen.most_common(VOCABULARY) if n > 1]
    number = {f: i for i, f in enumerate(names)}
    rows: list[int] = []
    columns: list[int] = []
    document: list[int] = []
    known: dict[bytes, list[int]] = {}
    count = 0
    for d, (words, starts) in enumerate(parsed):
        at = np.searchsorted(starts, np.arange(len(words)), side="right") - 1 + count
        for w, row in zip(words, at.tolist()):
            if w not in known:
                known[w] = [number[f] for f in features(w) if f in number]
            columns.extend(known[w])
            rows.extend([row] * len(known[w]))
        document.extend([d] * len(starts))
        count += len(starts)
    row, column, doc = np.array(rows, np.int64), np.array(columns, np.int64), np.array(document, np.int64)
    y = labels.astype(float)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    price = support * 0.5 / max(1, y.sum())
    discount = np.log(np.maximum(np.bincount(doc, minlength=len(y)), 1))[doc]
    w, b = np.zeros(len(names)), -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    chosen = np.ones(len(names), bool)
    for step in range(1, steps + 1):
        if step == steps // 2:  # what the penalty has left is fitted again without it
            chosen, price = w > 0.05 * max(w.max(initial=0), 1e-9), 1e-3 * price
        evidence = np.bincount(row, w[column], count)
        z = logits(b, evidence, discount)
        total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(y)), 1e-12)
        slope = np.where(y > 0, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) * balance
        dz = slope[doc] / (1.0 + np.exp(-z))
        de = dz * (1.0 + discount * np.exp(-evidence))
        g = np.bincount(column, de[row], len(names)) + price
        gb = dz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        speed = 0.15 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = np.where(chosen, np.maximum(0.0, w - speed * m / (np.sqrt(v) + 1e-7)), 0.0)
        b -= speed * mb / (np.sqrt(vb) + 1e-7)
    # Lower the bias until nearly all harmless texts stay below one half.
    evidence = np.bincount(row, w[column], count)
    for _ in range(40):
        total = np.bincount(doc, np.logaddexp(0, logits(b, evidence, discount)), len(y))
        if (total[y == 0] >= np.log(2)).mean() <= FALSE_ALARMS:
            break
        b -= 0.25
    return SentenceModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, held, per_class: int = DOCS_PER_CLASS) -> SentenceModel | None:
    """A model from about `per_class` labelled documents of each class; None without both classes."""
    sample = labelled_sample(docs, labels, "toxic", held, per_class)
    if sample["label"].nunique() < 2:
        return None
    return train(sample["text"].tolist(), sample["label"].to_numpy())


def toxicity_column(model: SentenceModel | None, text):
    """A struct (score, n_offending). Null, empty and wordless texts, or no model: 0."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_kept()
        cache: dict[bytes, float] = {}
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            rows = []
            for start, end in slices(texts):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                rows += [model.score(t, cache) if model else (0.0, 0) for t in texts[start:end]]
            yield pd.DataFrame(rows, columns=["score", "n_offending"])
        cache.clear()
        give_back()

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "score double, n_offending int")(text)


def locate(docs: DataFrame, model: SentenceModel, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability, sentence) of every offending sentence, as character places in the text."""

    def find(frames):
        for frame in frames:
            rows = [
                (key, a, b, p, text[a:b])
                for key, text in zip(frame["doc_id"].tolist(), frame["text"])
                if text
                for a, b, p in model.offending(text, least)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "probability", "sentence"])

    shape = "doc_id long, start int, end int, probability double, sentence string"
    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(find, shape)


def query(spark, folder: str) -> DataFrame:
    bounded_batches(spark)
    docs, held = table(spark, folder, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = train_toxicity(docs, table(spark, folder, "labels"), held)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity_column(model, F.col("text")).alias("found"))
    predicted = F.when(F.col("found.score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", "held_out", "found.score", predicted, "found.n_offending")
