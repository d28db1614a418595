"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by a small dense layer over its surface (character classes,
word shapes, repetition); gated attention, learned from document labels alone, weighs the passages; the
document's score is a logistic function of the weighted representation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, held_out, labelled_sample, slices, table
from tenura.llm.hashing import joined, words_of

DOCS_PER_CLASS = 1500
PASSAGE_WORDS = 32
HIDDEN = 12
GATE = 8
THRESHOLD = 0.7

_CODES = np.arange(256)
#: Byte classes counted in every passage.
CLASSES = np.stack(
    [
        (_CODES >= 65) & (_CODES <= 90),
        (_CODES >= 97) & (_CODES <= 122),
        (_CODES >= 48) & (_CODES <= 57),
        np.isin(_CODES, list(b".,;:")),
        np.isin(_CODES, list(b"!?")),
        np.isin(_CODES, list(b"'\"()-")),
        np.isin(_CODES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
        _CODES >= 128,
        _CODES == 10,
    ]
)
N_FEATURES = len(CLASSES) + 7


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text (passages x features) and the text each belongs to.

    A passage is `PASSAGE_WORDS` words, the last of a text maybe fewer. A text without words has one passage of zeros.
    """
    buffer, text_starts = joined(texts)
    starts, ends, hashes = words_of(buffer)
    text = np.searchsorted(text_starts, starts, side="right") - 1
    first = np.searchsorted(starts, text_starts[:-1])
    n_words = np.diff(np.concatenate([first, [len(starts)]]))
    passage_of_word = (np.arange(len(starts)) - first[text]) // PASSAGE_WORDS
    per_text = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(per_text) - per_text
    at = base[text] + passage_of_word
    total = int(per_text.sum())
    owner = np.repeat(np.arange(len(texts)), per_text)
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, owner
    full, inverse = np.unique(at, return_inverse=True)  # passages that hold words, ascending
    head = np.searchsorted(at, full)
    count = np.bincount(inverse).astype(np.float64)
    edge = starts[head]
    size = np.maximum(1, np.add.reduceat(ends - starts, head)).astype(np.float64)
    for k, chosen in enumerate(CLASSES):
        # Up to the next passage's first word: line feeds between words count, the joint behind a text does not matter.
        out[full, k] = np.add.reduceat(chosen[buffer], edge, dtype=np.int32) / size
    length = ends - starts
    k = len(CLASSES)
    last, one = CLASSES[6][buffer[ends - 1]] | CLASSES[4][buffer[ends - 1]], length == 1
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
    order = np.lexsort((hashes, at))
    fresh = np.concatenate([[True], (at[order][1:] != at[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])
    kinds = np.zeros(len(at))
    kinds[order] = fresh
    spread = np.lexsort((hashes, text))
    seen = np.concatenate(
        [[False], (text[spread][1:] == text[spread][:-1]) & (hashes[spread][1:] == hashes[spread][:-1])]
    )
    again = np.zeros(len(at))
    again[spread] = seen
    for i, values in enumerate((last, one, same, kinds, again)):
        out[full, k + i] = np.bincount(inverse, values) / count
    out[full, k + 5] = np.log1p(size / count)
    out[full, k + 6] = np.log1p(count)
    return out, owner


@dataclass
class AttentionModel:
    """Dense encoder, gated attention and logistic head."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        left, gate = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (left * gate) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, e)
        share = np.exp(e - top[owner])
        share /= np.bincount(owner, share, n)[owner]
        z = np.stack([np.bincount(owner, share * h[:, i], n) for i in range(h.shape[1])], 1)
        return x, h, left, gate, share, z, z @ w["c"] + w["d"][0]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document probabilities, and for every passage its text and its attention weight."""
        x, owner = passages(texts)
        *_, share, _, logit = self.forward(x, owner, len(texts))
        return 1 / (1 + np.exp(-logit)), owner, share

    def gradients(self, x, owner, y, weight):
        w = self.weights
        x, h, left, gate, share, z, logit = self.forward(x, owner, len(y))
        p = 1 / (1 + np.exp(-logit))
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum())
        dl = weight * (p - y)
        dz = dl[:, None] * w["c"]
        dh = share[:, None] * dz[owner]
        ds = (h * dz[owner]).sum(1)
        de = share * (ds - np.bincount(owner, share * ds, len(y))[owner])
        d_both = de[:, None] * w["a"]
        d_left, d_gate = d_both * gate * (1 - left * left), d_both * left * gate * (1 - gate)
        dh = dh + d_left @ w["V"].T + d_gate @ w["U"].T
        d_in = dh * (1 - h * h)
        return loss, {
            "W": x.T @ d_in, "b": d_in.sum(0), "V": h.T @ d_left, "U": h.T @ d_gate,
            "a": (left * gate).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()]),
        }


def train(texts: list[str], labels: np.ndarray, steps: int = 400, seed: int = 0, decay: float = 1e-4) -> AttentionModel:
    """Full-batch Adam on the balanced log-loss of the documents."""
    parts = [passages(texts[a:b]) + (a,) for a, b in slices(texts)]
    x = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + p[2] for p in parts])
    rng = np.random.default_rng(seed)
    weights = {
        "W": rng.standard_normal((N_FEATURES, HIDDEN)) / np.sqrt(N_FEATURES), "b": np.zeros(HIDDEN),
        "V": rng.standard_normal((HIDDEN, GATE)) / 3, "U": rng.standard_normal((HIDDEN, GATE)) / 3,
        "a": rng.standard_normal(GATE) / 3, "c": rng.standard_normal(HIDDEN) / 3, "d": np.zeros(1),
    }
    model = AttentionModel(weights, x.mean(0), x.std(0) + 1e-3)
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1):
        _, grads = model.gradients(x, owner, y, weight)
        for k, g in grads.items():
            g = g + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] -= 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, held, per_class: int = DOCS_PER_CLASS) -> AttentionModel | None:
    """A model from about `per_class` labelled documents of each class; None without both classes."""
    sample = labelled_sample(docs, labels, "quality", held, per_class)
    if sample["label"].nunique() < 2:
        return None
    return train(sample["text"].tolist(), sample["label"].to_numpy())


def quality_column(model: AttentionModel | None, text):
    """A struct (score, n_passages, best_passage): the passage that weighs most, from 0.

    Null and empty texts are one empty passage and are scored as such. Without a model every score is 1: nothing is
    known against a document.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            frames = []
            for a, b in slices(texts):
                if model is None:
                    frames.append(pd.DataFrame({"score": np.ones(b - a), "n_passages": 0, "best_passage": 0}))
                    continue
                p, owner, share = model.score(texts[a:b])
                first = np.searchsorted(owner, np.arange(b - a))
                best = np.lexsort((np.arange(len(owner)), -share, owner))[first] - first
                n = np.bincount(owner, minlength=b - a)
                frames.append(pd.DataFrame({"score": p, "n_passages": n, "best_passage": best}))
            yield pd.concat(frames) if frames else pd.DataFrame({"score": [], "n_passages": [], "best_passage": []})

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "score double, n_passages int, best_passage int")(text)


def query(spark, folder: str) -> DataFrame:
    bounded_batches(spark)
    docs, held = table(spark, folder, "documents"), held_out(F.col("doc_id"), 4, 2)
    model = train_quality(docs, table(spark, folder, "labels"), held)
    scored = docs.select("doc_id", held.alias("held_out"), quality_column(model, F.col("text")).alias("found"))
    predicted = F.when(F.col("found.score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", "held_out", "found.score", predicted, "found.n_passages", "found.best_passage")
