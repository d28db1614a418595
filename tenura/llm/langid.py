"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards, labels every byte with a language, and is trained in
numpy by backpropagation through time. Its state starts afresh at every word, so equal words get equal labels, and a
task evaluates each distinct word once. A document's language is pooled from the label probabilities of
all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import LONGEST_LEARNED, bounded_batches, class_sample, drop_kept, give_back, has_letter, held_out, letter_words, slices, table

HIDDEN = 16
#: Longer words are scored in pieces of so many bytes, longer ones learned from in pieces of so many; all of them.
PIECE = 512
LEARNED_PIECE = 48
#: Bytes of padded words that are evaluated at a time.
CELLS = 1 << 16
DOCS_PER_LANGUAGE = 300
TRAINING_WORDS = 160_000
EPOCHS = 3
BATCH = 512
CACHE_WORDS = 300_000
UNKNOWN = "und"
#: The name of the output for text of no learned language; never predicted, but it lowers the score of what is like it.
BACKGROUND = "\0"
#: Code points of scripts: further Latin, Greek, Cyrillic, Hebrew and Arabic, Indic, Thai, kana, Han, Hangul.
SCRIPTS = [(0xC0, 0x250), (0x370, 0x400), (0x400, 0x530), (0x5D0, 0x6D4), (0x900, 0xDF0), (0xE00, 0xE50), (0x3041, 0x30FF), (0x4E00, 0x9FA0), (0xAC00, 0xD7A0)]
#: Documents of fewer words say little about what scores are usual.
LEAST_WORDS = 10
#: Bytes that count as a word where a script has no spaces.
WORD_BYTES = 12


def pieces(word: bytes, longest: int) -> list[bytes]:
    """A word in pieces of at most `longest` bytes that end between characters."""
    out, at = [], 0
    while len(word) - at > longest:
        end = at + longest
        while word[end] & 0xC0 == 0x80 and end > at + 1:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as padded rows, forwards and backwards, with their lengths. Padding is 0."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    width = int(n.max(initial=1))
    forward = np.zeros((len(words), width), np.int64)
    mask = np.arange(width) < n[:, None]
    forward[mask] = np.frombuffer(b"".join(words), np.uint8)
    back = np.where(mask, n[:, None] - 1 - np.arange(width), np.arange(width))
    return forward, np.take_along_axis(forward, back, 1), n


@dataclass
class ByteNetwork:
    """Two gated recurrent layers, one per direction, and a softmax over the languages at every byte."""

    languages: list[str]
    hidden: int = HIDDEN
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    least: float = 0.0  # below this score a text is like no document that was learned from

    @property
    def learned(self) -> int:
        """How many outputs are languages; the background, if there is one, comes last."""
        return len(self.languages) - (self.languages[-1:] == [BACKGROUND])

    def __post_init__(self):
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)
        h, k = self.hidden, len(self.languages)
        for d in "fb":
            self.weights[f"x{d}"] = (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            self.weights[f"u{d}"] = (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.weights["o"] = (rng.standard_normal((2 * h, k)) * 0.3).astype(np.float32)
        self.weights["c"] = np.zeros(k, np.float32)

    def _run(self, codes: np.ndarray, d: str, keep_steps: bool = False):
        h, (n, width) = self.hidden, codes.shape
        x_in, u = self.weights[f"x{d}"], self.weights[f"u{d}"]
        u_gates, u_new = u[:, : 2 * h], u[:, 2 * h :]
        state = np.zeros((n, h), np.float32)
        states, steps = np.empty((width, n, h), np.float32), []
        for t in range(width):
            x = x_in[codes[:, t]]
            gates = _sigmoid(x[:, : 2 * h] + state @ u_gates)
            z, r = gates[:, :h], gates[:, h:]
            pushed = state @ u_new
            new = np.tanh(x[:, 2 * h :] + r * pushed)
            if keep_steps:
                steps.append((state, z, r, pushed, new))
            state = new + z * (state - new)
            states[t] = state
        return states, steps

    def _log_probabilities(self, forward: np.ndarray, backward: np.ndarray, back: np.ndarray) -> np.ndarray:
        both = np.concatenate([forward, np.take_along_axis(backward, back, 0)], 2)
        logits = both @ self.weights["o"] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    @staticmethod
    def _mirror(n: np.ndarray, width: int) -> np.ndarray:
        t = np.arange(width)[:, None]
        return np.where(t < n, n - 1 - t, t)[:, :, None]

    def label_bytes(self, words: list[bytes]) -> list[np.ndarray]:
        """Log-probabilities of the languages at every byte of every word (bytes x languages)."""
        forward, backward, n = coded(words)
        logs = self._log_probabilities(self._run(forward, "f")[0], self._run(backward, "b")[0], self._mirror(n, forward.shape[1]))
        return [logs[: n[i], i] for i in range(len(words))]

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Mean log-probability over each word's bytes (words x languages)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        parts = [(i, p) for i, w in enumerate(words) for p in pieces(w, PIECE)]
        parts.sort(key=lambda p: len(p[1]))
        at = 0
        while at < len(parts):
            end = at + 1
            while end < len(parts) and (end + 1 - at) * len(parts[end][1]) <= CELLS:
                end += 1
            places, part = zip(*parts[at:end])
            at = end
            forward, backward, n = coded(list(part))
            logs = self._log_probabilities(
                self._run(forward, "f")[0], self._run(backward, "b")[0], self._mirror(n, forward.shape[1])
            )
            logs *= (np.arange(forward.shape[1])[:, None] < n)[:, :, None]
            np.add.at(out, np.array(places), logs.sum(0))
        return out / np.maximum(1, np.fromiter(map(len, words), np.float32, len(words)))[:, None]

    def gradients(self, words: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradient by backpropagation through time."""
        forward, backward, n = coded(words)
        width, h = forward.shape[1], self.hidden
        back = self._mirror(n, width)
        states, steps = {}, {}
        for d, codes in (("f", forward), ("b", backward)):
            states[d], steps[d] = self._run(codes, d, keep_steps=True)
        logs = self._log_probabilities(states["f"], states["b"], back)
        mask = np.arange(width)[:, None] < n
        rows = np.arange(len(words))
        total = float(n.sum())
        loss = -float((logs[:, rows, labels] * mask).sum()) / total
        delta = np.exp(logs)
        delta[:, rows, labels] -= 1
        delta *= mask[:, :, None] / total
        both = np.concatenate([states["f"], np.take_along_axis(states["b"], back, 0)], 2)
        out = {"o": np.einsum("tnh,tnk->hk", both, delta), "c": delta.sum((0, 1))}
        into = delta @ self.weights["o"].T
        into = {"f": into[:, :, :h], "b": np.take_along_axis(into[:, :, h:], back, 0)}
        for d, codes in (("f", forward), ("b", backward)):
            u = self.weights[f"u{d}"]
            du, dx = np.zeros_like(u), np.zeros_like(self.weights[f"x{d}"])
            carry = np.zeros((len(words), h), np.float32)
            for t in range(width - 1, -1, -1):
                state, z, r, pushed, new = steps[d][t]
                carry = carry + into[d][t]
                d_new = carry * (1 - z) * (1 - new * new)
                d_z = carry * (state - new) * z * (1 - z)
                d_r = d_new * pushed * r * (1 - r)
                gates = np.concatenate([d_z, d_r], 1)
                du[:, : 2 * h] += state.T @ gates
                du[:, 2 * h :] += state.T @ (d_new * r)
                np.add.at(dx, codes[:, t], np.concatenate([gates, d_new], 1))
                carry = carry * z + gates @ u[:, : 2 * h].T + (d_new * r) @ u[:, 2 * h :].T
            out[f"u{d}"], out[f"x{d}"] = du, dx
        return loss, out

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> list[float]:
        """Adam over shuffled batches of words of similar length; returns the mean loss of every epoch."""
        rng = np.random.default_rng(self.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        losses, step = [], 0
        for epoch in range(epochs):
            order = np.argsort(lengths + rng.random(len(words)) * 2, kind="stable")
            batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            seen = []
            for place in rng.permutation(len(batches)):
                chosen = batches[place]
                loss, grads = self.gradients([words[i] for i in chosen], labels[chosen])
                step += 1
                speed = rate * (1 - (step - 1) / (epochs * len(batches))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (speed * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses


def background(words: list[bytes], n: int, rng: np.random.Generator) -> list[bytes]:
    """About `n` words of no language: letters of learned words in another order, random Latin letters, letters of other scripts."""
    letters = list("".join(w.decode(errors="ignore") for w in words[:: max(1, len(words) // 20_000)]))
    known = set(letters)
    scripts = [[c for c in map(chr, range(a, b)) if c.isalpha() and c not in known] for a, b in SCRIPTS]
    scripts = [x for x in scripts if x]
    sizes = rng.integers(2, 13, n)
    out = []
    for i, size in enumerate(sizes.tolist()):
        if i % 4 < 2 and letters:
            own = [letters[k] for k in rng.integers(0, len(letters), size)]
        elif i % 4 == 2 or not scripts:
            own = [chr(97 + k) for k in rng.integers(0, 26, size)]
        else:
            script = scripts[int(rng.integers(len(scripts)))]
            own = [script[k] for k in rng.integers(0, len(script), size)]
        out.append("".join(own).encode())
    return out


def train_network(
    docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words: int = TRAINING_WORDS, seed: int = 0
) -> ByteNetwork | None:
    """A network for the languages of `docs` (doc_id, text, lang); None if no row has a text and a language.

    Fitted on about `docs_per_language` documents of each language, of `common.LONGEST_LEARNED` characters at most, and on `words`
    pieces of their words, drawn evenly over the languages; a long word gives several pieces. A column that holds more values than
    `common.CLASSES` teaches its commonest. These bounds keep the driver's share the same at any size. `network.least` is
    the lowest score that a document of the sample gets in its own language, less a tenth: below it a text is like none.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") <= LONGEST_LEARNED)).select("doc_id", "text", "lang")
    sample = class_sample(usable, "lang", "doc_id", docs_per_language).orderBy("doc_id", "lang", "text").toLocalIterator()
    found: dict[str, list[bytes]] = {}
    rng = np.random.default_rng(seed)
    shown: list[tuple[str, str]] = []
    for row in sample:
        own = [p for w in letter_words(row.text) for p in pieces(w, LEARNED_PIECE)]
        # No document gives more pieces than all of a language will be asked for.
        found.setdefault(row.lang, []).extend([own[i] for i in np.sort(rng.permutation(len(own))[:words])])
        if len(own) >= LEAST_WORDS:
            shown.append((row.lang, row.text))
    found = {k: v for k, v in found.items() if v}
    if not found:
        return None
    languages = [*sorted(found), BACKGROUND]
    texts, labels = [], []
    for i, name in enumerate(languages[:-1]):
        own = found[name]
        for at in rng.permutation(len(own))[: max(1, words // len(languages))]:
            texts.append(own[at])
            labels.append(i)
    strange = background(texts, max(1, words // len(languages)), rng)
    texts += strange
    labels += [len(languages) - 1] * len(strange)
    network = ByteNetwork(languages, seed=seed)
    network.train(texts, np.array(labels))
    names, scores, _ = Pool(network).documents([text for _, text in shown])
    right = [score for (lang, _), name, score in zip(shown, names, scores) if lang == name]
    network.least = 0.9 * min(right, default=0.0)
    return network


class Pool:
    """A task's view of the network: each distinct word is evaluated once while the bounded cache holds it.

    A document gets the language with the largest sum of its words' log-probabilities. Its score is the mean, over the words, of
    that language's share in a word: it does not grow with the text, and is low for text that is like no learned language.
    """

    def __init__(self, network: ByteNetwork):
        self.network = network
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(network.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, score and number of words of every text; a long word counts as one for each `WORD_BYTES` bytes."""
        names, probabilities, counts = [], [], []
        for start, end in slices(texts):
            lists = [letter_words(t) if t else [] for t in texts[start:end]]
            new = set().union(*lists).difference(self.place)
            if len(self.place) + len(new) > CACHE_WORDS:
                self.place, self.scores, self.sizes = {}, self.scores[:0], self.sizes[:0]
                new = set().union(*lists)
            if new:
                new = list(new)
                self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
                self.scores = np.concatenate([self.scores, self.network.word_scores(new)])
                self.sizes = np.concatenate([self.sizes, [-(-len(w) // WORD_BYTES) for w in new]])
            for text, words in zip(texts[start:end], lists):
                if not words or not has_letter(text):
                    # Letters outside the words cannot occur; without any letter the language is undetermined.
                    names.append(UNKNOWN)
                    probabilities.append(0.0)
                    counts.append(0)
                    continue
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                counts.append(int(self.sizes[at].sum()))
                own = self.scores[at].astype(np.float64)
                best = int(own.sum(0)[: self.network.learned].argmax())
                share = np.exp(own - own.max(1, keepdims=True))
                names.append(self.network.languages[best])
                probabilities.append(float((share[:, best] / share.sum(1)).mean()))
        return names, probabilities, counts


def language_column(network: ByteNetwork | None, text):
    """A struct (lang_pred, score, words) for a text column. Null texts and texts without a letter: `und` with score 0.

    Without a network (no labelled row to learn from) every text is `und`. Very long texts and words are scored whole, equal texts
    get equal scores, ties go to the language that comes first; other columns are not looked at.
    """

    def predict(batches):
        drop_kept()
        pool = Pool(network) if network else None
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            none = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            names, scores, counts = pool.documents(texts) if pool else none
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.array(scores, float), "words": np.array(counts, np.int64)})
        del pool
        give_back()

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double, words long")(text)


def language_spans(network: ByteNetwork, text: str) -> list[tuple[int, int, str]]:
    """Byte ranges of the lower-cased text's words with the language of each byte run, joined where it stays the same."""
    out: list[tuple[int, int, str]] = []
    data = text.lower().encode().translate(bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)))
    at = 0
    for word in data.split():
        at = data.index(word, at)
        a = at
        for part in pieces(word, PIECE):
            labels = network.label_bytes([part])[0][:, : network.learned].argmax(1)
            for i, label in enumerate(labels.tolist()):
                place, name = a + i, network.languages[label]
                if out and out[-1][1] == place and out[-1][2] == name:
                    out[-1] = (out[-1][0], place + 1, name)
                else:
                    out.append((place, place + 1, name))
            a += len(part)
        at += len(word)
    return out


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; repeated rows stay."""
    return docs.select("doc_id", language_column(network, F.col("text")).alias("_found")).select(
        "doc_id", "_found.lang_pred", "_found.score"
    )


def query(spark, folder: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, folder, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    network = train_network(docs.where(~held))
    return identify(docs, network).select("doc_id", held.alias("held_out"), "lang_pred", "score")
