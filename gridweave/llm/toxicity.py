"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a fixed low bias plus the weights of
its words and of their first ``STEM`` letters, so that compounds and inflections count; the document's probability is the noisy-or of its sentences and of a learned leak,
which takes up labels that no sentence explains. What the low bias alone would give is taken off
each sentence, so that one without learned words adds exactly nothing and a text is not toxic by
its length. Only document labels are learned from, by
Adam with an L1 proximal step in numpy, on a sample of labelled rows by hash alone (at most
``SAMPLE_DOCS``, of any length). Every whole text is scored, and the sentences
with a probability of one half or more are located.

Defined results: null and empty texts score the leak; null ids pass through and are never
learned from; null labels are ignored and of several labels of an id the highest counts;
repeated rows are scored each; extra columns are ignored by ``score`` and kept by ``reject``;
with nothing to learn from every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

SAMPLE_DOCS = 8_000
LEAST_DOCS, LEAST_TOXIC, MOST_WORDS, LEAST_Z = 5, 2, 1_000, 4.0
STEM, STEM_GAIN, DROPOUT = 4, 1.5, 0.5
BIAS, L1, STEPS, RATE = -10.0, 5e-6, 500, 0.12
_WORD, _SENTENCE = r"\w+", r"[^.!?\n]+"


def marks(words: list[str]) -> set[str]:
    """The distinct words and their stems, which end in a star."""
    found = set(words)
    return found | {w[:STEM] + "*" for w in found if len(w) >= STEM}


class NoisyOr:
    def __init__(self, weights: dict[str, float], leak: float):
        self.weights, self.leak = weights, leak
        self.words = {w for w in weights if not w.endswith("*")}
        self.stems = {w[:-1] for w in weights if w.endswith("*")}

    @classmethod
    def fit(cls, texts: list[str], labels: list[int]) -> NoisyOr:
        import re
        from collections import Counter

        import numpy as np

        word, sentence = re.compile(_WORD).findall, re.compile(_SENTENCE).findall
        y = np.asarray(labels, float)
        if not len(y) or y.min() == y.max():
            return cls({}, float(y.mean()) if len(y) else 0.0)
        # Words of toxic documents first; the rest of the vocabulary is never held.
        toxic: Counter = Counter()
        for t, label in zip(texts, labels, strict=True):
            if label:
                toxic.update(marks(word(t.lower())))
        seen = {w: n for w, n in toxic.items() if n >= LEAST_TOXIC}
        toxic = dict(seen)
        for t, label in zip(texts, labels, strict=True):
            if not label:
                for w in marks(word(t.lower())):
                    if w in seen:
                        seen[w] += 1
        # A stem counts if it is clearly more frequent than each of its words.
        most: dict[str, int] = {}
        for w, n in seen.items():
            if not w.endswith("*"):
                most[w[:STEM] + "*"] = max(n, most.get(w[:STEM] + "*", 0))
        rate = y.mean()
        scored = []
        for w, n in seen.items():
            if w.endswith("*") and n < STEM_GAIN * most.get(w, 0):
                continue
            if n >= LEAST_DOCS and (z := (toxic[w] - n * rate) / (n * rate * (1 - rate)) ** 0.5) >= LEAST_Z:
                scored.append((-z, w))
        vocab = {w: i for i, (_, w) in enumerate(sorted(scored)[:MOST_WORDS])}
        doc_of, row, col, first = [], [], [], []
        for d, text in enumerate(texts):
            first.append(len(doc_of))
            for s in sentence(text) or [""]:
                hits = sorted({vocab[w] for w in marks(word(s.lower())) if w in vocab})
                row += [len(doc_of)] * len(hits)
                col += hits
                doc_of.append(d)
        row, col, doc_of, first = map(np.asarray, (row, col, doc_of, first))
        row, col = row.astype(int), col.astype(int)
        w, rng = np.zeros(len(vocab)), np.random.default_rng(6)
        leak, quiet = -3.0, np.log1p(-1 / (1 + np.exp(-BIAS)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, STEPS + 1):
            # Words are left out at random, so that each learns to speak for itself.
            used = (rng.random(len(col)) >= DROPOUT).astype(float)
            logit = BIAS + np.bincount(row, w[col] * used, len(doc_of))
            p = 1 / (1 + np.exp(-logit))
            lam = 1 / (1 + np.exp(-leak))
            clean = np.add.reduceat(np.minimum(np.log1p(-np.minimum(p, 1 - 1e-9)) - quiet, 0), first) + np.log1p(-lam)
            total = np.maximum(-np.expm1(clean), 1e-9)
            # d loss / d logit of a sentence is p for a clean document, p - p / total for a toxic one;
            # under the bias it is 0.
            pull = 1 - y / total
            g = np.append(np.bincount(col, (p * (logit >= BIAS) * pull[doc_of])[row] * used, len(w)), (lam * pull).sum()) / len(y)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            delta = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            w -= delta[:-1]
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1 / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-6), 0)
            leak -= delta[-1]
        return cls({x: float(w[i]) for x, i in vocab.items() if w[i] != 0}, float(1 / (1 + np.exp(-leak))))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of the offending sentences."""
        import math
        import re

        if not self.weights:
            return self.leak, []
        text = text or ""
        get, word = self.weights.get, re.compile(_WORD).findall
        found = set(word(text.lower()))
        hit = not self.words.isdisjoint(found) or (bool(self.stems) and not self.stems.isdisjoint({w[:STEM] for w in found}))
        log_clean, spans = math.log1p(-self.leak), []
        quiet = math.log1p(-1 / (1 + math.exp(-BIAS)))
        if not hit:
            return self.leak, []
        for s in re.compile(_SENTENCE).finditer(text):
            logit = BIAS + sum(get(w, 0.0) for w in marks(word(s[0].lower())))
            p = 1 / (1 + math.exp(-max(-60.0, min(logit, 30.0))))
            log_clean += min(0.0, math.log1p(-min(p, 1 - 1e-12)) - quiet)
            if p >= 0.5:
                spans.append((s.start(), s.end(), p))
        return min(1.0, max(0.0, 1 - math.exp(log_clean))), spans


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NoisyOr:
    """``learn`` is a condition on the id of the label rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
    picked = (
        known.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).groupBy("label_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_DOCS)
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    # The sample has SAMPLE_DOCS rows of two numbers at most.
    rows = texts.join(F.broadcast(picked), "label_id").orderBy(F.xxhash64("label_id"), "label_id", "text").limit(SAMPLE_DOCS).collect()
    return NoisyOr.fit([r["text"] for r in rows], [int(r["label"] > 0) for r in rows])


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score``, and ``sentences``, the offending ones with their places in characters."""

    def run(batches: Iterator):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                made = [model.score(t) for t in batch.column(1).to_pylist()]
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in made]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in made], pa.float64()), pa.array(spans, kind)], names=[id_col, "score", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {kind}, score double, sentences array<struct<start:long,end:long,score:double>>")


def reject(docs: DataFrame, model: NoisyOr, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.score(t)[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
