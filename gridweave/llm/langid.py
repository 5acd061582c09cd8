"""Language identification by a byte convolutional network.

Filters of several widths slide over the lower-cased UTF-8 bytes (one-hot, so a filter is one
weight per tap and byte value), each is max-pooled over a fixed-length window, and a softmax
layer scores the languages. Every window of a text is scored; a text's scores are the mean of
its windows' log-probabilities. Weights are trained in numpy on windows of a sample of
labelled texts (``SAMPLE_WINDOWS`` at most, dealt evenly over the languages).

Defined results: ``und`` with score 0 for null texts and texts without a letter (Unicode category L), and for every
text if nothing could be learned; more than ``MOST_LANGS`` languages are an error; null languages are never learned from; null ids pass
through; repeated rows are predicted each; very long texts are read whole; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, tidied

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
SAMPLE_WINDOWS, WINDOWS_PER_TEXT, MOST_LANGS = 16_000, 4, 1_000
EPOCHS, BATCH, RATE = 8, 256, 0.02
_SLICE = 2048  # windows scored at once


def _window_bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def training_windows(docs: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, bound: int = SAMPLE_WINDOWS) -> DataFrame:
    """(label, window) rows, at most ``bound``, spread evenly over the labels."""
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(label_col).count().limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{label_col} has more than {MOST_LANGS} values; a sample of {bound} windows cannot tell them apart")
    rate = F.lit(0.0)
    for r in sizes:
        share = 2.0 * bound / WINDOWS_PER_TEXT / len(sizes) / r["count"]
        rate = F.when(F.col(label_col) == r[label_col], F.lit(min(1.0, share))).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    rows = rows.where(unit < rate).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def cut(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            ids, labels, windows = [], [], []
            for i, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _window_bytes(text)
                n = len(raw)
                steps = min(WINDOWS_PER_TEXT, max(1, n // WINDOW))
                for k in range(steps):
                    at = k * (n // steps)
                    if piece := raw[at : at + WINDOW]:
                        ids.append((i or 0) * WINDOWS_PER_TEXT + k), labels.append(label), windows.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(windows, pa.binary())], names=["id", "label", "piece"])

    return hashed_sample(rows.mapInArrow(cut, "id long, label string, piece binary"), "id", bound)


class ByteCnn:
    def __init__(self, labels: list[str], seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.labels = labels
        self.taps = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, windows: list[bytes], targets: list[int]) -> ByteCnn:
        """Adam on the cross-entropy; the gradient of a max-pooled filter reaches one place only."""
        import numpy as np

        pad = max(WIDTHS) - 1
        x = np.zeros((len(windows), WINDOW + pad), np.uint8)
        for i, w in enumerate(windows):
            x[i, : len(w)] = np.frombuffer(w, np.uint8)
        y = np.asarray(targets)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(self.labels))[y].astype(np.float32)
        params = [*self.taps.values(), self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step = np.random.default_rng(2), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick = order[at : at + BATCH]
                b, n = x[pick], len(pick)
                pooled, where = [], []
                for w, taps in self.taps.items():
                    conv = sum(taps[k][b[:, k : k + WINDOW]] for k in range(w))
                    where.append(conv.argmax(axis=1))
                    pooled.append(np.take_along_axis(conv, where[-1][:, None], axis=1)[:, 0])
                hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y[pick]] -= 1
                p *= (weight[pick] / n)[:, None]
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for j, (w, taps) in enumerate(self.taps.items()):
                    g = back[:, j * FILTERS : (j + 1) * FILTERS]
                    grad = np.zeros_like(taps)
                    for k in range(w):
                        seen = np.take_along_axis(b, where[j] + k, axis=1).astype(np.int64)
                        grad[k] = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    grads.append(grad)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> dict:
        """Two taps of a filter as one table over byte pairs."""
        import numpy as np

        out = {}
        for w, taps in self.taps.items():
            for k in range(0, w - 1, 2):
                out[w, k] = np.ascontiguousarray((taps[k][:, None] + taps[k + 1][None]).reshape(65536, FILTERS))
            if w % 2:
                out[w, w - 1] = taps[w - 1]
        return out

    def log_probs(self, flat, starts, tables: dict):
        """Log-probabilities of the windows of a buffer that begin at ``starts``; a filter reads up to
        ``max(WIDTHS) - 1`` bytes beyond its window, which the buffer must have."""
        import numpy as np

        reach = np.arange(WINDOW + max(WIDTHS) - 1)
        out = []
        for at in range(0, len(starts), _SLICE):
            b = flat[starts[at : at + _SLICE, None] + reach]
            pair = b[:, :-1].astype(np.uint16) * np.uint16(256) + b[:, 1:]
            pooled = []
            for w in WIDTHS:
                conv = None
                for k in range(0, w, 2):
                    part = tables[w, k].take((pair if k + 1 < w else b)[:, k : k + WINDOW], axis=0)
                    conv = part if conv is None else np.add(conv, part, out=conv)
                pooled.append(conv.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteCnn | None:
    rows = training_windows(docs, learn, id_col, text_col, label_col).collect()
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return None
    return ByteCnn(labels).fit([bytes(r["piece"]) for r in rows], [labels.index(r["label"]) for r in rows])


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score``, the predicted language's share of the mean scores."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}").search
        tables = model.tables() if model else {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                use = [i for i, t in enumerate(texts) if model and t and letter(t)]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if use:
                    raws = [_window_bytes(texts[i]) for i in use]
                    # Zeros after each text, as in training, keep filters from reaching the next one.
                    sizes = np.array([-(-len(r) // WINDOW) for r in raws])
                    room = sizes * WINDOW + max(WIDTHS) - 1
                    flat = np.frombuffer(b"".join([r.ljust(n, b"\0") for r, n in zip(raws, room.tolist(), strict=True)]), np.uint8)
                    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
                    starts = np.repeat(begin - first * WINDOW, sizes) + np.arange(sizes.sum()) * WINDOW
                    mean = np.add.reduceat(model.log_probs(flat, starts, tables).astype(np.float64), first) / sizes[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for i, k, s in zip(use, p.argmax(axis=1), p.max(axis=1), strict=True):
                        names[i], scores[i] = model.labels[k], s
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {kind}, lang_pred string, score double")
