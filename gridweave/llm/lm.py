"""Language-model scoring with a log-bilinear neural model.

Words fall into classes: each of the ``TOP`` most frequent training words is a class of its
own, all others are dealt to ``TAILS`` classes by their last two bytes, and a text's end is a
class. The model predicts the next class from the two before it: the context's vectors are
mixed by one matrix per position and multiplied with the classes' output vectors. It is fitted by
noise-contrastive estimation: each token is told from ``NOISE`` tokens drawn by the classes'
frequencies. That loss depends on the training texts only through how often each class follows
each two, and with so few classes the expectation over the noise is a sum: so the counts are
taken over all tokens of all training documents, whatever their lengths, and merged into shards
of contexts, and each step of Adam sums the exact gradient over all shards. Scores come from
batched matrix products that are normalised over all classes that can occur. Within a tail class
the known words have their shares of the class's training tokens, less the Good-Turing share of
words not seen yet. What the tail classes leave for such words, added up, is the probability of
the one unknown token, which every word outside the training texts counts as. So the model is
normalised over the V known tokens and one unknown.

There are at most (CLASSES + 1)^2 contexts, so a step costs the same beyond some corpus size.
Token counts are exact and over all training documents, too (see ``blocks``).

Defined results: null and empty texts have one token, their end; a null id counts as crc 0;
repeated rows count and are scored each; very long texts are scored whole; extra columns are
ignored; an empty table gives an empty table; without training texts the base score is that of
N = V = 0 and the model is uniform over its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, tidied

TOP, TAILS, DIM = 448, 63, 24
STEPS, RATE, CHUNK, NOISE = 40, 0.1, 1024, 64.0
HELD_CELLS, SHARD_BYTES, MOST_SHARDS = 4 << 20, 32 << 20, 128
END = TOP + TAILS
CLASSES = END + 1
START = CLASSES


def _bucket(word: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(word) % buckets


def tail_class(word: bytes) -> int:
    import zlib

    return TOP + zlib.crc32(word[-2:]) % TAILS


def tokens_of(data: bytes) -> list[bytes]:
    """bytes.lower changes A-Z only and bytes.split cuts at \\x20 and \\x09-\\x0D."""
    return data.lower().split()


def count_tokens(packed: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the training counts of the block's distinct words there, in
    their sorted order (kind 0); for each bucket its class totals (1) and frequent words (2)."""

    def send(batches: Iterator):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for row in B.rows_of(batch):
                blk = B.Block(row)
                train, other, ends = Counter(), set(), int((blk.flags == 1).sum())
                for flag, text in zip(blk.flags, blk.texts(), strict=True):
                    train.update(tokens_of(text)) if flag == 1 else other.update(tokens_of(text))
                parts: dict[int, list[bytes]] = {0: []}
                for w in {*train, *other}:
                    parts.setdefault(_bucket(w, buckets), []).append(w)
                out = {"bucket": [], "block": [], "words": [], "counts": [], "ends": []}
                pack = zstandard.ZstdCompressor(level=1).compress
                for b, words in parts.items():
                    words.sort()
                    out["bucket"].append(b), out["block"].append(blk.block), out["ends"].append(ends if b == 0 else 0)
                    out["words"].append(pack(b"\n".join(words)))
                    out["counts"].append(B.squeeze(np.array([train[w] for w in words], np.int64)))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("ends", pa.int64())]))

    def total(batches: Iterator):
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held, counts, ends, bucket = [], defaultdict(int), 0, None
        for batch in batches:
            for row in B.rows_of(batch):
                bucket = row["bucket"]
                ends += row["ends"]
                words = unpack(row["words"])
                for w, c in zip(words.split(b"\n") if words else (), B.spread(row["counts"]).tolist(), strict=True):
                    counts[w] += c
                held.append((row["block"], row["words"]))
        if bucket is None:
            return
        fields = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("word", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        for block, packed_words in held:
            words = unpack(packed_words)
            back = B.squeeze(np.array([counts[w] for w in words.split(b"\n")] if words else [], np.int64))
            yield pa.RecordBatch.from_pydict({"kind": [0], "bucket": [bucket], "block": [block], "word": [b""], "counts": [back], "n": [0], "sums": [None]}, fields)
        known = [(w, c) for w, c in counts.items() if c]
        # Tokens, words and once-seen words of each tail class; then of the end.
        sums = np.zeros((3, CLASSES), np.int64)
        for w, c in known:
            sums[:, tail_class(w)] += (c, 1, c == 1)
        sums[:, END] = (ends, int(ends > 0), 0)
        yield pa.RecordBatch.from_pydict({"kind": [1], "bucket": [bucket], "block": [0], "word": [b""], "counts": [b""], "n": [0], "sums": [sums.ravel().tolist()]}, fields)
        best = sorted(known, key=lambda x: (-x[1], x[0]))[:TOP]
        n = len(best)
        yield pa.RecordBatch.from_pydict({"kind": [2] * n, "bucket": [bucket] * n, "block": [0] * n, "word": [w for w, _ in best], "counts": [b""] * n, "n": [c for _, c in best], "sums": [None] * n}, fields)

    sent = packed.mapInArrow(tidied(send), "bucket int, block long, words binary, counts binary, ends long")
    return cut(B.by_bucket(sent, buckets, total, "kind int, bucket int, block long, word binary, counts binary, n long, sums array<long>"))


def add_up(keys: list, counts: list):
    """Ascending distinct keys and the sums of their counts."""
    import numpy as np

    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.diff(k, prepend=-1))
    return k[at], np.add.reduceat(n, at) if len(at) else n


def count_cells(packed: DataFrame, number: dict[bytes, int], shards: int) -> DataFrame:
    """For each shard of contexts the training counts of (two classes before, class): a cell's
    key is ``(first * (CLASSES + 1) + second) * CLASSES + class``. ``number`` has the top words."""

    class Known(dict):
        def __missing__(self, word):
            self[word] = found = tail_class(word)
            return found

    def send(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        keys, counts, held = [], [], 0

        def flush():
            nonlocal held
            k, n = add_up(keys, counts)
            keys.clear(), counts.clear()
            held = 0
            # Contexts are dealt by a multiplicative hash, so that shards are alike.
            shard = ((k // CLASSES * 2654435761 % (1 << 32)) * shards) >> 32
            for b in np.unique(shard).tolist():
                own = shard == b
                yield pa.RecordBatch.from_pydict({"bucket": [b], "cells": [B.squeeze_sorted(k[own].astype(np.uint64))], "counts": [B.squeeze(n[own])]}, fields)

        fields = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in B.rows_of(batch):
                blk, known = B.Block(row), Known(number)
                classes, starts = [], []
                for flag, text in zip(blk.flags, blk.texts(), strict=True):
                    if flag == 1:
                        starts.append(len(classes))
                        classes.extend(map(known.__getitem__, tokens_of(text)))
                        classes.append(END)
                if not classes:
                    continue
                seq = np.array(classes, np.int64)
                first, second = contexts_of(seq, np.array(starts, np.int64))
                k, n = np.unique(((first * (CLASSES + 1) + second) * CLASSES + seq).astype(np.int32), return_counts=True)
                keys.append(k.astype(np.int64)), counts.append(n.astype(np.int64))
                held += len(k)
                if held > HELD_CELLS:
                    k, n = add_up(keys, counts)
                    keys[:], counts[:], held = [k], [n], len(k)
                    if held > HELD_CELLS // 2:
                        yield from flush()
        if keys:
            yield from flush()

    def total(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        keys, counts, held, bucket = [], [], 0, None
        for batch in batches:
            for row in B.rows_of(batch):
                bucket = row["bucket"]
                keys.append(B.spread_sorted(row["cells"]).astype(np.int64)), counts.append(B.spread(row["counts"]))
                held += len(keys[-1])
                if len(keys) > 1 and held > HELD_CELLS and held > 2 * len(keys[0]):
                    k, n = add_up(keys, counts)
                    keys, counts, held = [k], [n], len(k)
        if bucket is not None:
            k, n = add_up(keys, counts)
            yield pa.RecordBatch.from_pydict({"cells": [B.squeeze_sorted(k.astype(np.uint64))], "counts": [B.squeeze(n)]}, pa.schema([("cells", pa.binary()), ("counts", pa.binary())]))

    sent = packed.mapInArrow(tidied(send), "bucket int, cells binary, counts binary")
    return cut(B.by_bucket(sent, shards, total, "cells binary, counts binary"))


def slopes(left, right, q, b, log_noise, cells, counts):
    """Sums over ``cells`` of the gradients of the noise-contrastive loss with respect to ``left`` and
    ``right`` (each class's vector times its position's matrix), ``q`` and ``b``.

    ``log_noise`` is the log of ``NOISE`` times each class's noise probability. A token of class t in
    a context costs ``-log s(d_t) - sum_w noise_w log(1 - s(d_w))`` with ``d = score - log_noise`` and
    the logistic function s: with few classes the expectation over the noise is a sum.
    """
    import numpy as np

    context, place = np.unique(cells // CLASSES, return_inverse=True)
    edge = np.searchsorted(place, np.arange(len(context) + 1))
    first, second = context // (CLASSES + 1), context % (CLASSES + 1)
    n = np.add.reduceat(counts, edge[:-1]).astype(np.float32)
    counts, target = counts.astype(np.float32), cells % CLASSES
    qt, g_q, g_b, g_h = np.ascontiguousarray(q.T), np.zeros(q.shape), np.zeros(b.shape), np.empty((len(context), DIM), np.float32)
    shift, noise = (b - log_noise).astype(np.float32), np.exp(log_noise).astype(np.float32)
    for at in range(0, len(context), CHUNK):
        x = slice(at, min(at + CHUNK, len(context)))
        y = slice(edge[x.start], edge[x.stop])
        h = left[first[x]] + right[second[x]]
        p = h @ qt + shift
        np.clip(p, -30, 30, out=p)
        np.negative(p, out=p)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        where = (place[y] - at) * CLASSES + target[y]
        pull = counts[y] * (1 - p.ravel()[where])
        p *= noise
        p *= n[x][:, None]
        p.ravel()[where] -= pull
        g_q += p.T @ h
        g_b += p.sum(axis=0)
        g_h[x] = p @ q

    def by_class(which):
        order = np.argsort(which, kind="stable")
        at = np.flatnonzero(np.diff(which[order], prepend=-1))
        out = np.zeros(left.shape)
        out[which[order][at]] = np.add.reduceat(g_h[order], at)
        return out

    return by_class(first), by_class(second), g_q, g_b


class LogBilinear:
    """Class scores ``q_w . (C1 r_1 + C2 r_2) + b_w``."""

    def __init__(self, unigram, live=None, seed: int = 3):
        """``live`` has the classes that can occur."""
        import numpy as np

        rng = np.random.default_rng(seed)
        weight = np.where(True if live is None else live, unigram + 0.5, 1e-30)
        self.unigram = weight / weight.sum()
        self.r = rng.normal(0, 0.1, (CLASSES + 1, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32)
        self.c = np.stack([np.eye(DIM, dtype=np.float32)] * 2)
        self.b = np.log(self.unigram).astype(np.float32)

    def fit(self, counted: DataFrame, tokens: int) -> LogBilinear:
        """Adam on the mean noise-contrastive loss of all ``tokens``, the noise being the classes'
        frequencies; each step is one pass over the shards of ``count_cells``, which send four small
        arrays each."""
        import numpy as np

        params = [self.r, self.q, self.c, self.b]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        log_noise = np.log(NOISE * self.unigram)
        shapes = [self.r.shape, self.r.shape, self.q.shape, self.b.shape]
        for step in range(1, STEPS + 1 if tokens else 1):
            left, right, q, b = self.r @ self.c[0], self.r @ self.c[1], self.q, self.b

            def run(batches: Iterator, left=left, right=right, q=q, b=b):
                import pyarrow as pa

                for batch in batches:
                    for row in B.rows_of(batch):
                        found = slopes(left, right, q, b, log_noise, B.spread_sorted(row["cells"]).astype(np.int64), B.spread(row["counts"]))
                        yield pa.RecordBatch.from_pydict({"g": [np.concatenate([x.ravel() for x in found]).astype(np.float32).tobytes()]}, pa.schema([("g", pa.binary())]))

            total = np.zeros(sum(int(np.prod(x)) for x in shapes))
            for r in counted.mapInArrow(run, "g binary").collect():
                total += np.frombuffer(r["g"], np.float32)
            parts = np.split(total / tokens, np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
            g_l, g_r, g_q, g_b = (x.reshape(s).astype(np.float32) for x, s in zip(parts, shapes, strict=True))
            grads = (g_l @ self.c[0].T + g_r @ self.c[1].T, g_q, np.stack([self.r.T @ g_l, self.r.T @ g_r]), g_b)
            rate = RATE * (1 - (step - 1) / STEPS)
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-9)
        return self

    def norms(self, contexts, unseen=None):
        """Of each context (``first * (CLASSES + 1) + second``) the log of the sum that normalises its
        scores and, with ``unseen``, the log-probability of the unknown token: what the tail
        classes leave for it."""
        import numpy as np

        norm, unknown = np.empty(len(contexts), np.float32), np.zeros(len(contexts), np.float32)
        left, right = self.r @ self.c[0], self.r @ self.c[1]
        for at in range(0, len(contexts), 2048):
            c = contexts[at : at + 2048]
            s = (left[c // (CLASSES + 1)] + right[c % (CLASSES + 1)]) @ self.q.T + self.b
            top = s.max(axis=1)
            e = np.exp(s - top[:, None])
            whole = e.sum(axis=1)
            norm[at : at + 2048] = top + np.log(whole)
            if unseen is not None:
                unknown[at : at + 2048] = np.log((e[:, TOP:END].astype(np.float64) @ unseen[TOP:END]) / whole)
        return norm, unknown

    def all_norms(self, unseen):
        """``norms`` of every context that there can be: (CLASSES + 1) ** 2, whatever the corpus."""
        import numpy as np

        return self.norms(np.arange((CLASSES + 1) ** 2), unseen)

    def log_prob(self, first, second, target, norm=None):
        """Normalised natural log-probabilities; ``norm`` has the norms of all contexts, else each
        context that occurs is multiplied once."""
        import numpy as np

        key = first.astype(np.int64) * (CLASSES + 1) + second
        if norm is None:
            contexts, place = np.unique(key, return_inverse=True)
            norm, key = self.norms(contexts)[0], place
        left, right = self.r @ self.c[0], self.r @ self.c[1]
        out = np.empty(len(key))
        for at in range(0, len(key), 1 << 16):
            x = slice(at, at + (1 << 16))
            h = left[first[x]] + right[second[x]]
            out[x] = np.einsum("ij,ij->i", h, self.q[target[x]]) + self.b[target[x]] - norm[key[x]]
        return out


def contexts_of(classes, starts):
    """The two classes before each token; ``starts`` are where texts begin."""
    import numpy as np

    first, second = np.full(len(classes), START, np.int64), np.full(len(classes), START, np.int64)
    second[1:], first[2:] = classes[:-1], classes[:-2]
    second[starts] = first[starts] = START
    after = starts + 1
    first[after[after < len(classes)]] = START
    second[starts] = START
    return first, second


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10) of each document.

    ``learn`` says which documents are counted and trained on.
    """
    import numpy as np

    spark = docs.sparkSession
    packed = B.pack(docs, id_col, text_col, learn)
    raw = packed.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()[0]
    buckets = B.buckets_for(spark, raw)
    counted = count_tokens(packed, buckets)

    sums = np.zeros(3 * CLASSES, np.int64)
    totals = counted.where("kind = 1").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for r in totals.collect():  # three numbers for each class
        sums[r["at"]] = r["n"]
    sums = sums.reshape(3, CLASSES)
    n_all, v_all = int(sums[0].sum()), int(sums[1].sum())
    top = [(bytes(r["word"]), r["n"]) for r in counted.where("kind = 2").orderBy(F.desc("n"), "word").limit(TOP).collect()]
    for w, c in top:
        sums[:, tail_class(w)] -= (c, 1, c == 1)
    tails, kinds, once = (x.astype(float) for x in sums)
    unigram = tails.copy()
    unigram[: len(top)] = [c for _, c in top]
    # What each tail class leaves for the unknown token: all of it, where it has no words.
    unseen = np.where(tails > 0, np.minimum((once + 0.5) / (tails + 1.0), 0.9), 1.0)
    number = {w: i for i, (w, _) in enumerate(top)}

    shards = max(8, min(MOST_SHARDS, -(-raw // SHARD_BYTES)))
    live = np.ones(CLASSES, bool)
    live[len(top) : TOP] = False  # places of frequent words that no word has taken
    model = LogBilinear(unigram, live)
    if n_all:
        model.fit(count_cells(packed, number, shards), n_all)

    # The model and its norms for every context are of a size that the classes give.
    shipped = spark.sparkContext.broadcast((model, *model.all_norms(unseen)))

    def run(row: dict, replies: list[dict]):
        import pyarrow as pa

        model, norm, unknown = shipped.value
        blk = B.Block(row)
        texts = [tokens_of(t) for t in blk.texts()]
        parts: dict[int, list[bytes]] = {0: []}
        for w in {w for t in texts for w in t}:
            parts.setdefault(_bucket(w, buckets), []).append(w)
        counts = {}
        for r in replies:
            words = sorted(parts[r["bucket"]])
            counts.update(zip(words, B.spread(r["counts"]).tolist(), strict=True))
        local = {w: i for i, w in enumerate(counts)}
        local_count = np.append(np.fromiter(counts.values(), np.int64, len(counts)), int(tails[END]))
        local_class = np.array([number[w] if w in number else tail_class(w) for w in counts] + [END], np.int64)
        end = len(counts)
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        ids = np.fromiter((i for t in texts for i in (*map(local.__getitem__, t), end)), np.int64, int(lens.sum()))
        first_at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        with np.errstate(divide="ignore"):
            inside = np.where(local_count > 0, np.log((1 - unseen[local_class]) * local_count / np.maximum(tails[local_class], 1)), 0.0)
        inside[(local_class < len(top)) | (local_class == END)] = 0.0
        base = np.log10((local_count + 0.5) / (n_all + 0.5 * (v_all + 1)))
        cls = local_class[ids]
        before = contexts_of(cls, first_at)
        log_p = model.log_prob(*before, cls, norm) + inside[ids]
        new = np.flatnonzero((local_count == 0)[ids] & (cls != END))
        log_p[new] = unknown[before[0][new] * (CLASSES + 1) + before[1][new]]
        add = lambda x: np.add.reduceat(x, first_at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blk.ids, mask=~blk.known), pa.array(lens), pa.array(add((local_count > 0)[ids].astype(np.int64))), pa.array(np.full(blk.n, n_all, np.int64)),
                pa.array(add(base[ids])), pa.array(add(log_p) / np.log(10.0)),
            ],
            names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    replies = counted.where("kind = 0").select("block", "bucket", "counts")
    return B.with_replies(packed, replies, run, f"`{id_col}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
