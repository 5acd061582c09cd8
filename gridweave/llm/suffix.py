"""Suffix-array removal of long strings that an earlier document has.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Only suffixes that can matter are sorted:

1. Anchors. Each window of ``LENGTH`` bytes names the place of its least-hashed ``GRAM``-byte
   string; equal windows name the same place, so windows in a row that share an anchor form a
   run, and a corpus-wide exchange of hashed grams (``blocks``) leaves the runs whose gram is
   in two documents at least.
2. Suffixes. A run's suffix begins at its anchor and is followed by what stands before it, so
   equal keys are equal runs and keys with one gram are neighbours. Sampled splitters over
   (key, document) range-partition them, so that even one key's copies spread over buckets;
   each bucket is sorted by multikey quicksort, eight bytes at a time; a key's least document
   is its first. Runs that share a gram but differ are compared window by window.
3. Boundaries. Grams at a bucket's edges may go on in the next one. Their windows (one for each
   distinct window and bucket) are range-partitioned and sorted again as plain suffixes of
   ``LENGTH`` bytes, and the first and last strings of adjacent buckets are compared.

Defined results: null texts are empty; texts under ``LENGTH`` bytes lose nothing; rows with
a null id lose nothing and take nothing from others; rows that share an id take nothing from
each other; extra columns are ignored by ``repeated_spans`` and kept by ``remove_repeats``; an
empty table gives an empty table; very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import cut, shuffle_width, tidied

LENGTH, GRAM = 50, 24
BEFORE = LENGTH - GRAM  # 26 bytes may stand before an anchor in its windows
_CHUNK, _PLACE = 1 << 18, (1 << 20) - 1
#: Blocks that the splitters are sampled from: this many, or one in ``SAMPLE_PART`` if that is more.
BLOCK_BYTES, SAMPLE_BLOCKS, SAMPLE_PART = 2 << 20, 48, 64
#: Buckets, and so splitters on the driver, at most: 6 MB of them; a bucket grows beyond.
MOST_BUCKETS = 65_536
BUCKET_KEYS, LOOK_KEYS, SAMPLES_PER_BUCKET, MOST_SAMPLES = 100_000, 12_000, 24, 262_144
KEY, WORDS, WINDOW_WORDS = 80, 10, 7


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(b):
    """A mixed polynomial hash of each GRAM bytes: 24 = 16 + 8."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    with np.errstate(over="ignore"):
        h = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[b]
        for step in (1, 2, 4):
            h = h[:-step] * power(step) + h[step:]
        h16 = h[:-8] * power(8) + h[8:]
        return _mix(h16[: len(b) - GRAM + 1] * power(8) + h[16:])


def anchor_runs(data, starts, known):
    """Runs of windows that share an anchor: first window, last window, anchor, document."""
    import numpy as np

    total = len(data) - LENGTH + 1
    if total <= 0:
        return [np.empty(0, np.int64)] * 4
    place = np.empty(total, np.int64)
    for at in range(0, total, _CHUNK):
        m = min(_CHUNK, total - at)
        h = _gram_hashes(data[at : at + m + LENGTH - 1])
        x = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            x = np.minimum(x[:-step], x[step:])
        x = np.minimum(x[:m], x[BEFORE - 15 : BEFORE - 15 + m])  # 27 = 16 + 11 places
        place[at : at + m] = (x & np.uint64(_PLACE)).astype(np.int64) + at
    valid = np.zeros(total, bool)
    for i in np.flatnonzero(known & (np.diff(starts) >= LENGTH)):
        valid[starts[i] : starts[i + 1] - LENGTH + 1] = True
    v = np.flatnonzero(valid)
    if not len(v):
        return [np.empty(0, np.int64)] * 4
    a = place[v]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (v[1:] != v[:-1] + 1)]))
    lo, hi = v[first], v[np.append(first[1:], len(v)) - 1]
    return [lo, hi, a[first], np.searchsorted(starts, lo, "right") - 1]


def _at(data, places, width):
    """The ``width`` bytes from each place on."""
    import numpy as np

    return np.lib.stride_tricks.sliding_window_view(data, width)[places]


def gram_keys(data, anchors, bits: int):
    import numpy as np

    if not len(anchors):
        return np.empty(0, np.uint64)
    w = np.ascontiguousarray(_at(data, anchors, GRAM)).view(np.uint64)
    with np.errstate(over="ignore"):
        h = _mix(_mix(_mix(w[:, 0] + np.uint64(1)) + w[:, 1]) + w[:, 2])
    return h >> np.uint64(64 - bits)


def run_keys(data, lo, hi, anchor):
    """Rows of KEY bytes: the suffix at the anchor, what stands before it, and both lengths."""
    import numpy as np

    pad = np.zeros(LENGTH, np.uint8)
    wide = np.concatenate([pad, data, pad])
    key = np.zeros((len(lo), KEY), np.uint8)
    after, before = hi + LENGTH - anchor, anchor - lo
    key[:, :LENGTH] = _at(wide, anchor + LENGTH, LENGTH)
    key[:, :LENGTH][np.arange(LENGTH)[None] >= after[:, None]] = 0
    key[:, LENGTH : LENGTH + BEFORE] = _at(wide, anchor + LENGTH - BEFORE, BEFORE)
    key[:, LENGTH : LENGTH + BEFORE][np.arange(BEFORE)[None] < (BEFORE - before)[:, None]] = 0
    key[:, LENGTH + BEFORE], key[:, LENGTH + BEFORE + 1] = after, before
    return key


def words_of(rows):
    """Byte rows as big-endian numbers, so that they compare as the bytes do."""
    import numpy as np

    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_sort(words, last):
    """Order of the rows by their words, ties by ``last``; and where a new key begins.

    A multikey sort of all partitions of a level at once: rows are parted by their first word, and
    after each word only the parts of several equal rows are sorted on, by the next one.
    """
    import numpy as np

    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    col = words[order, 0]
    head = np.ones(n, bool)
    head[1:] = col[1:] != col[:-1]
    for k in range(1, words.shape[1] + 1):
        group = np.cumsum(head)
        at = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(at):
            break
        sub, g = order[at], group[at]
        col = words[sub, k] if k < words.shape[1] else last[sub]
        o = np.lexsort((col, g))
        order[at] = sub[o]
        if k < words.shape[1]:
            col = col[o]
            head[at[1:]] |= (g[1:] == g[:-1]) & (col[1:] != col[:-1])
    return order, head


def _sortable(words, docs):
    """Keys with their document as fixed-length byte strings."""
    import numpy as np

    doc = (docs.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    rows = np.concatenate([words.astype(">u8").view(np.uint8).reshape(len(words), 8 * words.shape[1]), doc], axis=1)
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _picked(words, docs, rate: float):
    """A hashed sample of keys with their documents, as sortable strings of full length."""
    import numpy as np
    import pyarrow as pa

    h = _mix(words[:, 0] ^ _mix(words[:, 3] + _mix(docs.view(np.uint64))))
    some = np.flatnonzero((h >> np.uint64(11)) < np.uint64(rate * (1 << 53)))
    width = 8 * words.shape[1] + 8
    made = [x.ljust(width, b"\0") for x in _sortable(words[some], docs[some]).tolist()] if len(some) else []
    return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["k"])


def _rate(total: int, buckets: int, part: float = 1.0) -> float:
    return min(1.0, min(MOST_SAMPLES, SAMPLES_PER_BUCKET * buckets) / max(total * part, 1))


def _splitters(sample: DataFrame, buckets: int) -> list[bytes]:
    """``buckets - 1`` keys at most that cut the sample (some for each bucket) evenly."""
    found = sorted(bytes(r["k"]) for r in sample.collect())
    return sorted({found[len(found) * b // buckets] for b in range(1, buckets)}) if found else []


def _store(words) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(words.astype(">u8").tobytes())


def _load(blob: bytes, width: int):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), ">u8").astype(np.uint64).reshape(-1, width)


_KEYS = "kind int, bucket int, block long, n long, keys binary, docs binary, runs binary, more binary"


def _batch(rows: list[dict]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in _KEYS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[k]) for name, k in fields], names=[f[0] for f in fields])


def _dealt(cuts: list[bytes], block: int, words, docs, runs, more=None) -> list[dict]:
    """A block's keys as one row for each bucket that they belong to."""
    import numpy as np

    edges = np.array(cuts, f"S{8 * words.shape[1] + 8}")
    to = np.searchsorted(edges, _sortable(words, docs), "right")
    order = np.argsort(to, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(to[order])) + 1, len(to))
    at, out = 0, []
    for z in ends if len(to) else ():
        x = order[at:z]
        out.append({"kind": 0, "bucket": int(to[x[0]]), "block": block, "n": len(x), "keys": _store(words[x]), "docs": B.squeeze(docs[x]), "runs": B.squeeze(runs[x]), "more": B.squeeze(more[x]) if more is not None else None})
        at = z
    return out


def _gather(batches: Iterator, width: int, aside: list | None = None):
    """All keys of a bucket: words, docs, block of each, runs, more. Rows of kind 3 go aside."""
    import numpy as np

    words, docs, blks, runs, more = [], [], [], [], []
    for batch in batches:
        for r in B.rows_of(batch):
            if r["kind"] == 3:
                aside.append(r)
                continue
            words.append(_load(r["keys"], width)), docs.append(B.spread(r["docs"])), runs.append(B.spread(r["runs"]))
            blks.append(np.full(len(docs[-1]), r["block"], np.int64))
            more.append(B.spread(r["more"]) if r["more"] else np.empty(0, np.int64))
    return [np.concatenate(x) for x in (words, docs, blks, runs, more)] if words else None


def windows_of(keys):
    """All windows of runs given as key rows: row number, shift, and LENGTH bytes in words."""
    import numpy as np

    after, before = keys[:, LENGTH + BEFORE].astype(int), keys[:, LENGTH + BEFORE + 1].astype(int)
    mat = np.concatenate([keys[:, LENGTH : LENGTH + BEFORE], keys[:, :LENGTH]], axis=1)
    row, shift, text = [], [], []
    for c in range(BEFORE + 1):
        r = np.flatnonzero((c >= BEFORE - before) & (c + LENGTH <= BEFORE + after))
        if len(r):
            row.append(r), shift.append(np.full(len(r), c))
            x = np.zeros((len(r), WINDOW_WORDS * 8), np.uint8)
            x[:, :LENGTH] = mat[r, c : c + LENGTH]
            text.append(words_of(x))
    if not row:
        return np.empty(0, int), np.empty(0, int), np.empty((0, WINDOW_WORDS), np.uint64)
    return np.concatenate(row), np.concatenate(shift), np.concatenate(text)


def _by_block(kind: int, blks, **columns):
    """One row for each block with the given columns of its entries."""
    import numpy as np

    order = np.argsort(blks, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(blks[order])) + 1, len(order))
    at = 0
    for z in ends if len(order) else ():
        x = order[at:z]
        yield {"kind": kind, "block": int(blks[x[0]])} | {name: B.squeeze(v[x]) for name, v in columns.items()}
        at = z


def _sort_runs(batches: Iterator):
    """Bucket of run keys: for each run its key's least document and its windows that a smaller
    document has (kind 0, by block), and the windows at the bucket's edges (kind 1)."""
    import numpy as np

    aside: list[dict] = []
    got = _gather(batches, WORDS, aside)
    if aside:
        yield _batch(aside)
    if got is None:
        return
    words, docs, blks, runs, _ = got
    order, head = multikey_sort(words, docs)
    words, docs, blks, runs = words[order], docs[order], blks[order], runs[order]
    key = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    least = docs[first]
    gram_head = np.ones(len(first), bool)
    gram_head[1:] = (words[first][1:, :3] != words[first][:-1, :3]).any(axis=1)
    gram = np.cumsum(gram_head) - 1
    edge = (gram == 0) | (gram == gram[-1])
    look = np.flatnonzero((np.bincount(gram)[gram] > 1) | edge)
    mask = np.zeros(len(first), np.int64)
    # Windows of different grams never meet, so grams are taken a few at a time.
    start = 0
    while start < len(look):
        stop = min(start + LOOK_KEYS, len(look))
        stop = start + int(np.searchsorted(gram[look[start:]], gram[look[stop - 1]], "right"))
        part = look[start:stop]
        start = stop
        row, shift, text = windows_of(words[first[part]].astype(">u8").view(np.uint8).reshape(len(part), KEY))
        at = part[row]
        o, h = multikey_sort(text, least[at])
        low = least[at[o]][np.flatnonzero(h)][np.cumsum(h) - 1]
        hit = low < least[at[o]]
        np.bitwise_or.at(mask, at[o][hit], np.int64(1) << shift[o][hit])
        # The edges' windows whose least document here is their own are compared elsewhere too;
        # rows that share that id all wait for the answer.
        ask = o[~hit & edge[at[o]]]
        if not len(ask):
            continue
        owner = np.flatnonzero((docs == least[key]) & edge[key])
        begin = np.searchsorted(key[owner], at[ask], "left")
        count = np.searchsorted(key[owner], at[ask], "right") - begin
        rep = np.repeat(np.arange(len(ask)), count)
        own = owner[np.repeat(begin, count) + (np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count))]
        for b in np.unique(blks[own]):
            x = np.flatnonzero(blks[own] == b)
            yield _batch([{"kind": 1, "block": int(b), "n": len(x), "keys": _store(text[ask[rep[x]]]), "docs": B.squeeze(docs[own[x]]), "runs": B.squeeze(runs[own[x]]), "more": B.squeeze(shift[ask[rep[x]]])}])
    tell = (least[key] < docs) | (mask[key] != 0)
    out = [*_by_block(0, blks[tell], docs=least[key][tell], runs=runs[tell], more=mask[key][tell])]
    if out:
        yield _batch(out)


def _sort_windows(batches: Iterator):
    """Bucket of windows: those that a smaller document has (kind 0, by block), and the
    bucket's edges (kind 1): first and last string, and their least documents (block and n)."""
    import numpy as np

    bucket = None

    def noted(inner):
        nonlocal bucket
        for batch in inner:
            if batch.num_rows:
                bucket = batch.column("bucket")[0].as_py() if hasattr(batch, "column") else None
            yield batch

    got = _gather(noted(batches), WINDOW_WORDS)
    if got is None:
        return
    words, docs, blks, runs, shift = got
    order, head = multikey_sort(words, docs)
    words, docs, blks, runs, shift = words[order], docs[order], blks[order], runs[order], shift[order]
    key = np.cumsum(head) - 1
    low = docs[np.flatnonzero(head)][key]
    hit = low < docs
    out = [*_by_block(0, blks[hit], runs=runs[hit], more=shift[hit])]
    wait = np.flatnonzero(~hit & (key == 0))
    for r in _by_block(2, blks[wait], runs=runs[wait], more=shift[wait]):
        out.append(r | {"bucket": bucket})
    ends = np.concatenate([words[:1], words[-1:]])
    out.append({"kind": 1, "bucket": bucket, "block": int(low[0]), "n": int(low[-1]), "keys": ends.astype(">u8").tobytes()})
    yield _batch(out)


def carried_buckets(edges: DataFrame) -> DataFrame:
    """(bucket): those whose first string goes on from buckets before with a smaller document.

    ``edges``: bucket, ``keys`` (first and last string), ``block`` and ``n`` (their least documents).
    Equal strings are in a row of buckets and documents ascend within a string, so the first of the
    buckets that end with a string has its least document."""
    half = WINDOW_WORDS * 8
    part = edges.select("bucket", F.substring("keys", 1, half).alias("first"), F.substring("keys", half + 1, half).alias("last"), F.col("block").alias("first_low"), F.col("n").alias("last_low"))
    begun = part.groupBy(F.col("last").alias("string")).agg(F.min(F.struct("bucket", "last_low")).alias("b"))
    met = part.join(begun, (F.col("first") == F.col("string")) & (F.col("b.bucket") < F.col("bucket")) & (F.col("b.last_low") < F.col("first_low")))
    return met.select("bucket")


def _analyse(docs: DataFrame, id_col: str, text_col: str, extra: list[str]):
    """The packed blocks, and what each block must know to cut its documents."""
    spark = docs.sparkSession
    packed = B.pack(docs, id_col, text_col, extra=extra, block_bytes=BLOCK_BYTES)
    raw, n_blocks = packed.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)), F.count("*")).first()
    buckets, bits = B.buckets_for(spark, raw), B.key_bits(raw)

    def scan(row: dict):
        import numpy as np

        blk = B.Block(row)
        data = np.frombuffer(blk.data, np.uint8)
        lo, hi, anchor, doc = anchor_runs(data, blk.starts, blk.known)
        return blk, data, lo, hi, anchor, doc, gram_keys(data, anchor, bits)

    def send(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in B.rows_of(batch):
                blk, _, _, _, _, doc, grams = scan(row)
                order = np.lexsort((doc, grams))
                g, d = grams[order], doc[order]
                head = np.ones(len(g), bool)
                head[1:] = g[1:] != g[:-1]
                many = np.zeros(len(g), bool)
                many[1:] = ~head[1:] & (d[1:] != d[:-1])
                keys = g[head]
                several = np.bitwise_or.reduceat(many, np.flatnonzero(head)) if len(g) else many
                out = {"bucket": [], "block": [], "keys": [], "many": []}
                for b, a, z in B.pieces(keys, buckets, bits):
                    out["bucket"].append(b), out["block"].append(blk.block)
                    out["keys"].append(B.squeeze_sorted(keys[a:z])), out["many"].append(B.squeeze(several[a:z].astype(np.uint8)))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]))

    def shared(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        keys, many, blks = [], [], []
        for batch in batches:
            for row in B.rows_of(batch):
                keys.append(B.spread_sorted(row["keys"])), many.append(B.spread(row["many"])), blks.append((row["bucket"], row["block"]))
        if not keys:
            return
        _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = np.bincount(place, np.concatenate(many)) > 0
        good = (several | (count > 1))[place]
        at = 0
        for (bucket, block), k in zip(blks, keys, strict=True):
            bits_here = good[at : at + len(k)]
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [block], "good": [B.squeeze(np.packbits(bits_here))], "n": [int(bits_here.sum())]}, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("good", pa.binary()), ("n", pa.int64())]))
            at += len(k)

    def keys_of(row: dict, replies: list[dict]):
        """The block's distinct keys: words, least ids, run numbers; equal runs and their leads."""
        import numpy as np

        blk, data, lo, hi, anchor, doc, grams = scan(row)
        keys, place = np.unique(grams, return_inverse=True)
        ranges = {b: (a, z) for b, a, z in B.pieces(keys, buckets, bits)}
        good = np.zeros(len(keys), bool)
        for r in replies:
            a, z = ranges[r["bucket"]]
            good[a:z] = np.unpackbits(B.spread(r["good"]), count=z - a)
        runs = np.flatnonzero(good[place]) if len(place) else np.empty(0, int)
        if not len(runs):
            return None
        words = words_of(run_keys(data, lo[runs], hi[runs], anchor[runs]))
        ids = blk.ids[doc[runs]]
        order, head = multikey_sort(words, ids)
        first = np.flatnonzero(head)
        lead = first[np.cumsum(head) - 1]
        twin = np.flatnonzero(lead != np.arange(len(order)))
        runs = runs.astype(np.int32)
        return words[order[first]], ids[order[first]], runs[order[first]], runs[order[twin]], runs[order[lead[twin]]]

    grams = packed.mapInArrow(tidied(send), "bucket int, block long, keys binary, many binary")
    good = cut(B.by_bucket(grams, buckets, shared, "bucket int, block long, good binary, n long"))

    # Splitters from the keys of a hashed sample of blocks; one block in ``every``.
    total = good.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = max(1, n_blocks // max(SAMPLE_BLOCKS, n_blocks // SAMPLE_PART))
    n_b = min(MOST_BUCKETS, max(shuffle_width(spark), -(-total // BUCKET_KEYS)))
    rate = _rate(total, n_b, 1 / every)

    def sample(row: dict, replies: list[dict]):
        got = keys_of(row, replies)
        if got is not None:
            yield _picked(got[0], got[1], rate)

    some = F.pmod(F.xxhash64("block"), F.lit(every)) == 0
    cuts = _splitters(B.with_replies(packed.where(some), good.where(some), sample, "k binary"), n_b)

    def emit(row: dict, replies: list[dict]):
        got = keys_of(row, replies)
        if got is not None:
            words, ids, runs, twins, leads = got
            # Runs of this block that equal another one in it pass through some bucket.
            aside = {"kind": 3, "bucket": row["block"] % n_b, "block": row["block"], "n": len(twins), "runs": B.squeeze(twins), "more": B.squeeze(leads)}
            yield _batch([*_dealt(cuts, row["block"], words, ids, runs), aside])

    dealt = B.with_replies(packed, good, emit, _KEYS)
    sorted_runs = cut(B.by_bucket(dealt, n_b, _sort_runs, _KEYS))

    asked = sorted_runs.where("kind = 1")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_w = min(MOST_BUCKETS, max(shuffle_width(spark), -(-total // BUCKET_KEYS)))
    window_rate = _rate(total, n_w)

    def sample_windows(batches: Iterator):
        for batch in batches:
            for r in B.rows_of(batch):
                yield _picked(_load(r["keys"], WINDOW_WORDS), B.spread(r["docs"]), window_rate)

    window_cuts = _splitters(asked.mapInArrow(sample_windows, "k binary"), n_w)

    def deal_windows(batches: Iterator):
        for batch in batches:
            for r in B.rows_of(batch):
                yield _batch(_dealt(window_cuts, r["block"], _load(r["keys"], WINDOW_WORDS), B.spread(r["docs"]), B.spread(r["runs"]), B.spread(r["more"])))

    sorted_windows = cut(B.by_bucket(asked.mapInArrow(deal_windows, _KEYS), n_w, _sort_windows, _KEYS))
    carried = carried_buckets(sorted_windows.where("kind = 1"))
    late = sorted_windows.where("kind = 2").join(carried, "bucket", "left_semi").select(*sorted_windows.columns)
    hits = sorted_windows.where("kind = 0").unionByName(late).withColumn("kind", F.lit(1))
    told = sorted_runs.where("kind IN (0, 3)").unionByName(hits)
    return packed, told.select("block", "kind", "docs", "runs", "more")


def _cut_block(row: dict, replies: list[dict]):
    """The block, and which of its bytes go."""
    import numpy as np

    blk = B.Block(row)
    data = np.frombuffer(blk.data, np.uint8)
    if not replies:
        return blk, data, np.zeros(len(data), bool)
    lo, hi, anchor, doc = anchor_runs(data, blk.starts, blk.known)
    ids = blk.ids[doc]
    left = np.full(len(lo), BEFORE)  # shift of a run's first window
    whole, mask = np.zeros(len(lo), bool), np.zeros(len(lo), np.int64)
    left -= anchor - lo
    for r in replies:
        if r["kind"] == 0:
            runs, least = B.spread(r["runs"]), B.spread(r["docs"])
            whole[runs[least < ids[runs]]] = True
            mask[runs] |= B.spread(r["more"])
        elif r["kind"] == 1:
            np.bitwise_or.at(mask, B.spread(r["runs"]), np.int64(1) << B.spread(r["more"]).astype(np.int64))
    for r in replies:
        if r["kind"] == 3:
            runs, lead = B.spread(r["runs"]), B.spread(r["more"])
            whole[runs] |= whole[lead] | (ids[runs] > ids[lead])
            mask[runs] |= mask[lead]
    turn = np.zeros(len(data) + 1, np.int64)
    np.add.at(turn, lo[whole], 1)
    np.add.at(turn, hi[whole] + LENGTH, -1)
    part = np.flatnonzero(~whole & (mask != 0))
    for c in range(BEFORE + 1):
        s = lo[part[(mask[part] >> c) & 1 == 1]] + c - left[part[(mask[part] >> c) & 1 == 1]]
        np.add.at(turn, s, 1)
        np.add.at(turn, s + LENGTH, -1)
    return blk, data, np.cumsum(turn[:-1]) > 0


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes``, ``spans`` (the removed byte ranges) and ``kept``, the remaining bytes."""
    packed, told = _analyse(docs, id_col, text_col, [])

    def run(row: dict, replies: list[dict]):
        import numpy as np
        import pyarrow as pa

        blk, data, gone = _cut_block(row, replies)
        kept, spans = [], []
        for i in range(blk.n):
            g = gone[blk.starts[i] : blk.starts[i + 1]]
            if g.any():
                kept.append(data[blk.starts[i] : blk.starts[i + 1]][~g].tobytes())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(turn[::2], turn[1::2], strict=True)])
            else:
                kept.append(blk.data[blk.starts[i] : blk.starts[i + 1]])
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(blk.ids, mask=~blk.known), pa.array(np.diff(blk.starts)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return B.with_replies(packed, told, run, f"`{id_col}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = None) -> DataFrame:
    """All columns of ``docs``, with repeated strings cut out of the text. Bytes of a character
    that was cut in two are left out; ``n_chars_col`` is set to the new length in characters."""
    extra = [c for c in docs.columns if c not in (id_col, text_col)]
    packed, told = _analyse(docs, id_col, text_col, extra)
    fields = [T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType()), *[docs.schema[c] for c in extra]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def run(row: dict, replies: list[dict]):
        import pyarrow as pa

        blk, data, gone = _cut_block(row, replies)
        rest = lambda a, z: data[a:z][~gone[a:z]].tobytes().decode("utf-8", "ignore")
        texts = [None if blk.flags[i] else rest(blk.starts[i], blk.starts[i + 1]) for i in range(blk.n)]
        yield pa.RecordBatch.from_arrays([pa.array(blk.ids, mask=~blk.known), pa.array(texts, pa.string()), *blk.extra(row)], names=[f.name for f in fields])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out = B.with_replies(packed, told, run, ddl)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out.select(*docs.columns)
