"""Corpus blocks and the exchange of sorted keys between blocks and key buckets.

A block is one row that holds some megabytes of consecutive documents: ids, lengths and the
compressed UTF-8 bytes. Operators that need corpus-wide facts about many small keys (words,
shingles, substrings) send each block's distinct keys to the bucket that owns their range, and
get one value per key back in the same order. Keys thus move as sorted, delta-coded arrays
instead of rows; a key shared by many documents is sent once per block, so a hot key costs a
bucket one entry per block; and no task sees more than a block or a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, shuffle_width, tidied, tidy

BLOCK_BYTES = 4 << 20
#: Tasks of an exchange at most; beyond as many buckets a task takes several, one after another.
MOST_TASKS = 4096
SCHEMA = "block long, n int, raw_bytes long, ids binary, known binary, flags binary, lens binary, data binary, extra binary"


class Block:
    """The documents of one row: ``ids`` (0 where ``known`` is false), ``flags``, ``starts``
    (one more than documents) and ``data``, all bytes one after another."""

    def __init__(self, row: dict):
        import numpy as np
        import zstandard

        self.block, self.n = row["block"], row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.bool_)
        self.flags = np.frombuffer(row["flags"], np.int8)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))])
        self.data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(self.starts[-1])) if self.starts[-1] else b""

    def extra(self, row: dict) -> list:
        """The carried columns."""
        import pyarrow as pa
        import zstandard

        if not row["extra"]:
            return []
        raw = zstandard.ZstdDecompressor().decompress(row["extra"])
        return [c.combine_chunks() for c in pa.ipc.open_stream(raw).read_all().columns]

    def texts(self) -> Iterator[bytes]:
        for i in range(self.n):
            yield self.data[self.starts[i] : self.starts[i + 1]]


def rows_of(batch) -> Iterator[dict]:
    """One dict at a time, so that only one block is unpacked at once."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def pack(docs: DataFrame, id_col: str, text_col: str, flag: Column | None = None, extra: list[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents to blocks, written once to the shared checkpoint folder. Null texts are empty, and
    flagged where the caller has no flag of its own.
    The columns named in ``extra`` go along as an Arrow stream, row by row."""
    mark = F.coalesce((F.col(text_col).isNull() if flag is None else flag).cast("int"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("_0"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_1"), mark.cast("int").alias("_2"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(extra)])

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids, flags, texts, size = [], [], [], 0
        carried = []

        def flush():
            nonlocal made, size
            stream = b""
            if carried:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, carried[0].schema) as out:
                    for x in carried:
                        out.write_batch(x)
                stream = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                carried.clear()
            known = np.array([i is not None for i in ids], np.bool_)
            lens = np.array([len(t) for t in texts], np.int64)
            row = [base + made, len(ids), size, np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), np.array(flags, np.int8).tobytes(), lens.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), stream]
            made, size = made + 1, 0
            ids.clear(), flags.clear(), texts.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                begin = 0
                for k, (i, t, f) in enumerate(zip(*(c.to_pylist() for c in part.columns[:3]), strict=True)):
                    ids.append(i), texts.append(t), flags.append(f)
                    size += len(t)
                    if size >= block_bytes:
                        if extra:
                            carried.append(part.slice(begin, k + 1 - begin).select(range(3, 3 + len(extra))))
                            begin = k + 1
                        yield flush()
                if extra and begin < part.num_rows:
                    carried.append(part.slice(begin).select(range(3, 3 + len(extra))))
        if ids:
            yield flush()

    return cut(rows.mapInArrow(tidied(run), SCHEMA))


def squeeze(values) -> bytes:
    """An integer array, compressed by byte planes: high bytes of sorted gaps are all alike."""
    import numpy as np
    import zstandard

    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T
    return v.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(blob: bytes):
    import numpy as np
    import zstandard

    kind = np.dtype(blob[:1].decode())
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(values) -> bytes:
    """Ascending unsigned values as gaps."""
    import numpy as np

    gaps = np.diff(values, prepend=values.dtype.type(0))
    small = gaps.max(initial=0)
    return squeeze(gaps.astype(np.uint16 if small < 1 << 16 else np.uint32 if small < 1 << 32 else np.uint64))


def spread_sorted(blob: bytes):
    import numpy as np

    return np.cumsum(spread(blob).astype(np.uint64), dtype=np.uint64)


def key_bits(raw_bytes: int) -> int:
    """Bits of a hashed key, so that about one in a thousand keys meets another by chance."""
    return min(63, max(32, raw_bytes.bit_length() + 8))


def buckets_for(spark, raw_bytes: int, bytes_per_bucket: int = 8 << 20) -> int:
    return max(shuffle_width(spark), -(-raw_bytes // bytes_per_bucket))


def pieces(keys, buckets: int, bits: int):
    """(bucket, start, stop) of the buckets that own some of the ascending ``bits``-bit keys; so a
    block's work is bounded by its own keys, however many buckets there are."""
    import numpy as np

    if not len(keys):
        return
    # bits >= 32; the top 32 of them place a key.
    to = (keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    start = 0
    for stop in [*(np.flatnonzero(np.diff(to)) + 1).tolist(), len(keys)]:
        yield int(to[start]), start, stop
        start = stop


def by_bucket(rows: DataFrame, buckets: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of each ``bucket`` from 0 to ``buckets``, one bucket at a time: a task
    has one bucket, or a range of them where there are more than ``MOST_TASKS``."""
    if buckets <= MOST_TASKS:
        return rows.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(tidied(run), schema)

    def each(batches: Iterator):
        def parts():
            for batch in batches:
                own, start = batch.column(0).to_pylist(), 0
                for stop in range(1, len(own) + 1):
                    if stop == len(own) or own[stop] != own[start]:
                        yield own[start], batch.slice(start, stop - start)
                        start = stop

        for _, of_one in groupby(parts(), key=lambda x: x[0]):
            yield from run(x for _, x in of_one)

    first = ["bucket", *[c for c in rows.columns if c != "bucket"]]
    dealt = rows.select(*first).repartitionById(MOST_TASKS, F.floor(F.col("bucket").cast("long") * MOST_TASKS / F.lit(buckets)).cast("int"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(tidied(each), schema)


def with_replies(blocks: DataFrame, replies: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(block_row, reply_rows)`` yields Arrow batches for each block."""
    nothing = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def both(left, right):
        import pyarrow as pa

        # One row: a block's number is unique.
        found = [*run(next(rows_of(left.to_batches()[0])), [r for b in right.to_batches() for r in rows_of(b)])] if left.num_rows else []
        tidy()
        return pa.Table.from_batches(found) if found else nothing

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)
