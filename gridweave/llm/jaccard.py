"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct five-word shingles. Documents are linked if
``100 * |A & B| >= 75 * |A | B|``, and every link between different sets counts: the stages
below only leave out pairs that cannot be linked or whose documents are joined already.

1. Shingle frequencies: blocks of documents get the document frequency of each of their
   shingles (``blocks``). A set with fewer than 75 % shared shingles has no link.
2. Equal sets become one representative, the smallest id.
3. Groups: representatives with the same least-hashed shared shingle are similar; they are one
   group, dealt to several where that would have over ``SHARD_ROWS`` sets or ``SHARD_TOKENS``
   shingles (each of these also has the smallest representative as a guest). A group is stored
   as the union of its tokens and its members as rows of a matrix over it. Products of that
   matrix give the links within, and their components.
4. Queries: linked sets share one of their rarest shared shingles, so the token-group matrix
   names the groups that a set may have links in. A set asks those with members of a larger
   component and of fitting sizes. Its overlap with a group's stored union bounds every overlap
   within; only the groups that reach the need are opened, that is, their members are sent for
   and multiplied with the sets that qualified.
5. Components over the links within groups and those found in opened groups.

Defined results: null and empty texts have no shingles, are linked with nothing and are their
own component; a text of fewer than five words has its whole sequence as one shingle; rows
that share an id are one vertex, with a row each; rows with a null id have a null component and
are linked with nothing; extra columns are ignored; an empty table gives an empty table.
Shingles are compared by 64-bit hashes and whole sets by 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import cut, tidied
from .components import components, join_edges

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
SHARD_ROWS, SHARD_TOKENS, QUERY_ROWS, COLUMN_BATCH = 256, 2_000_000, 256, 4096
_LOCAL = "doc_id long, n int, digest binary, toks binary, key long, block long, row int"


def shingle_sets(texts: Iterator[bytes], size: int = SHINGLE) -> list:
    """The distinct shingle hashes of each text, ascending, as uint64."""
    import numpy as np
    import xxhash

    word_hash: dict[bytes, int] = {}
    lens, hashes = [], []
    for t in texts:
        words = t.lower().split()
        for w in words:
            if w not in word_hash:
                word_hash[w] = xxhash.xxh3_64_intdigest(w)
        lens.append(len(words))
        hashes += map(word_hash.__getitem__, words)
    h = np.array(hashes, np.uint64)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    width = len(h) - size + 1
    grams = np.zeros(max(width, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            grams += (h[k : k + max(width, 0)] ^ (h[k : k + max(width, 0)] >> np.uint64(29))) * odd[k % 5] + np.uint64(k)
            grams = _mix(grams)
        out, at = [], 0
        for n in lens:
            if n >= size:
                out.append(np.unique(grams[at : at + n - size + 1]))
            elif n:
                x = np.uint64(n)
                for y in h[at : at + n]:
                    x = _mix(x * odd[1] + y)
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def need(n: int) -> int:
    """Shared shingles that a set of ``n`` needs at least for any link."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(shared, n, m):
    return DENOMINATOR * shared >= NUMERATOR * (n + m - shared)


def local_sets(docs: DataFrame, id_col: str, text_col: str, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocks, and (doc_id, n, digest, toks, key, block, row) of their documents. toks, null for sets
    without a possible link, are the shared shingles from the rarest on; ties of frequency go by
    hash, alike in all documents; key is the least-hashed one."""
    spark = docs.sparkSession
    packed = B.pack(docs, id_col, text_col, extra=extra)
    raw = packed.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()[0]
    buckets, bits = B.buckets_for(spark, raw), B.key_bits(raw)

    def sets_of(row: dict):
        import numpy as np

        blk = B.Block(row)
        sets = shingle_sets(blk.texts())
        # Rows without an id take no part in frequencies and links.
        known = [s for s, k in zip(sets, blk.known, strict=True) if k]
        whole = np.concatenate(known) if known else np.empty(0, np.uint64)
        return blk, sets, whole >> np.uint64(64 - bits)

    def send(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in B.rows_of(batch):
                blk, _, keys = sets_of(row)
                keys, n = np.unique(keys, return_counts=True)
                out = {"bucket": [], "block": [], "keys": [], "n": []}
                for b, a, z in B.pieces(keys, buckets, bits):
                    out["bucket"].append(b), out["block"].append(blk.block)
                    out["keys"].append(B.squeeze_sorted(keys[a:z])), out["n"].append(B.squeeze(n[a:z].astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())]))

    def total(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        keys, ns, blks = [], [], []
        for batch in batches:
            for row in B.rows_of(batch):
                keys.append(B.spread_sorted(row["keys"])), ns.append(B.spread(row["n"])), blks.append((row["bucket"], row["block"]))
        if not keys:
            return
        lens = [len(k) for k in keys]
        whole = np.concatenate(keys)
        del keys
        _, place = np.unique(whole, return_inverse=True)
        del whole
        df = np.bincount(place, np.concatenate(ns)).astype(np.int64)[place]
        # Frequencies by eighths of a doubling: rough, but in one order for all documents.
        code = np.minimum(255, np.floor(8 * np.log2(df))).astype(np.uint8)
        at = 0
        for (bucket, block), n in zip(blks, lens, strict=True):
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "block": [block], "codes": [B.squeeze(code[at : at + n])]}, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("codes", pa.binary())]))
            at += n

    def settle(row: dict, replies: list[dict]):
        import hashlib

        import numpy as np
        import pyarrow as pa

        blk, sets, whole = sets_of(row)
        keys, place = np.unique(whole, return_inverse=True)
        codes = np.concatenate([B.spread(r["codes"]) for r in sorted(replies, key=lambda r: r["bucket"])]) if replies else np.empty(0, np.uint8)
        code = codes[place] if len(place) else codes
        digests, toks, least, at = [], [], [], 0
        for s, known in zip(sets, blk.known, strict=True):
            c = code[at : at + len(s)] if known else np.zeros(len(s), np.uint8)
            at += len(s) if known else 0
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            shared = s[c > 0]
            if len(s) and len(shared) >= need(len(s)):
                toks.append(shared[np.lexsort((shared, c[c > 0]))].tobytes())
                with np.errstate(over="ignore"):
                    least.append(int(_mix(shared + np.uint64(1)).min().view(np.int64)))
            else:
                toks.append(None), least.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blk.ids, mask=~blk.known), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.array(toks, pa.binary()), pa.array(least, pa.int64()), pa.array(np.full(blk.n, blk.block)), pa.array(np.arange(blk.n, dtype=np.int32))],
            names=["doc_id", "n", "digest", "toks", "key", "block", "row"],
        )

    sent = packed.mapInArrow(tidied(send), "bucket int, block long, keys binary, n binary")
    replies = B.by_bucket(sent, buckets, total, "bucket int, block long, codes binary")
    return packed, cut(B.with_replies(packed, replies, settle, _LOCAL))


def _rare(reps: DataFrame) -> DataFrame:
    """(token, rep): those of a set's rarest shared shingles that a linked set must meet."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            toks, ids = [], []
            for rep, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.frombuffer(raw, np.int64)
                t = t[: len(t) - need(n) + 1]
                toks.append(t), ids.append(np.full(len(t), rep, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (toks, ids)], names=["token", "rep"])

    return reps.select("rep", "n", "toks").mapInArrow(run, "token long, rep long")


def _runs(batches: Iterator, width: int) -> Iterator[list[tuple]]:
    """The rows of each group; rows are sorted by their first ``width`` columns, the group."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _flat(rows: list):
    """Index arrays as (row, index) pairs."""
    import numpy as np

    lens = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lens), np.concatenate(rows) if rows else np.empty(0, np.int64)


def overlaps(queries: list, members: list, width: int):
    """How many indices (under ``width``) each query has in common with each member, by products
    of incidence matrices, some columns at a time."""
    import numpy as np

    (q_row, q_col), (m_row, m_col) = _flat(queries), _flat(members)
    used = np.flatnonzero((np.bincount(q_col, minlength=width) > 0) & (np.bincount(m_col, minlength=width) > (queries is members)))
    place = np.full(width, -1)
    place[used] = np.arange(len(used))
    q_col, m_col = place[q_col], place[m_col]
    shared = np.zeros((len(queries), len(members)), np.float32)
    for a in range(0, len(used), COLUMN_BATCH):
        z = min(a + COLUMN_BATCH, len(used))
        m = np.zeros((len(members), z - a), np.float32)
        some = (m_col >= a) & (m_col < z)
        m[m_row[some], m_col[some] - a] = 1
        q = m
        if queries is not members:
            q = np.zeros((len(queries), z - a), np.float32)
            some = (q_col >= a) & (q_col < z)
            q[q_row[some], q_col[some] - a] = 1
        shared += q @ m.T
    return np.rint(shared).astype(np.int64)


def stars(hit, rows: list[int], cols: list[int]) -> list[tuple[int, int]]:
    """(vertex, least vertex) of the components of a matrix of links, without the least ones."""
    import numpy as np

    r, c = np.nonzero(hit)
    found = join_edges([rows[i] for i in r.tolist()], [cols[i] for i in c.tolist()])
    return [(x, y) for x, y in found.items() if x != y]


class Group:
    """A group's token union (ascending) and its members as rows of indices into it."""

    def __init__(self, ids: list[int], n: list[int], sets: list):
        import numpy as np

        self.ids, self.n = ids, n
        if len(sets) == 1:
            self.union = np.sort(sets[0])
            self.rows = [np.arange(len(self.union))]
        else:
            self.union, place = np.unique(np.concatenate(sets), return_inverse=True)
            self.rows = [np.sort(x) for x in np.split(place, np.cumsum([len(x) for x in sets])[:-1])]

    def links(self) -> list[tuple[int, int]]:
        import numpy as np

        if len(self.ids) < 2:
            return []
        n = np.array(self.n)
        return stars(np.triu(linked(overlaps(self.rows, self.rows, len(self.union)), n[:, None], n[None]), 1), self.ids, self.ids)

    def packed(self) -> bytes:
        import numpy as np

        head = np.array([len(self.ids), *self.ids, *self.n, *[len(r) for r in self.rows]], np.int64).tobytes()
        return head + B.squeeze(np.concatenate([np.diff(r, prepend=0) for r in self.rows]).astype(np.int32))

    @staticmethod
    def opened(raw: bytes):
        """ids, sizes and rows of the members."""
        import numpy as np

        k = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, n, lens = np.frombuffer(raw, np.int64, 3 * k, 8).reshape(3, k)
        gaps = B.spread(raw[8 + 24 * k :]).astype(np.int64)
        return ids.tolist(), n, [np.cumsum(x) for x in np.split(gaps, np.cumsum(lens)[:-1])]


def _make_groups(batches: Iterator):
    """Sorted (grp, rep, n, toks) rows to links within groups and stored groups."""
    import numpy as np
    import pyarrow as pa

    kinds = {"grp": pa.int64(), "u": pa.int64(), "v": pa.int64(), "union": pa.binary(), "members": pa.binary()}
    rows: list[tuple] = []
    size = 0

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=[*kinds])
        rows.clear()
        return made

    for run in _runs(batches, 1):
        group = Group([r[1] for r in run], [r[2] for r in run], [np.frombuffer(r[3], np.uint64) for r in run])
        rows += [(run[0][0], u, v, None, None) for u, v in group.links()]
        rows.append((run[0][0], None, None, group.union.tobytes(), group.packed()))
        size += 16 * len(group.union)
        if size > 4 << 20 or len(rows) > 8192:
            yield flush()
            size = 0
    if rows:
        yield flush()


def _qualify(batches: Iterator):
    """Sorted (grp, part, rep, n, toks) rows, where the row without rep is the group's union: the
    queries whose overlap with the union reaches what some linked set would need."""
    import numpy as np
    import pyarrow as pa

    names, kinds = ["grp", "part", "rep", "n", "cells"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    for run in _runs(batches, 2):
        union = np.frombuffer(run[0][4], np.uint64)
        out = []
        for grp, part, rep, n, raw in run[1:]:
            t = np.frombuffer(raw, np.uint64)
            i = np.minimum(np.searchsorted(union, t), len(union) - 1)
            i = np.sort(i[union[i] == t])
            # |A & B| >= 75/175 (|A| + |B|), and the smallest set that can be linked has 75 % of |A|.
            if (NUMERATOR + DENOMINATOR) * len(i) >= NUMERATOR * (n + need(n)):
                out.append((grp, part, rep, n, i.astype(np.int32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _open(batches: Iterator):
    """Sorted (grp, part, rep, n, cells) rows, where the row without rep has the group's members:
    the components of the qualified queries and the members that they are linked with."""
    import numpy as np
    import pyarrow as pa

    for run in _runs(batches, 2):
        ids, n_member, rows = Group.opened(run[0][4])
        width = 1 + max((int(r[-1]) for r in rows), default=0)
        for at in range(1, len(run), QUERY_ROWS):
            part = run[at : at + QUERY_ROWS]
            queries = [np.frombuffer(r[4], np.int32).astype(np.int64) for r in part]
            hit = linked(overlaps(queries, rows, width), np.array([r[3] for r in part])[:, None], n_member[None])
            found = stars(hit, [r[2] for r in part], ids)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])


def _groups(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, grp) of each representative, and the stored groups with the links within."""
    many = F.greatest(F.count("*") / SHARD_ROWS, F.sum(F.octet_length("toks") / 8) / SHARD_TOKENS)
    shape = reps.groupBy("key").agg(F.ceil(many).cast("int").alias("shards"), F.min("rep").alias("lead")).where("shards > 1")
    shape = cut(shape.select(F.col("key").alias("s_key"), "shards", "lead"))
    deal = lambda rep: F.pmod(F.xxhash64(rep), F.col("shards")).cast("int")
    dealt = reps.select("rep", "key").join(shape, F.col("key") == F.col("s_key"), "left")
    dealt = dealt.select("rep", F.xxhash64("key", F.coalesce(deal("rep"), F.lit(0))).alias("grp"))
    guests = shape.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).where(F.col("shard") != deal("lead"))
    placed = dealt.union(guests.select("lead", F.xxhash64("s_key", "shard")))
    sets = reps.select(F.col("rep").alias("t_rep"), "n", "toks")
    met = placed.join(sets, F.col("rep") == F.col("t_rep")).select("grp", "rep", "n", "toks")
    return dealt, cut(met.repartition("grp").sortWithinPartitions("grp").mapInArrow(tidied(_make_groups), "grp long, u long, v long, union binary, members binary"))


def _asks(reps: DataFrame, dealt: DataFrame, label: DataFrame) -> DataFrame:
    """(rep, grp): the groups that a set may have a link of another component in."""
    comp = label.select(F.col("vertex").alias("c_rep"), "component")
    sized = reps.select("rep", "n").join(comp, F.col("rep") == F.col("c_rep"), "left").select("rep", "n", F.coalesce("component", "rep").alias("comp"))
    sized = sized.join(dealt.withColumnRenamed("rep", "d_rep"), F.col("rep") == F.col("d_rep")).drop("d_rep")
    sizes = cut(label.groupBy(F.col("component").alias("s_comp")).agg(F.count("*").alias("size")))
    own = F.struct(F.coalesce("size", F.lit(1)).alias("size"), "comp").alias("own")
    placed = cut(sized.join(sizes, F.col("comp") == F.col("s_comp"), "left").select(F.col("rep").alias("p_rep"), "n", "grp", own))
    entries = _rare(reps).join(placed, F.col("rep") == F.col("p_rep")).drop("p_rep")
    # Tokens that only one component has need no look; the rest is the token-group matrix.
    spread = entries.groupBy("token").agg(F.min("own.comp").alias("lo"), F.max("own.comp").alias("hi")).where("lo < hi")
    spread = cut(spread.select(F.col("token").alias("s_token")))
    entries = cut(entries.join(spread, F.col("token") == F.col("s_token")).drop("s_token"))
    matrix = entries.groupBy(F.col("token").alias("m_token"), F.col("grp").alias("asked")).agg(F.max("own").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (F.lit(DENOMINATOR) * F.col("high") >= F.lit(NUMERATOR) * F.col("n")) & (F.lit(DENOMINATOR) * F.col("n") >= F.lit(NUMERATOR) * F.col("low"))
    met = entries.join(matrix, (F.col("token") == F.col("m_token")) & (F.col("most") > F.col("own")) & fits)
    return cut(met.select("rep", F.col("asked").alias("grp")).distinct())


def _between(reps: DataFrame, groups: DataFrame, asks: DataFrame) -> DataFrame:
    """Links (u, v) of sets to members of the groups that they ask and that their bound opens."""
    shape = cut(asks.groupBy(F.col("grp").alias("s_grp")).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts")))
    sets = reps.select(F.col("rep").alias("t_rep"), "n", "toks")
    parted = asks.join(shape, F.col("grp") == F.col("s_grp")).select("grp", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    queries = parted.join(sets, F.col("rep") == F.col("t_rep")).select("grp", "part", "rep", "n", "toks")
    nobody = [F.lit(None).cast("long").alias("rep"), F.lit(0).alias("n")]
    stored = groups.where("members IS NOT NULL")
    unions = stored.select("grp", "union").join(shape, F.col("grp") == F.col("s_grp"))
    unions = unions.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *nobody, F.col("union").alias("toks"))
    by_group = lambda x: x.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("rep").asc_nulls_first())
    qualified = cut(by_group(unions.unionByName(queries)).mapInArrow(tidied(_qualify), "grp long, part int, rep long, n int, cells binary"))
    opened = qualified.select(F.col("grp").alias("o_grp"), "part").distinct()
    members = stored.select("grp", "members").join(opened, F.col("grp") == F.col("o_grp")).select("grp", "part", *nobody, F.col("members").alias("cells"))
    return by_group(members.unionByName(qualified)).mapInArrow(tidied(_open), "u long, v long")


def _components(docs: DataFrame, id_col: str, text_col: str, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocks, and (doc_id, n, digest, block, row, component) of each document."""
    packed, local = local_sets(docs, id_col, text_col, extra)
    known = local.where("doc_id IS NOT NULL AND n > 0")
    sets = known.where("toks IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "key", "toks")).alias("x"))
    # Two sets of one id may share their smallest id, and then a vertex; each keeps its row.
    reps = cut(sets.select(F.col("x.doc_id").alias("rep"), "x.n", "x.key", "x.toks"))
    dealt, groups = _groups(reps)
    within = groups.where("u IS NOT NULL").select("u", "v")
    label = components(within)
    across = _between(reps, groups, _asks(reps, dealt, label))
    heads = cut(known.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    twice = known.groupBy(F.col("doc_id").alias("t_id")).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("t_id")
    bridged = known.select("doc_id", F.col("digest").alias("d")).join(twice, F.col("doc_id") == F.col("t_id")).join(heads, F.col("d") == F.col("digest")).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    final = components(label.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(across).union(bridged))
    named = heads.join(final, F.col("rep") == F.col("vertex"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component"))
    out = local.select("doc_id", "n", "digest", "block", "row").join(named, F.col("digest") == F.col("d"), "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return packed, out.select("doc_id", "n", "digest", "block", "row", own.alias("component"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id`` and ``digest`` (equal for equal sets), a row each."""
    _, out = _components(docs, id_col, text_col)
    digest = F.when(F.col("n") > 0, F.hex("digest")).alias("digest")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), digest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked documents the row with the smallest id, with all its columns; of
    rows that share that id the first of each set; rows with a null id and those without words stay.

    Texts do not move with the decisions: each block is told which of its rows stay.
    """
    extra = [c for c in docs.columns if c not in (id_col, text_col)]
    packed, out = _components(docs, id_col, text_col, extra)
    out = cut(out.select("doc_id", "digest", "component", "block", "row"))
    first = out.where("doc_id = component").groupBy("doc_id", "digest").agg(F.min(F.struct("block", "row")).alias("at")).select("at.block", "at.row")
    stay = first.union(out.where("doc_id IS NULL").select("block", "row")).groupBy("block").agg(F.collect_list("row").alias("rows"))
    fields = [T.StructField(id_col, T.LongType()), T.StructField(text_col, T.StringType()), *[docs.schema[c] for c in extra]]

    def run(row: dict, replies: list[dict]):
        import pyarrow as pa

        if not replies:
            return
        blk = B.Block(row)
        pick = sorted(replies[0]["rows"])
        texts = [None if blk.flags[i] else blk.data[blk.starts[i] : blk.starts[i + 1]].decode("utf-8", "replace") for i in pick]
        others = [c.take(pa.array(pick)) for c in blk.extra(row)]
        yield pa.RecordBatch.from_arrays([pa.array([int(blk.ids[i]) if blk.known[i] else None for i in pick], pa.int64()), pa.array(texts, pa.string()), *others], names=[f.name for f in fields])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return B.with_replies(packed, stay, run, ddl).select(*docs.columns)
