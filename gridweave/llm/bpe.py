"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

Words are merged in a contiguous rank array: the parts of a word and the ranks of adjacent
parts lie side by side in two lists; the smallest rank is looked for by scanning, its right
part is deleted and the two neighbouring ranks are refreshed. Words of more than
``LONG_WORD`` parts take a heap over the same ranks, which gives the same merges.

Defined results: null and empty texts give no tokens and an empty decoded text; null ids pass
through; repeated rows are encoded each; very long texts are encoded whole; extra columns are
ignored by ``encode`` and kept by ``encode_into``; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import tidied

LONG_WORD = 96
CACHE_WORDS = 150_000
#: The vocabulary is shipped to the workers; it is a fixed file, whose size is checked.
MOST_VOCABULARY_BYTES = 32 << 20
_NONE = 1 << 62
_ID_BITS = 20
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A lower-casing byte-level BPE with a word-end suffix."""

    def __init__(self, spec: str | bytes):
        import regex

        spec = json.loads(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])
        #: (left << bits | right) -> (rank << bits | merged id)
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(vocab[a] << _ID_BITS | vocab[b], rank << _ID_BITS | vocab[a + b])
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+").findall
        self.cache: dict[str, tuple[bytes, str]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merges in place, lowest rank first and leftmost of equals."""
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get, mask = self.merges.get, (1 << _ID_BITS) - 1
        ranks = [get(a << _ID_BITS | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = merged = best & mask
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID_BITS | merged, _NONE)
            if i < len(ranks):
                ranks[i] = get(merged << _ID_BITS | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, mask, n = self.merges.get, (1 << _ID_BITS) - 1, len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _ID_BITS | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or get(ids[i] << _ID_BITS | ids[j], _NONE) != r:
                continue
            ids[i], alive[j], after[i] = r & mask, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := get(ids[a] << _ID_BITS | ids[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (x, a))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]

    def word(self, piece: str) -> tuple[bytes, str]:
        """The ids as little-endian int32 bytes, and the decoded text of one word."""
        import array

        raw = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        ids = self.merge(ids)
        made = array.array("i", ids).tobytes(), self.decode(ids)
        if len(piece) <= LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[piece] = made
        return made

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def _segment(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii():
            # Lower-casing is by single characters: a final sigma is not special.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        get, word = self.cache.get, self.word
        return [get(w) or word(w) for w in self.words(text.lower())]

    def encode(self, text: str) -> tuple[bytes, str]:
        """ids as int32 bytes, and the text that they decode to."""
        import array

        found: list[tuple[bytes, str]] = []
        at = 0
        for m in self.cut.finditer(text) if self.special and "<|" in text else ():
            found += self._segment(text[at : m.start()])
            found.append((array.array("i", [self.special[m[0]]]).tobytes(), m[0]))
            at = m.end()
        found += self._segment(text[at:] if at else text)
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


_READY: dict[int, WordBpe] = {}


def _load(shipped) -> WordBpe:
    spec = shipped.value
    key = hash(spec)
    if key not in _READY:
        _READY.clear()
        _READY[key] = WordBpe(spec)
    return _READY[key]


def _ship(spark, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    if len(spec) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} has {len(spec)} bytes; {MOST_VOCABULARY_BYTES} are allowed")
    return spark.sparkContext.broadcast(spec)


def _arrays(texts: list[str | None], bpe: WordBpe):
    import numpy as np
    import pyarrow as pa

    made = [bpe.encode(t) if t else (b"", "") for t in texts]
    offsets = np.zeros(len(made) + 1, np.int32)
    np.cumsum([len(x[0]) >> 2 for x in made], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join([x[0] for x in made]), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([x[1] for x in made], pa.string())


def _slices(batches: Iterator, rows: int = 256) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (array of int) and ``decoded``, the text that the ids decode to."""
    shipped = _ship(docs.sparkSession, tokenizer_path)

    def run(batches):
        import pyarrow as pa

        bpe = _load(shipped)
        for batch in _slices(batches):
            ids, decoded = _arrays(batch.column(1).to_pylist(), bpe)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_into(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and the ids of their texts; an equally named column is replaced."""
    from pyspark.sql import types as T

    shipped = _ship(docs.sparkSession, tokenizer_path)
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        bpe = _load(shipped)
        for batch in _slices(batches):
            ids, _ = _arrays(batch.column(at).to_pylist(), bpe)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the text that the ids decode to; null ids decode to null."""
    from pyspark.sql import types as T

    shipped = _ship(encoded.sparkSession, tokenizer_path)
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)

    def run(batches):
        import pyarrow as pa

        bpe = _load(shipped)
        for batch in _slices(batches):
            texts = [None if x is None else bpe.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(tidied(run), T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
