"""The pipeline's stages on small tables, each against a plain version of what it decides."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_contracts import brute_jaccard  # noqa: E402

from gridweave.llm import mixing, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def kept_texts(rows):
    """Texts without the bytes that a 50-byte string of an earlier document covers."""
    first = {}
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if r["doc_id"] is not None else 0):
            if first[b[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = b"\1" * 50
        out.append((r["doc_id"], bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return Counter(out)


def check_stages(spark, docs, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    cols = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        source, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        after = rows_of(docs)
        if name != "bpe_encode":
            assert docs.columns == cols
        whole = lambda r: tuple(r[c] for c in cols)
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            model = toxicity.train(source, labels, corpus_pipeline.fold(F.col("doc_id"), 5) != 0) if labels.count() else None
            assert Counter(map(whole, after)) == Counter(whole(r) for r in before if model is None or model.score(r["text"])[0] < 0.5)
        if name == "ngram_jaccard":
            group = {}
            for i, n, c in brute_jaccard([(r["doc_id"], r["text"]) for r in before]):
                group.setdefault(i, []).append((n, c))
            heads = {i for i, x in group.items() if i is None or any(c == i for _, c in x)}
            assert {r["doc_id"] for r in after} == heads and not Counter(map(whole, after)) - Counter(map(whole, before))
            texts = {(r["doc_id"], " ".join((r["text"] or "").encode().lower().decode().split())) for r in before if r["doc_id"] in heads}
            assert {(r["doc_id"], " ".join((r["text"] or "").encode().lower().decode().split())) for r in after} == texts
        if name == "suffix_dedup":
            assert Counter((r["doc_id"], r["text"] or "") for r in after) == kept_texts(before)
            assert sum(r["text"] is None for r in after) == sum(r["text"] is None for r in before)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        if name == "source_mixing":
            want = Counter({r["doc_id"]: 0 for r in before})
            for r in mixing.mix(source, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect():
                want[r["doc_id"]] += r["n_copies"]
            assert Counter(r["doc_id"] for r in after) == +want
            assert set(map(whole, after)) <= set(map(whole, before))
        if name == "bpe_encode":
            tok = Tokenizer.from_file(queries.tokenizer_path())
            assert docs.columns == [*cols, "token_ids"] and len(after) == len(before)
            assert all(r["token_ids"] == tok.encode(r["text"] or "", add_special_tokens=False).ids for r in after)
        done[name] = after
    return done


@needs_tables
def test_stages(spark, tmp_path):
    done = check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path)
    assert len(done["ngram_jaccard"]) < len(done["toxicity"])


@needs_tables
@pytest.mark.parametrize("labelled", [False, True])
def test_awkward_rows(spark, tmp_path, labelled):
    """Null ids and other nulls, empty and very long texts, repeated rows, columns with names that
    the operators use; without labels and with some."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, "no id here at all", "en", "s"), (None, None, None, None), (1, None, "en", "s"), (2, "", "de", None), (3, long, "en", "s"), (4, long + " more", "en", "s"), (5, "short", "en", "s"), (5, "short", "en", "s"), (6, "ß é 漢字 😀 " * 40, None, "s"), (7, "ß é 漢字 😀 " * 40 + "end", None, "s")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "d") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars int, block int, digest string")
    made = [(3, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (2, None, None)] if labelled else []
    spark.createDataFrame(made, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (tmp_path / "out").mkdir()
    check_stages(spark, docs, str(tmp_path), tmp_path / "out")


@needs_tables
def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    (tmp_path / "out").mkdir()
    assert check_stages(spark, docs, SF, tmp_path / "out")["bpe_encode"] == []


@needs_tables
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-1] == "token_ids" and out.where("token_ids IS NULL").isEmpty()
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{SF}/documents.parquet").count()
