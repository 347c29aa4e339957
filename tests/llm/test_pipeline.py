import random

from pyspark.sql import functions as F

import corpus_pipeline
from sheafwork.llm.common import written
from tests.llm.helpers import CLASHES, documents, sentence


def tables(spark, folder):
    r = random.Random(8)
    passage = "these ten words stand in the benchmark and nowhere else at all my friend".split()
    rows, labels, kinds = [], [], {}
    for i in range(500):
        text, kind = " ".join(sentence(r, 6, 14) for _ in range(r.randint(6, 14))), r.choices(["good", "poor", "toxic", "leak"], [0.75, 0.1, 0.1, 0.05])[0]
        if kind == "poor":
            text = text.upper().replace(" ", "!! ")
        if kind == "toxic":
            text = text.replace(" ", " vileword ", 3)
        if kind == "leak":
            text += " " + " ".join(passage)
        rows.append((i, text))
        kinds[i] = kind
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    copies = {}
    for k, i in enumerate([i for i, kind in kinds.items() if kind == "good"][:20]):
        words = rows[i][1].split()
        if k % 2:
            words[len(words) // 2] = "changed"
        copies[1000 + k] = i
        rows.append((1000 + k, " ".join(words)))
    documents(spark, rows).drop(*CLASHES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), kinds, copies, passage


def test_every_decision_takes_effect(spark, tmp_path):
    folder = str(tmp_path)
    texts, kinds, copies, passage = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test")
        kept.append({r.doc_id for r in docs.collect()})
        if name != "sharding":
            assert docs.columns == names
        if name == "benchmark decontamination":
            cleaned = {r.doc_id: r for r in docs.collect()}
    quality, near, leaks, mix, shards = kept
    assert quality == {i for i in texts if kinds.get(i) != "poor"}
    assert near == quality - set(copies)
    assert leaks == near
    for i in leaks:
        assert cleaned[i].n_chars == len(cleaned[i].text)
        assert cleaned[i].text.strip() == (texts[i].removesuffix(" ".join(passage)).strip() if kinds[i] == "leak" else texts[i])
    assert mix == {i for i in leaks if kinds[i] != "toxic"}
    assert shards == mix
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == shards


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.count() == 0


def test_awkward_rows_pass(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    rows = [(1, None), (1, None), (None, "some text that is here twice over. And again."), (None, ""), (2, "x"), (2, "another text of the same number."), (3, "long words " * 20_000)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() >= 0
        if name != "sharding":
            assert out.columns == docs.columns


def test_last_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.filter(F.col("shard").between(0, 39)).count() == out.count()
