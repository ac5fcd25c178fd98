"""The pipeline's stages: each one's decisions are in what the next one reads."""

from __future__ import annotations

import corpus_pipeline
from tillwise.llm import decontamination, repetition, secrets, simhash
from tillwise.llm.packing import tokenizer_file

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontaminate", "mask_secrets", "pack"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "pack":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = ids(docs)
        if name == "quality_rules":
            assert kept[name] == ids(repetition.measure(before).where("kept"))
        if name == "near_duplicates":
            assert kept[name] == ids(simhash.near_duplicates(before).where("doc_id = component_id"))
        if name == "decontaminate":
            leaked = {r.doc_id for r in decontamination.leaks(before, bench).collect()}
            assert leaked and kept[name] == [i for i in kept["near_duplicates"] if i not in leaked]
        if name == "mask_secrets":
            assert kept[name] == kept["decontaminate"]
            assert secrets.scan(docs).where("spans != ''").count() == 0 < secrets.scan(before).where("spans != ''").count()
            masked = {r.doc_id: r.text for r in docs.collect()}
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(tokenizer_file())
    total = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert set(total) == set(masked)
    assert all(total[i] == len(real.encode(t, add_special_tokens=False).ids) + 1 for i, t in list(masked.items())[:50])


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 400
    sums = rows.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sums) <= 2048


def test_odd_documents(spark):
    plain = " ".join(f"word{i}" for i in range(70))
    rows = [(1, plain + " password=abcdef99", "en", "s", 10, "x"), (1, plain + " password=abcdef99", "en", "s", 10, "x"),
            (None, plain + " more", None, None, None, "y"), (2, None, "de", "s", 0, None), (3, "", "de", "s", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0 if name != "pack" else True
    assert docs.where("doc_id = 1").count() >= 1
