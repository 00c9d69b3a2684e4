"""Every stage on a small table with odd rows: what must go goes, the rest and all columns stay."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from beaconry.llm import decontamination, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"span": F.lit("x"), "score": F.lit(None).cast("string"), "anchor": F.lit(1)})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near copies", "repeats", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, labels)
    scores = toxicity.score(docs, model).filter("score >= 0.5").count()
    assert clean.columns == docs.columns and clean.count() == docs.count() - scores

    single = stage["near copies"](spark, clean, SF).cache()
    fps = [(r["doc_id"], np.int64(simhash.fingerprint(r["text"] or ""))) for r in clean.collect()]
    values = np.array([f for _, f in fps])
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 2) + i + 1:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    assert single.columns == docs.columns and single.count() == len(set(group))

    cut = stage["repeats"](spark, single, SF).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    texts = [(r["text"] or "").encode() for r in cut.collect()]
    assert sum(map(len, texts)) <= sum(len((r["text"] or "").encode()) for r in single.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in cut.filter("text is not null").collect())

    left = stage["decontamination"](spark, cut, SF).cache()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontamination.contamination(cut, items).collect()}
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in cut.collect()} - leaks

    packed = stage["packing"](spark, left, SF)
    per_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert len(per_doc) == left.count() and all(r["n"] == r["all"] for r in per_doc)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
