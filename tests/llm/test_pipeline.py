"""The pipeline's rows against a plain version of what its stages decide."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from prefscale.llm import pieces, quality
from prefscale.llm.mixing import mix
from tests.compare import DATA
from tests.llm.cases import documents, empty
from tests.llm.test_dedup import brute_components


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA).cache()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.with_score(docs, model).where("score >= 0.3").collect()}
    once = stages["exact dedup"](spark, good, DATA).cache()
    first = {}
    for r in good.collect():
        key = re.sub(r"[ \t-\r]+", " ", r["text"] or "")
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(first.values())
    near = stages["n-gram Jaccard join"](spark, once, DATA).cache()
    parts = brute_components([(r["doc_id"], r["text"]) for r in once.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {c for _, c in parts.values()}
    mixed = stages["mixing sources"](spark, near, DATA).cache()
    want = Counter({r["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in mix(near).collect() if r["size"]})
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    for df in (good, once, near, mixed):
        assert df.columns == docs.columns
    out = stages["SentencePiece encoding"](spark, mixed, DATA).collect()
    assert len(out) == mixed.count()
    codec = pieces.PieceCodec.load()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(codec.decode(r["pieces"]) == text[r["doc_id"]] for r in out)
    assert Counter((r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter((r["doc_id"], r["n_pieces"]) for r in out)


def test_awkward_rows_and_empty_tables(spark):
    for docs in (documents(spark).withColumn("lang", F.lit("en")), empty(spark).withColumn("lang", F.lit("en"))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            docs = out.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
