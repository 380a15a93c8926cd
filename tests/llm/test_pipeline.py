import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symscape.llm import bpe, lm, minhash, packing, pii, quality, secrets, toxicity
from tests.llm import made
from tests.llm.test_pii import TEXTS
from tests.llm.test_toxicity import sentences


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = made.odd()
    rows += [(3000 + i, t, "en", "web", len(t)) for i, t in enumerate(sentences(60, True, 1) + sentences(150, False, 2))]
    rows += [(4000 + i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, made.DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(3000 + i, 1, int(i < 60)) for i in range(0, 210, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_are_the_operators_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "pii", "packing"]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    alone = {"toxicity": lambda d: toxicity.without_toxic(d, model), "quality_rules": quality.filtered, "minhash_near_dedup": minhash.deduplicated, "pii": pii.redacted, "packing": packing.pieces}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        assert made.rows(got) == made.rows(alone[name](docs))
        if k < 4:
            assert got.columns == columns
            got.write.mode("overwrite").parquet(f"{sf}/at-{k}")
            docs = spark.read.parquet(f"{sf}/at-{k}")
            kept[name] = {r.doc_id for r in docs.collect()}
    assert not any(3000 <= (i or 0) < 3060 for i in kept["toxicity"]) and all(i in kept["toxicity"] for i in range(3060, 3210))
    assert made.rows(corpus_pipeline.run(spark, sf)) == made.rows(got)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", ["quality", "minhash", "pii", "packing", "secrets", "bpe", "toxicity", "lm"])
def test_columns_of_clashing_names(spark, name):
    plain = spark.createDataFrame(made.corpus(40), made.DOCS)
    more = plain.select("*", *[F.lit(f"c{i}").alias(c) for i, c in enumerate(made.CLASH)])
    model = toxicity.fit([(t, 1) for t in sentences(60, True, 1)] + [(t, 0) for t in sentences(150, False, 2)])
    run = {"quality": quality.filtered, "minhash": minhash.deduplicated, "pii": pii.redacted, "packing": packing.pieces, "secrets": secrets.scan, "bpe": bpe.encoded, "toxicity": lambda d: toxicity.without_toxic(d, model), "lm": lm.word_counts}[name]
    a, b = run(plain), run(more)
    assert made.rows(b.select(*a.columns)) == made.rows(a)
    if b.columns != a.columns:
        assert b.columns == more.columns
        assert all(r[c] == f"c{i}" for r in b.collect() for i, c in enumerate(made.CLASH))
