"""The operators that SQL can express, against DuckDB on odd rows and on the driver's table."""

import duckdb
import pytest

from symscape.llm import packing, quality, secrets
from symscape.llm.queries import QUERIES, SQL
from tests.llm import made

CASES = {"op3_packing": packing.pieces, "op7_quality_rules": quality.filtered, "op8_secret_scan": secrets.scan}


def lines_table(seed=9):
    """Hosts of which many documents share lines: menus in all of them, some lines at the limit."""
    import random

    rng, rows = random.Random(seed), []
    for k in range(60):
        body = [made.words(rng, 8) for _ in range(rng.randint(0, 4))]
        menu = ["Home  | About", "", "home | about ", f"page {k % 30}"][: rng.randint(0, 4)]
        rare = ["at the limit"] * (k < 10) + ["above the limit"] * (k < 11)
        rows.append((k, "\n".join([*menu, *body, *rare]), "en", ["a", "a", "b", None][k % 4] if k >= 11 else "a", 0))
    return rows


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("made_rows", [made.corpus(80), made.odd(), lines_table(), []], ids=["corpus", "odd", "lines", "empty"])
def test_small_tables(spark, name, made_rows):
    docs = spark.createDataFrame(made_rows, made.DOCS)
    got = CASES[name](docs)
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        want = db.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert made.rows(got.select(*want.columns)) == made.rows_of(want.fetchall())


@pytest.mark.parametrize("name", SQL)
def test_the_drivers_table(spark, name):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        want = db.sql(SQL[name])
        assert made.rows(QUERIES[name](spark, d).select(*want.columns)) == made.rows_of(want.fetchall())


def test_lines_by_join_when_there_are_many(spark):
    docs = spark.createDataFrame(lines_table(), made.DOCS)
    assert made.rows(quality.filtered(docs, broadcast_lines=0)) == made.rows(quality.filtered(docs))


def test_pieces_put_together_are_the_document(spark):
    docs = spark.createDataFrame(made.odd(), made.DOCS)
    by = {}
    for r in packing.pieces(docs.dropDuplicates(), max_bits=6).collect():
        assert r.length == 2**r.bucket == len(r.text.split(" ")) and r.bucket <= 6
        by.setdefault(r.doc_id, []).append((r.start, r.text))
    for r in docs.dropDuplicates().where("text IS NOT NULL AND doc_id IS NOT NULL").collect():
        tokens = [w for w in r.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        assert " ".join(t for _, t in sorted(by.get(r.doc_id, []))).split() == " ".join(tokens).split()


def test_verdicts(spark):
    key = "'Zz9Yy8Xx7Ww6Vv5Uu4'"
    rows = [(k, f"password={key}", "en", f"owner{k}", 0) for k in range(4)] + [(10, "token: 'Qq1Ww2Ee3Rr4Tt5Yy6'", "en", "o", 0), (11, "secret = 'aaaaaaaaaaaaaaaaaaaa'", "en", "o", 0)]
    got = {r.doc_id: r.verdict for r in secrets.scan(spark.createDataFrame(rows, made.DOCS)).collect()}
    assert got == {0: "example", 1: "example", 2: "example", 3: "example", 10: "live", 11: "placeholder"}


def test_batches_are_as_many_as_their_sequences_fill(spark):
    docs = spark.createDataFrame([(1, "a " * 13, "en", "x", 0), (2, "b " * 9, "en", "x", 0)], made.DOCS)
    got = {r.bucket: (r.sequences, r.batches) for r in packing.batches(packing.pieces(docs, max_bits=3), tokens=8).collect()}
    assert got == {3: (2, 2), 2: (1, 1), 0: (2, 1)}
