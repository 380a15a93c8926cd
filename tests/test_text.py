"""Functions on text against Python's own, on texts of any length."""

import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from symscape.functions import text
from symscape.operators import code
from symscape.queries import SQL
from symscape.sources import repository

STRINGS = re.compile(r'"""(?:\\.|(?!""").)*"""|' + r"'''(?:\\.|(?!''').)*'''" + r'|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'", re.S)


def stripped(s):
    return re.sub(r"(?://|#)[^\n]*", " ", STRINGS.sub('"s"', re.sub(r"(?s)/\*.*?\*/", " ", s)))


CASES = ['a = "b" # c', "'''x '' \" y''' z", '"""a " b "" c""" d', r'"\"" e', '"open\nnext" f', r"'it\'s' g", '"a\\\nb" h', "/* * / */ i /* j", '""""""', '"""a""""', "''", "x # 'y'\nz", r'"""\""" k"""', "'a' 'b' '", '"""', ""]


def test_literals_are_those_of_python(spark):
    rows = [(i, s) for i, s in enumerate(CASES)]
    got = spark.createDataFrame(rows, "i int, s string").select("i", text.without_comments_and_strings(F.col("s")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: stripped(s) for i, s in rows}
    with duckdb.connect() as db:
        db.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
        assert dict(db.sql(SQL["strip_strings"]).fetchall()) == {i: stripped(s) for i, s in rows}


@pytest.mark.parametrize("mark", ['"""', "'''", '"', "'"])
@pytest.mark.parametrize("inside", ["x", "\\n", "\\\\", "é"])
def test_literals_of_a_megabyte(spark, mark, inside):
    s = f"a {mark}{inside * 500_000}{mark} b"
    assert spark.createDataFrame([(s,)], "s string").select(text.without_comments_and_strings(F.col("s"))).first()[0] == 'a "s" b'
    unclosed = f"a {mark}{inside * 500_000}"
    assert spark.createDataFrame([(unclosed,)], "s string").select(F.length(text.without_comments_and_strings(F.col("s")))).first()[0] > 100


def test_ids_are_of_canonical_json(spark):
    subjects = ["plain", 'q"uote', "back\\slash", "é", "\U0001f600", "tab\tline\ncr\r", "\x01\x1f\x7f", " ", "", "日本語 ~ !"]
    rows = [(s, None if i % 2 else s) for i, s in enumerate(subjects)]
    df = spark.createDataFrame(rows, "s string, d string")
    got = [r.id for r in df.select(text.finding_id(F.lit("api"), F.lit("fn"), F.col("s"), F.col("s"), F.col("d")).alias("id")).collect()]
    for (s, d), i in zip(rows, got, strict=True):
        raw = json.dumps({"version": 1, "check": "api", "kind": "fn", "subject": s, "path": s, "discriminator": d}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        assert i == "hr1-" + hashlib.sha256(raw.encode()).hexdigest()[:20]


def test_state_is_the_hash_of_paths_and_digests(spark):
    rows = [("b/a.py", b"x"), ("a.py", b""), ("b.py", "é".encode()), ("a/z.py", b"\0\1")]
    files = repository.files_of(spark.createDataFrame(rows, "path string, raw binary"))
    want = hashlib.md5(b"seed" + b"".join(p.encode() + hashlib.md5(c).digest() for p, c in sorted(rows, key=lambda r: r[0].split("/")))).hexdigest()[:12]
    assert code.state_hash(files, seed=b"seed").first().state == want
    assert len(repository.generator_fingerprint()) == 32 and repository.generator_fingerprint() == repository.generator_fingerprint()


def test_excluded_files_are_never_opened(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src [x]").mkdir()
    (tmp_path / "node_modules" / "big.js").write_text("x" * 5000)
    (tmp_path / "image.png").write_bytes(b"x" * 5000)
    (tmp_path / "src [x]" / "a{1}.py").write_text("def f(): pass\n")
    (tmp_path / "b.py").write_text("B = 1\n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r.path: r.text for r in repository.files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"src [x]/a{1}.py": "def f(): pass\n", "b.py": "B = 1\n"}
    assert repository.files(spark, str(tmp_path), langs=["go"]).count() == 0
