import hashlib

import duckdb

from symscape.llm import secrets
from tests.llm import made


def test_keywords_inside_names_and_short_passwords(spark):
    key = "wJalrXUtnFEMIK7MDENG"
    texts = {f"AWS_SECRET_ACCESS_KEY={key}": key, f"client_secret: '{key}'": key, f"secret_key = {key}": key, f"GITHUB_TOKEN={key}": key, "DB_PASSWORD=hunter2Xyz9": "hunter2Xyz9", f"token_{'x' * 9}": None}
    docs = spark.createDataFrame([(i, t, "en", "o", 0) for i, t in enumerate(texts)], made.DOCS)
    got = {(r.doc_id, r.secret) for r in secrets.scan(docs).where("kind = 'assigned'").collect()}
    assert got == {(i, hashlib.md5(v.encode()).hexdigest()) for i, v in enumerate(texts.values()) if v}
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        want = db.sql(secrets.sql())
        assert made.rows(secrets.scan(docs).select(*want.columns)) == made.rows_of(want.fetchall())
