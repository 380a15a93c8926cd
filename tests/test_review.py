import json

import pytest

from symscape.operators import code, graph, review
from symscape.plans import maps
from symscape.sources import repository
from tests.sample import FILES

OLD = FILES | {"lib/client.py": "class Session:\n    def fetch_user(self, k: int) -> int:\n        return k\n\ndef gone_soon():\n    return 1\n", "tests/test_client.py": "from lib.client import Session, gone_soon\n\nclass TestClient:\n    def test_a(self):\n        s = Session()\n        s.fetch_user(1)\n        gone_soon()\n"}
NEW = OLD | {
    "lib/client.py": "class Session:\n    def fetch_user(self, k: str) -> int:\n        return k\n",
    "web/users.py": "def fetch_users(k):\n    return k\n\ndef unused_thing():\n    return 2\n",
    "tests/test_more.py": "from lib.client import Session\n\nclass TestMore:\n    def test_b(self):\n        s = Session()\n        s.fetch_user(2)\n",
    "far/new.py": "def glue():\n    price(1)\n    check(2)\n    base_price(3)\n",
}


@pytest.fixture(scope="module")
def two(spark):
    rows = [(s, p, t.encode()) for s, c in (("old", OLD), ("new", NEW)) for p, t in c.items()]
    df = spark.createDataFrame(rows, "snapshot string, path string, raw binary")
    files = graph.written(repository.files_of(df.where("snapshot = 'old'"), "old").union(repository.files_of(df.where("snapshot = 'new'"), "new")), "files")
    facts = graph.written(code.with_facts(repository.symbols(files)), "facts")
    return files, facts, graph.written(code.edges(facts), "calls"), graph.written(repository.tokens(files), "tokens")


def test_findings(two):
    _, facts, calls, tokens = two
    found = review.ordered(review.review(facts, calls, tokens)).collect()
    by = {}
    for f in found:
        by.setdefault(f.check, []).append(f)
    assert [f.subject for f in by["dup"]] == ["fetch_users"] and "Session.fetch_user(int) in lib/client.py" in by["dup"][0].detail
    assert {f.subject for f in by["dead"]} == {"fetch_users", "unused_thing", "glue"}
    assert [(f.subject, f.path) for f in by["orphan"]] == [("TestClient", "tests/test_client.py")] and "gone_soon" in by["orphan"][0].detail
    assert {(f.subject, f.detail.split("exercises ")[1].split(",")[0]) for f in by["recover"]} == {("TestMore", "Session"), ("TestMore", "fetch_user")}
    assert len(by["api"]) == 1 and by["api"][0].detail == "api: +3 (glue, fetch_users, unused_thing) −1 (gone_soon) ~1 (fetch_user: " + by["api"][0].detail.split("~1 (fetch_user: ")[1] and "→" in by["api"][0].detail
    assert [(f.subject, f.path) for f in by["place"]] == [("glue", "far/new.py")]
    assert len({f.id for f in found}) == len(found) and all(f.id.startswith("hr1-") and len(f.id) == 24 for f in found)
    some = review.review(facts, calls, tokens, ("dead",)).collect()
    assert {f.id for f in some} == {f.id for f in by["dead"]}


def test_same_snapshots_have_no_findings(spark, two):
    _, facts, calls, tokens = two
    twice = lambda df: df.where("snapshot = 'old'").unionByName(df.where("snapshot = 'old'").selectExpr("'new' AS snapshot", *[c for c in df.columns if c != "snapshot"]))
    assert review.review(twice(facts), twice(calls), twice(tokens)).count() == 0
    empty = review.report(review.review(twice(facts), twice(calls), twice(tokens)), "HEAD").first()
    assert empty.text == "" and json.loads(empty.data)["count"] == 0


def test_report(two):
    _, facts, calls, tokens = two
    r = review.report(review.dead_arrivals(facts, tokens), "abc").first()
    data = json.loads(r.data)
    assert data["count"] == 3 == r.text.count("\n- ") and data["revision"] == "abc" and data["findings"][0]["check"] == "dead"


def test_map_and_budget(two):
    files, facts, calls, tokens = two
    whole = {r.snapshot: r for r in maps.build(files, facts, calls, tokens).collect()}
    m = whole["new"].text
    for part in ("shop/pricing.py:", "main() ✓ > Customer,", "Engine(I)", "←Fast", "= LIMIT=20", "never_called() ×0", "- _secret", "? test_main", "!IllegalState"):
        assert part in m, part
    assert "sk-" not in m and "✓ ×0" not in m
    assert f"output {whole['new'].tokens} tokens" in m and whole["new"].tokens == (len(m) + 3) // 4
    small = {r.snapshot: r for r in maps.build(files, facts, calls, tokens, budget=330).collect()}["new"]
    assert small.tokens <= 330 < whole["new"].tokens and small.dropped > 0 and not small.over and "Customer" in small.text
    assert {r.fresh for r in maps.is_fresh(files, maps.build(files, facts, calls, tokens)).collect()} == {True}


def test_embedding_a_map():
    once = maps.embedded("# doc\n\ntext\n", "a\nb\n")
    assert maps.embedded(once, "a\nb\n") == once and "text" in once
    again = maps.embedded(once + "after\n", "c")
    assert "a\nb" not in again and again.endswith("after\n") and maps.stripped(once) == "# doc\n\ntext\n"
