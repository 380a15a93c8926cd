import hashlib

import pytest

from symscape.operators import code, graph
from symscape.sources import repository
from tests.sample import FILES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    files = graph.written(repository.files(spark, str(root)), "files")
    facts = graph.written(code.with_facts(repository.symbols(files)), "facts")
    return files, facts, graph.written(code.edges(facts), "calls"), repository.tokens(files)


def by_name(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.file, r.container, r.name), r)
    return out


def test_scan_leaves_out_denied_and_unknown_files(corpus):
    assert {r.path for r in corpus[0].collect()} == set(FILES) - {"node_modules/x.js", "README.md"}


def test_state_hash_is_that_of_all_bytes_in_order(corpus):
    state = hashlib.md5()
    for path in sorted(set(FILES) - {"node_modules/x.js", "README.md"}, key=lambda p: p.split("/")):
        state.update(path.encode() + hashlib.md5(FILES[path].encode()).digest())
    assert code.state_hash(corpus[0]).first().state == state.hexdigest()[:12]


def test_python(corpus):
    rows = by_name(corpus[1])
    m = "shop/models.py"
    assert rows[m, None, "Colour"].kind == "enum" and rows[m, None, "Colour"].params == ["RED", "BLUE"]
    assert rows[m, None, "Order"].kind == "record" and rows[m, None, "Order"].params == ["int", "Customer"] and rows[m, None, "Order"].fields == ["id", "owner"]
    assert rows[m, None, "LIMIT"].signature == "LIMIT=20" and rows[m, None, "API_KEY"].signature == "API_KEY" and rows[m, None, "NAMES"].signature == "NAMES"
    total = rows[m, "Customer", "total"]
    assert (total.params, total.returns, total.calls, total.size) == (["list[Order]"], "int", ["sum", "price"], 2)
    assert rows[m, "Customer", "_secret"].visibility == "priv" and rows[m, "Customer", "_secret"].raises == ["ValueError"]
    assert rows["shop/pricing.py", None, "price"].bindings == {"order": "Order", "rate": "float"}
    assert rows["shop/app.py", None, "main"].bindings == {"c": "Customer"}


def test_other_languages(corpus):
    rows = by_name(corpus[1])
    assert rows["java/Engine.java", None, "Engine"].kind == "interface" and rows["java/Engine.java", "Engine", "run"].raises == ["IOException"]
    fast = rows["java/Fast.java", None, "Fast"]
    assert fast.supers == ["Engine"] and ("java/Fast.java", None, "Hidden") not in rows
    run = rows["java/Fast.java", "Fast", "run"]
    assert (run.params, run.returns, run.raises, run.visibility, run.kind) == (["int"], "int", ["IllegalStateException"], "pub", "method") and "helper.help" in run.calls
    assert rows["java/Fast.java", "Fast", "hide"].visibility == "priv" and rows["java/Fast.java", "Fast", "Fast"].kind == "ctor"
    assert rows["java/Fast.java", "Fast", "MAX"].signature == "MAX=7"
    helper = rows["java/Helper.java", None, "Helper"]
    assert helper.kind == "record" and helper.params == ["int", "Map<String,Integer>"] and rows["java/Helper.java", "Helper", "help"].params == ["int", "Map<String,Integer>"]
    assert rows["web/api.ts", None, "Api"].kind == "interface" and rows["web/api.ts", "Client", "get"].calls == ["load"]
    assert rows["web/api.ts", None, "load"].visibility == "pub" and rows["web/api.ts", None, "fetchIt"].visibility == "priv" and rows["web/api.ts", None, "Id"].kind == "type"
    assert rows["go/main.go", "Store", "Get"].calls == ["helper"] and rows["go/main.go", None, "helper"].visibility == "priv"
    assert rows["rust/lib.rs", "P", "area"].params == ["i32"] and rows["rust/lib.rs", "P", "area"].visibility == "pub" and rows["rust/lib.rs", None, "twice"].visibility == "priv"
    assert rows["Makefile", "Makefile", "all"].calls == ["build"] and rows["Makefile", "Makefile", "all"].param_names == ["CC"] and rows["Makefile", "Makefile", "build"].visibility == "priv"
    assert rows["chart/Chart.yaml", None, "shop"].kind == "class" and {n for f, _, n in rows if f == "style.css"} == {".box", "#top", "--gap"}
    assert rows["run.sh", "run.sh", "go_on"].calls == ["stop_it"] and rows["run.sh", None, "NAME"].signature == "NAME=x"


def named(facts, calls):
    name = {r.sym: r.name for r in facts.collect()}
    out = {}
    for r in calls.orderBy("caller", "pos").collect():
        out.setdefault(name[r.caller], []).append(name[r.target])
    return out


def test_calls(corpus):
    _, facts, calls, _ = corpus
    got = named(facts, calls)
    assert got["main"] == ["Customer", "total", "price", "base_price"]
    assert got["total"] == ["price"] and got["price"] == ["check", "base_price"] and got["test_main"] == ["main"]
    assert got["Get"] == ["helper"] and got["area"] == ["twice"] and got["all"] == ["build"] and got["load"] == ["fetchIt"] and got["hide"] == ["run"]
    shown = named(facts, code.displayed_edges(facts, calls))
    assert shown["main"] == ["Customer", "total"] and shown["price"] == ["check"]


def test_marks(corpus):
    _, facts, calls, tokens = corpus
    name = {r.sym: r.name for r in facts.collect()}
    assert {name[r.sym] for r in code.tested(facts, calls).collect()} == {"main"}
    zero = {r.name for r in code.zero_usage(facts, tokens).collect()}
    assert "never_called" in zero and not zero & {"price", "main", "check", "all"}
    assert {(r.name, tuple(r.implementors)) for r in code.implementors(facts).collect()} == {("Engine", ("Fast",)), ("Api", ("Client",))}
    assert {name[r.sym]: r.files for r in code.fan_in(facts, calls).collect()} == {"Customer": 1, "total": 1, "price": 2, "base_price": 1, "main": 1}
    cold = {name[r.sym] for r in code.cold_types(facts, calls).collect()}
    assert "Customer" not in cold and "Colour" in cold
    assert {r.name: r.description for r in code.described(facts).collect()}["run"] in ("Fast.run", "Engine.run")


def test_resolution_keeps_to_the_owner(spark):
    """Two types of one name lend each other nothing; an ambiguous bare name means nothing."""
    base = {"snapshot": "new", "ordinal": 0, "line": 1, "signature": "", "params": [], "param_names": [], "returns": None, "visibility": "pub", "container": None, "lang": "python", "fields": [], "calls": [], "supers": [], "permits": [], "raises": [], "bindings": {}, "decorators": [], "size": 1}
    rows = [
        {"name": "Client", "kind": "class", "file": "a/x.py"}, {"name": "send", "kind": "method", "file": "a/x.py", "container": "Client"}, {"name": "Client", "kind": "class", "file": "b/y.py"},
        {"name": "go", "kind": "fn", "file": "c/z.py", "calls": ["c.send", "twice", "self.send", "os.path"], "bindings": {"c": "Client"}}, {"name": "here", "kind": "method", "file": "b/y.py", "container": "Client", "calls": ["self.send"]},
        {"name": "near", "kind": "fn", "file": "a/w.py", "calls": ["c.send"], "bindings": {"c": "Client[int]"}}, {"name": "twice", "kind": "fn", "file": "a/x.py"}, {"name": "twice", "kind": "fn", "file": "b/y.py"}, {"name": "own", "kind": "fn", "file": "b/y.py", "calls": ["twice", "x.twice", "twice"]},
    ]
    from symscape.schemas import SYMBOLS

    columns = [f.split(" ")[0] for f in SYMBOLS.split(", ")]
    df = spark.createDataFrame([tuple((base | r | {"sym": f"{r['file']}#{i}", "ordinal": i})[c] for c in columns) for i, r in enumerate(rows)], SYMBOLS)
    calls = {(r.caller, r.target) for r in code.edges(code.with_facts(df)).collect()}
    assert calls == {("a/w.py#5", "a/x.py#1"), ("b/y.py#8", "b/y.py#7"), ("b/y.py#8", "a/x.py#6")}
