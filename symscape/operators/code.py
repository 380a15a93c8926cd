"""The code relation: what each declaration is, which declarations its calls mean, and what follows from that.

symbols has the schema SYMBOLS; all keys begin with snapshot, so that several versions of a corpus go through one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symscape.functions import paths, text
from symscape.operators import graph
from symscape.schemas import CALLABLE_KINDS, TYPE_KINDS

_CASES = "test parameterizedtest repeatedtest testfactory testtemplate fact theory testcase testcasesource testmethod datatestmethod".split()
_SUITES = "nested suite testclass testfixture testsuite".split()
_ROUTES = "GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping GET POST PUT DELETE PATCH Path Controller Get Post Put Delete Patch HttpGet HttpPost HttpPut HttpDelete HttpPatch Route route get post put delete patch".split()
_ENTRIES = sorted(({*_ROUTES} - {"Path"}) | set("Component EventListener KafkaListener Scheduled fixture".split()))
_VERBS = tuple("delete get patch post put route".split())
_MARKERS = "Transactional Scheduled KafkaListener EventListener Injectable property staticmethod classmethod abstractmethod cached_property fixture memo forwardRef ApiController".split()
#: Languages in which a bare call may mean a member of the caller's own type.
OWN_MEMBERS = "java typescript javascript tsx vue svelte csharp kotlin cpp rust make go bash".split()


def bases() -> Column:
    """Names of the decorators: without arguments and qualifiers, in lower case, without the ending Attribute."""
    return F.transform("decorators", lambda d: F.regexp_replace(F.lower(F.element_at(F.split(F.element_at(F.split(d, r"\("), 1), r"\."), -1)), "attribute$", ""))


def decorator_notes() -> Column:
    """The decorators that the map shows, without arguments of markers."""
    tail = lambda d: F.element_at(F.split(F.element_at(F.split(d, r"\("), 1), r"\."), -1)
    return F.transform(F.filter("decorators", lambda d: tail(d).isin(*_MARKERS, *_ROUTES)), lambda d: F.when(tail(d).isin(*_MARKERS), tail(d)).otherwise(d))


def with_facts(symbols: DataFrame) -> DataFrame:
    """symbols with dir, test_path, test_case, suite, prod, invoked (by a framework), order: columns that later steps filter on, computed once."""
    case = F.exists(bases(), lambda b: b.isin(*_CASES))
    named = F.col("name").rlike("^test(_|[A-Z0-9]|$)")
    top = (F.col("kind") == "fn") & F.col("container").isNull()
    go = (F.col("lang") == "go") & F.col("name").rlike("^(Test|Benchmark|Fuzz|Example)($|[^a-z])")
    member = (F.col("kind") == "method") & (F.coalesce("container", F.lit("")) != "")
    on_test = paths.test_path(F.col("file"))
    test_case = (top & (case | on_test & (named | go))) | (member & (case | on_test & named))
    suite = (F.col("kind") == "class") & on_test & (paths.test_name(F.col("name")) | F.exists(bases(), lambda b: b.isin(*_SUITES)) | F.exists("supers", lambda s: F.lower(text.base_type(s)).rlike("(testcase|specification|funsuite|freespec|wordspec|behaviorspec)$")))
    entry = F.exists("decorators", lambda d: F.element_at(F.split(F.trim(F.element_at(F.split(d, r"\("), 1)), r"\."), -1).isin(*_ENTRIES) & (F.element_at(F.split(d, r"\("), 1).contains(".") | ~F.element_at(F.split(F.trim(F.element_at(F.split(d, r"\("), 1)), r"\."), -1).isin(*_VERBS) | (F.col("lang") == "rust")))
    invoked = ((F.col("lang") == "make") & ((F.col("kind") == "class") | (F.col("kind") == "method") & (F.col("visibility") == "pub"))) | ((F.col("lang") == "typescript") & (F.col("kind") == "method") & F.col("name").rlike("^ng[A-Z]")) | entry
    return symbols.withColumns({"dir": paths.directory(F.col("file")), "test_path": on_test, "test_case": test_case, "suite": suite, "prod": (F.col("lang") == "make") | ~(on_test | test_case), "invoked": invoked, "order": F.struct(paths.parts(F.col("file")).alias("p"), F.col("ordinal").alias("o"))})


def _key(*parts: Column | str) -> Column:
    """A lookup key; null if any part is."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.when(~F.greatest(*[c.isNull() for c in cols]) if len(cols) > 1 else cols[0].isNotNull(), F.concat_ws("\x1f", *cols))


def lookup_index(facts: DataFrame) -> DataFrame:
    """(key, n, sym): all the indexes that calls are looked up in as one table. n counts declarations; sym is the only one, or, among methods
    of one shape, the most complete (the first of equals)."""
    lit = F.lit
    target = facts.where(F.col("prod") & F.col("kind").isin(*TYPE_KINDS, *CALLABLE_KINDS))
    is_type, owned = F.col("kind").isin(*TYPE_KINDS), F.coalesce("container", lit("")) != ""
    selector = F.regexp_extract(F.array_join(F.filter("decorators", lambda d: d.startswith("Component(")), " "), r"selector\s*:\s*['\"]([^'\"]+)['\"]", 1)
    keys = F.when(is_type, F.array(_key(lit("tf"), "snapshot", "lang", "file", "name"), _key(lit("td"), "snapshot", "lang", "dir", "name"), _key(lit("tg"), "snapshot", "lang", "name"), F.when((F.col("lang") == "typescript") & (selector != ""), _key(lit("se"), "snapshot", selector))))
    keys = keys.when(owned, F.array(_key(lit("mf"), "snapshot", "lang", "file", "container", "name"), _key(lit("md"), "snapshot", "lang", "dir", "container", "name"), _key(lit("mg"), "snapshot", "lang", "container", "name"), _key(lit("ln"), "snapshot", "lang", "name")))
    keys = keys.otherwise(F.array(_key(lit("ft"), "snapshot", "lang", "file", "name"), _key(lit("mt"), "snapshot", "lang", paths.stem(F.col("file")), "name"), _key(lit("ln"), "snapshot", "lang", "name")))
    shape = F.xxhash64("kind", "signature", "params", F.coalesce("returns", lit("\0")))
    worse = F.struct(-F.size("calls"), -F.size("raises"), -F.col("size"), -F.size("bindings"), -F.size("decorators"), "order")
    rows = target.select("sym", shape.alias("shape"), worse.alias("worse"), F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    index = rows.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("shape").alias("shapes"), F.min_by("sym", "worse").alias("sym"))
    method = F.substring("key", 1, 1) == "m"
    alone = F.when(method & (F.substring("key", 2, 1) != "t"), F.col("shapes") == 1).otherwise(F.col("n") == 1)
    return index.select("key", "n", F.when(alone, F.col("sym")).alias("sym"))


def edges(facts: DataFrame) -> DataFrame:
    """(snapshot, caller, pos, target): what each declaration's calls mean within the project, in order and once each; what is outside or ambiguous is left out.

    Every call makes the few keys that it may be looked up by; one join with the index answers them all, one aggregation per call picks the answer by priority."""
    index = lookup_index(facts)
    tags = facts.where("prod AND lang = 'html' AND name LIKE '%-%'").groupBy("snapshot", F.col("file").alias("template")).agg(F.collect_list("name").alias("tags"))
    url = F.regexp_extract(F.array_join(F.filter("decorators", lambda d: d.startswith("Component(")), " "), r"templateUrl\s*:\s*['\"](?:\./)?([^'\"]+)['\"]", 1)
    own = F.col("kind").isin(*TYPE_KINDS) & (url != "")
    near = F.when(F.col("dir") == ".", url).otherwise(F.concat("dir", F.lit("/"), url))
    near = F.regexp_replace(near, r"[^/]+/\.\./", "")
    callers = facts.withColumn("template", F.when(own, near)).join(tags, ["snapshot", "template"], "left")
    raw = callers.select("snapshot", F.col("sym").alias("caller"), "lang", "file", "dir", F.when(F.col("container") != "", F.col("container")).alias("container"), "bindings", F.posexplode(F.concat("calls", F.coalesce("tags", F.array().cast("array<string>")))).alias("pos", "raw"))
    dotted = F.col("raw").contains(".")
    receiver = F.when(dotted, F.regexp_extract("raw", r"(?s)^(.*)\.[^.]*$", 1))
    raw = raw.withColumns({"receiver": receiver, "name": F.when(dotted, F.element_at(F.split("raw", r"\."), -1)).otherwise(F.col("raw"))})
    own_receiver = (F.col("receiver") == F.col("container")) | F.col("receiver").isin("self", "cls", "this") & F.col("container").isNotNull()
    bound = F.try_element_at("bindings", F.col("receiver"))
    last = F.element_at(F.split("receiver", r"\."), -1)
    how = F.when(F.col("raw").contains("-") & F.col("lang").isin("typescript", "html"), "selector").when(F.col("receiver").isNull(), "bare").when(F.coalesce(own_receiver, F.lit(False)), "own").when(bound.isNotNull(), "bound").otherwise("named")
    owner = F.when(F.col("receiver").isNull(), F.when(F.col("lang").isin(*OWN_MEMBERS), F.col("container"))).when(F.coalesce(own_receiver, F.lit(False)), F.col("container")).when(bound.isNotNull(), text.base_type(bound)).otherwise(last)
    raw = raw.withColumns({"how": how, "owner": owner, "last": last})
    lit, sel = F.lit, F.when(F.col("how") == "selector", F.col("raw"))
    bare = F.when(F.col("how") == "bare", F.col("name"))
    slots = {
        "se": _key(lit("se"), "snapshot", sel),
        "bf": _key(lit("tf"), "snapshot", "lang", "file", bare), "bd": _key(lit("td"), "snapshot", "lang", "dir", bare), "bg": _key(lit("tg"), "snapshot", "lang", bare),
        "of": _key(lit("tf"), "snapshot", "lang", "file", "owner"), "od": _key(lit("td"), "snapshot", "lang", "dir", "owner"), "og": _key(lit("tg"), "snapshot", "lang", "owner"),
        "mf": _key(lit("mf"), "snapshot", "lang", "file", "owner", "name"), "md": _key(lit("md"), "snapshot", "lang", "dir", "owner", "name"), "mg": _key(lit("mg"), "snapshot", "lang", "owner", "name"),
        "ft": _key(lit("ft"), "snapshot", "lang", "file", bare), "ln": _key(lit("ln"), "snapshot", "lang", bare),
        "mt": _key(lit("mt"), "snapshot", "lang", F.when(F.col("how") == "named", F.col("last")), "name"),
    }
    asked = raw.select("snapshot", "caller", "pos", "how", F.explode(F.filter(F.array(*[F.struct(lit(s).alias("slot"), k.alias("key")) for s, k in slots.items()]), lambda x: x["key"].isNotNull())).alias("ask"))
    got = asked.select("snapshot", "caller", "pos", "how", "ask.slot", "ask.key").join(index, "key")
    sym = lambda s: F.max(F.when(F.col("slot") == s, F.col("sym"))).alias(s)
    n = lambda s: F.coalesce(F.max(F.when(F.col("slot") == s, F.col("n"))), lit(0)).alias("n_" + s)
    per = got.groupBy("snapshot", "caller", "pos", "how").agg(*[sym(s) for s in slots], n("of"), n("od"), n("og"))
    method = F.when(F.col("mf").isNotNull(), F.col("mf")).when(F.col("n_od") == 1, F.col("md")).when((F.col("n_of") > 0) | (F.col("n_og") != 1), lit(None)).otherwise(F.col("mg"))
    known = (F.col("n_of") == 1) | (F.col("n_od") == 1) | (F.col("n_og") == 1)
    target = F.when(F.col("how") == "selector", F.col("se")).when(F.col("how") == "bare", F.coalesce("bf", "bd", "bg", method, "ft", "ln")).when(F.col("how").isin("own", "bound"), method).when(known, method).otherwise(F.col("mt"))
    found = per.select("snapshot", "caller", "pos", target.alias("target")).where("target IS NOT NULL")
    identity = facts.select("snapshot", F.col("sym").alias("target"), F.struct("file", "lang", F.coalesce("container", lit("")).alias("container"), "name", "line").alias("identity"))
    first = found.join(identity, ["snapshot", "target"]).groupBy("snapshot", "caller", "identity").agg(F.min_by(F.struct("pos", "target"), "pos").alias("e"))
    return first.select("snapshot", "caller", "e.pos", "e.target")


def displayed_edges(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """edges without those that another edge of the same public caller implies."""
    public = facts.where(F.col("prod") & F.col("kind").isin(*CALLABLE_KINDS) & (F.col("visibility") == "pub"))
    ids = facts.select("snapshot", "sym", "kind")
    to_callables = calls.join(ids.where(F.col("kind").isin(*CALLABLE_KINDS)).select("snapshot", F.col("sym").alias("target")), ["snapshot", "target"], "left_semi")
    node = lambda c: F.concat_ws("\x1f", "snapshot", c)
    reach = graph.closure(to_callables.select(node("caller").alias("src"), node("target").alias("dst")), public.select(node("sym").alias("node")))
    shown = calls.select("*", node("caller").alias("src"), node("target").alias("dst"))
    mine = shown.join(facts.where("prod AND visibility = 'pub'").select("snapshot", F.col("sym").alias("caller")), ["snapshot", "caller"], "left_semi")
    rest = shown.join(facts.where("prod AND visibility = 'pub'").select("snapshot", F.col("sym").alias("caller")), ["snapshot", "caller"], "left_anti")
    return graph.transitive_reduction(mine, reach).select("snapshot", "caller", "pos", "target").unionByName(rest.select("snapshot", "caller", "pos", "target"))


def tested(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(snapshot, sym): declarations that a test calls."""
    tests = facts.where((F.col("lang") != "make") & (F.col("test_path") | F.col("test_case"))).select("snapshot", F.col("sym").alias("caller"))
    return calls.join(tests, ["snapshot", "caller"], "left_semi").select("snapshot", F.col("target").alias("sym")).distinct()


def zero_usage(facts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(snapshot, name): names of functions, methods and classes that occur no more often than they are declared."""
    declared = facts.where("kind <> 'reexport'").groupBy("snapshot", "name").agg(F.count("*").alias("declared"))
    used = tokens.groupBy("snapshot", F.col("token").alias("name")).agg(F.sum("n").alias("used"))
    asked = facts.where("kind IN ('fn', 'method', 'class') AND lang NOT IN ('html', 'helm') AND NOT (name LIKE '\\_\\_%' AND name LIKE '%\\_\\_') AND NOT invoked").select("snapshot", "name").distinct()
    return asked.join(declared, ["snapshot", "name"]).join(used, ["snapshot", "name"], "left").where("coalesce(used, 0) <= declared").select("snapshot", "name")


def fan_in(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(snapshot, sym, files): from how many other files each target is called."""
    file = lambda c: facts.select("snapshot", F.col("sym").alias(c), F.col("file").alias(f"{c}_file"))
    both = calls.join(file("caller"), ["snapshot", "caller"]).join(file("target"), ["snapshot", "target"])
    return both.where("caller_file <> target_file").groupBy("snapshot", F.col("target").alias("sym")).agg(F.countDistinct("caller_file").alias("files"))


def implementors(facts: DataFrame) -> DataFrame:
    """(snapshot, lang, name, implementors): distinct names of the types that extend each interface, in order of declaration."""
    subs = facts.where(F.col("prod") & F.col("kind").isin(*TYPE_KINDS)).select("snapshot", "lang", F.explode("supers").alias("super"), F.col("name").alias("sub"), "order")
    bases = facts.where("prod AND kind = 'interface'").select("snapshot", "lang", F.col("name").alias("super")).distinct()
    first = subs.join(bases, ["snapshot", "lang", "super"]).groupBy("snapshot", "lang", "super", "sub").agg(F.min("order").alias("order"))
    return first.groupBy("snapshot", "lang", F.col("super").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "sub"))), lambda x: x["sub"]).alias("implementors"))


def cold_types(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(snapshot, sym): main types that nothing outside them calls, them or their members."""
    owner = facts.select("snapshot", "sym", F.struct("file", "lang", F.when(F.col("kind").isin(*TYPE_KINDS), F.col("name")).otherwise(F.coalesce("container", F.lit(""))).alias("type")).alias("owner"))
    to = calls.join(owner.select("snapshot", F.col("sym").alias("target"), F.col("owner").alias("to")), ["snapshot", "target"]).join(owner.select("snapshot", F.col("sym").alias("caller"), F.col("owner").alias("by")), ["snapshot", "caller"])
    warm = to.where("to <> by").select("snapshot", F.col("to").alias("owner")).distinct()
    main = facts.where(F.col("prod") & F.col("kind").isin(*TYPE_KINDS) & F.col("container").isNull() & (paths.role(F.col("file")) == "main")).select("snapshot", "sym").join(owner, ["snapshot", "sym"])
    return main.join(warm, ["snapshot", "owner"], "left_anti").select("snapshot", "sym")


def merged_members(facts: DataFrame) -> DataFrame:
    """One row for declarations and definitions of one member: the most complete row, private if any is, calls, raises and decorators of all in order, the largest size."""
    keys = ["snapshot", "lang", "file", "container", "kind", "name", "signature", "params", "returns"]
    members = facts.where("prod AND kind IN ('method', 'ctor')")
    every = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("order", c))), lambda x: x[c]))).alias(c)
    best = F.min_by("sym", F.struct(-F.size("calls"), -F.size("raises"), -F.col("size"), "order")).alias("sym")
    return members.groupBy(*keys).agg(best, F.when(F.bool_or(F.col("visibility") == "priv"), "priv").otherwise("pub").alias("visibility"), every("calls"), every("raises"), every("decorators"), F.max("size").alias("size"), F.count("*").alias("rows"))


def described(facts: DataFrame) -> DataFrame:
    """facts with the shortest description of each target that no other shares."""
    targets = facts.where(F.col("prod") & F.col("kind").isin(*TYPE_KINDS, *CALLABLE_KINDS))
    full = F.concat_ws(".", "container", "name")
    stem_full = F.concat_ws(".", paths.stem(F.col("file")), full)
    logical = targets.select("snapshot", "lang", "file", F.coalesce("container", F.lit("")).alias("owner"), "name", full.alias("full"), stem_full.alias("stem_full")).distinct()
    for k in ("name", "full", "stem_full"):
        logical = logical.withColumn(f"n_{k}", F.count("*").over(Window.partitionBy("snapshot", k)))
    text_of = F.when(F.col("n_name") == 1, F.col("name")).when(F.col("n_full") == 1, F.col("full")).when(F.col("n_stem_full") == 1, F.col("stem_full")).otherwise(F.concat("file", F.lit(":"), "full"))
    chosen = logical.select("snapshot", "lang", "file", F.col("owner"), "name", text_of.alias("description"))
    return targets.withColumn("owner", F.coalesce("container", F.lit(""))).join(chosen, ["snapshot", "lang", "file", "owner", "name"]).drop("owner")


def state_hash(source: DataFrame, digits: int = 12, seed: bytes = b"") -> DataFrame:
    """(snapshot, state): a hash of all paths and contents, in order of the paths' parts. seed: what else the state depends on, such as the generator's own fingerprint. Files are hashed before they are gathered."""
    each = F.concat(F.hex(F.encode("path", "UTF-8")), F.md5("raw"))
    rows = F.sort_array(F.collect_list(F.struct(paths.parts(F.col("path")).alias("p"), each.alias("h"))))
    whole = F.unhex(F.concat(F.lit(seed.hex()), F.array_join(F.transform("r", lambda x: x["h"]), "")))
    return source.groupBy("snapshot").agg(rows.alias("r")).select("snapshot", F.substring(F.md5(whole), 1, digits).alias("state"))
