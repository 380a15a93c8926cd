"""The scanners bound to made sources: a module and a makefile for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.queries import query, table
from symscape.sources import repository, samples


def _files(spark, d, path: str, template: str) -> DataFrame:
    """A file for each part; § in the path and in the template stands for its key."""
    key = F.col("p_partkey").cast("string")
    filled = lambda x: F.replace(F.lit(x), F.lit("§"), key)
    made = table(spark, d, "part").select(filled(path).alias("path"), filled(template).cast("binary").alias("raw"))
    return repository.symbols(repository.files_of(made))


_WEB = "export const routes§ = [{ path: 'p§', component: C§ }, { path: \"x\" }];\nexport const W§ = React.memo((p: P§) => use§(p));\nconst L§: React.FC<Q§> = ({ a }) => draw§(a);\nexport const api§ = {\n  get(id: string): R§ { return find§(id); },\n  n: 1,\n};\n"


@query("""SELECT replace(name, '§', k) AS name, kind, replace(signature, '§', k) AS signature, visibility, replace(container, '§', k) AS container, replace(calls, '§', k) AS calls, decorators FROM (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part), (VALUES
('routes§', 'const', 'routes§=/p§→C§,/x', 'pub', NULL, '', ''), ('W§', 'fn', 'W§(P§)', 'pub', NULL, 'use§', 'memo'), ('L§', 'fn', 'L§(Q§)', 'priv', NULL, 'draw§', ''), ('api§', 'class', 'const api§', 'pub', NULL, '', ''), ('get', 'method', 'get(string):R§', 'pub', 'api§', 'find§', '')) AS t (name, kind, signature, visibility, container, calls, decorators)""")
def web_symbols(spark, d):
    """Routes, wrapped components, components by their type, and objects of functions."""
    return _files(spark, d, "src/m§.ts", _WEB).select("name", "kind", "signature", "visibility", "container", F.array_join("calls", ",").alias("calls"), F.array_join("decorators", ",").alias("decorators"))


_MAKE = "V§ ?= 1 # x\nW§ = 2\n.PHONY: t§\nt§: a§ \\\n  b§ # no\n\techo $(V§) $$(X) '# $(W§)' $(patsubst %,$(V§),$(W§))\n_h§: t§ ; @echo ${V§:.c=.o} # $(W§)\n"


@query("""SELECT replace(name, '§', k) AS name, kind, replace(signature, '§', k) AS signature, visibility, replace(calls, '§', k) AS calls FROM (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part), (VALUES
('r§.mk', 'class', 'r§.mk', 'pub', ''), ('t§', 'method', 't§(V§)', 'pub', 'a§,b§'), ('_h§', 'method', '_h§(V§)', 'priv', 't§')) AS t (name, kind, signature, visibility, calls)""")
def make_symbols(spark, d):
    """Continued lines, comments, nested references, substitutions, and recipes on the line of a rule."""
    return _files(spark, d, "r§.mk", _MAKE).select("name", "kind", "signature", "visibility", F.array_join("calls", ",").alias("calls"))


_ROWS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in samples.DECLARED)


@query(f"SELECT 'n' || n_nationkey AS dir, t.* FROM nation, (VALUES {_ROWS}) AS t (lang, kind, name, signature, visibility, container, supers, calls)")
def language_symbols(spark, d):
    """The sample sources of all languages, in a folder for each nation."""
    texts = F.explode(F.create_map(*[F.lit(x) for path, text in samples.TEXTS.values() for x in (path, text)])).alias("path", "raw")
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dir"), texts)
    rows = repository.symbols(repository.files_of(nations.select(F.concat_ws("/", "dir", "path").alias("path"), F.col("raw").cast("binary").alias("raw"))))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select(F.element_at(F.split("file", "/"), 1).alias("dir"), "lang", "kind", "name", "signature", "visibility", F.coalesce("container", F.lit("")).alias("container"), joined("supers"), joined("calls"))
