"""Operator 7, quality rules from cross-document line frequency.

Lines are compared in lower case with runs of blanks as one space. For each host (the column source) and line, distinct documents
are counted; a document is what its lines say: rows whose normalised lines are all the same, in order, are copies of one document and
count once, and any two others count as two, however many lines they share. A line in more than max(MIN_DOCS, MIN_SHARE * documents
of the host) is removed from all documents of that host. A document is rejected if nothing but blanks is left, or less than MIN_LEFT
of its characters (without blank lines).

A host's frequent lines are at most 1 / MIN_SHARE times the lines that its documents have on average, as each stands in more than that
share of them; that bounds the array with which a row is compared.

Defined results: null text counts as empty and is rejected; a null host is a host of its own; repeated rows are decided one by one
and alike; ties at a limit stay; texts of any length are read whole; an empty table gives an empty result. All columns of the input
come back, only text and n_chars (where present) change. Columns of other names, whatever they are, pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import free, quoted, written

MIN_DOCS, MIN_SHARE, MIN_LEFT = 10, 0.002, 0.2
#: Largest number of frequent lines that is sent to all executors (8 bytes each); beyond it they are joined by host and line, with the same result.
BROADCAST_LINES = 500_000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _normal(text: Column) -> Column:
    """The lines of a text as they are compared."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, r"[ \t\r]{2,}|[\t\r]", " ")), "\n"), lambda x: F.trim(x))


def _hash(line: Column) -> Column:
    return F.unhex(F.substring(F.md5(line), 1, 16))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _length(lines: Column, hashes: Column) -> Column:
    """Characters in lines that aren't blank."""
    return F.aggregate(F.zip_with(lines, hashes, lambda x, h: F.when(h != F.lit(_BLANK), F.length(x)).otherwise(0)), F.lit(0), lambda n, x: n + x)


_BLANK = bytes.fromhex(hashlib.md5(b"").hexdigest()[:16])


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line): the hashes of the lines above their host's limit."""
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    hashed = docs.select(host, F.transform(F.filter(_normal(_text()), lambda x: x != ""), _hash).alias("h")).where(F.size("h") > 0)
    lines = hashed.select("host", F.xxhash64("h").alias("doc"), F.explode(F.array_distinct("h")).alias("line"))
    found = lines.distinct().groupBy("host", "line").count().where(F.col("count") > min_docs)
    hosts = docs.groupBy(host).agg(F.count("*").alias("docs"))
    return found.join(hosts, "host").where(F.col("count") > F.greatest(F.lit(float(min_docs)), F.col("docs") * min_share)).select("host", "line")


def filtered(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The documents that aren't rejected, without their frequent lines."""
    bad = written(frequent_lines(docs, min_docs, min_share), "lines")
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    hashes = F.transform(_normal(_text()), _hash)
    h, key, other, cut_out, new_text, ok = free(docs, "__h", "__host", "__d", "__bad", "__text", "__ok")
    if bad.count() <= broadcast_lines:
        per_host = F.broadcast(bad.groupBy(F.col("host").alias(key)).agg(F.collect_list("line").alias(cut_out)))
        out = docs.withColumn(h, host).join(per_host, F.col(h) == F.col(key), "left")
    else:
        own = docs.select("doc_id", host.alias("host"), F.explode(F.array_distinct(hashes)).alias("line"))
        per_doc = own.join(bad, ["host", "line"]).groupBy(F.col("doc_id").alias(other), F.col("host").alias(key)).agg(F.collect_set("line").alias(cut_out))
        out = docs.withColumn(h, host).join(per_doc, (F.col(h) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(other)), "left")
    whole = F.struct(_text().alias("text"), (F.trim(F.translate(_text(), "\t\r\n", "   ")) != "").alias("ok"))

    def cut(s: Column) -> Column:
        lines, h, found = F.split(_text(), "\n"), s["h"], s["found"]
        kept = F.filter(F.arrays_zip(lines.alias("x"), h.alias("h")), lambda z: ~F.array_contains(found, z["h"]))
        return _let(kept, lambda k: _let(F.aggregate(F.transform(k, lambda z: F.when(z["h"] != F.lit(_BLANK), F.length(z["x"])).otherwise(0)), F.lit(0), lambda n, x: n + x), lambda n: F.struct(F.array_join(F.transform(k, lambda z: z["x"]), "\n").alias("text"), ((n > 0) & (n >= _length(lines, h) * min_left)).alias("ok"))))

    found = _let(hashes, lambda h: F.struct(h.alias("h"), F.array_intersect(h, F.col(cut_out)).alias("found")))
    result = F.when(F.col(cut_out).isNull(), whole).otherwise(_let(found, lambda s: F.when(F.size(s["found"]) == 0, whole).otherwise(cut(s))))
    # The generator makes each row's text once; a filter on it would be computed apart from it.
    columns = [quoted(c) for c in docs.columns]
    out = out.select(*columns, F.inline(F.filter(F.array(result), lambda r: r["ok"])).alias(new_text, ok))
    new = {"text": F.col(new_text), "n_chars": F.length(new_text)}
    return out.select(*[(new[c] if c in new else F.col(quoted(c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM {table}),
l0 AS (SELECT rid, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
l AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS norm FROM l0),
h AS (SELECT *, substr(md5(norm), 1, 16) AS hx FROM l),
k AS (SELECT rid, md5(string_agg(hx, ' ' ORDER BY pos)) AS document FROM h WHERE norm <> '' GROUP BY rid),
n AS (SELECT coalesce(source, '') AS host, count(*) AS docs FROM {table} GROUP BY 1),
f AS (SELECT h.host, h.hx FROM h JOIN k USING (rid) WHERE norm <> '' GROUP BY 1, 2 HAVING count(DISTINCT document) > {MIN_DOCS}
  AND count(DISTINCT document) > (SELECT docs * {MIN_SHARE} FROM n WHERE n.host = h.host)),
m AS (SELECT h.rid, h.pos, h.line, h.norm, f.hx IS NULL OR h.norm = '' AS keep FROM h LEFT JOIN f ON f.host = h.host AND f.hx = h.hx),
g AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (keep) AS text, coalesce(sum(length(line)) FILTER (keep AND norm <> ''), 0) AS kept, coalesce(sum(length(line)) FILTER (norm <> ''), 0) AS was FROM m GROUP BY rid)
SELECT d.doc_id, g.text, d.lang, d.source, CAST(length(g.text) AS BIGINT) AS n_chars FROM d JOIN g USING (rid) WHERE kept > 0 AND kept >= was * {MIN_LEFT}"""
