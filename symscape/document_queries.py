"""The operators on maps in documents and on what must not be published, bound to the tables: texts as maps, addresses as paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from symscape.plans import documents, privacy
from symscape.plans.maps import END, START
from symscape.queries import query, table

_BARE = "rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))"
_PLAIN = len(f"{START}\n{documents.NOTE}\n\n```\n\n```\n{END}")


@query(f"""WITH n AS (SELECT doc_id, length({_BARE}) AS n FROM documents), t AS (SELECT doc_id, (n + 4) // 4 AS digest, (n + {_PLAIN} + 3) // 4 AS plain, (n + {_PLAIN + len(documents.COACHING)} + 3) // 4 AS whole FROM n)
SELECT doc_id, CAST(digest AS BIGINT) AS digest, CAST(plain - digest AS BIGINT) AS wrapper, CAST(whole - plain AS BIGINT) AS coaching, CAST(whole AS BIGINT) AS whole FROM t""")
def map_costs(spark, d):
    """What each text would cost as a map in a document, by parts."""
    return table(spark, d, "documents").select("doc_id", documents.cost(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", "c.*")


_FOOTER = "'· ' || doc_id || ' LOC · input 1 · state ' || substr(md5(lang), 1, 12) || CASE WHEN doc_id % 3 = 0 THEN ' · langs ' || lang || ',go' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' · targets b.md, ' || source ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' · budget ' || doc_id ELSE '' END"


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN substr(md5(lang), 1, 12) END AS state, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN least(lang, 'go') || '+' || greatest(lang, 'go') END AS langs, CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 = 0 THEN 'b.md+' || source END AS targets, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN CAST(doc_id AS INTEGER) END AS budget FROM documents""")
def map_settings(spark, d):
    """Settings in the last line of a map; where another line follows, there are none."""
    whole = F.concat(F.lit("# map\nX=1 · budget 7\n"), F.expr(_FOOTER), F.when(F.col("doc_id") % 7 == 0, F.lit("\nmore\n")).otherwise("\n \n"))
    s = documents.settings(whole)
    return table(spark, d, "documents").select("doc_id", s["state"].alias("state"), F.array_join(s["langs"], "+").alias("langs"), F.array_join(s["targets"], "+").alias("targets"), s["budget"].alias("budget"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'notes/' || page_id WHEN 1 THEN 'a/notes/x' WHEN 2 THEN 'mynotes/x' WHEN 3 THEN './bench/local-' || page_id WHEN 4 THEN 'x' || chr(92) || 'notes' ELSE 'notes.txt' END AS path FROM pages) SELECT page_id, page_id % 6 IN (0, 1, 3, 4) AS private FROM p""")
def private_paths(spark, d):
    k = F.col("page_id")
    key = k.cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("notes/"), key)).when(k % 6 == 1, "a/notes/x").when(k % 6 == 2, "mynotes/x").when(k % 6 == 3, F.concat(F.lit("./bench/local-"), key)).when(k % 6 == 4, "x\\notes").otherwise("notes.txt")
    return table(spark, d, "pages").select("page_id", privacy.private_path(path, ["notes/", "bench/local-"]).alias("private"))


@query("""WITH t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, lower(text) AS term, row_number() OVER (ORDER BY item_id) AS entry FROM benchmark WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#'))
SELECT 'd' || doc_id || ': matches protected denylist entry ' || entry AS message FROM t, e WHERE contains(t, trim(term))""")
def protected_payloads(spark, d):
    """Items of the benchmark as terms, documents as payloads."""
    terms = privacy.deny_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("place"), F.col("text").alias("line")))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"), F.encode("text", "UTF-8").alias("raw"))
    return privacy.in_payloads(rows, terms)
