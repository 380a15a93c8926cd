"""Operator 8, secret scan with corpus-wide ownership frequency.

Candidates are matches of PATTERNS and WIDER in whole texts. Each value (its md5, the value itself is never returned) is counted over
the corpus: documents, repositories (owner and lang together) and owners (the column source). Values of few different characters
are "placeholder"; values of at least EXAMPLE_OWNERS owners are widely copied, "example"; the rest belong to few owners, "live".

Defined results: null or empty texts have no candidates; a null owner counts as one owner, and likewise a null lang; repeated rows
and a value twice in a text give one row per document; an empty table gives an empty result. Only doc_id, text, source and lang
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import written

EXAMPLE_OWNERS, MIN_CHARACTERS = 4, 8
#: kind -> pattern whose first group is the value; the same in Java and RE2.
PATTERNS = {
    "assigned": r"""(?i)\b(?:token|secret|password|passwd|api_?key|access_?key|auth_?key)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_/+.=-]{16,})""",
    "cloud_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "code_host": r"\b(gh[pousr]_[A-Za-z0-9]{36,})",
    "service_key": r"\b([sr]k[-_](?:live[-_]|proj[-_])?[A-Za-z0-9]{20,})",
    "chat": r"\b(xox[abprs]-[A-Za-z0-9-]{10,})",
    "web_token": r"\b(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[ \t\r\n]*([A-Za-z0-9+/=]{16,})",
}

#: Keywords inside longer names, and passwords of 8 characters or more.
WIDER = [
    ("assigned", r"""(?i)(?:token|secret|password|passwd|api_?key|access_?key|auth_?key)[A-Za-z0-9_]*+["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_/+.=-]{16,})"""),
    ("assigned", r"""(?i)(?:password|passwd|passphrase)[A-Za-z0-9_]*+["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9_/+.=-]{8,})"""),
]


def candidates(docs: DataFrame) -> DataFrame:
    labelled = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), labelled(k)) for k, p in [*PATTERNS.items(), *WIDER]]))
    owner = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", owner.alias("owner"), F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("repository"), F.explode(F.array_distinct(found)).alias("c"))
    value = F.col("c.value")
    return rows.select("doc_id", "owner", "repository", F.col("c.kind").alias("kind"), F.md5(value).alias("secret"), F.size(F.array_distinct(F.split(value, ""))).alias("characters")).distinct()


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """(doc_id, kind, secret, n_docs, n_repositories, n_owners, verdict) for each value in each document."""

    found = written(candidates(docs), "candidates")
    use = found.groupBy("kind", "secret").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.min("characters").alias("characters"))
    verdict = F.when(F.col("characters") < min_characters, "placeholder").when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    return found.select("doc_id", "kind", "secret").distinct().join(use, ["kind", "secret"]).select("doc_id", "kind", "secret", "n_docs", "n_repositories", "n_owners", verdict.alias("verdict"))


#: The same without possessive loops, which RE2 has not; what follows them can't be part of them.
_PATTERNS_OF_SQL = [(k, p.replace("*+", "*")) for k, p in [*PATTERNS.items(), *WIDER]]


def sql(table: str = "documents") -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS value FROM {table}" for k, p in _PATTERNS_OF_SQL)
    return f"""
WITH c AS (SELECT DISTINCT doc_id, owner, repository, kind, md5(value) AS secret, len(list_distinct(string_split(value, ''))) AS characters FROM ({parts})),
u AS (SELECT kind, secret, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners, min(characters) AS characters FROM c GROUP BY 1, 2)
SELECT DISTINCT doc_id, kind, secret, n_docs, n_repositories, n_owners, CASE WHEN u.characters < {MIN_CHARACTERS} THEN 'placeholder' WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'example' ELSE 'live' END AS verdict
FROM c JOIN u USING (kind, secret)"""
