"""Operator 3, packing by power-of-two decomposition.

A document of n tokens (runs of characters other than blanks) is cut, front to back, into n // MAX pieces of MAX tokens and then a
piece for each binary digit of the rest, the greatest first. A piece of 2**b tokens belongs to bucket b, and sequences of one
bucket have equal length, so that batches need no padding and no sequence holds tokens of two documents.

Defined results: null texts and texts of blanks have no piece; a document of any length is cut whole; repeated rows give their pieces
again; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 13
BLANKS = r"[ \t\r\n]+"


def pieces(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, bucket, start, length, text): start counts tokens from 0; text has the piece's tokens, one space between them. No shuffle."""
    words = docs.select("doc_id", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n, most = F.size("w"), 1 << max_bits
    full = F.when(n >= most, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / most).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.lit(max_bits).alias("b"), (k * most).alias("s")))).otherwise(F.array().cast("array<struct<b:int,s:int>>"))
    rest = F.array(*[F.when(F.getbit(n, F.lit(b)) == 1, F.struct(F.lit(b).alias("b"), F.shiftleft(F.shiftright(n, b + 1), b + 1).alias("s"))) for b in range(max_bits - 1, -1, -1)])
    cut = F.transform(F.filter(F.concat(full, rest), lambda p: p.isNotNull()), lambda p: F.struct(p["b"].alias("b"), p["s"].alias("s"), F.array_join(F.slice(F.col("w"), p["s"] + 1, F.pow(F.lit(2), p["b"]).cast("int")), " ").alias("t")))
    out = words.select("doc_id", F.explode(cut).alias("p"))
    return out.select("doc_id", F.col("p.b").alias("bucket"), F.col("p.s").cast("long").alias("start"), F.pow(F.lit(2), F.col("p.b")).cast("long").alias("length"), F.col("p.t").alias("text"))


def batches(packed: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """(bucket, sequences, batches): how many batches of so many tokens each bucket fills."""
    return packed.groupBy("bucket", "length").agg(F.count("*").alias("sequences")).select("bucket", "sequences", F.ceil(F.col("sequences") * F.col("length") / tokens).alias("batches"))


def sql(table: str = "documents", max_bits: int = MAX_BITS) -> str:
    most = 1 << max_bits
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{BLANKS}'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL),
n AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
p AS (SELECT doc_id, w, {max_bits} AS b, unnest(range(0, n // {most})) * {most} AS s FROM n WHERE n >= {most}
  UNION ALL SELECT doc_id, w, b, (n >> (b + 1)) << (b + 1) AS s FROM n, (SELECT unnest(range(0, {max_bits})) AS b) WHERE (n >> b) & 1 = 1)
SELECT doc_id, CAST(b AS INTEGER) AS bucket, CAST(s AS BIGINT) AS start, CAST(1 << b AS BIGINT) AS length, array_to_string(list_slice(w, CAST(s + 1 AS BIGINT), CAST(s + (1 << b) AS BIGINT)), ' ') AS text FROM p"""
