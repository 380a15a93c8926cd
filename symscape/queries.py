"""Each operator bound to the tables of a folder, with the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symscape import schemas
from symscape.functions import paths, text
from symscape.operators import graph, names, review, stats, support

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY ALL")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query(f"SELECT lang, CAST(sum(len(string_split_regex(text, '{_ENDS}')) - CAST(regexp_matches(text, '(^|{_ENDS})$') AS INT)) AS BIGINT) AS lines FROM documents GROUP BY lang")
def line_count(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(text.line_count(F.col("text"))).alias("lines"))


_TOKENS = r"SELECT w AS token FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$')"


def _tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(text.identifiers(F.col("text"))).alias("token"))


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM ({_TOKENS}) GROUP BY token")
def identifier_tokens(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS name FROM part), n AS (SELECT name, count(*) AS declared FROM w WHERE name <> '' GROUP BY 1), u AS (SELECT token, count(*) AS used FROM ({_TOKENS}) GROUP BY 1)
SELECT name, CAST(declared AS BIGINT) AS declared, CAST(coalesce(used, 0) AS BIGINT) AS used FROM n LEFT JOIN u ON name = token WHERE coalesce(used, 0) <= declared""")
def zero_usage(spark, d):
    declared = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("declared"))
    used = _tokens(spark, d).join(declared.select(F.col("name").alias("token")), "token", "left_semi").groupBy(F.col("token").alias("name")).agg(F.count("*").alias("used"))
    return declared.join(used, "name", "left").select("name", "declared", F.coalesce("used", F.lit(0)).alias("used")).where("used <= declared")


_LITERALS = "|".join([rf"{q * 3}(?:(?:{q}|{q * 2})?(?:[^{q}\\]|\\.))*{q * 3}" for q in "\"'"] + [rf"{q}(?:[^{q}\\\n]|\\.)*{q}" for q in "\"'"]).replace("'", "''")


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\*.*?\*/', ' ', 'g'), '(?s){_LITERALS}', '"s"', 'g'), '(?://|#)[^\n]*', ' ', 'g') AS code FROM pages""")
def strip_strings(spark, d):
    return table(spark, d, "pages").select("page_id", text.without_comments_and_strings(F.col("html")).alias("code"))


@query(rf"""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'API_KEY' WHEN p_size % 7 = 0 THEN 'TOKENS' ELSE upper(replace(p_name, ' ', '_')) END AS name, CASE WHEN p_size % 3 = 0 THEN '"' || p_type || '"' WHEN p_size % 11 = 0 THEN '''ghp_' || p_brand || '''' ELSE CAST(p_size AS VARCHAR) END AS value FROM part)
SELECT p_partkey, CASE WHEN length(value) > 24 OR regexp_matches(name, '(?i)(^|_)({schemas.SECRET_NAMES})(_|$|S(_|$))') OR regexp_matches(value, '^[''"]({schemas.SECRET_VALUES})') THEN name ELSE name || '=' || value END AS display FROM c""")
def secret_redact(spark, d):
    size, q = F.col("p_size"), F.lit('"')
    name = F.when(size % 5 == 0, "API_KEY").when(size % 7 == 0, "TOKENS").otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    value = F.when(size % 3 == 0, F.concat(q, "p_type", q)).when(size % 11 == 0, F.concat(F.lit("'ghp_"), "p_brand", F.lit("'"))).otherwise(size.cast("string"))
    return table(spark, d, "part").select("p_partkey", text.constant_display(name, value).alias("display"))


@query("""SELECT p_partkey, 'hr1-' || substr(sha256('{"check":"dead","discriminator":null,"kind":"' || p_type || '","path":"' || p_brand || '\\u00e9","subject":"' || p_name || '\\ud83d\\ude00\\n","version":1}'), 1, 20) AS id FROM part""")
def finding_id(spark, d):
    return table(spark, d, "part").select("p_partkey", text.finding_id(F.lit("dead"), F.col("p_type"), F.concat("p_name", F.lit("\U0001f600\n")), F.concat("p_brand", F.lit("é")), F.lit(None).cast("string")).alias("id"))


# --- joins


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), a AS (SELECT s_nationkey, min(s_suppkey) AS one FROM s GROUP BY 1 HAVING count(*) = 1), b AS (SELECT n_regionkey, min(s_suppkey) AS one FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, coalesce(a.one, b.one) AS target FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.s_nationkey = c_nationkey LEFT JOIN b ON b.n_regionkey = nation.n_regionkey""")
def unique_resolve(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    near = stats.unique_lookup(s.select(F.col("n_nationkey").alias("c_nationkey"), "s_suppkey"), ["c_nationkey"], "s_suppkey", "near")
    wide = stats.unique_lookup(s.select("n_regionkey", "s_suppkey"), ["n_regionkey"], "s_suppkey", "wide")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(near, "c_nationkey", "left").join(wide, "n_regionkey", "left").select("c_custkey", F.coalesce("near", "wide").alias("target"))


@query("""SELECT l_orderkey, l_partkey, arg_max(l_linenumber, (l_quantity, l_linenumber)) AS line FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_returnflag, l_linestatus)) = 1""")
def canonical_pick(spark, d):
    return stats.canonical(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_returnflag", "l_linestatus"], [F.col("l_quantity"), F.col("l_linenumber")], "l_linenumber", "line")


_SPLIT = "TIMESTAMP '1995-06-01'"


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < {_SPLIT} GROUP BY 1), n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= {_SPLIT} GROUP BY 1)
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (o_custkey) WHERE o.n IS DISTINCT FROM n.n""")
def full_outer_diff(spark, d):
    o = table(spark, d, "orders")
    side = lambda cond: o.where(cond).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return stats.changes(side(f"o_orderdate < {_SPLIT}"), side(f"o_orderdate >= {_SPLIT}"), ["o_custkey"], "n")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text)) AND b.text <> ''")
def deny_scan(spark, d):
    return names.contained_terms(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query()
def name_similarity(spark, d):
    part = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"), "p_partkey")
    return names.similar_names(part, part, ["type"], row="p_partkey")


# --- aggregations


@query("SELECT l_partkey, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def fan_in(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("customers"))


@query("""WITH m AS (SELECT event_type, median(value) AS m, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, CAST(any_value(n) AS BIGINT) AS n, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS mad FROM events JOIN m USING (event_type) WHERE value IS NOT NULL GROUP BY 1""")
def median_mad(spark, d):
    return stats.median_mad(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT source, round(avg(CASE WHEN quality = 1 THEN 100.0 ELSE 0.0 END) FILTER (quality IS NOT NULL), 4) AS good, CAST(count(quality) AS BIGINT) AS good_n, round(avg(CASE WHEN quality = 1 THEN 100.0 ELSE 0.0 END) FILTER (toxic = 1 AND quality IS NOT NULL), 4) AS good_toxic, CAST(count(quality) FILTER (toxic = 1) AS BIGINT) AS good_toxic_n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def percent_with_n(spark, d):
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    (a, an), (b, bn) = stats.percent(F.col("quality") == 1, F.lit(True)), stats.percent(F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return both.groupBy("source").agg(a.alias("good"), an.alias("good_n"), b.alias("good_toxic"), bn.alias("good_toxic_n"))


@query("""WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS t, avg(value) FILTER (event_type = 'view') AS c FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT user_id, round(t - c, 6) AS delta, CASE WHEN t IS NULL AND c IS NULL THEN 'neither' WHEN t IS NULL THEN 'no purchase' WHEN c IS NULL THEN 'no view' END AS reason FROM m""")
def matched_delta(spark, d):
    return stats.matched_deltas(table(spark, d, "events"), "user_id", "event_type", "value", "purchase", "view")


@query("""WITH h AS (SELECT source, doc_id, md5(doc_id || chr(31) || md5(coalesce(text, ''))) AS h FROM documents)
SELECT source, substr(md5(string_agg(h, '' ORDER BY doc_id)), 1, 12) AS state FROM h GROUP BY source""")
def state_hash(spark, d):
    return stats.ordered_hash(table(spark, d, "documents"), ["source"], ["doc_id"], [F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'purchase') AND event_id % 3 <> 0 GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER w AS k, lead(n, 1, 0) OVER w AS second FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type))
SELECT user_id, event_type, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM r WHERE k = 1 AND total >= 3 AND n * 3 >= total * 2 AND n > second""")
def placement_mass(spark, d):
    e = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IN ('view', 'purchase') AND event_id % 3 <> 0")
    return stats.dominant(e, ["user_id"], "event_type")


# --- windows, order, limits


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_attempt(spark, d):
    return stats.latest_by(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def dedup_first(spark, d):
    return stats.first_by(table(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn", "text"])


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, CAST(rank AS BIGINT) AS rank, CAST(greatest(n - 3, 0) AS BIGINT) AS omitted FROM r WHERE rank <= 3""")
def top3_per_group(spark, d):
    return stats.top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "rank", "omitted")


@query("SELECT c_custkey, c_mktsegment AS tier, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS turn FROM customer")
def round_robin(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return stats.round_robin(c, F.col("c_mktsegment"), F.col("c_nationkey"), [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "tier", "turn")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL), v AS (SELECT user_id, min(k) AS k FROM e WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT e.user_id, min(e.k) AS k FROM e JOIN v USING (user_id) WHERE event_type = 'click' AND e.k > v.k GROUP BY 1)
SELECT e.user_id, CAST(min(e.k) AS BIGINT) AS place FROM e JOIN c USING (user_id) WHERE event_type = 'purchase' AND e.k > c.k GROUP BY 1""")
def sequence_match(spark, d):
    return stats.followed(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase"])


@query("""WITH u AS (SELECT doc_id, source, sum((length(text) + 3) // 4) OVER (PARTITION BY source ORDER BY length(text), doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL)
SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM u WHERE used <= 5000""")
def budget_pack(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", F.length("text").alias("n"), text.token_estimate(F.col("text")).alias("size"))
    return stats.prefix_within(docs, ["source"], [F.asc("n"), F.asc("doc_id")], "size", 5000).select("doc_id", "source", "used")


@query("""WITH d AS (SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem), i AS (SELECT l_partkey, day, date_diff('day', DATE '1970-01-01', day) - row_number() OVER (PARTITION BY l_partkey ORDER BY day) AS island FROM d)
SELECT l_partkey, min(day) AS first_day, CAST(count(*) AS BIGINT) AS days FROM i GROUP BY l_partkey, island""")
def contiguous_runs(spark, d):
    days = table(spark, d, "lineitem").select("l_partkey", F.unix_date(F.to_date("l_shipdate")).alias("day"))
    return support.contiguous_runs(days, ["l_partkey"], "day").select("l_partkey", F.date_from_unix_date(F.col("first").cast("int")).alias("first_day"), F.col("n").alias("days"))


# --- sets and graphs


def _parts_of_year(year: int) -> str:
    return f"SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = {year}"


@query(f"""SELECT coalesce(a.l_partkey, b.l_partkey) AS id, CASE WHEN b.l_partkey IS NULL THEN 'resolved' WHEN a.l_partkey IS NULL THEN 'new' ELSE 'persisting' END AS state FROM ({_parts_of_year(1995)}) a FULL JOIN ({_parts_of_year(1996)}) b USING (l_partkey)""")
def resolved_persisting_new(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("y"))
    return review.resolved_persisting_new(line.where("y = 1995"), line.where("y = 1996"))


_EDGES = """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT 's' || (s_suppkey + 1), 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0"""


def _edges(spark, d) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c) if isinstance(c, str) else c)
    nation, s = table(spark, d, "nation"), table(spark, d, "supplier")
    pair = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    near, after = s.where("s_suppkey % 3 = 0"), F.col("s_suppkey") + 1
    return stats.union_all([
        pair(nation, key("r", "n_regionkey"), key("n", "n_nationkey")), pair(s, key("n", "s_nationkey"), key("s", "s_suppkey")),
        pair(s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), key("r", "n_regionkey"), key("s", "s_suppkey")),
        pair(near, key("s", "s_suppkey"), key("s", after)), pair(near, key("s", after), key("s", "s_suppkey")),
    ]).distinct()


_REACH = f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(f"{_REACH} SELECT src, dst FROM r")
def reachability(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"""{_REACH} SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.src AND o.dst <> e.dst AND (o.dst, e.dst) IN (SELECT (src, dst) FROM r) AND (e.dst, o.dst) NOT IN (SELECT (src, dst) FROM r))""")
def transitive_reduction(spark, d):
    edges = graph.written(_edges(spark, d), "edges")
    return graph.transitive_reduction(edges, graph.closure(edges))


@query("""WITH p AS (SELECT string_split(url, '/') AS p FROM pages WHERE url IS NOT NULL), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p)
SELECT array_to_string(p[1:k], '/') AS prefix, CAST(k AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS below, CAST(count(DISTINCT p[k + 1]) AS BIGINT) AS children FROM x GROUP BY 1, 2""")
def path_trie(spark, d):
    return graph.path_prefixes(table(spark, d, "pages"), "url")


@query("""WITH p AS (SELECT string_split(url, '/') AS p FROM pages WHERE url IS NOT NULL), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p),
n AS (SELECT array_to_string(p[1:k], '/') AS node, k AS depth, any_value(p[1:k]) AS q, count(DISTINCT p[k + 1]) AS children, bool_or(len(p) = k) AS ends FROM x GROUP BY 1, 2), kept AS (SELECT * FROM n WHERE children <> 1 OR ends),
a AS (SELECT kept.node, kept.depth, kept.q, coalesce(max(o.depth), 0) AS k FROM kept LEFT JOIN kept o ON o.depth < kept.depth AND array_to_string(kept.q[1:o.depth], '/') = o.node GROUP BY 1, 2, 3)
SELECT node, array_to_string(q[k + 1:depth], '/') AS label, CAST(depth AS BIGINT) AS depth FROM a""")
def path_compression(spark, d):
    return graph.compressed_trie(table(spark, d, "pages"), "url")


@query()
def name_factoring(spark, d):
    listed = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    return listed.select("p_brand", names.factored_lists("names").alias("names"))


@query("""WITH k AS (SELECT DISTINCT p_name, p_brand, p_type FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS a, count(*) OVER (PARTITION BY p_brand, p_name) AS b FROM k)
SELECT p_partkey, CASE WHEN a = 1 THEN p_name WHEN b = 1 THEN p_brand || '.' || p_name ELSE p_type || ':' || p_brand || '.' || p_name END AS description FROM part JOIN c USING (p_name, p_brand, p_type)""")
def target_descriptions(spark, d):
    return names.descriptions(table(spark, d, "part"), "p_name", "p_brand", "p_type", ["p_name", "p_brand", "p_type"]).select("p_partkey", "description")


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages), v AS (SELECT page_id, p || CASE page_id % 4 WHEN 0 THEN '/x_test.py' WHEN 1 THEN '/tests/Makefile' WHEN 2 THEN '/a.tsx' ELSE '/node_modules/b.js' END AS path FROM u)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'make' WHEN 2 THEN 'tsx' ELSE 'javascript' END AS lang, CASE WHEN page_id % 4 < 2 THEN 'tests' ELSE 'main' END AS role, page_id % 4 <> 3 AS scanned FROM v""")
def source_roles(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    k = F.col("page_id") % 4
    path = F.concat(path, F.when(k == 0, "/x_test.py").when(k == 1, "/tests/Makefile").when(k == 2, "/a.tsx").otherwise("/node_modules/b.js"))
    return table(spark, d, "pages").withColumn("path", path).select("page_id", paths.language(F.col("path")).alias("lang"), paths.role(F.col("path")).alias("role"), paths.scanned(F.col("path")).alias("scanned"))
