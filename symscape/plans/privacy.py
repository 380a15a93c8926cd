"""What must not be published: terms and private folders in names, contents, links, archives and history. Findings never show what they match."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symscape.operators import names
from symscape.sources import revisions

PAYLOAD, NESTED, METADATA, CONTAINER, BLOB, OBJECT = (f"<{x} location redacted>" for x in ("private-only", "archive member", "archive metadata", "artifact container", "publishable blob", "historical blob"))
PROTECTED, ARTIFACT = "<protected location redacted>", "<private-only artifact location redacted>"


def private_path(name: Column, prefixes: list[str]) -> Column:
    """Whether a path lies in one of the private folders, or begins with one of the prefixes that are no folder, at any depth."""
    whole = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^[./]+", "")
    bare = F.regexp_replace(whole, "/+$", "")
    hit = F.lit(False)
    for p in prefixes:
        short = p.rstrip("/")
        hit = hit | whole.startswith(p) | whole.contains("/" + p) | (bare == short) | bare.endswith("/" + short)
    return hit


def deny_terms(lines: DataFrame) -> DataFrame:
    """(entry, term): the terms of a list (place, line) in order, numbered from 1; blank lines and those that begin with # are none."""
    kept = lines.withColumn("term", F.lower(F.trim("line"))).where("term <> '' AND NOT startswith(term, '#')")
    numbered = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x, i: F.struct((i + 1).alias("entry"), x["term"].alias("term")))
    return kept.agg(numbered.alias("t")).select(F.explode("t").alias("t")).select("t.*")  # a list of terms is short


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _found(rows: DataFrame, key: str, text: str, terms: DataFrame, fold=F.lower) -> DataFrame:
    return names.contained_terms(rows.select(key, text), key, text, terms.select("entry", "term"), "entry", "term", fold=fold)


def _plain(raw: Column) -> Column:
    """Bytes as characters, one for one."""
    return F.decode(raw, "ISO-8859-1")


def bytewise(terms: DataFrame) -> DataFrame:
    return terms.select("entry", _plain(F.encode("term", "UTF-8")).alias("term"))


def safe_labels(rows: DataFrame, label: str, terms: DataFrame) -> DataFrame:
    """rows with the labels that hold a term replaced."""
    listed = rows.select(label).distinct()
    bad = _found(listed.where(F.col(label).isNotNull()), label, label, terms).select(F.col(label).alias("__bad")).distinct()
    return rows.join(bad, F.col(label) == F.col("__bad"), "left").withColumn(label, F.when(F.col("__bad").isNotNull(), PROTECTED).otherwise(F.col(label))).drop("__bad")


def in_payloads(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(message) wherever a payload (label, raw) holds a term, whatever the case of ASCII letters; bytes are compared one by one."""
    text = safe_labels(rows.where("raw IS NOT NULL"), "label", terms).select("label", _plain(F.col("raw")).alias("payload"))
    return _found(text, "label", "payload", bytewise(terms), _ascii_lower).select(F.concat("label", F.lit(": matches protected denylist entry "), F.col("entry").cast("string")).alias("message"))


def in_names(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(message) wherever a name (kind, name) holds a term."""
    return _found(rows.where("name IS NOT NULL").select("kind", F.col("name").alias("text")), "kind", "text", terms).select(F.concat("kind", F.lit(": name matches protected denylist entry "), F.col("entry").cast("string")).alias("message"))


def in_links(rows: DataFrame, terms: DataFrame, prefixes: list[str]) -> DataFrame:
    """(message) for link targets (kind, name): terms in them, and private folders that they lead to."""
    target = rows.where("name IS NOT NULL").select(F.concat("kind", F.lit(" target")).alias("kind"), "name")
    leads = target.where(private_path(F.col("name"), prefixes)).select(F.concat("kind", F.lit(": private-only path <redacted>")).alias("message"))
    return in_names(target, terms).union(leads)


def in_metadata(rows: DataFrame, terms: DataFrame, prefixes: list[str]) -> DataFrame:
    """(message) for metadata (raw) of archives: terms, and the name of a private folder anywhere."""
    text = F.replace(_plain(F.col("raw")), F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | text.contains(p.rstrip("/"))
    private = rows.where(hit).select(F.lit(f"{METADATA}: private-only path <redacted>").alias("message"))
    return in_payloads(rows.select(F.lit(METADATA).alias("label"), "raw"), terms).union(private)


def _flagged(rows: DataFrame, label: str, what: str) -> DataFrame:
    return rows.where(revisions.is_archive("raw")).select(F.lit(f"{label}: {what} is not allowed").alias("message"))


def audit_files(files: DataFrame, terms: DataFrame, prefixes: list[str]) -> DataFrame:
    """(message) for candidates of publication (path, place, raw, link), place being index or worktree, raw null where there is only a name."""
    paths_of = files.select("path").distinct()
    private = private_path(F.col("path"), prefixes)
    label = F.when(private, PAYLOAD).otherwise(F.concat("path", F.lit(" ("), "place", F.lit(")")))
    kind = F.concat(F.when(F.col("place") == "index", "indexed").otherwise("worktree"), F.lit(" symlink"))
    held = files.where("raw IS NOT NULL")
    return (
        in_names(paths_of.select(F.lit("publishable path").alias("kind"), F.col("path").alias("name")), terms)
        .union(paths_of.where(private).select(F.lit("tracked private-only path: <redacted>").alias("message")))
        .union(in_payloads(held.select(label.alias("label"), "raw"), terms))
        .union(in_links(held.where("link IS NOT NULL").select(kind.alias("kind"), F.col("link").alias("name")), terms, prefixes))
        .union(_flagged(held.where("link IS NULL"), BLOB, "archive payload"))
    )


def audit_tree(spark: SparkSession, root: str, terms: DataFrame, prefixes: list[str]) -> DataFrame:
    """(message) for the index and the work tree, both, of a repository."""
    indexed = revisions.index_entries(spark, root).select("path", F.explode("entries").alias("e")).select("path", "e.mode", "e.oid")
    link = F.when(F.col("mode") == "120000", F.decode("raw", "UTF-8")).alias("link")
    there = revisions.contents(indexed, root).select("path", F.lit("index").alias("place"), "raw", link)
    disk = revisions.worktree(spark, root, revisions.publishable(spark, root)).select("path", F.lit("worktree").alias("place"), "raw", "link")
    return audit_files(there.union(disk), terms, prefixes)


def audit_artifacts(files: DataFrame, terms: DataFrame, prefixes: list[str]) -> DataFrame:
    """(message) for artifacts (path, raw): the container, its metadata, and every member's name, link and content; archives within are flagged."""
    members = revisions.archive_members(files)
    own = F.when(private_path(F.col("path"), prefixes), ARTIFACT).otherwise(F.col("path"))
    members = safe_labels(members.withColumn("artifact", own), "artifact", terms)
    known = members.where("member IS NOT NULL")
    private = private_path(F.col("member"), prefixes)
    label = F.when(private, PAYLOAD).otherwise(F.concat("artifact", F.lit(":"), "member"))
    return (
        in_payloads(files.select(F.lit(CONTAINER).alias("label"), "raw"), terms)
        .union(in_metadata(members.select(F.explode("metadata").alias("raw")), terms, prefixes))
        .union(in_names(known.select(F.concat("artifact", F.lit(": archive member")).alias("kind"), F.col("member").alias("name")), terms))
        .union(known.where(private).select(F.concat("artifact", F.lit(": contains private-only path <redacted>")).alias("message")))
        .union(in_links(known.where("link IS NOT NULL").select(F.lit("archive link").alias("kind"), F.col("link").alias("name")), terms, prefixes))
        .union(in_payloads(known.select(label.alias("label"), F.col("payload").alias("raw")), terms))
        .union(_flagged(known.where("regular").select(F.col("payload").alias("raw")), NESTED, "nested archive payload"))
    )


def audit_history(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """(message) for every object of a repository; object ids follow from contents, so they aren't shown either."""
    if terms.isEmpty():
        raise ValueError("a history is audited for terms; there are none")
    objects = revisions.history(spark, root)
    label = F.concat(F.lit("git object ("), "kind", F.lit(")")).alias("label")
    return in_payloads(objects.select(label, "raw"), terms).union(_flagged(objects.where("kind = 'blob'"), OBJECT, "archive payload"))
