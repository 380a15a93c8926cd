"""A folder of sources as DataFrames: files, declarations, identifiers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symscape.functions import paths, text
from symscape.schemas import SYMBOLS
from symscape.sources import python_code, scanners

#: tsx and javascript have the declarations of typescript.
SAME = {"tsx": "typescript", "javascript": "typescript"}
_LISTS = ("params", "param_names", "fields", "calls", "supers", "permits", "raises", "decorators")


def files(spark: SparkSession, root: str, snapshot: str = "new", langs: list[str] | None = None) -> DataFrame:
    """(snapshot, path, lang, raw, text): the known files under a folder, by path from there. Names are listed first, without opening a file; then only the files that count are opened."""
    reader = spark.read.format("binaryFile")
    start = F.length(F.lit(root.split(":", 1)[-1].rstrip("/"))) + 2
    plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    path = F.substring(plain, start, F.length(plain))
    listed = reader.option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("whole"), path.alias("path"))
    wanted = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.whole) for r in _known(listed, langs).select("whole").collect()]
    if not wanted:
        return files_of(spark.createDataFrame([], "path string, raw binary"), snapshot, langs)
    return files_of(spark.read.format("binaryFile").load(wanted).select(path.alias("path"), F.col("content").alias("raw")), snapshot, langs)


def _known(found: DataFrame, langs: list[str] | None) -> DataFrame:
    known = found.where(paths.scanned(F.col("path"))).withColumn("lang", paths.language(F.col("path")))
    return known if langs is None else known.where(F.col("lang").isin(*langs))


def generator_fingerprint() -> bytes:
    """A hash of the sources of this package, in order: a state seeded with it changes with the extraction too."""
    home = Path(__file__).resolve().parent.parent
    out = hashlib.sha256()
    for f in sorted(home.rglob("*.py"), key=lambda f: f.relative_to(home).as_posix()):
        out.update(f.relative_to(home).as_posix().encode() + b"\0" + hashlib.sha256(f.read_bytes()).digest())
    return out.digest()


def files_of(found: DataFrame, snapshot: str = "new", langs: list[str] | None = None) -> DataFrame:
    """The same from a table (path, raw) such as the files of a revision. The filter on language comes before any content is looked at."""
    return _known(found, langs).select(F.lit(snapshot).alias("snapshot"), "path", "lang", "raw", F.make_valid_utf8(F.col("raw").cast("string")).alias("text"))


def extract(source: str, lang: str, path: str) -> list[dict]:
    """The declarations of one file, in order."""
    if lang == "python":
        return python_code.extract(source)
    if lang in ("vue", "svelte"):
        return scanners.single_file(source, lang, path)
    if lang in ("helm", "make"):
        return getattr(scanners, lang)(source, path)
    if lang in ("ruby", "lua", "bash", "css", "html"):
        rows = getattr(scanners, lang)(source)
        if lang == "bash" and rows:
            owner = path.split("/")[-1]
            rows = [{"name": owner, "kind": "class", "line": 1, "signature": owner}, *[r | ({"container": owner} if r["kind"] == "method" else {}) for r in rows]]
        return rows
    return scanners.braces(source, SAME.get(lang, lang))


def _spread(source: DataFrame) -> DataFrame:
    """The files (snapshot, path, lang, text) over four tasks for each core. Parsing takes far longer than moving a text, and a table of millions of small sources may be read by a single task."""
    return source.select("snapshot", "path", "lang", "text").repartition(4 * source.sparkSession.sparkContext.defaultParallelism, "snapshot", "path")


def symbols(source: DataFrame) -> DataFrame:
    """A row for each declaration of files (snapshot, path, lang, text). Each file is parsed once, by any task, wherever it was read."""
    schema = pa.schema([(f[0], pa.list_(pa.string()) if f[1] == "array<string>" else pa.map_(pa.string(), pa.string()) if f[1].startswith("map") else pa.int32() if f[1] == "int" else pa.string()) for f in (x.strip().split(" ") for x in SYMBOLS.replace("map<string,string>", "map").split(", "))])

    def run(batches):
        for batch in batches:
            rows = []
            for snapshot, path, lang, source_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, r in enumerate(extract(source_text or "", lang, path)):
                    row = {"snapshot": snapshot, "sym": f"{path}#{k}", "ordinal": k, "file": path, "lang": r.get("lang") or SAME.get(lang, lang), "signature": "", "visibility": "pub", "size": 0, "container": None, "returns": None} | r
                    rows.append(row | {c: row.get(c) or [] for c in _LISTS} | {"bindings": list((row.get("bindings") or {}).items())})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return _spread(source).mapInArrow(run, SYMBOLS)


def tokens(source: DataFrame) -> DataFrame:
    """(snapshot, file, token, n): identifiers of each file outside comments and strings, with Python's reads counted once more."""
    source = _spread(source)
    plain = source.select("snapshot", F.col("path").alias("file"), F.explode(text.identifiers(text.without_comments_and_strings(F.col("text")))).alias("token")).groupBy("snapshot", "file", "token").agg(F.count("*").alias("n"), F.lit(True).alias("seen"))

    def run(batches):
        for batch in batches:
            rows = [(s, p, t, n) for s, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in Counter(python_code.reads(x or "")).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["snapshot", "file", "token", "n"])

    more = source.where("lang = 'python'").select("snapshot", "path", "text").mapInArrow(run, "snapshot string, file string, token string, n long").withColumn("seen", F.lit(False))
    return plain.unionByName(more).groupBy("snapshot", "file", "token").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))
