"""Revisions of a repository, its index and history, and the members of archives, as DataFrames.

Names and object ids are listed by the driver; contents are read by the tasks, each with one process for all its objects. The repository
must be on storage that all executors share."""

from __future__ import annotations

import io
import os
import stat
import subprocess
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symscape.functions import paths
from symscape.sources import repository

MEMBERS = "path string, member string, payload binary, regular boolean, link string, metadata array<binary>"
#: A repository's variables would lead git elsewhere.
_ENV = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}


def _git(root: str, *args: str) -> bytes | None:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, env=_ENV)
    return done.stdout if done.returncode == 0 else None


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def revision_entries(spark: SparkSession, root: str, rev: str) -> DataFrame:
    """(path, mode, oid) of all files at a revision; none for one that doesn't exist."""
    out = _git(root, "ls-tree", "-r", "-z", "--full-tree", rev, "--") or b""
    rows = [(name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), *meta.decode().split(" ")[::2]) for meta, _, name in (x.partition(b"\t") for x in out.split(b"\0") if x)]
    return _rows(spark, rows, "path string, mode string, oid string")


def revision_files(spark: SparkSession, root: str, rev: str) -> DataFrame:
    """(path, mode, oid) of the known sources at a revision; links are none."""
    return revision_entries(spark, root, rev).where(paths.scanned(F.col("path")) & F.col("mode").startswith("100"))


def contents(entries: DataFrame, root: str) -> DataFrame:
    """entries (…, oid) with raw, the object's bytes, read in the tasks."""

    def run(batches):
        git = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=_ENV)
        try:
            for batch in batches:
                payloads = []
                for oid in batch.column("oid").to_pylist():
                    git.stdin.write(oid.encode() + b"\n")
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if len(head) != 3:
                        raise ValueError("an object can't be read")
                    payloads.append(git.stdout.read(int(head[2])))
                    git.stdout.read(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], [*batch.schema.names, "raw"])
        finally:
            git.kill()
            git.wait()

    return entries.repartition("oid").mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField("raw", T.BinaryType())]))


def snapshot(spark: SparkSession, root: str, rev: str, name: str = "old", langs: list[str] | None = None) -> DataFrame:
    """The files (snapshot, path, lang, raw, text) of a revision, without a working tree."""
    known = revision_files(spark, root, rev)
    if langs is not None:
        known = known.where(paths.language(F.col("path")).isin(*langs))
    return repository.files_of(contents(known, root).select("path", "raw"), name, langs)


def index_entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, entries): the distinct (mode, oid) of every indexed path, those of unresolved stages too."""
    out = _git(root, "ls-files", "-z", "--stage")
    if out is None:
        raise ValueError("a readable work tree is needed")
    rows = [(name.decode("utf-8", "replace"), *meta.decode().split(" ")[:2]) for meta, _, name in (x.partition(b"\t") for x in out.split(b"\0") if x)]
    flat = _rows(spark, rows, "path string, mode string, oid string")
    return flat.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("mode", "oid"))).alias("entries"))


def untracked(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that are neither indexed nor ignored."""
    out = _git(root, "ls-files", "-z", "--others", "--exclude-standard") or b""
    return _rows(spark, [(x.decode("utf-8", "replace"),) for x in out.split(b"\0") if x], "path string")


def publishable(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all that could be published now: what is indexed, and what isn't but could be."""
    return index_entries(spark, root).select("path").union(untracked(spark, root)).distinct()


def worktree(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """(path, raw, link) of the named files as they are on disk; a link's bytes are where it leads, and it is never followed."""

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                whole = os.path.join(root, name)
                if os.path.islink(whole):
                    target = os.fsencode(os.readlink(whole))
                    rows.append((name, target, target.decode("utf-8", "replace")))
                elif os.path.isfile(whole):
                    with open(whole, "rb") as f:
                        rows.append((name, f.read(), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["path", "raw", "link"])

    return names.select("path").mapInArrow(run, "path string, raw binary, link string")


def history(spark: SparkSession, root: str) -> DataFrame:
    """(oid, kind, raw) of every object that a repository holds, reachable or not."""
    out = _git(root, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)")
    if out is None:
        raise ValueError("a readable repository is needed")
    return contents(_rows(spark, [tuple(x.split(" ")) for x in out.decode().splitlines()], "oid string, kind string"), root)


# --- archives


def _members(name: str, raw: bytes):
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if z.comment:
                yield None, None, False, None, [z.comment]
            for i in z.infolist():
                payload = None if i.is_dir() else z.read(i)
                link = stat.S_ISLNK(i.external_attr >> 16 & 0xFFFF)
                yield i.filename, payload, not (i.is_dir() or link), payload.decode("utf-8", "replace") if link and payload is not None else None, [x for x in (i.comment, i.extra) if x]
        return
    pairs = lambda headers: [f"{k}\0{v}".encode("utf-8", "surrogateescape") for k, v in headers.items()]
    try:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            if t.pax_headers:
                yield None, None, False, None, pairs(t.pax_headers)
            for m in t.getmembers():
                link = m.linkname if m.issym() or m.islnk() else None
                held = t.extractfile(m) if m.isfile() else None
                payload = held.read() if held else b"" if m.isfile() else link.encode("utf-8", "surrogateescape") if link is not None else None
                yield m.name, payload, m.isfile(), link, [x.encode("utf-8", "surrogateescape") for x in (m.uname, m.gname) if x] + pairs(m.pax_headers)
        return
    except tarfile.TarError:
        pass
    yield name.rsplit("/", 1)[-1], raw, False, None, []


def archive_members(files: DataFrame) -> DataFrame:
    """A row for each member of the archives (path, raw), and one without a member for an archive's own metadata; a file that is no archive is its own member."""
    kinds = [pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string(), pa.list_(pa.binary())]

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *m) for m in _members(path, raw or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "member", "payload", "regular", "link", "metadata"])

    return files.select("path", "raw").mapInArrow(run, MEMBERS)


@F.pandas_udf(T.BooleanType())
def is_archive(raw: pd.Series) -> pd.Series:
    """Whether bytes are a zip or a tar of any compression."""

    def one(x) -> bool:
        if x is None:
            return False
        if zipfile.is_zipfile(io.BytesIO(x)):
            return True
        try:
            with tarfile.open(fileobj=io.BytesIO(x), mode="r:*"):
                return True
        except (tarfile.TarError, OSError, EOFError):
            return False

    return raw.map(one).astype(bool)
