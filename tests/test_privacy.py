import io
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from symscape.plans import privacy
from symscape.sources import revisions

PRIVATE = ["notes/", "bench/local-"]


@pytest.fixture(scope="module")
def terms(spark):
    return privacy.deny_terms(spark.createDataFrame([(0, "# none"), (1, " Acme "), (2, ""), (3, "züge")], "place int, line string"))


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "a.py").write_text("def f(): return 'ACME'\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("x\n")
    (root / "sub").mkdir()
    (root / "sub" / "b.go").write_text("package b\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    (root / "a.py").write_text("def f(): return 1\n")
    (root / "link").symlink_to("notes/secret")
    git("add", "-A")
    git("commit", "-qm", "second")
    (root / "sub" / "b.go").write_text("package zZüGE\n")
    (root / "notes").mkdir()
    (root / "notes" / "n.txt").write_text("acme")
    (root / ".gitignore").write_text("ignored\n")
    (root / "ignored").write_text("acme")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("m.txt", "plain")
    return str(root)


def test_private_paths(spark):
    cases = {"notes/a": True, "x/notes/a": True, "notes": True, "x/notes": True, "mynotes/a": False, "./notes/a": True, "bench/local-1": True, "bench/loc": False, "a\\notes\\b": True, "notes.txt": False, "q/bench/local-": True}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", privacy.private_path(F.col("p"), PRIVATE).alias("h")).collect()
    assert {r.p: r.h for r in got} == cases


def test_terms_are_numbered(terms):
    assert [(r.entry, r.term) for r in terms.orderBy("entry").collect()] == [(1, "acme"), (2, "züge")]


def test_revisions(spark, repo):
    assert {r.path for r in revisions.revision_files(spark, repo, "HEAD~1").collect()} == {"a.py", "sub/b.go"}
    assert revisions.revision_files(spark, repo, "nowhere").count() == 0
    old = {r.path: r for r in revisions.snapshot(spark, repo, "HEAD~1").collect()}
    assert old["a.py"].text == "def f(): return 'ACME'\n" and old["sub/b.go"].lang == "go" and old["a.py"].snapshot == "old"
    assert [r.path for r in revisions.snapshot(spark, repo, "HEAD", langs=["go"]).collect()] == ["sub/b.go"]
    index = {r.path: r.entries for r in revisions.index_entries(spark, repo).collect()}
    assert index["link"][0].mode == "120000" and "ignored" not in index
    names = {r.path for r in revisions.publishable(spark, repo).collect()}
    assert names == {"a.py", "link", "node_modules/x.js", "sub/b.go", "notes/n.txt", ".gitignore", "z.zip"}


def test_tree(spark, repo, terms):
    got = sorted(r.message for r in privacy.audit_tree(spark, repo, terms, PRIVATE).collect())
    assert got == sorted([
        "tracked private-only path: <redacted>", f"{privacy.PAYLOAD}: matches protected denylist entry 1", "sub/b.go (worktree): matches protected denylist entry 2",
        "indexed symlink target: private-only path <redacted>", "worktree symlink target: private-only path <redacted>", f"{privacy.BLOB}: archive payload is not allowed",
    ])


def test_history(spark, repo, terms):
    got = sorted(r.message for r in privacy.audit_history(spark, repo, terms).collect())
    assert got == ["git object (blob): matches protected denylist entry 1"]
    with pytest.raises(ValueError, match="terms"):
        privacy.audit_history(spark, repo, terms.limit(0))


def archives():
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in.txt", "x")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"from Acme notes"
        z.writestr("notes/acme.txt", "plain")
        z.writestr("deep.zip", inner.getvalue())
        z.writestr("dir/", "")
        z.writestr("t.txt", "ZÜGE züge".encode())
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "../notes"
        t.addfile(link)
        plain = tarfile.TarInfo("p.txt")
        plain.size, plain.uname = 4, "acme"
        t.addfile(plain, io.BytesIO(b"acme"))
    return [("dist/a.zip", out.getvalue()), ("b.tar.gz", tar.getvalue()), ("plain.txt", b"an ACME text"), ("acme.bin", b""), ("notes/x", b"acme")]


def test_artifacts(spark, terms):
    files = spark.createDataFrame(archives(), "path string, raw binary")
    members = {(r.path, r.member): r for r in revisions.archive_members(files).collect()}
    assert members["dist/a.zip", "deep.zip"].regular and not members["dist/a.zip", "dir/"].regular and members["dist/a.zip", None].metadata[0] == b"from Acme notes"
    assert members["b.tar.gz", "l"].link == "../notes" and not members["plain.txt", "plain.txt"].regular
    got = sorted(r.message for r in privacy.audit_artifacts(files, terms, PRIVATE).collect())
    entry = lambda label, k, n=1: [f"{label}: matches protected denylist entry {k}"] * n
    assert got == sorted([
        *entry(privacy.CONTAINER, 1, 3), *entry(privacy.CONTAINER, 2, 0), *entry(privacy.METADATA, 1, 2), f"{privacy.METADATA}: private-only path <redacted>",
        "dist/a.zip: archive member: name matches protected denylist entry 1", "dist/a.zip: contains private-only path <redacted>", "archive link target: private-only path <redacted>",
        *entry("dist/a.zip:t.txt", 2), *entry("b.tar.gz:p.txt", 1), *entry("plain.txt:plain.txt", 1), f"{privacy.NESTED}: nested archive payload is not allowed",
        f"{privacy.PROTECTED}: archive member: name matches protected denylist entry 1", *entry(f"{privacy.ARTIFACT}:x", 1),
        *(entry(privacy.CONTAINER, 2) if any("züge".encode() in raw.lower() for _, raw in archives()) else []),
    ])
