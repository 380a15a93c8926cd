"""Predicates on paths of source files, as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "python": "py", "java": "java", "typescript": "ts", "tsx": "tsx jsx", "javascript": "js mjs", "go": "go", "rust": "rs", "csharp": "cs", "kotlin": "kt kts",
    "c": "c h", "cpp": "cpp cc cxx hpp hh", "lua": "lua", "html": "html htm", "css": "css", "vue": "vue", "svelte": "svelte", "helm": "yaml yml tpl", "make": "mk",
    "bash": "sh bash zsh", "ruby": "rb", "php": "php", "swift": "swift", "scala": "scala sc",
}
SUFFIXES = {suffix: lang for lang, all_of in LANGUAGES.items() for suffix in all_of.split()}
MAKEFILES = ("Makefile", "makefile", "GNUmakefile")
DENIED = set("node_modules target build dist out bin obj vendor generated __pycache__ venv fixtures testdata resources".split())
_TEST_DIRS = "^(tests?|__tests__|specs?|__specs__)$|[._-]tests$"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def directory(path: Column) -> Column:
    """The path without its last part; "." for a file at the root."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def stem(path: Column) -> Column:
    """The file's name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def language(path: Column) -> Column:
    """By whole name for makefiles, else by suffix (case counts); null for others."""
    by = F.create_map(*[F.lit(x) for x in chain(*SUFFIXES.items())])
    suffix = F.regexp_extract(base_name(path), r"(?<=.)\.([^.]+)$", 1)
    return F.when(base_name(path).isin(*MAKEFILES), "make").when(suffix != "", F.try_element_at(by, suffix))


def scanned(path: Column) -> Column:
    """Whether the file is of a known language and in no denied or hidden directory."""
    dirs = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return language(path).isNotNull() & ~F.exists(dirs, lambda d: d.isin(*sorted(DENIED)) | d.startswith("."))


def test_name(raw: Column) -> Column:
    return F.lower(raw).rlike(r"^(tests?|specs?)$|^test_|[_.](test|spec)$") | raw.rlike("(Test|Tests|Spec|IT)$")


def test_path(path: Column) -> Column:
    dirs = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: F.lower(d).rlike(_TEST_DIRS)) | test_name(stem(path))


def role(path: Column) -> Column:
    """tests, tools, benchmark or main; directories count at the root alone."""
    first = F.when(F.size(parts(path)) > 1, F.lower(F.element_at(parts(path), 1))).otherwise("")
    return F.when(test_path(path), "tests").when(first == "tools", "tools").when(first.isin("benchmark", "benchmarks"), "benchmark").otherwise("main")
