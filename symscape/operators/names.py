"""Names: similarity, lossless factoring of lists, shortest unique descriptions, terms that must not occur."""

from __future__ import annotations

import difflib
import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symscape.storage import written

#: Bytes of terms that are sent to all tasks as one automaton; more are looked for in several passes over the texts.
TERM_BYTES = 32 << 20


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, as the longest common blocks give them, in lower case."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def long_enough(a: Column, b: Column, least: float) -> Column:
    """Lengths alone rule out a similarity of `least` where this is false."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def _letters(name: Column) -> Column:
    """How often each letter and digit stands in a name, whatever the case; other signs together."""
    low = F.lower(name)
    count = lambda sign: F.length(low) - F.length(F.replace(low, F.lit(sign)))
    known = [count(chr(c)) for c in [*range(97, 123), *range(48, 58)]]
    return F.array(*known, F.length(F.regexp_replace(low, "[a-z0-9]", "")))


def similar_pairs(a: DataFrame, b: DataFrame, on: list[str], least: float) -> DataFrame:
    """(on, name, other, ratio) of the distinct names of a and b that are at least so similar, equal ones too.

    Two bounds that cost no Python come first, in this order: lengths, by ranges of which pairs meet, and the letters that both have, whose
    number is no smaller than that of matching ones."""
    n = F.length("name")
    width = 4
    side = lambda df: df.select(*on, "name").distinct().withColumns({"n": n, "letters": _letters(F.col("name"))})
    # Names of n signs are as similar only to those of n * least / (2 - least) to n * (2 - least) / least: they meet in buckets of lengths.
    low, high = F.floor(n * least / (2 - least) / width), F.floor(n * (2 - least) / least / width)
    x = side(a).withColumn("bucket", F.explode(F.sequence(low, high)))
    y = side(b).withColumn("bucket", F.floor(n / width)).withColumnsRenamed({"name": "other", "n": "m", "letters": "others"})
    both = F.aggregate(F.zip_with("letters", "others", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    pairs = x.join(y, [*on, "bucket"]).where((2 * F.least("n", "m") >= least * (F.col("n") + F.col("m"))) & (2 * both >= least * (F.col("n") + F.col("m"))))
    return pairs.withColumn("ratio", similarity("name", "other")).where(F.col("ratio") >= least).select(*on, "name", "other", "ratio")


def similar_names(new: DataFrame, old: DataFrame, on: list[str], least: float = 0.7, shortest: int = 5, row: str | None = None) -> DataFrame:
    """(on, name, best, ratio): for each name of new the most similar of old (the first by name of equals) with at least that ratio; equal names too.

    row: the key of both tables where they share rows; a row is then no match of itself, while an equal name of another row is.

    Names are compared by similar_pairs()."""
    fit = lambda df: df.where(F.length("name") >= shortest)
    rated = similar_pairs(fit(new), fit(old), on, least).withColumnRenamed("other", "best")
    if row is not None:
        ends = lambda df, n: fit(df).withColumnRenamed("name", n).groupBy(*on, n).agg(F.min(row).alias(f"__{n}_lo"), F.max(row).alias(f"__{n}_hi"))
        rated = rated.join(ends(new, "name"), [*on, "name"]).join(ends(old, "best"), [*on, "best"]).where("name <> best OR least(__name_lo, __best_lo) < greatest(__name_hi, __best_hi)")
    return rated.groupBy(*on, "name").agg(F.min_by(F.struct("best", "ratio"), F.struct(-F.col("ratio"), "best")).alias("p")).select(*on, "name", "p.best", F.round("p.ratio", 6).alias("ratio"))


SEPARATORS = "_./-"
_MARK = "×0"


def _shared(name: str) -> list[tuple[str, str]]:
    """The beginnings of a name up to a separator, and its endings from one or from a hump, as (prefix, suffix)."""
    inside = lambda x: any(c not in SEPARATORS for c in x)
    heads = [(name[: k + 1], "") for k, c in enumerate(name) if c in SEPARATORS and inside(name[: k + 1])]
    hump = lambda k: name[k] in SEPARATORS or name[k].isupper() and name[k - 1].islower()
    return heads + [("", name[k:]) for k in range(1, len(name)) if hump(k) and inside(name[k:])]


def factored(names: list[str], dedupe: bool = False, least: int = 2) -> list[str]:
    """A shorter list that unfactored() gives back: runs of at least `least` neighbours with a common beginning are written prefix{a,b}, with a common ending {a,b}suffix, wherever that saves bytes; a mark that all have stands outside. The runs that save most are taken first."""
    names = list(dict.fromkeys(names)) if dedupe else list(names)
    mark = [_MARK if n.endswith(_MARK) else "" for n in names]
    bare = [n.removesuffix(_MARK) for n in names]
    where: dict[tuple[str, str, str], list[int]] = {}
    for k, n in enumerate(bare):
        for head, tail in _shared(n):
            where.setdefault((head, tail, mark[k]), []).append(k)
    options = []
    for (head, tail, m), places in where.items():
        for _, group in itertools.groupby(enumerate(places), lambda x: x[1] - x[0]):
            run = [k for _, k in group]
            middles = [bare[k][len(head) : len(bare[k]) - len(tail)] for k in run]
            if len(run) >= least and all(re.fullmatch(r"[\w$-]+", x) for x in middles):
                short = f"{head}{{{','.join(middles)}}}{tail}{m}"
                saved = len(",".join(names[k] for k in run).encode()) - len(short.encode())
                if saved > 0:
                    options.append((-saved, -len(head) - len(tail), run[0], head, tail, m, run, short))
    gone: set[int] = set()
    instead: dict[int, str] = {}
    for *_, run, short in sorted(options):
        if gone.isdisjoint(run):
            gone.update(run)
            instead[run[0]] = short
    return [instead.get(k, n) for k, n in enumerate(names) if k not in gone or k in instead]


def unfactored(items: list[str]) -> list[str]:
    out: list[str] = []
    for x in items:
        m = re.fullmatch(r"([^{}]*)\{([^{}]*)\}([^{}]*)", x)
        out += [m[1] + part + m[3] for part in m[2].split(",")] if m else [x]
    return out


def wrapped(prefix: str, names: list[str], width: int = 120, next_line: str | None = None) -> list[str]:
    """Lines of factored names, broken only between them; later lines begin with next_line, or with as many blanks as the prefix has."""
    rest = " " * len(prefix) if next_line is None else next_line
    lines: list[str] = []
    line, empty = prefix, True
    for x in factored(names, dedupe=True):
        longer = f"{line}{x}" if empty else f"{line},{x}"
        if len(longer) > width and not empty:
            lines.append(line + ",")
            longer = rest + x
        line, empty = longer, False
    return lines if empty else [*lines, line]


@F.pandas_udf(T.ArrayType(T.StringType()))
def factored_lists(lists: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else factored([n for n in x if n is not None]) for x in lists], dtype=object)


def descriptions(df: DataFrame, name: str, owner: str, file: str, key: list[str]) -> DataFrame:
    """df with description: the shortest of name, owner.name and file:owner.name that no other key shares; rows of one key count once."""
    full = F.concat_ws(".", F.col(owner), F.col(name))
    levels = {"d1": F.col(name), "d2": full, "d3": F.concat(F.col(file), F.lit(":"), full)}
    logical = df.select(*key, *[v.alias(k) for k, v in levels.items()]).distinct()
    for k in ("d1", "d2"):
        logical = logical.withColumn(f"n_{k}", F.count("*").over(Window.partitionBy(k)))
    chosen = logical.select(*key, F.when(F.col("n_d1") == 1, F.col("d1")).when(F.col("n_d2") == 1, F.col("d2")).otherwise(F.col("d3")).alias("description"))
    return df.join(chosen, key)


def contained_terms(texts: DataFrame, id_column: str, text: str, terms: DataFrame, term_id: str, term: str, term_bytes: int = TERM_BYTES, fold=F.lower) -> DataFrame:
    """(id, term id) wherever a text holds a term, whatever the case (what fold makes alike): one pass of an automaton over each text for every TERM_BYTES of terms. No shuffle.

    The driver holds one pass's terms at a time; where one pass is not enough, each one's findings are written. Null and empty terms are never found."""
    rows = ((r[0], r[1]) for r in terms.select(term_id, fold(F.col(term))).where(F.length(term) > 0).toLocalIterator())
    kind = pa.string() if dict(terms.dtypes)[term_id] == "string" else pa.int64() if dict(terms.dtypes)[term_id] == "bigint" else pa.int32()
    schema = f"{id_column} {dict(texts.dtypes)[id_column]}, {term_id} {dict(terms.dtypes)[term_id]}"
    lower = texts.where(F.col(text).isNotNull()).select(id_column, fold(F.col(text)).alias("__t"))

    def search(pack):
        def run(batches):
            import ahocorasick

            by: dict[str, list] = {}
            for k, t in pack:
                by.setdefault(t, []).append(k)
            automaton = ahocorasick.Automaton()
            for t, ids in by.items():
                automaton.add_word(t, ids)
            automaton.make_automaton()
            for batch in batches:
                found = [(i, k) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in sorted({k for _, ids in (automaton.iter(t) if by else ()) for k in ids})]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.schema[0].type), pa.array([f[1] for f in found], kind)], [id_column, term_id])

        return lower.mapInArrow(run, schema)

    def packs():
        pack, size = [], 0
        for r in rows:
            pack.append(r)
            size += len(r[1].encode())
            if size > term_bytes:
                yield pack
                pack, size = [], 0
        yield pack

    listed = packs()
    first, second = next(listed), next(listed, None)
    if not second:
        return search(first)
    out = written(search(first), "found").union(written(search(second), "found"))
    for pack in listed:
        if pack:
            out = out.union(written(search(pack), "found"))
    return out
