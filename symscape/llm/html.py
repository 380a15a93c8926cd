"""Operator 5, main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags; comments, scripts, styles, titles and other elements without readable text are one tag each; a
sign > in a quoted value ends no tag, and end tags may be missing wherever HTML allows it or a page just lacks them. A word
scores a positive weight, a tag a negative one, by its name. The contiguous run of words and tags with the greatest sum is the content,
found by one linear scan; its words, with entities decoded and block tags as line breaks, are the text.

Weights come from labelled pages: those whose own markup names their content, by a LABEL element. Over all of them, tokens within the
first such element and tokens outside are counted by kind; a token's weight is the logarithm of the ratio of its shares within and
outside, held above LEAST for words and below -LEAST for tags. All tags' weights are then multiplied by the one of SCALES with which the
runs found agree best (F1 of words) with the labels. The names of LABEL elements don't score, so that no page is decided by its label.

Defined results: a null or empty page, and one without a word, gives an empty text; of several runs with the greatest sum the first and
shortest counts; without labelled pages a word scores 1 and a tag UNKNOWN; repeated rows are decided alike; pages of any length are
read whole; an empty table gives an empty result. Only page_id and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symscape.llm.common import tidy

LABEL = ("article", "main")
LEAST, UNKNOWN = 0.05, -2.0
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0)
#: What a worker counts before it hands the counts on, in kinds of tokens; tag names of broken pages are without end.
MOST_KINDS = 100_000

#: What ends only at its own end tag, and has none of the page's text in it; without an end tag code runs to the end of the page, the others are mere tags.
_RAW, _CODE = {"script", "style", "title", "textarea", "iframe"}, {"script", "style"}
#: Elements without readable text that hold tags; without an end tag they are mere tags too.
_HIDDEN = {"noscript", "template", "svg", "object", "select"}
#: A quoted value after = may hold a >.
_TAG = re.compile(r"""<(?:(!--)|(/?[a-z][a-z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)|[!?][^>]*+(?:>|\Z))""", re.I)
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "footer", "nav", "blockquote", "pre", "hr"}


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element of this name that has an end tag ends, by its place; the ends pair off with the nearest starts."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?![a-z0-9:-])[^>]*+(?:>|\Z)", page, re.I):
        if not m[1]:
            if name != "svg" or not m[0].endswith("/>"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def tokens(page: str) -> list[tuple[str, str]]:
    """("word", its text) for each run of text between tags, be it blanks alone, ("/p", "") for a tag."""
    out: list[tuple[str, str]] = []
    ends: dict[str, dict[int, int]] = {}
    closed: dict[str, re.Pattern] = {}
    missing: set[str] = set()
    last = 0
    while m := _TAG.search(page, last):
        if last < m.start():
            out.append(("word", page[last : m.start()]))
        last, name = m.end(), (m[2] or "!").lower()
        if m[1]:
            end = page.find("-->", m.start() + 2)
            last = end + 3 if end >= 0 else len(page)
        elif name in _RAW and name not in missing:
            if name not in closed:
                closed[name] = re.compile(rf"</{name}(?![a-z0-9:-])[^>]*+(?:>|\Z)", re.I)
            end = closed[name].search(page, last)
            if end:
                last = end.end()
            elif name in _CODE:
                last = len(page)
            else:
                missing.add(name)
        elif name in _HIDDEN and not (name == "svg" and m[3].endswith("/")):
            if name not in ends:
                ends[name] = _ends(page, name)
            last = ends[name].get(m.start(), last)
        out.append((name, ""))
    if last < len(page):
        out.append(("word", page[last:]))
    return out


def content_run(names: list[str]) -> tuple[int, int] | None:
    """Places of the first label element's tags, None on a page that has none; elements of the same name within it are part of it."""
    for i, n in enumerate(names):
        if n in LABEL:
            depth = 0
            for j in range(i, len(names)):
                depth += (names[j] == n) - (names[j] == "/" + n)
                if not depth:
                    return i, j
            return i, len(names)
    return None


def counts_of(page: str) -> tuple[Counter, Counter]:
    """Tokens by kind (within, outside) of a labelled page, both empty for others."""
    found = tokens(page)
    names = [n for n, _ in found]
    at = content_run(names)
    parts: tuple[Counter, Counter] = (Counter(), Counter())
    if at:
        for i, (n, text) in enumerate(found):
            if n.lstrip("/") not in LABEL:
                parts[0 if at[0] < i < at[1] else 1][n] += len(text.split()) if n == "word" else 1
    return parts


def train(pages: DataFrame) -> dict[str, float]:
    """Weights by kind of token, from the counts over all labelled pages."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def flush():
            rows = [(k, a, b) for k, (a, b) in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["kind", "within", "outside"])

        for batch in batches:
            for page in batch.column(0).to_pylist():
                for side, part in enumerate(counts_of(page)):
                    for k, n in part.items():
                        seen.setdefault(k, [0, 0])[side] += n
                if len(seen) > MOST_KINDS:
                    yield flush()
        yield flush()

    counts = pages.where(F.col("html").isNotNull()).select("html").mapInArrow(tidy(run), "kind string, within long, outside long")
    # A kind that is on hardly any page weighs as an unknown tag does.
    rows = counts.groupBy("kind").agg(F.sum("within").alias("within"), F.sum("outside").alias("outside")).where("within + outside >= 5").collect()
    weight = weights({r.kind: (r.within, r.outside) for r in rows})
    return scaled(weight, best_scale(pages, weight)) if rows else weight


def scaled(weight: dict[str, float], scale: float) -> dict[str, float]:
    return {k: w if k == "word" else w * scale for k, w in weight.items()}


def agreement(page: str, settings: list[dict[str, float]]) -> list[tuple[int, int]] | None:
    """(words in both the run found and the label, words in either by how often) with each setting, None for pages without a label."""
    found = tokens(page)
    at = content_run([n for n, _ in found])
    if not at:
        return None
    words = np.array([len(text.split()) if n == "word" else 0 for n, text in found])
    total = np.concatenate([[0], np.cumsum(words)])
    out = []
    for weight in settings:
        a, b = best_run(scores_of(found, words, weight))
        lo, hi = max(a, at[0]), min(b, at[1])
        out.append((int(total[hi] - total[lo]) if lo < hi else 0, int(total[b] - total[a] + total[at[1]] - total[at[0]])))
    return out


def best_scale(pages: DataFrame, weight: dict[str, float]) -> float:
    settings = [scaled(weight, x) for x in SCALES]

    def run(batches):
        sums = np.zeros((len(SCALES), 2), np.int64)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                one = agreement(page, settings)
                if one:
                    sums += np.array(one)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SCALES)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["k", "both", "either"])

    sums = pages.where(F.col("html").isNotNull()).select("html").mapInArrow(tidy(run), "k int, both long, either long").groupBy("k").agg(F.sum("both").alias("both"), F.sum("either").alias("either")).collect()
    return SCALES[min(sums, key=lambda r: (-r.both / max(r.either, 1), r.k)).k] if sums else 1.0


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    within, outside = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    if not within or not outside:
        return {"word": 1.0}
    out = {k: math.log((a + 0.5) / within) - math.log((b + 0.5) / outside) for k, (a, b) in counts.items()}
    # Multiples of a power of two, so that sums are exact and ties are ties.
    exact = lambda w: round(w * (1 << 20)) / (1 << 20)
    return {k: exact(max(w, LEAST) if k == "word" else min(w, -LEAST)) for k, w in out.items()} | ({} if "word" in out else {"word": 1.0})


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """[a, b) of the contiguous run with the greatest sum above 0; (0, 0) if none has."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    if len(total) < 2:
        return 0, 0
    gain = total - np.minimum.accumulate(total)
    b = int(gain.argmax())
    if gain[b] <= 0:
        return 0, 0
    low = total[: b + 1]
    return int(np.flatnonzero(low == low.min())[-1]), b


def scores_of(found: list[tuple[str, str]], words: np.ndarray, weight: dict[str, float]) -> np.ndarray:
    """All words of a run of text score alike, so that the best sum begins and ends between runs."""
    return np.array([weight["word"] * w if n == "word" else 0.0 if n.lstrip("/") in LABEL else weight.get(n, UNKNOWN) for (n, _), w in zip(found, words.tolist(), strict=True)])


def text_of(page: str | None, weight: dict[str, float]) -> tuple[str, float]:
    """(content, its score)."""
    found = tokens(page or "")
    if not found:
        return "", 0.0
    scores = scores_of(found, np.array([len(text.split()) if n == "word" else 0 for n, text in found]), weight)
    a, b = best_run(scores)
    lines: list[str] = []
    for n, text in found[a:b]:
        if n == "word":
            lines.append(text)
        elif n.lstrip("/") in _BLOCK:
            lines.append("\0")
    text = entities.unescape("".join(lines))
    return "\n".join(x for x in (" ".join(part.split()) for part in text.split("\0")) if x), float(scores[a:b].sum())


def extracted(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(page_id, text, n_words, score): a row for each row of pages. No shuffle."""

    def run(batches):
        for batch in batches:
            found = [text_of(p, weight) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([len(t.split()) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["page_id", "text", "n_words", "score"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, text string, n_words long, score double")
