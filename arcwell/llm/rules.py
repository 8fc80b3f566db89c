"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words are
compared with the reference of its language by Jensen-Shannon distance (square root
of the divergence in bits, 0 to 1).  References are the mean shares over all documents
of the language that pass the base rules and the length guard, each document with the
same weight, so they cover the whole corpus and no long text makes its own reference.
A language is any value of `lang`; one of fewer than `least_docs` such documents has
no reference.  Documents of such a language are held against the classes of the
`largest` languages with the most documents, and pass if one lets them pass; common
words of another language tell nothing of them.  Documents of an unknown language
(null) must pass under both histograms of one reference.  Where there is no reference
at all, the base rules decide.
Which words are common is fixed for the languages named below and the same list
serves all others.  Where a text is too short for a steady histogram, the guard lets
it pass.

The limit of the distance over common words is a share of the distance that a text
without a common word has from the language's reference, so such a text never passes
where the reference has enough common words to tell.

Counts are taken in one pass; the small table of them, without texts, is written to
the shared folder, summed by language in integers, and compared in a second pass
over it.  The sums are partial before any shuffle, so a language with most of the
corpus is no hot key.  The largest languages' references go with the tasks, at most
`largest` of them; those of further languages come by a join, in which the large
ones take no part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import kept

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, Spanish and French
COMMON = tuple(
    dict.fromkeys(
        "the of and to in a is that it was for on are as with his they be at this from or by not have had but an were we there "
        "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
        "que el y los se las por un para con no una su al lo como más del "
        "de la le et les des en du une est dans qui par pour au il sur pas plus ce avec ne son".split()
    )
)
CLASSES = ("lower", "upper", "accented", "digit", "space", "newline", "stop", "bracket", "symbol", "other")


@lru_cache(maxsize=1 << 16)
def char_class(c: str) -> int:
    """Index into CLASSES."""
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if c in SYMBOLS:
        return 8
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return 1 if kind == "Lu" else 0 if c < "\x80" else 2
    if kind[0] == "N":
        return 3
    if kind in ("Ps", "Pe"):
        return 7
    return 6 if c in ".,;:!?'\"-" else 9 if kind[0] in "PCM" else 8


_LATIN = np.array([char_class(chr(i)) for i in range(0x250)])


def char_histogram(text: str) -> np.ndarray:
    """Code points by class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    near = points < len(_LATIN)
    out = np.bincount(_LATIN[points[near]], minlength=len(CLASSES))
    if not near.all():
        out = out + np.bincount([char_class(chr(i)) for i in points[~near]], minlength=len(CLASSES))
    return out


_PLACE = {w.encode(): k for k, w in enumerate(COMMON)}
_STRIP = b".,;:!?\"'()[]"


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Words by their place in COMMON, all others in the last cell; end punctuation off, in lower case."""
    get, rest = _PLACE.get, len(COMMON)
    return np.bincount([get(w.strip(_STRIP).lower(), rest) for w in words] or [rest], minlength=rest + 1) * (len(words) > 0)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that stand in a window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)).astype(np.uint64)
    if len(number) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = np.nonzero(key[order[1:]] == key[order[:-1]])[0]
    if not len(same):
        return 0
    # equal keys are compared word by word with the first of their kind
    group = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
    first = order[np.searchsorted(group, group)]
    spans = np.arange(width)
    alike = np.ones(n, bool)
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        alike[part] = (ids[order[part, None] + spans] == ids[first[part, None] + spans]).all(axis=1)
    if not alike.all():
        return _repeated_exactly(words, width)
    size = np.bincount(group)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = order[size[group] > 1]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def _repeated_exactly(words: list[bytes], width: int) -> int:
    places: dict[tuple, list[int]] = {}
    for k in range(len(words) - width + 1):
        places.setdefault(tuple(words[k : k + width]), []).append(k)
    return len({at + j for found in places.values() if len(found) > 1 for at in found for j in range(width)})


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """The words, then word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = sum(map(len, words)) if len(data) == len(text) else len(b"".join(words).decode())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.array(flat.astype(np.int64, copy=False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, the four base counts, base_failed, and both histograms as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars, commons = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                words, *found = base_counts(text)
                n, repeats = len(words), found[3]
                rows.append((n, *found, n < 20 or 100 * repeats > 30 * n))
                chars.append(char_histogram(text or ""))
                commons.append(word_histogram(words))
            kinds = (*[pa.int64()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)), _lists(chars, len(CLASSES)), _lists(commons, len(COMMON) + 1)],
                ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars", "commons"],
            )

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars array<long>, commons array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, schema)


#: Shares are summed as whole numbers of this part, so that sums depend on no order.
_PART = 1_000_000


def references(found: DataFrame, least_docs: int = 20, least_chars: int = 100, least_words: int = 40) -> DataFrame:
    """(lang, docs, char_sums, common_sums) of each language of at least least_docs documents that pass the base rules and the guards."""
    total = {name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x) for name in ("chars", "commons")}
    steady = found.where(~F.col("base_failed") & F.col("lang").isNotNull() & (total["chars"] >= least_chars) & (total["commons"] >= least_words))
    shares = steady.select("lang", *[F.expr(f"transform({name}, x -> x * {_PART} div aggregate({name}, 0L, (a, y) -> a + y))").alias(name) for name in ("chars", "commons")])
    sums = [F.sum(F.col(name)[k]).alias(f"{name}{k}") for name, n in (("chars", len(CLASSES)), ("commons", len(COMMON) + 1)) for k in range(n)]
    by = shares.groupBy("lang").agg(F.count("*").alias("docs"), *sums).where(F.col("docs") >= least_docs)
    return by.select("lang", "docs", F.array(*[f"chars{k}" for k in range(len(CLASSES))]).alias("char_sums"), F.array(*[f"commons{k}" for k in range(len(COMMON) + 1)]).alias("common_sums"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis, in [0, 1]."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(terms.sum(-1) / 2, 0, 1))


def word_limits(refs: np.ndarray, most_words: float, most_of_plain: float, least_common: float) -> np.ndarray:
    """The limit for each reference: at most most_words, and most_of_plain of the distance of a text without common words where the reference has a share of least_common of these."""
    plain = np.zeros(len(COMMON) + 1)
    plain[-1] = 1
    return np.where(1 - refs[:, -1] >= least_common, np.minimum(most_words, most_of_plain * js_distance(plain, refs)), most_words)


@dataclass(frozen=True)
class Limits:
    """Greatest distances, guards, support of a reference, and how many languages serve those without one."""

    most_chars: float = 0.25
    most_words: float = 0.5
    least_chars: int = 100
    least_words: int = 40
    most_of_plain: float = 0.8
    least_common: float = 0.15
    least_docs: int = 20
    largest: int = 64


def _shares(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(1, sums.sum(-1, keepdims=True))


def _against(own: np.ndarray, refs: np.ndarray, limits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each histogram the distance from its reference, NaN under the guard, and whether it passes; refs and limits have a row for each."""
    n = own.sum(-1)
    found = js_distance(_shares(own), refs)
    return np.where(n < least, np.nan, found), (n < least) | (found <= limits)


def judged(docs: DataFrame, how: Limits | None = None) -> DataFrame:
    """Counts, distances and the verdict of every row.

    kept is false if the base rules fail (under 20 words, or over 30 % of the words
    in repeated windows of 8), or if a distance passes its limit in a text of at
    least least_chars characters or least_words words.  A distance is null under its
    guard or where there is no reference (that over common words also for a language
    without one); of several references it is the smallest.  Null
    texts have no words; repeated rows count and return as often as they stand.
    """
    how = how or Limits()
    found = kept(counts(docs), "counts")
    refs = kept(references(found, how.least_docs, how.least_chars, how.least_words), "references")
    # a bounded report: the largest languages
    rows = refs.orderBy(F.desc("docs"), "lang").limit(how.largest + 1).collect()
    rest, rows = len(rows) > how.largest, rows[: how.largest]
    place = {r["lang"]: i for i, r in enumerate(rows)}
    widths = (len(CLASSES), len(COMMON) + 1)
    tables = [_shares(np.array([r[c] for r in rows], float).reshape(len(rows), w)) for c, w in zip(("char_sums", "common_sums"), widths)]

    def limits(of: list[np.ndarray]) -> list[np.ndarray]:
        return [np.full(len(of[0]), how.most_chars), word_limits(of[1], how.most_words, how.most_of_plain, how.least_common)]

    near = limits(tables)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            own = [_matrix(batch.column(c), w) for c, w in zip(("chars", "commons"), widths)]
            distance, passes = np.full((2, len(langs)), np.nan), np.ones((2, len(langs)), bool)
            at = np.array([place.get(k, -1) for k in langs], np.int64)
            joined = np.asarray(batch.column("char_sums").is_valid()) if rest else np.zeros(len(langs), bool)
            for k, least in enumerate((how.least_chars, how.least_words)):
                some = np.nonzero(at >= 0)[0]
                distance[k, some], passes[k, some] = _against(own[k][some], tables[k][at[some]], near[k][at[some]], least)
                some = np.nonzero(joined)[0]
                if len(some):
                    theirs = [_shares(_matrix(batch.column(c).filter(pa.array(joined)), w).astype(float)) for c, w in zip(("char_sums", "common_sums"), widths)]
                    distance[k, some], passes[k, some] = _against(own[k][some], theirs[k], limits(theirs)[k], least)
            # the smallest distance; of a known language by classes alone, of an unknown one both histograms by one reference
            some = np.nonzero((at < 0) & ~joined)[0]
            if len(some) and len(rows):
                known = np.array([langs[i] is not None for i in some])
                each = [_against(own[k][some], table[:, None], limit[:, None], least) for k, (table, limit, least) in enumerate(zip(tables, near, (how.least_chars, how.least_words)))]
                each = [(d, p | known * (k == 1)) for k, (d, p) in enumerate(each)]
                passes[0, some] = (each[0][1] & each[1][1]).any(axis=0)
                distance[0, some] = each[0][0].min(axis=0)
                distance[1, some] = np.where(known, np.nan, each[1][0].min(axis=0))
            stay = ~np.asarray(batch.column("base_failed")) & passes.all(axis=0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in base), pa.array(stay), *(pa.array(d, from_pandas=True) for d in distance)], [*base, "kept", "char_distance", "word_distance"])

    if rest:
        others = refs.where(~F.col("lang").isin([r["lang"] for r in rows])).select(F.col("lang").alias("of"), "char_sums", "common_sums")
        found = found.join(others, F.col("lang") == F.col("of"), "left").drop("of")
    return found.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double")
