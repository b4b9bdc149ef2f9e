"""Repetition inside a single document by suffix arrays.

A text is read as its words in lower case; blanks, punctuation and numbers only part them,
and each character of a script written without blanks is a word. Only where a text has next
to no words are its numbers words. For a batch of texts a suffix array is built by prefix
doubling, never across texts, and the longest common prefixes of neighbouring suffixes
follow from the ranks of the doubling steps. An interval of the array whose prefixes have
at least ``min_words`` words holds the occurrences of a repeated passage. A shorter passage,
down to ``short_words`` words, is no mere turn of phrase where it occurs at least
``short_times`` times and makes up ``short_share`` of all words. All but the first
occurrence of a passage are marked, and the union of the marked spans, measured in
characters of the text, is the repeated share. Both that share and the longest repeat, as a
share of the words, are limited.

Defined results: null, empty and blank texts, and texts of punctuation alone, have share 0
and no repeat; repeated rows of an id come out once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a passage must have at least to count as a repeat; twice as many characters of unspaced scripts.
MIN_WORDS = 8
#: Words a short passage must have at least, its least number of occurrences and its least share of the words of the text.
SHORT_WORDS, SHORT_TIMES, SHORT_SHARE = 3, 10, 0.1
#: Numbers for each word from which on numbers are words themselves.
NUMBERS_A_WORD = 10
#: Share of the text that repeats, and share of the words in the longest repeat, from which a document counts as repetitive.
LIMIT, LONGEST_LIMIT = 0.4, 0.5
STEP_CHARS = 500_000
MEASURES = ("repeated_share", "longest_repeat", "longest_share")


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point (0 parts words, 1 in a word, 2 a word of its own, 3 in a number) and its lower case."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kind = np.zeros(0x110000, np.uint8)
    for number, pattern in ((1, r"[\p{L}\p{M}]"), (2, r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}ー々]"), (3, r"\p{N}")):
        kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = number
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in regex.findall(r"[\p{Lu}\p{Lt}]", every):
        if len(low := c.lower()) == 1:
            lower[ord(c)] = ord(low)
    return kind, lower


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: each word's number, document, place in its text, and whether its script is unspaced."""
    from tesserae.llm.bpe import _hashes, distinct

    kinds, lower = _tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    kind = kinds[codes]
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge[ends[ends < len(codes)]] = True
    starts = np.flatnonzero(edge)[:-1]
    stops = np.append(starts[1:], len(codes))
    hashed = _hashes(lower[codes], starts, stops)
    doc, sort = np.searchsorted(ends, starts, "right"), kind[starts]
    letters, numbers = (np.bincount(doc[k], minlength=len(texts)) for k in ((sort == 1) | (sort == 2), sort == 3))
    own = (sort > 0) & ((sort < 3) | (numbers >= NUMBERS_A_WORD * letters)[doc])
    starts, doc = starts[own], doc[own]
    number = distinct(hashed[:, own])[1]
    return number, doc, starts - np.append(0, ends)[doc], kind[starts] == 2


def suffix_array(number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all texts (suffixes end with their text, texts in order) and the prefix each shares with the one before."""
    n = len(number)
    span = int(number.max(initial=0)) + 1
    stop = np.searchsorted(doc, doc, "right")  # end of each suffix's text

    def ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        fresh = np.append(True, keys[order][1:] != keys[order][:-1])
        out = np.empty(len(keys), np.int64)
        out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
        return out

    rank = ranks(doc.astype(np.int64) * span + number)
    levels, step = [rank], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        after = active + step
        inside = after < stop[active]
        key = rank[active] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, old = key[order], rank[active[order]]
        at = np.arange(len(key))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        part = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        rank = rank.copy()
        rank[active[order]] = old + part - group
        levels.append(rank)
        step *= 2
        many = np.bincount(part, minlength=len(part))[part] > 1
        active = np.sort(active[order][many])
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    left, right = array[:-1], array[1:]
    shared = np.zeros(n, np.int64)
    got = shared[1:]
    for j in range(len(levels) - 1, -1, -1):
        a, b = left + got, right + got
        ok = (a < stop[left]) & (b < stop[right])
        same = ok & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        got += same.astype(np.int64) << j
    return array, shared


def repeated(texts: list[str], min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of it that repeats earlier text, and the words of its longest repeat."""
    return measures(texts, min_words, short_words)[:2]


def measures(texts: list[str], min_words: int = MIN_WORDS, short_words: int = SHORT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``repeated``, with the share of the words in the longest repeat, 0 where that is too short to count."""
    share, longest = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    number, doc, place, unspaced = words_of(texts)
    n = len(number)
    if not n:
        return share, longest, share
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.bincount(doc, minlength=len(texts))
    scale = np.where(np.bincount(doc, unspaced, len(texts)) * 2 > words, 2, 1)
    array, shared = suffix_array(number, doc)
    np.maximum.at(longest, doc[array], shared)
    cover = np.zeros(n + 1)
    for size in (min_words, *range(short_words, min_words)):
        least = (size * scale)[doc[array]]
        joined = shared >= least
        interval = np.cumsum(~joined)
        first = np.full(interval[-1] + 1, n, np.int64)
        np.minimum.at(first, interval, array)
        inside = joined | np.append(joined[1:], False)
        if size < min_words:
            times = np.bincount(interval[inside], minlength=interval[-1] + 1)[interval]
            inside &= (times >= SHORT_TIMES) & (times * least >= SHORT_SHARE * words[doc[array]])
        again = array[inside & (array != first[interval])]
        cover += np.bincount(again, minlength=n + 1) - np.bincount(np.minimum(again + (size * scale)[doc[again]], n), minlength=n + 1)
    marked = np.cumsum(cover)[:n] > 0
    last = np.append(doc[1:] != doc[:-1], True)
    weight = np.where(last, sizes[doc], np.append(place[1:], 0)) - place
    total = np.bincount(doc, weight, len(texts))
    part = np.where(longest >= min_words * scale, longest / np.maximum(words, 1), 0.0)
    return np.bincount(doc, weight * marked, len(texts)) / np.maximum(total, 1), longest, part


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key, repeated_share, longest_repeat`` (in words) and ``longest_share`` (of the words) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = [t or "" for t in batch.column(1).to_pylist()], 0, 0
            found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
            for i, t in enumerate(texts):
                size += len(t)
                if size >= STEP_CHARS or i == len(texts) - 1:
                    found.append(measures(texts[begin : i + 1], min_words))
                    begin, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], [key, *MEASURES])

    kinds = f"{key} {documents.schema[key].dataType.simpleString()}, repeated_share double, longest_repeat bigint, longest_share double"
    return documents.select(key, text).mapInArrow(run, kinds).groupBy(key).agg(*[F.max(c).alias(c) for c in MEASURES])


def repetitive(documents: DataFrame, limit: float = LIMIT, longest_limit: float = LONGEST_LIMIT) -> DataFrame:
    """Documents beyond either limit, of the share that repeats earlier text or of the longest repeat: ``doc_id``."""
    return repetition(documents).where((F.col("repeated_share") >= limit) | (F.col("longest_share") >= longest_limit)).select("doc_id")
