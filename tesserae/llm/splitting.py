"""Splitting oversized items at natural boundaries.

The size of a text is a prefix sum over its characters, one each for sizes in code
points; any other unit works with its own sums. Natural places are kept as sorted arrays
by strength: ends of paragraphs, lines, sentences, words. A piece ends at the strongest
place found by binary search under the limit, in the later half of what would fit, that
also lets the next piece begin at a word when it steps back by the overlap; failing that
at a natural place with a hard begin; failing that it is cut hard at the limit.

Defined results: a null text gives no pieces, a text within the limit one piece, an empty
one a single empty piece; an item of a kind without a limit is one piece; line ends stay
as they are, and a CR LF is not cut apart (the overlap is one longer there) unless a piece
has no other room; an overlap that is no less than the limit is an error; repeated rows of
an id come out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import bounded_rows

# What ends a paragraph, a line, a sentence and a word; the place is after the match.
PLACES = (
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"\r?\n|\r(?!\n)"),
    re.compile(r"[.!?…][\"')\]»”]*\s+|[。！？；]+"),
    re.compile(r"\s+|[，、,;]"),
)


def natural_places(text: str) -> list[np.ndarray]:
    """Sorted offsets of natural places, strongest kind first, each kind with those stronger than it."""
    found: list[np.ndarray] = []
    for pattern in PLACES:
        own = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        found.append(np.union1d(found[-1], own) if found else own)
    return found


def cut_points(text: str, limit: int, overlap: int, sums: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Begin and end of each piece. ``sums[i]`` is the size of ``text[:i]``; by default its characters.

    Raises where the overlap leaves no room for anything new in a piece.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"no pieces of at most {limit} with an overlap of {overlap}")
    n = len(text)
    sums = np.arange(n + 1) if sums is None else sums
    if sums[n] <= limit:
        return [(0, n)]
    kinds = natural_places(text)
    words = np.zeros(n + 1, bool)
    words[kinds[-1]] = words[0] = True
    # places that a piece may end at with the next one beginning at a word
    back = np.searchsorted(sums, sums - overlap, "left")
    paired = [k[words[back[k]] & (sums[k] - sums[back[k]] == overlap)] if overlap else k for k in kinds]
    pieces, begin = [], 0
    while sums[n] - sums[begin] > limit:
        last = int(np.searchsorted(sums, sums[begin] + limit, "right")) - 1
        least = begin + max(1, (last - begin) // 2, int(np.searchsorted(sums, sums[begin] + overlap, "right")) - begin)
        end = 0
        for places in (*paired, *kinds):
            k = int(np.searchsorted(places, last, "right")) - 1
            if k >= 0 and places[k] >= least:
                end = int(places[k])
                break
        if not end:
            end = last - (last > least and text[last - 1] == "\r" and text[last : last + 1] == "\n")
        pieces.append((begin, end))
        begin = max(begin + 1, int(back[end]))
        if text[begin - 1 : begin + 1] == "\r\n" and begin - 1 > pieces[-1][0]:
            begin -= 1
    return [*pieces, (begin, n)]


def _limits(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """Limit and overlap by kind; the table has a few fixed rows."""
    rows = bounded_rows(limits.select("item_kind", "max_size", "overlap_size"), 100)
    if rows is None:
        raise ValueError("size_limits is no small table")
    return {r[0]: (int(r[1]), int(r[2] or 0)) for r in rows if r[1] is not None}


SCHEMA = pa.schema([("item_kind", pa.string()), ("item_id", pa.int64()), ("piece_no", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("n_pieces", pa.int32()), ("text", pa.string())])


def split_items(items: DataFrame, limits: DataFrame, only_over: bool = False) -> DataFrame:
    """Pieces of ``item_kind, item_id, text``: ``item_kind, item_id, piece_no, char_start, char_end, n_pieces, text``."""
    sizes = _limits(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None or (only_over and (kind not in sizes or len(text) <= sizes[kind][0])):
                    continue
                pieces = cut_points(text, *sizes[kind]) if kind in sizes else [(0, len(text))]
                out += [(kind, item, k, a, b, len(pieces), text[a:b]) for k, (a, b) in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

    ddl = "item_kind string, item_id bigint, piece_no int, char_start int, char_end int, n_pieces int, text string"
    return items.select("item_kind", "item_id", "text").mapInArrow(run, ddl)


def items_of(excerpts: DataFrame, slices: DataFrame) -> DataFrame:
    """Texts of excerpts and windows, each row as it is."""
    return excerpts.select(F.lit("excerpt").alias("item_kind"), F.col("excerpt_id").alias("item_id"), "text").unionByName(
        slices.select(F.lit("window").alias("item_kind"), F.col("slice_id").alias("item_id"), "text")
    )


def pieces(excerpts: DataFrame, slices: DataFrame, limits: DataFrame, only_over: bool = True) -> DataFrame:
    """Pieces of every item (by default of those over their limit), each item once."""
    return split_items(items_of(excerpts, slices), limits, only_over).dropDuplicates(["item_kind", "item_id", "piece_no"])


def oversized(excerpts: DataFrame, slices: DataFrame, limits: DataFrame) -> DataFrame:
    """Items that the splitter cut: ``item_kind, item_id``."""
    cut = split_items(items_of(excerpts, slices), limits, only_over=True)
    return cut.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("item_kind", "item_id").distinct()
