"""Problem 3: items over a size limit cut into overlapping pieces at natural boundaries.

Content-defined chunking: a rolling hash over the last 32 characters marks landmarks. A cut goes to the first
landmark that leaves a piece of at least the minimum, moved to the nearest natural boundary (blank line, else
line end, else space) between the minimum and the maximum. As landmarks depend on nearby characters only, an
edit changes the pieces around it and leaves the others as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters under the rolling hash, and the mean distance of landmarks beyond the minimum.
WINDOW = 32
SPACING = 512

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("piece_text", T.StringType()),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("n_pieces", T.IntegerType()),
        ]
    )
)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """For each position the hash of the ``WINDOW`` characters that end there."""
    x = codes.astype(np.uint64)
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    h = x.copy()
    span = 1
    while span < WINDOW:  # doubling: the hash of 2n characters from two hashes of n
        h[span:] = h[span:] + (h[:-span] * np.uint64(pow(0x100000001B3, span, 1 << 64)) if len(h) > span else 0)
        span *= 2
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _nearest(places: np.ndarray, target: int, low: int, high: int) -> int | None:
    """The element of sorted ``places`` within ``low..high`` that is nearest to ``target``."""
    a, b = np.searchsorted(places, low), np.searchsorted(places, high, side="right")
    if a == b:
        return None
    k = int(np.searchsorted(places[a:b], target)) + a
    near = [int(places[i]) for i in (k - 1, k) if a <= i < b]
    return min(near, key=lambda p: (abs(p - target), p))


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the consecutive, disjoint parts of ``text``, the last of them its length.

    A part is at most ``limit - overlap`` long, so that a piece, which is a part with ``overlap``
    characters before it, stays within ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    n, most = len(text), limit - overlap
    least = max(1, most // 4)
    if n <= limit:
        return [n]
    codes = _codes(text)
    marks = rolling_hash(codes)
    found = np.flatnonzero(marks % np.uint64(SPACING) == 0) + 1
    line_ends = np.flatnonzero(codes == 10) + 1
    blanks = line_ends[1:][np.diff(line_ends) == 1] if len(line_ends) > 1 else line_ends[:0]
    spaces = np.flatnonzero((codes == 32) | (codes == 9) | (codes == 0xA0)) + 1
    ends, at = [], 0
    while n - at > (limit if not ends else most):
        low, high = at + least, at + (limit if not ends else most)
        k = int(np.searchsorted(found, low))
        mark = int(found[k]) if k < len(found) and found[k] <= high else low + int(np.argmin(marks[low - 1 : high]))
        cut = None
        reach = most // 8
        for places, within in ((blanks, reach), (line_ends, most), (spaces, most)):
            cut = _nearest(places, mark, max(low, mark - within), min(high, mark + within))
            if cut is not None:
                break
        at = cut if cut is not None else mark
        ends.append(at)
    return [*ends, n]


def split_text(text: str, limit: int, overlap: int, first_line: int, last_line: int | None = None) -> list[tuple]:
    """Pieces ``(piece_no, start_char, text, start_line, end_line)``; line numbers stay within ``last_line``."""
    pieces, begin = [], 0
    breaks = np.flatnonzero(_codes(text) == 10)
    cap = last_line if last_line is not None else 1 << 30
    for no, end in enumerate(cut_points(text, limit, overlap), 1):
        start = max(0, begin - overlap)
        body = text[start:end]
        first = first_line + int(np.searchsorted(breaks, start))
        last = first_line + int(np.searchsorted(breaks, max(start, end - 1)))
        pieces.append((no, start, body, min(first, cap), min(last, cap)))
        begin = end
    return pieces


def split_oversized(df: DataFrame, text: str, start_line: str, end_line: str, limit: int, overlap: int) -> DataFrame:
    """Each row of ``df`` whose ``text`` has more than ``limit`` characters, once per piece.

    Columns of ``df`` without ``text``, ``start_line`` and ``end_line``, then ``n_pieces, piece_no, start_char,
    piece_text, piece_start_line, piece_end_line``. Consecutive pieces share exactly ``overlap`` characters and
    no piece exceeds ``limit``. Rows of null, empty or short texts don't come out; a null ``start_line`` counts
    as 1; exact copies of a row come out as copies. Short rows never leave the JVM.
    """
    names = [f.name for f in PIECES.elementType]

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts, ends in batches:
            cut = [split_text(t, limit, overlap, int(s), None if pd.isna(e) else int(e)) for t, s, e in zip(texts, starts, ends)]
            yield pd.Series([[dict(zip(names, (*p, len(all_of_it)))) for p in all_of_it] for all_of_it in cut])

    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, start_line, end_line)]
    cut = pieces(F.col(text), F.coalesce(F.col(start_line), F.lit(1)), F.col(end_line))
    # every row has pieces; the outer form keeps the optimizer from splitting once more for a test of emptiness
    return (
        df.where(F.char_length(text) > limit)
        .select(*kept, F.explode_outer(cut).alias("__piece"))
        .select(
            *kept, "__piece.n_pieces", "__piece.piece_no", "__piece.start_char", "__piece.piece_text",
            F.col("__piece.start_line").alias("piece_start_line"), F.col("__piece.end_line").alias("piece_end_line"),
        )
    )


def aligned(df: DataFrame, window: int, overlap: int, limit: int) -> DataFrame:
    """Chunks ``id, repo_id, file_path, start_line, end_line, chunk_text`` with ``start_line`` at the first line of the text.

    The text of a window is stripped but its line numbers aren't moved, so one that begins with blank lines
    starts later than it says. Where lines are missing from a text of more than ``limit`` characters, the window
    before it, which shares ``overlap`` lines, tells how many were on top; without such a window they count as
    having been at the end. Only keys and the shared lines of whole windows move.
    """
    step, place = window - overlap, ["repo_id", "file_path", "start_line"]
    missing = F.col("end_line") - F.col("start_line") - F.length(F.regexp_replace("chunk_text", "[^\n]+", ""))
    first = F.trim(F.substring_index("chunk_text", "\n", 1))
    loose = df.where((F.char_length("chunk_text") > limit) & (missing > 0)).select(*place, "id", missing.alias("__missing"), first.alias("__first")).distinct()
    tail = F.transform(F.slice(F.split("chunk_text", "\n"), step + 1, overlap), lambda x: F.trim(x))
    before = (
        df.where((F.col("end_line") - F.col("start_line") + 1 == window) & (F.length(F.regexp_replace("chunk_text", "[^\n]+", "")) >= step))
        .select("repo_id", "file_path", (F.col("start_line") + step).alias("start_line"), tail.alias("__tail"))
    )
    blank = F.array_position(F.transform("__tail", lambda x: x != ""), True) - 1  # lines before the first one that isn't blank
    fits = (blank > 0) & (blank <= F.col("__missing")) & (F.get("__tail", blank.cast("int")) == F.col("__first"))
    shifts = loose.join(before, place).where(fits).groupBy(*place, "id").agg(F.min(blank).cast("int").alias("__shift"))
    moved = df.join(shifts, [*place, "id"], "left").withColumn("start_line", (F.col("start_line") + F.coalesce("__shift", F.lit(0))).cast("int"))
    return moved.select(*df.columns)


def limit_of(limits: DataFrame, name: str) -> tuple[int, int]:
    """Size and overlap of one named row of ``size_limits``."""
    row = limits.where(F.col("limit_name") == name).select("max_size", F.coalesce("overlap", F.lit(0)).alias("overlap")).first()
    if row is None:
        raise ValueError(f"size_limits has no row {name!r}")
    return int(row[0]), int(row[1])
