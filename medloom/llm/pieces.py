"""Cutting oversized texts at natural boundaries.

Every position between two characters has a boundary strength (paragraph, line, sentence, clause, white space, sentence mark
without a blank, none). A
sparse table over the strengths answers "strongest cut in this window, rightmost of equals" in constant time; the next
piece steps back by the overlap. A cut falls inside a run of visible characters only where the run itself is longer than
the limit, and then not between a letter and its accents where that can be avoided.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Strengths of a cut, weakest first: before a sign that belongs to the one before it, inside a run, after a mark that ends a
#: sentence without a blank, and at white space by what it divides. Cuts below WHITE are forced.
JOINED, INSIDE, MARK, WHITE, CLAUSE, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3, 4, 5, 6
_JOINED = regex.compile(r"\p{M}|\u200d|(?<=\u200d).|[\U0001f3fb-\U0001f3ff]", regex.S)
_MARKS = regex.compile(r"[。！？｡]+[」』”’）]*(?=\S)")
#: What a text with any of those has: it lies beyond the letters, punctuation and symbols of European texts.
_RARE = re.compile("[\u0300-\u1fff\u200d\u20d0-\u20ff\u2c00-\U0010ffff]")
_WHITE = re.compile(r"[ \t\r\n]+")
#: Characters a sparse table covers at once, so that its size doesn't grow with the text.
SPAN = 1 << 18


def strengths(text: str) -> np.ndarray:
    """Strength of the cut before each position 0..len(text)."""
    out = np.full(len(text) + 1, INSIDE, np.int8)
    if _RARE.search(text):
        out[[m.end() for m in _MARKS.finditer(text)]] = MARK
        out[[m.start() for m in _JOINED.finditer(text)]] = JOINED
    for match in _WHITE.finditer(text):
        start, end = match.span()
        out[start:end] = WHITE
        run = match.group()
        lines = run.count("\n") or run.count("\r")
        before = text[start - 1] if start else ""
        if start > 1 and before in "\"')»]":
            before = text[start - 2]
        kind = PARAGRAPH if lines > 1 else LINE if lines else SENTENCE if before and before in ".!?…" else CLAUSE if before and before in ",;:" else WHITE
        out[end] = kind
    return out


class StrongestCut:
    """Sparse-table range maximum over (strength, position)."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.strength, self.widest, self.base, self.levels = strength, widest, -1, []

    def _cover(self, low: int) -> None:
        self.base = low
        part = self.strength[low : low + SPAN + self.widest].astype(np.int64)
        level = part * (1 << 40) + np.arange(low, low + len(part))
        self.levels = [level]
        width = 1
        while 2 * width <= min(self.widest, len(level)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in low..high, both included, the rightmost of equals."""
        if low > high:
            return INSIDE, high
        if self.base < 0 or low < self.base or low > self.base + SPAN:
            self._cover(low)
        a, b = low - self.base, high - self.base
        k = (b - a + 1).bit_length() - 1
        best = int(max(self.levels[k][a], self.levels[k][b - (1 << k) + 1]))
        return best >> 40, best & ((1 << 40) - 1)


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, end, characters repeated from the piece before, cut inside a run) of each piece; one piece if it fits.

    Pieces have at most ``limit`` characters and cover the text. A piece repeats exactly ``overlap`` characters of the one
    before, or none where repeating them would force a cut that can be avoided, or the piece before is no longer than that.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, 0, False)]
    table = StrongestCut(strengths(text), limit + 1)
    out: list[tuple[int, int, int, bool]] = []
    start = last = 0
    while n - start > limit:
        high = start + limit
        late = max(last + 1, start + limit // 2)
        strength, cut = table.query(late, high)
        if strength < WHITE:
            strength, cut = table.query(last + 1, high)
        if strength < WHITE and start < last:
            start = last
            continue
        if strength < WHITE:
            strength, cut = table.query(late, high)
        out.append((start, cut, last - start, strength < WHITE))
        last = cut
        start = cut - overlap if cut - overlap > out[-1][0] else cut
    out.append((start, n, last - start, False))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Ordered pieces of the texts of ``df``.

    Columns out: item_id, piece_no, start, n_chars, n_overlap, forced[, piece]. Lengths are Unicode code points. Texts
    within the limit come out as one piece without passing through Python; empty and blank ones too. Null texts have no
    piece. Repeated rows are cut each for itself. No shuffle.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("item_id"), F.col(f"`{text}`").alias("piece")).filter("piece is not null")
    schema = "item_id string, piece_no int, start int, n_chars int, n_overlap int, forced boolean" + (", piece string" if with_text else "")

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (start, end, back, forced) in enumerate(cut_text(value, limit, overlap)):
                    for column, x in zip(columns, (item, no, start, end - start, back, forced, value[start:end] if with_text else None)):
                        column.append(x)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            n = 7 if with_text else 6
            names = ["item_id", "piece_no", "start", "n_chars", "n_overlap", "forced", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names=names[:n])

    small = rows.filter(F.length("piece") <= limit).select(
        "item_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.length("piece").alias("n_chars"), F.lit(0).alias("n_overlap"), F.lit(False).alias("forced"), *(["piece"] if with_text else [])
    )
    return small.unionByName(oversized(rows, limit).mapInArrow(run, schema))


def oversized(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    return rows.filter(F.length("piece") > limit)


def oversized_items(df: DataFrame, key: str, text: str, tbl: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tbl, item_id, cut) of each item longer than the limit: 'forced' if a piece had to end inside a run of visible
    characters, else 'boundary'. Only the flags of the pieces are shuffled."""
    pieces = split_oversized(df.filter(F.length(f"`{text}`") > limit), key, text, limit, overlap, with_text=False)
    flags = pieces.groupBy("item_id").agg(F.max("forced").alias("forced"))
    return flags.select(F.lit(tbl).alias("tbl"), "item_id", F.when(F.col("forced"), "forced").otherwise("boundary").alias("cut"))
