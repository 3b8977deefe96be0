"""Several values packed into one cell, one row per value.

The grammar (ordered choice, first match wins)::

    cell      <- ws? value? (divider value?)* end
    value     <- bracketed / quoted / bare
    bracketed <- JSON list, followed by a divider or the end
    quoted    <- '"' ('""' / [^"])* '"' ws? &(divider / end)
    bare      <- (inner quoted span / any character that is no divider)+

A quoted or bracketed alternative that does not close, or is followed by something other than a divider, fails and the
parser backtracks to ``bare`` at the same place, which leaves the text as written and raises the value's flag.

Which characters divide depends on the cell: ``|``, ``;``, tab and line breaks (and ``#`` for tags, blanks for tree
numbers) always do; a comma divides only in a cell with no other divider outside quotes.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, OPEN_QUOTE, STRAY_QUOTE, BAD_LIST = "ok", "open_quote", "stray_quote", "bad_list"

_RUNS = re.compile(r'"+')
_BLANKS = re.compile(r"[  ]*")
_DECODER = json.JSONDecoder()

#: Kinds of cells: characters that always divide, and whether the comma is one of them.
KINDS = {"terms": ("|;\t\r\n", False), "tags": ("|;\t\r\n#", False), "tree_numbers": ("|;\t\r\n  ", True)}


class Quotes:
    """Where the quotes of a cell close, from one pass over it, so that a long cell of open quotes isn't read again for each."""

    def __init__(self, cell: str):
        runs = [m.span() for m in _RUNS.finditer(cell)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]
        # the first run from i on with an odd number of quotes: pairs of quotes are text, what is left over closes
        self.odd = [len(runs)] * (len(runs) + 1)
        for i in range(len(runs) - 1, -1, -1):
            self.odd[i] = i if (runs[i][1] - runs[i][0]) % 2 else self.odd[i + 1]

    def close(self, at: int) -> int | None:
        """The position after the quote that closes the one at ``at``; None if none does. Where only pairs follow, the last
        pair's first quote closes."""
        i = bisect_right(self.starts, at) - 1
        left = self.ends[i] - at - 1
        if left % 2:
            return self.ends[i]
        if (j := self.odd[i + 1]) < len(self.ends):
            return self.ends[j]
        if i + 1 < len(self.ends):
            return self.ends[-1] - 1
        return self.ends[i] - 1 if left else None


class _Grammar:
    """The grammar for one set of dividing characters."""

    def __init__(self, strong: str, comma: bool, tags: bool):
        self.strong = set(strong)
        self.any = self.strong | {","}
        self.comma = comma
        self.tags = tags

    def values(self, cell: str) -> list[tuple[str, str]]:
        """The non-empty values with their flags, in order."""
        quotes = Quotes(cell)
        dividers = self.any if self.comma or not self._has_strong(cell, quotes) else self.strong
        out: list[tuple[str, str]] = []
        at = 0
        while at < len(cell):
            if cell[at] in dividers:
                at += 1
                continue
            at = _BLANKS.match(cell, at).end()
            if at >= len(cell) or cell[at] in dividers:
                continue
            found = self._bracketed(cell, at, dividers) or self._quoted(cell, at, dividers, quotes) or self._bare(cell, at, dividers, quotes)
            at, items, flag = found
            for item in items:
                item = item.strip()
                if self.tags:
                    item = item.strip("#").strip()
                if item:
                    out.append((item, flag))
        return out

    def _has_strong(self, cell: str, quotes: Quotes) -> bool:
        """Whether a divider other than the comma stands outside quotes and lists."""
        at = 0
        while at < len(cell):
            at = _BLANKS.match(cell, at).end() if " " not in self.strong else at
            if at >= len(cell):
                return False
            if cell[at] in self.strong:
                return True
            if cell[at] == ",":
                at += 1
                continue
            found = self._bracketed(cell, at, self.any) or self._quoted(cell, at, self.any, quotes) or self._bare(cell, at, self.any, quotes)
            at = found[0]
        return False

    def _closed(self, cell: str, at: int, dividers: set[str]) -> int | None:
        """Position after the blanks if a divider or the end follows there."""
        after = at if " " in dividers else _BLANKS.match(cell, at).end()
        return after if after == len(cell) or cell[after] in dividers else None

    def _bracketed(self, cell: str, at: int, dividers: set[str]):
        if cell[at] != "[":
            return None
        try:
            values, end = _DECODER.raw_decode(cell, at)
        except (ValueError, RecursionError):  # brackets too deep are no list
            return None
        if (after := self._closed(cell, end, dividers)) is None:
            return None
        return after, [v if isinstance(v, str) else json.dumps(v) for v in values if v is not None], OK

    def _quoted(self, cell: str, at: int, dividers: set[str], quotes: Quotes):
        if cell[at] != '"' or not (end := quotes.close(at)):
            return None
        if (after := self._closed(cell, end, dividers)) is None:
            return None
        return after, [cell[at + 1 : end - 1].replace('""', '"')], OK

    def _bare(self, cell: str, at: int, dividers: set[str], quotes: Quotes):
        start, flag = at, BAD_LIST if cell[at] == "[" else OK
        while at < len(cell) and cell[at] not in dividers:
            if cell[at] == '"':
                end = quotes.close(at) if at == start or cell[at - 1] in " ,([" else None
                if end and (end == len(cell) or cell[end] in self.any or cell[end] in " )]"):
                    flag = flag if flag != OK else STRAY_QUOTE
                    at = end
                    continue
                flag = flag if flag != OK else OPEN_QUOTE
            at += 1
        return at, [cell[start:at]], flag


@lru_cache(maxsize=None)
def _grammar(kind: str) -> _Grammar:
    strong, comma = KINDS[kind]
    return _Grammar(strong, comma, kind == "tags")


def parse_cell(cell: str | None, kind: str = "terms") -> list[tuple[int, str, str]]:
    """(position, item, flag) of each value of one cell; nothing for a null, empty or blank cell."""
    if not cell:
        return []
    return [(pos, item, flag) for pos, (item, flag) in enumerate(_grammar(kind).values(cell))]


_PARSED = "array<struct<pos:int,item:string,flag:string>>"
#: Cells repeat a lot; each batch parses a spelling once.
_MEMO = 50_000


def packed_values(cell: Column, kind: str = "terms") -> Column:
    """The values of a packed cell as an array of (pos, item, flag)."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")

    @F.pandas_udf(_PARSED)
    def parse(batches: pd.Series) -> pd.Series:
        memo: dict[str, list[dict]] = {}
        out = []
        for cell in batches:
            if cell is None:
                out.append([])
                continue
            if (got := memo.get(cell)) is None:
                got = [{"pos": p, "item": i, "flag": f} for p, i, f in parse_cell(cell, kind)]
                if len(memo) < _MEMO:
                    memo[cell] = got
            out.append(got)
        return pd.Series(out)

    return parse(cell)


def explode_packed(df: DataFrame, row_no: str, fields: dict[str, str], tbl: str) -> DataFrame:
    """One row per value of each packed field.

    ``fields`` maps a column to its kind ('terms', 'tags' or 'tree_numbers'). Columns out: tbl, row_no, field_name, pos,
    item, flag. Null, empty and blank cells have no rows; repeated rows and values are kept; other columns of ``df``,
    whatever their names, play no part. The work is a projection: nothing is shuffled.
    """
    parts = [F.struct(F.lit(name).alias("field_name"), packed_values(F.col(f"`{name}`"), kind).alias("parsed")) for name, kind in fields.items()]
    cells = df.select(F.lit(tbl).alias("tbl"), F.col(f"`{row_no}`").cast("bigint").alias("row_no"), F.array(*parts).alias("cells"))
    per_cell = cells.select("tbl", "row_no", F.explode("cells").alias("c")).select("tbl", "row_no", "c.field_name", F.explode("c.parsed").alias("v"))
    return per_cell.select("tbl", "row_no", "field_name", "v.pos", "v.item", "v.flag")
