"""Page geometry: how many image pages of which size a text would fill, in closed form or by walking wide glyphs.

Glyph coverage isn't part of this library: every assigned code point counts as
covered, and wide means East Asian Wide or Fullwidth.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the results to match.
PAD, MAX_W, MAX_H, PATCH = 4, 1568, 728, 28
CELLS = {"normal": (5, 8), "tiny": (4, 6)}
NEWLINE, NEWLINE_TOO, TAB, TAB_TOO, INDENT, INDENT_TOO = "↵", "⏎", "→", "⇢", "⇥", "⇨"
INDENTS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_INDENT, TAB_STOP = 3, 4


class Grid(NamedTuple):
    cw: int
    ch: int
    cols: int
    lines: int

    @property
    def chars(self) -> int:
        return self.cols * self.lines

    @property
    def full(self) -> int:
        """Full rows on a page: each but the first costs a separator too."""
        return min(self.lines, (self.chars + 1) // (self.cols + 1))


def grid(font: str) -> Grid:
    cw, ch = CELLS["tiny" if font.lower() == "tiny" else "normal"]
    return Grid(cw, ch, (MAX_W - 2 * PAD) // cw, (MAX_H - 2 * PAD) // ch)


def minified(text: Column) -> Column:
    """Without trailing spaces and tabs; four newlines or more become three."""
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+(?=\\n|\\z)", ""), "\\n{4,}", "\n\n\n")


def packed(text: Column) -> Column:
    """One line, losslessly: newlines, tabs and indents of 3 to 61 spaces as marks; marks in the text swapped before."""
    plain = F.translate(text, NEWLINE + TAB + INDENT, NEWLINE_TOO + TAB_TOO + INDENT_TOO)
    width = lambda x: F.length(x) - F.length(F.regexp_replace(x, "^ +", ""))

    def line(x: Column) -> Column:
        t = F.translate(x, "\t", TAB)
        n = width(t)
        return F.when((n >= MIN_INDENT) & (n < len(INDENTS)), F.concat(F.lit(INDENT), F.substring(F.lit(INDENTS), n + 1, F.lit(1)), F.substring(t, n + 1, F.lit(1 << 30)))).otherwise(t)

    return F.array_join(F.transform(F.split(minified(plain), "\n", -1), line), NEWLINE)


def unpacked(text: str) -> str:
    """The minified text that ``packed`` made, but for marks that were in it."""
    lines = text.split(NEWLINE)
    lines = [" " * INDENTS.index(x[1]) + x[2:] if x.startswith(INDENT) else x for x in lines]
    return "\n".join(lines).replace(TAB, "\t").replace(NEWLINE_TOO, NEWLINE).replace(TAB_TOO, TAB).replace(INDENT_TOO, INDENT)


def patches(w: Column, h: Column) -> Column:
    return (F.ceil(w / PATCH) * F.ceil(h / PATCH)).cast("long")


def estimate(docs: DataFrame, font: str = "normal") -> DataFrame:
    """doc_id, cells, pages, pixels, tokens, last_width, last_height of narrow texts, packed into one line.

    Rows are full but for the last, so pages follow from the number of cells alone.
    """
    g = grid(font)
    n = F.length(packed(F.col("text"))).cast("long")
    rows = docs.select("doc_id", n.alias("cells"))
    whole, rest = F.floor(F.col("cells") / g.cols), F.col("cells") % g.cols
    rows = rows.withColumns({"whole": whole, "rest": rest})
    # A short last row may share the page of as many full rows as one holds.
    slack = g.chars - (g.full * g.cols + g.full - 1) - 1
    shares = (F.col("whole") > 0) & (F.col("whole") % g.full == 0) & (F.col("rest") > 0) & (F.col("rest") <= slack) if g.full < g.lines else F.lit(False)
    some = (F.col("rest") > 0) | (F.col("whole") == 0)
    pages = F.floor((F.col("whole") + some.cast("int") + g.full - 1) / g.full) - F.when(shares, 1).otherwise(0)
    rows = rows.withColumn("pages", pages)
    last_full = F.col("whole") - (F.col("pages") - 1) * g.full
    height = 2 * PAD + (last_full + some.cast("int")) * g.ch
    width = F.when(last_full > 0, 2 * PAD + g.cols * g.cw).otherwise(2 * PAD + F.greatest(F.col("rest"), F.lit(1)) * g.cw)
    rows = rows.withColumns({"last_width": width.cast("long"), "last_height": height.cast("long")})
    w, h = F.lit(2 * PAD + g.cols * g.cw), F.lit(2 * PAD + g.full * g.ch)
    others = F.col("pages") - 1
    return rows.select(
        "doc_id", "cells", F.col("pages").cast("long").alias("pages"), (others * w * h + F.col("last_width") * F.col("last_height")).cast("long").alias("pixels"),
        (others * patches(w, h) + patches(F.col("last_width"), F.col("last_height"))).cast("long").alias("tokens"), "last_width", "last_height",
    )


def cell_width(c: str) -> int:
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


@lru_cache(maxsize=1)
def wide_glyph() -> re.Pattern:
    """Matches any code point of two cells."""
    wide = [i for i in range(0x1100, 0x40000) if cell_width(chr(i)) == 2]
    starts = [i for i, before in zip(wide, [-1, *wide], strict=False) if i != before + 1]
    ends = [i for i, after in zip(wide, [*wide[1:], -1], strict=True) if i != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]")


def is_narrow(line: str) -> bool:
    return line.isascii() or not wide_glyph().search(line)


def width(line: str) -> int:
    return len(line) if is_narrow(line) else sum(map(cell_width, line))


def expand_tabs(line: str) -> str:
    if "\t" not in line:
        return line
    out, col = [], 0
    for c in line:
        if c == "\t":
            span = TAB_STOP - col % TAB_STOP
            out.append(TAB + " " * (span - 1))
            col += span
        else:
            out.append(c)
            col += cell_width(c)
    return "".join(out)


def _minify(text: str) -> str:
    return re.sub("\n{4,}", "\n\n\n", "\n".join(x.rstrip(" \t") for x in text.split("\n")))


def packed_lines(text: str) -> list[str]:
    """The lines that ``NEWLINE`` joins when a text is packed into one."""
    text = text.replace(NEWLINE, NEWLINE_TOO).replace(TAB, TAB_TOO).replace(INDENT, INDENT_TOO)
    lines = [x.replace("\t", TAB) for x in _minify(text).split("\n")]
    for i, x in enumerate(lines):
        n = len(x) - len(x.lstrip(" "))
        if MIN_INDENT <= n < len(INDENTS):
            lines[i] = INDENT + INDENTS[n] + x[n:]
    return lines


def laid_out(text: str, g: Grid, reflow: bool = True, pack: bool = True) -> list[list[str]]:
    """Rows of each page."""
    if reflow and pack:
        text = NEWLINE.join(packed_lines(text))
    elif reflow:
        text = NEWLINE.join(expand_tabs(x) for x in _minify(text.replace(NEWLINE, NEWLINE_TOO)).split("\n"))
    rows: list[str] = []
    for line in _minify(text).split("\n"):
        line = expand_tabs(line)
        if is_narrow(line):
            rows += [line[i : i + g.cols] for i in range(0, len(line), g.cols)] or [""]
            continue
        row, used = [], 0
        for c in line:
            w = cell_width(c)
            if used + w > g.cols:
                rows.append("".join(row))
                row, used = [], 0
            row.append(c)
            used += w
        if row or not line:
            rows.append("".join(row))
    pages: list[list[str]] = []
    held = 0
    for row in rows:
        n = len(row) + 1
        if pages and len(pages[-1]) < g.lines and held + n <= g.chars:
            pages[-1].append(row)
            held += n
        else:
            pages.append([row])
            held = len(row)
    return pages


def page_sizes(pages: list[list[str]], g: Grid, pack: bool = True) -> list[tuple[int, int]]:
    full = 2 * PAD + g.cols * g.cw
    wide = lambda rows: min(g.cols, max(map(width, rows)))
    return [(max(2 * PAD + wide(p) * g.cw, 2 * PAD + g.cw) if pack else full, 2 * PAD + len(p) * g.ch) for p in pages]


def walked(docs: DataFrame, font: str = "normal", reflow: bool = True, pack: bool = True) -> DataFrame:
    """doc_id, pages, pixels, tokens, dims of any text: wide glyphs, tab stops and unpacked lines are walked one by one."""
    g = grid(font)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dim = pa.list_(pa.struct([("w", pa.int64()), ("h", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = [page_sizes(laid_out(t or "", g, reflow, pack), g, pack) for t in batch.column("text").to_pylist()]
            each = [[len(d), sum(w * h for w, h in d), sum(math.ceil(w / PATCH) * math.ceil(h / PATCH) for w, h in d)] for d in dims]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([e[i] for e in each], pa.int64()) for i in range(3)), pa.array([[{"w": w, "h": h} for w, h in d] for d in dims], dim)], names=["doc_id", "pages", "pixels", "tokens", "dims"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pages bigint, pixels bigint, tokens bigint, dims array<struct<w: bigint, h: bigint>>")


def _tokens(dims: list[tuple[int, int]]) -> int:
    return sum(math.ceil(w / PATCH) * math.ceil(h / PATCH) for w, h in dims)


def font_sizes(text: str) -> tuple[int, int, int]:
    """Pages and tokens at the normal cell size, and tokens at the tiny one, of a text that is packed.

    The rows of a narrow text follow from its length, so neither its one line nor its rows are made.
    """
    fonts = [grid("normal"), grid("tiny")]
    if is_narrow(text):
        lines = packed_lines(text)
        n = sum(map(len, lines)) + len(lines) - 1
        dims = [_narrow_sizes(n, g) for g in fonts]
    else:
        dims = [page_sizes(laid_out(text, g), g) for g in fonts]
    return len(dims[0]), _tokens(dims[0]), _tokens(dims[1])


def _narrow_sizes(n: int, g: Grid) -> list[tuple[int, int]]:
    """``page_sizes`` of one line of ``n`` narrow cells."""
    pages: list[list[int]] = []
    held = 0
    for at in range(0, max(n, 1), g.cols):
        row = min(g.cols, n - at)
        if pages and len(pages[-1]) < g.lines and held + row + 1 <= g.chars:
            pages[-1].append(row)
            held += row + 1
        else:
            pages.append([row])
            held = row
    return [(2 * PAD + max(*p, 1) * g.cw, 2 * PAD + len(p) * g.ch) for p in pages]
