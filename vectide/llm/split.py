"""Cutting oversized texts at natural boundaries with overlap.

Balanced targets: the least number of pieces that the limit allows is computed,
equal-length targets are placed, each is snapped to the strongest boundary near
it, and a piece is added whenever a limit fails.

Boundary strength: paragraph end 4, line end 3, sentence end 2, any other stop
of a clause 1.5, white space 1, none 0 (a forced cut).
A cut lies behind its boundary, so that pieces begin with text.

Semantics
* A text that is null, empty or not over the limit is no case and gives no piece.
* Piece 0 is ``text[0:c1]``; piece i is ``text[c_i - overlap : c_(i+1)]``; each is
  at most ``limit`` long and the pieces without their overlaps join to the text.
* Characters are code points. Cuts never fall between a base character and a
  following combining mark unless nothing else is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stops that count as places to cut, besides white space.
STOPS = ".,;:!?。，、；：！？"
SENTENCE = ".!?。！？"
_UNBROKEN = re.compile(rf"[^\s{re.escape(STOPS)}]+")


def longest_unbroken(text: str, limit: int) -> bool:
    """Whether a stretch longer than ``limit`` has neither white space nor a stop."""
    return any(m.end() - m.start() > limit for m in _UNBROKEN.finditer(text))


_BREAKS = re.compile(rf"\n\s*\n\s*|[\r\n]+\s*|[{re.escape(SENTENCE)}]+[\"'”’»)\]]*\s*|[{re.escape(STOPS)}]\s*|\s+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions a cut may take, ascending, and their strengths."""
    at, how = [], []
    for m in _BREAKS.finditer(text):
        s = m.group()
        lines = s.count("\n") + (0 if "\n" in s else s.count("\r"))
        strength = 4.0 if lines > 1 else 3.0 if lines == 1 else 2.0 if s[0] in SENTENCE else 1.5 if s[0] in STOPS else 1.0
        if s[0] in ".,:" and len(s) == 1 and m.end() < len(text) and text[m.end()].isdigit():
            strength = 0.5  # inside a number
        at.append(m.end())
        how.append(strength)
    return np.asarray(at, dtype=np.int64), np.asarray(how)


def _no_mark(text: str, cut: int, low: int) -> int:
    while cut > low and cut < len(text) and unicodedata.combining(text[cut]):
        cut -= 1
    return cut


def cut_points(text: str, limit: int, overlap: int) -> tuple[list[int], list[float]]:
    """Inner cuts of a text and the strength of each.

    With p pieces the cuts lie near ``i * len / p``. The window of cut i is what
    the limit leaves: not more than ``room`` behind the cut before it, and near
    enough to the end for the remaining pieces. In it the best boundary is the
    one of largest strength less its distance from the target, in quarter pieces.
    """
    n, room = len(text), limit - overlap
    if n <= limit:
        return [], []
    at, how = boundaries(text)
    pieces = 1 + -(-(n - limit) // room)
    while True:
        cuts, strengths, before = [], [], 0
        for i in range(1, pieces):
            target = i * n / pieces
            high = min(n - 1, before + (limit if i == 1 else room))
            low = max(before + max(1, overlap), n - (pieces - i) * room)
            if low > high:
                break
            lo, hi = np.searchsorted(at, low), np.searchsorted(at, high, side="right")
            if lo == hi:  # none where the others would still fit: any the limit allows
                lo = np.searchsorted(at, before + max(1, overlap))
                hi = np.searchsorted(at, high, side="right")
            if lo < hi:
                near = how[lo:hi] - np.abs(at[lo:hi] - target) / (0.25 * n / pieces)
                best = lo + int(near.argmax())
                cut, strength = int(at[best]), float(how[best])
            else:
                cut, strength = _no_mark(text, int(min(max(target, low), high)), before + 1), 0.0
            cuts.append(cut)
            strengths.append(strength)
            before = cut
        if len(cuts) == pieces - 1 and n - before <= room:
            return cuts, strengths
        pieces += 1


def split_pieces(text: str, limit: int, overlap: int) -> list[tuple[str, float]]:
    """(piece, strength of the cut before it) of an oversized text."""
    cuts, strengths = cut_points(text, limit, overlap)
    if not cuts:
        return []
    edges = [0, *cuts, len(text)]
    return [(text[max(0, a - (overlap if a else 0)) : b], s) for a, b, s in zip(edges, edges[1:], [4.0, *strengths])]


def split_oversized(df: DataFrame, item_id: str, text: str, limit: int, overlap: int = 60) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points.

    Columns: ``item_id STRING, piece INT, piece_text STRING, cut_strength DOUBLE,
    n_pieces INT, cut_kind STRING``. A row given again counts once (by id). Short
    texts are dropped by the scan before any Python runs. ``cut_kind`` is
    ``forced`` if the text has a stretch longer than the limit without any place
    to cut. Each row is worked on alone: nothing is gathered over rows.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half the limit")
    rows = (
        df.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("t"))
        .where(F.col("item_id").isNotNull() & (F.length("t") > limit))
        .dropDuplicates(["item_id"])
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, value in zip(frame.item_id, frame.t):
                kind = "forced" if longest_unbroken(value, limit) else "boundary"
                got = split_pieces(value, limit, overlap)
                out += [(key, k, piece, s, len(got), kind) for k, (piece, s) in enumerate(got)]
            yield pd.DataFrame(out, columns=["item_id", "piece", "piece_text", "cut_strength", "n_pieces", "cut_kind"])

    return rows.mapInPandas(run, "item_id string, piece int, piece_text string, cut_strength double, n_pieces int, cut_kind string")
