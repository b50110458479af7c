"""Character n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE


def prepare(text: Column) -> Column:
    """Lower case; runs of two or more white-space characters become one blank."""
    return F.regexp_replace(F.lower(text), f"[{SPACE}]{{2,}}", " ")


def char_ngrams(text: Column, lo: int, hi: int, prepared: bool = False) -> Column:
    """All n-grams of ``lo`` to ``hi`` code points, as an array.

    A look-ahead captures the gram at each code point, so a text is walked once per
    size; cutting grams out by position would walk from the start for every gram.
    A text shorter than a size has no grams of it.
    """
    text = text if prepared else prepare(text)
    return F.concat(*(
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(lo, hi + 1)
    ))


def text_pieces(text: Column, hi: int, size: int = 65_536) -> Column:
    """A long text as an array of overlapping pieces that together have its n-grams.

    A piece has ``size`` code points plus the ``hi - 1`` that follow. Of the grams of a
    piece those that start in its first ``size`` code points belong to it, see
    ``piece_ngrams``.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + hi - 1}}})).{{1,{size}}}"), F.lit(1))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(parts)


def piece_ngrams(piece: Column, lo: int, hi: int, size: int = 65_536) -> Column:
    grams = lambda n: F.slice(F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), 1, size)
    return F.concat(*(grams(n) for n in range(lo, hi + 1)))
