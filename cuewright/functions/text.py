"""Text normalisation as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE

# Invisible characters, Arabic diacritics, and letter folding.
INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}-\x{2069}\x{FEFF}\x{00AD}]"
DIACRITICS = r"[\x{064B}-\x{0652}\x{0670}]"
ARABIC_LETTERS = "يكةؤإأآىٱ"
PERSIAN_LETTERS = "یکهوااایا"

# The characters of the two classes.
DELETED = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x2060, 0x206A), 0xFEFF, 0xAD, *range(0x64B, 0x653), 0x670]))

# Every character Unicode counts as white space, for trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202F\u205F\u3000"
)

# Characters forbidden in file names.
UNSAFE_IN_NAMES = r'[\\/*?:"<>|]'


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's ``trim`` knows only blanks)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def fold_letters(c: Column) -> Column:
    """Arabic letter forms to their Persian counterparts."""
    return F.translate(c, ARABIC_LETTERS, PERSIAN_LETTERS)


def nfkc(c: Column) -> Column:
    """Unicode NFKC by the ICU library on Spark's own class path.

    Spark has no built-in for it. Calling ICU through ``reflect`` keeps the text in
    the JVM, where a Python UDF would ship every row to a worker and back.
    """
    return F.when(c.isNotNull(), _compose(c))


def _compose(c: Column) -> Column:
    """``nfkc`` of what is not null."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def letters_only(c: Column) -> Column:
    """Keep letters and white space."""
    return F.regexp_replace(c, rf"[^\p{{L}}{SPACE}]", "")


def normalize(c: Column, aggressive: bool = False) -> Column:
    """Invisible characters, diacritics, letter folding, NFKC, in this order.

    The order matters: presentation forms become plain Arabic letters only in the
    last step and are not folded. ``aggressive`` keeps letters and white space only.
    None of the steps touches ASCII, so ASCII text skips them; deleting and folding are
    one pass of ``translate``, because neither can produce characters of the other. The test
    for null is on the text as given, since one on the folded text would fold it twice.
    """
    folded = F.translate(c, ARABIC_LETTERS + DELETED, PERSIAN_LETTERS)
    done = F.when(c.isNull() | is_ascii(c), c).otherwise(_compose(folded))
    return letters_only(done) if aggressive else done


def _drop_enclosed(c: Column, opening: str, closing: str) -> Column:
    """Drop non-empty ``{...}``. What follows the last closing mark cannot match and is
    set aside, or each opening mark in it would be tried up to the end of the text."""
    tail = F.substring_index(c, closing, -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return F.concat(F.regexp_replace(head, rf"\{opening}[^{closing}]++{closing}", ""), tail)


def clean_tags(c: Column) -> Column:
    """Drop ``{...}`` and ``<...>``, make each run of white space one blank, trim."""
    c = _drop_enclosed(_drop_enclosed(c, "{", "}"), "<", ">")
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def safe_filename(c: Column) -> Column:
    return strip(F.regexp_replace(c, UNSAFE_IN_NAMES, "_"))


def unix_newlines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def time_range(start: Column, end: Column) -> Column:
    return F.concat_ws(" --> ", start, end)
