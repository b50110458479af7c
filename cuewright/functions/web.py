"""Links and names from stored web pages, as Column expressions over regular markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE
from .text import strip

_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag; null when the tag has none."""
    pattern = rf"""(?i)[{SPACE}/]{name}[{SPACE}]*=[{SPACE}]*(?:"([^"]*)"|'([^']*)'|([^{SPACE}"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    return F.when(tag.rlike(pattern), unescape(value))


# Named entities of titles and labels, ``&amp;`` last.
_NAMED = (("&nbsp;", "\u00A0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"),
          ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"))
_NUMBERED = "(?i)&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"


def unescape(c: Column) -> Column:
    """Numbered entities, and the named ones that occur in links and titles."""
    def char(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "(?i)&#x?([0-9a-f]+);", 1)
        number = F.when(entity.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\uFFFD")

    def resolved(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        return F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.concat(g, char(F.get(found, i)))).otherwise(g)), "")

    both = F.struct(F.split(c, _NUMBERED, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(_NUMBERED), F.lit(0)).alias("found"))
    c = F.when(c.contains("&#"), F.transform(F.array(both), resolved)[0]).otherwise(c)
    for entity, char_ in _NAMED:
        c = F.replace(c, F.lit(entity), F.lit(char_))
    return c


def has_class(tag: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(tag, "class"), f"[{SPACE}]+"), name), F.lit(False))


def inner_text(c: Column) -> Column:
    """Text without tags: each run of text between tags trimmed, then put together."""
    return F.array_join(F.transform(F.split(c, r"<[^>]*>", -1), lambda node: strip(unescape(node))), "")


def absolute_url(base: Column, href: Column) -> Column:
    """A reference resolved against the address of its page (RFC 3986)."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"\A([^#]*)", 1)
    no_query = F.regexp_extract(base, r"\A([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"\A(.*/)", 1))
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("/"), F.concat(origin, _remove_dots(href)))
        .otherwise(F.concat(origin, _remove_dots(F.concat(folder, href))))
    )


def _remove_dots(reference: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path; query and fragment stay."""
    path = F.regexp_extract(reference, r"\A([^?#]*)", 1)
    rest = F.substring(reference, F.length(path) + 1, F.length(reference))
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return (
            F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))
        )
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    resolved = F.concat(F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(resolved, rest)).otherwise(reference)


def url_filename(url: Column, name: Column, lang: Column, season: Column) -> Column:
    """Last path segment of the address, or ``name_lang_season.zip`` where that is empty."""
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    last = F.substring_index(path, "/", -1)
    built = F.concat(F.concat_ws("_", name, lang, season), F.lit(".zip"))
    return F.when(last != "", last).otherwise(built)
