"""Links and download tables from stored pages ``(page_id, url, html)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import absolute_url, attribute, has_class, inner_text, url_filename
from .corpus import unroll

# The markup of a catalogue.
CARD_CLASS = "sk-cell-l-3"
CARD_LINK_CLASS = "sk-query"
DOWNLOAD_ID = "sk-download"
BODY_CLASS = "body"
LINK_CLASS = "link"
SEASON_CLASS = "season"
UNKNOWN_TITLE = "Unknown"
UNKNOWN_SEASON = "unknown"

_ANCHOR = r"(?is)<a(?=[\s>]).*?</a\s*>"
# Up to the last closed anchor; an open one behind it would be tried to the page's end.
_CLOSED = r"(?is)\A.*</a\s*>"
_START_TAG = r"(?s)\A<[^>]*>"
_DOWNLOAD_TOKENS = (
    rf"(?is)<div(?=[\s>])[^>]*>|</div\s*>|<a\s[^>]*>|<p\s[^>]*{SEASON_CLASS}[^>]*>(?:.*?</p\s*>|[^<]*)"
)


def extract_links(pages: DataFrame, anchor_class: str | None = None) -> DataFrame:
    """Anchors of a page as ``(page_id, pos, text, url)``, without those that lack an href.

    The text falls back to ``Unknown``; the address is made absolute against the
    page's own. ``pos`` counts the kept anchors.
    """
    def link(anchor: Column) -> Column:
        tag = F.regexp_extract(anchor, _START_TAG, 0)
        href = attribute(tag, "href")
        wanted = F.lit(True) if anchor_class is None else has_class(tag, anchor_class)
        return F.struct(
            F.when(wanted, href).alias("href"),
            F.coalesce(F.nullif(inner_text(anchor), F.lit("")), F.lit(UNKNOWN_TITLE)).alias("text"),
        )
    anchors = F.regexp_extract_all(F.regexp_extract("html", _CLOSED, 0), F.lit(_ANCHOR), F.lit(0))
    links = F.filter(F.transform(anchors, link), lambda l: F.coalesce(l["href"], F.lit("")) != "")
    return unroll(pages, ["page_id", "url"], links, "pos", "link").select(
        "page_id", "pos", "link.text", absolute_url(F.col("url"), F.col("link.href")).alias("url")
    )


def gather(items: Column, start: Column, step: Callable[[Column, Column], Column], kept: str) -> Column:
    """Fold ``step`` over an array with a state that gathers an array in its field ``kept``; the gathered array.

    Appending copies what is there, so a plain fold takes the square of the array's length. Here a block of the cube root of that length fills an array of its own, and
    full arrays are appended as one entry each: n^(4/3) copies in all. ``start`` has ``kept`` empty and typed.
    """
    size = F.size(items)
    block = F.greatest(F.ceil(F.cbrt(size.cast("double"))).cast("int"), F.lit(1))
    firsts = F.when(size > 0, F.sequence(F.lit(1), size, block)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(firsts, lambda first: F.slice(items, first, block))
    empty = start[kept]

    def outer(acc: Column, of_block: Column) -> Column:
        done = lambda r: F.struct(r.withField(kept, empty).alias("state"), F.concat(acc["full"], F.array(r[kept])).alias("full"))
        return F.aggregate(of_block, acc["state"], step, done)

    nothing = F.slice(F.array(empty), 1, 0)
    return F.aggregate(blocks, F.struct(start.alias("state"), nothing.alias("full")), outer, lambda acc: F.flatten(acc["full"]))


def catalogue_links(pages: DataFrame) -> DataFrame:
    """Title and address of each card: the first link of the wanted class in it, if that has an address.

    A card ends where its ``div`` ends, so a link behind it is not its own; one that is not closed runs to the page's end. A card within another
    one is a card too, and both may have the same link. ``pos`` counts cards with links in the order in which the cards open.
    Closing tags without an open ``div`` are passed over. A null page has no card.
    """
    anchor = rf"<a(?=\s)(?=[^>]*{CARD_LINK_CLASS})[^>]*>.*?</a\s*>"
    tokens = F.regexp_extract_all(F.regexp_extract("html", _CLOSED, 0), F.lit(rf"(?is)<div(?=[\s>])[^>]*>|</div\s*>|{anchor}"), F.lit(0))

    def describe(token: Column, at: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, r"\A<(/?[A-Za-z]+)", 1))
        opening = F.regexp_extract(token, _START_TAG, 0)
        return F.struct(
            at.alias("at"), F.when(tag == "div", 1).when(tag == "/div", -1).otherwise(0).alias("level"),
            ((tag == "div") & has_class(opening, CARD_CLASS)).alias("is_card"),
            F.when((tag == "a") & has_class(opening, CARD_LINK_CLASS), token).alias("anchor"),
        )

    # cards that are open and have no link yet, with the depth at which each opened
    start = F.struct(
        F.lit(0).alias("depth"), F.array().cast("array<struct<at:int,depth:int>>").alias("open"),
        F.array().cast("array<struct<at:int,anchor:string>>").alias("links"),
    )

    def step(acc: Column, t: Column) -> Column:
        depth = F.greatest(acc["depth"] + t["level"], F.lit(0))
        card = F.array(F.struct(t["at"].alias("at"), depth.alias("depth")))
        still = F.when(t["is_card"], F.concat(acc["open"], card)).when(t["level"] < 0, F.filter(acc["open"], lambda o: o["depth"] <= depth)).otherwise(acc["open"])
        linked = t["anchor"].isNotNull()
        found = F.transform(acc["open"], lambda o: F.struct(o["at"].alias("at"), t["anchor"].alias("anchor")))
        return F.struct(
            depth.alias("depth"),
            F.when(linked, F.slice(acc["open"], 1, 0)).otherwise(still).alias("open"),
            F.when(linked, F.concat(acc["links"], found)).otherwise(acc["links"]).alias("links"),
        )

    def link(found: Column) -> Column:
        titles = r"""(?is)<h3(?=[^>]*\sdir\s*=\s*["']?ltr)[^>]*>(.*?)</h3\s*>"""
        title = F.regexp_extract(found["anchor"], titles, 1)
        return F.struct(
            attribute(F.regexp_extract(found["anchor"], _START_TAG, 0), "href").alias("href"),
            F.when(F.regexp_like(found["anchor"], F.lit(titles)), inner_text(title)).otherwise(UNKNOWN_TITLE).alias("text"),
        )

    # the tokens are described once
    links = F.transform(F.array(F.transform(tokens, describe)), lambda described: F.array_sort(gather(described, start, step, "links")))[0]
    cards = F.filter(F.transform(links, link), lambda c: F.coalesce(c["href"], F.lit("")) != "")
    return unroll(pages, ["page_id", "url"], cards, "pos", "card").select(
        "page_id", "pos", "card.text", absolute_url(F.col("url"), F.col("card.href")).alias("url")
    )


def extract_downloads(pages: DataFrame, languages: list[str], name: Column | None = None) -> DataFrame:
    """Download links of the wanted languages as
    ``(page_id, pos, lang, season, url, file_name)``.

    The season of a link is the nearest label before it anywhere on the page. Languages do not look at each other: of each
    the first ``div`` of its class in the section counts, also inside one of another language, and a ``div`` may be of several. Tags
    are taken as tokens, and folded over a page's token array once for each language; the state carries the nesting depth, the open block and
    the last season. A page stays one row, and its links are gathered by ``gather``.
    """
    tokens = F.regexp_extract_all("html", F.lit(_DOWNLOAD_TOKENS), F.lit(0))

    def describe(token: Column, at: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, r"\A<(/?[A-Za-z]+)", 1))
        opening = F.regexp_extract(token, _START_TAG, 0)
        class_list = F.coalesce(attribute(opening, "class"), F.lit(""))
        return F.struct(
            at.alias("at"),
            tag.alias("tag"),
            *[class_list.rlike(rf"(?<![\p{{L}}\p{{N}}_]){l}(?![\p{{L}}\p{{N}}_])").alias(f"is_{k}") for k, l in enumerate(languages)],
            F.coalesce(attribute(opening, "id") == DOWNLOAD_ID, F.lit(False)).alias("is_section"),
            has_class(opening, BODY_CLASS).alias("is_body"),
            F.when((tag == "a") & has_class(opening, LINK_CLASS), attribute(opening, "href")).alias("href"),
            F.when((tag == "p") & has_class(opening, SEASON_CLASS),
                   F.replace(inner_text(F.regexp_replace(token, _START_TAG, "")), F.lit(" "), F.lit("_"))).alias("season"),
        )

    none = lambda t: F.lit(None).cast(t)
    start = F.struct(
        F.lit(0).alias("depth"), none("int").alias("section"), none("int").alias("block"), none("int").alias("body"),
        F.lit(False).alias("done"), F.lit(UNKNOWN_SEASON).alias("season"),
        F.array().cast("array<struct<at:int,k:int,lang:string,season:string,href:string>>").alias("links"),
    )

    def fold(k: int, language: str):
        """``section``, ``block`` and ``body`` hold the depth at which each was opened;
        a body that was left is 0, since only the first of a block counts."""
        def step(acc: Column, t: Column) -> Column:
            opens, closes = t["tag"] == "div", t["tag"] == "/div"
            depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            left = lambda level, value: F.when(closes & (depth < level), value).otherwise(level)
            section = F.when(opens & t["is_section"] & acc["section"].isNull(), depth).otherwise(left(acc["section"], none("int")))
            new_block = opens & acc["section"].isNotNull() & ~acc["done"] & t[f"is_{k}"]
            new_body = opens & acc["block"].isNotNull() & acc["body"].isNull() & t["is_body"]
            season = F.coalesce(t["season"], acc["season"])
            link = F.struct(t["at"].alias("at"), F.lit(k).alias("k"), F.lit(language).alias("lang"), season.alias("season"), t["href"].alias("href"))
            linked = acc["block"].isNotNull() & (acc["body"] > 0) & (t["href"] != "")
            return F.struct(
                depth.alias("depth"),
                section.alias("section"),
                F.when(new_block, depth).otherwise(left(acc["block"], none("int"))).alias("block"),
                F.when(new_block, none("int")).when(new_body, depth).otherwise(left(acc["body"], F.lit(0))).alias("body"),
                (acc["done"] | new_block).alias("done"),
                season.alias("season"),
                F.when(linked, F.concat(acc["links"], F.array(link))).otherwise(acc["links"]).alias("links"),
            )
        return step

    def all_links(described: Column) -> Column:
        found = [gather(described, start, fold(k, l), "links") for k, l in enumerate(languages)]
        return F.array_sort(F.concat(*found))

    # the tokens are described once, whatever the number of languages
    links = F.transform(F.array(F.transform(tokens, describe)), all_links)[0]
    series = F.lit(None).cast("string") if name is None else name
    found = unroll(pages.withColumn("_name", series), ["page_id", "_name"], links, "pos", "link")
    lang, season, url = F.col("link.lang"), F.col("link.season"), F.col("link.href")
    return found.select(
        "page_id", "pos", lang.alias("lang"), season.alias("season"), url.alias("url"),
        url_filename(url, F.col("_name"), lang, season).alias("file_name"),
    )
