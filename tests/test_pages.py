"""Links of stored pages on literal markup."""

import time
from html.parser import HTMLParser
import random

from pyspark.sql import functions as F

from cuewright.functions.web import inner_text, unescape
from cuewright.sources import pages


def page(spark, html):
    return spark.createDataFrame([(1, "http://h.org/d/p", html)], "page_id BIGINT, url STRING, html STRING")


def test_entities_and_text(apply):
    assert apply(unescape, ["a&#39;b&#x27;c&#8217;d&#X41;&nbsp;&amp;lt;", "&#0;&#55296;&#99999999;", "&#128512;", "plain", None]) == [
        "a'b'c’dA\u00A0&lt;", "��&#99999999;", "😀", "plain", None]
    assert apply(inner_text, ["<b> A </b> B", "x <i>y</i>\n", "&nbsp;<p>t</p>", ""]) == ["AB", "xy", "t", ""]


def test_links(spark):
    html = "<a href='/a'>One</a><a name=x>no</a><a class=k href=b.html> <b>Two</b> words</a><A HREF=\"#f\"></A><a href='/open'>"
    assert [(r.pos, r.text, r.url) for r in pages.extract_links(page(spark, html)).orderBy("pos").collect()] == [
        (0, "One", "http://h.org/a"), (1, "Twowords", "http://h.org/d/b.html"), (2, "Unknown", "http://h.org/d/p#f")]
    assert [r.url for r in pages.extract_links(page(spark, html), "k").collect()] == ["http://h.org/d/b.html"]


def test_season_labels_with_markup(spark):
    html = ('<div id="sk-download"><div class="farsi"><div class="body"><p class="season"><b>Season</b> 1</p><a class="link" href="http://x/a.zip">a</a>'
            '<p class="season"> Season &#50; </p><a class="link" href="http://x/b.zip">b</a></div></div></div>')
    rows = pages.extract_downloads(page(spark, html), ["farsi"], F.lit("n")).orderBy("pos").collect()
    assert [(r.season, r.file_name) for r in rows] == [("Season1", "a.zip"), ("Season_2", "b.zip")]


def links(spark, html, languages):
    rows = pages.extract_downloads(page(spark, f'<div id="sk-download">{html}</div>'), languages).orderBy("pos").collect()
    return [(r.lang, r.url[-1]) for r in rows]


def test_languages_are_independent(spark):
    block = lambda classes, inner: f'<div class="{classes}"><div class="body">{inner}</div></div>'
    a, b, c = (f'<a class="link" href="http://x/{n}">{n}</a>' for n in "abc")
    nested = block("english", a + block("farsi", b) + c)
    assert links(spark, nested, ["farsi", "english"]) == [("english", "a"), ("farsi", "b"), ("english", "b"), ("english", "c")]
    assert links(spark, block("box farsi english", a), ["farsi", "english"]) == [("farsi", "a"), ("english", "a")]
    # only the first block of a language, and only its body
    assert links(spark, block("farsi", a) + block("farsi", b) + f'<div class="english">{c}</div>', ["farsi", "english"]) == [("farsi", "a")]
    assert links(spark, block("farsinet", a), ["farsi"]) == []


class Cards(HTMLParser):
    """The rule on a tree: of every card its first descendant link of the wanted class, in the order of the cards."""

    def __init__(self):
        super().__init__()
        self.open, self.cards = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = attrs.get("class", "").split()
        if tag == "div":
            self.open.append(len(self.cards) if "sk-cell-l-3" in classes else None)
            if "sk-cell-l-3" in classes:
                self.cards.append(None)
        if tag == "a" and "sk-query" in classes:
            for i in self.open:
                if i is not None and self.cards[i] is None:
                    self.cards[i] = attrs.get("href", "")

    def handle_endtag(self, tag):
        if tag == "div" and self.open:
            self.open.pop()


def cards_of(spark, html):
    rows = spark.createDataFrame(list(enumerate(html)), "page_id BIGINT, html STRING").withColumn("url", F.lit("http://h.org/d/p"))
    out = [[] for _ in html]
    for r in sorted(pages.catalogue_links(rows).collect()):
        assert r.pos == len(out[r.page_id])
        out[r.page_id].append((r.text, r.url))
    return out


def test_a_card_ends_with_its_div(spark):
    link = lambda n, more="": f'<a class="sk-query" href="/{n}"><h3 dir="ltr">{n}</h3></a>{more}'
    card = lambda inner: f'<div class="x sk-cell-l-3">{inner}</div>'
    html = [
        card("<p>none</p>") + f"<div class=footer>{link('foot')}</div>",
        "</div></div>" + card(f"<div><div></div></div>{link('a')}{link('b')}") + link("c"),
        card(card(link("in")) + link("out")),
        card('<a class="sk-query"><h3 dir="ltr">no address</h3></a>' + link("late")) + card(link("z")),
        f'<div class="sk-cell-l-3">{link("open")}',
        "", None, link("alone"), f'<div class="sk-cell-l-33">{link("other")}</div>', card('<a class="sk-query" href="q">no title</a>'),
    ]
    assert cards_of(spark, html) == [
        [], [("a", "http://h.org/a")], [("in", "http://h.org/in")] * 2, [("z", "http://h.org/z")], [("open", "http://h.org/open")],
        [], [], [], [], [("Unknown", "http://h.org/d/q")]]


def test_cards_against_a_parser(spark):
    rng = random.Random(5)
    pieces = ["<div>", '<div class="sk-cell-l-3">', "</div>", "</div>", "<p>t</p>", "<a href=/n>n</a>"]
    html = ["".join(rng.choice(pieces + [f'<a class="sk-query" href="/{i}">t</a>', '<a class="sk-query">t</a>']) for i in range(rng.randint(0, 60))) for _ in range(150)]
    expected = []
    for text in html:
        parser = Cards()
        parser.feed(text)
        expected.append([f"http://h.org{h}" for h in parser.cards if h])
    assert [[url for _, url in found] for found in cards_of(spark, html)] == expected and sum(map(len, expected)) > 150


def test_many_links(spark):
    """Time in proportion: a page of 40,000 links."""
    anchors = "".join(f'<a class="link" href="/{i}.zip">t</a>' for i in range(40_000))
    started = time.time()
    rows = pages.extract_downloads(page(spark, f'<div id="sk-download"><div class="farsi"><div class="body">{anchors}</div></div></div>'), ["farsi", "english"])
    found = [r.url for r in rows.orderBy("pos").collect()]
    assert found == [f"/{i}.zip" for i in range(40_000)] and time.time() - started < 60
