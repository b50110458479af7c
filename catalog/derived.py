"""Inputs of the registered queries, derived by Spark from the given tables.

The tables hold Latin prose, so Arabic letters, presentation forms, invisible
characters and advertisement phrases are worked into every row of them: the work
grows with the tables. ``duckdb_sql`` derives the same inputs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import strip
from cuewright.ml.features import text_grams
from cuewright.ml.linear import LinearModel
from cuewright.session import spread
from cuewright.sources.corpus import document_lines, files_from_table, unroll

# Letters of the prose and what they are coded as: Arabic letters that fold to
# Persian, full-width capitals, an invisible character for "h", a diacritic for "d".
PLAIN = "aeioutnsr" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "hd"
CODED = "يكةؤإأآىٱ" + "".join(chr(ord(c) + 0xFEE0) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "\u200C" + "\u064E"
NORMAL = "یکهوااایا" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# One phrase is added to each line. Most fire a rule, the last ones are near misses.
PHRASES = [
    "https://a.org/x", "http://b", "www.site", "foo-bar.net", "sub.name.info", "me.too@mail.example", "@handle",
    "t.me/abc", "Telegram channel", "discord.gg/x", "instagram.com/y", "twitter.com/z", "youtube.com/w", "fb.com/v",
    "WhatsApp", "like and share", "Subscribe", "join us", "check  out", "click the link", "visit our", "donate",
    "Patreon", "free download", "buy now", "sponsor", "an ad", "promo", "subtitled by", "translation by", "sub by",
    "powered by", "OpenSubtitles", "دانلود", "زيرنويس فارسي", "ترجمه شده توسط", "كانال تلگرام", "اينستاگرام",
    "سابسين", "سابتايتل", "خريد آنلاين", "تبليغ", "حمايت مالي", "لايك و فالو", "عضويت در كانال", "براي دسترسي به زيرنويس",
    "با كليك روي لينك", "كد تخفيف", "تقديم مي كند", "دنبال كنيد", "كاري از", "تي وي", "ف\u0650يلم", "مووي", "زر",
    "۳۰نما", "30NAMA", "CinamaSub", "متر\u200Cجم", "آدرس سايت",
    "liked", "éfoo.com", "foo_bar.com", "joins us", "checkout", "adverb", "substandby", "@x", "a.b.c", "donated",
    "likely", "downloads", "buy", "visit them", "t.mex", "wwwx", "powered bye", "سلام", "کتاب", "promoted",
]

WORDS_TO_REVIEW = "the"
REPLACEMENTS = ["one", "two", "three"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; dealt out only where the session's caller names a number of partitions."""
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"), spark.conf.get("spark.cuewright.inputPartitions", None))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def coded_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.translate("text", PLAIN, CODED).alias("text"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document: (doc_id, pos, text)."""
    return document_lines(documents(spark, sf), "doc_id")


def phrase(doc_id: Column, pos: Column) -> Column:
    return F.get(F.array(*map(F.lit, PHRASES)), ((doc_id * 7 + pos) % len(PHRASES)).cast("int"))


def _time(seconds: Column, mark: str) -> Column:
    second = seconds.cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}000", F.floor(second / 3600) % 100, F.floor(second / 60) % 60, second % 60)


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a cue of the file ``doc-<id>.srt``, with a phrase added."""
    text = F.concat("text", F.lit(" "), phrase(F.col("doc_id"), F.col("pos")))
    return lines(spark, sf).select(
        F.concat(F.lit("doc-"), "doc_id", F.lit(".srt")).alias("path"),
        F.lit("srt").alias("format"),
        "pos",
        (F.col("pos") + 1).cast("string").alias("cue_index"),
        _time(F.col("pos") * 2, ",").alias("start"),
        _time(F.col("pos") * 2 + 1, ",").alias("end"),
        text.alias("text"),
        F.lit(None).cast("string").alias("raw"),
    )


def decisions(cues_: DataFrame) -> DataFrame:
    """A review that chose every other cue."""
    return cues_.filter("pos % 2 = 0").select("path", "pos")


def _text_lines(text: str = "text") -> Column:
    return F.filter(F.split(text, "\n"), lambda line: strip(line) != "")


def srt_files(spark: SparkSession, sf: str, planted: bool = False) -> DataFrame:
    """Each document as an SRT file of its non-blank lines."""
    def block(line: Column, i: Column) -> Column:
        if planted:
            line = F.concat(line, F.lit(" "), phrase(F.col("doc_id"), i))
        return F.concat(
            (i + 1).cast("string"), F.lit("\n"), _time(i * 2, ","), F.lit(" --> "), _time(i * 2 + 1, ","), F.lit("\n"), line
        )
    content = F.array_join(F.transform(_text_lines(), block), "\n\n")
    return _files(documents(spark, sf), ".srt", content)


def vtt_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a WebVTT file; odd cues have no index, every third has settings."""
    def block(line: Column, i: Column) -> Column:
        index = F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit("\n"))).otherwise("")
        settings = F.when(i % 3 == 0, " align:start").otherwise("")
        return F.concat(index, _time(i * 2, "."), F.lit(" --> "), _time(i * 2 + 1, "."), settings, F.lit("\n"), line)
    content = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(_text_lines(), block), "\n\n"))
    return _files(documents(spark, sf), ".vtt", content)


def ass_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as an ASS file; even events carry a tag, odd ones are comments, every fourth is written as SSA does."""
    def event(line: Column, i: Column) -> Column:
        second = i.cast("bigint")
        time = lambda s: F.format_string("%d:%02d:%02d.50", F.floor(s / 3600) % 10, F.floor(s / 60) % 60, s % 60)
        kind = F.when(i % 2 == 0, "Dialogue").otherwise("Comment")
        tag = F.when(i % 2 == 0, "{\\an8}").otherwise("")
        ssa = i % 4 == 3
        return F.concat(kind, F.when(ssa, ": Marked=0,").otherwise(": 0,"), time(second), F.lit(","), time(second + 1),
                        F.when(ssa, ",Default,,0000,0000,0000,,").otherwise(",Default,,0,0,0,,"), tag, line, F.lit("\\Nend"))
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    return _files(documents(spark, sf), ".ass", F.concat(F.lit(head), F.array_join(F.transform(_text_lines(), event), "\n")))


def _files(docs: DataFrame, suffix: str, content: Column) -> DataFrame:
    path = F.concat(F.lit("subs/"), "source", F.lit("/doc-"), "doc_id", F.lit(suffix))
    return files_from_table(docs.select(path.alias("path"), content.alias("content")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a score made of the key, higher on average for toxic texts."""
    score = ((F.col("doc_id") * 37 + F.col("toxic") * 400) % 1000) / 1000
    return labels(spark, sf).select(F.col("toxic").cast("int").alias("label"), score.alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as samples; the class is the label's quality."""
    text = documents(spark, sf).select("doc_id", F.col("text").alias("clean_text"))
    return text.join(labels(spark, sf), "doc_id").select("clean_text", F.col("quality").cast("int").alias("label"))


def gram_model(spark: SparkSession, sf: str) -> LinearModel:
    """A model with coefficients that any engine can work out: of every gram of three characters that labelled documents hold twenty times or more, the logarithm of
    how much oftener it stands in good ones."""
    labelled = documents(spark, sf).join(labels(spark, sf), "doc_id").select("doc_id", "text", "quality")
    counts = text_grams(labelled, 3, 3, ["doc_id", "quality"], "text")
    good, bad = (F.sum(F.when(F.col("quality") == q, F.col("tf")).otherwise(0)) for q in (1, 0))
    grams = counts.groupBy("gram").agg(good.alias("good"), bad.alias("bad"), F.count("*").alias("df")).filter("good + bad >= 20")
    n = labelled.count()
    idf = F.round(F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1, 6)
    weight = F.round(F.log((F.col("good") + 1.0) / (F.col("bad") + 1)), 6)
    return LinearModel(grams.select("gram", idf.alias("idf"), weight.alias("coefficient")), 3, 3, -0.5, threshold=0.55)


def _hrefs() -> Column:
    return F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))


def catalogue_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page, and behind its own markup its links as cards of a catalogue; every third card has no title."""
    def card(href: Column, i: Column) -> Column:
        title = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('<h3 dir="ltr"> No '), i.cast("string"), F.lit(" </h3>")))
        return F.concat(F.lit('<div class="sk-cell-l-3"><a class="sk-query" href="'), href, F.lit('">'), title, F.lit("</a></div>"))
    html = F.concat("html", F.lit("<body>"), F.array_join(F.transform(_hrefs(), card), "\n"), F.lit("</body>"))
    return pages(spark, sf).select("page_id", "url", html.alias("html"))


def download_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each page, and behind its own markup its links as download links: three language blocks, a season label before
    every second link except the first."""
    def link(href: Column, i: Column) -> Column:
        season = F.when((i > 0) & (i % 2 == 0), F.concat(F.lit('<p class="season">Season '), i.cast("string"), F.lit("</p>"))).otherwise("")
        return F.concat(season, F.lit('<li><a class="link" href="http://h.org'), href, F.lit('.zip?x=1">get</a></li>'))
    links = F.transform(_hrefs(), link)
    third = F.ceil(F.size(links) / 3).cast("int")
    block = lambda lang, n: F.concat(
        F.lit(f'<div class="box {lang}"><div class="head"><a class="link" href="/none">n</a></div><div class="body"><ul>'),
        F.array_join(F.slice(links, third * n + 1, third), ""), F.lit("</ul></div></div>"),
    )
    html = F.concat("html", F.lit('<div id="sk-download">'), block("english", 0), block("arabic", 1), block("farsi", 2), F.lit("</div>"))
    return pages(spark, sf).select("page_id", "url", html.alias("html"))


def archives(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into zip files of five, as (path, content BINARY); names repeat
    across archives, every third archive is in another folder, every tenth is broken."""
    import io
    import zipfile

    import pandas as pd

    docs = documents(spark, sf).select(
        F.floor(F.col("doc_id") / 5).alias("archive"), "doc_id", "text",
        F.concat(F.lit("dir/"), "source", F.lit("-"), F.col("doc_id") % 50, F.lit(".txt")).alias("name"),
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["archive"].iloc[0])
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as zipped:
            zipped.writestr("dir/", "")
            for row in group.sort_values("doc_id").itertuples():
                zipped.writestr(row.name, row.text)
        content = b"broken" if number % 10 == 9 else data.getvalue()
        folder = "english" if number % 3 == 0 else "Farsi"
        return pd.DataFrame({"path": [f"root/{folder}/part-{number:08d}.ZIP"], "content": [content]})

    return docs.groupBy("archive").applyInPandas(pack, "path STRING, content BINARY")


def archive_files(spark: SparkSession, sf: str, folder: str) -> None:
    """The archives as files below a folder."""
    from collections.abc import Iterator

    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                filesystem, path = fs.FileSystem.from_uri(f"{folder}/{row.path}")
                filesystem.create_dir(path.rpartition("/")[0])
                own = f"{path}.{uuid.uuid4().hex}.tmp"  # another attempt of the task replaces the file
                with filesystem.open_output_stream(own) as stream:
                    stream.write(row.content)
                filesystem.move(own, path)
                yield pd.DataFrame({"path": [row.path]})

    archives(spark, sf).mapInPandas(write, "path STRING").write.format("noop").mode("overwrite").save()
