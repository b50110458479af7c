"""The registered queries: each operator on the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.functions.cues import time_ms
from cuewright.functions.web import absolute_url, url_filename
from cuewright.ml import encoding, evaluate, features, linear, model, search
from cuewright.operators import actions, dataset, detect, render, stats
from cuewright.plans.clean import clean_files, clean_files_by_model, flagged_lines
from cuewright.session import shared_folder, stored
from cuewright.sinks import files as sink
from cuewright.sinks.committed import write_committed
from cuewright.sources import archives, corpus, pages
from cuewright.streaming import landing

from . import derived as D

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# ---- text functions -------------------------------------------------------------------


def _on_coded(spark, sf, expression):
    return D.coded_documents(spark, sf).select("doc_id", expression(F.col("text")).alias("text"))


@query
def doc_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: lines, and lines flagged by the full rule set."""
    return flagged_lines(D.documents(spark, sf), "doc_id")


@query
def strip_invisible(spark, sf):
    return _on_coded(spark, sf, T.strip_invisible)


@query
def strip_diacritics(spark, sf):
    return _on_coded(spark, sf, T.strip_diacritics)


@query
def fold_letters(spark, sf):
    return _on_coded(spark, sf, T.fold_letters)


@query
def nfkc(spark, sf):
    return _on_coded(spark, sf, T.nfkc)


@query
def letters_only(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.letters_only(F.col("text")).alias("text"))


@query
def normalize_lines(spark, sf):
    return corpus.document_lines(D.coded_documents(spark, sf), "doc_id").select(
        "doc_id", "pos", T.normalize(F.col("text")).alias("text")
    )


@query
def normalize_aggressive(spark, sf):
    return _on_coded(spark, sf, lambda c: T.normalize(c, aggressive=True))


@query
def clean_tags_pages(spark, sf):
    return D.pages(spark, sf).select("page_id", T.clean_tags(F.col("html")).alias("text"))


@query
def safe_filename(spark, sf):
    return D.pages(spark, sf).select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query
def url_filenames(spark, sf):
    name = url_filename(F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise("")),
                        F.col("page_id").cast("string"), F.lit("farsi"), F.lit("s1"))
    return D.pages(spark, sf).select("page_id", name.alias("file_name"))


@query
def cue_times(spark, sf):
    cues = corpus.explode_cues(corpus.parse(D.srt_files(spark, sf)))
    start, end = time_ms(F.col("start")), time_ms(F.col("end"))
    return cues.select("path", "pos", start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"))


@query
def display_cols(spark, sf):
    return render.display_cols(D.cues(spark, sf))


# ---- reading subtitles ----------------------------------------------------------------


@query
def decode_files(spark, sf):
    bytes_ = F.concat(F.encode(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), "UTF-8"), F.unhex(F.lit("FF")))
    path = F.concat(F.lit("d/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".VTT").when(F.col("doc_id") % 3 == 1, ".ssa").otherwise(".txt"))
    return corpus.decode_files(D.documents(spark, sf).select(path.alias("path"), bytes_.alias("content")))


@query
def srt_parse(spark, sf):
    return corpus.srt_cue_table(D.srt_files(spark, sf)).drop("raw")


@query
def vtt_parse(spark, sf):
    return corpus.vtt_cue_table(D.vtt_files(spark, sf)).drop("raw")


@query
def ass_parse(spark, sf):
    return corpus.ass_cue_table(D.ass_files(spark, sf)).drop("raw")


@query
def load_batch(spark, sf):
    """SRT and WebVTT files together, every SRT file given twice."""
    srt = D.srt_files(spark, sf)
    return corpus.batch_counts(corpus.load_batch(srt.union(srt).union(D.vtt_files(spark, sf))))


@query
def load_batch_table(spark, sf):
    """The files of ``load_batch`` as a stored table: each path's format and cues, contents read by address."""
    srt = D.srt_files(spark, sf)
    table = stored(srt.union(srt).union(D.vtt_files(spark, sf)), "files")
    batch = corpus.load_batch_table(table)
    last = F.element_at("cues", -1)["text"]
    return batch.select("path", "format", F.size("cues").alias("n_cues"), F.when(F.size("cues") > 0, last).alias("last_text"))


@query
def read_lines(spark, sf):
    """Documents as text files read by line."""
    folder = shared_folder(spark, "lines")
    D.documents(spark, sf).select("text").write.text(folder)
    return corpus.read_lines(spark, folder)


@query
def merge_texts(spark, sf):
    """Documents as whole texts, each cleaned of tags."""
    texts = D.documents(spark, sf).select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"))
    return corpus.merge_texts(texts)


@query
def text_corpus(spark, sf):
    """Documents written as one text file each, and read from their folder as whole texts, each cleaned of tags."""
    folder = shared_folder(spark, "texts")
    name = F.concat(F.lit(f"{folder}/"), "doc_id", F.lit(".txt"))
    given = D.documents(spark, sf).select(name.alias("path"), name.alias("out_path"), F.lit("txt").alias("format"), F.col("text").alias("content"))
    sink.write_files(given).write.format("noop").mode("overwrite").save()
    return corpus.read_text_corpus(spark, folder).select(T.base_name(F.col("path")).alias("name"), "text")


@query
def dropped_chunks(spark, sf):
    """Documents read as SRT make no cue, so every block of text is lost."""
    docs = D.documents(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.lit("srt").alias("format"), F.col("text").alias("content"))
    return corpus.dropped_chunks(docs)


@query
def archive_members(spark, sf):
    unpacked = stored(archives.unpack(archives.in_folder(D.archives(spark, sf), "farsi")), "members")
    members = archives.first_of_name(unpacked)
    return members.select("archive", "ordinal", "name", F.col("content").cast("string").alias("content"))


@query
def archive_errors(spark, sf):
    members = archives.unpack(archives.in_folder(D.archives(spark, sf), "farsi"))
    return archives.bad_archives(members).select("archive")


def _extracted(spark, sf):
    folder = shared_folder(spark, "archives")
    D.archive_files(spark, sf, folder)
    members, errors = archives.extract_first(archives.list_members(spark, folder))
    short = F.concat(F.lit("root/"), F.regexp_extract("archive", "[^/]+/[^/]+$", 0)).alias("archive")
    return members.select(short, "ordinal", "name", F.col("content").cast("string").alias("content")), errors.select(short)


@query
def extract_archives(spark, sf):
    """Archives in a folder: the first member of each name, found by the archives' directories."""
    return _extracted(spark, sf)[0]


@query
def extract_errors(spark, sf):
    """Archives in a folder that cannot be unpacked."""
    return _extracted(spark, sf)[1]


@query
def read_archives(spark, sf):
    """Archives in a folder unpacked whole: all members."""
    folder = shared_folder(spark, "archives")
    D.archive_files(spark, sf, folder)
    members = archives.read_archives(spark, folder)
    short = F.concat(F.lit("root/"), F.regexp_extract("archive", "[^/]+/[^/]+$", 0)).alias("archive")
    return members.filter("error IS NULL").select(short, "ordinal", "name", F.col("content").cast("string").alias("content"))


@query
def extract_links(spark, sf):
    return pages.extract_links(D.pages(spark, sf))


@query
def catalogue_links(spark, sf):
    return pages.catalogue_links(D.catalogue_pages(spark, sf))


@query
def absolute_urls(spark, sf):
    """Reference forms built of each page's own number."""
    n = F.col("page_id").cast("string")
    forms = F.array(F.concat(F.lit("/a/"), n), F.concat(F.lit("b"), n), F.concat(F.lit("../c"), n), F.concat(F.lit("?d="), n),
                    F.concat(F.lit("#e"), n), F.concat(F.lit("//h.net/"), n), F.concat(F.lit("https://i.org/"), n))
    rows = D.pages(spark, sf).select("page_id", "url", F.posexplode(forms).alias("pos", "ref"))
    return rows.select("page_id", "pos", absolute_url(F.col("url"), F.col("ref")).alias("url"))


@query
def extract_downloads(spark, sf):
    return pages.extract_downloads(D.download_pages(spark, sf), ["farsi", "english"], F.lit("show"))


# ---- detection ------------------------------------------------------------------------


@query
def detect_full(spark, sf):
    return detect.detect_rules(D.lines(spark, sf))


@query
def detect_planted(spark, sf):
    return detect.detect_rules(D.cues(spark, sf)).select("path", "pos", "text")


@query
def detect_lite(spark, sf):
    return detect.detect_rules(D.cues(spark, sf), ruleset="lite").select("path", "pos", "text")


@query
def detect_aggressive(spark, sf):
    return detect.detect(D.cues(spark, sf), aggressive=True).select("path", "pos", "text")


@query
def detect_conversations(spark, sf):
    """Turns of a conversation as cues."""
    return detect.detect_rules(D.conversations(spark, sf).withColumn(
        "text", F.concat("text", F.lit(" "), D.phrase(F.col("conv_id"), F.col("turn")))
    )).select("conv_id", "turn", "text")


@query
def keyword_filter(spark, sf):
    return detect.keyword_filter(D.lines(spark, sf), "ThE")


@query
def min_length(spark, sf):
    return detect.min_length(D.lines(spark, sf).withColumnRenamed("text", "clean_text"))


# ---- actions and writing --------------------------------------------------------------


def _marked(spark, sf):
    return detect.mark_rules(D.cues(spark, sf))


def _flagged(spark, sf):
    return detect.detect_rules(D.cues(spark, sf))


@query
def remove_ads(spark, sf):
    cues = D.cues(spark, sf)
    return actions.remove_cues(cues, D.decisions(detect.detect_rules(cues))).select("path", "pos", "text")


@query
def replace_fixed(spark, sf):
    cues = D.cues(spark, sf)
    return actions.replace_cues(cues, D.decisions(detect.detect_rules(cues)), "(removed)").select("path", "pos", "text")


@query
def replace_random(spark, sf):
    """Whether each cue holds one of the texts, and its text where it does not."""
    cues = D.cues(spark, sf)
    done = actions.replace_random(cues, detect.detect_rules(cues), D.REPLACEMENTS)
    drawn = F.col("text").isin(D.REPLACEMENTS)
    return done.select("path", "pos", drawn.alias("drawn"), F.when(~drawn, F.col("text")).alias("text"))


@query
def apply_edits(spark, sf):
    cues = D.cues(spark, sf)
    edits = cues.filter("pos % 5 = 0").select("path", "pos", F.concat(F.lit("edited: "), "text").alias("new_text"))
    return actions.apply_edits(cues, edits).select("path", "pos", "text")


@query
def only_decided(spark, sf):
    cues = D.cues(spark, sf)
    return actions.only_decided(detect.detect_rules(cues), D.decisions(cues)).select("path", "pos", "text")


@query
def skip_existing(spark, sf):
    docs = D.documents(spark, sf).select("doc_id", F.concat("source", F.lit("-"), "doc_id").alias("name"))
    return actions.skip_existing(docs, docs.filter("doc_id % 3 = 0"))


@query
def clean_list(spark, sf):
    return actions.clean(D.cues(spark, sf), "list").select("path", "pos", "text")


@query
def clean_remove(spark, sf):
    return actions.clean(D.cues(spark, sf), "remove").select("path", "pos", "text")


@query
def clean_replace(spark, sf):
    return actions.clean(D.cues(spark, sf), "replace", text="-").select("path", "pos", "text")


@query
def srt_roundtrip(spark, sf):
    return render.render_batch(corpus.parse(D.srt_files(spark, sf)))


@query
def vtt_rebuild(spark, sf):
    return render.render_batch(corpus.parse(D.vtt_files(spark, sf)))


@query
def ass_rebuild(spark, sf):
    return render.render_batch(corpus.parse(D.ass_files(spark, sf)))


@query
def rebuild_parts(spark, sf):
    """Flat cues back to files, in parts of eight cues, then joined."""
    files = D.srt_files(spark, sf)
    parts = render.rebuild(corpus.srt_cue_table(files), files, cues_per_part=8)
    return render.join_parts(parts)


@query
def clean_srt_files(spark, sf):
    """Whole files: parse, detect, remove, write back, name."""
    return clean_files(D.srt_files(spark, sf, planted=True), "remove", out_dir="out")


@query
def output_names(spark, sf):
    files = D.documents(spark, sf).select(F.concat(F.lit("in/"), "source", F.lit("/v1."), "doc_id", F.lit(".srt")).alias("path"))
    return sink.with_output_path(files)


@query
def ad_report(spark, sf):
    return render.ad_report(_flagged(spark, sf))


@query
def ad_report_console(spark, sf):
    return render.ad_report(_flagged(spark, sf), "console")


def _write_and_read(spark, sf, write):
    folder = shared_folder(spark, "files")
    given = D.srt_files(spark, sf)
    kept = corpus.srt_cue_table(given).filter("path NOT LIKE '%7.srt'")  # files without any cue are written too
    parts = sink.with_output_path(render.rebuild(kept, given, cues_per_part=8), folder)
    written = write(parts, folder, sink.with_output_path(given.select("path"), folder))
    read = corpus.read_corpus(spark, folder, "*.srt").select(T.base_name(F.col("path")).alias("name"), "content")
    # Spark's reader passes over files of no bytes
    names = written.select(T.base_name(F.col("out_path")).alias("name"), F.lit("srt").alias("format"))
    return names.join(read, "name", "left").select("name", "format", F.coalesce("content", F.lit("")).alias("content"))


@query
def written_files(spark, sf):
    """Cleaned files written one by one, and read again."""
    return _write_and_read(spark, sf, lambda parts, _, names: stored(sink.write_files(parts, names), "written"))


@query
def committed_files(spark, sf):
    """Cleaned files written by a job that is committed as a whole; those its list names, read again."""
    return _write_and_read(spark, sf, write_committed)


@query
def dataset_csv(spark, sf):
    """Samples written as CSV and read again."""
    folder = os.path.join(shared_folder(spark, "csv"), "samples")
    sink.write_dataset(dataset.build_dataset(D.lines(spark, sf), 1), folder, "csv")
    return corpus.read_dataset(spark, folder)


@query
def clean_stream(spark, sf):
    """SRT files cleaned as they arrive in a folder."""
    folder = shared_folder(spark, "stream")
    given = sink.with_output_path(D.srt_files(spark, sf, planted=True), f"{folder}/in", "")
    sink.write_files(given).write.format("noop").mode("overwrite").save()
    stream = landing.clean_stream(landing.landing_files(spark, f"{folder}/in", "*.srt"), f"{folder}/out", f"{folder}/state")
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(T.base_name(F.col("path")).alias("name"), "content")


# ---- counts and samples ---------------------------------------------------------------


@query
def batch_stats(spark, sf):
    marked = _marked(spark, sf)
    return stats.batch_stats(marked, D.decisions(marked))


@query
def batch_totals(spark, sf):
    return stats.batch_totals(detect.mark_batch(corpus.parse(D.srt_files(spark, sf, planted=True))))


@query
def ads_per_file(spark, sf):
    return stats.ads_per_file(_flagged(spark, sf))


@query
def ad_positions(spark, sf):
    return stats.ad_positions(_flagged(spark, sf), per_row=16).select(
        "path", "part", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")
    )


@query
def dedup_text(spark, sf):
    return dataset.dedup_text(D.lines(spark, sf).withColumnRenamed("text", "clean_text"))


@query
def build_dataset(spark, sf):
    lines = corpus.clean_lines(D.lines(spark, sf), "text")
    return dataset.build_dataset(lines, 1)


def _both(spark, sf):
    positive = dataset.build_dataset(detect.detect_rules(D.cues(spark, sf)).select("text"), 1)
    return dataset.union_datasets(positive, dataset.build_dataset(D.lines(spark, sf), 0))


@query
def union_datasets(spark, sf):
    return _both(spark, sf)


@query
def class_counts(spark, sf):
    return dataset.class_counts(_both(spark, sf))


@query
def shuffle_samples(spark, sf):
    return dataset.shuffle(_both(spark, sf))


@query
def stratified_split_exact(spark, sf):
    """Size of the test part of each class."""
    split = dataset.stratified_split(_both(spark, sf), exact=True)
    return split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query
def stratified_split(spark, sf):
    return dataset.stratified_split(_both(spark, sf))


# ---- classifier -----------------------------------------------------------------------


@query
def char_ngram_counts(spark, sf):
    return features.gram_counts(D.lines(spark, sf), 3, 4, column="text")


@query
def vocabulary(spark, sf):
    return features.vocabulary(D.lines(spark, sf), 2000, 3, 4, column="text")


def _rounded(weights):
    return weights.withColumn("weight", F.round("weight", 6))


def _turns(spark, sf):
    return D.conversations(spark, sf).select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("clean_text"))


@query
def tfidf_weights(spark, sf):
    return _rounded(features.tfidf_rows(_turns(spark, sf), "id", 3, 4))


@query
def tfidf_sublinear(spark, sf):
    return _rounded(features.tfidf_rows(_turns(spark, sf), "id", 3, 3, sublinear=True))


@query
def train_score(spark, sf):
    samples = dataset.stratified_split(D.samples(spark, sf))
    fitted = model.train(samples.filter("NOT is_test").select("clean_text", "label"))
    return model.score(samples.filter("is_test").select("clean_text", "label"), fitted)


@query
def detect_model(spark, sf):
    """Train on labelled documents, store, load, and flag the lines of all documents."""
    folder = shared_folder(spark, "model")
    model.save_model(model.train(D.samples(spark, sf)), folder, 0.6)
    fitted, threshold = model.load_model(folder)
    return detect.detect_model(D.lines(spark, sf), fitted, threshold)


@query
def clean_by_model(spark, sf):
    """Cleaned files by a model trained on rule hits."""
    fitted = model.train(_both(spark, sf))
    return clean_files_by_model(D.srt_files(spark, sf, planted=True), fitted, 0.5)


def _stored_model(spark, sf):
    """The model of fixed coefficients as it comes back from its folder."""
    folder = shared_folder(spark, "linear")
    linear.save_table(D.gram_model(spark, sf), folder)
    return linear.load_table(spark, folder)


@query
def linear_scores(spark, sf):
    """Scores of all conversation turns by a model stored as a table."""
    turns = D.conversations(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    scored = linear.linear_scores(turns, ["id"], _stored_model(spark, sf), "text")
    return scored.select("id", F.round("score", 6).alias("score"))


@query
def detect_linear(spark, sf):
    """Lines of all documents that a model stored as a table flags at its threshold."""
    marked = detect.mark_linear(D.lines(spark, sf), _stored_model(spark, sf), key=["doc_id", "pos"])
    return marked.filter("is_ad").select("doc_id", "pos", "text")


@query
def clean_linear(spark, sf):
    """Documents without the lines that a model stored as a table flags."""
    marked = detect.mark_linear(D.lines(spark, sf), _stored_model(spark, sf), key=["doc_id", "pos"])
    kept = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(~F.col("is_ad"), F.struct("pos", "text")))).alias("kept"), F.count_if("is_ad").alias("n_removed"))
    return kept.select("doc_id", "n_removed", F.array_join(F.col("kept.text"), "\n").alias("text"))


@query
def grid_search(spark, sf):
    _, table = search.grid_search(D.samples(spark, sf), {"C": [1.0, 5.0], "ngrams": [(3, 3), (3, 4)]})
    return table


@query
def gram_dictionary(spark, sf):
    """All grams of all documents with dense numbers by falling frequency."""
    documents = D.documents(spark, sf).select("doc_id", F.col("text").alias("clean_text"))
    counts = encoding.text_gram_counts(documents, ["doc_id"], 3, 4)
    return encoding.dictionary(encoding.frequencies(counts))


@query
def fold_dictionary(spark, sf):
    """The 2,000 most frequent grams outside of each of three folds of the documents, with their numbers and frequencies there."""
    documents = D.documents(spark, sf).select("doc_id", (F.col("doc_id") % 3).alias("fold"), F.col("text").alias("clean_text"))
    of_folds = stored(search.fold_frequencies(encoding.text_gram_counts(documents, ["doc_id", "fold"], 3, 3), 3), "fold-frequencies")
    parts = [encoding.dictionary(search.without_fold(of_folds, k), 2000).select(F.lit(k).alias("fold"), "*") for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query
def classification_report(spark, sf):
    report = evaluate.classification_report(D.predictions(spark, sf))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(D.predictions(spark, sf))


@query
def roc_auc(spark, sf):
    return evaluate.roc_auc(D.predictions(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query
def score_curve(spark, sf):
    return evaluate.score_curve(D.predictions(spark, sf)).select("score", "pos", "neg", "tp", "fp")


@query
def recall_threshold(spark, sf):
    best = evaluate.threshold_for_recall(D.predictions(spark, sf))
    return best.select("threshold", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))
