"""Documents to training tokens: quality, near duplicates, personal data, the mix of sources, byte-level BPE.

Every stage works on all rows of the one before, as written and read again. ``STAGES`` are ``(name, function)``; a function
takes ``(spark, docs, sf_dir)``. All but the last give the columns of ``documents``; the mix shows in the order of the rows
it is written in, and the last stage returns each document's place in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.base import stored, table
from cuewright.llm.bpe import encode_documents
from cuewright.llm.kneser_ney import keep_good
from cuewright.llm.minhash import similar_documents
from cuewright.llm.mixing import mixed, with_place
from cuewright.llm.pii import redact
from cuewright.llm.queries import vocabulary
from cuewright.llm.simhash import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above their language's threshold; those that cannot be judged stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, texts that share 0.8 of their runs of five words or more: the one with the least id."""
    return without_near_duplicates(docs, similar_documents, shingle=5, least=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixed stream, sources weighted by the root of their size."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of the ids and of the bytes decoded from them, and where it stands in the mixed stream.

    The stream is ordered by ``mix_slot``, ``mix_source`` and ``mix_place``. They are worked out from the same rows and by the same rule as in ``mix``, since the
    order of rows is lost where several files are read.
    """
    placed = with_place(docs.select("doc_id", "text", "source"), "mix_at")
    names = {"slot": "mix_slot", "source": "mix_source", "place": "mix_place"}
    placed = placed.select("doc_id", "text", *[F.col("mix_at")[a].alias(b) for a, b in names.items()])
    return encode_documents(placed, vocabulary(), ids=True, keep=tuple(names.values()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens),
]

# Trained models and a tokenizer have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
