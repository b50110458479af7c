"""One query per operator, with production parameters over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.base import table
from cuewright.llm.bpe import encode_documents
from cuewright.llm.kneser_ney import judge
from cuewright.llm.lempel_ziv import fingerprints
from cuewright.llm.mask_search import ranked
from cuewright.llm.mixing import mix_documents
from cuewright.llm.periodic_runs import looped, periodic_runs, run_digests
from cuewright.llm.pii import find_pii
from cuewright.llm.sharding import shard_documents
from cuewright.llm.simhash import near_duplicates
from cuewright.llm.suffix_dedup import repeated_bytes
from cuewright.llm.universal_minima import near_copies
from cuewright.llm.vafile import nearest
from cuewright.llm.warc import archive_pages


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, its language's threshold, and whether it is kept."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document stands in the mixed stream; weights by the square root of a source's size."""
    docs = table(spark, sf_dir, "documents")
    return mix_documents(docs).drop("key")


def vocabulary() -> str:
    """Path of the rank file; its package is imported only where it is used."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them, and where its pre-tokens start."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary(), offsets=True)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives, with its place in the order of captures."""
    found = archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


def op8_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("removed")


def op9_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_lz_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document and its edited text, and how alike neighbours are."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_universal_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of sets of two-word shingles that share 0.8 of their union."""
    return near_copies(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("key")


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that rank highest for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to end in one, and the text without repetitions."""
    return run_digests(periodic_runs(looped(table(spark, sf_dir, "documents"))))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_kneser_ney, op2_boosted_pii, op3_simhash_trie, op4_va_file, op5_mix_sources, op6_byte_bpe, op7_warc_index, op8_induced_suffixes, op9_shard_ring,
    op10_lz_phrases, op11_universal_minhash, op12_mask_search, op13_basic_factors)}

# The others have no SQL form that DuckDB runs on whole tables; the tests hold them against brute force.
SQL: dict[str, str] = {
    "op4_va_file": """
      WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS i FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.i, c.i) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
      SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
      WHERE rank <= 10""",
    "op7_warc_index": r"""
      WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
          strlen(coalesce(html, '')) AS bytes, lower(regexp_replace(coalesce(url, ''), '#.*$', '')) AS u FROM pages),
      h AS (SELECT *, regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?]*)', 1) AS host, regexp_replace(u, '^[a-z][a-z0-9+.-]*://[^/?]*', '') AS rest FROM p),
      k AS (SELECT *, CASE WHEN host = '' THEN rest ELSE array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*\.|:80$', ''), '.')), ',')
          || ')' || rest END AS url_key, min(page_id) OVER (PARTITION BY digest) AS first FROM h)
      SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
        CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to, url_key,
        row_number() OVER (ORDER BY url_key, (page_id % 137438953472 + 137438953472) % 137438953472, md5(page_id || '|' || url || '|' || digest)) - 1 AS capture_no FROM k""",
    "op12_mask_search": r"""
      WITH d AS (SELECT row_number() OVER () AS r, doc_id,
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
      c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS words FROM d),
      p AS (SELECT r, term, any_value(n) AS n, count(*) AS tf FROM (SELECT r, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, term),
      w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(docs) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term),
      b AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
      i AS (SELECT q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
      s AS (SELECT q, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS score
        FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY q, r HAVING score > 0),
      k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) JOIN b USING (q))
      SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 20""",
}
