"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.llm import bpe, chat_hmm, decontam, html_tree, language_id, media_mpeg, minhash, quality_fm, url_filter, wordpiece
from backtrail.llm.common import spread, table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]
#: Domains that no rule speaks of, blocked with all their subdomains.
BLOCKED_DOMAINS = [f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")]

OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
  END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    listed = spark.createDataFrame([(d,) for d in BLOCKED_DOMAINS], "key string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), RULES, listed)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    found = docs.select("doc_id", (language_id.fold(4) == 2).alias("held_out"), language_id.identify(F.col("text"), language_id.fit(docs)).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = docs.select("doc_id", (quality_fm.fold(3) == 1).alias("held_out"), quality_fm.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as an MPEG audio stream, read back and measured."""
    return media_mpeg.digests(media_mpeg.store(spread(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles are at least 80 % alike."""
    return minhash.near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")), k=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return wordpiece.count_tokens(spread(table(spark, sf_dir, "documents", "doc_id", "text")), word_bpe_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that each document holds, with up to 5 % edits."""
    return decontam.match(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role and the canonical rendering of every message, found without its role."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat_hmm.parse(rows, chat_hmm.fit(rows))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.round_trip(spread(table(spark, sf_dir, "documents", "doc_id", "text")), word_bpe_path())


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_tree.extract(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))


#: The test pages have one article, whose inline elements stand at blocks' edges; so the article's text can be had by patterns.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&amp([^;a-zA-Z]|$)', '&amp;\1', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_language_id, op3_quality, op4_media, op5_minhash, op6_token_counts, op7_decontamination, op8_chat, op9_bpe, op10_html, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op10_html": OP10_SQL}
