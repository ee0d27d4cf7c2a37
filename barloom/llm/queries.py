"""The queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, chat, decontam, langid, licenses, packing, pii, quality, runs, simhash, suffix_dedup, syncmers, whitening
from barloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark, d):
    return bpe.round_trip(read(spark, d, "documents"))


@query
def op2_language_id(spark, d):
    return langid.identify(read(spark, d, "documents"))


@query
def op3_license_scan(spark, d):
    return licenses.scan(read(spark, d, "documents"))


@query
def op4_decontamination(spark, d):
    """One row per document that holds benchmark items."""
    found = decontam.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), items.alias("item_ids"), F.min("edits").alias("min_edits"))


@query
def op5_pii(spark, d):
    found = pii.find(read(spark, d, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found")


@query
def op6_chat_format(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chats(rows.unionByName(more))
    seen = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return seen.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op7_token_packing(spark, d):
    return packing.pack(read(spark, d, "documents"))


@query
def op8_suffix_dedup(spark, d):
    return suffix_dedup.without_repeats(read(spark, d, "documents"), with_bytes=False)


@query
def op9_simhash(spark, d):
    return simhash.near_duplicates(read(spark, d, "documents"))


@query
def op10_quality(spark, d):
    return quality.assess(read(spark, d, "documents")).drop("rejected_by")


@query
def op11_fingerprints(spark, d):
    return syncmers.compare(read(spark, d, "documents"))


@query
def op12_whitening(spark, d):
    return whitening.whitened(read(spark, d, "embeddings"))


def _periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words from some place on repeat a block, in about a tenth of the documents; without a doc_id never."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


@query
def op13_periodic_runs(spark, d):
    return runs.find(read(spark, d, "documents"), edit=_periodic_tail)


ORACLES["op6_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
runs AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l'))
    + CASE WHEN opens THEN length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 7 + 7 ELSE 6 END AS chars
  FROM runs)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

ORACLES["op10_quality"] = r"""
WITH w AS (
  SELECT doc_id, text, row_number() OVER () AS r,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM again GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_caps
  FROM w LEFT JOIN repeats USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_caps > n_words) AS kept
FROM b"""
