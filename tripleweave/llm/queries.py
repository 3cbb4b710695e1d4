"""One query per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tripleweave.llm import (
    decontamination,
    mixing,
    periodic,
    phrases,
    ppm,
    quality,
    repeats,
    secrets,
    sharding,
    simhash,
    tokencounts,
    tokenfiles,
    urlrules,
)
from tripleweave.llm.registry import ORACLES, QUERIES, query
from tripleweave.llm.tables import source

__all__ = ["ORACLES", "QUERIES"]

# Fixed values of the queries' contracts.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
WEIGHTS = {"clean": 0.8, "poor": 0.2, "toxic": 0.0}
SHARDS = 40
END_ID = 2
TOKEN_LIMIT = 512


@query()
def op1_soft_mixing(spark, sf):
    return mixing.mix(source(spark, sf, "documents"), source(spark, sf, "labels"), WEIGHTS)


@query()
def op2_repeated_bytes(spark, sf):
    return repeats.remove_repeats(source(spark, sf, "documents"))


@query(
    """with p as (
         select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as raw,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
       h as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
       r(host, path, rule, verdict) as (values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
         ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
       f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
             from h, r where (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path) group by page_id)
       select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict from h left join f on h.page_id = f.page_id"""
)
def op3_url_rules(spark, sf):
    return urlrules.judge(source(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


@query(
    quality.SQL
    + """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, failed,
         (failed & 3) <> 0 as base_failed, failed = 0 as kept from f"""
)
def op4_quality_ledger(spark, sf):
    rows = quality.ledger(source(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "failed",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.POLICIES[quality.CURRENT]).alias("kept"),
    )


@query()
def op5_decontamination(spark, sf):
    return decontamination.leaks(source(spark, sf, "documents"), source(spark, sf, "benchmark"))


@query()
def op6_vector_shards(spark, sf):
    return sharding.shard(source(spark, sf, "documents"), SHARDS)


@query()
def op7_token_files(spark, sf):
    index = tokenfiles.write_sequences(source(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokenfiles.read_documents(index)


@query()
def op8_token_counts(spark, sf):
    docs = source(spark, sf, "documents")
    return tokencounts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


@query()
def op9_ppm_scores(spark, sf):
    return ppm.score(source(spark, sf, "documents"))


@query()
def op10_simhash(spark, sf):
    return simhash.near_duplicates(source(spark, sf, "documents"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers to read in place of a text's own: fixed by the contract for every tenth crc32."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < start, at, start + (at - start) % period)


@query()
def op11_periodic_runs(spark, sf):
    found = periodic.periodic_runs(source(spark, sf, "documents"), planted_order)
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        # Fits in long: a length is below 2 ** 31.
        F.call_function("div", F.lit(1000) * F.col("length"), F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(phrases.SQL)
def op12_collocations(spark, sf):
    return phrases.collocations(source(spark, sf, "documents"))


@query(secrets.SQL)
def op13_secrets(spark, sf):
    return secrets.digest(source(spark, sf, "documents"))
