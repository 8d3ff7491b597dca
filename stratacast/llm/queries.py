"""The queries opN_* over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratacast.llm.common import Scratch, documents
from stratacast.llm.conversations import repaired
from stratacast.llm.decontaminate import contained_items
from stratacast.llm.language import languages
from stratacast.llm.merkle import manifest
from stratacast.llm.near_duplicates import near_duplicates
from stratacast.llm.packing import packed
from stratacast.llm.quality_rules import quality
from stratacast.llm.repeated_passages import repeated_passages
from stratacast.llm.secrets import scan_secrets
from stratacast.llm.sharding import sharded
from stratacast.llm.substring_dedup import substring_dedup
from stratacast.llm.token_files import new_root, read_token_files, write_token_files
from stratacast.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

CONTAINED_SQL = rf"""
WITH texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), listed AS (
    SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS words FROM texts
), rows AS (
    SELECT side, id, unnest(list_distinct(list_transform(range(1, len(words) - 3),
        lambda i: array_to_string(words[i:i + 4], ' ')))) AS shingle FROM listed WHERE len(words) >= 5
), sizes AS (SELECT id, count(*) AS n FROM rows WHERE side = 'i' GROUP BY 1
), found AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found
    FROM rows d JOIN rows i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle GROUP BY 1, 2
)
SELECT doc_id, item_id, n_found, n AS n_shingles, CAST(n_found AS DOUBLE) / n AS containment
FROM found JOIN sizes ON item_id = id WHERE 100 * n_found >= 80 * n
"""


@query("op2_decontaminate", CONTAINED_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(documents(spark, folder), table(spark, folder, "benchmark"), size=5, percent=80)


@query("op8_repeated_passages")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(documents(spark, folder), min_words=50)


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), listed AS (
    SELECT doc_id, CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2),
             lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]))
    END AS shingles FROM texts
), sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM listed
), rows AS (SELECT doc_id, unnest(shingles) AS shingle FROM listed
), common AS (
    SELECT l.doc_id AS x, r.doc_id AS y, count(*) AS shared
    FROM rows l JOIN rows r ON l.shingle = r.shingle AND l.doc_id < r.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sizes
    UNION SELECT reach.x, l.y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON reach.y = l.x
), lowest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN lowest USING (doc_id)
"""


@query("op9_near_duplicates", NEAR_DUPLICATES_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), size=4, percent=80)


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packed(documents(spark, folder), path, capacity=2048, end_id=0, memo_bits=21)


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    root = new_root(spark)
    write_token_files(documents(spark, folder), root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, root)


@query("op3_language")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return languages(documents(spark, folder))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), table(spark, folder, "labels"))


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(documents(spark, folder), shards=8)


@query("op10_secrets")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(documents(spark, folder))


@query("op5_quality_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder), table(spark, folder, "labels"))


@query("op12_merkle_manifest")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(documents(spark, folder), Scratch(spark, "manifest"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "conversations"))


@query("op13_substring_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(documents(spark, folder), Scratch(spark, "substrings"), window=35)
