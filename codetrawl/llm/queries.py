"""The thin queries: each applies one operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier
from .collocations import collocations
from .decontaminate import contamination
from .html_text import extract_text
from .language_id import held_out, predict, train
from .line_dedup import drop_site_lines
from .oracle import ORACLE  # noqa: F401
from .packing import pack
from .quality_rules import judge
from .sharding import shard_documents
from .simhash import near_duplicates
from .spelling import spelling_variants, word_counts
from .suffix_dedup import without_repeats
from .url_filter import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# fixed values: the rules of the url query
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rated = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
    return quality_classifier.grade(docs, quality_classifier.train(docs, rated), keep=["doc_id"])


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), keep=["doc_id"])


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return predict(docs, train(docs), keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_verdicts(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"), keep=["doc_id"]).drop("rejected_by")


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(table(spark, sf, "documents"), keep=["doc_id"], digest=True)


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf, "documents"), typo_every=31))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


def op13_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages"), keep=["page_id", "url"])


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = drop_site_lines(table(spark, sf, "documents"), copies_once=True)
    return docs.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_html_text": op13_html_text,
}
