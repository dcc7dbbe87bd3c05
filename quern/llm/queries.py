"""Queries of this package over the driver's tables; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracle
from quern.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    voters = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, voters).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.substring_dedup import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.common import fresh_path
    from quern.llm.tokens import read_tokens, write_tokens

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import report

    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    start = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), count_links=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import similar_documents
    from quern.llm.packing import numbered, packed, with_n_words

    docs = table(spark, sf_dir, "documents")
    # a cluster is a component of near copies; rows without a doc_id have none, so their exact copies are one
    near = similar_documents(docs).where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("__near"))
    rows = with_n_words(docs.select("doc_id", "source", F.xxhash64("text").alias("__copy"), "text"))
    rows = rows.join(near, rows["doc_id"].cast("long") == near["__id"], "left")
    cluster = F.coalesce(F.concat(F.lit("near "), F.col("__near")), F.concat(F.lit("copy "), F.col("__copy")))
    rows = numbered(rows.select("doc_id", "n_words", "source", cluster.alias("cluster")), "row")
    return packed(rows, F.col("n_words"), F.col("source"), F.col("cluster"), F.col("row")).drop("row")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii import KINDS, find

    found = find(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest": op4_nearest,
    "op5_tokens": op5_tokens,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_ngram_join": op8_ngram_join,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {"op3_substring_dedup": oracle.OP3, "op6_decontamination": oracle.OP6, "op7_licenses": oracle.OP7, "op8_ngram_join": oracle.OP8}
