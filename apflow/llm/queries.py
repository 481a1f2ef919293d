"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apflow.llm import (
    ann, bpe, cover_lloyd, folds, jaccard, language, lexical, mixing, quality, secret_scan, substrings, topk, url_filter, warc,
)
from apflow.llm.oracles import ORACLES
from apflow.operators.joins import fresh_folder, materialize

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
QUALITY_CUT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(folds.learned_from(F.col("doc_id"))))
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path()).select("doc_id", "ids")
    return bpe.decode(coded, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _every_50th() -> Column:
    return F.col("vec_id") % 50 == 0


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), _every_50th(), k=5, scale=256.0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, _table(spark, sf_dir, "labels"), folds.learned_from(F.col("doc_id")))
    return scored.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), _every_50th(), k=5)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, quantizer = cover_lloyd.compress(_table(spark, sf_dir, "embeddings"))
    digests = [F.when(F.col("length") == n, F.lit(quantizer.digest(n))) for n in quantizer.codebooks]
    return coded.select("vec_id", "code", "error", "label_error",
                        F.coalesce(*digests, F.lit(None).cast("string")).alias("codebooks_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"), k=20)


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.resolved(materialize(warc.read_archives(spark, folder, payloads=False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_ngram_jaccard_join, op3_source_mixing, op4_bpe, op5_exact_topk, op6_url_filter,
        op7_quality, op8_secrets, op9_ann, op10_substring_dedup, op11_vector_codes, op12_lexical_search,
        op13_warc_salvage)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
