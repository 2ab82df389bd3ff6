"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, html, mixing, oracle, passages, pii, repair, search, secret_scan, simhash, toxicity, warc

#: Fixed for repeatable test results; a real key is a secret of its user.
PSEUDONYM_KEY = b"terraloom-test-key"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), keep=["doc_id"])
    return decontaminate.verdict(found).select(
        "_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.components(_table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
        for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.windows(turns))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = toxicity.fit(docs, _table(spark, sf, "labels"), toxicity.not_held_out())
    out = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("_row.doc_id", (~toxicity.not_held_out("_row.doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0).alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passages(_table(spark, sf, "documents"))


def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    out = html.extract(_table(spark, sf, "pages"), keep=["page_id", "url"])
    return out.select("_row.page_id", "_row.url", "_new.text", "_new.n_chars")


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    packages = warc.write(warc.typed(_table(spark, sf, "pages")), warc.new_folder(spark))
    return warc.read(warc.index(packages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(_table(spark, sf, "embeddings"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf, "documents"), PSEUDONYM_KEY, keep=["doc_id"])
    return out.select("_row.doc_id", "_new.*")


def op11_vector_code_compression(spark: SparkSession, sf: str) -> DataFrame:
    made = codes.fit(_table(spark, sf, "embeddings"))
    return codes.with_label_error(made.rows).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(codes.codebooks_digest(made.history[-1] if made.history else None)).alias("codebooks_sha256"))


def op12_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, sf, "documents"), keep=["doc_id"]))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.digests(repair.damage(_table(spark, sf, "conversations")), copies="copies")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline  # it builds on this module

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_simhash_near_dedup, op3_chat_formatting, op4_toxicity,
    op5_substring_dedup, op6_html_extraction, op7_warc, op8_exact_top_k, op9_mixing, op10_pii,
    op11_vector_code_compression, op12_secret_scans, op13_conversation_repair, pipeline)}
ORACLES = {
    "op1_benchmark_decontamination": oracle.OP1,
    "op3_chat_formatting": oracle.op3(chat.CONTROL, len(chat.TURN + chat.SAYS + chat.END), chat.BUDGET, chat.HISTORY),
    "op7_warc": oracle.OP7,
    "op8_exact_top_k": oracle.OP8,
    "op11_vector_code_compression": oracle.op11(8, 16, 6, 4096),
    "op13_conversation_repair": oracle.OP13,
}
