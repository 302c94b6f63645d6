"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fairmix, filteraudit, langid, licenses, qda, quality, setsketch, sharding, simhash, spelling, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dict(_read(spark, sf_dir, "conversations").dtypes)
    planted = spark.createDataFrame(chat.PLANTED, "conv_id long, turn long, role string, text string")
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(planted.select(*[F.col(c).cast(kinds[c]) for c in planted.columns]))
    return chat.digests(chat.render(turns))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.learn(docs, ~langid.held_out()))


def op4_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairmix.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_simhash_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan(_read(spark, sf_dir, "documents")))


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.even_shards(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_setsketch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_copies(_read(spark, sf_dir, "documents"), 85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_prefix_targets": op2_chat_prefix_targets,
    "op3_language_codes": op3_language_codes,
    "op4_fair_queue_mix": op4_fair_queue_mix,
    "op5_warc_histories": op5_warc_histories,
    "op6_spaced_seed_overlaps": op6_spaced_seed_overlaps,
    "op7_simhash_deletion": op7_simhash_deletion,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_quality_discriminant": op9_quality_discriminant,
    "op10_best_fit_shards": op10_best_fit_shards,
    "op11_setsketch_classes": op11_setsketch_classes,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op2_chat_prefix_targets": chat.OP2_SQL,
    "op4_fair_queue_mix": fairmix.op4_sql(),
    "op5_warc_histories": warc.OP5_SQL,
    "op6_spaced_seed_overlaps": decontam.op6_sql(),
    "op8_license_diagonals": licenses.op8_sql(),
    "op11_setsketch_classes": setsketch.OP11_SQL,
    "op12_filter_audit": filteraudit.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
