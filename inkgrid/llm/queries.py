"""Thin queries that apply the operators to whole tables, with the SQL for those that SQL can express."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import oracles
from inkgrid.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.decontaminate import overlaps

    out = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("window").cast("long").alias("window"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.secrets import scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    digest = F.sha2(joined("base"), 256).alias("base_sha256")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), digest, joined("spans").alias("spans"), F.size("links").cast("long").alias("n_links"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.text import fold
    from inkgrid.llm.toxicity import score

    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    ids = F.array_join(F.transform("evidence", lambda e: e.doc_id.cast("string")), ",")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), ids.alias("evidence"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkgrid.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded")
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/inkgrid/warc-{uuid.uuid4().hex}")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.lines import drop_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_boilerplate(docs, dropped="dropped")
    return out.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.llm.repeats import runs

    keepers = F.array_join(F.transform("keepers", lambda k: F.concat_ws(":", F.coalesce(k.doc_id.cast("string"), F.lit("")), k.n_words.cast("string"))), ",")
    return runs(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_units", "n_words", "kept_doc_ids", keepers.alias("keepers"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_|pipeline$", name)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    pipe = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return oracles.SQL | pipe
