"""The operators over their whole tables, with the columns that the driver's contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import crc_of_id, id_key, table
from tickframe.llm.labels import labelled_sample
from tickframe.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.token_store import read_documents, write_token_store

    path = work_dir(spark, "token_store")
    write_token_store(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.language import fit, language_column

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2)
    model = fit(docs.filter("NOT held_out"))
    return docs.select("doc_id", "held_out", language_column(model, F.col("text")).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.accepted")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    sample = labelled_sample(docs, labels.filter(~held_out), "quality", quality.SAMPLE)
    model = quality.fit(sample, quality.unlabelled_sample(docs, labels, quality.SAMPLE))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0
    model = toxicity.fit(labelled_sample(docs, labels.filter(~held_out), "toxic", toxicity.SAMPLE))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.periodic import periodic_runs, with_planted_periods

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", with_planted_periods(F.col("text"), crc_of_id(F.col("doc_id")))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.conversations import Repair, damaged

    talks = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(talks))
    ids = talks.select("conv_id").distinct().withColumn("talk", id_key(F.col("conv_id")))
    report = repair.report().withColumn("talk", id_key(F.col("conv_id"))).drop("conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(report, "talk", "left").join(repair.digests(), "talk", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickframe.llm.secret_scan import KINDS, fit, scan_documents

    found = scan_documents(table(spark, sf_dir, "documents"), fit())
    listed = lambda kept: F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    of = lambda kinds: F.filter("findings", lambda f: f["kind"].isin(kinds))
    return found.select("doc_id", *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS),
                        F.sha2(listed(of(KINDS)), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_token_store": op2_token_store,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversations": op12_conversations,
    "op13_secrets": op13_secrets,
}
