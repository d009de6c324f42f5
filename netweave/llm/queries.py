"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netweave.llm import collocations, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import pii

    return pii.report(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import rules

    return rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


ROUND_TRIP_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import chat

    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", ROUND_TRIP_TEXT), (-7, 1, "assistant", ROUND_TRIP_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.format_conversations(given.unionByName(added))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import langid

    return langid.identify(table(spark, folder, "documents"))


def op5_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import kneser

    return kneser.score_documents(table(spark, folder, "documents"))


def op6_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import bpe

    return bpe.encode_documents(table(spark, folder, "documents"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import mixing

    return mixing.mix_by_source(table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedupe_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op9_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import parity

    return parity.components(table(spark, folder, "documents"))


def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import winnow

    return winnow.compare_with_next(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, folder, "documents"))


def op12_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import licences

    return licences.label_licences(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from netweave.llm import align

    return align.align_documents(table(spark, folder, "documents"))


QUERIES["op1_personal_data"] = op1_personal_data
QUERIES["op2_quality_rules"] = op2_quality_rules
QUERIES["op3_chat_round_trip"] = op3_chat_round_trip
QUERIES["op4_language_id"] = op4_language_id
QUERIES["op5_kneser_ney"] = op5_kneser_ney
QUERIES["op6_bpe_chunks"] = op6_bpe_chunks
QUERIES["op7_source_mixing"] = op7_source_mixing
QUERIES["op8_line_dedup"] = op8_line_dedup
QUERIES["op9_parity_join"] = op9_parity_join
QUERIES["op10_winnowing"] = op10_winnowing
QUERIES["op11_collocations"] = op11_collocations
QUERIES["op12_licence_scan"] = op12_licence_scan
QUERIES["op13_token_alignment"] = op13_token_alignment
ORACLES["op8_line_dedup"] = lines.ORACLE
ORACLES["op11_collocations"] = collocations.ORACLE
