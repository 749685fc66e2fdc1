"""The training-data operators as registered queries: thin calls with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, spread


def vocabulary_path() -> str:
    import public_tokenizers

    return os.environ.get("LOOMWRIGHT_BPE", public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .edit_counts import edited_counts, standard_edits

    docs = _table(spark, sf_dir, "documents")
    return edited_counts(docs, standard_edits(F.coalesce(F.col("text"), F.lit(""))), vocabulary_path())


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transport import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lsh_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import document_scores

    return document_scores(_table(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import search

    return search(_table(spark, sf_dir, "embeddings"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perspectives import rotate

    return rotate(_table(spark, sf_dir, "conversations"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_click_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import attributed_sales

    return attributed_sales(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sales"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digests

    return line_digests(_table(spark, sf_dir, "documents"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .heap_lloyd import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .attribution import ORACLE as attribution
    from .heap_lloyd import oracle as heap_lloyd
    from .line_dedup import ORACLE as line_dedup
    from .perspectives import ORACLE as perspectives
    from .pii import ORACLE as personal_data

    return {"op5_personal_data": personal_data, "op8_perspective_rotation": perspectives, "op11_click_attribution": attribution, "op12_line_dedup": line_dedup, "op13_heap_lloyd": heap_lloyd()}
