"""Corpus operators for training-data pipelines. Nothing else in lociframe imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, fingerprints, hosts, ngramjoin, packing, periodic, quality, secrets, spelling, substrings, tokenfiles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_quality": quality.op2_quality,
        "op3_ngram_join": ngramjoin.op3_ngram_join,
        "op4_substrings": substrings.op4_substrings,
        "op5_packing": packing.op5_packing,
        "op6_token_files": tokenfiles.op6_token_files,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_near_embeddings": embeddings.op9_near_embeddings,
        "op10_url_filter": hosts.op10_url_filter,
        "op11_chat_format": chat.op11_chat_format,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngramjoin.ORACLE, "op4_substrings": substrings.ORACLE, "op9_near_embeddings": embeddings.ORACLE}
