"""Queries of the operators of this package and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import (
    bpe, collocations, decontaminate, divergence, fingerprint, langid, neardup, packing, pages, pii, secrets, substring, tokencount,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_secrets": secrets.op2_secrets,
    "op3_pages": pages.op3_pages,
    "op4_substring": substring.op4_substring,
    "op5_langid": langid.op5_langid,
    "op6_tokencount": tokencount.op6_tokencount,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_pii": pii.op8_pii,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_neardup": neardup.op10_neardup,
    "op11_divergence": divergence.op11_divergence,
    "op12_collocations": collocations.op12_collocations,
    "op13_packing": packing.op13_packing,
}
ORACLES: dict[str, str] = {
    "op2_secrets": secrets.SQL,
    "op4_substring": substring.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_neardup": neardup.SQL,
    "op11_divergence": divergence.SQL,
    "op12_collocations": collocations.SQL,
}
