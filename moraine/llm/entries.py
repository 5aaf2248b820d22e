"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import decontaminate, htmltext, linedup, mixing, neardup, quality, quotes, substring, tokens, warc
from .common import table


def queries() -> dict:
    return {
        "op1_near_dedup": lambda spark, d: neardup.query(table(spark, d, "documents")),
        "op2_quality_rules": lambda spark, d: quality.query(table(spark, d, "documents")),
        "op3_substring_dedup": lambda spark, d: substring.query(table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: linedup.query(table(spark, d, "documents")),
        "op5_chat_quotes": lambda spark, d: quotes.query(table(spark, d, "conversations")),
        "op6_decontamination": lambda spark, d: decontaminate.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_html_text": lambda spark, d: htmltext.query(table(spark, d, "pages")),
        "op8_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op9_warc": lambda spark, d: warc.query(table(spark, d, "pages")),
        "op10_token_ids": lambda spark, d: tokens.query(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": neardup.ORACLE, "op2_quality_rules": quality.ORACLE, "op3_substring_dedup": substring.ORACLE, "op4_line_dedup": linedup.ORACLE, "op5_chat_quotes": quotes.ORACLE, "op6_decontamination": decontaminate.ORACLE, "op8_mixing": mixing.ORACLE, "op9_warc": warc.ORACLE}
