"""Queries and SQL of the corpus operators, one query for each."""

from __future__ import annotations

from tidemark.llm import avi, decontaminate, langid, line_dedup, lm, mixing, near_dedup, secrets, toxicity, warc
from tidemark.llm.shared import table


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark, sf_dir):
    return warc.digest_pages(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_avi(spark, sf_dir):
    return avi.digest(table(spark, sf_dir, "documents"))


QUERIES = (op1_near_dedup, op2_decontaminate, op3_warc, op4_toxicity, op5_mix_sources, op6_line_dedup, op7_secrets, op8_lm_score, op9_language, op10_avi)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op1_near_dedup": near_dedup.ORACLE, "op3_warc": warc.ORACLE, "op5_mix_sources": mixing.ORACLE, "op6_line_dedup": line_dedup.ORACLE}
