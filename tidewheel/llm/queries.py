"""The registered query of each operator, over whole tables."""

from __future__ import annotations

from ..session import ship
from . import decontam, license, linededup, mix, passages, quality, rules, sigtree, toxicity, wrapper
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark, sf_dir):
    return linededup.digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mix.digest(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_substring_dedup(spark, sf_dir):
    return passages.digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark, sf_dir):
    return wrapper.digest(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark, sf_dir):
    return rules.digest(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_line_dedup,
        op3_mixing,
        op4_ngram_jaccard_join,
        op5_substring_dedup,
        op6_decontamination,
        op7_html_extraction,
        op8_quality_rules,
        op9_license_scan,
        op10_quality_classifier,
    )
}
