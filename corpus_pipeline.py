"""The corpus pipeline: STAGES applied one after another to `documents`, each stage's rows written before the next reads them.

Every stage takes all rows that its predecessor kept and returns the columns of
documents; the last one adds mix_taken, the words that the mix takes of each row.
"""

from __future__ import annotations

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from tidemark.llm.shared import delete, fresh_path, own, scratch, table


def drop_toxic(spark, docs, sf_dir):
    """Documents below the toxicity threshold; the classifier learns from `docs` and labels."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Texts without lines that an earlier document has; documents that keep nothing go."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one_of_each(docs)


def drop_benchmark_copies(spark, docs, sf_dir):
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents that the weighted mix takes."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
]

#: No SQL: SQL can express neither the trained network nor the templates; tests plant cases for every stage; its operator's own tests compare with brute force or SQL, of the network only layers and scores.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied to documents; what a stage needed goes once its rows are written, and its rows once the next stage's are.

    The last stage's tables stay for the result; shared.sweep() deletes them."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            path = own(fresh_path(spark, name), outer=True)
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
