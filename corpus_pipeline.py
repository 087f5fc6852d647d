"""The corpus pipeline: each stage is one operator of ``lexframe.llm``.

The quality classifier's rejects go, then lines found in ten documents or more, then
all but one document of each group of near copies, then bytes of passages that stand
earlier; what is left is packed into windows.
"""
from __future__ import annotations

from lexframe.llm import line_dedup, ngram_join, packing, quality_model, suffix_dedup
from lexframe.llm.common import Work, read_table, small_batches


def quality(spark, docs, sf_dir):
    return quality_model.without_rejected(docs, read_table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    small_batches(spark)
    return line_dedup.without_frequent_lines(docs)


def near_copies(spark, docs, sf_dir):
    small_batches(spark)
    return ngram_join.one_per_group(docs)


def passages(spark, docs, sf_dir):
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def windows(spark, docs, sf_dir):
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
          ("suffix-array dedup", passages), ("packing", windows)]

#: SQL can't express the classifier, the groups and the tokens; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, work = read_table(spark, sf_dir, "documents"), Work(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
