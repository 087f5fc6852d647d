"""AGG1, AGG2, AGG5, AGG6 and type checks: summaries over whole tables."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SECTION_TYPES
from ..functions.text import token_count
from .scan import Running, numbered, running

PROFILE_TYPES = ("part", "schedule", "chapter", "article", "section", "subsection",
                 "paragraph", "subparagraph")


def node_preview(sections: DataFrame) -> "F.Column":
    st = F.col("section_type")
    title = F.when(F.col("section_title") != "", F.concat(F.lit(" — "), F.col("section_title"))) \
             .otherwise(F.lit(""))
    return F.concat(F.lit("["), st, F.lit("] "), F.col("section_ref"), title)


def structure_profile(sections: DataFrame, preview_rows: int = 1) -> DataFrame:
    """AGG2/TOP4: per act, node count, count per type, and the preview of its
    first ``preview_rows`` nodes in document order.

    Counts are one partially-aggregated ``groupBy``; the preview uses
    ``min_by`` (n=1) or the chunked running ordinal (n>1), never a whole-act
    window.
    """
    st = F.col("section_type")
    counts = [F.count(F.lit(1)).alias("n_nodes")] + \
             [F.count_if(st == t).alias(f"n_{t}") for t in PROFILE_TYPES]
    if preview_rows == 1:
        return sections.groupBy("law_id").agg(
            *counts, F.min_by(node_preview(sections), F.col("seq")).alias("first_node"))
    ordered = running(sections, ["law_id"], "seq",
                      [Running("_ord", F.lit(1).cast("bigint"), "sum", inclusive=True)])
    head = (ordered.filter(F.col("_ord") <= preview_rows)
            .withColumn("_pv", node_preview(ordered))
            .groupBy("law_id")
            .agg(F.expr("listagg(_pv, '\\n') WITHIN GROUP (ORDER BY seq)").alias("first_nodes")))
    return sections.groupBy("law_id").agg(*counts).join(head, "law_id", "left")


#: fixed values: indentation steps of a node type in the structure preview
INDENT = {"part": 0, "schedule": 0, "chapter": 1, "section": 1, "article": 1, "subsection": 2, "paragraph": 3,
          "subparagraph": 4}
PREVIEW_CHARS = 60


def quoted(text: "F.Column") -> "F.Column":
    """A text in quotes as Python writes it: double ones where it holds single ones only;
    backslashes, tabs, carriage returns and no-break spaces escaped."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for ch, esc in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("\xa0", "\\xa0")):
        t = F.replace(t, F.lit(ch), F.lit(esc))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))) \
            .otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def structure_preview(sections: DataFrame, max_nodes: int = 80) -> DataFrame:
    """AGG2/TOP4: ``(law_id, list_no, line, n_more)``, the first ``max_nodes`` nodes of each
    act in document order, indented by type, with the first 60 characters of their text;
    ``n_more`` counts the act's nodes beyond.  Texts are cut before the rows move, and an
    act of any size is numbered by ranges.  Null refs and texts count as empty."""
    st = F.coalesce("section_type", F.lit(""))
    indent = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, n in INDENT.items() for x in (t, "  " * n)]), st), F.lit(""))
    title = F.when(F.col("section_title") != "", F.concat(F.lit(" — "), F.col("section_title"))).otherwise(F.lit(""))
    text = F.replace(F.left(F.coalesce("text_content", F.lit("")), F.lit(PREVIEW_CHARS)), F.lit("\n"), F.lit(" "))
    line = F.concat(indent, F.lit("["), st, F.lit("] "), F.coalesce("section_ref", F.lit("")), title, F.lit("  |  "), quoted(text))
    n = numbered(sections.select("law_id", "seq", line.alias("line")), ["law_id"], [F.col("seq")])
    more = n.groupBy("law_id").agg(F.greatest(F.count(F.lit(1)) - max_nodes, F.lit(0)).alias("n_more"))
    return n.filter(F.col("list_no") <= max_nodes).join(more, "law_id").select("law_id", "list_no", "line", "n_more")


def dup_refs(sections: DataFrame, types=("part", "schedule", "chapter")) -> DataFrame:
    """AGG6: refs that occur more than once per act and type."""
    return (sections.filter(F.col("section_type").isin(*types))
            .groupBy("law_id", "section_type", "section_ref")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def bad_types(sections: DataFrame) -> DataFrame:
    """Node types with counts and whether each is a known type."""
    return (sections.groupBy("section_type").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("valid", F.col("section_type").isin(*SECTION_TYPES)))


def status_summary(items: DataFrame, status: str = "status") -> DataFrame:
    """AGG1: how many items ended in each status (``ok``, ``skipped``, ``error:..``)."""
    return items.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def token_counts(docs: DataFrame, text: str, by: list[str], tokenizer=None) -> DataFrame:
    """AGG5: tokens per group.  Default tokenizer is the built-in word /
    punctuation split; ``tokenizer`` may be a Column -> Column (e.g. a
    pandas UDF around a model tokenizer)."""
    n = tokenizer(F.col(text)) if tokenizer is not None else token_count(text)
    return docs.groupBy(*by).agg(F.sum(n).cast("bigint").alias("n_tokens"),
                                 F.count(F.lit(1)).alias("n_docs"))


_TOKENIZERS: dict = {}


def make_token_counter(load, name: str = "tokenizer"):
    """AGG5: a pandas UDF ``text -> bigint`` token count around a user
    tokenizer (``load()`` returns ``str -> list``; loaded once per worker)."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        tok = _TOKENIZERS.get(name)
        if tok is None:
            tok = _TOKENIZERS[name] = load()
        return texts.fillna("").map(lambda t: len(tok(t))).astype("int64")
    return count
