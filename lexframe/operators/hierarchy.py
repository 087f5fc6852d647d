"""WIN1-WIN4, WIN10, SCL19, AGG4, JN1: typed rows -> section table.

The reference walks rows with a stack.  Here the same tree comes out of
running aggregates over ``(law_id, row_no)``:

* WIN1 parent: the nearest earlier node of lower rank, i.e. the latest of
  the "last node of rank r" values for r < rank (a node of lower rank is
  never popped before a later one of lower-or-equal rank replaces it);
* WIN3 current section: latest section/article event, part/schedule reset;
* WIN4 node group: latest node at or before the row;
* WIN2 position: running count of nodes per ``(law_id, parent_seq)``;
* WIN10 breadcrumb: the last-of-rank values that are later than every
  last node of smaller rank are exactly the nodes on the stack.

All of them are ``max(struct(row_no, ..))`` or counts, so they run through
:func:`lexframe.operators.scan.running`, which splits one huge act over
many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import MAX_RANK
from .classify import classify_rows, is_enacting
from .scan import DEFAULT_CHUNK_ROWS, Running, chunked, running

SECTION_COLUMNS = ["law_id", "seq", "section_type", "section_ref", "section_title",
                   "text_content", "position", "parent_seq", "parent_ref"]


def _node(rank_filter: Column) -> Column:
    return F.when(rank_filter, F.struct(F.col("row_no").alias("s"), F.col("rank").alias("k"),
                                        F.col("raw_ref").alias("r")))


def _compound(cur: Column, n: Column) -> Column:
    """SCL19: ``{current.ref}({n})`` or ``({n})`` with no current section."""
    return F.concat(F.coalesce(cur, F.lit("")), F.lit("("), n, F.lit(")"))


def _display_ref(node: Column, cur: Column) -> Column:
    """Final ref of a stacked node; subsections get their compound ref."""
    return F.when(node["k"] == 3, _compound(cur, node["r"])).otherwise(node["r"])


def scan_nodes(classified: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, gate: bool = True,
               partitioned: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Running state for every classified row (nodes and continuation rows).

    Adds ``_last1.._last4`` (latest node of that rank before the row),
    ``_cur`` (latest section event), ``_grp`` (latest node at or before) and,
    with ``gate``, ``_first`` (the act's first enacting row if it comes before
    the row).  The enactment gate (WIN5) needs no pass of its own: a row
    takes part iff ``_first`` is set, and a remembered node counts iff it
    comes after ``_first`` (if the latest node of a rank is before the gate,
    so are all earlier ones).  The raw cells ``c1``/``c2`` are read by the
    scan expressions and then dropped (``node_title``/``node_text`` carry
    their content), so the text is materialized once, not twice; ``drop``
    names more columns the caller does not need (e.g. ``node_text``).
    """
    st = F.col("section_type")
    specs = [Running(f"_last{r}", _node(F.col("rank") == r), late=True) for r in range(1, MAX_RANK)]
    event = (F.when(st.isin("section", "article"),
                    F.struct(F.col("row_no").alias("s"), F.col("raw_ref").alias("r")))
              .when(st.isin("part", "schedule"),
                    F.struct(F.col("row_no").alias("s"), F.lit(None).cast("string").alias("r"))))
    specs.append(Running("_cur", event, late=True))
    specs.append(Running("_grp", F.when(st.isNotNull(), F.col("row_no")), inclusive=True, late=True))
    if gate:
        # first enacting row strictly before: max of -row_no
        specs.append(Running("_negfirst", F.when(is_enacting(F.col("c2")), -F.col("row_no"))))
    out = running(classified, ["law_id"], "row_no", specs, chunk_rows, materialize=True,
                  partitioned=partitioned, drop=tuple(c for c in ("c1", "c2", *drop) if c in classified.columns))
    if not gate:
        return out.withColumn("_first", F.lit(None).cast("bigint")).withColumn("_gated", F.lit(True))
    first = -F.col("_negfirst")
    out = out.withColumn("_first", first).withColumn("_gated", F.col("_negfirst").isNotNull()).drop("_negfirst")
    after = lambda c: F.when(c.isNotNull() & (c["s"] > F.col("_first")), c)
    for r in range(1, MAX_RANK):
        out = out.withColumn(f"_last{r}", after(F.col(f"_last{r}")))
    out = out.withColumn("_cur", after(F.col("_cur")))
    return out.withColumn("_grp", F.when(F.col("_grp") > F.col("_first"), F.col("_grp")))


def build_sections(rows: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                   with_breadcrumb: bool = False, gate: bool = True, with_text: bool = True,
                   text_chars: int | None = None, with_title: bool = True) -> DataFrame:
    """Statute rows ``(law_id, row_no, c1, c2)`` -> one row per node
    (``SECTION_COLUMNS``).

    Rows are shuffled once by ``(law_id, chunk)`` and classified after the
    shuffle (SCL18, full parallelism, narrow shuffle).  With ``gate``
    (default) rows up to the first enacting row are skipped (WIN5) inside
    the same scan; pass ``gate=False`` for rows already gated.

    ``with_text=False`` gives the structure only (no ``text_content``): the
    row text is dropped before the first checkpoint and the per-node text
    aggregate (a shuffle of the whole corpus) is skipped, since every node
    row is its own group; ``with_title=False`` drops the titles (no
    ``section_title``) there too.  ``text_chars`` gives that many first characters of
    ``text_content``: each row's text is cut to as many before the first
    checkpoint (the start of a joined text needs no more of any piece).
    """
    rows = rows.filter(F.col("c2").isNotNull() & (F.col("c2") != ""))
    classified = classify_rows(chunked(rows, ["law_id"], "row_no", chunk_rows))
    if text_chars is not None:
        classified = classified.withColumn("node_text", F.left("node_text", F.lit(text_chars)))
    unread = (() if with_text else ("node_text",)) + (() if with_title else ("node_title",))
    scanned = scan_nodes(classified, chunk_rows, gate, partitioned=True, drop=unread).filter(F.col("_gated"))
    cur = F.col("_cur.r")
    # WIN1: parent = latest last-of-rank below the node's rank
    parent = None
    for k in range(2, MAX_RANK + 1):
        lower = [F.col(f"_last{r}") for r in range(1, k)]
        cand = lower[0] if len(lower) == 1 else F.greatest(*lower)
        parent = F.when(F.col("rank") == k, cand) if parent is None else parent.when(F.col("rank") == k, cand)
    st = F.col("section_type")
    own_ref = F.when(st == "subsection", _compound(cur, F.col("raw_ref"))).otherwise(F.col("raw_ref"))
    node_cols = [
        F.col("row_no").cast("bigint").alias("seq"),
        st.alias("section_type"),
        own_ref.alias("section_ref"),
        *([F.col("node_title").alias("section_title")] if with_title else []),
        F.col("_parent.s").cast("bigint").alias("parent_seq"),
        _display_ref(F.col("_parent"), cur).alias("parent_ref"),
    ]
    if with_breadcrumb:
        node_cols.append(_breadcrumb(cur).alias("breadcrumb"))
    scanned = scanned.withColumn("_parent", parent)
    if with_text:
        # AGG4: node text + continuation rows, non-empty pieces joined by "\n"
        grouped = (scanned.filter(F.col("_grp").isNotNull())
                   .groupBy("law_id", "_grp")
                   .agg(F.max(F.when(st.isNotNull(), F.struct(*node_cols))).alias("_n"),
                        F.expr("listagg(nullif(node_text, ''), '\n') WITHIN GROUP (ORDER BY row_no)")
                         .alias("_text")))
        text = F.coalesce(F.col("_text"), F.lit(""))
        nodes = grouped.select("law_id", "_n.*", (text if text_chars is None else F.left(text, F.lit(text_chars))).alias("text_content"))
    else:
        # a gated node row heads its own group: no text to gather, no shuffle
        nodes = scanned.filter(st.isNotNull() & F.col("_grp").isNotNull()).select("law_id", *node_cols)
    # WIN2: 1-based position among siblings (top-level nodes share key -1)
    nodes = nodes.withColumn("_pkey", F.coalesce(F.col("parent_seq"), F.lit(-1).cast("bigint")))
    nodes = running(nodes, ["law_id", "_pkey"], "seq",
                    [Running("position", F.lit(1).cast("bigint"), "sum", inclusive=True, late=True)], chunk_rows,
                    materialize=True)
    cols = [c for c in SECTION_COLUMNS if (with_text or c != "text_content") and (with_title or c != "section_title")]
    cols += ["breadcrumb"] if with_breadcrumb else []
    return nodes.select(*cols)


def _breadcrumb(cur: Column) -> Column:
    """WIN10: refs of the ancestors, outermost first, joined by `` > ``.

    A last-of-rank node is still on the stack iff it comes after every last
    node of smaller rank, so the ancestors are the entries of
    ``[_last1.._last(rank-1)]`` that raise the running maximum of ``s``.
    """
    levels = F.array(*[F.col(f"_last{r}") for r in range(1, MAX_RANK)])
    below = F.filter(levels, lambda x, i: (i + 1) < F.col("rank"))
    kept = F.aggregate(
        below,
        F.struct(F.lit(-1).cast("bigint").alias("m"),
                 F.array().cast("array<string>").alias("refs")),
        lambda acc, x: F.when(x.isNotNull() & (x["s"] > acc["m"]),
                              F.struct(x["s"].cast("bigint").alias("m"),
                                       F.concat(acc["refs"], F.array(_display_ref(x, cur))).alias("refs")))
                        .otherwise(acc))
    return F.array_join(kept["refs"], " > ")


def parent_by_ref(sections: DataFrame) -> DataFrame:
    """JN1/AGG3: the reference's stored parent: the *last* row of the law
    whose ref equals ``parent_ref`` (NULL if none).  Adds ``parent_by_ref``.

    The ref table is aggregated before the join (one row per (law, ref)), and
    the join is a plain equi-join on ``(law_id, ref)``; AQE splits a hot key.
    """
    last_by_ref = (sections.filter(F.col("section_ref").isNotNull() & (F.col("section_ref") != ""))
                   .groupBy("law_id", F.col("section_ref").alias("parent_ref"))
                   .agg(F.max("seq").alias("parent_by_ref")))
    return sections.join(last_by_ref, ["law_id", "parent_ref"], "left")
