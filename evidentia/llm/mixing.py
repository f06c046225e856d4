"""Mixing sources to target weights by hierarchical budgeting.

A tree has a level for each of the given columns, e.g. domain, language, source. The token budget flows from the root to
the leaves: each node shares its budget among its children by weight, but gives none more than it can use, which is
max_epochs times its tokens. What a child can't use goes to its siblings by weight; only when all of them are full does
the node itself take less, and its own siblings get the rest. A leaf takes whole epochs and then a token prefix of one
more, in an order seeded by epoch. All is done with joins and sums. No window holds a whole parent or leaf: running sums
are taken over the sums of buckets first and then within buckets (running()), and a leaf's prefix is found in sums over
64 slices of its order, then over 64 slices of the one in which it ends, and rows are only ordered within one of these.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Table, join_checked, write

NULL = "(null)"
#: Words as tokens: runs of characters other than the six ASCII white-space characters.
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each (new column: summed column), the sum over the rows before in the order of (bucket, order).

    A task holds the buckets of one group ``by``, or the rows of one bucket, but never all rows of a group.
    """
    by_bucket = [*by, "_bucket"]
    marked = rows.withColumn("_bucket", bucket)
    parts = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*by_bucket).agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    begins = totals.select(*by_bucket, *[F.coalesce(F.sum(f"_s{i}").over(parts), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inner = Window.partitionBy(*by_bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(begins, by_bucket)
    return joined.select(*rows.columns, *[(F.col(f"_b{i}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(new) for i, (new, c) in enumerate(sums.items())])


def shares(nodes: DataFrame, parent: list[str], name: str) -> Table:
    """(parent columns, name, tokens): what each child gets, from a written table (parent columns, name, capacity, weight, budget of the parent).

    A child is full if what is left for it and all with as much capacity by weight or more, shared by weight, covers its
    capacity; the others share the rest by weight. Whole tokens are dealt in the order of md5(name): a child gets the
    whole part of the sum of shares up to it, less that of the sum before it, so that nothing of the rest is lost.
    """
    ratio = F.col("capacity") / F.col("weight")
    ratios = nodes.withColumn("_ratio", ratio).groupBy(*parent, "_ratio").agg(F.sum("capacity").alias("_c"), F.sum("weight").alias("_w"), F.first("budget").alias("_budget"))
    whole = nodes.groupBy(*parent).agg(F.sum("weight").alias("_all"))
    meet = lambda a, b: a.join(b, parent) if parent else a.crossJoin(F.broadcast(b))  # noqa: E731  # without a parent b is one row
    ordered = meet(running(ratios, parent, F.floor(F.log2(F.col("_ratio") + 1) * 8).cast("int"), ["_ratio"], {"_cb": "_c", "_wb": "_w"}), whole)
    test = F.col("_c").cast("decimal(38,0)") * (F.col("_all") - F.col("_wb")) <= F.col("_w").cast("decimal(38,0)") * (F.col("_budget") - F.col("_cb"))
    filled = write(ordered.select(*parent, "_ratio", "_c", "_w", "_budget", test.alias("full")), "filled")
    rest = filled.df.groupBy(*parent).agg((F.first("_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("_c"))), F.lit(0))).alias("_rest"), F.sum(F.when(~F.col("full"), F.col("_w"))).alias("_open"))
    marked = meet(nodes.withColumn("_ratio", ratio).join(filled.df.select(*parent, "_ratio", "full"), [*parent, "_ratio"]), rest)
    marked = write(marked.select(*parent, name, "capacity", "weight", "full", "_rest", "_open", F.md5(name).alias("_key")), "children")
    filled.drop()
    left = running(marked.df.filter("not full"), parent, F.substring("_key", 1, 3), ["_key"], {"_before": "weight"})
    upto = lambda w: F.expr(f"cast({w} as decimal(20,0)) * cast(_rest as decimal(18,0)) div _open")
    dealt = left.withColumn("tokens", upto("_before + weight") - upto("_before"))
    out = [*parent, name, "tokens"]
    result = write(marked.df.filter("full").withColumn("tokens", F.col("capacity")).select(*out).unionByName(dealt.select(*out)), "shares")
    marked.drop()
    return result


def plan(leaves: DataFrame, levels: list[str], weights: Mapping[tuple[str, ...], int], share: float, max_epochs: int) -> Table:
    """leaves (level columns, available) with budget: the tokens to take of each leaf. share: of all available tokens."""
    spark = leaves.sparkSession
    table = leaves.withColumn("capacity", F.col("available") * max_epochs)
    given = spark.createDataFrame([(len(k), "\0".join(k), int(v)) for k, v in weights.items()], "depth int, path string, w long")
    above, tables = None, []
    for depth in range(1, len(levels) + 1):
        names = levels[:depth]
        nodes = table.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
        of = given.filter(F.col("depth") == depth).select("path", "w")
        nodes = nodes.withColumn("path", F.concat_ws("\0", *names)).join(F.broadcast(of), "path", "left").withColumn("weight", F.coalesce("w", F.lit(1).cast("long"))).drop("path", "w").filter("weight > 0")
        if above is None:
            total = nodes.agg(F.sum("available").alias("all")).select(F.floor(F.lit(share) * F.col("all")).cast("long").alias("budget"))
            nodes = nodes.crossJoin(F.broadcast(total))  # one row
        else:
            nodes = nodes.join(above, names[:-1])
        tables.append(write(nodes.drop("available"), "nodes"))
        tables.append(shares(tables[-1].df, names[:-1], names[-1]))
        above = tables[-1].df.withColumnRenamed("tokens", "budget")
    planned = write(table.join(above, levels).select(*levels, "available", "budget"), "plan")
    for t in tables:
        t.drop()
    return planned


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], share: float, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, level columns, epoch, doc_tokens, taken): what is taken of each document in each epoch, if anything.

    levels: the tree's columns from the root down; null counts as the value "(null)". weights: whole numbers by path of
    level values, 1 where none is given; 0 takes nothing. share: the budget, as a part of all tokens. tokens: a document's
    tokens, its words unless given. Documents without tokens take no part, nor do rows with a null id. In a leaf's last,
    partial epoch documents are taken in the order of md5(seed:epoch:id) until its tokens are used up, the last one in
    part. Repeated rows count one by one. An empty table gives no rows; other columns are not read. Levels may have any names.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    count = word_count(F.col(text_col)) if tokens is None else tokens.cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(n) for n, c in zip(names, levels.values(), strict=True)], count.alias("_tokens"))
    measured = write(rows.filter("_tokens > 0 and _id is not null"), "measured")
    sums = measured.df.groupBy(*names).agg(F.sum("_tokens").alias("available"))
    planned = plan(sums, names, weights, share, max_epochs)
    n_leaves = planned.df.count()
    leaf = planned.df.filter("budget > 0").select(*names, F.expr("budget div available").alias("_full"), F.expr("budget % available").alias("_part"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id").cast("string")))
    marked = write(join_checked(measured.df, leaf, names, "inner", n_leaves).withColumn("_key", key), "keyed")
    measured.drop()
    planned.drop()
    # slices of slices of a leaf's order: which are inside its prefix, and in which it ends
    at = F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")
    slices = write(marked.df.filter("_part > 0").groupBy(*names, "_part", at.alias("_slice")).agg(F.sum("_tokens").alias("_sum")).withColumn("_outer", F.expr("_slice div 64")), "slices")
    outer = slices.df.groupBy(*names, "_part", "_outer").agg(F.sum("_sum").alias("_all"))
    before = lambda by, order, c: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  # 64 rows at most
    outer = outer.withColumn("_begin", before(names, "_outer", "_all")).filter("_begin < _part").withColumn("_in", F.col("_begin") + F.col("_all") <= F.col("_part"))
    outer = write(outer.select(*names, "_outer", "_begin", "_in"), "outer")
    n_outer = outer.df.count()  # at most 64 for each leaf
    cut = join_checked(slices.df, outer.df.filter("not _in").select(*names, "_outer", F.col("_begin").alias("_from")), [*names, "_outer"], "inner", n_outer)
    cut = cut.withColumn("_begin", F.col("_from") + before([*names, "_outer"], "_slice", "_sum")).filter("_begin < _part")
    inner = write(cut.select(*names, "_slice", "_begin", (F.col("_begin") + F.col("_sum") <= F.col("_part")).alias("_whole")), "inner")
    slices.drop()
    sliced = marked.df.filter("_part > 0").withColumn("_slice", at).withColumn("_outer", F.expr("_slice div 64"))
    covered = join_checked(sliced, outer.df.filter("_in").select(*names, "_outer"), [*names, "_outer"], "left_semi", n_outer)
    near = write(join_checked(sliced, inner.df, [*names, "_slice"], "inner", inner.df.count()), "prefix")
    within = Window.partitionBy(*names, "_slice").orderBy("_key", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = near.df.filter("not _whole").withColumn("_at", F.col("_begin") + F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
    last = F.col("_full").cast("int").alias("epoch")
    partial = edge.filter("_at < _part").select("_id", *names, last, "_tokens", F.least("_tokens", F.col("_part") - F.col("_at")).alias("taken"))
    inside = near.df.filter("_whole").select("_id", *names, last, "_tokens", F.col("_tokens").alias("taken"))
    inside = inside.unionAll(covered.select("_id", *names, last, "_tokens", F.col("_tokens").alias("taken")))
    epochs = marked.df.filter("_full > 0").select("_id", *names, F.explode(F.sequence(F.lit(0), (F.col("_full") - 1).cast("int"))).alias("epoch"), "_tokens", F.col("_tokens").alias("taken"))
    return epochs.unionAll(inside).unionAll(partial).select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, levels, strict=True)], "epoch", F.col("_tokens").alias("doc_tokens"), "taken")
