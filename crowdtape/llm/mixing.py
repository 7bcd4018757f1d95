"""Mixing sources to target weights by budgets that flow down a tree of domains, languages and sources.

A node's budget is shared among its children by weight. A child that cannot use its share, because all leaves
below it are spent after ``max_epochs`` passes, takes what it can, and the rest goes to its siblings by weight;
only what they cannot use either is missing one level up, where the node's own siblings get it. All of it is
integer arithmetic on the table of leaves.

A leaf with budget b and t tokens gives every document b div t times, and b mod t more tokens from one further
epoch: the longest prefix of whole documents, in that epoch's own seeded order, that fits.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from crowdtape.llm.common import others, packed, unpacked, words
from crowdtape.sources.staging import staged

# Hex digits of the order key that divide a leaf into slices, so that no leaf is ever sorted in one task.
SLICE_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.size(words(F.col(f"`{text}`").cast("string"))).cast("long")


def _weight(name: Column, weights: dict[str, int], default: int) -> Column:
    found = F.lit(default)
    for key, weight in weights.items():
        found = F.when(name == key, F.lit(weight)).otherwise(found)
    return found.cast("long")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column,
                 default_weight: int = 1, max_epochs: int = 1) -> DataFrame:
    """Token budgets of leaves: ``leaves`` has the ``levels`` (no NULL) and ``tokens``; adds ``budget``.

    ``budget`` is the total, an expression over the one-row sum ``tokens`` of all leaves. A node of weight 0
    gets nothing. What exceeds all leaves' tokens times ``max_epochs`` stays unspent.
    """
    wanted = [_weight(F.col(level), own, default_weight) for level, own in zip(levels, weights)]
    usable = F.lit(True)
    for weight in wanted:
        usable = usable & (weight > 0)
    rows = leaves.withColumn("_room", F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("long"))
    total = rows.agg(F.sum("tokens").alias("tokens"), F.sum("_room").alias("_all_room")).select(
        F.least(F.coalesce(budget.cast("long"), F.lit(0)), F.coalesce("_all_room", F.lit(0))).cast("long")).first()[0]
    given = None
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        nodes = rows.groupBy(*levels[:depth + 1]).agg(F.sum("_room").alias("_room")).withColumn(
            "_weight", F.greatest(wanted[depth], F.lit(1)).cast("long"))
        nodes = nodes.join(given, parents) if parents else nodes.withColumn("_budget", F.lit(total).cast("long"))
        # Children in the order in which a rising level would fill them.
        by_need = Window.partitionBy(*parents).orderBy(F.col("_room") / F.col("_weight"), level)
        whole = Window.partitionBy(*parents)
        nodes = nodes.withColumn("_before", F.sum("_room").over(by_need.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_room"))
        nodes = nodes.withColumn("_rest_weight", F.sum("_weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        nodes = nodes.withColumn(
            "_full", F.col("_room") * F.col("_rest_weight") <= (F.col("_budget") - F.col("_before")) * F.col("_weight"))
        open_weight = F.when(F.col("_full"), 0).otherwise(F.col("_weight")).cast("long")
        nodes = nodes.withColumn("_open", open_weight)
        nodes = nodes.withColumn("_left", F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_room")).otherwise(0)).over(whole))
        nodes = nodes.withColumn("_open_all", F.sum("_open").over(whole))
        nodes = nodes.withColumn("_open_to", F.sum("_open").over(
            Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)))
        # Shares are cut from one running product, so they are whole and add up.
        share = F.expr("(_left * _open_to) div _open_all - (_left * (_open_to - _open)) div _open_all")
        given = nodes.select(
            *levels[:depth + 1], F.when(F.col("_full"), F.col("_room")).otherwise(share).cast("long").alias("_budget"))
    return leaves.join(given, levels).withColumnRenamed("_budget", "budget")


def _order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def with_copies(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column,
                tokens: Column | None = None, id_col: str = "doc_id", seed: int = 42, default_weight: int = 1,
                max_epochs: int = 1) -> DataFrame:
    """``docs`` with ``copies``: how often the mixture holds each document, 0 for not at all.

    ``levels`` names the tree's levels from the top, each with its expression; a NULL name counts as an empty
    one. ``tokens`` is a document's size (words, unless given), NULL counting as 0. Rows that share an id share
    their place in the order and are taken or left together; a leaf without tokens gives none. A column
    ``copies`` of ``docs`` is replaced.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    named = [F.coalesce(column.cast("string"), F.lit("")).alias(n) for n, column in zip(names, levels.values())]
    size = F.coalesce(word_count() if tokens is None else tokens, F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(f"`{id_col}`").alias("_id"), *named, size.alias("tokens")), "mix-sizes")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    planned = leaf_budgets(leaves, names, weights, budget, default_weight, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    planned = staged(planned.select(
        *names, whole.cast("long").alias("_epochs"), (F.col("budget") - whole * F.col("tokens")).alias("_rest")), "mix-budgets")

    # Where each leaf's prefix ends: sums of slices find the slice, and only that one is put in order.
    keyed = rows.join(planned, names).select(
        *names, "tokens", "_rest", _order_key(seed, F.col("_epochs"), F.col("_id")).alias("_key"))
    sliced = keyed.withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    sums = sliced.groupBy(*names, "_slice", "_rest").agg(F.sum("tokens").alias("_sum"))
    running = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("_to", F.sum("_sum").over(running)).where("_to > _rest AND _to - _sum <= _rest")
    # Empty documents may follow, but the first slice beyond the budget decides.
    ends = ends.groupBy(*names).agg(F.min(F.struct("_slice", (F.col("_to") - F.col("_sum")).alias("_from"))).alias("_end"))
    ends = ends.select(*names, F.col("_end._slice").alias("_slice"), F.col("_end._from").alias("_from"))
    last = sliced.join(ends, [*names, "_slice"])
    inside = last.withColumn("_to", F.col("_from") + F.sum("tokens").over(Window.partitionBy(*names, "_slice").orderBy("_key")))
    fits = inside.where("_to <= _rest").groupBy(*names).agg(F.max("_key").alias("_last"))
    cuts = staged(planned.join(ends.select(*names, "_slice"), names, "left").join(fits, names, "left").select(
        *[F.col(n).alias(f"_of{n}") for n in names], "_epochs",
        F.coalesce("_last", "_slice", F.lit("")).alias("_cut")), "mix-cuts")

    passed = others(docs, "copies")
    placed = docs.select(packed(passed), F.col(f"`{id_col}`").alias("_id"), *named).join(
        cuts, [F.col(n) == F.col(f"_of{n}") for n in names])
    more = (_order_key(seed, F.col("_epochs"), F.col("_id")) <= F.col("_cut")).cast("long")
    return placed.select(*unpacked(passed), (F.col("_epochs") + more).alias("copies"))


def mixture(docs: DataFrame, *args, **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as ``with_copies`` says."""
    copied = with_copies(docs, *args, **options)
    return copied.withColumn("copies", F.explode(F.expr("array_repeat(true, CAST(copies AS INT))"))).drop("copies")
