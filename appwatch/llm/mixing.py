"""Mixing sources to target weights along a curriculum, with DataFrame operations only.

Every source has a weight schedule over training time, a straight line from ``start`` to ``end`` on
[0, 1]. Its integral is the source's share. Shares of all words are the targets; a source gives each
of its words ``max_repeat`` times at most, and what it cannot give is shared again by weight among
the others. Within a source, documents are taken in a fixed pseudo-random order, pass after pass,
until the target is met to the word. The integral of the schedule up to time t is the source's demand
by then. :func:`deal` solves it for the middle of the words of each copy, counted over all passes and
as a part of the target: that is the copy's training position, by which the copies are range-sorted.
:func:`mix` has one row per document; its ``position`` is that of the document's first copy, null if it is not taken.

Running sums over a source are taken over spans of its order, one digest prefix each, and then over
the spans' totals, so a source with a third of all rows is spread over many tasks.

Cases: a null text has size 0; documents without words are taken 0 times and have no
position. A null source is a source of its own, last in order. Rows of equal id are told apart by
their texts; fully equal rows share one order place at random but have equal sizes, so reruns agree.
An empty table gives an empty result. Other columns are kept, but for those
with the name of a new one, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from appwatch.llm import common

NEW = ("size", "source_size", "target", "taken", "position")


@dataclass(frozen=True)
class Schedule:
    """Weights of sources by their place in order, repeating: a line from ``start`` to ``end``, for each.

    The integrals of the default are 1, 2 and 3: light sources fade out, heavy ones grow.
    """

    lines: tuple[tuple[float, float], ...] = ((1.5, 0.5), (2.0, 2.0), (2.0, 4.0))

    def pick(self, place: Column, which: int) -> Column:
        return F.element_at(F.array(*[F.lit(float(x[which])) for x in self.lines]), (place % len(self.lines) + 1).cast("int"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, schedule: Schedule = Schedule(), max_repeat: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``, ``w0`` and ``w1``: one row per source.

    With sources sorted by the level at which they reach their limit, those at their limit come
    first; the level of the rest follows from running sums. The table holds one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    placed = sizes.select(
        "source", "source_size", (F.row_number().over(order) - 1).alias("place")
    ).select("*", schedule.pick(F.col("place"), 0).alias("w0"), schedule.pick(F.col("place"), 1).alias("w1"))
    ranked = placed.withColumn("weight", (F.col("w0") + F.col("w1")) / F.lit(2.0)).withColumn(
        "full_at", F.col("source_size") * F.lit(float(max_repeat)) / F.col("weight")
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    # If this source and all later ones are below their limits, they share what the earlier ones leave.
    # The first source for which that holds has the greatest such level.
    level = (
        F.sum("source_size").over(everything) - F.lit(max_repeat) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn(
        "common", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    )
    capped = F.col("common").isNull() | (F.col("full_at") < F.col("common"))
    share = F.when(capped, F.col("source_size") * F.lit(float(max_repeat))).otherwise(F.col("weight") * F.col("common"))
    return leveled.select("source", "source_size", share.alias("target"), "w0", "w1")


def _taken(docs: DataFrame, schedule: Schedule, max_repeat: int, id_col: str, text_col: str, source_col: str, at: str) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, and in ``at`` the words of its source before it,
    ``first``, and the line ``w0``, ``w1``."""
    names = ("order_key", "order_span", "order_tie", "running", "order_source")
    key, span, tie, running, of = (common.free_name(docs, n) for n in names)
    # Sources as a key without nulls: the window and the join then share one shuffle of the texts.
    source = common.field(docs, source_col, "string")
    never_null = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    # The number of spans follows the cluster; the order itself does not depend on it.
    digits = 2 if int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= 64 else 3
    sized = (
        docs.withColumn("size", word_count(common.field(docs, text_col, "string")))
        .withColumn(key, F.md5(F.coalesce(common.field(docs, id_col, "string"), F.lit("")).cast("binary")))
        .withColumn(span, F.substring(key, 1, digits))
        .withColumn(tie, F.md5(F.coalesce(common.field(docs, text_col, "string"), F.lit("")).cast("binary")))
        .withColumn(of, never_null(source))
    )
    spans = sized.groupBy(source.alias("source"), F.col(span).alias("span")).agg(F.sum("size").alias("span_size"))
    plan = targets(spans.groupBy("source").agg(F.sum("span_size").alias("source_size")), schedule, max_repeat)
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum("span_size").over(earlier), F.lit(0))).alias("o")
    offsets = offsets.join(plan.alias("p"), F.expr("o.source <=> p.source")).select(
        "o.source", "span", "offset", "source_size", "target", "w0", "w1"
    )
    offsets = offsets.select(never_null(F.col("source")).alias(of), F.col("span").alias(span), F.struct("*").alias("mix_plan"))
    within = (
        Window.partitionBy(of, span)
        .orderBy(key, common.field(docs, id_col, "string"), tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn(running, F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, [of, span], "left")
    whole = F.col("mix_plan.source_size")
    first = F.col(running) + F.col("mix_plan.offset")
    demand = F.round(F.col("mix_plan.target")).cast("long")
    # Whole passes over the source, and the part of the last one that reaches this document.
    passes = F.when(whole > 0, F.floor(demand / whole)).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), demand - passes * whole - first))
    taken = F.when(F.col("size") > 0, F.least(passes * F.col("size") + rest, F.lit(max_repeat) * F.col("size"))).otherwise(0)
    return joined.withColumns({"source_size": whole, "target": F.col("mix_plan.target"), "taken": taken.cast("long")}).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *NEW[:-1],
        F.struct(first.alias("first"), F.col("mix_plan.w0"), F.col("mix_plan.w1")).alias(at),
    )


def _solved(share: Column, at: str) -> Column:
    """The time at which the demand curve has ``share`` of its integral: (w1 - w0)/2 t^2 + w0 t = area."""
    w0, w1 = F.col(f"{at}.w0"), F.col(f"{at}.w1")
    area = share * (w0 + w1) / F.lit(2.0)
    return F.when(area > 0, F.lit(2.0) * area / (w0 + F.sqrt(w0 * w0 + F.lit(2.0) * (w1 - w0) * area))).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame,
    schedule: Schedule = Schedule(),
    max_repeat: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``position``, in order of position.

    ``position`` inverts the source's cumulative demand at the middle of the first copy's words.
    """
    docs = common.without(docs, NEW)
    at = common.free_name(docs, "mix_at")
    out = _taken(docs, schedule, max_repeat, id_col, text_col, source_col, at)
    middle = F.col(f"{at}.first").cast("double") + F.least("size", "taken") / F.lit(2.0)
    position = F.when(F.col("taken") > 0, _solved(F.least(F.lit(1.0), middle / F.col("target")), at))
    return out.withColumn("position", position).drop(at).orderBy(F.col("position").asc_nulls_last(), F.col(f"`{id_col}`"))


def deal(
    docs: DataFrame,
    schedule: Schedule = Schedule(),
    max_repeat: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is taken, with the columns of :func:`mix`, in training order.

    ``position`` is that of the copy: the middle of its words among all that are taken of the source,
    as a part of the target, put through the demand curve. Texts are those of :func:`repeat`.
    """
    docs = common.without(docs, NEW)
    at = common.free_name(docs, "mix_at")
    turn = common.free_name(docs, "turn")
    copies = _copies(_taken(docs, schedule, max_repeat, id_col, text_col, source_col, at), text_col, turn)
    middle = F.col(f"{at}.first") + (F.col(turn) - 1) * F.col("source_size") + _words(turn) / F.lit(2.0)
    # The last word taken may lie half a word beyond the target, which is rounded to whole words.
    share = F.least(F.lit(1.0), middle.cast("double") / F.col("target"))
    return copies.withColumn("position", _solved(share, at)).orderBy("position", F.col(f"`{id_col}`"), turn).drop(at, turn)


def _words(turn: str) -> Column:
    """Words of the copy: all, or those that are left for the last one."""
    return F.least(F.col("size"), F.col("taken") - (F.col(turn) - 1) * F.col("size"))


def _copies(mixed: DataFrame, text_col: str, turn: str) -> DataFrame:
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    copies = mixed.where(F.col("taken") > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), times)))
    words, text = _words(turn), F.col(f"`{text_col}`")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"({common.WORD_PATTERN})")), F.lit(1), words.cast("int")), " ")
    return copies.withColumn(text_col, F.when(words < F.col("size"), short).otherwise(text))


def repeat(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each time a document is taken; a part taken last keeps its first words only."""
    turn = common.free_name(mixed, "turn")
    return _copies(mixed, text_col, turn).drop(turn)
