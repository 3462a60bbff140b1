"""Ordered work that stays parallel when one key, or no key at all, orders everything.

A window function sends a whole partition key to one task, so a key with a third
of the rows (or a global order) would not scale.  The order is therefore always cut
into ranges of ``keys + by`` by Spark's range partitioner, so a hot key or a hot
instant is split like any other stretch of rows.  There are as many ranges as the order
says, else ``spark.sql.shuffle.partitions``, of which adaptive execution may join small
neighbours.

* ``laid_out``   - the rows written in ranges, with the number of each row's range
* ``running``    - unbounded frames: window per range + carry from earlier ranges
* ``ordinal``    - position in the global order and inside the key
* ``lookback``   - frames over the previous L rows: blocks of rows plus a copied tail
* ``first_at_or_after`` / ``count_before`` - as-of probes, by merging probes into the
  order and scanning once; the cost is one sort, however many rows a frame would span
* ``quantiles``  - exact, interpolated, without gathering values in one task
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: Carry rows (two per range at most) are broadcast up to so many ranges.
BROADCAST_RANGES = 16_384


@dataclass(frozen=True)
class Order:
    """Rows are ordered by ``by`` inside each combination of ``keys``."""

    keys: tuple[str, ...] = ()
    by: tuple[str, ...] = ("us", "line_id")
    ranges: int | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return self.keys + self.by

    @property
    def range(self) -> str:
        """The column that numbers the ranges of rows laid out in this order."""
        return "_range_" + "_".join(self.columns)

    def most(self, spark: SparkSession) -> int:
        """The most ranges there can be."""
        return self.ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))


def laid_out(df: DataFrame, order: Order) -> DataFrame:
    """``df`` written in ranges of the order; does nothing if it is laid out already.

    Written once, the range numbers stay the same in every later step and the totals and
    windows read the table instead of repeating the work before it.
    """
    if order.range in df.columns:
        return df
    ranged = df.repartitionByRange(*([order.ranges] if order.ranges else []), *order.columns)
    return checkpointed(ranged.withColumn(order.range, F.spark_partition_id()))


def numbers(values: Sequence[float]) -> Column:
    """Doubles as one constant array (a single literal, folded when the plan is built)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def search(
    table: Column,
    steps: int,
    point: Column,
    size: Column,
    *,
    strict: bool = False,
    measure: Callable[[Column], Column] = lambda entry: entry,
) -> Column:
    """How many entries of the sorted array ``table`` are ``<= point`` (``<`` if strict).

    ``measure`` is a rising function applied to the entries that are looked at.
    """

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        open_ = state["lo"] < state["hi"]
        entry = measure(F.get(table, middle))
        right = open_ & ((entry < point) if strict else (entry <= point))
        return F.struct(
            F.when(right, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~right, middle).otherwise(state["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, halve, lambda s: s["lo"])


_LOCAL = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _range_total(how: str, value: Column, position: Column, reverse: bool) -> Column:
    if how in ("sum", "min", "max"):
        return _LOCAL[how](value)
    pick_last = (how == "last") != reverse
    where = F.when(value.isNotNull(), position)
    return F.max_by(value, where) if pick_last else F.min_by(value, where)


def _combine(how: str, carry: Column, local: Column) -> Column:
    if how == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if how == "min":
        return F.least(carry, local)
    if how == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry) if how == "last" else F.coalesce(carry, local)


def running(
    df: DataFrame,
    order: Order,
    columns: Mapping[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates from the start of the key up to (or just before) each row.

    ``columns`` maps an output name to ``(how, value)`` with ``how`` one of sum, min,
    max, last, first; last and first skip nulls.  ``reverse`` runs from the end.
    """
    done = _running(laid_out(df, order), order, columns, exclusive=exclusive, reverse=reverse)
    return done if order.range in df.columns else done.drop(order.range)


def _running(
    df: DataFrame, order: Order, columns: Mapping[str, tuple[str, Column]], *, exclusive: bool = False, reverse: bool = False,
) -> DataFrame:
    """``running`` over rows that are laid out."""
    keys = [F.col(k) for k in order.keys]
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order.by]
    end = -1 if exclusive else Window.currentRow

    def frame(parts: Sequence[Column]) -> WindowSpec:
        return (
            Window.partitionBy(*parts).orderBy(*direction).rowsBetween(Window.unboundedPreceding, end)
        )

    position = F.struct(*order.by)
    per_range = df.groupBy(*order.keys, order.range).agg(
        *[_range_total(h, v, position, reverse).alias(n) for n, (h, v) in columns.items()]
    )
    # Keys inside one range need no carry.  The others number at most one per cut
    # between ranges, with at most two (key, range) rows per cut.
    by_key = Window.partitionBy(*keys)
    carried = Window.partitionBy(*keys).orderBy(
        F.col(order.range).desc() if reverse else F.col(order.range).asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_range.withColumn("_spread", F.count("*").over(by_key))
        .filter("_spread > 1")
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in order.keys],
            F.col(order.range).alias("_b"),
            *[_LOCAL[h](F.col(n)).over(carried).alias(f"_c_{n}") for n, (h, _) in columns.items()],
        )
    )
    if order.most(df.sparkSession) <= BROADCAST_RANGES:
        carry = F.broadcast(carry)
    local = df.withColumns(
        {n: _LOCAL[how](v).over(frame([*keys, F.col(order.range)])) for n, (how, v) in columns.items()}
    )
    match = F.col(order.range) == F.col("_b")
    for k in order.keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    done = local.join(carry, match, "left").withColumns(
        {n: _combine(how, F.col(f"_c_{n}"), F.col(n)) for n, (how, _) in columns.items()}
    )
    return done.drop("_b", *[f"_k_{k}" for k in order.keys], *[f"_c_{n}" for n in columns])


def ordinal(df: DataFrame, order: Order, name: str = "pos") -> DataFrame:
    """Zero-based position of each row inside its key."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))}).withColumn(
        name, F.col(name) - 1
    )


def _in_blocks(df: DataFrame, order: Order, rows: int, block_rows: int) -> DataFrame:
    """Rows with ``_ord`` (position over all keys), ``_home`` and ``_block``.

    The last ``rows`` rows of every block are copied into the next one (``_block`` is not
    ``_home`` there), so the copies cost ``rows / block_rows`` of the data.
    """
    block_rows = max(block_rows, rows)
    whole = Order((), order.columns, order.ranges)
    numbered = _running(laid_out(df, order), whole, {"_ord": ("sum", F.lit(1).cast("long"))})
    numbered = numbered.withColumn("_ord", F.col("_ord") - 1)
    home = F.floor(F.col("_ord") / block_rows)
    is_tail = F.col("_ord") % block_rows >= block_rows - rows
    both = F.array(F.col("_home"), F.col("_home") + 1)
    return numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(is_tail, both).otherwise(F.array(F.col("_home"))))
    )


def lookback(df: DataFrame, order: Order, rows: int, block_rows: int = 200_000):
    """Prepare frames over the previous ``rows`` rows.

    Returns ``(frame, window, finish)``: compute ``expr.over(window.rowsBetween(-rows, ..))``
    on ``frame``, then pass the result through ``finish``.
    """
    extra = [] if order.range in df.columns else [order.range]
    spread = _in_blocks(df, order, rows, block_rows)

    def finish(out: DataFrame) -> DataFrame:
        return out.filter(F.col("_block") == F.col("_home")).drop("_block", "_home", "_ord", *extra)

    return spread, Window.partitionBy("_block", *order.keys).orderBy("_ord"), finish


def blocks(df: DataFrame, order: Order, rows: int, block_rows: int) -> DataFrame:
    """Rows numbered over ``keys + by`` and laid out in blocks with the previous ``rows`` rows.

    Adds ``_ord`` (position over all keys), ``_pos`` (position in the key), ``_block`` and
    ``_own`` (false for the copied tail).  Every block holds at most block_rows + rows rows,
    so a grouped Python function over ``_block`` sees bounded input even for one hot key.
    """
    laid = laid_out(df, order)
    if order.keys:
        laid = _running(laid, order, {"_pos": ("sum", F.lit(1).cast("long"))})
    spread = _in_blocks(laid, order, rows, block_rows)
    spread = spread.withColumn("_pos", F.col("_pos") - 1 if order.keys else F.col("_ord"))
    out = spread.withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")
    return out if order.range in df.columns else out.drop(order.range)


def first_at_or_after(
    probes: DataFrame,
    marks: DataFrame,
    values: Mapping[str, Column],
    *,
    keys: Sequence[str] = (),
    at: str = "at",
    ranges: int | None = None,
) -> DataFrame:
    """For each probe, the value of the first mark of its key with ``mark.at >= probe.at``.

    ``values`` maps output names to expressions over ``marks``; a null value means the mark
    does not count for that output.  Probe columns are kept.
    """
    kept = [c for c in probes.columns if c not in (*keys, at)]
    # One mark per instant is enough, so hot instants shrink before the sort.
    firsts = marks.groupBy(*keys, F.col(at).alias("_at")).agg(
        *[F.min(v).alias(n) for n, v in values.items()]
    )
    left = probes.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct(*[F.col(c) for c in kept]).alias("_probe"),
        *[F.lit(None).cast(firsts.schema[n].dataType).alias(n) for n in values],
    ).withColumn("_tie", F.xxhash64("_probe"))
    right = firsts.select(
        *keys, "_at", F.lit(1).alias("_kind"),
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
        *values, F.lit(0).cast("long").alias("_tie"),
    )
    # Scanned backwards, ties put marks (kind 1) before probes (kind 0): ">=" holds.
    # The hash only lets many probes of one instant fall into several ranges.
    merged = left.unionByName(right)
    order = Order(tuple(keys), ("_at", "_kind", "_tie"), ranges)
    found = running(merged, order, {n: ("last", F.col(n)) for n in values}, reverse=True)
    return found.filter("_kind = 0").select(
        *keys, F.col("_at").alias(at), *[F.col("_probe")[c].alias(c) for c in kept], *values
    )


def count_before(
    probes: DataFrame,
    marks: DataFrame,
    *,
    keys: Sequence[str] = (),
    at: str = "at",
    name: str = "n",
    ranges: int | None = None,
) -> DataFrame:
    """For each probe, how many marks of its key have ``mark.at < probe.at``."""
    kept = [c for c in probes.columns if c not in (*keys, at)]
    left = probes.select(
        *keys, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias(name),
        F.struct(*[F.col(c) for c in kept]).alias("_probe"),
    ).withColumn("_tie", F.xxhash64("_probe"))
    # Marks at one instant are counted before they are sorted, so hot instants shrink.
    right = (
        marks.groupBy(*keys, F.col(at).alias("_at"))
        .agg(F.count("*").alias(name))
        .select(
            *keys, "_at", F.lit(1).alias("_kind"), name,
            F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
            F.lit(0).cast("long").alias("_tie"),
        )
    )
    order = Order(tuple(keys), ("_at", "_kind", "_tie"), ranges)
    counted = running(left.unionByName(right), order, {name: ("sum", F.col(name))})
    return counted.filter("_kind = 0").select(
        *keys, F.col("_at").alias(at), *[F.col("_probe")[c].alias(c) for c in kept], name
    )


def quantiles(
    df: DataFrame,
    value: Column,
    probs: Sequence[float],
    *,
    keys: Sequence[str] = (),
    ranges: int | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: rows ``keys, q (index into probs), value``.

    A row counts ``weight`` times (a whole number, else once).  Equal values are counted first, the counts are accumulated over the ordered values,
    and the rows that cover a wanted rank are picked out.
    """
    probs = [float(p) for p in probs]
    one = F.lit(1).cast("long") if weight is None else weight
    counts = df.select(*keys, value.cast("double").alias("_v"), one.alias("_w")).filter("_v is not null")
    order = Order(tuple(keys), ("_v",), ranges)
    counts = laid_out(counts.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c")), order)
    ranked = _running(counts, order, {"_cum": ("sum", F.col("_c"))})
    if keys:
        ranked = ranked.join(counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), list(keys))
    else:
        ranked = ranked.withColumn("_n", counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long")).scalar())
    distinct_probs = sorted(set(probs))
    grid = numbers(distinct_probs)
    steps = len(distinct_probs).bit_length() + 1
    last = F.col("_n") - 1

    def covered(round_: Callable[[Column], Column]) -> Column:
        """Indexes of the probabilities whose rank r has cum - c <= r < cum."""

        def up_to(rank: Column) -> Column:
            return search(
                grid, steps, rank, F.lit(len(distinct_probs)), measure=lambda p: round_(p * last)
            )

        low, high = up_to(F.col("_cum") - F.col("_c") - 1), up_to(F.col("_cum") - 1)
        return F.struct(low.alias("from"), high.alias("to"))

    def indexes(span: Column) -> Column:
        some = span["to"] > span["from"]
        return F.when(some, F.sequence(span["from"], span["to"] - 1)).otherwise(
            F.array().cast("array<int>")
        )

    ranked = ranked.withColumns({"_lo": covered(F.floor), "_hi": covered(F.ceil)})
    hits = ranked.filter("_lo.to > _lo.from or _hi.to > _hi.from").select(
        *keys, "_n", "_v",
        F.explode(
            F.concat(
                F.transform(indexes(F.col("_lo")), lambda i: F.struct(i.alias("i"), F.lit("lo").alias("side"))),
                F.transform(indexes(F.col("_hi")), lambda i: F.struct(i.alias("i"), F.lit("hi").alias("side"))),
            )
        ).alias("_hit"),
    )
    places = [(j, i) for i, p in enumerate(distinct_probs) for j, x in enumerate(probs) if x == p]
    wanted = F.array(*[
        F.array(*[F.lit(j) for j, k in places if k == i]) for i in range(len(distinct_probs))
    ])
    pairs = hits.groupBy(*keys, F.col("_hit.i").alias("_i")).agg(
        F.max("_n").alias("_n"),
        F.max(F.when(F.col("_hit.side") == "lo", F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_hit.side") == "hi", F.col("_v"))).alias("_b"),
    )
    at = F.get(grid, F.col("_i")) * (F.col("_n") - 1)
    return pairs.select(
        *keys,
        F.explode(F.get(wanted, F.col("_i"))).alias("q"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("value"),
    )


def quantile_list(df: DataFrame, value: Column, probs: Sequence[float], **kw) -> list[float]:
    """The quantiles as Python numbers (one per probability; empty when there are no rows)."""
    if df.select(value.alias("_v")).filter("_v is not null").isEmpty():
        return []
    found = {r["q"]: r["value"] for r in quantiles(df, value, probs, **kw).collect()}
    return [found[i] for i in range(len(probs))]
