"""From templates to line scores: surprise, time delta, memory distance and their blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.functions.time import log_delta
from omenlog.operators.context import context_distance
from omenlog.operators.embedding import embedded
from omenlog.operators.order import Order
from omenlog.operators.scores import online_hybrid
from omenlog.operators.surprise import CountModel, adaptive_scores, line_signals, numbered_lines, to_lines
from omenlog.operators.temporal import delta_ms
from omenlog.session import checkpointed, compact, passing


def line_vectors(df: DataFrame, features: int = 1024, components: int = 16) -> DataFrame:
    """Default embedding per distinct line (see ``embedded``): ``norm, vec``."""
    return embedded(checkpointed(df.select("norm").distinct()), features, components)


def score_texts(
    df: DataFrame,
    model: CountModel,
    *,
    memory: bool = True,
    keys: Sequence[str] = (),
    vectors: DataFrame | None = None,
    keep: Sequence[str] | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Lines with ``mlm_error`` and ``mlm_prob``, for the ``memory`` with ``vec`` too, as a written table.

    Of the columns of ``df`` besides ``line_id``, ``us`` and ``keys`` only those in ``keep`` travel, if
    it is given.  ``lines`` are the distinct lines of ``df`` as ``surprise.trained`` gives them beside
    the model, if they are known.  The result reads none of ``df``, the model and ``lines``.
    """
    own = df.columns if keep is None else list(dict.fromkeys(["line_id", "us", *keys, *keep]))
    spark = df.sparkSession
    with passing(spark) as step:
        with passing(spark) as first:
            if lines is None:
                df = first(df)
                lines = numbered_lines(df, write=first)
            every = step(to_lines(df.select(*dict.fromkeys([*own, "norm"])), lines).select(*own, "line_no"))
            with passing(spark) as answers:
                once = step(adaptive_scores(line_signals(model, lines, write=answers), ["line_no"]).select(
                    "line_no", F.col("error_mean").alias("mlm_error"), F.col("prob_mean").alias("mlm_prob")
                ))
            if memory:
                named = lines.select("line_no", "norm")
                named = step((embedded(named) if vectors is None else named.join(vectors, "norm")).select("line_no", "vec"))
        out = every.join(once, "line_no")
        if memory:
            out = out.join(named, "line_no")
        # read by the memory scan and by the blend
        return compact(out.drop("line_no"))


def score_order(
    out: DataFrame, *, time: bool = False, memory: bool = True, metric: str = "knn", alpha: float = 0.5,
    keys: tuple[str, ...] = (), **options,
) -> DataFrame:
    """What the lines of ``score_texts`` get from the lines before them."""
    rows = out.drop("vec") if memory else out
    if time:
        rows = delta_ms(rows, keys=keys, by=("us", "line_id")).withColumn("log_delta", log_delta(F.col("delta_ms")))
    if not memory:
        return rows
    order = Order(keys)
    far = context_distance(out, metric, order=order, **options)
    named = f"{metric}_distance"
    joined = rows.join(far.withColumnRenamed("distance", named).drop(*keys), "line_id")
    return online_hybrid(joined, "mlm_error", named, alpha, order=order)


def score_lines(
    df: DataFrame,
    model: CountModel,
    *,
    time: bool = False,
    memory: bool = True,
    metric: str = "knn",
    alpha: float = 0.5,
    keys: tuple[str, ...] = (),
    vectors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Lines (``line_id, us, norm`` ...) with ``mlm_error`` and ``mlm_prob``.

    ``time`` adds ``log_delta``; ``memory`` adds ``<metric>_distance`` and ``hybrid``.  The
    two switches give the baseline, time only, memory only and full variants.  ``vectors``
    (``norm, vec``) replaces the default embedding.
    """
    out = score_texts(df, model, memory=memory, keys=keys, vectors=vectors)
    return score_order(out, time=time, memory=memory, metric=metric, alpha=alpha, keys=keys, **options)
