"""Whole-table parsing steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omenlog.functions.normalise import Profile, normalise


def normalise_lines(
    df: DataFrame, profile: str | Profile = "generic", *, raw: str = "raw", name: str = "norm"
) -> DataFrame:
    """Adds the template; lines that become empty leave together with their id and label.

    The template is exploded from an array without its empty value rather than filtered:
    a filter would be pushed below the projection and compute every template twice.
    """
    value = F.filter(F.array(normalise(F.col(raw), profile)), lambda t: t != "")
    return df.select("*", F.explode(value).alias(name))
