"""Totals of an event log: savings, cache breaks, tool tax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "pos"


def _count(c: str) -> Column:
    """A count field: what isn't a whole number from 0 on counts as 0."""
    return F.coalesce(F.when(F.col(c) >= 0, F.col(c)), F.lit(0)).cast("long")


def _share(part: Column, whole: Column) -> Column:
    """Tenths of a percent, rounded half away from zero."""
    return F.when(whole > 0, F.signum(part) * F.floor((F.abs(part) * 2000 + whole) / (whole * 2))).cast("long")


def totals(events: DataFrame) -> DataFrame:
    """One row of totals over events (pos orders them): counts, tokens, savings in tenths of a percent, the last break and tool tax.

    Sums and last values are aggregated in each task before one row a task is shuffled.
    """
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0))
    done = F.coalesce(F.col("compressed"), F.lit(False))
    broke, taxed = F.col("break_kind").isNotNull() | F.col("break_rebilled").isNotNull(), F.col("tax_tokens").isNotNull()
    sums = events.agg(
        F.count("*").alias("requests"), F.count_if(done).alias("compressed"), sum_(F.when(done, _count("orig_chars"))).alias("imaged_chars"), sum_(F.when(done, _count("image_count"))).alias("images"),
        sum_(_count("baseline_tokens")).alias("baseline"), sum_(F.coalesce("saved_tokens_cache_aware", F.lit(0))).alias("saved_aware"), sum_(_count("input_tokens") + _count("cache_read_tokens") + _count("cache_create_tokens")).alias("actual"),
        sum_(_count("output_tokens")).alias("output"), F.count_if(broke).alias("breaks"), sum_(F.when(broke, _count("break_rebilled"))).alias("rebilled"),
        F.max_by("break_kind", F.when(F.col("break_kind").isNotNull() & F.col("break_index").isNotNull(), F.col(MARK))).alias("last_break"), F.count_if(taxed).alias("taxed"), sum_(F.when(taxed, _count("tax_tokens"))).alias("tax_tokens"),
        F.count_if(F.coalesce("volatile_system", F.lit(False))).alias("volatile"),
    )
    seen = F.col("actual") > 0
    aware = F.col("actual") + F.col("saved_aware")
    return sums.withColumns(
        {
            "baseline_aware": aware, "saved_tenths": F.when(seen, _share(F.col("baseline") - F.col("actual"), F.col("baseline"))), "saved_aware_tenths": F.when(seen, _share(F.col("saved_aware"), aware)),
            "output_tenths": F.when(F.col("output") > 0, _share(F.col("output"), F.col("actual") + F.col("output"))),
        }
    )
