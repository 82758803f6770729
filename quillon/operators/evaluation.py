"""Blinded comparison of pairs: sides dealt by a key, verdicts of four kinds, and a ranking of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

# The verdicts.
VERDICTS = ("left better", "tie", "right better", "both fail")
CUT = 4  # rounds of the ranking that are one plan
BLOCK = 4  # cases in which each side comes as often as the other


def sides(pairs: DataFrame, key: str, block: int = BLOCK, stratum: str = "stratum", case: str = "case_id", ordinal: str = "ordinal") -> DataFrame:
    """pairs (stratum, case_id, ordinal, first, second) with left and right: permuted blocks.

    ordinal numbers the cases of a stratum from 0 without gaps. In each `block` cases that follow each other one half
    shows the first condition on the left, the other half the second; which ones follows from a keyed hash, so
    whoever lacks the key can't tell, and the same key gives the same sides. A stratum's last block may be cut
    short. Blocks are dealt on their own, so a large stratum is many tasks.
    """
    if block < 2 or block % 2:
        raise ValueError("a block has an even number of cases")
    secret = F.sha2(F.concat_ws("\n", F.lit(key), F.col(stratum).cast("string"), F.col(case).cast("string")), 256)
    rows = pairs.withColumn("block_", F.floor(F.col(ordinal) / block))
    place = F.row_number().over(Window.partitionBy(stratum, "block_").orderBy(secret, case))
    rows = rows.withColumn("turned_", place > block // 2)
    left, right = F.when(F.col("turned_"), F.col("second")).otherwise(F.col("first")), F.when(F.col("turned_"), F.col("first")).otherwise(F.col("second"))
    return rows.withColumns({"left": left, "right": right}).drop("block_", "turned_")


def usable(pairs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pairs whose two outputs (case_id, condition, state) are there, whole and unexposed: state is ok."""
    good = outputs.where("state = 'ok'").select("case_id", "condition").distinct()
    for side in ("first", "second"):
        pairs = pairs.join(good.withColumnRenamed("condition", side), ["case_id", side], "left_semi")
    return pairs


def unblinded(reviews: DataFrame, verdict: str = "verdict") -> DataFrame:
    """reviews (left, right, verdict, ...) as (left, right, left_points, right_points, counted): a tie is half a point each.

    Reviews in which both fail are kept, but count for no one; other verdicts than the four are an error of the row.
    """
    v = F.col(verdict)
    known = F.when(v.isin(*VERDICTS), v).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce(v, F.lit("null")))))
    points = lambda won: F.when(v == won, 1.0).when(v == "tie", 0.5).otherwise(0.0)
    rows = reviews.withColumn(verdict, known)
    return rows.withColumns({"left_points": points("left better"), "right_points": points("right better"), "counted": v != "both fail"})


def pair_counts(reviews: DataFrame) -> DataFrame:
    """(condition, other, n, points) of unblinded reviews, both ways: how often two met, and what the first got."""
    rows = reviews.where("counted and left <> right")
    one = rows.groupBy(F.col("left").alias("condition"), F.col("right").alias("other")).agg(F.count("*").alias("n"), F.sum("left_points").alias("points"))
    two = rows.groupBy(F.col("right").alias("condition"), F.col("left").alias("other")).agg(F.count("*").alias("n"), F.sum("right_points").alias("points"))
    return one.unionByName(two).groupBy("condition", "other").agg(F.sum("n").alias("n"), F.sum("points").alias("points"))


def strengths(counts: DataFrame, rounds: int = 30, prior: float = 1.0, tolerance: float = 0.0) -> DataFrame:
    """(condition, strength, n, points) by the fixed point of Bradley and Terry's model, from pair_counts.

    A condition's strength becomes its points over the sum of n / (its strength + the other's), again and again.
    Each one also met an imagined condition of strength 1, `prior` times won and lost, so strengths are
    finite whatever the verdicts and need no scaling. Stops after `rounds` rounds, or earlier where in the last of CUT rounds no
    strength changed by more than tolerance of itself. Rounds are joins on the pairs that met; each CUT of them are
    written, so plans stay short.
    """
    counts = scratch.table(counts, "pair_counts")
    total = counts.groupBy("condition").agg(F.sum("n").alias("n"), F.sum("points").alias("points"))
    now = scratch.table(total.withColumns({"strength": F.lit(1.0), "before": F.lit(1.0)}), "strengths")
    for k in range(1, rounds + 1):
        here, there = now.select("condition", F.col("strength").alias("own")), now.select(F.col("condition").alias("other"), F.col("strength").alias("theirs"))
        due = counts.join(here, "condition").join(there, "other").groupBy("condition").agg(F.sum(F.col("n") / (F.col("own") + F.col("theirs"))).alias("due"))
        new = (F.col("points") + prior) / (F.col("due") + 2 * prior / (F.col("strength") + 1))
        now = now.join(due, "condition").select("condition", "n", "points", new.alias("strength"), F.col("strength").alias("before"))
        if k % CUT == 0 or k == rounds:
            now = scratch.table(now, "strengths")
            if now.where(F.abs(F.col("strength") - F.col("before")) > tolerance * F.col("before")).isEmpty():
                break
    return now.select("condition", "strength", "n", "points")


def win_chance(strength: Column, other: Column) -> Column:
    return strength / (strength + other)
