"""Interleaving of sources to target weights by Pfair scheduling, in DataFrame functions only.

Texts of a source, in an order that a hash of the id gives, fill blocks of equal size. With weight w,
block b of a source may not start before slot floor(b / w) and has to be done by slot ceil((b + 1) / w);
of the released blocks the one with the earliest deadline comes next. So after any slot each source is
less than one block away from its weight's share. Weights are whole parts of PARTS, and all times follow
from them in whole numbers, so nothing drifts however many slots there are.

When a source has no block left, a new phase begins: the weights of the others are scaled up to one and
times count from there. So every slot holds a block, and in each phase each source that still has blocks
stays within one block of its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

BLOCK_CHARS = 1 << 16
MOST_BLOCKS = 1 << 18  # and one for each source: beyond that blocks grow, not the schedule
PARTS = 1 << 40  # of all weights; times of 2**18 blocks stay whole numbers of 64 bits
ADDED = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset", "mix_phase")

# One slot: the released block of the earliest deadline; the state then counts it. `from` is where the phase
# began, `total` the parts of the sources that still have blocks, `done` their blocks in this phase.
_SLOT = """
(state, slot) -> transform(
  array(array_min(transform(parts, (p, i) -> if(
    state.left[i] > 0 and (state.done[i] * state.total) div p <= slot - state.from,
    named_struct('deadline', state.from + ((state.done[i] + 1) * state.total + p - 1) div p, 'i', i,
                 'release', state.from + (state.done[i] * state.total) div p), null)))),
  pick -> transform(
    array(state.left[pick.i] = 1L),
    dry -> named_struct(
      'done', transform(state.done, (v, i) -> if(dry, 0L, if(i = pick.i, v + 1, v))),
      'left', transform(state.left, (v, i) -> if(i = pick.i, v - 1, v)),
      'from', if(dry, slot + 1, state.from),
      'total', if(dry, state.total - parts[pick.i], state.total),
      'phase', if(dry, state.phase + 1, state.phase),
      'picks', concat(state.picks, array(named_struct(
        'i', pick.i, 'release', pick.release, 'deadline', pick.deadline, 'phase', state.phase)))))[0])[0]
"""
_PICKS = "array<struct<i:int,release:bigint,deadline:bigint,phase:int>>"
# All slots, in pieces whose lists are joined at the end: a list that grew by each slot would be copied for each.
_EDF = f"""
aggregate(
  sequence(0L, slots - 1, step),
  named_struct('done', transform(parts, x -> 0L), 'left', blocks, 'from', 0L, 'total', aggregate(parts, 0L, (a, x) -> a + x),
               'phase', 0, 'lists', cast(array() as array<{_PICKS}>)),
  (whole, first) -> transform(
    array(aggregate(
      sequence(first, least(first + step, slots) - 1),
      named_struct('done', whole.done, 'left', whole.left, 'from', whole.from, 'total', whole.total, 'phase', whole.phase, 'picks', cast(array() as {_PICKS})),
      {_SLOT})),
    x -> named_struct('done', x.done, 'left', x.left, 'from', x.from, 'total', x.total, 'phase', x.phase, 'lists', concat(whole.lists, array(x.picks))))[0],
  whole -> flatten(whole.lists))
"""


def block_size(sizes: DataFrame, least: int = BLOCK_CHARS, most: int = MOST_BLOCKS) -> int:
    """Characters of a block: `least`, or as many as keep the blocks of (source, chars) within `most` and one a source."""
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    return max(least, -(-total // most))


def schedule(sizes: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(source, block, slot, release, deadline, phase, weight) of every block of (source, chars).

    weights: (source, weight); sources it lacks, or gives no positive weight, are not scheduled. Without
    it a source weighs the square root of its characters. weight: its share of all, in whole parts of
    PARTS divided by their sum. The rows are as many as the blocks; one task works them out.
    """
    root = F.sqrt(F.col("chars").cast("double"))
    own = sizes.select("source", "chars", root.alias("weight")) if weights is None else sizes.join(weights, sizes["source"].eqNullSafe(weights["source"])).select(sizes["source"], "chars", weights["weight"].cast("double").alias("weight"))
    own = own.where("weight > 0 and chars > 0").withColumn("blocks", F.expr(f"(chars + {block_chars - 1}) div {block_chars}"))
    one = own.agg(F.sum("weight").alias("whole"), F.sum("blocks").alias("slots"), F.array_sort(F.collect_list(F.struct("source", "weight", "blocks"))).alias("all"))
    one = one.where(F.size("all") > 0).withColumn("parts", F.transform("all", lambda x: F.greatest(F.lit(1), F.round(x["weight"] / F.col("whole") * PARTS)).cast("long")))
    one = one.select("all", "slots", "parts", F.col("all.blocks").alias("blocks"), F.ceil(F.sqrt("slots")).cast("long").alias("step"))
    one = one.withColumn("sum", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x))
    turns = one.select("all", "parts", "sum", F.posexplode(F.expr(_EDF)).alias("slot", "x"))
    turns = turns.select(F.col("all")[F.col("x.i")]["source"].alias("source"), F.col("slot").cast("long").alias("slot"), "x.release", "x.deadline", "x.phase", (F.col("parts")[F.col("x.i")] / F.col("sum")).alias("weight"))
    return turns.withColumn("block", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1)


def mix(documents: DataFrame, weights: DataFrame | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents with the columns ADDED (a name that is taken gets underscores), sorted by none of them.

    mix_slot and mix_offset order the mixture: the slot of the block that the text begins in, and how
    many characters of its source come before it in that block. mix_release and mix_deadline bound the
    slot: release <= slot < deadline. mix_phase counts the sources that have run out before. Null sources
    form one source. Null and empty texts count as one character. A block that lies inside one long text
    has a slot in which nothing begins. Rows of sources without a weight are left out.
    """
    names = {}
    for name in (*ADDED, "q_source", "q_chars", "q_hash", "q_bucket", "q_before"):
        new = name
        while new in documents.columns or new in names.values():
            new += "_"
        names[name] = new
    c = lambda name: F.col(names[name])
    # Null and text sources in one not-null key, so that joins on it need no null test.
    source = F.when(F.col(source_column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_column).cast("string")))
    bits = store.parallelism(documents.sparkSession, 64).bit_length() + 2
    rows = documents.withColumns({
        names["q_source"]: source,
        names["q_chars"]: F.greatest(F.coalesce(F.length(F.col(text_column).cast("string")), F.lit(0)), F.lit(1)).cast("long"),
        names["q_hash"]: F.conv(F.substring(F.md5(F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (id_column, text_column)])), 1, 15), 16, 10).cast("long"),
    })
    rows = rows.withColumn(names["q_bucket"], F.shiftrightunsigned(c("q_hash"), 60 - bits))
    # A source is not summed up in one task: sums of its buckets first, then running sums inside each.
    buckets = rows.groupBy(names["q_source"], names["q_bucket"]).agg(F.sum(names["q_chars"]).alias("chars"))
    buckets = store.table(buckets, "buckets")
    sizes = buckets.groupBy(F.col(names["q_source"]).alias("source")).agg(F.sum("chars").alias("chars"))
    if weights is not None:
        weights = weights.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("source"), "weight").where("weight is not null").dropDuplicates(["source"])
    chars = block_size(sizes, block_chars)
    plan = store.table(schedule(sizes, weights, chars), "schedule")
    before = F.sum("chars").over(Window.partitionBy(names["q_source"]).orderBy(names["q_bucket"]).rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(names["q_source"], names["q_bucket"], F.coalesce(before, F.lit(0)).alias(names["q_before"]))
    rows = rows.join(buckets, [names["q_source"], names["q_bucket"]])
    inside = F.sum(names["q_chars"]).over(Window.partitionBy(names["q_source"], names["q_bucket"]).orderBy(names["q_hash"], id_column).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(names["q_before"], c("q_before") + F.coalesce(inside, F.lit(0)))
    rows = rows.withColumns({names["mix_block"]: F.expr(f"`{names['q_before']}` div {chars}"), names["mix_offset"]: c("q_before") % chars})
    # A row for each block: at most MOST_BLOCKS and one for each source, some 50 bytes each.
    slots = plan.select(F.col("source").alias(names["q_source"]), F.col("block").alias(names["mix_block"]), *[F.col(x).alias(names[f"mix_{x}"]) for x in ("slot", "release", "deadline", "phase")])
    rows = rows.join(F.broadcast(slots), [names["q_source"], names["mix_block"]])
    return rows.select(*documents.columns, *[names[n] for n in ADDED])
