"""Mixing sources to target weights by hash thresholds.

Every document gets a uniform key from the hash of its id and text. A source
takes the documents below a threshold, which is found without sorting documents: sizes
are summed by source and leading key bits, the bucket in which the running sum
passes the budget is split by the next bits, and so on until that bucket holds
one key. A smaller budget takes a subset of what a larger one takes, and a
rerun takes the same documents. A budget above the source's size takes all of
it once and a thresholded part again. Rows of one id and text share a key; where
the threshold is theirs, as many of these equal rows are taken as come nearest
to the budget, counted by task and numbered within tasks, so that a key with a
third of all rows is never in one place.

Targets: ``share`` of all sizes by weight, at most ``repeats`` times a source's
size; what is cut off goes to the others by weight.

Nulls: a null source is a source of its own, last in order; a null text has
size 0; a null id counts as an empty one. Which of equal rows are taken depends
on where they lie in the table, how many does not. An empty table gives no
rows; sources without words get the target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import WORD, join_small, narrow, packed
from pageloom.scratch import materialize

KEY_BITS = 60
_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition above these
LEVEL_BITS = 12


def source_targets(facts: DataFrame, weights: Sequence[int], share: float, repeats: int):
    """Target of each source; the table of sources is a dimension, not documents.

    Where sources are sorted by size over weight, those that reach their
    maximum come first, and the rest divide what remains by weight.
    """
    sizes = materialize(facts.groupBy("_s").agg(F.sum("size").alias("source_size")), "sources")
    last = F.when(F.col("_s") == "", 1).otherwise(0)
    rank = F.row_number().over(Window.orderBy(last, "_s")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), rank % len(weights) + 1)
    weighed = sizes.withColumn("_w", weight).withColumn(
        "_most", (F.col("source_size") * repeats).cast("double")
    )
    filling = Window.orderBy(F.col("_most") / F.col("_w"), "_s")
    budget = float(share) * F.sum("source_size").over(Window.partitionBy())
    level = (
        budget
        - F.coalesce(
            F.sum("_most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        )
    ) / F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("_level", level)
    free = F.when(F.col("_level") < F.col("_most") / F.col("_w"), F.col("_level"))
    common = F.max(free).over(Window.partitionBy())  # the first one's; levels fall from there
    target = F.when(free.isNotNull(), F.col("_w") * common).otherwise(F.col("_most"))
    # within the last bit of a division a source may look free but lie above its maximum
    return materialize(
        leveled.withColumn("target", F.least(target, F.col("_most"))).select(
            "_s", "source_size", "target"
        ),
        "targets",
    )


def thresholds(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, and the key at which the last copy ends."""
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    state = materialize(
        targets.withColumn("copies", whole.cast("long")).select(
            "*",
            (F.col("target") - F.col("copies") * F.col("source_size")).alias("_left"),
            F.lit(0).cast("long").alias("_prefix"),
            F.lit(True).alias("_open"),
            F.lit(None).cast("long").alias("_cross"),
            F.lit(0).cast("long").alias("_take"),
        ),
        "state",
    )
    running = Window.partitionBy("_s").orderBy("_bucket")
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, KEY_BITS // LEVEL_BITS + 1):
        shift = KEY_BITS - LEVEL_BITS * level
        open_ = state.filter("_open").select("_s", "_left", "_prefix")
        inside = join_small(facts, open_, "_s").filter(
            F.shiftright("_key", shift + LEVEL_BITS) == F.col("_prefix")
        )
        # at most 2 ** LEVEL_BITS rows for each source
        sums = inside.groupBy("_s", F.shiftright("_key", shift).alias("_bucket")).agg(
            F.sum("size").alias("_size"),
            F.count("*").alias("_rows"),
            F.min("_key").alias("_low"),
            F.max("_key").alias("_high"),
            F.first("_left").alias("_budget"),
        )
        passed = (
            sums.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
            .filter(F.col("_before") + F.col("_size") > F.col("_budget"))
            .groupBy("_s")
            .agg(F.min_by(F.struct("_bucket", "_size", "_rows", "_low", "_high", "_before"), "_bucket").alias("_b"))
        )
        single = F.col("_b._low") == F.col("_b._high")
        rest = F.col("_left") - F.col("_b._before")
        new = F.col("_open") & F.col("_b").isNotNull()
        take = F.floor(rest * F.col("_b._rows") / F.col("_b._size") + 0.5)
        state = materialize(
            state.join(passed, "_s", "left").select(
                "_s", "source_size", "target", "copies",
                F.when(new, rest).otherwise(F.col("_left")).alias("_left"),
                F.when(new, F.col("_b._bucket")).otherwise(F.col("_prefix")).alias("_prefix"),
                (new & ~single).alias("_open"),
                F.when(new & single, F.col("_b._low")).otherwise(F.col("_cross")).alias("_cross"),
                F.when(new & single, take).otherwise(F.col("_take")).alias("_take"),
            ),
            "state",
        )
        if state.filter("_open").isEmpty():
            break
    return state.select("_s", "source_size", "target", "copies", "_cross", "_take")


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _key(seed: str) -> Column:
    text = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))),
    )
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _limits(
    docs: DataFrame, weights: Sequence[int], share: float, repeats: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """Sizes and keys of the documents, written, and the thresholds of the sources."""
    facts = materialize(
        narrow(docs, "doc_id", "source", "text").select(
            "doc_id",
            _source().alias("_s"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
            _key(seed).alias("_key"),
        ),
        "facts",
    )
    return facts, thresholds(facts, source_targets(facts, weights, share, repeats))


def _taken(rows: DataFrame, limits: DataFrame, repeats: int) -> DataFrame:
    """``rows`` (with _s and _key) and how often each is taken, ``_n``, under the thresholds of its source."""
    marked = join_small(rows.withColumn("_mark", F.monotonically_increasing_id()), limits, "_s")
    at = F.coalesce(F.col("_key") == F.col("_cross"), F.lit(False))
    part = F.shiftright("_mark", _ROW_BITS)
    crossing = marked.filter(at).withColumn("_part", part)
    # a row for each source and task that has rows at the threshold
    counts = materialize(crossing.groupBy("_s", "_part").agg(F.count("*").alias("_rows")), "crossing")
    earlier = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_mark"))
    numbered = crossing.withColumn("_place", place).join(offsets, ["_s", "_part"])
    last = F.when(at, F.col("_place") + F.col("_offset") <= F.col("_take")).otherwise(
        F.coalesce(F.col("_key") < F.col("_cross"), F.lit(False))
    )
    # a source without words has no threshold; its documents are taken once
    times = F.when(F.col("source_size") == 0, 1).otherwise(F.col("copies") + last.cast("int"))
    times = F.least(times, F.lit(repeats)).cast("int").alias("_n")
    none = F.lit(0).alias("_place"), F.lit(0).cast("long").alias("_offset")
    columns = [*rows.columns, *[c for c in limits.columns if c != "_s"], "_place", "_offset"]
    both = marked.filter(~at).select("*", *none).select(columns).unionByName(numbered.select(columns))
    return both.select(*rows.columns, "source_size", "target", times)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), times."""
    facts, limits = _limits(docs, weights, share, repeats, seed)
    return _taken(facts, limits, repeats).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("_n")).alias("taken"), F.col("_n").alias("times")
    )


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them."""
    _, limits = _limits(docs, weights, share, repeats, seed)
    placed = packed(docs, _source().alias("_s"), _key(seed).alias("_key"))
    taken = _taken(placed, limits, repeats).select("_doc", "_n").filter("_n > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), "_n"))).select("_doc.*")
