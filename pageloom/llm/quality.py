"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of six transformed statistics. For each language and
source the centre and covariance are estimated from the share of its documents
that concentration steps settle on: start from medians and their deviations,
take the nearest documents, estimate anew, repeat, and finally re-estimate from
all documents within the usual chi-square bound. Documents whose squared
Mahalanobis distance exceeds the cutoff are rejected, besides those that fail
the base rules.

A step is one aggregation by group and distance bin; the nearest documents are
those of the lowest bins, so nothing is sorted and no group meets in one task.
Statistics are whole numbers (1/1024), so sums are exact and reruns agree. A
deviation is never taken as less than a floor for its statistic, because most
texts have no symbols or repetitions at all.

Groups with fewer than ``least`` documents are pooled by language, and pools
that stay small with each other; if that is still too small only the base
rules apply.

Nulls: a null text has no words and fails; null languages and sources are
groups of their own. Repeated rows count as often as they occur and give
repeated rows. An empty table gives no rows. All on DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import SPACES, WORD, join_small
from pageloom.scratch import materialize

SCALE = 1024
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
# smallest standard deviation of each statistic, in its own unit
FLOORS = {
    "word_length": 0.06,
    "symbols": 0.6,
    "dup_lines": 0.8,
    "repeats": 0.8,
    "runs": 0.5,
    "capitals": 0.5,
}
_BINS_PER_OCTAVE = 8


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of dimensions."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def chi_square_point(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < share else (low, middle)
    return high


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """Counts of each text: the base statistics and those that the vector needs besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *carried,
        text.alias("_text"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    words, n = F.col("_words"), F.size("_words")
    windows = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
    )
    hashed = split.select(
        *carried,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit("[A-Z]")).alias("_capitals"),
        F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).alias("_runs"),
        F.when(n >= WINDOW, windows).alias("_windows"),
    )
    again = F.size("_windows") > F.size(F.array_distinct("_windows"))
    sorted_ = hashed.withColumn(
        "_sorted",
        F.when(
            again,
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ordered = F.col("_sorted")
    same = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.coalesce(F.get(ordered, k - 1)["h"], x["h"] + 1))
        | (x["h"] == F.coalesce(F.get(ordered, k + 1)["h"], x["h"] + 1)),
    )
    placed = sorted_.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x["i"])))
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(
            starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))
        ),
        F.lit(0).cast("long"),
        lambda total, c: total + c,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(
        "_windows", "_sorted", "_starts"
    )


def vector() -> dict[str, Column]:
    """The transformed statistics; short texts are drawn to what is usual."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def share(part: str, whole: Column, unit: int) -> Column:
        return F.log(1 + unit * F.col(part) / whole)

    values = {
        "word_length": F.log((chars + 100) / (n + 20)),
        "symbols": share("n_symbols", chars + 200, 1000),
        "dup_lines": share("n_dup_lines", F.col("_n_lines") + 5, 100),
        "repeats": share("n_repeat_words", n + 10, 100),
        "runs": share("_runs", n + 20, 100),
        "capitals": share("_capitals", chars + 100, 100),
    }
    return {name: F.round(v * SCALE).cast("long") for name, v in values.items()}


def _with_distance(facts: DataFrame, names: list[str]) -> DataFrame:
    """Squared Mahalanobis distance ``_d2`` under columns m_i (centre) and l_i_j (Cholesky factor).

    In steps, so that each solved component is computed once.
    """
    for i, name in enumerate(names):
        value = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        facts = facts.withColumn(f"_y{i}", value / F.col(f"l_{i}_{i}"))
    squares = [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(names))]
    return facts.withColumn("_d2", sum(squares[1:], squares[0])).drop(*[f"_y{i}" for i in range(len(names))])


def _factor(sums: DataFrame, names: list[str], floors: list[float], factor: float) -> DataFrame:
    """Centre and Cholesky factor from n, s_i and s_i_j of each group."""
    p = len(names)
    table = sums
    for i in range(p):
        table = table.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor
            table = table.withColumn(f"c_{i}_{j}", cov + floors[i] ** 2 if i == j else cov)
    for j in range(p):
        for i in range(j, p):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                entry = F.sqrt(F.greatest(value, F.lit((floors[i] / 10) ** 2)))
            else:
                entry = value / F.col(f"l_{j}_{j}")
            table = table.withColumn(f"l_{i}_{j}", entry)
    keep = [f"m_{i}" for i in range(p)] + [f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return materialize(table.select("_g", *keep), "estimate")


def _moments(names: list[str]) -> list[Column]:
    sums = [F.count("*").alias("n")]
    for i, a in enumerate(names):
        sums.append(F.sum(a).alias(f"s_{i}"))
        sums += [F.sum(F.col(a) * F.col(names[j])).alias(f"s_{i}_{j}") for j in range(i + 1)]
    return sums


def _total(names: list[str]) -> list[Column]:
    p = len(names)
    columns = ["n", *[f"s_{i}" for i in range(p)], *[f"s_{i}_{j}" for i in range(p) for j in range(i + 1)]]
    return [F.sum(c).alias(c) for c in columns]


def robust_distances(
    facts: DataFrame, floors: dict[str, float], share: float = 0.75, steps: int = 3
) -> DataFrame:
    """``facts`` (written; ``_g`` and whole-number statistics) with ``_d2``, the squared distance."""
    names, low = list(floors), [f * SCALE for f in floors.values()]
    p = len(names)
    # exact medians: a statistic has a bounded number of values
    medians = facts.groupBy("_g").agg(
        *[F.percentile(name, F.lit(0.5)).alias(f"m_{i}") for i, name in enumerate(names)]
    )
    medians = materialize(medians, "medians")
    spread = join_small(facts, medians, "_g").groupBy("_g").agg(
        *[
            F.percentile(F.abs(F.col(name) - F.col(f"m_{i}")).cast("long"), F.lit(0.5)).alias(f"d_{i}")
            for i, name in enumerate(names)
        ]
    )
    start = medians.join(spread, "_g")
    for i in range(p):
        for j in range(i + 1):
            entry = F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(low[i])) if i == j else F.lit(0.0)
            start = start.withColumn(f"l_{i}_{j}", entry)
    estimate = materialize(start.drop(*[f"d_{i}" for i in range(p)]), "estimate")

    # the covariance of the nearest share of a normal sample is too small by this
    factor = share / chi_square(chi_square_point(share, p), p + 2)
    running = Window.partitionBy("_g").orderBy("_bin")
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    for _ in range(steps):
        near = _with_distance(join_small(facts, estimate, "_g"), names)
        distance = F.floor(F.log2(F.greatest("_d2", F.lit(2.0**-20))) * _BINS_PER_OCTAVE)
        binned = near.groupBy("_g", F.least(distance, F.lit(1000)).alias("_bin")).agg(*_moments(names))
        chosen = (
            binned.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("_all", F.sum("n").over(whole))
            .filter(F.col("_before") < F.ceil(share * F.col("_all")))
        )
        estimate = _factor(chosen.groupBy("_g").agg(*_total(names)), names, low, factor)
    bound = chi_square_point(0.975, p)
    within = _with_distance(join_small(facts, estimate, "_g"), names).filter(F.col("_d2") <= bound)
    tail = 0.975 / chi_square(bound, p + 2)
    final = _factor(within.groupBy("_g").agg(*_moments(names)), names, low, tail)
    drop = [c for c in final.columns if c != "_g"]
    return _with_distance(join_small(facts, final, "_g", "left"), names).drop(*drop)


def _groups(facts: DataFrame, least: int) -> DataFrame:
    """``_g``: language and source, or the pool of small groups."""

    def part(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))

    named = facts.withColumn("_l", part("lang")).withColumn(
        "_key", F.concat(F.hex(F.col("_l")), F.lit("/"), F.hex(part("source")))
    )
    counts = named.groupBy("_key", "_l").agg(F.count("*").alias("_n"))
    small = F.when(F.col("_n") < least, F.col("_n")).otherwise(0)
    in_language = F.sum(small).over(Window.partitionBy("_l"))
    name = (
        F.when(F.col("_n") >= least, F.col("_key"))
        .when(in_language >= least, F.concat(F.lit("pool/"), F.hex("_l")))
        .otherwise(F.lit("pool"))
    )
    table = materialize(counts.select("_key", name.alias("_g")), "group_names")
    return materialize(join_small(named, table, "_key").drop("_l", "_key"), "statistics")


def quality(docs: DataFrame, cutoff: float = 0.99999, least: int = 60) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept, distance.

    ``cutoff`` is the share of ordinary documents that a normal sample would keep.
    """
    counted = statistics(docs.select("doc_id", "lang", "source", "text"), "doc_id", "lang", "source")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # written before the transforms so that texts are read once
    counted = materialize(
        counted.select("doc_id", "lang", "source", *base, "_n_lines", "_capitals", "_runs"), "counts"
    )
    vectors = counted.select("doc_id", "lang", "source", *base, *[v.alias(k) for k, v in vector().items()])
    facts = _groups(vectors, least)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = robust_distances(facts, FLOORS)
    sizes = materialize(facts.groupBy("_g").agg(F.count("*").alias("_members")), "sizes")
    far = (F.col("_d2") > chi_square_point(cutoff, len(FLOORS))) & (F.col("_members") >= least)
    return join_small(judged, sizes, "_g").select(
        "doc_id",
        *base,
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.col("_d2").alias("distance"),
    )
