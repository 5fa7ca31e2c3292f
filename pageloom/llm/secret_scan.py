"""Secrets in texts: fixed forms, and strings that look random.

Three base kinds are regular expressions. Besides them, strings of ``shortest``
or more characters are judged by two character Markov models, one of random
strings and one of ordinary identifiers. Each gives the log-probability of a
string's characters after its first; a string whose log-likelihood ratio
passes ``threshold`` is a span of kind ``markov`` unless it meets a base span.

The models are trained from labelled samples (string, is_secret). By default
these come from the texts themselves: values of base spans are random strings,
words of a sample of about ``sample`` documents (by hash of the id) without
those spans are identifiers. Pairs of printable ASCII characters are counted;
a pair's probability is drawn to that of its second character by the weight of
_BACKOFF pairs, and single characters are counted with add-one smoothing.

Positions are code points, ends exclusive. Nulls: a null text is empty, which
has no spans and the digest of the empty string. Repeated rows give repeated
rows; an empty table gives no rows and models without a preference. All on
DataFrame functions: matches and the gaps between them come from two splits of
the text by one pattern, positions from their lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import narrow
from pageloom.scratch import materialize

# (kind, pattern, group whose length counts, its least length). The last two take
# whole runs of one class, so their least length is asked for in the pattern: a
# shorter run holds no match. A short assignment still uses up its text.
BASE = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
_FIRST, _CODES = 32, 96  # printable ASCII and one class for all else
_BACKOFF = 8.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(pieces: Column, offset: Column) -> Column:
    """(start, value) of pieces (gap, size, value) that follow ``offset``; copies what it has at each step."""
    state = F.struct(offset.alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        start = s["at"] + piece["gap"]
        found = F.struct(start.alias("start"), piece["value"].alias("value"))
        return F.struct((start + piece["size"]).alias("at"), F.concat(s["found"], F.array(found)).alias("found"))

    return F.aggregate(pieces, state, step, lambda s: s["found"])


def _matches(text: Column, pattern: str) -> Column:
    """(start, value) of the non-overlapping matches, leftmost first; for texts that have some.

    Starts are sums of the lengths before. They are added up for runs of about
    the root of the matches' number, and within each run, so a text of very many
    matches is not gone through again at each.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        values,
        lambda gap, v: F.struct(F.length(gap).alias("gap"), F.length(v).alias("size"), v.alias("value")),
    )
    pieces = F.filter(pieces, lambda piece: piece["value"].isNotNull())

    def by_runs(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(pieces), width)
        runs = F.transform(firsts, lambda first: F.slice(pieces, first, width))

        def together(runs: Column) -> Column:
            # each run as one piece without a gap: its start is what lies before it
            whole = F.transform(
                runs,
                lambda run: F.struct(
                    F.lit(0).alias("gap"),
                    F.aggregate(run, F.lit(0), lambda n, piece: n + piece["gap"] + piece["size"]).alias("size"),
                    F.lit("").alias("value"),
                ),
            )
            return F.flatten(F.zip_with(runs, _placed(whole, F.lit(0)), lambda run, at: _placed(run, at["start"])))

        return _let(runs, together)

    return _let(pieces, by_runs)


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans (sorted, apart from each other) overlaps [start, end): a binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    state = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        beyond = F.get(spans, middle)["end"] > start
        low = F.when((s["low"] < s["high"]) & ~beyond, middle + 1).otherwise(s["low"])
        high = F.when((s["low"] < s["high"]) & beyond, middle).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    first = F.aggregate(steps, state, step, lambda s: s["low"])
    return F.coalesce(F.get(spans, first)["start"] < end, F.lit(False))


def _spans(text: Column, rank: int) -> Column:
    kind, pattern, group, least = BASE[rank]

    def long_enough(m: Column) -> Column:
        value = F.regexp_extract(m["value"], pattern, group) if group else m["value"]
        return F.length(value) >= least

    def span(m: Column) -> Column:
        value = F.regexp_extract(m["value"], pattern, group) if group else m["value"]
        end = m["start"] + F.length(m["value"])
        return F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            end.alias("end"), value.alias("value"),
        )

    found = F.transform(F.filter(_matches(text, pattern), long_enough), span)
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, base spans and candidate spans of every text, written."""
    text = F.col("text")
    kinds = [f"_base{rank}" for rank in range(len(BASE))]
    spanned = narrow(docs, "doc_id", "text").select(
        "doc_id", "text", *[_spans(text, rank).alias(kind) for rank, kind in enumerate(kinds)]
    )
    candidate = CANDIDATE % shortest
    free = F.when(
        text.rlike(candidate),
        F.transform(
            _matches(text, candidate),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("markov").alias("kind"),
                (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"),
            ),
        ),
    ).otherwise(F.array().cast(f"array<{_SPAN}>"))

    def apart(found: Column, kind: str) -> Column:
        def without(spans: Column) -> Column:
            return F.filter(found, lambda c: ~_meets(spans, c["start"], c["end"]))

        return F.when(F.size(kind) == 0, found).otherwise(_let(F.col(kind), without))

    spanned = spanned.withColumn("_free", free)
    for kind in kinds:
        spanned = spanned.withColumn("_free", apart(F.col("_free"), kind))
    return materialize(
        spanned.select("doc_id", F.concat(*kinds).alias("base"), F.col("_free").alias("free")), "spans"
    )


def _code(char: Column) -> Column:
    """0 to 94 for printable ASCII, 95 for other characters."""
    number = F.ascii(char) - _FIRST
    return F.when(number.between(0, _CODES - 2), number).otherwise(_CODES - 1)


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), _code)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs from (string, is_secret), as one array.

    Pairs are counted by string first, so repeated strings cost nothing more.
    """
    width = F.length("string") - 1
    pairs = _let(
        _codes(F.col("string")),
        lambda codes: F.zip_with(
            F.slice(codes, F.lit(1), width), F.slice(codes, F.lit(2), width), lambda a, b: a * _CODES + b
        ),
    )
    counts = (
        samples.filter(F.length("string") >= 2)
        .groupBy("string", "is_secret")
        .agg(F.count("*").alias("n"))
        .select("is_secret", "n", F.explode(pairs).alias("pair"))
        .groupBy("is_secret", "pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )  # at most 2 * 96 * 96 rows
    tables = {}
    for label in (False, True):
        seen = [0] * _CODES**2
        for row in counts:
            if row["is_secret"] == label:
                seen[row["pair"]] = row["n"]
        rows = [seen[i : i + _CODES] for i in range(0, len(seen), _CODES)]
        single = [(sum(column) + 1) / (sum(seen) + _CODES) for column in zip(*rows)]
        tables[label] = [
            math.log((n + _BACKOFF * p) / (sum(row) + _BACKOFF)) for row in rows for n, p in zip(row, single)
        ]
    return [a - b for a, b in zip(tables[True], tables[False])]


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string, random over ordinary; one pass over its characters."""
    lookup = F.lit(table).cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

    def step(s: Column, code: Column) -> Column:
        gain = F.when(s["last"] >= 0, F.get(lookup, s["last"] * _CODES + code)).otherwise(0.0)
        return F.struct(code.alias("last"), (s["total"] + gain).alias("total"))

    return F.aggregate(_codes(value), start, step, lambda s: s["total"])


def identifiers(docs: DataFrame, sample: int) -> DataFrame:
    """Words of a sample of documents without base spans, as ordinary strings."""
    count = docs.count()
    share = min(1.0, sample / max(1, count))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("identifiers")), F.lit(1 << 30)) < int(share * (1 << 30))
    text = narrow(docs, "doc_id", "text").filter(chosen)
    cleaned = F.col("text")
    for _, pattern, _, _ in BASE:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    words = text.select(F.explode(F.regexp_extract_all(cleaned, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("string"))
    return words.select("string", F.lit(False).alias("is_secret"))


def secret_scan(
    docs: DataFrame,
    samples: DataFrame | None = None,
    shortest: int = 16,
    threshold: float = 10.0,
    sample: int = 20_000,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    ``spans`` lists kind:start:end of all spans by start, then kind.
    """
    found = scan(docs, shortest)
    if samples is None:
        secrets = found.select(F.explode("base.value").alias("string"), F.lit(True).alias("is_secret"))
        samples = secrets.unionByName(identifiers(docs, sample))
    table = train(samples)
    judged = found.withColumn(
        "_markov", F.filter("free", lambda c: ratio(c["value"], table) > threshold)
    )

    def written(spans: Column) -> Column:
        lines = F.transform(
            F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(lines, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return judged.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "_markov")).alias("spans"),
        F.size("_markov").cast("long").alias("n_markov"),
    )
