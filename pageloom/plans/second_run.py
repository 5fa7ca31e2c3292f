"""A further run of the job over new and changed pages, without analysing the others again.

The stored version (``sources.versions``) is brought up to date: what a changed
page contributed is subtracted, what the new records contribute is added. Terms
and pages that are known keep their ids, new ones are numbered after them. A
changed page keeps the spelling of its URL. Records of unchanged pages are not
needed: no word or n-gram of theirs is made again. Their stored word counts are
asked for by page id where the links to a page changed, their n-gram ids are searched
where lists made anew have them, and their links are counted as they are stored.
Facts are added in new segments, the old ones stay as they are.

The result equals a full run over all pages in their newest form, but for the
order of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.urls import normalize_url
from pageloom.operators import frequency as freq
from pageloom.operators import graph
from pageloom.operators.ids import assign_ids
from pageloom.operators.lookup import MAX_IDS
from pageloom.operators.similarity import beats, kth, top_pairs, top_shared
from pageloom.plans.job import link_facts, load, run
from pageloom.scratch import materialize, own_scratch
from pageloom.sources.versions import LIVE, entry, extend, read_version

_STATIC = ["id_page", "title", "url", "edits_per_day", "distinct_links", "quant_set2", "quant_set3"]


def _last(table: DataFrame, column: str) -> int:
    return table.agg(F.max(column)).first()[0] or 0


def _of_pages(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts joined with some pages; a few ids become a filter that prunes the sorted files."""
    few = [row[0] for row in pages.select("id_page").limit(MAX_IDS + 1).collect()]
    if len(few) <= MAX_IDS:
        facts = facts.filter(F.col("id_page").isin(few))
    return facts.join(pages, "id_page")


def identified(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Records with the id (and URL) of the stored page they renew, or a new id; ``known`` tells."""
    key = normalize_url(F.col("url")).alias("_key")
    known = stored.select(key, "id_page", F.col("url").alias("_url"))
    found = materialize(pages.select("url", key).join(known, "_key", "left").drop("_key"), "found")
    fresh = assign_ids(found.filter("id_page is null").select("url"), ["url"], "id_page", _last(stored, "id_page"))
    ids = found.filter("id_page is not null").select("url", "id_page", "_url", F.lit(True).alias("known"))
    ids = ids.unionByName(fresh.select("url", "id_page", F.col("url").alias("_url"), F.lit(False).alias("known")))
    return pages.join(ids, "url").drop("url").withColumnRenamed("_url", "url")


def _dictionary(
    counts: DataFrame, stored: DataFrame, keys: list[str], id_column: str
) -> tuple[DataFrame, DataFrame]:
    """Terms of this run with their ids and pages, and those of them that are new."""
    terms = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("page_count"))
    found = materialize(terms.join(stored.select(id_column, *keys), keys, "left"), "found")
    # new terms keep their pages while they are numbered, so no join brings the ids back
    unknown = found.filter(F.col(id_column).isNull()).drop(id_column)
    fresh = assign_ids(unknown, keys, id_column, _last(stored, id_column))
    known = found.filter(F.col(id_column).isNotNull())
    return known.unionByName(fresh), fresh.drop("page_count")


def _words(
    batch: DataFrame, touched: DataFrame, stored: dict[str, DataFrame], page: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The word table, and the facts of this run's pages."""
    shares = materialize(freq.page_word_share(batch), "shares")
    old = stored["word"].select("id_word", "word", "total_repetitions", "link_repetitions")
    terms, fresh = _dictionary(shares, old, ["word"], "id_word")
    facts = materialize(freq.relation(shares, terms, ["word"]).drop("word"), "page_word")

    # how many links point to each page, before and now
    times = page.select("id_page", F.col("total_repetitions").alias("now")).join(
        stored["page"].select("id_page", F.col("total_repetitions").alias("then")), "id_page", "left"
    )
    times = times.withColumn("then", F.coalesce("then", F.lit(0)))
    moved = materialize(
        times.join(touched.select("id_page", F.lit(True).alias("mine")), "id_page", "left").filter(
            F.col("mine") | (F.col("now") != F.col("then"))
        ),
        "moved",
    )
    before = _of_pages(stored["page_word"].select("id_page", "id_word", "quantity"), moved)
    mine = F.coalesce("mine", F.lit(False))
    change = before.select(
        "id_word",
        F.when(mine, -F.col("quantity")).otherwise(0).alias("words"),
        (F.col("quantity") * (F.when(mine, 0).otherwise(F.col("now")) - F.col("then"))).alias("links"),
    ).unionByName(
        facts.join(moved, "id_page").select(
            "id_word", F.col("quantity").alias("words"), (F.col("quantity") * F.col("now")).alias("links")
        )
    )
    change = change.groupBy("id_word").agg(F.sum("words").alias("words"), F.sum("links").alias("links"))
    zero = F.lit(0).cast("long")
    every = old.unionByName(
        fresh.select("id_word", "word", zero.alias("total_repetitions"), zero.alias("link_repetitions"))
    )
    word = every.join(change, "id_word", "left").select(
        "id_word",
        "word",
        (F.col("total_repetitions") + F.coalesce("words", zero)).alias("total_repetitions"),
        (F.col("link_repetitions") + F.coalesce("links", zero)).alias("link_repetitions"),
    )
    return word.filter("total_repetitions > 0"), facts


def _grams(
    batch: DataFrame, touched: DataFrame, stored: dict[str, DataFrame], n: int
) -> tuple[DataFrame, DataFrame]:
    """The dictionary of n-grams, and the facts of this run's pages."""
    keys, number = freq.gram_words(n), f"id_set{n}"
    counts = materialize(freq.gram_page_frequency(batch, n), f"set{n}_page")
    old = stored[f"set{n}"].select(number, *keys, "page_count")
    terms, fresh = _dictionary(counts, old, keys, number)
    facts = materialize(
        freq.relation(counts, terms, keys).select(number, "id_page", "repetition_count"), f"set{n}_page"
    )
    gone = stored[f"set{n}_page"].join(touched, "id_page", "left_semi")
    change = facts.select(number, F.lit(1).alias("pages")).unionByName(gone.select(number, F.lit(-1).alias("pages")))
    change = change.groupBy(number).agg(F.sum("pages").alias("pages"))
    every = old.unionByName(fresh.select(number, *keys, F.lit(0).cast("long").alias("page_count")))
    gram = every.join(change, number, "left").select(
        number, *keys, (F.col("page_count") + F.coalesce("pages", F.lit(0))).alias("page_count")
    )
    return gram.filter("page_count > 0"), facts


def _partners(
    postings: DataFrame, touched: DataFrame, lists: DataFrame, k: int, symmetric: bool
) -> tuple[DataFrame, DataFrame]:
    """The lists of partners that are other than before, and whose lists they are.

    ``postings`` are (item, page) of all pages now, ``lists`` the stored
    (page1, page2, shared, rank). A list is made anew if it is of a page of this
    run or names one that changed. Any other list can only gain pages of this
    run, so it is touched only if one of those beats its last place.

    All come from one search over the items that pages of lists to be made anew hold.
    What a page of this run shares is complete there. Two other pages may share more
    than is seen, so a page of this run that belongs into a list is never crowded out.
    """
    known = touched.filter("known").select(F.col("id_page").alias("page2"))
    stale = materialize(
        touched.select(F.col("id_page").alias("page1"))
        .unionByName(lists.join(known, "page2", "left_semi").select("page1"))
        .distinct(),
        "stale",
    )
    held = postings.join(stale.toDF("page"), "page", "left_semi").select("item").distinct()
    near = postings.join(held, "item", "left_semi").select("item", F.col("page").alias("member"))
    best = materialize(top_shared(near, k, symmetric), "best")

    anew = best.join(stale, "page1", "left_semi")
    fresh = best.drop("rank").join(touched.select(F.col("id_page").alias("page2")), "page2", "left_semi")
    offered = fresh.join(stale, "page1", "left_anti").join(kth(lists, k), "page1", "left")
    better = materialize(offered.filter(beats()).select("page1", "page2", "shared"), "better")
    owners = better.select("page1").distinct()
    kept = lists.join(owners, "page1", "left_semi").select("page1", "page2", "shared")
    improved = top_pairs(kept.unionByName(better), k)
    return anew.select(*improved.columns).unionByName(improved), stale.unionByName(owners)


def update(spark: SparkSession, source: str, folder: str, k: int = 10) -> dict[str, int]:
    """Take the records of ``source`` into the stored version and publish the next one.

    Returns what ``run`` returns, and how many of the pages were ``changed``.
    Without a stored version it is a first run; without pages nothing is published.
    """
    places = entry(spark, folder)
    if places is None:
        return {**run(spark, source, folder), "changed": 0}
    with own_scratch(spark):
        stored = read_version(spark, folder, state=True)
        pages, counts = load(spark, source)
        batch = materialize(identified(pages, stored["page"]), "batch")
        touched = materialize(batch.select("id_page", "known"), "touched")
        counts["changed"] = touched.filter("known").count()
        if not counts["pages"]:
            return counts
        # from here on the stored rows of changed pages do not count any more
        rest = {
            name: stored[name].join(touched, "id_page", "left_anti")
            for name in ("page", "link", "set2_page", "set3_page")
        }

        links = materialize(link_facts(batch), "link")
        every_link = rest["link"].unionByName(links)
        static = rest["page"].select(*_STATIC).unionByName(freq.page_stats(batch).select(*_STATIC))
        edges = every_link.filter("src <> dst").select("src", "dst")
        repeated = every_link.groupBy(F.col("dst").alias("link")).agg(F.sum("n").alias("total_repetitions"))
        page = materialize(
            graph.page_repetitions(graph.page_connectivity(static, edges, "url"), repeated, "url"), "page"
        )

        word, page_word = _words(batch, touched, stored, page)
        replaced = {"page": page, "word": materialize(word, "word")}
        segments = {
            "link": links,
            "page_word": page_word.select("id_page", "id_word", "quantity", "percentage", "fraction"),
            "word_page": page_word.select("id_word", "id_page", "quantity"),
        }
        first = [F.lit(0).alias(column) for column in LIVE]
        live = stored["live"].select("id_page", *LIVE).unionByName(
            touched.filter("not known").select("id_page", *first)
        )
        live = _moved(live, "facts", touched.select("id_page"), len(places["page_word"]))
        for n in (2, 3):
            replaced[f"set{n}"], facts = _grams(batch, touched, stored, n)
            segments[f"set{n}_page"] = facts
            now = rest[f"set{n}_page"].select(f"id_set{n}", "id_page").unionByName(facts.select(f"id_set{n}", "id_page"))
            lists = stored[f"shared{n}"].select(
                F.col("id_page1").alias("page1"), F.col("id_page2").alias("page2"),
                F.col("shared_sets_count").alias("shared"), "rank",
            )
            found, owners = _partners(now.toDF("item", "page"), touched, lists, k, symmetric=n == 3)
            segments[f"shared{n}"] = materialize(found, f"shared{n}").select(
                F.col("page1").alias("id_page1"), F.col("page2").alias("id_page2"),
                F.col("shared").alias("shared_sets_count"), "rank",
            )
            live = _moved(live, f"near{n}", owners.toDF("id_page"), len(places[f"shared{n}"]))
        extend(folder, {**replaced, "live": materialize(live, "live")}, segments)
    return counts


def _moved(live: DataFrame, column: str, pages: DataFrame, segment: int) -> DataFrame:
    """``live`` with the given pages' rows in a new segment."""
    hit: Column = F.col("_hit").isNotNull()
    marked = live.join(pages.withColumn("_hit", F.lit(True)), "id_page", "left")
    return marked.withColumn(column, F.when(hit, F.lit(segment)).otherwise(F.col(column))).drop("_hit")
