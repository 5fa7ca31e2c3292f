"""One function per registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.html import heading
from pageloom.functions.text import ngrams, tokens
from pageloom.functions.urls import page_url, title_key
from pageloom.operators import frequency as freq
from pageloom.operators import graph, lookup, prepare
from pageloom.operators import similarity as sim
from pageloom.operators.ids import assign_ids, number_groups
from pageloom.plans import fixtures as fx
from pageloom.plans.job import ORDERED, analysis_tables, run
from pageloom.plans.second_run import update
from pageloom.scratch import discard, materialize, scratch_path
from pageloom.sources import sinks
from pageloom.sources.records import load_pages, read_first, read_tables, spread, stored_sizes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(items: str, separator: str = " ") -> list:
    return [
        F.size(items).cast("long").alias("n_items"),
        F.array_join(items, separator).alias("items"),
    ]


# Sources and sinks


@query
def load_pages_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    records = fx.corpus_with_rates(spark, sf_dir).withColumn("links", F.array().cast("array<string>"))
    fields = ["url", "title", "word_list", "bigrams", "trigrams", "edits_per_day", "links"]
    sinks.write_jsonl(records.select(*fields), path)
    return load_pages(spark, path).select(
        "url",
        "title",
        F.array_join("word_list", " ").alias("words"),
        F.size("bigrams").cast("long").alias("n_bigrams"),
        F.size("trigrams").cast("long").alias("n_trigrams"),
        F.coalesce("edits_per_day", F.lit(0.0)).alias("edits_per_day"),
    )


QUERIES["load_pages"] = QUERIES.pop("load_pages_jsonl")


@query
def sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table")
    totals = freq.word_totals(fx.corpus(spark, sf_dir))
    sinks.write_table(totals, path, ["word"])
    sinks.write_table(totals, path, ["word"])
    return spark.read.parquet(path)


@query
def incremental_new_pages(spark, sf_dir):
    incoming = fx.documents(spark, sf_dir).select("id_page", "url")
    processed = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id_page"))
    return prepare.new_pages(incoming, processed, "id_page")


@query
def dict_insert_ignore(spark, sf_dir):
    existing = assign_ids(fx.words_of(spark, sf_dir, "benchmark").select("word"), ["word"], "id_word")
    incoming = fx.words_of(spark, sf_dir, "documents").select("word")
    return sinks.insert_if_absent(existing, incoming, ["word"], "id_word")


@query
def dict_upsert(spark, sf_dir):
    existing = fx.words_of(spark, sf_dir, "benchmark")
    incoming = fx.words_of(spark, sf_dir, "documents")
    return sinks.upsert(existing, incoming, ["word"])


@query
def page_update_connectivity(spark, sf_dir):
    pages = (
        fx.vertices(spark, sf_dir)
        .join(fx.rates(spark, sf_dir), "id_page", "left")
        .join(graph.link_counts(fx.links(spark, sf_dir)), "id_page", "left")
        .select(
            "id_page",
            "url",
            F.coalesce("edits_per_day", F.lit(0.0)).alias("edits_per_day"),
            F.coalesce("distinct_links", F.lit(0)).alias("quant_diff_urls"),
        )
    )
    updates = fx.connectivity(spark, sf_dir)
    return sinks.update_by_key(pages, updates, "id_page", {"quant_diff_urls": "total_connections"})


# Preparation


@query
def page_text(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages").select("page_id", "html")
    return prepare.page_text(spread(pages, "page_id"))


@query
def page_text_innermost(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages").select("page_id", "html")
    return prepare.page_text(spread(pages, "page_id"), repeat=False)


@query
def page_title(spark, sf_dir):
    return prepare.page_title(fx.read(spark, sf_dir, "pages"), fallback="url")


@query
def tokenize(spark, sf_dir):
    docs = spread(fx.documents(spark, sf_dir), "id_page")
    docs = docs.withColumn("words", tokens(F.col("text")))
    return docs.select("id_page", *_joined("words"))


@query
def tokenize_stopwords(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("id_page", *_joined("word_list"))


@query
def ngrams_bigram(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).withColumn("grams", ngrams(F.col("word_list"), 2))
    return docs.select("id_page", *_joined("grams", "|"))


@query
def ngrams_trigram(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).withColumn("grams", ngrams(F.col("word_list"), 3))
    return docs.select("id_page", *_joined("grams", "|"))


@query
def page_links(spark, sf_dir):
    return prepare.page_links(fx.read(spark, sf_dir, "pages"), fx.RULES)


@query
def page_url_build(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages").withColumn("title", heading(F.col("html")))
    return pages.select("page_id", page_url(fx.RULES.base, F.col("title")).alias("page_url"))


@query
def link_title_key(spark, sf_dir):
    built = page_url_build(spark, sf_dir)
    return built.select("page_id", title_key(F.col("page_url")).alias("title_key"))


@query
def edit_rate(spark, sf_dir):
    return fx.rates(spark, sf_dir)


@query
def url_dedup(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages").select("page_id", "url")
    copies = pages.select(
        (F.col("page_id") + 1_000_000).alias("page_id"),
        F.concat(F.upper("url"), F.lit("/")).alias("url"),
    )
    framed = pages.select(
        (F.col("page_id") + 2_000_000).alias("page_id"),
        F.concat(F.lit("\n"), "url", F.lit("\t")).alias("url"),
    )
    return prepare.dedup_by_url(pages.unionAll(copies).unionAll(framed), "url", "page_id")


# Words and n-grams


@query
def page_stats(spark, sf_dir):
    counts = graph.link_counts(fx.links(spark, sf_dir))
    return freq.page_stats(fx.corpus_with_rates(spark, sf_dir), counts)


@query
def word_page_frequency(spark, sf_dir):
    return freq.word_page_frequency(fx.corpus(spark, sf_dir))


@query
def word_totals(spark, sf_dir):
    return freq.word_totals(fx.corpus(spark, sf_dir))


@query
def word_dictionary(spark, sf_dir):
    words = fx.words_of(spark, sf_dir, "documents")
    return assign_ids(words, ["word"], "id_word")


@query
def word_page_relation(spark, sf_dir):
    return freq.word_page_relation(fx.corpus_by_page(spark, sf_dir))


@query
def bigram_split(spark, sf_dir):
    return freq.gram_split(fx.corpus(spark, sf_dir), 2)


@query
def bigram_page_frequency(spark, sf_dir):
    return freq.gram_page_frequency(fx.corpus_by_page(spark, sf_dir), 2)


@query
def bigram_dictionary(spark, sf_dir):
    return freq.gram_dictionary(fx.corpus_by_page(spark, sf_dir), 2)


@query
def bigram_page_relation(spark, sf_dir):
    return freq.gram_page_relation(fx.corpus_by_page(spark, sf_dir), 2)


@query
def trigram_split(spark, sf_dir):
    return freq.gram_split(fx.corpus(spark, sf_dir), 3)


@query
def trigram_page_frequency(spark, sf_dir):
    return freq.gram_page_frequency(fx.corpus_by_page(spark, sf_dir), 3)


@query
def trigram_dictionary(spark, sf_dir):
    return freq.gram_dictionary(fx.corpus_by_page(spark, sf_dir), 3)


@query
def trigram_page_relation(spark, sf_dir):
    return freq.gram_page_relation(fx.corpus_by_page(spark, sf_dir), 3)


@query
def page_word_percentage(spark, sf_dir):
    return freq.page_word_share(fx.corpus(spark, sf_dir)).drop("fraction")


@query
def page_word_fraction(spark, sf_dir):
    return freq.page_word_share(fx.corpus(spark, sf_dir)).drop("percentage")


# Similarity


def _postings(spark, sf_dir, n):
    return sim.page_postings(fx.corpus(spark, sf_dir), freq.GRAM_COLUMN[n])


def _shared_table(spark, sf_dir, n):
    """Best ten: pairs look at larger ids only, triples at all pages."""
    best = sim.top_shared(_postings(spark, sf_dir, n), 10, symmetric=n == 3)
    return best.select(
        F.col("page1").alias("id_page1"),
        F.col("page2").alias("id_page2"),
        F.col("shared").alias("shared_sets_count"),
        "rank",
    )


@query
def shared_bigram_pairs(spark, sf_dir):
    return sim.shared_pairs(_postings(spark, sf_dir, 2))


@query
def shared_bigram_top10(spark, sf_dir):
    return _shared_table(spark, sf_dir, 2)


@query
def shared_trigram_pairs(spark, sf_dir):
    return sim.mirrored(sim.shared_pairs(_postings(spark, sf_dir, 3)))


@query
def shared_trigram_top10(spark, sf_dir):
    return _shared_table(spark, sf_dir, 3)


# Link graph


@query
def link_edges(spark, sf_dir):
    return fx.edges(spark, sf_dir)


@query
def in_degree(spark, sf_dir):
    return graph.in_degree(fx.edges(spark, sf_dir))


@query
def out_degree(spark, sf_dir):
    return graph.out_degree(fx.edges(spark, sf_dir))


@query
def total_connections(spark, sf_dir):
    return graph.total_connections(fx.edges(spark, sf_dir))


@query
def page_connectivity(spark, sf_dir):
    return fx.connectivity(spark, sf_dir)


@query
def top_connected_pages(spark, sf_dir):
    return graph.top_connected(fx.connectivity(spark, sf_dir), 20, "id_page")


@query
def shared_link_pairs(spark, sf_dir):
    return graph.shared_link_pairs(fx.edges(spark, sf_dir))


@query
def hub_pages(spark, sf_dir):
    return graph.hub_pages(fx.connectivity(spark, sf_dir), 15, "id_page")


@query
def hub_report(spark, sf_dir):
    return graph.hub_report(fx.connectivity(spark, sf_dir), 5, "id_page")


@query
def graph_summary(spark, sf_dir):
    return graph.graph_summary(fx.vertices(spark, sf_dir), fx.edges(spark, sf_dir), "id_page")


@query
def word_frequency_in_links(spark, sf_dir):
    return graph.words_in_links(fx.corpus(spark, sf_dir), fx.links(spark, sf_dir), "id_page")


@query
def repeated_links(spark, sf_dir):
    return graph.repeated_links(fx.links(spark, sf_dir))


@query
def page_link_repetitions(spark, sf_dir):
    repeated = graph.repeated_links(fx.links(spark, sf_dir))
    return graph.page_repetitions(fx.vertices(spark, sf_dir), repeated, "id_page")


@query
def bfs_depth3(spark, sf_dir):
    pairs = fx.edges(spark, sf_dir)
    start = pairs.agg(F.min("src").alias("page"))
    return graph.reachable(pairs, start, 3)


# Lookups


def _stored(spark, tables, after=None, ordered=()):
    """The tables as a lookup finds them: written in their order and read back."""
    folder = scratch_path(spark, "stored")
    sinks.write_tables(tables, folder, after, ordered)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def _page_table(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("id_page", "title", "url")


def _first(rows: DataFrame):
    """The argument of a lookup: one row, chosen from the table itself."""
    return rows.limit(1).collect()[0]


def _word_tables(spark, sf_dir):
    """Stored pages, words with their totals, and their counts on pages."""
    counts = materialize(freq.word_page_frequency(fx.corpus_by_page(spark, sf_dir)), "word_page")
    sums = {"total_repetitions": F.sum("quantity")}
    terms, facts = number_groups(counts, ["word"], "id_page", "id_word", sums, page_count=False)
    return _stored(
        spark,
        {
            "page": _page_table(spark, sf_dir),
            "word": terms,
            "word_page": facts.select("id_word", "id_page", "quantity"),
        },
        ordered=["word_page"],
    )


def _common_word(tables):
    return _first(lookup.available_words(tables, 1))["word"]


@query
def top_pages_by_word(spark, sf_dir):
    tables = _word_tables(spark, sf_dir)
    return lookup.top_pages_by_word(tables, _common_word(tables).upper())


def _top_pages_by_gram(spark, sf_dir, n):
    keys = freq.gram_words(n)
    counts = freq.written_grams(fx.corpus_by_page(spark, sf_dir), n)
    sums = {"total": F.sum("repetition_count")}
    terms, facts = number_groups(counts, keys, "id_page", f"id_set{n}", sums, page_count=False, joined=True)
    discard(counts)
    tables = _stored(
        spark,
        {
            "page": _page_table(spark, sf_dir),
            f"set{n}": terms.select(f"id_set{n}", *keys),
            f"set{n}_page": facts.select(f"id_set{n}", "id_page", "repetition_count"),
        },
        # numbered facts lie in the order of their ids and pages
        ordered=[f"set{n}_page"],
    )
    words = _first(terms.orderBy(F.desc("total"), *keys))
    return lookup.top_pages_by_gram(tables, *[words[key].upper() for key in keys])


@query
def top_pages_by_bigram(spark, sf_dir):
    return _top_pages_by_gram(spark, sf_dir, 2)


@query
def top_pages_by_trigram(spark, sf_dir):
    return _top_pages_by_gram(spark, sf_dir, 3)


def _shared_of_page(spark, sf_dir, n, find):
    shared = materialize(_shared_table(spark, sf_dir, n), "shared")
    tables = _stored(spark, {"page": _page_table(spark, sf_dir), f"shared{n}": shared})
    page = _first(shared.agg(F.min("id_page1").alias("id_page")))["id_page"]
    return find(tables, f"doc://{page}")


@query
def shared_bigrams_of_page(spark, sf_dir):
    return _shared_of_page(spark, sf_dir, 2, lookup.shared_bigrams_of_page)


@query
def shared_trigrams_of_page(spark, sf_dir):
    return _shared_of_page(spark, sf_dir, 3, lookup.shared_trigrams_of_page)


def _page_word_tables(spark, sf_dir):
    counts = materialize(freq.page_word_counts(fx.corpus_by_page(spark, sf_dir)), "counts")
    terms, facts = number_groups(counts, ["word"], "id_page", "id_word", page_count=False)
    # shares follow from counts, so they need not move with them
    tables = _stored(
        spark,
        {"page": _page_table(spark, sf_dir), "word": terms, "page_word": facts},
        {"page_word": freq.with_shares},
    )
    first = _first(counts.agg(F.min("id_page").alias("id_page")))
    return tables, f"doc://{first['id_page']}"


@query
def words_of_page(spark, sf_dir):
    return lookup.words_of_page(*_page_word_tables(spark, sf_dir))


@query
def words_of_page_json(spark, sf_dir):
    return lookup.as_json_array(lookup.words_of_page(*_page_word_tables(spark, sf_dir)))


@query
def word_percentages_of_page(spark, sf_dir):
    return lookup.word_percentages_of_page(*_page_word_tables(spark, sf_dir))


@query
def sorted_result(spark, sf_dir):
    words = materialize(lookup.words_of_page(*_page_word_tables(spark, sf_dir)), "words")
    positions = [
        assign_ids(words, [*lookup.sort_keys(words, "QUANTITY", order), "WORD"], "position")
        .withColumn("sort_order", F.lit(order))
        for order in ("asc", "desc", "alpha")
    ]
    return positions[0].unionByName(positions[1]).unionByName(positions[2])


@query
def sorted_titles(spark, sf_dir):
    """Pages of the most common word, in the orders that a reader may ask for by title and by URL."""
    tables = _word_tables(spark, sf_dir)
    found = materialize(lookup.top_pages_by_word(tables, _common_word(tables)), "found")
    positions = [
        assign_ids(found, [*lookup.sort_keys(found, column, order), "URL"], "position").withColumn(
            "sort_order", F.lit(f"{column} {order}")
        )
        for column in ("TITLE", "URL")
        for order in ("asc", "desc", "alpha")
    ]
    return reduce(DataFrame.unionByName, positions)


@query
def link_count_of_page(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    table = pages.select(
        F.col("page_id").alias("id_page"),
        "url",
        heading(F.col("html")).alias("title"),
        F.size(prepare.link_array(F.col("html"), fx.RULES)).cast("long").alias("distinct_links"),
    )
    tables = _stored(spark, {"page": table})
    url = _first(pages.orderBy("page_id").select("url"))["url"]
    return lookup.link_count_of_page(tables, url)


def _graph_tables(spark, sf_dir):
    return _stored(spark, {"page": fx.graph_page_table(spark, sf_dir)})


def _first_part(spark, sf_dir):
    first = fx.vertices(spark, sf_dir).agg(F.min("id_page").alias("id_page"))
    return f"part://{_first(first)['id_page']}"


def _ranked(spark, table: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of a table from a copy that is stored in their order."""
    path = scratch_path(spark, "ranked")
    sinks.write_ranked(table, path, order)
    return read_first(spark, path, limit)


@query
def top_interconnected(spark, sf_dir):
    page = fx.graph_page_table(spark, sf_dir)
    order = [F.desc("connectivity_score"), F.desc("total_repetitions"), F.asc("url")]
    return lookup.top_interconnected({"page": _ranked(spark, page, order, 10)}, 10)


@query
def page_connections(spark, sf_dir):
    return lookup.page_connections(_graph_tables(spark, sf_dir), _first_part(spark, sf_dir))


@query
def top_hub_pages(spark, sf_dir):
    page = fx.graph_page_table(spark, sf_dir).filter(lookup.MAY_BE_HUB)
    order = [lookup.hub_score().desc(), F.asc("url")]
    return lookup.top_hub_pages({"page": _ranked(spark, page, order, 15)}, 15)


@query
def word_repetitions(spark, sf_dir):
    tables = _word_tables(spark, sf_dir)
    return lookup.word_repetitions(tables, _common_word(tables).upper())


@query
def page_repetitions(spark, sf_dir):
    return lookup.page_repetitions(_graph_tables(spark, sf_dir), _first_part(spark, sf_dir))


@query
def summary(spark, sf_dir):
    """Sizes of the stored dictionaries, from their files' footers."""
    items = {1: "total_words", 2: "total_word_pairs", 3: "total_word_triplets"}
    paths = _written(spark, {"total_pages": fx.documents(spark, sf_dir).select("id_page")})
    folders = {n: scratch_path(spark, name) for n, name in items.items()}
    stored = sinks.write_dictionaries(fx.corpus(spark, sf_dir), folders)
    return stored_sizes(spark, paths | {name: stored[n] for n, name in items.items()})


def _written(spark, tables: dict[str, DataFrame]) -> dict[str, str]:
    paths = {name: scratch_path(spark, name) for name in tables}
    for name, table in tables.items():
        sinks.write_table(table, paths[name])
    return paths


@query
def load_check(spark, sf_dir):
    words = materialize(freq.word_page_frequency(fx.corpus(spark, sf_dir)).select("word"), "words")
    tables = {"pages": fx.documents(spark, sf_dir).select("id_page"), "words": words.distinct(), "word_pages": words}
    return stored_sizes(spark, _written(spark, tables))


@query
def available_pages(spark, sf_dir):
    return lookup.available_pages({"page": _page_table(spark, sf_dir)})


@query
def available_words(spark, sf_dir):
    words = freq.word_totals(fx.corpus(spark, sf_dir))
    first = _ranked(spark, words, [F.desc("total_repetitions"), F.asc("word")], 100)
    return lookup.available_words({"word": first}, 100)


# The whole job


# What is compared of each table: keys, values and shares in billionths.
CONTENT = {
    "page": ["id_page", "title", "url", "edits_per_day", "distinct_links", "quant_set2", "quant_set3",
             "total_repetitions", "incoming_links", "outgoing_links", "total_connections",
             "connectivity_score"],
    "word": ["id_word", "word", "total_repetitions", "link_repetitions"],
    "set2": ["id_set2", "word1", "word2"],
    "set3": ["id_set3", "word1", "word2", "word3"],
    "word_page": ["id_word", "id_page", "quantity"],
    "page_word": ["id_page", "id_word", "quantity", "percentage", "fraction"],
    "set2_page": ["id_set2", "id_page", "repetition_count"],
    "set3_page": ["id_set3", "id_page", "repetition_count"],
    "shared2": ["id_page1", "id_page2", "shared_sets_count", "rank"],
    "shared3": ["id_page1", "id_page2", "shared_sets_count", "rank"],
}


NAMED_CONTENT = {
    "page": CONTENT["page"][1:],
    "word": CONTENT["word"][1:],
    "set2": ["word1", "word2", "page_count"],
    "set3": ["word1", "word2", "word3", "page_count"],
    "word_page": ["word", "url", "quantity"],
    "page_word": ["url", "word", "quantity", "percentage", "fraction"],
    "set2_page": ["word1", "word2", "url", "repetition_count"],
    "set3_page": ["word1", "word2", "word3", "url", "repetition_count"],
    "shared2": ["url1", "url2", "shared_sets_count", "rank"],
    "shared3": ["url1", "url2", "shared_sets_count", "rank"],
}


def checksum(name: str, table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table, and the sum of a 32-bit hash of every row."""
    parts = [
        F.round(F.col(c) * 1e9).cast("long") if dict(table.dtypes)[c] == "double" else F.col(c)
        for c in columns or CONTENT[name]
    ]
    line = F.concat_ws("|", *[part.cast("string") for part in parts])
    value = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("checksum")).select(
        F.lit(name).alias("table_name"), "n_rows", "checksum"
    )


def _checksums(spark, folder):
    sums = [checksum(name, spark.read.parquet(f"{folder}/{name}")) for name in CONTENT]
    return reduce(DataFrame.unionAll, sums)


def _analysed(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    tables = analysis_tables(fx.corpus_with_rates(spark, sf_dir), fx.links(spark, sf_dir))
    sinks.write_tables(tables, folder, ordered=ORDERED)
    return folder


QUERIES["analysis_tables"] = lambda spark, sf_dir: _checksums(spark, _analysed(spark, sf_dir))


@query
def job_repeated_urls(spark, sf_dir):
    """The job over records of which every third comes again under other spellings of its URL."""
    source, folder = scratch_path(spark, "jsonl"), scratch_path(spark, "tables")
    records = fx.corpus(spark, sf_dir).select(
        "id_page", "url", "title", "word_list", "bigrams", "trigrams",
        F.lit(0.0).alias("edits_per_day"), F.array().cast("array<string>").alias("links"),
    )
    again = records.filter("id_page % 3 = 0")
    spelled = F.array(F.concat(F.upper("url"), F.lit("/")), F.concat(F.lit(" "), "url", F.lit("\t")), F.lit(None))
    copies = again.withColumn("url", F.explode(spelled)).withColumn("title", F.lit("copy"))
    # the names of the folders say which come first
    sinks.write_jsonl(records.drop("id_page"), f"{source}/0-records")
    sinks.write_jsonl(copies.drop("id_page"), f"{source}/1-copies")
    run(spark, f"{source}/*", folder)
    tables = read_tables(spark, folder)
    page = tables["page"].select("id_page", "url", "title")
    shares = tables["page_word"].join(page, "id_page")
    sums = shares.groupBy("url", "title").agg(
        F.sum("quantity").alias("n_words"), F.round(F.sum("percentage"), 6).alias("percentage")
    )
    return sums


def _linked_records(spark, sf_dir):
    """Documents as records; a document links to the parts that the supplier of its number sells."""
    target = F.concat(F.lit("doc://"), F.col("dst").cast("string"))
    links = fx.links(spark, sf_dir).groupBy(F.col("src").alias("id_page")).agg(
        F.collect_list(target).alias("links")
    )
    records = fx.corpus_with_rates(spark, sf_dir).join(links, "id_page", "left")
    return records.select(
        "id_page", "url", "title", "word_list", "bigrams", "trigrams",
        F.coalesce("edits_per_day", F.lit(0.0)).alias("edits_per_day"),
        F.coalesce("links", F.array().cast("array<string>")).alias("links"),
    )


@query
def job_second_run(spark, sf_dir):
    """A first run over two thirds of the pages, every fifth in an older form, and a second over the rest.

    The older form has every second link and the first half of the words. The
    second run brings the newer form and the pages that were not there.
    """
    first, second, folder = (scratch_path(spark, name) for name in ("jsonl", "jsonl", "tables"))
    records = materialize(_linked_records(spark, sf_dir), "records")
    there, older = F.col("id_page") % 3 != 0, F.col("id_page") % 5 == 0
    half = F.slice("word_list", F.lit(1), F.floor(F.size("word_list") / 2).cast("int"))
    words = F.when(older, half).otherwise(F.col("word_list"))
    some = F.filter("links", lambda link, i: i % 2 == 0)
    begun = records.filter(there).withColumns(
        {
            "word_list": words,
            "title": F.when(older, F.lit("older")).otherwise(F.col("title")),
            "links": F.when(older, some).otherwise(F.col("links")),
        }
    )
    begun = begun.withColumn("bigrams", ngrams(F.col("word_list"), 2)).withColumn(
        "trigrams", ngrams(F.col("word_list"), 3)
    )
    sinks.write_jsonl(begun.drop("id_page"), first)
    sinks.write_jsonl(records.filter(~there | older).drop("id_page"), second)
    run(spark, first, folder)
    update(spark, second, folder)
    return _named_checksums(read_tables(spark, folder))


def _named_checksums(tables: dict[str, DataFrame]) -> DataFrame:
    """Checksums of the tables' rows with URLs and words in place of ids."""
    page = tables["page"].select("id_page", "url")
    named = {"page": tables["page"], "word": tables["word"]}
    for fact in ("word_page", "page_word"):
        rows = tables[fact].join(page, "id_page")
        named[fact] = rows.join(tables["word"].select("id_word", "word"), "id_word")
    for n in (2, 3):
        named[f"set{n}"] = tables[f"set{n}"]
        grams = tables[f"set{n}"].select(f"id_set{n}", *freq.gram_words(n))
        named[f"set{n}_page"] = tables[f"set{n}_page"].join(page, "id_page").join(grams, f"id_set{n}")
        named[f"shared{n}"] = (
            tables[f"shared{n}"]
            .join(page.toDF("id_page1", "url1"), "id_page1")
            .join(page.toDF("id_page2", "url2"), "id_page2")
        )
    sums = [checksum(name, named[name], NAMED_CONTENT[name]) for name in CONTENT]
    return reduce(DataFrame.unionAll, sums)


@query
def raw_page_tables(spark, sf_dir):
    """Raw pages and revisions to stored tables: links, titles, rates, words of each page."""
    source, folder = scratch_path(spark, "jsonl"), scratch_path(spark, "tables")
    events = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts")
    records = prepare.page_records(fx.read(spark, sf_dir, "pages"), events, fx.RULES)
    sinks.write_jsonl(records.drop("id_page"), source)
    run(spark, source, folder)
    return read_tables(spark, folder)["page"].select(
        "id_page", "url", "title", "edits_per_day", "distinct_links"
    )
