import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions.text import collated
from pageloom.operators import frequency as freq
from pageloom.operators import graph, prepare
from pageloom.operators import similarity as sim
from pageloom.operators.ids import assign_ids, number_groups
from pageloom.operators.joins import join_on_skewed_key
from pageloom.plans import fixtures as fx

from .conftest import rows


def test_ids_follow_key_order(spark):
    words = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("word"))
    numbered = assign_ids(words.repartition(7), ["word"], "id", after=10)
    found = numbered.orderBy("id").collect()
    assert [row["id"] for row in found] == list(range(11, 5011))
    assert [row["word"] for row in found] == sorted(row["word"] for row in found)


def test_skewed_join_equals_plain_join(spark):
    keys = [1] * 60 + [2] * 30 + [3, 4, 5]
    fact = spark.createDataFrame([(key, n) for n, key in enumerate(keys)], "k long, n long")
    dim = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in (1, 2, 3, 5)], "k long, v string, w long")
    plain = rows(fact.join(dim.drop("w"), "k"))
    assert rows(join_on_skewed_key(fact, dim, ["k"], "w")) == plain
    # 95 rows over 8 partitions: keys of more than 11 rows are hot
    skewed = join_on_skewed_key(fact, dim, ["k"], "w", min_hot_rows=5)
    assert rows(skewed.select("k", "n", "v")) == plain
    assert "Union" in skewed._jdf.queryExecution().toString()


def test_hot_means_more_than_a_tasks_share(spark):
    """One key with 30 % of the rows and one with 0.04 %, which counts once there are more partitions."""
    keys = [1] * 3000 + [2] * 40 + list(range(10, 7000))
    fact = spark.createDataFrame([(key, n) for n, key in enumerate(keys)], "k long, n long")
    dim = fact.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2)
    plain = rows(fact.join(dim.drop("w"), "k").select("k", "n", "v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, most in ((8, 10), (4000, 10_000), (4000, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            joined = join_on_skewed_key(fact, dim, ["k"], "w", min_hot_rows=5, most_broadcast=most)
            spark.conf.set("spark.sql.shuffle.partitions", before)
            assert rows(joined.select("k", "n", "v")) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def pages(spark, *items):
    return spark.createDataFrame(
        list(items),
        "id_page long, url string, title string, word_list array<string>,"
        "bigrams array<string>, trigrams array<string>, edits_per_day double, links array<string>",
    )


def page(number, words, links=(), title="t", bigrams=None, rate=None):
    words = list(words) if words is not None else None
    two = [" ".join(p) for p in zip(words or [], (words or [])[1:])] if bigrams is None else bigrams
    three = [" ".join(p) for p in zip(words or [], (words or [])[1:], (words or [])[2:])]
    return (number, f"u{number}", title, words, two, three, rate, list(links))


def test_counts_with_null_and_empty(spark):
    df = pages(spark, page(1, "a b a".split()), page(2, None), page(3, ["", "a"]))
    assert rows(freq.word_page_frequency(df)) == [(1, "a", 2), (1, "b", 1), (3, "a", 1)]
    assert rows(freq.word_totals(df)) == [("a", 3), ("b", 1)]
    assert rows(freq.page_word_share(df).filter("id_page = 3")) == [(3, "a", 1, 100.0, 1.0)]


def test_collated_counts_merge_accents(spark):
    df = pages(spark, page(1, ["automático", "automatico", "otro"]))
    assert rows(freq.word_page_frequency(df))[0][2] == 1
    found = freq.word_page_frequency(collated(df)).collect()
    assert sorted(row["quantity"] for row in found) == [1, 2]
    totals = freq.word_totals(collated(df)).collect()
    assert sorted(row["total_repetitions"] for row in totals) == [1, 2]


def test_same_title_does_not_multiply(spark):
    df = pages(spark, page(1, ["a"], title="x"), page(2, ["a"], title="x"))
    assert rows(freq.word_page_relation(df)) == [(1, 1, 1), (1, 2, 1)]


def test_invalid_grams_are_dropped(spark):
    grams = ["a b", "a", "a  b", " b", "a b c", "a b", None, ""]
    df = pages(spark, page(1, [], bigrams=grams))
    assert rows(freq.gram_page_frequency(df, 2)) == [(1, "a", "b", 3)]
    assert rows(freq.gram_split(df, 2).select("gram")) == [("a b",), ("a b",), ("a b c",)]


def test_page_stats(spark):
    df = pages(spark, page(1, "a b c".split(), ["x", "x", "y"], rate=None), page(2, None))
    found = rows(freq.page_stats(df).select("id_page", "edits_per_day", "distinct_links",
                                            "quant_set2", "quant_set3"))
    assert found == [(1, 0.0, 2, 2, 1), (2, 0.0, 0, 0, 0)]


def test_gram_counts_and_shares_on_documents(spark, sf_dir):
    df = fx.corpus(spark, sf_dir)
    sizes = df.select(F.size("word_list").alias("n"), F.size("bigrams").alias("b"),
                      F.size("trigrams").alias("t"))
    assert sizes.filter("b <> greatest(n - 1, 0) or t <> greatest(n - 2, 0)").isEmpty()
    sums = freq.page_word_share(df).groupBy("id_page").agg(F.sum("percentage").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 100) > 1e-6).isEmpty()


# Similarity


def brute(members):
    shared = {}
    for a in members:
        for b in members:
            if a < b and members[a] & members[b]:
                shared[a, b] = len(members[a] & members[b])
    return shared


def corpus_with_hot_items(seed):
    """A third of the members are copies, another third shares one item."""
    pick = random.Random(seed)
    members = {}
    for member in range(90):
        items = {f"g{int(pick.paretovariate(0.6))}" for _ in range(pick.randint(1, 12))}
        if member % 3 == 0:
            items = {"hotA", "hotB", "copy1", "copy2"} | ({f"own{member}"} if member % 2 else set())
        if member % 3 == 1:
            items.add("hotC")
        members[member] = items
    return members


@pytest.mark.parametrize("name", ["word_page_relation", "words_of_page", "top_pages_by_word"])
def test_counted_words_meet_their_ids_without_a_join(spark, sf_dir, monkeypatch, name):
    """A join moves all counted words once more as soon as the dictionary is too large to be sent."""
    from pageloom.plans.queries import QUERIES

    def joined(*args):
        raise AssertionError("counted words are joined")

    monkeypatch.setattr(freq, "join_on_skewed_key", joined)
    assert QUERIES[name](spark, sf_dir).count()


def test_counts_of_dealt_pages_are_not_shuffled(spark, sf_dir):
    counts = freq.page_word_counts(fx.corpus_by_page(spark, sf_dir))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert rows(freq.with_shares(counts).select("id_page", "word", "quantity", "percentage", "fraction")) == rows(
        freq.page_word_share(fx.corpus(spark, sf_dir))
    )


def test_joined_keys_are_numbered_in_the_order_of_their_words(spark):
    """Also where words begin with one another or hold control characters, and in files in that order."""
    words = ["a", "a\x00", "a\x01", "a\x02b", "a\x1f", "ab", "a!", "\x01", "é", "\x00", "\x1f", "b"]
    data = [(one, two, page, page) for one in words for two in words for page in (3, 1, 2)]
    counts = spark.createDataFrame(data, "word1 string, word2 string, id_page long, n long").repartition(5)
    keys = {key: at for at, key in enumerate(sorted({row[:2] for row in data}), 1)}
    groups, facts = number_groups(counts, ["word1", "word2"], "id_page", "id_set2", joined=True)
    assert groups.columns == ["id_set2", "word1", "word2", "page_count"]
    assert rows(groups) == [(number, *key, 3) for key, number in keys.items()]
    assert rows(facts) == sorted((keys[row[:2]], *row[2:]) for row in data)
    parts = facts.rdd.map(tuple).glom().collect()
    assert all(part == sorted(part) for part in parts)


def test_dictionary_of_grams_moves_them_once(spark, monkeypatch):
    from pageloom.operators import frequency, ids

    written = []
    for module in (frequency, ids):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, write=write: written.append(df) or write(df, name))
    pages = spark.createDataFrame([(1, ["a b", "b c", "a b"]), (2, ["a b", "a a"])], "id_page long, bigrams array<string>")
    assert rows(frequency.gram_dictionary(pages, 2)) == [(1, "a", "a", 1), (2, "a", "b", 2), (3, "b", "c", 1)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    assert sum("RepartitionByExpression" in plan for plan in plans) == 1
    assert not any("Aggregate [word1" in plan for plan in plans)


def test_postings_of_the_job_are_made_where_pages_lie(spark, monkeypatch):
    """Texts move for counts only; numbered facts are not ranged again."""
    from pageloom.plans import job

    found, search = [], job.top_shared
    monkeypatch.setattr(job, "top_shared", lambda postings, *a, **b: found.append(postings) or search(postings, *a, **b))
    data = [(i, f"u{i}", "t", 0.0, ["a", "b", "c"], [], ["a b", "b c"], ["a b c"]) for i in range(1, 4)]
    kinds = "id_page long, url string, title string, edits_per_day double, word_list array<string>, links array<string>, "
    pages = spark.createDataFrame(data, kinds + "bigrams array<string>, trigrams array<string>")
    tables = job.analysis_tables(pages)
    assert rows(tables["set3_page"]) == [(1, page, 1) for page in (1, 2, 3)]
    assert rows(tables["shared2"]) == [(1, 2, 2, 1), (1, 3, 2, 2), (2, 3, 2, 1)]
    assert len(found) == 2
    for postings in found:
        assert "Repartition" not in postings._jdf.queryExecution().optimizedPlan().toString()
    for name in job.ORDERED:
        assert "Exchange rangepartitioning" not in tables[name]._jdf.queryExecution().executedPlan().toString()


def test_groups_are_numbered_without_their_counts(spark):
    counts = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id_page long, word string")
    groups, facts = number_groups(counts, ["word"], "id_page", "id_word", page_count=False)
    assert groups.columns == ["id_word", "word"] and rows(groups) == [(1, "a"), (2, "b")]
    assert rows(facts) == [(1, 2), (2, 1), (2, 3)]


@pytest.fixture(scope="module", params=[1, 2])
def hot_corpus(spark, request):
    members = corpus_with_hot_items(request.param)
    data = [(item, member) for member, items in members.items() for item in items]
    return members, spark.createDataFrame(data, "item string, member long").cache()


@pytest.mark.parametrize("hot", [None, 5])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_shared_pairs_equal_brute_force(hot_corpus, least, hot):
    members, postings = hot_corpus
    found = {(r.page1, r.page2): r.shared for r in sim.shared_pairs(postings, least, hot).collect()}
    assert found == {pair: n for pair, n in brute(members).items() if n >= least}


@pytest.mark.parametrize("hot", [None, 5])
@pytest.mark.parametrize("symmetric", [True, False])
def test_top_shared_equals_brute_force(hot_corpus, symmetric, hot):
    members, postings = hot_corpus
    shared = brute(members)
    expected = set()
    for a in members:
        others = [b for b in members if b != a and (symmetric or b > a)]
        scored = [(-shared.get((min(a, b), max(a, b)), 0), b) for b in others]
        best = sorted(pair for pair in scored if pair[0])[:4]
        expected |= {(a, b, -n, rank) for rank, (n, b) in enumerate(best, 1)}
    found = sim.top_shared(postings, 4, symmetric, hot).select("page1", "page2", "shared", "rank")
    assert set(map(tuple, found.collect())) == expected


def test_pair_budget_bounds_the_lists(spark, monkeypatch):
    classes = spark.createDataFrame([("a", 2, 1), ("b", 8, 1), ("c", 4096, 1)],
                                    "item string, size long, weight long")
    postings = spark.range(4106)
    assert sim._bound(classes, postings) == (8, False)
    monkeypatch.setattr(sim, "PAIRS_PER_POSTING", 10_000)
    assert sim._bound(classes, postings) == (8, True)
    monkeypatch.setattr(sim, "LONGEST", 4096)
    assert sim._bound(classes, postings) == (4096, True)


@pytest.mark.parametrize("pairs", [0, 1000])
@pytest.mark.parametrize("symmetric", [True, False])
def test_top_shared_within_and_beyond_the_budget(hot_corpus, monkeypatch, pairs, symmetric):
    """Large classes are expanded where the budget allows, and searched by bounds where not."""
    members, postings = hot_corpus
    expected = rows(sim.top_shared(postings, 2, symmetric, hot=10_000))
    monkeypatch.setattr(sim, "LONGEST", 2)
    monkeypatch.setattr(sim, "PAIRS_PER_POSTING", pairs)
    monkeypatch.setattr(sim, "CELL", 3)
    assert rows(sim.top_shared(postings, 2, symmetric)) == expected
    found = {(r.page1, r.page2): r.shared for r in sim.shared_pairs(postings, 2).collect()}
    assert found == {pair: n for pair, n in brute(members).items() if n >= 2}


@pytest.mark.parametrize("hot", [None, 3])
def test_partner_search_writes_no_items(hot_corpus, monkeypatch, hot):
    """Items move once, as hashes: neither their texts nor a copy of all postings is written."""
    written, write = [], sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, name: written.append((name, df.columns)) or write(df, name))
    members, postings = hot_corpus
    found = {(r.page1, r.page2): r.shared for r in sim.shared_pairs(postings, 1, hot).collect()}
    assert found == brute(members)
    sim.top_shared(postings, 4, True, hot).collect()
    assert written
    assert not [name for name, columns in written if "item" in columns]


@pytest.mark.parametrize("symmetric", [True, False])
def test_candidates_are_looked_up_in_cells(hot_corpus, monkeypatch, symmetric):
    """Pairs of small classes are not written, and codes are copied for blocks of pages, not for pairs."""
    members, postings = hot_corpus
    expected = rows(sim.top_shared(postings, 4, symmetric, hot=10_000))
    for name in ("PAIRS_PER_TASK", "CODES_PER_CELL", "_CODES_AT_ONCE"):
        monkeypatch.setattr(sim, name, 20)
    written, write = [], sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert rows(sim.top_shared(postings, 4, symmetric, hot=5)) == expected
    assert "best" in written and "cold" not in written


@pytest.mark.parametrize("symmetric", [True, False])
def test_best_partners_are_chosen_where_pairs_are_made(hot_corpus, monkeypatch, symmetric):
    """Beyond 16 pairs a posting too, neither pairs nor candidates are written."""
    members, postings = hot_corpus
    expected = rows(sim.top_shared(postings, 4, symmetric, hot=5))
    monkeypatch.setattr(sim, "PAIRS_PER_POSTING", 0)
    written, write = [], sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert rows(sim.top_shared(postings, 4, symmetric)) == expected
    assert not {"best", "fresh", "nearest"} & set(written)
    # many blocks, and few pages and columns at once
    for name, value in {"CODES_PER_BLOCK": 20, "_CODES_AT_ONCE": 15, "_ROWS_AT_ONCE": 3, "_COLUMN_BITS": 2}.items():
        monkeypatch.setattr(sim, name, value)
    assert rows(sim.top_shared(postings, 4, symmetric)) == expected
    # beyond the larger budget, the search goes by bounds
    monkeypatch.setattr(sim, "PAIRS_IN_CELLS", 0)
    assert rows(sim.top_shared(postings, 4, symmetric)) == expected
    assert "best" in written


@pytest.mark.parametrize("hot", [None, 3])
def test_pairs_are_made_in_as_many_tasks_as_they_need(hot_corpus, monkeypatch, hot):
    """However small their lists are, which would bring all pairs into one task."""
    members, postings = hot_corpus
    expected = brute(members)
    for name in ("PAIRS_PER_TASK", "PAIRS_PER_CELL", "_CODES_AT_ONCE"):
        monkeypatch.setattr(sim, name, 25)
    pairs = sim.shared_pairs(postings, 1, hot)
    assert {(r.page1, r.page2): r.shared for r in pairs.collect()} == expected
    assert pairs.rdd.getNumPartitions() >= len(expected) // 25


def test_pairs_of_a_cell():
    def code(number, weight):
        return (number << 31) | weight

    cell = pa.table({
        "right": [False, False, True, True],
        "alone": [False] * 4,
        "member": [9, 2, 8, 7],
        "codes": [[code(1, 5), code(3, 2)], [code(4, 9)], [code(1, 5), code(2, 1), code(3, 2)], [code(3, 2), code(4, 9)]],
    })
    found = {tuple(row.values()) for row in sim._pairs_of_cell(cell).to_pylist()}
    assert found == {(8, 9, 7), (7, 9, 2), (2, 7, 9)}
    assert sim._pairs_of_cell(cell.slice(2)).num_rows == 0
    alone = cell.set_column(0, "right", pa.array([False] * 4)).set_column(1, "alone", pa.array([True] * 4))
    found = {tuple(row.values()) for row in sim._pairs_of_cell(alone).to_pylist()}
    assert found == {(8, 9, 7), (7, 9, 2), (7, 8, 2), (2, 7, 9)}


def test_overlaps_of_a_cell():
    def code(number, weight):
        return (number << 31) | weight

    sides = pa.table({
        "right": [False, False, True, True],
        "member": [1, 2, 8, 7],
        "codes": [[code(1, 5), code(3, 2)], [code(4, 9)], [code(1, 5), code(2, 1), code(3, 2)], [code(3, 2)]],
    })
    pairs = pa.table({"page1": [1, 1, 2, 1, 6], "page2": [7, 8, 8, 9, 7], "shared": [10, 0, 3, 4, 5]})
    assert sim._add_overlaps(pairs, sides)["shared"].to_pylist() == [12, 7, 3, 4, 5]
    assert sim._add_overlaps(pairs, sides.slice(0, 0))["shared"].to_pylist() == [10, 0, 3, 4, 5]
    assert sim._add_overlaps(pairs.slice(0, 0), sides).num_rows == 0


def test_hot_class_is_joined_in_cells(spark, monkeypatch):
    monkeypatch.setattr(sim, "CELL", 7)
    data = [("x", m) for m in range(40)] + [("y", m) for m in range(0, 40, 2)]
    postings = spark.createDataFrame(data, "item string, member long")
    found = {(r.page1, r.page2): r.shared for r in sim.shared_pairs(postings, 1, 3).collect()}
    members = {m: {"x"} | ({"y"} if m % 2 == 0 else set()) for m in range(40)}
    assert found == brute(members)


def test_groups_are_numbered_without_a_join(spark, tmp_path, monkeypatch):
    """Dense numbers in key order; rows move once, so they are written and joined to no dictionary."""
    import pageloom.operators.ids as ids

    written, write = [], ids.materialize
    monkeypatch.setattr(ids, "materialize", lambda df, name: written.append(df) or write(df, name))
    data = [(f"w{i % 7}", f"v{i % 3}", i, i % 5 or None) for i in range(200)] + [("w1", "", 999, 1)]
    counts = spark.createDataFrame(data, "word1 string, word2 string, id_page long, n int").repartition(5)
    sums = {"total": F.sum("n")}
    groups, facts = ids.number_groups(counts, ["word1", "word2"], "id_page", "id_set2", sums)
    expected = {}
    for one, two, page, n in data:
        expected.setdefault((one, two), []).append((page, n))
    keys = {key: at for at, key in enumerate(sorted(expected), 1)}
    assert rows(groups) == [
        (keys[key], *key, len(expected[key]), sum(n or 0 for _, n in expected[key])) for key in sorted(expected)
    ]
    assert {tuple(r) for r in facts.select("id_set2", "id_page", "n").collect()} == {
        (keys[one, two], page, n) for one, two, page, n in data
    }
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert "Join" not in plan
    none = ids.number_groups(counts.filter("false"), ["word1", "word2"], "id_page", "id_set2")
    assert [table.count() for table in none] == [0, 0]


def test_counts_of_pages_move_texts_only(spark, sf_dir):
    from pageloom.plans import fixtures as fx

    counts = freq.gram_page_frequency(fx.corpus_by_page(spark, sf_dir), 3)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "word_list" not in plan[plan.index("Exchange hashpartitioning") :]


# Graph


def edge_frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_edges_and_degrees(spark):
    links = edge_frame(spark, ("a", "b"), ("a", "b"), ("a", "a"), ("b", "c"), ("a", None))
    edges = graph.link_edges(links)
    assert rows(edges) == [("a", "b"), ("b", "c")]
    assert rows(graph.degrees(edges)) == [("a", 0, 1, 1), ("b", 1, 1, 2), ("c", 1, 0, 1)]
    counts = rows(graph.repeated_links(links))
    assert counts == [("a", 1), ("b", 2), ("c", 1)]


def test_connectivity_of_fixture(spark, sf_dir):
    found = fx.connectivity(spark, sf_dir)
    assert found.filter("total_connections <> connectivity_score").isEmpty()
    edges = fx.edges(spark, sf_dir).count()
    sums = graph.degrees(fx.edges(spark, sf_dir)).agg(F.sum("incoming_links"), F.sum("outgoing_links"))
    assert tuple(sums.first()) == (edges, edges)
    one_pass = {r.page: tuple(r) for r in graph.degrees(fx.edges(spark, sf_dir)).collect()}
    for r in graph.in_degree(fx.edges(spark, sf_dir)).collect():
        assert one_pass[r.page][1] == r.incoming_links


def test_shared_links_skip_the_common_target(spark):
    pairs = [(f"p{i}", "home") for i in range(30)]
    pairs += [("p1", "x"), ("p2", "x"), ("p3", "x"), ("p3", "y"), ("p4", "y"), ("home", "x")]
    edges = edge_frame(spark, *pairs)
    postings = edges.select(F.col("dst").alias("item"), F.col("src").alias("member"))
    found = sim.shared_pairs(postings, 2, hot=5)
    assert rows(found) == [("p1", "p2", 2), ("p1", "p3", 2), ("p2", "p3", 2), ("p3", "p4", 2)]


def test_words_in_links_equal_the_naive_join(spark):
    df = pages(
        spark,
        page(1, "a b".split(), ["u2", "u2", "u9"]),
        page(2, "b c b".split(), ["u1", "u2"]),
        page(3, "z".split(), ["u2"]),
    )
    found = graph.words_in_links(df, graph.page_link_occurrences(df))
    expected = Counter()
    words = {"u1": "ab", "u2": "bcb", "u3": "z"}
    for link in ["u2", "u2", "u9", "u1", "u2", "u2"]:
        expected.update(words.get(link, ""))
    assert dict(found.collect()) == expected


def test_traversal_stops_at_depth_and_repeats_nothing(spark):
    edges = edge_frame(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"))
    start = spark.createDataFrame([("a",)], "page string")
    assert rows(graph.reachable(edges, start, 2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.reachable(edges, start, 9))[-1] == ("e", 3)


# Preparation


def test_edit_rate(spark):
    base = datetime(2024, 1, 1)
    data = [(1, base), (2, base), (2, base + timedelta(hours=1))]
    data += [(3, base + timedelta(days=i)) for i in range(11)]
    data += [(4, base + timedelta(days=i)) for i in range(600)]
    found = dict(prepare.edit_rate(spark.createDataFrame(data, "page long, ts timestamp")).collect())
    assert found == {1: 0.0, 2: 2.0, 3: 1.1, 4: round(600 / 599, 2)}
    burst = [(5, base), *((5, base + timedelta(days=100, minutes=i)) for i in range(600))]
    df = spark.createDataFrame(burst, "page long, ts timestamp")
    assert rows(prepare.edit_rate(df)) == [(5, 5.99)]
    assert rows(prepare.edit_rate(df, newest=500)) == [(5, 500.0)]


def test_url_dedup_keeps_the_first(spark):
    data = [(1, "http://X/a b/"), (2, "http://x/a%20b"), (3, ""), (4, None), (5, "http://x/c")]
    df = spark.createDataFrame(data, "pos long, url string")
    assert rows(prepare.dedup_by_url(df, "url", "pos").select("pos")) == [(1,), (5,)]


def test_page_records_from_raw_pages(spark):
    raw = spark.createDataFrame(
        [(1, "u1", "<h1>The Cat</h1><p>A cat sat <a href='/wiki/Mat'>mat</a></p>")],
        "page_id long, url string, html string",
    )
    revisions = spark.createDataFrame([(1, datetime(2024, 1, 1))], "page long, ts timestamp")
    row = prepare.page_records(raw, revisions).first()
    assert row["title"] == "The Cat" and row["edits_per_day"] == 0.0
    assert row["word_list"] == ["cat", "cat", "sat", "mat"]
    assert row["trigrams"] == ["cat cat sat", "cat sat mat"]
    assert row["links"] == ["https://es.wikipedia.org/wiki/Mat"]


def test_new_pages_skip_processed(spark):
    done = spark.createDataFrame([(1,), (1,)], "id long")
    assert rows(prepare.new_pages(spark.range(3), done, "id")) == [(0,), (2,)]
