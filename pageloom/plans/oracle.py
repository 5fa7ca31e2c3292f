"""The same results as plain SQL, one statement per registered query.

Nothing here comes from the code under test: patterns, rules and word lists are
written out once more, for the other engine.
"""

from __future__ import annotations

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Link forms of the pages table.
_ORIGIN = "https://wiki.example.org"
_BASE = "https://wiki.example.org/wiki/"
_ROOTED = "/"
_MARKER = "example.org/wiki/"

# Character references that occur in the pages table, the ampersand last.
_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " ", "amp": "&"}

_SPACE = r"\t\n\v\f\r \x{1C}-\x{1F}\x{85}\p{Z}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_STOP = ", ".join(_text(word) for word in STOP_WORDS)


def _tokens(text: str, stop: bool) -> str:
    other = _text(rf"[^\p{{L}}\p{{Nd}}\p{{Nl}}\p{{No}}_{_SPACE}]+")
    cleaned = f"lower(regexp_replace({text}, {other}, '', 'g'))"
    dropped = f"'', {_STOP}" if stop else "''"
    split = f"regexp_split_to_array({cleaned}, {_text(f'[{_SPACE}]+')})"
    return f"list_filter({split}, lambda x: x NOT IN ({dropped}))"


def _unescape(text: str) -> str:
    for name, character in _REFERENCES.items():
        text = f"replace({text}, '&{name};', {_text(character)})"
    return text


def _stripped(text: str) -> str:
    left = f"regexp_replace({text}, {_text(f'^[{_SPACE}]+')}, '')"
    return f"regexp_replace({left}, {_text(f'[{_SPACE}]+$')}, '')"


# scripts and styles end at their own closing tag, comments at their own mark
_CONTENT = (
    "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), "
    "'<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis')"
)

# a page as comments, scripts and styles, declarations, tags and text
_TOKEN = _text(
    r"(?is)<!--.*?-->|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)|<[!?][^>]*>"
    r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<"""
)
_EMPTY_ELEMENTS = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr'"
_TEXT_BLOCKS = "'p','h1','h2','h3','h4','h5'"


def _page_text(repeat: bool) -> str:
    """Open elements as a stack in a fold over the tokens; rows of pieces, put together by block."""
    state = (
        "struct_pack(kind := {kind}, name := {name}, text := {text}, stack := {stack}, blocks := {blocks}, "
        "run := {run}, found := {found})"
    )
    token = state.format(
        kind=rf"""CASE WHEN x[1] <> '<' OR x = '<' THEN 'text' WHEN x LIKE '<!--%' THEN 'gap'
          WHEN x[2] IN ('!', '?') THEN 'none' WHEN x[2] = '/' THEN 'close'
          WHEN regexp_matches(x, '^<(script|style)([ \t\n/>]|$)', 'i') THEN 'gap'
          WHEN lower(regexp_extract(x, '^<([a-zA-Z][^\s/>]*)', 1)) IN ({_EMPTY_ELEMENTS}) THEN 'gap'
          WHEN x LIKE '%/>' THEN 'empty' ELSE 'open' END""",
        name=r"lower(regexp_extract(x, '^</?([a-zA-Z][^\s/>]*)', 1))",
        text="x",
        stack="[]::STRUCT(name VARCHAR, block INTEGER)[]",
        blocks="0::INTEGER",
        run="''",
        found="[]::STRUCT(block INTEGER, place INTEGER, text VARCHAR)[]",
    )
    owners = "list_filter(s.stack, lambda o: o.block >= 0)"
    if not repeat:
        owners = f"({owners})[-1:]"
    flushed = f"""CASE WHEN s.run = '' THEN s.found ELSE list_concat(s.found, list_transform({owners},
        lambda o: struct_pack(block := o.block, place := len(s.found)::INTEGER, text := s.run))) END"""
    block = f"(t.kind IN ('open', 'empty') AND t.name IN ({_TEXT_BLOCKS}))"
    back = "list_position(list_reverse(list_transform(s.stack, lambda o: o.name)), t.name)"
    kept = {"kind": "''", "name": "''", "text": "''"}
    text = state.format(**kept, stack="s.stack", blocks="s.blocks", run="s.run || t.text", found="s.found")
    tag = state.format(
        **kept,
        stack=f"""CASE WHEN t.kind = 'open' THEN list_append(s.stack, struct_pack(name := t.name,
            block := CASE WHEN {block} THEN s.blocks ELSE -1::INTEGER END))
          WHEN t.kind = 'close' AND coalesce({back}, 0) > 0 THEN s.stack[:len(s.stack) - {back}]
          ELSE s.stack END""",
        blocks=f"(s.blocks + CASE WHEN {block} THEN 1 ELSE 0 END)::INTEGER",
        run="''",
        found=f"""list_concat({flushed}, CASE WHEN {block}
            THEN [struct_pack(block := s.blocks, place := -1::INTEGER, text := '')]
            ELSE []::STRUCT(block INTEGER, place INTEGER, text VARCHAR)[] END)""",
    )
    return f"""WITH taken AS MATERIALIZED (
          SELECT page_id, list_transform(list_append(list_prepend('', regexp_extract_all(coalesce(html, ''), {_TOKEN})), '<!---->'),
            lambda x: {token}) AS tokens FROM pages
        ), folded AS MATERIALIZED (
          SELECT page_id, list_reduce(tokens, lambda s, t: CASE WHEN t.kind = 'none' THEN s
            WHEN t.kind = 'text' THEN {text} ELSE {tag} END).found AS found FROM taken
        ), pieces AS (
          SELECT page_id, f.block AS block, f.place AS place, {_stripped(_unescape("f.text"))} AS piece
          FROM (SELECT page_id, unnest(found) AS f FROM folded)
        ), blocks AS (
          SELECT page_id, block,
            coalesce(string_agg(piece, ' ' ORDER BY place) FILTER (WHERE place >= 0 AND piece <> ''), '') AS block_text
          FROM pieces GROUP BY ALL
        )
        SELECT p.page_id, coalesce(b.text, '') AS text FROM pages p LEFT JOIN (
          SELECT page_id, string_agg(block_text, ' ' ORDER BY block) AS text FROM blocks GROUP BY page_id) b USING (page_id)"""


_PAIR = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
_TRIPLE = (
    "list_transform(range(1, len(words) - 1), "
    "lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])"
)

_CTES = {
    "docs": f"""SELECT doc_id AS id_page, 'doc://' || doc_id AS url, source AS title,
        {_tokens("text", True)} AS words FROM documents""",
    "w": "SELECT id_page, unnest(words) AS word FROM docs",
    "wf": "SELECT id_page, word, count(*) AS quantity FROM w GROUP BY ALL",
    "totals": "SELECT word, count(*) AS total_repetitions FROM w GROUP BY word",
    "bench_totals": f"""SELECT word, count(*) AS total_repetitions FROM
        (SELECT unnest({_tokens("text", True)}) AS word FROM benchmark) GROUP BY word""",
    "g2": f"SELECT id_page, unnest({_PAIR}) AS gram FROM docs",
    "g3": f"SELECT id_page, unnest({_TRIPLE}) AS gram FROM docs",
    "s2": """SELECT id_page, gram, split_part(gram, ' ', 1) AS word1,
        split_part(gram, ' ', 2) AS word2 FROM g2""",
    "s3": """SELECT id_page, gram, split_part(gram, ' ', 1) AS word1,
        split_part(gram, ' ', 2) AS word2, split_part(gram, ' ', 3) AS word3 FROM g3""",
    "f2": "SELECT id_page, word1, word2, count(*) AS repetition_count FROM s2 GROUP BY ALL",
    "f3": "SELECT id_page, word1, word2, word3, count(*) AS repetition_count FROM s3 GROUP BY ALL",
    "d2": """SELECT row_number() OVER (ORDER BY word1, word2) AS id_set2, *
        FROM (SELECT word1, word2, count(*) AS page_count FROM f2 GROUP BY ALL)""",
    "d3": """SELECT row_number() OVER (ORDER BY word1, word2, word3) AS id_set3, *
        FROM (SELECT word1, word2, word3, count(*) AS page_count FROM f3 GROUP BY ALL)""",
    "u2": "SELECT DISTINCT id_page, gram FROM g2",
    "u3": "SELECT DISTINCT id_page, gram FROM g3",
    "p2": """SELECT a.id_page AS page1, b.id_page AS page2, count(*) AS shared
        FROM u2 a JOIN u2 b ON a.gram = b.gram AND a.id_page < b.id_page GROUP BY ALL""",
    "p3": """SELECT a.id_page AS page1, b.id_page AS page2, count(*) AS shared
        FROM u3 a JOIN u3 b ON a.gram = b.gram AND a.id_page <> b.id_page GROUP BY ALL""",
    "t2": """SELECT page1 AS id_page1, page2 AS id_page2, shared AS shared_sets_count, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY page1 ORDER BY shared DESC, page2) AS rank
              FROM p2) WHERE rank <= 10""",
    "t3": """SELECT page1 AS id_page1, page2 AS id_page2, shared AS shared_sets_count, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY page1 ORDER BY shared DESC, page2) AS rank
              FROM p3) WHERE rank <= 10""",
    "share": """SELECT id_page, word, quantity,
        quantity::DOUBLE / sum(quantity) OVER (PARTITION BY id_page)::DOUBLE AS fraction FROM wf""",
    "found": """SELECT d.title AS "TITLE", d.url AS "URL", f.quantity AS "QUANTITY",
          regexp_extract(d.title, '[0-9]+')::BIGINT AS title_number, f.id_page
        FROM wf f JOIN docs d USING (id_page)
        WHERE f.word = (SELECT word FROM totals ORDER BY total_repetitions DESC, word LIMIT 1)""",
    "rates": """SELECT id_page, CASE WHEN n < 2 THEN 0.0::DOUBLE
          ELSE round(n / greatest(micros / 86400000000.0::DOUBLE, 1.0::DOUBLE), 2) END
          AS edits_per_day
        FROM (SELECT user_id AS id_page, count(*)::DOUBLE AS n,
                (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS micros
              FROM events WHERE ts IS NOT NULL GROUP BY user_id)""",
    "links": "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "edges": "SELECT DISTINCT src, dst FROM links WHERE src <> dst",
    "own_links": "SELECT src, dst FROM links WHERE src IN (SELECT id_page FROM docs)",
    "own_edges": "SELECT DISTINCT src, dst FROM own_links WHERE src <> dst",
    "numbered": """SELECT id_page, url, row_number() OVER (ORDER BY id_page % 3 = 0, url) AS no
        FROM docs""",
    "verts": "SELECT p_partkey AS id_page, 'part://' || p_partkey AS url, p_name AS title FROM part",
    "link_counts": "SELECT src AS id_page, count(DISTINCT dst) AS distinct_links FROM links GROUP BY src",
    "conn": """SELECT v.id_page, v.url, v.title, coalesce(i.n, 0) AS incoming_links,
          coalesce(o.n, 0) AS outgoing_links, coalesce(t.n, 0) AS total_connections,
          coalesce(i.n, 0) + coalesce(o.n, 0) AS connectivity_score
        FROM verts v
        LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = v.id_page
        LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = v.id_page
        LEFT JOIN (SELECT page, count(*) AS n FROM (SELECT src AS page FROM edges
                   UNION ALL SELECT dst FROM edges) GROUP BY page) t ON t.page = v.id_page""",
    "hubs": """SELECT *, outgoing_links * 0.6::DOUBLE + incoming_links * 0.4::DOUBLE AS hub_score
        FROM conn""",
    "repeated": """SELECT dst AS link, count(*) AS total_repetitions FROM links
        WHERE dst IS NOT NULL GROUP BY dst""",
    "gp": """SELECT c.*, coalesce(r.total_repetitions, 0) AS total_repetitions,
          coalesce(e.edits_per_day, 0.0::DOUBLE) AS edits_per_day,
          round(c.connectivity_score * 0.6::DOUBLE
                + coalesce(r.total_repetitions, 0) * 0.4::DOUBLE, 2) AS hub_score
        FROM conn c LEFT JOIN repeated r ON r.link = c.id_page
        LEFT JOIN rates e ON e.id_page = c.id_page""",
    "clean": f"SELECT page_id, url, {_CONTENT} AS body FROM pages",
    "titles": f"""SELECT page_id, url, CASE WHEN inner_html IS NOT NULL
        THEN {_stripped(_unescape("regexp_replace(inner_html, '<[^>]+>', '', 'g')"))} END AS title
        FROM (SELECT page_id, url,
                CASE WHEN regexp_matches(body, '<h1[ >]', 'i')
                     THEN regexp_extract(body, '<h1(?: [^>]*)?>(.*?)</h1>', 1, 'is') END AS inner_html
              FROM clean)""",
    "anchors": "SELECT page_id, unnest(regexp_extract_all(body, '<a [^>]*>', 0, 'is')) AS tag FROM clean",
    "hrefs": f"""SELECT page_id, {_unescape("value")} AS href FROM (
        SELECT page_id, CASE WHEN regexp_matches(tag, ' href *= *"', 'i')
                             THEN regexp_extract(tag, ' href *= *"([^"]*)"', 1, 'i')
                             WHEN regexp_matches(tag, ' href *= *''', 'i')
                             THEN regexp_extract(tag, ' href *= *''([^'']*)''', 1, 'i')
                             ELSE regexp_extract(tag, ' href *= *([^ >]+)', 1, 'i') END AS value
        FROM anchors WHERE regexp_matches(tag, ' href *=', 'i'))""",
    "page_link": f"""SELECT DISTINCT page_id, link FROM (
        SELECT page_id, CASE
          WHEN starts_with(href, {_text(_ROOTED)}) THEN
            CASE WHEN NOT contains(href, ':') AND NOT contains(href, '#')
                 THEN {_text(_ORIGIN)} || href END
          WHEN starts_with(href, './') THEN
            CASE WHEN NOT contains(href, ':') AND NOT contains(href, '#') AND length(href) > 2
                 THEN {_text(_BASE)} || substr(href, 3) END
          WHEN contains(href, {_text(_MARKER)})
               AND NOT contains(string_split(href, '/wiki/')[-1], ':')
               AND NOT contains(href, '#') THEN href END AS link
        FROM hrefs) WHERE link IS NOT NULL""",
}

# Which of the named steps each one reads.
_NEEDS = {
    "found": ["wf", "totals", "docs"],
    "w": ["docs"], "wf": ["w"], "totals": ["w"], "g2": ["docs"], "g3": ["docs"], "s2": ["g2"],
    "s3": ["g3"], "f2": ["s2"], "f3": ["s3"], "d2": ["f2"], "d3": ["f3"], "u2": ["g2"],
    "u3": ["g3"], "p2": ["u2"], "p3": ["u3"], "t2": ["p2"], "t3": ["p3"], "share": ["wf"],
    "edges": ["links"], "own_links": ["links", "docs"], "own_edges": ["own_links"], "numbered": ["docs"], "link_counts": ["links"], "conn": ["verts", "edges"], "hubs": ["conn"],
    "repeated": ["links"], "gp": ["conn", "repeated", "rates"], "page_link": ["hrefs"], "hrefs": ["anchors"],
    "anchors": ["clean"], "titles": ["clean"],
}


def _with(names: str, body: str) -> str:
    """``body`` after the named steps and all they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    steps = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name]})" for name in ordered)
    return f"WITH {steps}\n{body}"


_ITEMS = "len({0}) AS n_items, array_to_string({0}, '{1}') AS items"
_WORD = "(SELECT word FROM totals ORDER BY total_repetitions DESC, word LIMIT 1)"
_FIRST_DOC = "(SELECT min(id_page) FROM wf)"
_FIRST_PART = "(SELECT min(id_page) FROM verts)"


def _top_by_gram(n: int) -> str:
    keys = ", ".join(f"word{i}" for i in range(1, n + 1))
    return _with(
        f"f{n}",
        f"""SELECT d.title AS "TITLE", d.url AS "URL", f.repetition_count AS "REPETITION_COUNT"
        FROM f{n} f JOIN docs d USING (id_page)
        JOIN (SELECT {keys} FROM f{n} GROUP BY ALL
              ORDER BY sum(repetition_count) DESC, {keys} LIMIT 1) USING ({keys})""",
    )


def _shared_of_page(n: int) -> str:
    return _with(
        f"t{n}",
        f"""SELECT d.title AS "TITLE", d.url AS "URL", t.shared_sets_count AS "SHARED_SETS"
        FROM t{n} t JOIN docs d ON d.id_page = t.id_page2
        WHERE t.id_page1 = (SELECT min(id_page1) FROM t{n})""",
    )


def _gram_relation(n: int) -> str:
    keys = ", ".join(f"word{i}" for i in range(1, n + 1))
    return _with(
        f"d{n}", f"SELECT id_set{n}, id_page, repetition_count FROM f{n} JOIN d{n} USING ({keys})"
    )


def _job_tables() -> list[tuple[str, str, str]]:
    """Each result table: what its rows hold, shares in billionths, and the rows."""
    terms = "(SELECT row_number() OVER (ORDER BY word) AS id_word, word FROM (SELECT DISTINCT word FROM wf))"
    billionths = "round({} * 1e9::DOUBLE)::BIGINT"
    percentage, fraction = billionths.format("fraction * 100"), billionths.format("fraction")
    found = [
        (
            "page",
            f"""id_page, title, url, {billionths.format("edits_per_day")}, distinct_links, quant_set2,
              quant_set3, total_repetitions, incoming, outgoing, connections, incoming + outgoing""",
            """SELECT d.id_page, d.title, d.url, coalesce(edits_per_day, 0.0::DOUBLE) AS edits_per_day,
                coalesce(distinct_links, 0) AS distinct_links,
                greatest(len(words) - 1, 0) AS quant_set2, greatest(len(words) - 2, 0) AS quant_set3,
                (SELECT count(*) FROM links l WHERE l.dst = d.id_page) AS total_repetitions,
                (SELECT count(*) FROM edges e WHERE e.dst = d.id_page) AS incoming,
                (SELECT count(*) FROM edges e WHERE e.src = d.id_page) AS outgoing,
                (SELECT count(*) FROM edges e WHERE e.dst = d.id_page)
                  + (SELECT count(*) FROM edges e WHERE e.src = d.id_page) AS connections
              FROM docs d LEFT JOIN link_counts USING (id_page) LEFT JOIN rates USING (id_page)""",
        ),
        (
            "word",
            "id_word, word, quantity, link_quantity",
            f"""SELECT id_word, word, quantity, coalesce(link_quantity, 0) AS link_quantity FROM {terms}
              JOIN (SELECT word, sum(quantity)::BIGINT AS quantity FROM wf GROUP BY word) USING (word)
              LEFT JOIN (SELECT word, count(*) AS link_quantity FROM links
                         JOIN w ON w.id_page = links.dst GROUP BY word) USING (word)""",
        ),
        (
            "word_page",
            "id_word, id_page, quantity",
            f"SELECT id_word, id_page, quantity FROM wf JOIN {terms} USING (word)",
        ),
        (
            "page_word",
            f"id_page, id_word, quantity, {percentage}, {fraction}",
            f"SELECT id_page, id_word, quantity, fraction FROM share JOIN {terms} USING (word)",
        ),
    ]
    for n in (2, 3):
        keys = ", ".join(f"word{i}" for i in range(1, n + 1))
        facts = f"SELECT id_set{n}, id_page, repetition_count FROM f{n} JOIN d{n} USING ({keys})"
        found += [
            (f"set{n}", f"id_set{n}, {keys}", f"SELECT * FROM d{n}"),
            (f"set{n}_page", f"id_set{n}, id_page, repetition_count", facts),
            (f"shared{n}", "id_page1, id_page2, shared_sets_count, rank", f"SELECT * FROM t{n}"),
        ]
    return found


def _second_run_tables() -> list[tuple[str, str, str]]:
    """The tables over all pages, named by URL and word: pages of the first run come first."""
    billionths = "round({} * 1e9::DOUBLE)::BIGINT"
    percentage, fraction = billionths.format("fraction * 100"), billionths.format("fraction")
    job = {name: (values, rows) for name, values, rows in _job_tables()}
    found = [
        (
            "page",
            job["page"][0].replace("id_page, ", "", 1),
            job["page"][1].replace("FROM links l", "FROM own_links l").replace("FROM edges e", "FROM own_edges e"),
        ),
        (
            "word",
            "word, quantity, link_quantity",
            """SELECT word, quantity, coalesce(link_quantity, 0) AS link_quantity
              FROM (SELECT word, sum(quantity)::BIGINT AS quantity FROM wf GROUP BY word)
              LEFT JOIN (SELECT word, count(*) AS link_quantity FROM own_links
                         JOIN w ON w.id_page = own_links.dst GROUP BY word) USING (word)""",
        ),
        ("word_page", "word, url, quantity", "SELECT * FROM wf JOIN docs USING (id_page)"),
        ("page_word", f"url, word, quantity, {percentage}, {fraction}", "SELECT * FROM share JOIN docs USING (id_page)"),
    ]
    for n in (2, 3):
        keys = ", ".join(f"word{i}" for i in range(1, n + 1))
        side = "<" if n == 2 else "<>"
        found += [
            (f"set{n}", f"{keys}, page_count", f"SELECT * FROM d{n}"),
            (f"set{n}_page", f"{keys}, url, repetition_count", f"SELECT * FROM f{n} JOIN docs USING (id_page)"),
            (
                f"shared{n}",
                "url1, url2, shared, rank",
                f"""SELECT *, row_number() OVER (PARTITION BY no1 ORDER BY shared DESC, no2) AS rank FROM (
                  SELECT a.no AS no1, b.no AS no2, any_value(a.url) AS url1, any_value(b.url) AS url2, count(*) AS shared
                  FROM (SELECT * FROM u{n} JOIN numbered USING (id_page)) a
                  JOIN (SELECT * FROM u{n} JOIN numbered USING (id_page)) b ON a.gram = b.gram AND a.no {side} b.no
                  GROUP BY ALL) QUALIFY rank <= 10""",
            ),
        ]
    return found


ORACLE: dict[str, str] = {
    "load_pages": _with(
        "docs rates",
        """SELECT url, title, array_to_string(words, ' ') AS words,
          greatest(len(words) - 1, 0) AS n_bigrams, greatest(len(words) - 2, 0) AS n_trigrams,
          coalesce(edits_per_day, 0.0::DOUBLE) AS edits_per_day
        FROM docs LEFT JOIN rates USING (id_page)""",
    ),
    "sink_roundtrip": _with("totals", "SELECT * FROM totals"),
    "incremental_new_pages": """SELECT doc_id AS id_page, 'doc://' || doc_id AS url FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "dict_insert_ignore": _with(
        "bench_totals totals",
        """SELECT row_number() OVER (ORDER BY word) AS id_word, word FROM bench_totals
        UNION ALL
        SELECT (SELECT count(*) FROM bench_totals) + row_number() OVER (ORDER BY word), word
        FROM totals WHERE word NOT IN (SELECT word FROM bench_totals)""",
    ),
    "dict_upsert": _with(
        "bench_totals totals",
        """SELECT * FROM totals UNION ALL
        SELECT * FROM bench_totals WHERE word NOT IN (SELECT word FROM totals)""",
    ),
    "page_update_connectivity": _with(
        "conn rates",
        """SELECT c.id_page, c.url, coalesce(r.edits_per_day, 0.0::DOUBLE) AS edits_per_day,
          c.total_connections AS quant_diff_urls
        FROM conn c LEFT JOIN rates r USING (id_page)""",
    ),
    "page_text": _page_text(True),
    "page_text_innermost": _page_text(False),
    "page_title": _with(
        "titles", "SELECT page_id, coalesce(title, replace(url, '_', ' ')) AS title FROM titles"
    ),
    "tokenize": f"""SELECT id_page, {_ITEMS.format("words", " ")}
        FROM (SELECT doc_id AS id_page, {_tokens("text", False)} AS words FROM documents)""",
    "tokenize_stopwords": _with(
        "docs", f"SELECT id_page, {_ITEMS.format('words', ' ')} FROM docs"
    ),
    "ngrams_bigram": _with(
        "docs",
        f"""SELECT id_page, {_ITEMS.format("grams", "|")}
        FROM (SELECT id_page, {_PAIR} AS grams FROM docs)""",
    ),
    "ngrams_trigram": _with(
        "docs",
        f"""SELECT id_page, {_ITEMS.format("grams", "|")}
        FROM (SELECT id_page, {_TRIPLE} AS grams FROM docs)""",
    ),
    "page_links": _with("page_link", "SELECT * FROM page_link"),
    "page_url_build": _with(
        "titles",
        f"""SELECT page_id, {_text(_BASE)}
          || replace(url_encode(replace(title, ' ', '_')), '%2F', '/') AS page_url FROM titles""",
    ),
    "link_title_key": _with(
        "titles", "SELECT page_id, replace(title, ' ', '_') AS title_key FROM titles"
    ),
    "edit_rate": _with("rates", "SELECT * FROM rates"),
    "url_dedup": """SELECT page_id, url, normalized_url FROM (
        SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY page_id) AS rank FROM (
          SELECT page_id, url,
            lower(url_decode(rtrim(trim(url, chr(32) || chr(9) || chr(10) || chr(13)), '/')))
              AS normalized_url
          FROM (SELECT page_id, url FROM pages
                UNION ALL SELECT page_id + 1000000, upper(url) || '/' FROM pages
                UNION ALL SELECT page_id + 2000000, chr(10) || url || chr(9) FROM pages)))
        WHERE rank = 1 AND normalized_url <> ''""",
    "page_stats": _with(
        "docs link_counts rates",
        """SELECT d.id_page, d.title, d.url, coalesce(edits_per_day, 0.0::DOUBLE) AS edits_per_day,
          coalesce(distinct_links, 0) AS distinct_links,
          greatest(len(words) - 1, 0) AS quant_set2, greatest(len(words) - 2, 0) AS quant_set3,
          1::BIGINT AS total_repetitions
        FROM docs d LEFT JOIN link_counts USING (id_page) LEFT JOIN rates USING (id_page)""",
    ),
    "word_page_frequency": _with("wf", "SELECT * FROM wf"),
    "word_totals": _with("totals", "SELECT * FROM totals"),
    "word_dictionary": _with(
        "totals", "SELECT row_number() OVER (ORDER BY word) AS id_word, * FROM totals"
    ),
    "word_page_relation": _with(
        "wf totals",
        """SELECT id_word, id_page, quantity FROM wf
        JOIN (SELECT row_number() OVER (ORDER BY word) AS id_word, word FROM totals) USING (word)""",
    ),
    "bigram_split": _with("s2", "SELECT * FROM s2"),
    "bigram_page_frequency": _with("f2", "SELECT * FROM f2"),
    "bigram_dictionary": _with("d2", "SELECT * FROM d2"),
    "bigram_page_relation": _gram_relation(2),
    "trigram_split": _with("s3", "SELECT * FROM s3"),
    "trigram_page_frequency": _with("f3", "SELECT * FROM f3"),
    "trigram_dictionary": _with("d3", "SELECT * FROM d3"),
    "trigram_page_relation": _gram_relation(3),
    "page_word_percentage": _with(
        "share", "SELECT id_page, word, quantity, fraction * 100 AS percentage FROM share"
    ),
    "page_word_fraction": _with("share", "SELECT id_page, word, quantity, fraction FROM share"),
    "shared_bigram_pairs": _with("p2", "SELECT * FROM p2"),
    "shared_bigram_top10": _with("t2", "SELECT * FROM t2"),
    "shared_trigram_pairs": _with("p3", "SELECT * FROM p3"),
    "shared_trigram_top10": _with("t3", "SELECT * FROM t3"),
    "link_edges": _with("edges", "SELECT * FROM edges"),
    "in_degree": _with(
        "edges", "SELECT dst AS page, count(*) AS incoming_links FROM edges GROUP BY dst"
    ),
    "out_degree": _with(
        "edges", "SELECT src AS page, count(*) AS outgoing_links FROM edges GROUP BY src"
    ),
    "total_connections": _with(
        "edges",
        """SELECT page, count(*) AS total_connections
        FROM (SELECT src AS page FROM edges UNION ALL SELECT dst FROM edges) GROUP BY page""",
    ),
    "page_connectivity": _with("conn", "SELECT * FROM conn"),
    "top_connected_pages": _with(
        "conn", "SELECT * FROM conn ORDER BY connectivity_score DESC, id_page LIMIT 20"
    ),
    "shared_link_pairs": _with(
        "edges",
        """SELECT a.src AS page1, b.src AS page2, count(*) AS shared_links_count
        FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src
        GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "hub_pages": _with("hubs", "SELECT * FROM hubs ORDER BY hub_score DESC, id_page LIMIT 15"),
    "hub_report": _with(
        "hubs",
        """SELECT substr(title, 1, 50) AS title, round(hub_score, 2) AS hub_score
        FROM hubs ORDER BY hubs.hub_score DESC, id_page LIMIT 5""",
    ),
    "graph_summary": _with(
        "conn",
        """SELECT (SELECT count(*) FROM edges) AS total_edges,
          count(*) FILTER (WHERE connectivity_score > 0) AS connected_pages FROM conn""",
    ),
    "word_frequency_in_links": _with(
        "w links",
        """SELECT word, count(*) AS total_repetitions FROM links JOIN w ON w.id_page = links.dst
        GROUP BY word""",
    ),
    "repeated_links": _with("repeated", "SELECT * FROM repeated"),
    "page_link_repetitions": _with(
        "verts repeated",
        """SELECT v.*, coalesce(total_repetitions, 0) AS total_repetitions
        FROM verts v LEFT JOIN repeated r ON r.link = v.id_page""",
    ),
    "bfs_depth3": """WITH RECURSIVE
        edges AS MATERIALIZED (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem
                  WHERE l_suppkey <> l_partkey),
        walk AS (SELECT min(src) AS page, 0 AS depth FROM edges
                 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.page
                 WHERE w.depth < 3)
        SELECT page, min(depth) AS depth FROM walk GROUP BY page""",
    "top_pages_by_word": _with(
        "wf totals",
        f"""SELECT d.title AS "TITLE", d.url AS "URL", f.quantity AS "QUANTITY"
        FROM wf f JOIN docs d USING (id_page) WHERE f.word = {_WORD}""",
    ),
    "top_pages_by_bigram": _top_by_gram(2),
    "top_pages_by_trigram": _top_by_gram(3),
    "shared_bigrams_of_page": _shared_of_page(2),
    "shared_trigrams_of_page": _shared_of_page(3),
    "words_of_page": _with(
        "wf",
        f"""SELECT word AS "WORD", quantity AS "QUANTITY" FROM wf WHERE id_page = {_FIRST_DOC}""",
    ),
    "words_of_page_json": _with(
        "wf",
        f"""SELECT to_json(list(struct_pack("WORD" := word, "QUANTITY" := quantity) ORDER BY word))::VARCHAR AS json
        FROM wf WHERE id_page = {_FIRST_DOC}""",
    ),
    "word_percentages_of_page": _with(
        "share",
        f"""SELECT word AS "WORD", fraction * 100 AS "PERCENTAGE" FROM share
        WHERE id_page = {_FIRST_DOC}""",
    ),
    "sorted_result": _with(
        "wf",
        f"""SELECT row_number() OVER (ORDER BY quantity, word) AS position,
            word AS "WORD", quantity AS "QUANTITY", 'asc' AS sort_order
          FROM wf WHERE id_page = {_FIRST_DOC}
        UNION ALL SELECT row_number() OVER (ORDER BY quantity DESC, word), word, quantity, 'desc'
          FROM wf WHERE id_page = {_FIRST_DOC}
        UNION ALL SELECT row_number() OVER (ORDER BY quantity::VARCHAR, word), word, quantity,
            'alpha' FROM wf WHERE id_page = {_FIRST_DOC}""",
    ),
    # numbers in titles and URLs by value: the digits follow a fixed beginning
    "sorted_titles": _with(
        "found",
        " UNION ALL ".join(
            f"""SELECT row_number() OVER (ORDER BY {keys}, "URL") AS position, "TITLE", "URL",
              "QUANTITY", '{order}' AS sort_order FROM found"""
            for order, keys in {
                "TITLE asc": "title_number",
                "TITLE desc": "title_number DESC",
                "TITLE alpha": '"TITLE"',
                "URL asc": "id_page",
                "URL desc": "id_page DESC",
                "URL alpha": '"URL"',
            }.items()
        ),
    ),
    "link_count_of_page": _with(
        "titles page_link",
        """SELECT t.title AS "TITLE", t.url AS "URL",
          (SELECT count(*) FROM page_link p WHERE p.page_id = t.page_id) AS "QUANTITY_URLS"
        FROM titles t WHERE t.page_id = (SELECT min(page_id) FROM pages)""",
    ),
    "top_interconnected": _with(
        "gp",
        """SELECT title AS "TITLE", url AS "URL", connectivity_score AS "CONNECTIVITY_SCORE",
          total_repetitions AS "TOTAL_REPETITIONS", edits_per_day AS "EDITS_PER_DAY"
        FROM gp WHERE connectivity_score > 0
        ORDER BY connectivity_score DESC, total_repetitions DESC, url LIMIT 10""",
    ),
    "page_connections": _with(
        "gp",
        f"""SELECT title AS "PAGE_TITLE", url AS "PAGE_URL",
          connectivity_score AS "CONNECTIVITY_SCORE", hub_score AS "HUB_SCORE",
          total_repetitions AS "TOTAL_REPETITIONS" FROM gp WHERE id_page = {_FIRST_PART}""",
    ),
    "top_hub_pages": _with(
        "gp",
        """SELECT title AS "TITLE", url AS "URL", hub_score AS "HUB_SCORE",
          connectivity_score AS "CONNECTIVITY_SCORE", total_repetitions AS "TOTAL_REPETITIONS",
          edits_per_day AS "EDITS_PER_DAY"
        FROM gp WHERE connectivity_score > 0 OR total_repetitions > 1
        ORDER BY hub_score DESC, url LIMIT 15""",
    ),
    # the word that the query asks for is the most common one, so its row comes first
    "word_repetitions": _with(
        "totals",
        """SELECT word AS "WORD", total_repetitions AS "TOTAL_REPETITIONS" FROM totals
        ORDER BY total_repetitions DESC, word LIMIT 1""",
    ),
    "page_repetitions": _with(
        "gp",
        f"""SELECT title AS "TITLE", url AS "URL", edits_per_day AS "EDITS_PER_DAY",
          total_repetitions AS "TOTAL_REPETITIONS" FROM gp WHERE id_page = {_FIRST_PART}""",
    ),
    "summary": _with(
        "w g2 g3",
        """SELECT (SELECT count(*) FROM docs) AS total_pages,
          (SELECT count(DISTINCT word) FROM w) AS total_words,
          (SELECT count(DISTINCT gram) FROM g2) AS total_word_pairs,
          (SELECT count(DISTINCT gram) FROM g3) AS total_word_triplets""",
    ),
    "load_check": _with(
        "wf",
        """SELECT (SELECT count(*) FROM docs) AS pages,
          (SELECT count(DISTINCT word) FROM wf) AS words,
          (SELECT count(*) FROM wf) AS word_pages""",
    ),
    "available_pages": _with("docs", "SELECT url, title FROM docs ORDER BY url LIMIT 50"),
    "available_words": _with(
        "totals", "SELECT word FROM totals ORDER BY total_repetitions DESC, word LIMIT 100"
    ),
    "analysis_tables": _with(
        "wf f2 f3 d2 d3 t2 t3 share rates link_counts links w conn",
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS table_name, count(*) AS n_rows,
              sum(('0x' || substr(md5(concat_ws('|', {values})), 1, 8))::BIGINT)::BIGINT AS checksum
            FROM ({rows})"""
            for name, values, rows in _job_tables()
        ),
    ),
    "job_second_run": _with(
        "wf f2 f3 d2 d3 u2 u3 share rates link_counts own_links own_edges numbered w",
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS table_name, count(*) AS n_rows,
              sum(('0x' || substr(md5(concat_ws('|', {values})), 1, 8))::BIGINT)::BIGINT AS checksum
            FROM ({rows})"""
            for name, values, rows in _second_run_tables()
        ),
    ),
    # a copy adds nothing: words and shares of a page are those of the page alone
    "job_repeated_urls": _with(
        "wf docs",
        """SELECT url, title, sum(quantity)::BIGINT AS n_words, 100.0::DOUBLE AS percentage
        FROM wf JOIN docs USING (id_page) GROUP BY url, title""",
    ),
    "raw_page_tables": _with(
        "titles page_link rates",
        """SELECT row_number() OVER (ORDER BY t.url) AS id_page, t.url, t.title,
          coalesce(r.edits_per_day, 0.0::DOUBLE) AS edits_per_day,
          (SELECT count(*) FROM page_link p WHERE p.page_id = t.page_id) AS distinct_links
        FROM titles t LEFT JOIN rates r ON r.id_page = t.page_id WHERE t.title IS NOT NULL""",
    ),
}
