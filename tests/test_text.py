import re

from pyspark.sql import functions as F

from pageloom.functions import html, urls
from pageloom.functions.stopwords import english
from pageloom.plans.oracle import STOP_WORDS
from pageloom.functions.text import exploded, kept_words, ngrams, tokens
from pageloom.plans import fixtures as fx

from .conftest import rows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(value).alias(name) for name, value in values.items()])
    return df.select(column.alias("value")).first()["value"]


def python_tokens(text):
    return re.sub(r"[^\w\s]", "", text).lower().split()


def test_tokens_follow_python(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("text", tokens(F.col("text")).alias("words"))
    for row in docs.collect():
        assert row["words"] == python_tokens(row["text"])


def test_tokens_edge_cases(spark):
    cases = ["", "  ", "Don't stop!", "a_b c-d", "x y z\tw", "É1 ñ", "!!!"]
    for text in cases:
        assert one(spark, tokens(F.col("t")), t=text) == python_tokens(text)
    assert spark.sql("select cast(null as string) as t").select(tokens(F.col("t"))).first()[0] == []


def test_stop_words_keep_order_and_duplicates(spark):
    words = one(spark, kept_words(F.col("t")), t="The cat and the cat don't sit, Not here")
    # the apostrophe is gone before the comparison, so "don't" stays as "dont"
    assert words == ["cat", "cat", "dont", "sit"]
    assert one(spark, kept_words(F.col("t"), ["el"]), t="El gato the") == ["gato", "the"]
    assert sorted(english()) == sorted(STOP_WORDS) and len(STOP_WORDS) == 181


def test_ngrams(spark):
    for words in ([], ["a"], ["a", "b"], ["a", "b", "c", "a", "b"]):
        df = spark.createDataFrame([(words,)], "w array<string>")
        for n in (1, 2, 3):
            expected = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            assert df.select(ngrams(F.col("w"), n)).first()[0] == expected


def test_ngrams_from_shorter_ones(spark):
    for words in ([], ["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]):
        df = spark.createDataFrame([(words,)], "w array<string>").withColumn("pairs", ngrams(F.col("w"), 2))
        made = df.select(ngrams(F.col("w"), 3, F.col("pairs")), ngrams(F.col("w"), 3)).first()
        assert made[0] == made[1]


def test_ngrams_bridge_removed_stop_words(spark):
    words = kept_words(F.col("t"))
    assert one(spark, ngrams(words, 2), t="cat on the mat") == ["cat mat"]


def test_exploded_drops_null_and_empty(spark):
    df = spark.createDataFrame(
        [(1, ["a", None, "", "a"]), (2, []), (3, None)], "id int, items array<string>"
    )
    assert rows(exploded(df, ["id"], F.col("items"), "item")) == [(1, "a"), (1, "a")]


def test_quote_and_unquote(spark):
    from urllib.parse import quote, unquote

    for text in ["a b", "a+b", "a/b~c*d", "Á é?", "100%", "x&y=z"]:
        assert one(spark, urls.quote(F.col("t")), t=text) == quote(text)
    for text in ["a%20b", "a+b", "%C3%A1", "bad%zz", "%2", "mixed%zz%20", "plain"]:
        assert one(spark, urls.unquote(F.col("t")), t=text) == unquote(text)


def test_normalize_url(spark):
    def normal(text):
        return one(spark, urls.normalize_url(F.col("t")), t=text)

    assert normal(" http://X/A%20b// ") == "http://x/a b"
    assert normal("http://x/caf%C3%A9") == normal("http://x/café/")
    assert normal("") == normal(" \t/ ") == ""
    assert normal("http://a/b\t") == normal("\nhttp://a/B/ \r\n") == "http://a/b"


def test_title_key(spark):
    assert one(spark, urls.title_key(F.col("t")), t="https://h/wiki/A%20b") == "A b"


def test_link_rules(spark):
    rules = urls.LinkRules()
    long = "./" + "x" * 2_100_000
    assert len(one(spark, rules.resolve(F.col("t")), t=long)) == len(rules.base) + 2_100_000
    cases = {
        "/wiki/Casa": "https://es.wikipedia.org/wiki/Casa",
        "/wiki/Archivo:Foto": None,
        "/wiki/Casa#top": None,
        "./Perro": "https://es.wikipedia.org/wiki/Perro",
        "./": None,
        "./A:b": None,
        "https://es.wikipedia.org/wiki/Gato": "https://es.wikipedia.org/wiki/Gato",
        "https://es.wikipedia.org/wiki/A:b": None,
        "https://other.org/x": None,
        "#top": None,
    }
    for href, expected in cases.items():
        assert one(spark, rules.resolve(F.col("h")), h=href) == expected, href


PAGE = """<html><head><title>T</title><script>var t="</p><a href='/no'>";</script></head><body>
<!-- <p>hidden</p> <a href="/hidden">x</a> --><h1>A &amp; <i>B</i></h1>
<p>one <b>two</b><br>three<p>four</p><div>skip</div><h2> five </h2>
<a class="x" href="/wiki/X">x</a><a href='./Y?a=1&amp;b=2'>y</a><a name="z">z</a></body></html>"""


def test_block_text(spark):
    def text(page, repeat=True):
        return one(spark, html.block_text(F.col("h").cast("string"), repeat), h=page)

    assert text(PAGE, False) == "A & B one two three skip x y z four five"
    assert "hidden" not in text(PAGE) and "var t" not in text(PAGE)
    nested = "<p>a<p>b</p></p><p>c</p>"
    assert text(nested, False) == "a b c"
    assert text(nested) == "a b b c"
    assert text("<p>a<p>b</p>") == "a b b"
    assert text("") == text("<p>") == text("no block") == ""
    assert text("<div>x</div><h5>y</h5>") == "y"
    assert text("<p/><p></p><p>a</p>") == "  a"
    assert text("<p title='a>b'>x < y<!-- c -->z</P ><script>p</p>") == "x < y z"
    assert text("<p>a</div></b>b<i>c</p>d") == "a b c"
    assert text("<p>" + "a<b>" * 3000) == " ".join("a" * 3000)


def test_unescape_as_the_standard_does(spark):
    import html as standard
    import random

    chosen = random.Random(2)
    bits = ["&amp;", "&lt", "&notit;", "&notin;", "&#65;", "&#x41", "&#0;", "&#128;", "&#x9f;", "&#55296;", "&#1114112;",
            "&#99999999999;", "&#11;", "&nbsp", "&Eacute;t", "&eacutet", "&;", "&", "& ", "&#", "&#x", "&#xZ;", "x", "<", "é",
            "&unknown;", "&ampamp;", "&#00065;", "&CounterClockwiseContourIntegral;", "&#127;", "&#13;", "&#xFFFE;", "&bne;"]
    texts = ["".join(chosen.choice(bits) for _ in range(chosen.randint(0, 6))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", html.unescape(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in found] == [(t, standard.unescape(t)) for t in texts]


def test_heading_and_hrefs(spark):
    assert one(spark, html.heading(F.col("h")), h=PAGE) == "A & B"
    assert one(spark, html.heading(F.col("h")), h="<p>x</p>") is None
    known = {
        "<h1>\n  Casa\t\n</h1>": "Casa",
        "<!-- <h1>old</h1> --><h1>New</h1>": "New",
        "<script>var t = '<h1>x</h1>';</script><h1 class='a'>Y</h1>": "Y",
        "<h1>Espa&ntilde;a &#225; &amp;lt; &#x41;</h1>": "España á &lt; A",
        "<h1> \u00a0</h1>": "",
    }
    for page, title in known.items():
        assert one(spark, html.heading(F.col("h")), h=page) == title
    assert one(spark, html.hrefs(F.col("h")), h='<a href="/wiki/Espa&ntilde;a">x</a>') == ["/wiki/España"]
    assert one(spark, html.hrefs(F.col("h")), h=PAGE) == ["/wiki/X", "./Y?a=1&b=2"]
