import pytest
from pyspark.sql import functions as F

from webrank.config import Settings
from webrank.functions import html, urls
from webrank.functions.porter2 import stem
from webrank.functions.text import collapse, tokenize, tokenize_content
from webrank.operators.dedup import bucket, simhash, token_hash, unsigned
from webrank.operators.search import phrase

INDEX = {
    "HTTP://Example.COM:80/A/b/#frag": "http://example.com/A/b",
    "https://example.com": "https://example.com/",
    "https://example.com:443/?q=1": "https://example.com/?q=1",
    "http://example.com:443/x/": "http://example.com:443/x",
    "https://example.com/x?b=2&a=1": "https://example.com/x?b=2&a=1",
    "http://[bad": "",
    "": "",
}
CRAWL = {
    "https://E.com/a/?utm_source=x&B=2&a=1#t": "https://e.com/a?a=1&b=2",
    "http://e.com/fr/825?page=2&ref=x": "http://e.com/fr/825?ref=x",
    "https://e.com": "https://e.com/",
    "https://e.com//": "https://e.com",
    "https://e.com/x?a=&b=1": "https://e.com/x?b=1",
}


def test_urls(spark):
    rows = spark.createDataFrame([(x,) for x in [*INDEX, *CRAWL]], "url string")
    got = {r.url: r for r in rows.select("url", urls.normalize_index(F.col("url")).alias("i"), urls.normalize_crawl(F.col("url")).alias("c"), urls.url_hash(F.col("url")).alias("h")).collect()}
    assert {x: got[x].i for x in INDEX} == INDEX
    assert {x: got[x].c for x in CRAWL} == CRAWL
    for x, y in INDEX.items():  # the parser's own canonical form is the same
        assert html.canonical(x) == y
    two = spark.createDataFrame([("http://a.com/x",), ("https://a.com/x",)], "url string")
    assert two.select(urls.url_hash(F.col("url"))).distinct().count() == 1


def test_text(spark):
    row = spark.createDataFrame([("The RED  fox, 42 runs  off ",)], "t string").select(collapse(F.col("t")).alias("c"), tokenize(F.col("t")).alias("t"), tokenize_content(F.col("t")).alias("w"), tokenize(F.lit(None).cast("string")).alias("n")).first()
    assert row.c == "The RED fox, 42 runs off"
    assert row.t == ["the", "red", "fox", "42", "runs", "off"] and row.w == ["red", "fox", "runs"] and row.n == []


@pytest.mark.parametrize(("word", "want"), [w.split(":") for w in "caresses:caress ponies:poni ties:tie cries:cri gas:gas gaps:gap kiwis:kiwi hopping:hop hoping:hope luxuriated:luxuri relational:relat conditional:condit generously:generous communism:communism skies:sky dying:die happy:happi enjoy:enjoy nationalization:nation knightly:knight running:run proceed:proceed at:at agreed:agre falling:fall controlling:control rate:rate".split()])
def test_stems(word, want):
    assert stem(word) == want


def test_hashes(spark):
    row = spark.range(1).select(token_hash(F.lit("abc")).alias("h"), bucket(token_hash(F.lit("abc"))).alias("b"), unsigned(token_hash(F.lit("fox"))).alias("f")).first()
    assert row.h == 8669643054431393949 and row.b == 1925 and int(row.f) == 0xD2E367B6C1211290
    one = simhash(spark.createDataFrame([(1, "abc", 0.5)], "doc_id long, term string, weight double")).first()
    assert one.fingerprint == row.h


def test_phrase(spark):
    cases = [([3, 10], [4, 11], True), ([3, 10], [5, 12], False), ([1, 2], [1, 2], True), ([4], [3], False)]
    rows = spark.createDataFrame(cases, "a array<int>, b array<int>, want boolean")
    assert all(r.got == r.want for r in rows.select(phrase(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_html():
    page = "<html><head><title>A &amp; B</title><script>x<b>y</b></script></head><body><h1>Head <b>line</b></h1><p><b>bold<br><p>text <a href='/t#f'>go <i>on</i></a><a href='/img'><img src=x></a>"
    got = html.fields_of("http://e.com/a/", page)
    assert (got["title"], got["headings"], got["bold"], got["body"]) == ("A & B", "Head line", "bold", "text go on")
    assert got["links"] == [{"target": "http://e.com/t", "text": "go on"}]
    assert html.links_of("http://e.com/a/", page) == ["http://e.com/t", "http://e.com/img"]
    assert html.fields_of("", None)["body"] == "" and Settings().top_k == 15


def test_references_need_their_semicolon():
    got = html.fields_of("http://a.com/", "<title>a&amp;&amp&copy2 &#65; &lt;&nope; &notit;</title><h1>b &amp</h1><p>c & d &quot;</p><xmp>e & f</xmp><a href='/?x=1&amp;y=2&amp'>&middot</a>")
    assert got["title"] == "a&&amp&copy2 A <&nope; &notit;" and got["headings"] == "b &amp"
    assert got["body"] == 'c & d " e & f &middot'
    assert got["links"] == [{"target": "http://a.com/?x=1&y=2&amp", "text": "&middot"}]


def test_visible_text_keeps_cut_references(spark):
    rows = spark.createDataFrame([("<h1>a&amp;&amp</h1><p>b &copy; &cop</p>",)], "html string")
    assert rows.select(html.visible_text("html").alias("t")).first().t == "a&&amp b © &cop"
