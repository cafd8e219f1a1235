"""Column forms against the single-value forms, and cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import columns as C
from skein.functions import rules

TEXTS = [
    "http://a.b/c", "//x", "www.a", "API.x", "1.2.3.4", "1.2.3.4:80/", "1.2.3.4x", "a.b.co", "a.b/", "a.b", "/ab", "/a", "./", "../x", "v1/x", "x.json",
    "x.min.JS", "a.js", ".js", "x/y.js", "?q=1", "/s?q", "a?b", "ab?c", "a.com?v", "a b.com?v", "a.b;c?x", "one two three four", "this means /x", "", "a\\b.js",
    "<!doctype html>", "  <html lang=a>", "<b>x", "<a <script>", "a < b > c", "< " * 60 + ">", "/x/:id/[K]", "http://u:p@h/:id", "[1]", "{a}", "FUZZFUZZ/x", "FUZZFUZZFUZZ",
    "see https://ab.cd/ef, and more words here", "error: https://abc.de/f).", "useRoutes() x", "no words", "tar.gz", "ab.tar.gz", "mailto:x@y", "ftp://",
]


def noise(n, seed=4):
    r = random.Random(seed)
    pool = ["/", ".", "?", ":", "api", "js", "a", "b1", " ", "www.", "http://", "{x}", "[ID]", "FUZZ", "(", ")", ";", "-", "_", "<", ">"]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(t,) for t in dict.fromkeys(TEXTS + noise(1500))], "t string").cache()


@pytest.mark.parametrize("name", ["is_url", "is_path", "is_filename", "is_html", "wordy"])
def test_predicates_agree(table, name):
    rows = table.select("t", getattr(C, name)(F.col("t")).alias("got")).collect()
    assert [r.t for r in rows if r.got != getattr(rules, name)(r.t)] == []


def test_rewrites_agree(table):
    t = F.col("t")
    rows = table.select("t", C.route_template(t).alias("route"), C.message_urls(t).alias("urls")).collect()
    assert [r.t for r in rows if r.route != rules.route_template(r.t)[0]] == []
    assert [r.t for r in rows if r.urls != rules.message_urls(r.t, "FUZZ")] == []


@pytest.mark.parametrize(
    "text, want",
    [("/a(b)c", "/a(b)c"), ("/a)b", "/a"), ("/a(b]c", "/a(b"), ("/a[", "/a["), ("/a.b.,.", "/a.b"), ("/x})", "/x"), ("f(a)[0]{x}", "f(a)[0]{x}"), ("", ""), (")", "")],
)
def test_clean(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    once = df.select(C.clean(F.col("t")).alias("c"))
    assert once.first()[0] == want
    assert once.select(C.clean(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(
    "text, junk",
    [
        (None, True), ("", True), ("application/json", True), ("text/html; charset=utf-8", True), ("message/rfc822", True), ("/api/users", False),
        ("https://FUZZ/", True), ("https://FUZZ/api", False), ("https://{domain}", False), ("util.promisify.custom", True), ("app.min.js", False),
        ("/{t}", True), ("FUZZ/FUZZ", True), ("/dd/mm/yyyy", True), ("/{yyyy}/{mm}/{dd}/", True), ("/HH:MM", True), ("America/Argentina/Buenos_Aires", True),
        ("Africa/Abidjan|LMT GMT|g.8", True), ("YYYY-MM-DD", True), ("(/$1)?$2", True), ("FUZZ%", True), ("/*FUZZ*FUZZ", True), ("Object.prototype.x", True),
        ("x.bind ", True), ("/a/('", True), ("it's here/x", True), ("{a}'s/b", False), ("http://www.w3.org/2000/svg", True), ("file://", True),
    ],
)
def test_junk(spark, text, junk):
    assert spark.createDataFrame([(text,)], "t string").select(C.is_junk(F.col("t"))).first()[0] is junk


def test_placeholder_with_special_characters(spark):
    df = spark.createDataFrame([("$X{1}$X{1}/a",), ("$X{1}/$X{1}",)], "t string")
    assert df.select(C.consolidate(F.col("t"), "$X{1}")).first()[0] == "$X{1}/a"
    assert [r[0] for r in df.select(C.is_junk(F.col("t"), "$X{1}")).collect()][1] is True
