import pytest

from skein.functions import rules
from skein.javascript import aliases
from skein.javascript.candidates import Options, entries
from skein.operators.urls import extract_urls, url_entries
from skein.plans.options import UrlOptions, extension_set


def urls(spark, code, **options):
    df = spark.createDataFrame([(1, code)], "source_id long, content string")
    return [r.url for r in extract_urls(df, **options).orderBy("ord").collect()]


def test_many_sources_do_not_see_each_other(spark):
    codes = ['const b = "/one"; go(b + "/x1")', 'go(b + "/x2")', None, "", '"/users/:id"', "<html><a href='/pp.'>x</a></html>"]
    df = spark.createDataFrame(list(enumerate(codes)), "source_id long, content string")
    got = {}
    for r in extract_urls(df).orderBy("source_id", "ord").collect():
        got.setdefault(r.source_id, []).append(r.url)
    assert got == {0: ["/one", "/one/x1", "/x1"], 1: ["FUZZ/x2", "/x2"], 4: ["/users/FUZZ"], 5: ["/pp."]}


@pytest.mark.parametrize(
    "code, want",
    [
        ('var p="https://"; var h="example.com"; p.concat(h, "/api", "/v1").concat("/data")', "https://example.com/api/v1/data"),
        ('var a=["/api","/v2","/users"]; a.join("")', "/api/v2/users"),
        ('var u="456"; var p="/user/{id}"; p.replace("{id}", u)', "/user/456"),
        ('"/api/test?a\\x3d1&b\\u003d2&c\\075d"', "/api/test?a=1&b=2&c=d"),
        ('"cdn.site.com?v=123"', "cdn.site.com?v=123"),
        ('throw "this means see https://example.com/invariant-packages) now"', "https://example.com/invariant-packages"),
        ("x = `${base}/spaces/${k}${v}`", "FUZZ/spaces/FUZZ"),
        ('var o = {a: {b: "/deep/p"}}; go(o.b + "/q1")', "/deep/p/q1"),
    ],
)
def test_single_results(spark, code, want):
    assert want in urls(spark, code)


def test_templates_and_aliases(spark):
    code = "const {config: c} = z; const o = {id: t, tempValue: t}; go(`/a1/${c.id}/${t}`)"
    assert urls(spark, code, include_templates=True)[0] == "/a1/{config.id}/{id}"
    assert urls(spark, code, include_templates=True, skip_aliases=True)[0] == "/a1/{c.id}/{t}"
    assert aliases.score("id") == -3 and aliases.score("tempValue") == 109


def test_nothing_to_find(spark):
    assert urls(spark, 'var a = ""; var b = \'\';') == []
    assert urls(spark, "var a = '<div>no address</div>'") == []


def test_template_with_values_inside_a_chain():
    found = entries('var a = "x1"; go(`/p1/${a}` + "/q1")', Options())
    assert ("/p1/{a}/q1", "/p1/x1/q1") in {(e.original, e.placeholder) for e in found}


def test_context_nested_and_lists():
    options = Options(context={"cfg": {"base": "/ctx"}, "parts": ["/a1", 2]})
    found = [e.placeholder for e in entries('go(cfg.base + "/x1"); go(parts.join("/"))', options)]
    assert "/ctx/x1" in found and "/a1/2" in found


def test_combinations_are_bounded():
    code = "".join(f'v{i} = "a{j}";' for i in range(8) for j in range(10)) + "go(`/x1/" + "".join(f"${{v{i}}}" for i in range(8)) + "`)"
    assert len(entries(code, Options(max_combinations=500))) == 500


def test_node_limit():
    code = "".join(f'f("/path{i}");' for i in range(100))
    assert 0 < len(entries(code, Options(max_nodes=50))) < 30


def test_size_gate(spark):
    code = 'const b = "/v1"; go(b + "/users")'
    assert "/v1/users" in urls(spark, code)
    assert "/v1/users" not in urls(spark, code, max_file_size=0.00001)
    assert "/ctx/users" in urls(spark, code, max_file_size=0.00001, context={"b": "/ctx"})


def test_options_are_checked():
    for bad in ({"context_policy": "x"}, {"html_parser": "x"}, {"placeholder": ""}, {"max_nodes": 0}):
        with pytest.raises(ValueError):
            UrlOptions(**bad)
    assert extension_set(" .Proto, graphql,,") == {"proto", "graphql"}


def test_first_occurrence_and_other_columns(spark):
    df = spark.createDataFrame([("k", 'a("/x1"); b("/y1"); a("/x1")')], "name string, content string")
    rows = [(r.name, r.ord, r.url) for r in extract_urls(df).collect()]
    assert rows == [("k", 0, "/x1"), ("k", 1, "/y1")]
    assert url_entries(df).columns == ["name", "ord", "original", "placeholder", "resolved", "has_template"]


def test_srcset_with_a_trailing_comma(spark):
    assert urls(spark, '<html><img srcset="/aa.png 1x, ,"><a href="/bb">x</a></html>') == ["/bb", "/aa.png"]


@pytest.mark.parametrize(
    "text, want", [(r"\x41", "A"), (r"\u{1F600}", "\U0001f600"), (r"é", "é"), (r"\101", "A"), (r"\0", "\0"), (r"\q", r"\q"), (r"\n\t", "\n\t"), (r"\8", r"\8"), ("\\", "\\")]
)
def test_unescape(text, want):
    assert rules.unescape(text) == want
