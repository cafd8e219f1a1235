import pytest

from skein.javascript import modes, patterns
from skein.javascript.comments import bare
from skein.javascript.parser import parse
from skein.operators import html
from skein.operators import modes as ops

CODE = 'const API = "https://a.b/c"; function f(x){ return fetch("/x/" + x, {method: "POST"}); } // see "zz"\nobj.call("q"); fetch(\'/y\');'


@pytest.mark.parametrize(
    "text, want",
    [
        ("// //google.com", ("//google.com", True)), ("// //255.255.255.255", ("//255.255.255.255", True)), ("/// test", ("test", True)),
        ("// // test", ("test", True)), ("/* test */", ("test", True)), ("/*/*test*/*/", ("test", True)), ("/* /* // // test */ */", ("test", True)),
        ("/*/*///// test /*/*/", ("test", True)), ("//", (None, False)), ("/**/", (None, False)), ("plain", ("plain", False)),
    ],
)
def test_bare_comments(text, want):
    assert bare(text) == want


def test_strings_once_and_by_length():
    assert modes.strings(CODE) == ["https://a.b/c", "/x/", "POST", "zz", "q", "/y"]
    assert modes.strings(CODE, 3, 4) == ["/x/", "POST"]
    assert modes.strings(r"f('a\nb')") == [r"a\nb", "a", "b"]
    assert modes.strings("x = `t${1}`") == ["`t${1}`", "t"]


def test_inspect_prunes_below_known_texts():
    assert modes.inspect("const x = 5;") == ["const x = 5;"]
    assert modes.inspect("f(a); g(a)", ["identifier"]) == ["f", "a", "g"]


def test_tree_columns_are_bytes():
    lines = modes.tree("x = 'é'; y", include_text=True)
    assert lines[0] == "program (0, 0) - (0, 11) => " + repr("x = 'é'; y".encode())
    assert modes.tree("// 'a'", parse_comments=True, only_named=True)[2] == "  program (0, 0) - (0, 3)"


@pytest.mark.parametrize(
    "query, want",
    [
        ("(string) @s", ["https://a.b/c", "/x/", "POST", "q", "/y"]),
        ('(call_expression function: (identifier) @f (#eq? @f "fetch") arguments: (arguments (string) @a))', ["fetch", "/y"]),
        ("(pair key: (_) @k value: (string) @v)", ["method", "POST"]),
        ("(call_expression function: [(identifier) (member_expression)] @f)", ["fetch", "obj.call", "fetch"]),
        ('((identifier) @i (#match? @i "^A"))', ["API"]),
        ("(arguments . (string) @first)", ["q", "/y"]),
    ],
)
def test_queries(query, want):
    assert [t for _, t in patterns.run(parse(CODE), patterns.Query(query), trim=True)] == want


@pytest.mark.parametrize("query", ["", "   ", "(nope) @x", "(string", "(string))", "(#eq? @a @b)", '(string) @s (#what? @s "a")'])
def test_bad_queries(query):
    with pytest.raises(patterns.PatternError):
        patterns.Query(query)


def test_unique_and_nulls(spark):
    df = spark.createDataFrame([(1, "f(a); f(a)"), (2, None), (3, "")], "id int, content string")
    rows = ops.js_query(df, "(identifier) @i", unique=True).collect()
    assert [(r.id, r.capture, r.text) for r in rows] == [(1, "i", "f"), (1, "i", "a")]
    assert ops.syntax_tree(df).filter("id = 3").count() == 1
    assert ops.js_strings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ops.js_strings(df, least=3, most=3)


def test_node_relation(spark):
    df = spark.createDataFrame([(1, "f(a) // 'x'")], "id int, content string")
    nodes = ops.js_nodes(df, parse_comments=True).orderBy("node_id").collect()
    assert nodes[0].type == "program" and nodes[0].parent_id is None
    assert {n.unit_id for n in nodes} == {0, 1}
    for n in nodes:
        inside = [m for m in nodes if n.node_id < m.node_id <= n.last_desc and m.unit_id == n.unit_id]
        assert all(n.start <= m.start and m.end <= n.end for m in inside)


def test_html_pieces(spark):
    page = "<A HREF=/x1><script>var a=\"</p>\"</script><script src='/s.js'>no()</script><!-- '/c1' --><p data-url=' /d1 '>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "no tags"), (4, "<a <b")], "id int, html string")
    kinds = [(r.kind, r.name, r.value) for r in html.html_pieces(df).filter("id = 1").orderBy("ord").collect()]
    assert ("attribute", "href", "/x1") in kinds and ("script", "", 'var a="</p>"') in kinds and ("comment", "", " '/c1' ") in kinds
    assert html.inline_scripts(df).count() == 1
    assert {r.rank for r in html.html_attributes(df).collect()} == {0, 9 - 2, 31} or html.html_attributes(df).count() == 3
