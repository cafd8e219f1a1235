"""Files, context, SQL names, streams and the command line."""

import json

import pytest

from skein import cli
from skein.operators import html, modes, urls
from skein.plans.register import register
from skein.sources.context import parse_context
from skein.sources.files import read_sources, write_lines
from skein.streaming.stream import stream_sources, stream_urls


def test_context(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": "/x"}')
    assert parse_context(str(path)) == {"a": "/x"}
    assert parse_context('{"a": {"b": 1}}') == {"a": {"b": 1}}
    assert parse_context("A=1, B=x=y C=") == {"A": "1", "B": "x=y", "C": ""}
    for bad in ("", "  ", "[1]", "novalue", "=x", ","):
        with pytest.raises(ValueError):
            parse_context(bad)
    path.write_text("{")
    with pytest.raises(ValueError):
        parse_context(str(path))


def test_files(spark, tmp_path):
    (tmp_path / "a.js").write_text('f("/é1")', encoding="utf-8")
    (tmp_path / "b.js").write_bytes(b"\xff\xfe")
    (tmp_path / "c.js").write_text(" \n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_sources(spark, str(tmp_path), "*.js").collect()}
    assert rows["a.js"].content == 'f("/é1")' and rows["a.js"].valid
    assert rows["b.js"].content is None and not rows["b.js"].valid and not rows["c.js"].valid
    out = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "source_id long, ord long, url string")
    write_lines(out, str(tmp_path / "out"), "url")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ["a", "b", "c"]


def test_sql_names(spark):
    register(spark)
    spark.createDataFrame([(1, 'go("/a1"); // x'), (2, None)], "id int, code string").createOrReplaceTempView("src")
    got = spark.sql("SELECT id, u.url FROM src, LATERAL js_urls(code) u").collect()
    assert [(r[0], r[1]) for r in got] == [(1, "/a1")]
    spark.createDataFrame([('go(`/v1/${x}`); go("/u1/:id).")',)], "code string").createOrReplaceTempView("one")
    got = spark.sql("""SELECT u.url FROM one, LATERAL js_urls(code, '{"include_templates": true, "placeholder": "ZZ"}') u""").collect()
    assert [r[0] for r in got] == ["/v1/{x}", "/v1/ZZ", "/u1/{id}", "/u1/ZZ"]
    assert spark.sql("SELECT e.placeholder FROM src, LATERAL js_entries(code) e").first()[0] == "/a1"
    assert list(spark.sql("SELECT is_junk_url('text/x'), is_junk_url('/a1'), clean_url('/c/1(a)]rest.'), clean_url('/x1.,.'), clean_url(null)").first()) == [True, False, "/c/1(a)", "/x1", None]
    assert [r[0] for r in spark.sql("SELECT n.type FROM LATERAL js_nodes('f(1)') n WHERE n.named").collect()][:2] == ["program", "expression_statement"]
    assert [tuple(r) for r in spark.sql("SELECT h.tag, h.name, h.value FROM LATERAL html_attrs('<a href=/x class=y><p data-url=/z>') h").collect()] == [("a", "href", "/x"), ("p", "data-url", "/z")]
    plan = spark.sql("SELECT is_path(code) FROM src")._jdf.queryExecution().toString()
    assert "Python" not in plan and "BatchEval" not in plan
    got = spark.sql("SELECT is_path('/a1'), is_url('x'), is_filename('a.b'), route_template('/x1/:id'), js_unescape('\\\\x41'), bare_comment('// z')").first()
    assert list(got)[:2] == [True, False] and got[3] == "/x1/{id}" and got[5] == "z"
    assert spark.sql("SELECT q.text FROM src, LATERAL js_query(code, '(string) @s') q").count() == 1
    assert spark.sql("SELECT * FROM src, LATERAL js_tree(code) t").count() > 3
    assert spark.sql("SELECT h.value FROM LATERAL html_pieces('<a href=x>') h").first()[0] == "x"


def test_columns_of_any_name(spark):
    rows = [(1, "x", "y", 'go("/a1")', '<a href="/b1"><!-- c --><script>d("/e1")</script>')]
    df = spark.createDataFrame(rows, "`a.b` int, ord string, URL string, `the.code` string, html string")
    found = urls.extract_urls(df, "the.code")
    assert found.columns == ["a.b", "html", "ord", "url"] and [tuple(r)[2:] for r in found.collect()] == [(0, "/a1")]
    assert urls.url_entries(df, "the.code").first()["original"] == "/a1"
    assert modes.js_strings(df, "the.code").first()["text"] == "/a1" and modes.js_nodes(df, "the.code").first()["type"] == "program"
    assert modes.js_query(df, "(string) @s", "the.code").columns == ["a.b", "URL", "html", "ord", "capture", "text"]
    for made in (html.html_pieces(df), html.html_attributes(df), html.inline_scripts(df), html.html_comments(df)):
        assert made.columns.count("ord") == 1 and "a.b" in made.columns and made.count() >= 1


def test_problems_are_told(spark):
    deep = "f(" * 2000 + '"/x1"' + ")" * 2000
    many = "".join(f'a = "/p{i}"; b = "/q{i}";' for i in range(40)) + "go(`${a}${b}`)"
    page = f"<html><script>{deep}</script></html>"
    df = spark.createDataFrame([(1, 'go("/a1")'), (2, deep), (3, many), (4, None), (5, page), (6, "x;" * 500)], "id int, content string")
    got = {(r.id, r.problem) for r in urls.source_problems(df, max_combinations=100, max_nodes=600).collect()}
    assert {(2, "nested too deep"), (3, "readings cut"), (5, "nested too deep"), (6, "nodes cut")} <= got
    assert not any(i in (1, 4) for i, _ in got)


def test_single_text_rules_equal_columns(spark):
    from skein.functions import columns, rules
    from skein.queries import _JUNK_CASES

    texts = [t.replace("{}", "n1").replace("{{", "{").replace("}}", "}") for t, _ in _JUNK_CASES] + ["", "x", "/a(b", "/a)b", "/a[(])c", "((([[[{}}]", "/a1.,.", ").", "é)x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = columns.F.col("text")
    for r in df.select("text", columns.is_junk(text).alias("junk"), columns.clean(text).alias("clean")).collect():
        assert rules.is_junk(r.text) == r.junk and rules.clean(r.text) == r.clean, r


def test_cleaning_takes_linear_time(spark):
    import time

    from skein.functions import columns

    df = spark.range(1).select(columns.F.repeat(columns.F.lit("/abc(d)"), columns.F.lit(60_000)).alias("text"))
    start = time.perf_counter()
    assert df.select(columns.F.length(columns.clean(columns.F.col("text")))).first()[0] == 420_000
    assert time.perf_counter() - start < 20


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.js").write_text(f'a("/same"); b("/only{i}")')
    rows = stream_urls(stream_sources(spark, str(tmp_path / "in")), delay="1 hour")
    query = rows.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.url for r in spark.table("found").collect()) == ["/only0", "/only1", "/only2", "/same"]


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "a.js"
    path.write_text('const b = "/v1"; go(b + "/x1")')
    assert cli.main(["urls", str(path)]) == 0
    assert capsys.readouterr().out.splitlines() == ["/v1", "/v1/x1", "/x1"]
    assert cli.main(["strings", str(path), "--min", "3", "--max", "9"]) == 0
    assert capsys.readouterr().out.splitlines() == ["/v1", "/x1"]
    assert cli.main(["query", str(path), "--query", "(nope) @x"]) == 0
    assert capsys.readouterr().out.startswith("error:")
    assert cli.main(["inspect", "--get-types"]) == 0
    assert "program" in capsys.readouterr().out
    for bad in (["query", str(path), "--query", " "], ["strings", str(path), "--min", "0"], ["strings", str(path), "--min", "3", "--max", "2"], ["urls", str(path), "--context", ""], ["nope"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 1
    capsys.readouterr()
    with pytest.raises(SystemExit):
        cli.main(["urls", "--help"])
    shown = capsys.readouterr().out
    assert "examples:" in shown and "(default: FUZZ)" in shown
    assert json.dumps(cli.arguments(["urls", str(path), "--context", "a=1"]).context) == '{"a": "1"}'


def test_spread_only_where_partitions_are_few(spark):
    from skein.sources.files import spread

    df = spark.range(100).repartition(2)
    assert spread(df, 8).rdd.getNumPartitions() == 8
    assert spread(df, 2).rdd.getNumPartitions() == 2
