"""Registered queries of the source-analysis operators, with DuckDB equivalents.

Pages give real HTML.  JavaScript is generated from table columns, so that what
the operators must find can be said in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import fixed
from .operators import aliases, html, modes
from .operators.urls import extract_urls, url_entries
from .sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages").select("page_id", "html"))


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# -- patterns of the SQL side ----------------------------------------------------

_NO_ADDRESS = "|".join(fixed.NO_ADDRESS)
_WORDY = "(len({t}) - len(replace({t}, ' ', '')) >= 3 OR regexp_matches(lower({t}), '" + _NO_ADDRESS + "'))"
_HOST = r"^(?i:www\.|api\.|cdn\.)"
_URL_SQL = (
    "(NOT " + _WORDY + " AND regexp_matches({t}, '" + f"{fixed.SCHEME}|^//|{_HOST}|{fixed.IPV4}|{fixed.THREE_LABELS}|{fixed.LABELS_SLASH}" + "'))"
)
_EXTENSIONS = ", ".join(f"'{e}'" for e in fixed.FILE_EXTENSIONS)
_FILE_SQL = (
    "(contains({t}, '.') AND NOT regexp_matches({t}, '[/\\\\]') AND len({t}) - len(split_part({t}, '.', -1)) >= 3"
    " AND lower(split_part({t}, '.', -1)) IN (" + _EXTENSIONS + "))"
)
_PATH_SQL = (
    "(NOT " + _WORDY + " AND NOT starts_with({t}, '//') AND CASE WHEN " + _FILE_SQL + " THEN true WHEN contains({t}, '?') THEN"
    " CASE WHEN contains(split_part({t}, '?', 1), '/') THEN true WHEN contains(split_part({t}, '?', 1), '.') THEN"
    " NOT regexp_matches(split_part({t}, '?', 1), '" + fixed.QUERY_NOISE.replace("'", "''") + "')"
    " AND regexp_matches(split_part({t}, '?', 1), '" + fixed.QUERY_HOST + "')"
    " ELSE regexp_matches(split_part({t}, '?', 1), '" + fixed.QUERY_WORD + "') END"
    " ELSE regexp_matches({t}, '" + f"{fixed.SLASH_WORD}|{fixed.DOT_SLASH}|{fixed.WORD_SLASH}" + "') END)"
)


def _sql(template: str, text: str) -> str:
    return template.replace("{t}", text)


# -- pages -------------------------------------------------------------------------


@_query(
    "href_paths",
    "SELECT DISTINCT page_id, value AS path FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS value FROM pages) WHERE "
    + _sql(_PATH_SQL, "value"),
)
def href_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-like link targets of each page, each once: repeats are dropped within the row."""
    links = F.filter(html.pieces(F.col("html"), ("attribute",)), lambda p: (p["tag"] == "a") & (p["name"] == "href"))
    rows = _pages(spark, sf_dir).select("page_id", F.explode(F.array_distinct(F.transform(links, lambda p: F.trim(p["value"])))).alias("path"))
    return rows.filter(C.is_path(F.col("path")))


@_query(
    "page_url_class",
    f"SELECT page_id, {_sql(_URL_SQL, 'url')} AS is_url, {_sql(_PATH_SQL, 'url')} AS is_path, {_sql(_FILE_SQL, 'url')} AS is_filename FROM pages",
)
def page_url_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", C.is_url(url).alias("is_url"), C.is_path(url).alias("is_path"), C.is_filename(url).alias("is_filename"))


@_query("inline_scripts", "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS code FROM pages")
def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.inline_scripts(_pages(spark, sf_dir)).select("page_id", "code")


@_query("html_comments", "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS comment FROM pages")
def html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_comments(_pages(spark, sf_dir)).select("page_id", "comment")


@_query(
    "html_detect",
    r"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
    b AS (SELECT kind, id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM t)
    SELECT kind, id, regexp_matches(lower(substr(body, 1, 200)), '<!doctype html|<html|<head|<body')
        OR (starts_with(body, '<') AND contains(substr(body, 1, 100), '>') AND
            (len(split_part(body, '>', 1)) - len(replace(split_part(body, '>', 1), '<', '')) = 1 OR contains(lower(split_part(body, '>', 1)), '<script'))) AS is_html
    FROM b""",
)
def html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs).select("kind", "id", C.is_html(F.col("text")).alias("is_html"))


@_query("script_strings", "SELECT page_id, '</p>' AS text FROM pages WHERE contains(html, '<script>var t=\"</p>\"')")
def script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = html.inline_scripts(_pages(spark, sf_dir)).select("page_id", F.col("code").alias("content"))
    return modes.js_strings(code).select("page_id", "text")


@_query(
    "page_urls",
    "WITH v AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS url FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)),"
    " w AS (SELECT page_id, trim(url) AS url, min(i) AS i FROM v WHERE "
    + _sql(_URL_SQL, "trim(url)") + " OR " + _sql(_PATH_SQL, "trim(url)")
    + " GROUP BY ALL) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, url FROM w",
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a page gives: attributes verbatim, comments, scripts."""
    return extract_urls(_pages(spark, sf_dir), "html")


# -- texts ---------------------------------------------------------------------------

_MESSAGE = "|".join(fixed.MESSAGE)
_SPACES = "len(text) - len(replace(text, ' ', ''))"


@_query(
    "prose_filter",
    "WITH t AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents UNION ALL SELECT 'chat', conv_id, turn::BIGINT, text FROM conversations)"
    f" SELECT kind, id, turn, NOT (contains(text, '<') AND contains(text, '>')) AND (({_SPACES} >= 4 AND NOT regexp_matches(text, '^(?:https?://|/|\\./|\\.\\./)'))"
    f" OR contains(text, 'useRoutes()') OR regexp_matches(lower(text), '{_MESSAGE}')) AS is_message, {_sql(_WORDY, 'text')} AS is_wordy FROM t",
)
def prose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    chats = _table(spark, sf_dir, "conversations").select(F.lit("chat").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long"), "text")
    text = F.col("text")
    return docs.unionByName(chats).select("kind", "id", "turn", C.message_urls(text).isNotNull().alias("is_message"), C.wordy(text).alias("is_wordy"))


#: Texts around a name, and whether they are junk.
_JUNK_CASES = (
    ("application/{}", True), ("text/{}", True), ("/{}/users", False), ("https://{}.example.com/x", False), ("http://www.w3.org/{}", True),
    ("{}://", True), ("Europe/{}", True), ("Function.{}", True), ("a.prototype.{}", True), ("/{{{}}}", True), ("$1{}", True), ("{}(", True),
    ("x'{}'y", True), ("/x'{}'y", False), ("a", True), ("//", True), ("FUZZpx", True), ("/FUZZ", True), ("FUZZ/FUZZ", True), ("https://FUZZ/", True),
    ("/yyyy/mm/dd/", True), ("/{{yyyy}}-{{MM}}-{{dd}}", True), ("/hh:mm:ss", True), ("MM/DD/YYYY", True), ("^FUZZ$", True), ("ftp://", True),
    ("action.target.value", True), ("jquery.min.js", False), ("message/rfc822; charset={}", True), ("./", True), ("x.toString", True),
)


@_query(
    "junk_rules",
    "SELECT n_nationkey, i, replace(replace(replace(replace(t, '{}', n_name), '{{', '{'), '}}', '}'), '_', '-') AS text,"
    " junk AS is_junk FROM nation, (VALUES "
    + ", ".join("({}, '{}', {})".format(i, t.replace("'", "''"), str(j).lower()) for i, (t, j) in enumerate(_JUNK_CASES)) + ") v(i, t, junk)",
)
def junk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of junk, around the nations' names."""
    cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_JUNK_CASES)], "i int, t string")
    rows = _table(spark, sf_dir, "nation").crossJoin(F.broadcast(cases))  # a fixed list of some thirty forms
    text = F.replace(F.col("t"), F.lit("{}"), F.col("n_name"))
    for a, b in (("{{", "{"), ("}}", "}"), ("_", "-")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.select("n_nationkey", "i", text.alias("text")).withColumn("is_junk", C.is_junk(F.col("text")))


@_query(
    "route_params",
    "SELECT o_orderkey, '/orders/{id}/' || lower(o_orderstatus) AS routed, '/o/v{KEY}/' || o_orderkey AS bracketed,"
    " 'https://u:p@h/:id/' || o_orderkey AS kept, '/orders/FUZZ/' || lower(o_orderstatus) AS filled FROM orders",
)
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    routed = C.route_template(F.concat(F.lit("/orders/:id/"), F.lower("o_orderstatus")))
    return orders.select(
        "o_orderkey",
        routed.alias("routed"),
        C.route_template(F.concat(F.lit("/o/v[KEY]/"), "o_orderkey")).alias("bracketed"),
        C.route_template(F.concat(F.lit("https://u:p@h/:id/"), "o_orderkey")).alias("kept"),
        C.consolidate(F.regexp_replace(routed, fixed.BRACES, "FUZZFUZZ")).alias("filled"),
    )


@_query(
    "clean_texts",
    "SELECT c_custkey, '/c/' || c_custkey || '(a)' AS cut, '/c/[' || c_custkey AS open, '/c/' || c_custkey AS bare, '/c/' || c_custkey || '/x' AS both FROM customer",
)
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unopened brackets and sentence ends go; unclosed brackets stay."""
    key = F.col("c_custkey").cast("string")
    forms = {"cut": ("(a)]rest)", "/c/"), "open": ("", "/c/["), "bare": (".,..", "/c/"), "both": ("/x.}", "/c/")}
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", *[C.clean(F.concat(F.lit(a), key, F.lit(z))).alias(n) for n, (z, a) in forms.items()]
    )


@_query(
    "filename_ext",
    "SELECT p_partkey, ext, list_contains(['js', 'PNG', 'tar', 'gz'], ext) AS known FROM part, (VALUES ('js'), ('PNG'), ('tar'), ('gz'), ('exe'), ('')) v(ext)",
)
def filename_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.explode(F.array(*[F.lit(e) for e in ("js", "PNG", "tar", "gz", "exe", "")]))
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", exts.alias("ext"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), "ext")
    return rows.select("p_partkey", "ext", C.is_filename(name).alias("known"))


# -- generated programs --------------------------------------------------------------


def _program(*parts: str) -> Column:
    """Code from alternating text and column names (in angle brackets)."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("<") and p.endswith(">") else F.lit(p) for p in parts])


def _generated(name: str, table: str, key: str, parts: tuple[str, ...], urls: list[str], **options) -> None:
    """Register a query over a program per row of a table; ``urls`` are SQL expressions of what it gives, in order."""
    union = " UNION ALL ".join(f"SELECT {key}, {i}::BIGINT AS ord, {u} AS url FROM {table}" for i, u in enumerate(urls))

    @_query(name, union)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return extract_urls(spread(rows.select(key, _program(*parts).alias("content"))), "content", **options)


_generated(
    "js_literals", "supplier", "s_suppkey",
    ('var a = "/api/n', "<s_suppkey>", '/list"; f(\'https://x', "<s_suppkey>", ".example.com/'); var s = \"plain words\"; g(`/tt/", "<s_suppkey>", "/u`);"),
    ["'/api/n' || s_suppkey || '/list'", "'https://x' || s_suppkey || '.example.com/'", "'/tt/' || s_suppkey || '/u'"],
)
_generated(
    "js_concat", "customer", "c_custkey",
    ('const b = "/api/', "<c_mktsegment>", '"; const u = b + "/users"; go(b + "/v" + n);'),
    ["'/api/' || c_mktsegment", "'/api/' || c_mktsegment || '/users'", "'/users'", "'/api/' || c_mktsegment || '/vFUZZ'", "'/api/' || c_mktsegment || '/v'"],
)
_generated(
    "js_template", "part", "p_partkey",
    ('let p = "', "<p_partkey>", '"; p = "z', "<p_partkey>", '"; get(`/parts/${p}/of/${q}`);'),
    ["'/parts/' || p_partkey || '/of/FUZZ'", "'/parts/z' || p_partkey || '/of/FUZZ'"],
)
_generated(
    "js_join", "supplier", "s_suppkey",
    ('var s = ["api", "n', "<s_suppkey>", '", "x"]; get(s.join("/"));'),
    ["'api/n' || s_suppkey || '/x'"],
)
_generated(
    "js_replace", "customer", "c_custkey",
    ('var t = "/user/{uid}/home"; var u = t.replace("{uid}", "', "<c_custkey>", '");'),
    # the pattern itself is a literal like any other
    ["'/user/{uid}/home'", "'/user/' || c_custkey || '/home'"],
)
_generated(
    "js_concat_call", "supplier", "s_suppkey",
    ('var h = "https://s', "<s_suppkey>", '.example.com"; get(h.concat("/v1", "/xx").concat("/yy"));'),
    ["'https://s' || s_suppkey || '.example.com'", "'https://s' || s_suppkey || '.example.com/v1/xx/yy'", "'https://s' || s_suppkey || '.example.com/v1/xx'", "'/v1'", "'/xx'", "'/yy'"],
)
_generated(
    "js_object", "supplier", "s_suppkey",
    ('var c = {base: "/b', "<s_suppkey>", '"}; c.tail = "/t', "<s_suppkey>", '"; go(c.base + c.tail); go(c.none + "/z1");'),
    ["'/b' || s_suppkey", "'/t' || s_suppkey", "'/b' || s_suppkey || '/t' || s_suppkey", "'FUZZ/z1'", "'/z1'"],
)
_generated(
    "js_subscript", "supplier", "s_suppkey",
    ('var c = {"k": "/kk', "<s_suppkey>", '"}; var i = "k"; var u = c["k"] + "/a1"; var w = c[i] + "/b1"; go(`${u}`); go(`${w}`);'),
    ["'/kk' || s_suppkey", "'FUZZ/a1'", "'/a1'", "'FUZZ/b1'", "'/b1'", "'/kk' || s_suppkey || '/a1'", "'/kk' || s_suppkey || '/b1'"],
)
_generated(
    "js_location", "supplier", "s_suppkey",
    ('go(window.location.origin + "/n', "<s_suppkey>", '"); go(location.protocol + "//h', "<s_suppkey>", '.example.com/p");'),
    ["'https://FUZZ/n' || s_suppkey", "'/n' || s_suppkey", "'https://h' || s_suppkey || '.example.com/p'", "'//h' || s_suppkey || '.example.com/p'"],
)
_generated(
    "js_logical", "supplier", "s_suppkey",
    ('var b = x || "/d', "<s_suppkey>", '"; go(b + "/e1");'),
    ["'/d' || s_suppkey", "'/d' || s_suppkey || '/e1'", "'/e1'"],
)
_generated(
    "js_escape", "supplier", "s_suppkey",
    ('go("/e\\x2f', "<s_suppkey>", '\\u002fx?a\\075b");'),
    ["'/e/' || s_suppkey || '/x?a=b'"],
)
_generated(
    "js_comment", "supplier", "s_suppkey",
    ("// see https://c", "<s_suppkey>", ".example.com/doc and /rel/", "<s_suppkey>", '\n/* old: get("/was/', "<s_suppkey>", '") */\nx();'),
    ["'https://c' || s_suppkey || '.example.com/doc'", "'/rel/' || s_suppkey", "'/was/' || s_suppkey"],
)
_CONTEXT = ('const t = "/v', "<s_suppkey>", '"; go(`${t}/users`);')
_generated("ctx_merge", "supplier", "s_suppkey", _CONTEXT, ["'/v' || s_suppkey", "'/api/users'", "'/v' || s_suppkey || '/users'"], context={"t": "/api"})
_generated("ctx_override", "supplier", "s_suppkey", _CONTEXT, ["'/v' || s_suppkey", "'/api/users'"], context={"t": "/api"}, context_policy="override")
_generated("ctx_only", "supplier", "s_suppkey", _CONTEXT, ["'/v' || s_suppkey", "'/api/users'"], context={"t": "/api"}, context_policy="only")
_generated(
    "include_templates", "supplier", "s_suppkey",
    ('go("/n', "<s_suppkey>", '/:id"); go(`/mm/${k}/', "<s_suppkey>", "`);"),
    ["'/n' || s_suppkey || '/{id}'", "'/n' || s_suppkey || '/FUZZ'", "'/mm/{k}/' || s_suppkey", "'/mm/FUZZ/' || s_suppkey"],
    include_templates=True,
)
_generated(
    "skip_symbols", "customer", "c_custkey",
    ('const b = "/api/', "<c_mktsegment>", '"; const u = b + "/users";'),
    ["'/api/' || c_mktsegment", "'FUZZ/users'", "'/users'"],
    skip_symbols=True,
)
_ALIAS = ("function f() { const o = {contentId: t, v: 1}; return get(`/c", "<s_suppkey>", "/${t}`); }")
_generated("alias_names", "supplier", "s_suppkey", _ALIAS, ["'/c' || s_suppkey || '/{contentId}'", "'/c' || s_suppkey || '/FUZZ'"], include_templates=True)
_generated(
    "skip_aliases", "supplier", "s_suppkey", _ALIAS, ["'/c' || s_suppkey || '/{t}'", "'/c' || s_suppkey || '/FUZZ'"], include_templates=True, skip_aliases=True
)
_generated(
    "html_in_js", "supplier", "s_suppkey",
    ("var h = '<a href=\"/h", "<s_suppkey>", '">x</a><img srcset="/s', "<s_suppkey>", ".png 1x, /tt.png 2x\"><script>get(\"/in", "<s_suppkey>", "\")</script>';"),
    ["'/in' || s_suppkey", "'/h' || s_suppkey", "'/s' || s_suppkey || '.png'", "'/tt.png'"],
)
_generated(
    "js_in_html", "supplier", "s_suppkey",
    ('<html><body data-url="/d', "<s_suppkey>", '"><a href="/a', "<s_suppkey>", '.">x</a><script>var b = "/a', "<s_suppkey>", '."; go(b + "/q1")</script></body></html>'),
    # attributes come as they are; what scripts give is cleaned
    ["'/a' || s_suppkey || '.'", "'/d' || s_suppkey", "'/a' || s_suppkey", "'/a' || s_suppkey || './q1'", "'/q1'"],
)
_generated(
    "custom_extensions", "part", "p_partkey",
    ('load("s', "<p_partkey>", '.proto"); load("s', "<p_partkey>", '.foo");'),
    ["'s' || p_partkey || '.proto'"], extensions=".proto, graphql",
)
_generated(
    "js_jsx", "supplier", "s_suppkey",
    ('const a = <Link to="/l', "<s_suppkey>", '">{go("/m', "<s_suppkey>", '")}</Link>;'),
    ["'/l' || s_suppkey", "'/m' || s_suppkey"],
)


@_query(
    "size_gate",
    "SELECT n_nationkey, big, CASE WHEN big THEN 'FUZZ/users' ELSE '/v' || n_nationkey || '/users' END AS url FROM nation, (VALUES (true), (false)) v(big)",
)
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of sources over the size limit, here by lines of over a million characters, stay unresolved."""
    code = F.concat(F.lit('const t = "/v'), F.col("n_nationkey").cast("string"), F.lit('"; go(t + "/users");'))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", code.alias("code"), F.explode(F.array(F.lit(True), F.lit(False))).alias("big"))
    lines = F.when(F.col("big"), F.repeat(F.lit("\n"), F.lit(1_100_000))).otherwise(F.lit("\n"))
    found = extract_urls(spread(rows.select("n_nationkey", "big", F.concat("code", lines).alias("content"))), "content")
    return found.filter(F.col("url").endswith("/users") & (F.col("url") != "/users")).select("n_nationkey", "big", "url")


@_query(
    "entries_dedup",
    "SELECT s_suppkey, 0::BIGINT AS ord, '/p' || s_suppkey AS original, '/p' || s_suppkey AS placeholder, '/p' || s_suppkey AS resolved, false AS has_template FROM supplier"
    " UNION ALL SELECT s_suppkey, 1, '/qq/{x}', '/qq/FUZZ', '/qq/FUZZ', true FROM supplier",
)
def entries_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by first occurrence: repeats of one triple are one."""
    code = _program('a("/p', "<s_suppkey>", '"); b(`/qq/${x}`); a("/p', "<s_suppkey>", '"); b(`/qq/${x}`);')
    return url_entries(_table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("content")))


@_query(
    "tree_dump",
    "WITH l AS (SELECT c_custkey, 12 + len(c_name) AS e FROM customer) "
    + " UNION ALL ".join(
        f"SELECT c_custkey, {i}::BIGINT AS ord, {t} AS line FROM l"
        for i, t in enumerate(
            (
                "'program (0, 0) - (0, ' || (e + 3) || ')'",
                "'  lexical_declaration (0, 0) - (0, ' || (e + 3) || ')'",
                "'    variable_declarator (0, 6) - (0, ' || (e + 2) || ')'",
                "'      name: identifier (0, 6) - (0, 9)'",
                "'      value: string (0, 12) - (0, ' || (e + 2) || ')'",
                "'        string_fragment (0, 13) - (0, ' || (e + 1) || ')'",
            )
        )
    ),
)
def tree_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _program('const key = "', "<c_name>", '";')
    return modes.syntax_tree(_table(spark, sf_dir, "customer").select("c_custkey", code.alias("content")), only_named=True)


@_query(
    "inspect_types",
    "SELECT c_custkey, unnest([0, 1, 2]::BIGINT[]) AS ord, unnest(['f', 'n_' || c_custkey, 'g']) AS text FROM customer",
)
def inspect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _program("f(n_", "<c_custkey>", "); g(n_", "<c_custkey>", ", 'x');")
    return modes.js_inspect(_table(spark, sf_dir, "customer").select("c_custkey", code.alias("content")), types=["identifier"])


@_query(
    "string_lengths",
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS ord, text FROM (SELECT DISTINCT ON (p_partkey, text) p_partkey, i, text FROM"
    " (SELECT p_partkey, 0 AS i, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part) ORDER BY p_partkey, text, i)"
    " WHERE len(text) BETWEEN 6 AND 9",
)
def string_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _program('f("', "<p_name>", "\", '", "<p_brand>", "', '", "<p_type>", "');")
    return modes.js_strings(spread(_table(spark, sf_dir, "part").select("p_partkey", code.alias("content"))), least=6, most=9)


@_query(
    "query_captures",
    "SELECT c_custkey, unnest([0, 1]::BIGINT[]) AS ord, unnest(['fn', 'arg']) AS capture, unnest(['fetch', '/n/' || c_name]) AS text FROM customer",
)
def query_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _program('fetch("/n/', "<c_name>", '"); other(1); fetch(x);')
    pattern = "(call_expression function: (identifier) @fn arguments: (arguments (string) @arg))"
    return modes.js_query(_table(spark, sf_dir, "customer").select("c_custkey", code.alias("content")), pattern, trim=True)


@_query(
    "node_counts",
    "SELECT type, per * n AS n FROM (VALUES ('program', 1), ('expression_statement', 1), ('call_expression', 1), ('identifier', 2), ('arguments', 1), ('string', 1),"
    " ('string_fragment', 1)) v(type, per), (SELECT count(*) AS n FROM customer)",
)
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node relation, aggregated."""
    code = _program("f(a, 'n", "<c_custkey>", "')")
    nodes = modes.js_nodes(_table(spark, sf_dir, "customer").select("c_custkey", code.alias("content")))
    return nodes.filter("named").groupBy("type").agg(F.count("*").alias("n"))


# -- HTML by rows of a table -----------------------------------------------------------

_generated(
    "tag_table", "part", "p_partkey",
    ("<html><body ", *(x for i, (t, a) in enumerate(fixed.TAG_ATTRIBUTES) for x in (f'><{t} {a}="/t{i}/', "<p_partkey>", f'"></{t}')), "></body></html>"),
    [f"'/t{i}/' || p_partkey" for i in range(len(fixed.TAG_ATTRIBUTES))],
)
_generated(
    "data_attrs", "part", "p_partkey",
    ('<html><p data-url="/u', "<p_partkey>", '" data-src="/s', "<p_partkey>", '"></p><b data-href="/h', "<p_partkey>", '" data-none="/no"></b></html>'),
    ["'/u' || p_partkey", "'/s' || p_partkey", "'/h' || p_partkey"],
)
_generated(
    "srcset", "part", "p_partkey",
    ('<html><img srcset="/small', "<p_partkey>", ".png 1x,/large", "<p_partkey>", '.png 2x, "><source srcset="/one', "<p_partkey>", '.webp"></html>'),
    ["'/small' || p_partkey || '.png'", "'/large' || p_partkey || '.png'", "'/one' || p_partkey || '.webp'"],
)
_generated(
    "comment_scan", "part", "p_partkey",
    ("<html><!-- was https://c", "<p_partkey>", '.example.com/doc with href="/old', "<p_partkey>", '" then, /rel/', "<p_partkey>", " --></html>"),
    ["'https://c' || p_partkey || '.example.com/doc'", "'/old' || p_partkey", "'/rel/' || p_partkey"],
)
_generated(
    "skipped_schemes", "part", "p_partkey",
    ('<html><a href="#top"></a><a href="javascript:go()"></a><a href="tel:1"></a><img src="data:x/y"><a href="/kept', "<p_partkey>", '"></a></html>'),
    ["'/kept' || p_partkey"],
)


# -- comments as programs, patterns ------------------------------------------------------


def _read(name: str, parts: tuple[str, ...], sql: str, read: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query that reads a program per part in one of the syntax modes."""

    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spread(_table(spark, sf_dir, "part").select("p_partkey", _program(*parts).alias("content"))))


def _listed(columns: str, rows: list[tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, {i}::BIGINT AS ord, {', '.join(f'{v} AS {c}' for c, v in zip(columns.split(), row, strict=True))} FROM part" for i, row in enumerate(rows))


_COMMENTED = ("go(a1); // see(b", "<p_partkey>", ")\n/* then(c2) */")
_read(
    "tree_comments", _COMMENTED,
    "SELECT p_partkey, unit_id, type, text FROM part, LATERAL (VALUES (1, 'program', 'see(b' || p_partkey || ')'), (1, 'expression_statement', 'see(b' || p_partkey || ')'),"
    " (1, 'call_expression', 'see(b' || p_partkey || ')'), (1, 'identifier', 'see'), (1, 'arguments', '(b' || p_partkey || ')'), (1, 'identifier', 'b' || p_partkey),"
    " (2, 'program', 'then(c2)'), (2, 'expression_statement', 'then(c2)'), (2, 'call_expression', 'then(c2)'), (2, 'identifier', 'then'), (2, 'arguments', '(c2)'),"
    " (2, 'identifier', 'c2')) v(unit_id, type, text)",
    lambda rows: modes.js_nodes(rows, parse_comments=True).filter("named and unit_id > 0").select("p_partkey", "unit_id", "type", F.trim("text").alias("text")),
)
_read(
    "inspect_comments", _COMMENTED, _listed("text", [("'go'",), ("'a1'",), ("'see'",), ("'b' || p_partkey",), ("'then'",), ("'c2'",)]),
    lambda rows: modes.js_inspect(rows, types=["identifier"]),
)
_read(
    "string_comments", ("go('a1'); // see('b", "<p_partkey>", "', 'a1')"), _listed("text", [("'a1'",), ("'b' || p_partkey",)]), lambda rows: modes.js_strings(rows)
)
_CALLS = ('fetch("/p', "<p_partkey>", '"); send(7, "/q"); fetch("/q"); o.fetch(x)')
_read("query_all", _CALLS, _listed("capture text", [("'s'", "'/p' || p_partkey"), ("'s'", "'/q'"), ("'s'", "'/q'")]), lambda rows: modes.js_query(rows, "(string) @s", trim=True))
_read("query_unique", _CALLS, _listed("capture text", [("'s'", "'/p' || p_partkey"), ("'s'", "'/q'")]), lambda rows: modes.js_query(rows, "(string) @s", unique=True, trim=True))
_read(
    "query_alternation", _CALLS, _listed("capture text", [("'v'", "'/p' || p_partkey"), ("'v'", "'7'"), ("'v'", "'/q'"), ("'v'", "'/q'")]),
    lambda rows: modes.js_query(rows, "[(string) (number)] @v", trim=True),
)
_read(
    "query_wildcard", _CALLS, _listed("capture text", [("'f'", "'fetch'"), ("'f'", "'send'"), ("'f'", "'fetch'"), ("'f'", "'o.fetch'")]),
    lambda rows: modes.js_query(rows, "(call_expression function: (_) @f)"),
)
_read(
    "query_predicate", _CALLS, _listed("capture text", [("'f'", "'fetch'"), ("'f'", "'fetch'"), ("'a'", "'(\"/p' || p_partkey || '\")'"), ("'a'", "'(\"/q\")'")]),
    lambda rows: modes.js_query(rows, '((call_expression function: (identifier) @f arguments: (arguments) @a) (#eq? @f "fetch"))'),
)
_read(
    "query_match", _CALLS, _listed("capture text", [("'s'", "'/p' || p_partkey")]),
    lambda rows: modes.js_query(rows, '((string) @s (#match? @s "/p[0-9]+"))', trim=True),
)


_ALIASES = "lower(split_part(p_type, ' ', 1)) || ['Id', '', 'Key', 'Name', 'Tmp'][p_size % 5 + 1]", "['x', 'id', 'title', 'orderBy'][p_size % 4 + 1]"


@_query(
    "best_alias",
    "WITH f AS (SELECT p_brand AS name, p_partkey AS ord, ['low', 'medium', 'high'][p_size % 3 + 1] AS confidence, "
    + f"CASE WHEN p_size % 2 = 0 THEN {_ALIASES[0]} ELSE {_ALIASES[1]} END AS alias FROM part),"
    " u AS (SELECT name, alias, min(ord) AS ord, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE arg_min(confidence, ord) END AS confidence FROM f GROUP BY 1, 2),"
    f" t AS (SELECT *, CASE WHEN lower(alias) IN {fixed.LETTERS} OR regexp_matches(lower(alias), '{'|'.join(fixed.TEMPORARY)}') THEN 3 WHEN lower(alias) IN {fixed.COMMON} THEN 2"
    f" WHEN regexp_matches(lower(alias), '{'|'.join(fixed.COMMON)}') AND len(alias) > 4 THEN 0 ELSE 1 END AS tier FROM u)"
    " SELECT name, alias AS best FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, list_position(['high', 'medium', 'low'], confidence), len(alias), ord) = 1",
)
def best_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling of the names that each brand goes by."""
    size = F.col("p_size")
    word = F.concat(F.lower(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))), F.element_at(F.array(*map(F.lit, ("Id", "", "Key", "Name", "Tmp"))), (size % 5 + 1).cast("int")))
    other = F.element_at(F.array(*map(F.lit, ("x", "id", "title", "orderBy"))), (size % 4 + 1).cast("int"))
    sure = F.element_at(F.array(*map(F.lit, fixed.CONFIDENCE)), (size % 3 + 1).cast("int"))
    found = _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("name"), F.when(size % 2 == 0, word).otherwise(other).alias("alias"), sure.alias("confidence"), F.col("p_partkey").alias("ord")
    )
    return aliases.best_aliases(aliases.alias_table(found))


@_query("node_type_catalogue", "SELECT ord, type FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(fixed.NODE_TYPES)) + ") v(ord, type)")
def node_type_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.node_types(spark)
