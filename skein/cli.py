"""Command line: python -m skein.cli MODE PATH... [options]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from . import __version__
from .sources.context import parse_context


EXAMPLES = """examples:
  python -m skein.cli urls bundle.js
  python -m skein.cli urls --input sources/ --include-templates --context API=/v2
  python -m skein.cli strings bundle.js --min 5
  python -m skein.cli tree bundle.js --only-named
  python -m skein.cli inspect bundle.js --types identifier string
  python -m skein.cli query bundle.js --query '(string) @s' --trim
  cat bundle.js | python -m skein.cli urls"""


class _Help(argparse.ArgumentDefaultsHelpFormatter, argparse.RawDescriptionHelpFormatter):
    """Defaults beside the options, the examples as they stand."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        """Errors end with status 1 and the help."""
        print(f"error: {message}", file=sys.stderr)
        self.print_help(sys.stderr)
        sys.exit(1)


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = _Parser(prog="skein", description="URLs, strings and syntax of JavaScript and HTML sources", epilog=EXAMPLES, formatter_class=_Help)
    parser.add_argument("-v", "--version", action="version", version=__version__)
    modes = parser.add_subparsers(dest="mode", required=True, parser_class=_Parser)

    def mode(name: str, text: str) -> argparse.ArgumentParser:
        one = modes.add_parser(name, help=text, description=text, epilog=EXAMPLES, formatter_class=_Help)
        one.add_argument("file", nargs="*", help="files or folders; standard input if none is given")
        one.add_argument("--input", help="a file or folder, in place of the positional ones")
        one.add_argument("--output", help="a folder for the result (default: stdout)")
        return one

    urls = mode("urls", "URLs, paths and file names")
    urls.add_argument("--placeholder", default="FUZZ", help="stands for what isn't known")
    urls.add_argument("--include-templates", action="store_true")
    urls.add_argument("--verbose", action="store_true", help="print candidates in place of the final list")
    urls.add_argument("--max-nodes", type=int, default=1_000_000, help="syntax nodes read per pass")
    urls.add_argument("--max-file-size", type=float, default=1.0, help="MB up to which variables are resolved")
    urls.add_argument("--html-parser", default="lxml", help="accepted; there is one reader")
    urls.add_argument("--skip-symbols", action="store_true")
    urls.add_argument("--skip-aliases", action="store_true")
    urls.add_argument("--context", help="values of names: a JSON file, a JSON object or KEY=VALUE pairs")
    urls.add_argument("--context-policy", default="merge", help="merge, override or only")
    urls.add_argument("--extensions")
    tree = mode("tree", "syntax tree")
    tree.add_argument("--indent", type=int, default=2)
    tree.add_argument("--only-named", action="store_true")
    tree.add_argument("--include-text", action="store_true")
    tree.add_argument("--parse-comments", action="store_true")
    strings = mode("strings", "string literals")
    strings.add_argument("--min", type=int)
    strings.add_argument("--max", type=int)
    strings.add_argument("--include-error", action="store_true")
    inspect = mode("inspect", "texts of syntax nodes")
    inspect.add_argument("--get-types", action="store_true")
    inspect.add_argument("--types", nargs="+")
    query = mode("query", "captures of a pattern")
    query.add_argument("--query", required=True)
    query.add_argument("--unique", action="store_true")
    query.add_argument("--trim", action="store_true")

    args = parser.parse_args(given)
    if args.file and args.input:
        parser.error("positional files and --input exclude each other")
    if args.mode == "query" and not args.query.strip():
        parser.error("the query cannot be empty")
    if args.mode == "strings":
        if (args.min is not None and args.min < 1) or (args.max is not None and args.max < 1):
            parser.error("lengths have to be positive")
        if args.min is not None and args.max is not None and args.min >= args.max:
            parser.error("--min has to be below --max")
    if args.mode == "urls":
        try:
            args.context = parse_context(args.context) if args.context is not None else {}
            from .plans.options import UrlOptions

            args.options = UrlOptions(
                args.placeholder, args.include_templates, args.max_nodes, args.max_file_size, args.html_parser,
                args.skip_symbols, args.skip_aliases, args.context, args.context_policy, args.extensions,
            )
        except ValueError as e:
            parser.error(str(e))
    return args


def main(given: Sequence[str] | None = None) -> int:
    args = arguments(given)
    from pyspark.sql import SparkSession

    from .functions.fixed import NODE_TYPES
    from .operators import modes
    from .operators.urls import extract_urls, url_entries
    from .sources.files import read_sources, write_lines

    if args.mode == "inspect" and args.get_types:
        print("\n".join(NODE_TYPES))
        return 0
    paths = args.file or ([args.input] if args.input else [])
    if not paths and sys.stdin.isatty():
        print("error: no input", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    if paths:
        sources = read_sources(spark, paths)
        if sources.filter("content is null").limit(1).count():
            print("error: a file isn't UTF-8", file=sys.stderr)
            return 1
        sources = sources.filter("valid").select("source_id", "content")
    else:
        text = sys.stdin.read()
        if not text.strip():
            return 1
        sources = spark.createDataFrame([(0, text)], "source_id long, content string")
    if args.mode == "urls":
        made = url_entries(sources, options=args.options) if args.verbose else extract_urls(sources, options=args.options)
        value = "placeholder" if args.verbose else "url"
    elif args.mode == "tree":
        made, value = modes.syntax_tree(sources, "content", args.indent, args.only_named, args.include_text, args.parse_comments), "line"
    elif args.mode == "strings":
        made, value = modes.js_strings(sources, "content", args.min, args.max, args.include_error), "text"
    elif args.mode == "inspect":
        made, value = modes.js_inspect(sources, "content", args.types), "text"
    else:
        try:
            made, value = modes.js_query(sources, args.query, "content", args.unique, args.trim), "text"
        except ValueError as e:
            print(f"error: {e}")
            return 0
    if args.output:
        write_lines(made, args.output, value)
    else:
        rows = [r[0] for r in made.orderBy("source_id", "ord").select(value).toLocalIterator()]
        print("\n".join(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
