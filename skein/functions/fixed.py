"""Lists and patterns that results depend on."""

# --- file names ---------------------------------------------------------------

FILE_EXTENSIONS = (
    "apng", "asp", "aspx", "atom", "avif", "bmp", "cgi", "css", "csv", "eot", "gif", "gz", "htm", "html", "ico",
    "ics", "jpeg", "jpg", "js", "json", "json5", "jsonld", "jsx", "less", "map", "md", "mjs", "mp3", "mp4", "oga",
    "ogg", "ogv", "otf", "pdf", "php", "png", "rss", "sass", "scss", "shtml", "svg", "svgz", "tar", "ts", "tsv",
    "tsx", "ttf", "txt", "wav", "wasm", "webm", "webmanifest", "webp", "woff", "woff2", "xhtml", "xml", "xsl",
    "xslt", "yaml", "yml", "zip",
)

# --- MIME types -----------------------------------------------------------------

#: Top-level types whose texts are never paths.
MIME_PREFIXES = ("application", "text", "image", "audio", "video", "font", "multipart")
#: Types registered under other top-level names.  The registry's full list isn't at hand; these are of public knowledge.
MIME_OTHERS = (
    "message/http", "message/imdn+xml", "message/partial", "message/rfc822", "message/sip",
    "message/global", "message/external-body", "message/delivery-status", "model/gltf+json", "model/gltf-binary",
    "model/iges", "model/mesh", "model/obj", "model/stl", "model/step", "model/vrml", "model/x3d+xml", "model/3mf",
    "model/mtl", "model/u3d", "haptics/ivs", "haptics/hjif", "haptics/hmpg", "example/example",
)

# --- prose ----------------------------------------------------------------------

#: Phrases that no address holds.
NO_ADDRESS = (
    "has been", "must be", "called on", "this means", "please change", "will never", "in favor of", "for the full",
    "deprecated",
)
#: Phrases that mark a message for people.
MESSAGE = (
    "has been deprecated", "must be one of", "called on incompatible", "please change", "this means",
    "will never render", "in favor of", "for the full message", "minified", "invariant", "warning:", "error:",
)

# --- junk -------------------------------------------------------------------------

JUNK = (
    "http://", "https://", "//", "https:", "http:", "http://localhost", "http://a", "http://test/path", "./", "/?", "/", "#",
)
JUNK_PREFIX = "http://www.w3.org/"
CSS_UNITS = (
    "px", "em", "rem", "%", "vh", "vw", "vmin", "vmax", "ch", "ex", "pt", "pc", "in", "cm", "mm", "deg", "rad", "turn", "s", "ms",
)
TIMEZONE_AREAS = (
    "Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc", "US",
    "Canada", "Mexico", "Brazil", "Chile",
)
JS_GLOBALS = (
    "Function", "Object", "Array", "String", "Number", "Boolean", "Symbol", "Map", "Set", "WeakMap", "WeakSet", "Promise",
    "Proxy", "Reflect", "moment", "Immutable", "Redux", "React", "Vue", "Angular",
)
JS_METHODS = ("bind", "call", "apply", "toString", "valueOf")

# --- names of parameters ------------------------------------------------------------

#: Parts of names that stand for anything, such names of one letter, and names that tell little by themselves.
TEMPORARY = ("temp", "tmp", "val", "test", "dummy", "placeholder")
LETTERS = ("x", "y", "z", "i", "j", "k", "n", "a", "b", "c", "d", "e")
COMMON = ("id", "key", "name", "title", "value", "data", "item", "type")
CONFIDENCE = ("low", "medium", "high")

# --- HTML ---------------------------------------------------------------------------

#: Tags and their attributes that hold addresses, in the order in which they are read.
TAG_ATTRIBUTES = (
    ("a", "href"), ("link", "href"), ("base", "href"), ("area", "href"),
    ("img", "src"), ("img", "srcset"), ("img", "data-src"),
    ("script", "src"), ("script", "data-src"), ("form", "action"), ("button", "formaction"),
    ("iframe", "src"), ("iframe", "data-src"), ("video", "src"), ("video", "poster"), ("video", "data-src"),
    ("audio", "src"), ("audio", "data-src"), ("source", "src"), ("source", "srcset"),
    ("track", "src"), ("embed", "src"), ("input", "src"), ("object", "data"), ("object", "codebase"),
    ("blockquote", "cite"), ("q", "cite"), ("ins", "cite"), ("del", "cite"), ("use", "href"), ("use", "xlink:href"),
)
DATA_ATTRIBUTES = ("data-url", "data-href", "data-src")
SKIPPED_SCHEMES = ("#", "javascript:", "data:", "tel:")

# --- names of syntax nodes -------------------------------------------------------------

NODE_TYPES = (
    "arguments", "array", "array_pattern", "arrow_function", "as", "assignment_expression", "assignment_pattern",
    "async", "augmented_assignment_expression", "await", "await_expression", "binary_expression", "break",
    "break_statement", "call_expression", "case", "catch", "catch_clause", "class", "class_body",
    "class_declaration", "class_heritage", "class_static_block", "comment", "computed_property_name", "const",
    "continue", "continue_statement", "debugger", "debugger_statement", "declaration", "decorator", "default",
    "delete", "do", "do_statement", "else", "else_clause", "empty_statement", "escape_sequence", "export",
    "export_clause", "export_specifier", "export_statement", "expression", "expression_statement", "extends",
    "false", "field_definition", "finally", "finally_clause", "for", "for_in_statement", "for_statement",
    "formal_parameters", "from", "function", "function_declaration", "generator_function",
    "generator_function_declaration", "get", "glimmer_closing_tag", "glimmer_opening_tag", "glimmer_template",
    "hash_bang_line", "identifier", "if", "if_statement", "import", "import_clause", "import_specifier",
    "import_statement", "in", "instanceof", "jsx_attribute", "jsx_closing_element", "jsx_element", "jsx_expression",
    "jsx_namespace_name", "jsx_opening_element", "jsx_self_closing_element", "jsx_text", "labeled_statement", "let",
    "lexical_declaration", "member_expression", "meta_property", "method_definition", "named_imports",
    "namespace_export", "namespace_import", "new", "new_expression", "null", "number", "object",
    "object_assignment_pattern", "object_pattern", "of", "optional_chain", "pair", "pair_pattern",
    "parenthesized_expression", "pattern", "primary_expression", "private_property_identifier", "program",
    "property_identifier", "regex", "regex_flags", "regex_pattern", "rest_pattern", "return", "return_statement",
    "sequence_expression", "set", "shorthand_property_identifier", "shorthand_property_identifier_pattern",
    "spread_element", "statement", "statement_block", "statement_identifier", "static", "static get", "string",
    "string_fragment", "subscript_expression", "super", "switch", "switch_body", "switch_case", "switch_default",
    "switch_statement", "target", "template_string", "template_substitution", "ternary_expression", "this", "throw",
    "throw_statement", "true", "try", "try_statement", "typeof", "unary_expression", "undefined",
    "update_expression", "var", "variable_declaration", "variable_declarator", "void", "while", "while_statement",
    "with", "with_statement", "yield", "yield_expression",
)
#: Types that the parser gives besides the catalogue's, for queries.
MORE_NODE_TYPES = ("ERROR", "function_expression", "import_attribute")

# --- patterns, the same in Python and Java ------------------------------------------------

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
HOST_PREFIX = r"^(?i:www\.|api\.|cdn\.)"
IPV4 = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]+)?(/|$)"
THREE_LABELS = r"^[a-zA-Z0-9-]+\.[a-zA-Z0-9-]+\.[a-zA-Z]{2,}"
LABELS_SLASH = r"^[a-zA-Z0-9-]+\.[a-zA-Z0-9-]+/"
SLASH_WORD = r"^/[a-zA-Z0-9_-]{2,}"
DOT_SLASH = r"^\.\.?/"
WORD_SLASH = r"^[a-zA-Z][a-zA-Z0-9_-]*/[a-zA-Z0-9]"
QUERY_NOISE = r"[ ;:,!@#$%^&*()+=\[\]{}'\"]"
QUERY_HOST = r"^[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"
QUERY_WORD = r"^[a-zA-Z0-9_-]{2,}$"
PROSE_URL = r"https?://[^\s<>\"'{}|\\^`\[\])]+"
EMBEDDED_URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
COMMENT_PATH = r"(?:^|[\s,;])((?:/[a-zA-Z0-9_\-./{}:]+)|(?:\./[a-zA-Z0-9_\-./]+)|(?:\.\./[a-zA-Z0-9_\-./]+))"
CREDENTIALS = r"://[^/]*@"
ROUTE_PARAM = r"/:([a-zA-Z_][a-zA-Z0-9_]*)"
BRACKET_PARAM = r"\[([a-zA-Z_][a-zA-Z0-9_]*)\]"
BRACES = r"\{[^}]+\}"
BARE_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://?$"
PROPERTY_PATH = r"(?i)^[a-z]+\.[a-z]+\.[a-z.]+$"
ONE_PARAM = r"^/\{[^}]+\}$"
BACKREFERENCE = r"\$[0-9]"


def _stamp(*parts: str) -> str:
    """A date or time of format letters, each bare or in braces."""
    return "".join(p if p in ("[/-]", ":") else f"(?:{p}|\\{{(?:{p})\\}})" for p in parts)


_YEAR, _MONTH, _DAY = "yyyy|yy", "mm|m", "dd|d"
_DATES = (
    _stamp(_YEAR, "[/-]", _MONTH, "[/-]", _DAY), _stamp(_DAY, "[/-]", _MONTH, "[/-]", _YEAR), _stamp(_MONTH, "[/-]", _DAY, "[/-]", _YEAR)
)
DATE_FORMAT = f"(?i)^/+(?:{'|'.join(_DATES)}|{_stamp('hh|h', ':', 'mm|m')}(?::{_stamp('ss|s')})?)/?$"
BARE_DATE = "(?i)^(?:{0})[/-](?:{0})[/-](?:{0})$".format("yyyy|yy|mm|m|dd|d")
ZONE = rf"^(?:{'|'.join(TIMEZONE_AREAS)})/[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)?(?:\|.+)?$"
API = rf"^(?:{'|'.join(JS_GLOBALS)})\.|\.prototype\.|\.(?:{'|'.join(JS_METHODS)})\s*$"
OPEN_END = r"['\"(]\s*$"
QUOTE_START = r"^(?:https?://|/|\./|\.\./|\{)"
