"""What SQL can say of the scans: matches of the fixed patterns, their counts and digests."""

from __future__ import annotations

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
)

_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
#: From the right every second digit doubled, digits of the products added up.
_LUHN = (
    f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT"
    f" ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{_DIGITS}[-i]::INT + 1] END)) % 10 = 0"
)
_BYTES = "len(list_filter(string_split(t, '.'), lambda x: ltrim(x, '0') <> '' AND (len(ltrim(x, '0')) > 3 OR ltrim(x, '0')[1:3]::INT > 255))) = 0"

PERSONAL = {
    "email": (_EMAIL, "true"),
    "ip": (_IP, _BYTES),
    "card": (_CARD, f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (_PHONE, f"len({_DIGITS}) BETWEEN 9 AND 15"),
}
SECRET = {
    "assign": (_ASSIGN, r"""len(regexp_extract(t, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"""),
    "access": ("AKIA[A-Z0-9]+", "len(t) >= 18"),
    "hex": ("[0-9a-f]+", "len(t) >= 16"),
}


def scan_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Counts and digest by document.

    A text with its matches marked is cut at the marks; where a match begins is
    told by the sizes of the parts before it.
    """
    found = " UNION ALL ".join(
        f"""SELECT row, '{kind}' AS kind, {place} AS place, s, s + len(t) AS e FROM (
            SELECT row, i, split_part(piece, chr(2), 1) AS t,
                   (sum(len(replace(piece, chr(2), ''))) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS s
            FROM (SELECT row, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM (
                SELECT row, string_split(regexp_replace(body, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS l FROM d)))
            WHERE i > 1 AND {test}"""
        for place, (kind, (pattern, test)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(kind) FILTER (kind = '{kind}') AS n_{kind}" for kind in kinds)
    shown = f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}), '')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents), f AS ({found})
        SELECT doc_id, {counts}, sha256({shown}) AS base_sha256 FROM d LEFT JOIN f USING (row) GROUP BY row, doc_id"""
