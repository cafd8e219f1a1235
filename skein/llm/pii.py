"""Personal data: fixed patterns, and contextual extraction bootstrapped from them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, run_tables, text_of
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does: from within the run it would fail or end alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_CONTEXT = re.compile(r"\w+|[^\w\s]")

#: Numbers written in groups: digits joined by single blanks, hyphens, full stops and brackets.
_NUMBER = re.compile(r"(?<![\w@%])\+?\(?[0-9](?:(?:[\x20.-]|[\x20.-]?\(|\)[\x20.-]?\(?)?[0-9])*(?![\w@%])", re.ASCII)

#: Identifiers that contexts may discover have this many characters or more.  Contexts are
#: looked for within this many characters on either side, further where these hold too few words.
TOKEN_SIZE, CONTEXT_CHARS = 6, 80
#: Longer identifiers and context words are told apart by their digest.
KEY_CHARS = 64


def _emails(text: str) -> Iterator[Span]:
    """Around each @: what a leftmost search of the whole pattern finds, in linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind as listed, then start."""
    out = list(_emails(text))
    if _HINT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """Seeds (``base``) and unlabelled identifiers: ``kind, start, end, token, patterns``.

    An unlabelled identifier is a run of the characters that e-mail addresses are
    made of, with a digit or @ in it and outside every base span, less the full
    stops and hyphens around it; or a number written in groups, as far as base
    spans leave it.  Groups that are a run by themselves are candidates too.
    """
    found: list[tuple[str | None, int, int]] = list(base)
    spans = sorted((s, e) for _, s, e in base)
    done, at = 0, 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (text[start - 1] in _LOCAL or text[start - 1] == "@"):
            start -= 1
        done = m.end()
        while done < len(text) and (text[done] in _LOCAL or text[done] == "@"):
            done += 1
        core = text[start:done].strip(".-_%+")
        if len(core) < TOKEN_SIZE:
            continue
        start += text[start:done].index(core)
        end = start + len(core)
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if at == len(spans) or spans[at][0] >= end:
            found.append((None, start, end))
    runs, at = {(s, e) for _, s, e in found}, 0
    for first, last in [*spans, (len(text), len(text))]:
        for m in _NUMBER.finditer(text, at, max(at, first)):
            if m.end() - m.start() >= TOKEN_SIZE and m.span() not in runs:
                found.append((None, *m.span()))
        at = max(at, last)
    return [(kind, s, e, _key(text[s:e].lower()), _patterns(text, s, e)) for kind, s, e in found]


def _key(token: str) -> str:
    return token if len(token) <= KEY_CHARS else "#" + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def _near(text: str, at: int, way: int, n: int) -> list[str]:
    """The ``n`` words and signs before (``way`` -1) or after a place, whole however long they are."""
    size = CONTEXT_CHARS
    while True:
        part = text[max(0, at - size) : at] if way < 0 else text[at : at + size]
        found = _CONTEXT.findall(part.lower())
        if len(found) > n or len(part) < size:
            return found[-n:] if way < 0 else found[:n]
        size *= 4


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical contexts that an identifier stands in: what precedes it, nearly and further, and what is around it."""
    left, right = _near(text, start, -1, 3), _near(text, end, 1, 1)
    left = ["^"] * (3 - len(left)) + [_key(x) for x in left]
    right = [_key(x) for x in right] or ["$"]
    return [f"{left[1]} {left[2]} _", f"{' '.join(left)} _", f"{left[2]} _ {right[0]}"]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            base = base_spans(text)
            found = [dict(zip(("kind", "start", "end", "token", "patterns"), c, strict=True)) for c in candidates(text, base)]
            rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), digest(base), joined(base), found))
        out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"])
        out.insert(0, "doc_id", pdf["doc_id"].array)
        yield out


def _learn(found: DataFrame, rounds: int, support: int, trust: float, accept: float) -> DataFrame:
    """Bootstrapping on the pattern-instance graph: ``token, kind`` of what is discovered.

    A pattern's score for a kind is the sum of its instances' scores over their
    number plus one: distinct instances count, so copies of a document add
    nothing.  An instance's score is the noisy-or of its trusted patterns'
    scores; seeds have 1 for their kind and keep it.  Instances of a score of
    ``accept`` support a pattern as seeds do.  Scores never fall from round to
    round, so rounds go on while they discover something new, ``rounds`` at least.
    """
    with run_tables() as tables:
        edges = (
            found.select("token", "kind", F.explode("patterns").alias("pattern"))
            .groupBy("pattern", "token")
            .agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"seed_{k}") for k in KINDS])
        )
        seeds = found.groupBy("token").agg(*[F.coalesce(F.max((F.col("kind") == k).cast("double")), F.lit(0.0)).alias(f"seed_{k}") for k in KINDS])
        edges = materialise(edges.select("pattern", "token").join(seeds, "token"), "pii-edges")
        is_seed = F.greatest(*[F.col(f"seed_{k}") for k in KINDS]) > 0
        accepted = F.greatest(*[F.col(f"conf_{k}") for k in KINDS]) >= accept
        scores, known, new, done = None, 0, 0, 0
        while done < rounds or new:
            now = edges if scores is None else edges.join(scores, "token", "left")
            conf = {k: F.col(f"seed_{k}") if scores is None else F.when(is_seed, F.col(f"seed_{k}")).otherwise(F.coalesce(f"conf_{k}", F.lit(0.0))) for k in KINDS}
            ranked = now.groupBy("pattern").agg(
                F.count("*").alias("n"),
                F.count_if(is_seed if scores is None else is_seed | F.coalesce(accepted, F.lit(False))).alias("known"),
                *[F.sum(conf[k]).alias(f"sum_{k}") for k in KINDS],
            )
            ranked = ranked.filter(F.col("known") >= support).select(
                "pattern", *[(F.col(f"sum_{k}") / (F.col("n") + 1)).alias(f"pat_{k}") for k in KINDS]
            )
            ranked = materialise(ranked.filter(F.greatest(*[F.col(f"pat_{k}") for k in KINDS]) >= trust), "pii-patterns")
            miss = {k: F.when(F.col(f"pat_{k}") >= trust, F.log1p(-F.least(f"pat_{k}", F.lit(0.999)))).otherwise(F.lit(0.0)) for k in KINDS}
            scores = (
                edges.filter(~is_seed)
                .join(ranked, "pattern")
                .groupBy("token")
                .agg(*[(1 - F.exp(F.sum(miss[k]))).alias(f"conf_{k}") for k in KINDS])
            )
            scores = materialise(scores, "pii-scores")
            now_known = scores.filter(accepted).count()
            known, new, done = now_known, now_known - known, done + 1
        release(found.sparkSession, tables, keep=1)  # all but the last scores
    best = F.array_max(F.array(*[F.struct(F.col(f"conf_{k}").alias("conf"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    return scores.select("token", best.alias("best")).filter(F.col("best.conf") >= accept).select("token", "best.kind")


def _scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``uid``, counts, digest, base spans and candidates of every row."""
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {counts}, base_sha256 string, base string, found array<struct<kind: string, start: int, end: int, token: string, patterns: array<string>>>"
    return materialise(rows.mapInPandas(_scan, schema).withColumn("uid", F.monotonically_increasing_id()), "pii-base")


def masked_recall(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 5, rounds: int = 3, support: int = 5, trust: float = 0.7, accept: float = 0.9
) -> DataFrame:
    """How many seeds the contexts find again: ``kind, n, found``.

    One in ``every`` of the fixed patterns' identifiers is taken for unlabelled,
    everywhere; ``found`` of these ``n`` are discovered as of their kind.
    """
    found = _scanned(docs, text, doc_id).select(F.explode("found").alias("f")).select("f.*")
    hidden = F.pmod(F.xxhash64("token"), F.lit(every)) == 0
    learnt = _learn(found.withColumn("kind", F.when(~hidden, F.col("kind"))), rounds, support, trust, accept)
    asked = found.filter(hidden & F.col("kind").isNotNull()).select("token", "kind").distinct()
    met = asked.join(learnt.select("token", F.col("kind").alias("got")), "token", "left")
    return met.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == F.col("got")).alias("found"))


def scan_pii(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    rounds: int = 3,
    support: int = 5,
    trust: float = 0.7,
    accept: float = 0.9,
) -> DataFrame:
    """Personal data in every whole text, one row per input row.

    ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered``:
    counts and digest of the fixed patterns' spans, and all spans.  The fixed
    patterns' matches are the seeds.  Over ``rounds`` and on until a round
    discovers nothing new, words before and around them become patterns, each
    scored by how many of the different identifiers that stand there are known
    ones of a kind; a pattern counts with ``support`` seeds or discovered
    identifiers and a score of ``trust``, and identifiers whose patterns together
    reach ``accept`` are discovered, as of that kind.  Identifiers are runs of
    e-mail characters and numbers in groups, of six characters or more.  They add
    spans wherever they stand (where one lies in another, the outer one), and
    base spans stay.  The graph is joined and aggregated in
    Spark; pattern and instance tables are as large as the corpus makes them.

    Null texts count as empty: no spans, the digest of the empty text.  Rows that
    repeat are reported each; an empty table gives no rows.
    """
    base = _scanned(docs, text, doc_id)
    found = base.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    learnt = _learn(found, rounds, support, trust, accept)
    new = found.filter("kind is null").drop("kind", "patterns").join(learnt, "token")
    # of identifiers discovered within each other, the outer ones
    outer = Window.partitionBy("uid").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reached", F.max("end").over(outer)).filter("reached is null or end > reached")
    new = new.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    old = F.expr("transform(filter(found, f -> f.kind is not null), f -> named_struct('kind', f.kind, 'start', f.start, 'end', f.end))")
    out = base.withColumn("old", old).drop("found").join(new, "uid", "left")
    whole = "concat(old, coalesce(new, cast(array() as array<struct<kind: string, start: int, end: int>>)))"
    case = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    ordered = f"array_sort(transform({whole}, s -> named_struct('place', {case}, 'start', s.start, 'end', s.end, 'kind', s.kind)))"
    spans = F.expr(f"array_join(transform({ordered}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_discovered"),
    )
