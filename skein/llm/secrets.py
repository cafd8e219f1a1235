"""Secrets: fixed patterns, and a character convolutional network over further candidates."""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import Span, digest, joined

KINDS = ("assign", "access", "hex")
#: The kind of spans that only the network finds.
MODEL_KIND = "model"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates: runs of the characters of keys, of this length or longer, with a letter and a digit; and
#: runs without a digit of this length or longer, as random keys may be, with three letters of each case.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_LETTERS_ONLY = 20

#: What the network sees: characters of the candidate between stretches of context.
LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
#: Windows over longer candidates start this far apart, and at such parts of a path or value.
STEP = BODY // 2
_PART = re.compile(r"(?<=[/=.])[^/=.]{12,}")
#: Windows scored at a time.
PORTION = 8192
_ALPHABET = string.ascii_letters + string.digits + " \n\"'`:=+/_.-@#$%&*()[]{}<>,;!?|\\~^"
_CODES = np.full(0x110000, len(_ALPHABET) + 1, dtype=np.uint8)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)
_SYMBOLS = len(_ALPHABET) + 2


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _key_like(run: str) -> bool:
    if len(run) < 12 or not any(map(str.isalpha, run)):
        return False
    return any(map(str.isdigit, run)) or (len(run) >= _LETTERS_ONLY and sum(map(str.isupper, run)) >= 3 <= sum(map(str.islower, run)))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs outside every base span; of a run that base spans lie in, the parts around them."""
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        parts, i = [], at
        while i < len(taken) and taken[i][0] < end:
            parts.append((start, taken[i][0]))
            start = taken[i][1]
            i += 1
        for s, e in [*parts, (start, end)]:
            run = text[s:e].strip(".-=") if s < e else ""
            if _key_like(run):
                s += text[s:e].index(run)
                out.append((s, s + len(run)))
    return out


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of up to ``BODY`` characters that cover a candidate and overlap by half."""
    if end - start <= BODY:
        return [(start, end)]
    at = {*range(start, end - BODY, STEP), end - BODY}
    at.update(m.start() for m in _PART.finditer(text, start, end))
    return [(s, min(end, s + BODY)) for s in sorted(at)]


def encode(findings: list[tuple[str, str, str]]) -> np.ndarray:
    """(context before, candidate, context after) as rows of character codes, padded with 0."""
    out = np.zeros((len(findings), WIDTH), dtype=np.uint8)
    for i, (left, body, right) in enumerate(findings):
        for part, at, size, end in ((left[-LEFT:], 0, LEFT, True), (body[:BODY], LEFT, BODY, False), (right[:RIGHT], LEFT + BODY, RIGHT, False)):
            codes = _CODES[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            first = at + size - len(codes) if end else at
            out[i, first : first + len(codes)] = codes
    return out


class CharConvNet:
    """Embedding, one convolution, maximum over positions by zone, a logistic output; all numpy.

    The maxima of the context and of the candidate are kept apart, so that the
    word before an equals sign and the characters of a key weigh separately.
    """

    ZONES = ((0, LEFT), (LEFT, WIDTH))

    def __init__(self, filters: int = 24, size: int = 5, depth: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = size
        self.p = {
            "embed": rng.normal(0, 0.3, (_SYMBOLS, depth)),
            "conv": rng.normal(0, (2 / (size * depth)) ** 0.5, (size * depth, filters)),
            "bias": np.zeros(filters),
            "out": rng.normal(0, 0.2, filters * len(self.ZONES)),
            "off": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        #: Share of secrets found, and of others reported, among findings that neither fit nor threshold has seen.
        self.recall = self.false_alarms = float("nan")

    def _forward(self, codes: np.ndarray):
        x = self.p["embed"][codes] * (codes > 0)[..., None]
        n = WIDTH - self.size + 1
        cols = np.concatenate([x[:, i : i + n] for i in range(self.size)], axis=2)
        act = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        tops, where = [], []
        for a, b in self.ZONES:
            part = act[:, a : min(b, n)]
            at = part.argmax(axis=1)
            tops.append(np.take_along_axis(part, at[:, None], axis=1)[:, 0])
            where.append(at + a)
        pooled = np.concatenate(tops, axis=1)
        return cols, where, pooled, pooled @ self.p["out"] + self.p["off"]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 1024])[3] for i in range(0, len(codes), 1024)] or [np.zeros(0)])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(codes) + self.shift)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
                c, y = codes[rows], labels[rows]
                cols, where, pooled, z = self._forward(c)
                dz = (1 / (1 + np.exp(-z)) - y) / len(rows)
                grad = {"out": pooled.T @ dz, "off": dz.sum(keepdims=True)}
                dpool = dz[:, None] * self.p["out"] * (pooled > 0)
                f = len(self.p["bias"])
                dconv, dbias, dembed = np.zeros_like(self.p["conv"]), np.zeros(f), np.zeros_like(self.p["embed"])
                for zone, at in enumerate(where):
                    d = dpool[:, zone * f : (zone + 1) * f]
                    picked = np.take_along_axis(cols, at[:, :, None], axis=1)
                    dconv += np.einsum("nfk,nf->kf", picked, d)
                    dbias += d.sum(axis=0)
                    back = (d[:, :, None] * self.p["conv"].T[None]).reshape(len(rows), f, self.size, -1)
                    at_codes = c[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(self.size)]
                    np.add.at(dembed, at_codes, back * (at_codes > 0)[..., None])
                grad |= {"conv": dconv, "bias": dbias, "embed": dembed}
                step += 1
                for k, g in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
        """Platt scaling on findings not trained on, then the highest threshold that keeps ``recall``."""
        z = self.logits(codes)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps on the two parameters, with a little shrinkage
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p)
            g = np.array([((p - labels) * z).sum() + 0.01 * (a - 1), (p - labels).sum() + 0.01 * b])
            h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
            a, b = np.array([a, b]) - np.linalg.solve(h + 1e-6 * np.eye(2), g)
        self.scale, self.shift = float(a), float(b)
        found = np.sort(self.probability(codes)[labels == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 1.0


#: Words around findings, secret and other.  Fixed values.
_SECRET_NAMES = (
    "secret_key", "client_secret", "access_token", "auth", "Authorization: Bearer", "Authorization: Basic", "private key", "credentials",
    "api key is", "AWS_SECRET", "pwd", "db_pwd", "passphrase", "PASS", "signing_key", "webhook secret", "x-api-key", "AccountKey", "login with",
)
_OTHER_NAMES = (
    "file", "id", "version", "see", "path", "order", "class", "sku", "release", "image", "module", "checksum of part", "ref", "section",
    "isbn", "model", "commit", "etag", "build", "integrity", "session of", "request id", "boundary", "trace", "doi", "title", "user", "page",
)
_WORDS = (
    "report", "image", "config", "index", "module", "release", "section", "table", "update", "main", "test", "user", "page", "chapter", "invoice",
    "backup", "summer", "winter", "dragon", "monkey", "welcome", "admin", "orange", "secure", "garden", "silver",
)
_SYLLABLES = ("the", "an", "in", "er", "on", "re", "ou", "ti", "sch", "en", "ble", "ion", "ge", "mi", "ció", "äu", "st", "la", "é", "ha")
_SCHEMES = ("postgres", "mysql", "mongodb", "redis", "amqp", "ftp", "https")


def labelled_findings(n: int, seed: int = 11) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """``n`` labelled findings, drawn by seed.

    Secrets are random keys in the forms that services give out, and passwords
    made of words and numbers where a name or the place in a connection address
    tells what they are.  The others are names of files and classes, numbers,
    dates, versions, paths and hosts, and what looks random without being
    secret: identifiers, checksums, images as text.  Some of both kinds can't be
    told apart by their looks, so that probabilities have something to say.
    """
    r = random.Random(seed)
    b62, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    hexed, upper = "0123456789abcdef", string.ascii_uppercase + string.digits

    def chars(pool: str, low: int, high: int) -> str:
        return "".join(r.choice(pool) for _ in range(r.randint(low, high)))

    def word() -> str:
        if r.random() < 0.5:
            return r.choice(_WORDS)
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def uuid() -> str:
        return "-".join(chars(hexed, k, k) for k in (8, 4, 4, 4, 12))

    def password() -> str:
        made = "".join(r.choice((word(), word().title(), str(r.randint(1, 2030)), r.choice("_-."))) for _ in range(r.randint(3, 5)))
        return made + chars(string.digits, 1, 4) if len(made) >= 8 else made + word().title() + chars(string.digits, 2, 6)

    def mixed() -> str:
        return "".join(r.choice((c, c.upper(), {"a": "4", "e": "3", "o": "0", "i": "1", "s": "5"}.get(c, c))) for c in word() + word()) + chars(b62, 2, 6)

    keys = (
        lambda: chars(b62, 20, 48),
        lambda: chars(b64, 24, 60) + r.choice(("", "=", "==")),
        lambda: "ghp_" + chars(b62, 36, 36),
        lambda: "xoxb-" + chars(string.digits, 10, 12) + "-" + chars(b62, 24, 24),
        lambda: "sk_live_" + chars(b62, 24, 32),
        lambda: "eyJ" + chars(b62, 20, 30) + "." + chars(b62, 20, 40) + "." + chars(b62 + "_-", 20, 40),
        lambda: "AIza" + chars(b62 + "_-", 35, 35),
        lambda: chars(upper, 16, 32),
        lambda: chars(r.choice((hexed, hexed.upper())), 20, 40),
        lambda: chars(hexed, 32, 64),
        lambda: "T" + chars(upper, 8, 8) + "/B" + chars(upper, 8, 8) + "/" + chars(b62, 24, 24),
    )
    named_only = (password, password, mixed, uuid, lambda: chars(hexed, 12, 15))
    others = (
        lambda: f"{word()}_{word()}_{r.randint(1, 2030)}.{r.choice(('png', 'txt', 'html', 'pdf', 'js'))}",
        lambda: f"{word()}/{word()}/{word()}{r.randint(1, 99)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}",
        lambda: f"{word().title()}{word().title()}{word().title()}{r.randint(1, 9)}",
        lambda: f"{word()}-{word()}-{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
        lambda: f"www{r.randint(1, 9)}.{word()}{word()}.example.{r.choice(('com', 'net', 'org'))}",
        lambda: f"{r.choice(('INV', 'PO', 'SKU', 'ISBN', 'REF'))}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(0, 99)}",
        lambda: "".join(word() for _ in range(r.randint(2, 4))) + str(r.randint(0, 99)),
        lambda: f"{word()}{r.randint(1, 99)}={word()}",
        lambda: "".join(word().title() for _ in range(r.randint(4, 5))),
        lambda: f"{word()}.{r.randint(1, 99)}@"[:-1] + f".{word()}{r.randint(1, 99)}",
        lambda: f"{word()}.{chars(hexed, 8, 12)}.chunk.js",
        lambda: f"10.{r.randint(1000, 9999)}/{word()}.{r.randint(1990, 2030)}.{r.randint(100, 9999)}",
    )
    random_others = (uuid, lambda: "sha512-" + chars(b64, 40, 60) + "==", lambda: "iVBORw0KGgo" + chars(b64, 40, 60), lambda: chars(upper, 26, 26), password, lambda: "----WebKitFormBoundary" + chars(b62, 16, 16))
    found, labels = [], np.zeros(n)
    for i in range(n):
        secret = r.random() < 0.5
        before = " ".join(word() for _ in range(3)) + " "
        after = r.choice(('"', "'", "\n", " ", "", ",", ". ")) + word()
        kind = r.random()
        join = r.choice((" = ", "=", ": ", ' = "', ": '", " "))
        if secret and kind < 0.15:
            body, after = r.choice((password, mixed, keys[0]))(), f"@{word()}.example.com/{word()}"
            before += f"{r.choice(_SCHEMES)}://{word()}:"
        elif secret:
            easy = kind < 0.65
            body = r.choice(keys if easy else named_only)()
            if not easy or r.random() < 0.55:
                before += r.choice(_SECRET_NAMES) + join
            elif r.random() < 0.5:
                before += r.choice((word(), "")) + join
        elif kind < 0.15:  # addresses of people, from either end
            host, name = f"mail{r.randint(0, 99)}.example.{r.choice(('com', 'net', 'org'))}", f"{word()}{r.choice(('.', '_', ''))}{word()}{r.choice(('.', ''))}{r.randint(0, 99):02d}"
            if r.random() < 0.5:
                before, body = before + name + "@", host
            else:
                body, after = name, "@" + host
        elif kind < 0.32:
            body = r.choice(random_others)()
            before += r.choice(("data:image/png;base64,", "url(data:font/woff;base64,")) if body.startswith("iVBOR") else r.choice(_OTHER_NAMES) + join
        else:
            body = r.choice(others)()
            if r.random() < 0.5:
                before += r.choice((*_OTHER_NAMES, word(), "")) + join
        found.append((before, body, after))
        labels[i] = secret
    return found, labels


@functools.lru_cache(maxsize=4)
def trained(n: int = 10_000, recall: float = 0.95, seed: int = 11) -> CharConvNet:
    """The network, fitted on six tenths of ``n`` labelled findings.

    Two tenths that it hasn't seen calibrate it and set the threshold; on the
    rest ``recall`` and ``false_alarms`` are measured.
    """
    found, labels = labelled_findings(n, seed)
    codes, cut, last = encode(found), n * 6 // 10, n * 8 // 10
    net = CharConvNet()
    net.fit(codes[:cut], labels[:cut])
    net.calibrate(codes[cut:last], labels[cut:last], recall)
    reported = net.probability(codes[last:]) >= net.threshold
    net.recall, net.false_alarms = float(reported[labels[last:] == 1].mean()), float(reported[labels[last:] == 0].mean())
    return net


def _scan(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
    net = sent.value
    for pdf in batches:
        bases, spans, owner = [], [], []
        chance: list[float] = []
        findings, of = [], []

        def score() -> None:
            for i, p in zip(of, net.probability(encode(findings)), strict=True):
                chance[i] = max(chance[i], p)
            findings.clear()
            of.clear()

        for i, text in enumerate(pdf["text"]):
            base = base_spans(text)
            bases.append(base)
            for s, e in [*((s, e) for _, s, e in base), *candidates(text, base)]:
                owner.append(i)
                spans.append((s, e))
                chance.append(0.0)
                for a, b in windows(text, s, e):
                    of.append(len(chance) - 1)
                    findings.append((text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]))
                    if len(findings) >= PORTION:
                        score()
        score()
        every = [list(b) for b in bases]
        known = [{(s, e) for _, s, e in b} for b in bases]
        top = np.zeros(len(bases))
        for i, span, p in zip(owner, spans, chance, strict=True):
            top[i] = max(top[i], p)
            if p >= net.threshold and span not in known[i]:
                every[i].append((MODEL_KIND, *span))
        order = (*KINDS, MODEL_KIND)
        out = pd.DataFrame({"doc_id": pdf["doc_id"].array})
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(k == kind for k, _, _ in b) for b in bases]
        out["base_sha256"] = [digest(b) for b in bases]
        out["spans"] = [joined(sorted(x, key=lambda s: (s[1], order.index(s[0])))) for x in every]
        out["n_model"] = [len(x) - len(b) for x, b in zip(every, bases, strict=True)]
        out["top_score"] = top
        yield out


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    findings: int = 10_000,
    recall: float = 0.95,
) -> DataFrame:
    """Secrets in every whole text, one row per input row.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, top_score``:
    counts and digest of the fixed patterns' spans, all spans, how many of them
    only the network found, and the highest probability it gave.  The network
    scores every base span and every other key-like run, of any length, with the
    characters around it; one of over ``BODY`` characters in windows that overlap,
    of which the highest probability counts.  It is trained on ``findings``
    labelled findings, a number that bounds the sample and doesn't depend on the
    corpus, calibrated on a part of them held back, and reports what reaches the
    highest threshold that keeps ``recall`` there.  Base spans always stay.

    Null texts count as empty: no spans, the digest of the empty text.  Rows that
    repeat are reported each; an empty table gives no rows.  The network's
    weights, some 20 KB, are broadcast.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trained(findings, recall))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS)
    schema += ", base_sha256 string, spans string, n_model long, top_score double"
    return rows.mapInPandas(lambda it: _scan(it, sent), schema)
