"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_of, text_of, worker_keeps

#: The bounds of the sample that is fitted: characters of reference text that a language gets at
#: most, and that all get together (with many languages each gets an equal part), and languages:
#: those with the most text.  An automaton of 60,000 letters takes up to 32 MB, and some 8 MB where
#: the alphabet is large or languages are many.
REFERENCE_CHARS, ALL_CHARS, MAX_LANGUAGES = 60_000, 1_200_000, 256
#: A reference document may be up to this share of its language's reference text.
DOC_SHARE = 0.25
#: Long texts are worked off in stretches of this many letters side by side; results don't depend on it.
STRETCH = 512
#: Characters of texts that are worked off at a time.
PORTION = 1_000_000
UNDETERMINED = "und"

_CLASSES: np.ndarray | None = None


def _letter_map() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CLASSES = table
    return _CLASSES


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-case letters, with one blank between words and at both ends."""
    points = _letter_map()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    blank = points == 32
    return points[~(blank & np.concatenate(([False], blank[:-1])))]


#: States times letters that all automata together may keep as plain tables of four bytes each.
DENSE = 32_000_000
#: Bits of a packed transition that hold the state it leads to.
_STATE_BITS = np.int64(24)


class Automaton:
    """The suffix automaton of a text of numbered letters.

    Transitions are a table of states by the text's own letters where that is
    small, else one open-addressed table.
    """

    def __init__(self, numbers: np.ndarray, letters: int, room: int):
        own = np.unique(numbers)
        #: The text's own numbers of letters, 0 for those that it hasn't.
        self.own = np.zeros(letters, dtype=np.int32)
        self.own[own] = np.arange(1, len(own) + 1)
        text, self.size, self.letters = self.own[numbers].tolist(), len(numbers), len(own) + 1
        moves: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in text:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
            last = new
        #: Where a phrase that begins with a letter stands after it: the start again if the letter is unknown.
        self.first = np.ones(self.letters, dtype=np.int64)
        for c, to in moves[1].items():
            self.first[c] = to
        n = sum(map(len, moves))
        letters = self.letters
        keys = np.fromiter((state * letters + c for state, out in enumerate(moves) for c in out), dtype=np.int64, count=n)
        to = np.fromiter((x for out in moves for x in out.values()), dtype=np.int64, count=n)
        self.dense = None
        if len(moves) * letters <= room:
            self.dense = np.zeros(len(moves) * letters, dtype=np.int32)
            self.dense[keys] = to
            return
        bits = max(4, (3 * n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        packed, at = keys << _STATE_BITS | to, self._place(keys)
        while len(packed):  # of those that want a free slot one gets it, the others go on to the next
            free = self.slots[at] < 0
            self.slots[at[free]] = packed[free]
            left = self.slots[at] != packed
            packed, at = packed[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that letters lead to, and where there is none; the start is state 1, and 0 no letter of the text."""
        key = state * self.letters
        key += letter
        if self.dense is not None:
            to = self.dense[key].astype(np.int64)
            return to, np.flatnonzero(to == 0)
        at = self._place(key)
        key <<= _STATE_BITS
        to = self.slots[at]
        to ^= key  # the state alone where the slot is the key's
        stop = np.flatnonzero(to >> _STATE_BITS)
        more = stop[self.slots[at[stop]] >= 0]  # those whose slot another key holds look further
        if len(more):
            while len(more):
                at[more] = (at[more] + 1) & self.mask
                got = self.slots[at[more]]
                found = got ^ key[more]
                hit = found >> _STATE_BITS == 0
                to[more[hit]] = found[hit]
                more = more[~hit & (got >= 0)]
            stop = stop[to[stop] >> _STATE_BITS != 0]
        return to, stop


class CrossParser:
    """Suffix automata of one reference text per language."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        texts = [normalise(references[x]) for x in self.languages]
        self.alphabet = np.unique(np.concatenate(texts)) if texts else np.array([32], dtype=np.uint32)
        self.automata = [Automaton(self._letters(t), len(self.alphabet) + 1, DENSE // len(texts)) for t in texts]
        #: Bits that name a place in the reference: what a phrase costs.
        self.bits = np.array([np.log2(a.size + 1) for a in self.automata])

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Numbers of letters from 1, and 0 for those that no reference has."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text (as of :func:`normalise`) falls into, by language.

        A text is cut from the left into the longest pieces that occur in the
        reference; a letter that doesn't occur there is a phrase of its own.
        Stretches of all texts advance side by side, each from its beginning.
        Then each is parsed again from the state that the one before it ended
        in, until the two parses have a phrase begin at the same place, from
        which on they are one; that is the parse of the whole text.
        """
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not sizes.sum() or not self.languages:
            return out
        letters = self._letters(np.concatenate(texts))
        begins = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lanes = _Lanes(letters, begins[owner] + nth * STRETCH, (begins + sizes)[owner], nth > 0)
        for i, automaton in enumerate(self.automata):
            np.add.at(out[:, i], owner, lanes.parse(automaton))
        return out


class _Lanes:
    """Stretches of texts, side by side: a column each, a row for each letter, the longest first."""

    def __init__(self, letters: np.ndarray, begin: np.ndarray, last: np.ndarray, follows: np.ndarray):
        length = np.minimum(begin + STRETCH, last) - begin
        order = np.argsort(-length, kind="stable")
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.length = length[order]
        rows = np.arange(self.length[0])
        self.active = np.searchsorted(-self.length, -rows, side="left")
        self.grid = letters[np.minimum(begin[order] + rows[:, None], len(letters) - 1)]
        #: Columns that go on with a text, and of each the column before.
        after = np.flatnonzero(follows)
        self.after, self.before = self.place[after], self.place[after - 1]

    def parse(self, automaton: Automaton) -> np.ndarray:
        """Phrases that begin in each stretch."""
        starts = np.zeros(self.grid.shape, dtype=bool)
        state = np.ones(self.grid.shape[1], dtype=np.int64)
        grid = automaton.own[self.grid]
        fresh = np.arange(len(state))  # those at the start state
        for i, n in enumerate(self.active):
            letter = grid[i, :n]
            to, broken = automaton.step(state[:n], letter)
            starts[i, fresh[fresh < n]] = True
            starts[i, broken] = True
            to[broken] = first = automaton.first[letter[broken]]
            state[:n] = to
            fresh = broken[first == 1]
        begun = np.ones(len(state), dtype=np.int64)
        while True:
            given = state[self.before]
            moved = np.flatnonzero(begun[self.after] != given)
            if not len(moved):
                return starts.sum(axis=0)[self.place]
            begun[self.after[moved]] = given[moved]
            self._again(automaton, self.after[moved], given[moved], state, starts, grid)

    def _again(self, automaton: Automaton, column: np.ndarray, state: np.ndarray, ends: np.ndarray, starts: np.ndarray, grid: np.ndarray) -> None:
        """Parse these stretches from a state under way, up to where a phrase begins that began there before."""
        row = 0
        while len(column):
            letter = grid[row, column]
            to, broken = automaton.step(state, letter)
            begun = state == 1
            begun[broken] = True
            to[broken] = automaton.first[letter[broken]]
            going = ~(begun & starts[row, column])
            starts[row, column] = begun
            column, state = column[going], to[going]
            row += 1
            over = self.length[column] == row
            if over.any():
                ends[column[over]] = state[over]
                column, state = column[~over], state[~over]


def _parser(references: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(references))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    chars: int = REFERENCE_CHARS,
) -> dict[str, str]:
    """Reference text by language, from rows with a label that are not held out.

    Held out are rows whose ``crc32(doc_id) mod 5`` is 0.  Languages are the
    ``MAX_LANGUAGES`` labels with the most text; further labels, of which a dirty
    column may have any number, are not learned.  Of each language the documents
    are taken whole, in an order drawn by hash, until ``chars`` characters are
    reached (fewer where many languages share ``ALL_CHARS``); documents over
    ``DOC_SHARE`` of that are passed over unless the language has no other, whose
    shortest then stands in with its first ``chars`` characters.
    """
    body = text_of(docs, text)
    rows = docs.filter(docs[lang].isNotNull() & ~held_out(docs[doc_id])).select(
        docs[lang].cast("string").alias("lang"), body.alias("text"), F.length(body).alias("n"), docs[doc_id].alias("doc_id")
    )
    rows = rows.filter("n > 0").withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("all"), F.min(F.struct("n", "draw")).alias("least"))
    known = sizes.orderBy(F.desc("all"), "lang").limit(MAX_LANGUAGES)
    names = known.collect()
    if not names:
        return {}
    chars = min(chars, ALL_CHARS // len(names))
    limit = int(chars * DOC_SHARE)
    known = F.broadcast(known.sparkSession.createDataFrame([(r["lang"], r["least"]["n"], r["least"]["draw"]) for r in names], "lang string, least_n int, least_draw long"))
    rows = rows.join(known, "lang")
    short = rows.filter(F.col("n") <= limit)
    totals = {r["lang"]: r["total"] for r in short.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    # by hash, about four times what is needed of each language comes to the windows below
    parts = [(r["lang"], int(min(1.0, 4 * chars / totals[r["lang"]]) * (1 << 30)) if r["lang"] in totals else None) for r in names]
    parts = F.broadcast(known.sparkSession.createDataFrame(parts, "lang string, part long"))
    alone = F.col("part").isNull() & (F.col("n") == F.col("least_n")) & (F.col("draw") == F.col("least_draw"))
    pick = alone | ((F.col("n") <= limit) & (F.pmod("draw", F.lit(1 << 30)) < F.col("part")))
    sample = rows.join(parts, "lang").filter(pick).select("lang", "draw", F.substring("text", 1, chars).alias("text"))
    sample = sample.dropDuplicates(["lang", "draw"]).withColumn("n", F.length("text"))
    running = F.sum("n").over(Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("running", running).filter((F.col("running") <= chars) | (F.col("running") == F.col("n")))
    found: dict[str, list] = {}
    for r in sample.select("lang", "text", "draw").collect():
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return {x: "\n".join(t for _, t in sorted(v)) for x, v in found.items()}


def held_out(doc_id) -> F.Column:
    """Null ids count as the empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, references: dict[str, str], text: str = "text") -> F.Column:
    """A column of ``lang_pred, score, n_letters, n_phrases`` for every row of ``docs``.

    The language that needs the fewest normalised phrases for the whole text wins,
    ties going to the first by name: a phrase names a place in the reference, so
    phrases count with the logarithm of its size, and a language with little
    reference text is neither favoured nor put back.  ``score`` is the share of
    the second best's count in those of the best two: 0.5 for a tie, near 1 for a
    clear case, 1 if there is one language only.  ``n_phrases`` are as they stand.  Null texts, texts without a letter
    and, if nothing was learned, all texts are ``und`` with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(references.items())))

    @F.pandas_udf("lang_pred string, score double, n_letters long, n_phrases long")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = worker_keeps("languages", sent.value, _parser)
        for series in batches:
            texts, pieces, start = series.tolist(), [], 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= PORTION):
                    size += len(texts[end])
                    end += 1
                pieces.append(_decide(parser, texts[start:end]))
                start = end
            yield pd.concat(pieces, ignore_index=True) if pieces else _decide(parser, [])

    return parse(text_of(docs, text))


def _decide(parser: CrossParser, texts: list[str]) -> pd.DataFrame:
    forms = [normalise(t) for t in texts]
    letters = np.array([int((f != 32).sum()) for f in forms], dtype=np.int64)
    counts = parser.phrases(forms)
    n = len(parser.languages)
    if not n:
        return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "n_letters": letters, "n_phrases": 0})
    costs = counts * parser.bits
    best = costs.argmin(axis=1) if len(texts) else np.zeros(0, dtype=int)
    least = np.take_along_axis(costs, best[:, None], axis=1)[:, 0]
    second = np.partition(costs, 1, axis=1)[:, 1] if n > 1 else np.zeros(len(texts))
    score = second / np.maximum(1e-9, second + least) if n > 1 else np.ones(len(texts))
    names = np.array(parser.languages, dtype=object)[best]
    none = letters == 0
    return pd.DataFrame(
        {
            "lang_pred": np.where(none, UNDETERMINED, names),
            "score": np.where(none, 0.0, score),
            "n_letters": letters,
            "n_phrases": np.take_along_axis(counts, best[:, None], axis=1)[:, 0],
        }
    )


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row.

    ``doc_id, held_out, lang_pred, score, n_letters, n_phrases``; see :func:`fit`
    and :func:`identify`.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    out = rows.select("doc_id", held_out(rows["doc_id"]).alias("held_out"), identify(rows, fit(rows)).alias("found"))
    return out.select("doc_id", "held_out", "found.*")


def keep_identified(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    least_phrase: float = 2.0,
    least_letters: int = 40,
) -> DataFrame:
    """The input's rows whose text is in one of the learned languages, columns as they were.

    Rejected are texts without a letter, and texts of ``least_letters`` or more
    whose phrases are shorter than ``least_phrase`` letters on average, as those
    of no learned language are: letters at random.  Labels are not looked at.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    whole = docs.select(row_of(docs).alias("row"), docs[text].alias("text"))
    found = whole.select("row", identify(whole, fit(rows)).alias("found"))
    plain = (F.col("found.n_letters") < least_letters) | (F.col("found.n_phrases") * least_phrase <= F.col("found.n_letters"))
    return found.filter((F.col("found.lang_pred") != UNDETERMINED) & plain).select("row.*")
