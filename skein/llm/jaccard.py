"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, release, row_of, run_tables, text_of, worker_keeps

#: Words of an n-gram, least similarity, and the share of pairs at that similarity to be met in some band.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
#: Rows of a band: eight bring pairs of similarity 0.3 into a common band in 0.4 % of cases, five would in 7 %.
ROWS = 8
#: Sets, and n-grams, that one side of a tile takes.
TILE_SETS, TILE_GRAMS = 512, 2_000_000
#: Minima of each band that go into a sketch, a byte each, and the share of equal bytes from which a pair
#: may be similar: at similarity 0.8 a share below it is six standard deviations off.
SKETCHED, ALIKE = 2, 0.58
#: Sketches that one side of a tile of a bucket takes, and rows of buckets that one task takes.
BUCKET_SETS, BUCKET_ROWS = 16_384, 200_000
#: Columns of the dense product inside a tile.
PRODUCT_COLUMNS = 4096

_U = np.uint64


def banding(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """Bands and rows: as many bands as bring the chance of a common band to ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashed n-gram sets.  Word hashes are kept for reuse, up to ``keep`` words."""

    def __init__(self, words: int = WORDS, keep: int = 150_000):
        self.words, self.keep, self.known = words, keep, {}

    def _word(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self.known) >= self.keep:
            self.known.clear()
        self.known[word] = h
        return h

    def grams(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams of words between white space.

        A text of fewer words has the one n-gram of all its words; one without
        words has none.
        """
        words = text.translate(_SPACES).split(" ")
        if "" in words:
            words = [w for w in words if w]
        if not words:
            return np.zeros(0, dtype=_U)
        get, make = self.known.get, self._word
        w = np.array([get(x) or make(x) for x in words], dtype=_U)
        n = min(self.words, len(w))
        h = np.full(len(w) - n + 1, n, dtype=_U)
        for i in range(n):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
        return np.unique(h)


_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _signer(bands: int, rows: int, seed: int = 7):
    """Band hashes and sketch of an n-gram set, from the minima of ``bands * rows`` random functions."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**31, bands * rows, dtype=np.uint32)[None, :] * np.uint32(2) + np.uint32(1)
    start = _mix(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def sign(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # n-gram hashes are random already, and odd multiples permute their upper halves
        upper = (grams >> _U(32)).astype(np.uint32)[:, None]
        low = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(upper), 64):
            np.minimum(low, (upper[i : i + 64] * mul).min(axis=0), out=low)
        table = low.reshape(bands, rows)
        out = start
        for r in range(rows):
            out = _mix(out + table[:, r])
        return out, (table[:, :SKETCHED] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).ravel()

    return sign


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """Per row: ``doc_id, text_key, set_key, n_grams, bands, sketch``; texts themselves are left behind."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_keeps("shingles")
        shingler, sign = Shingler(words), _signer(bands, rows)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                grams = shingler.grams(text)
                key = hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()
                hashes, sketch = sign(grams) if len(grams) else (np.zeros(0, _U), np.zeros(0, np.uint8))
                out.append((key, len(grams), hashes.view(np.int64), sketch.tobytes()))
            made = pd.DataFrame(out, columns=["set_key", "n_grams", "bands", "sketch"])
            made.insert(0, "text_key", pdf["text_key"].array)
            made.insert(0, "doc_id", pdf["doc_id"].array)
            yield made

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInPandas(scan, f"doc_id {kind}, text_key string, set_key string, n_grams long, bands array<long>, sketch binary")


def _joined(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key and ``n``, the number of ``rows`` (``total`` in all) that have it.

    Keys of more than one in ``k`` rows, of which there are at most ``k``, are
    broadcast; the others, none of them hot, meet by a shuffle.
    """
    k = max(100, 8 * parts(rows))
    hot = F.broadcast(table.filter(F.col("n") * k > total))
    tail = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col("n") * k <= total), key)
    return rows.join(hot, key).unionByName(tail)


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (``a, b``): the smallest node it is linked with.

    Large-star and small-star steps in turn until nothing changes; each is an
    aggregation and a join by node, of at most as many rows as there are edges.
    Nodes of any degree are fine: a node's least neighbour is aggregated before
    the shuffle, and edges of hubs stay where they are for the join.
    """
    spark = edges.sparkSession
    with run_tables() as tables:
        edges = materialise(edges.filter("a <> b").distinct(), "edges")
        state = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        before = tuple(edges.agg(*state).first())
        while True:
            both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
            large = _joined(both, least, "a", 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = materialise(large.filter("a <> b").distinct(), "edges")  # each from a greater node to a smaller one
            least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
            small = _joined(large, least, "a", large.count())
            small = small.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
            edges = materialise(small, "edges")
            release(spark, tables, keep=1)  # the edges before these
            now = tuple(edges.agg(*state).first())
            if now == before:
                break
            before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def _alike(sketches: np.ndarray) -> np.ndarray:
    """For each sketch the position of the first that a chain of alike ones leads to.

    Each is compared once, as its turn comes, with those that no chain has
    reached yet: a group of copies takes about one comparison a member.
    """
    n = len(sketches)
    root = np.full(n, -1, dtype=np.int64)
    least = math.ceil(ALIKE * sketches.shape[1])
    left = np.arange(n)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        left = left[root[left] < 0]
        queue = [first]
        while queue and len(left):
            met = (sketches[left] == sketches[queue.pop()]).sum(axis=1) >= least
            found = left[met]
            root[found] = first
            queue.extend(found.tolist())
            left = left[~met]
    return root


def _refined(groups: DataFrame, banded: DataFrame, sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """``groups`` with those of over ``TILE_SETS`` sets cut into what alike sketches of common buckets hold together.

    Buckets chain what few n-grams join into large groups.  Pairs of a bucket are
    compared by sketch, a bucket of over ``BUCKET_SETS`` in tiles, and only
    spanning edges leave a task.
    """
    sizes = groups.groupBy("comp").agg(F.count("*").alias("n"))
    large = materialise(sizes.filter(F.col("n") > TILE_SETS), "large-groups")
    if not large.limit(1).count():
        return groups
    total = groups.count()
    inside = _joined(groups, large, "comp", total).select(F.col("node").alias("sid"))
    held = inside.join(sets.select("sid", "sketch"), "sid")
    rows = banded.join(buckets, "hash").join(held, "sid")
    rows = rows.withColumn("side", F.ceil(F.col("n") / BUCKET_SETS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("side")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, side - 1)")))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    bins = max(parts(sets), -(-buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_ROWS))
    # small buckets share tasks; a large one, or a tile of it, is a task
    owner = F.when(F.col("n") > BUCKET_SETS // 8, F.col("hash")).otherwise(F.pmod("hash", F.lit(bins)))
    rows = rows.withColumn("owner", owner).select("owner", "low", "high", "hash", "sid", "sketch")

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "sid"], ignore_index=True)
        sid, hashes = pdf["sid"].to_numpy(), pdf["hash"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True])))
        root = np.empty(len(pdf), dtype=np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            root[a:b] = a + _alike(np.frombuffer(b"".join(pdf["sketch"].iloc[a:b]), dtype=np.uint8).reshape(b - a, -1))
        moved = sid != sid[root]
        return pd.DataFrame({"a": sid[moved], "b": sid[root][moved]}).drop_duplicates()

    edges = rows.groupBy("owner", "low", "high").applyInPandas(spans, "a long, b long")
    smaller = _joined(groups, sizes.filter(F.col("n") <= TILE_SETS), "comp", total).select("node", "comp")
    return smaller.unionByName(components(edges))


def _links(sizes: np.ndarray, grams: list[np.ndarray], split: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets that are similar: within all if ``split`` is 0, else of the first ``split`` with the rest.

    Intersections are sparse products by column blocks: only n-grams that more
    than one set has are columns.
    """
    n = len(grams)
    if n < 2:
        return
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    counts = np.bincount(column)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    renumber = np.cumsum(counts > 1) - 1
    column = renumber[column]
    top = split or n
    common = np.zeros((top, n - split), dtype=np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    starts = np.searchsorted(column, np.arange(0, width + PRODUCT_COLUMNS, PRODUCT_COLUMNS))
    for k in range(len(starts) - 1):
        part = slice(starts[k], starts[k + 1])
        if part.start == part.stop:
            continue
        dense = np.zeros((n, PRODUCT_COLUMNS), dtype=np.float32)
        dense[owner[part], column[part] - k * PRODUCT_COLUMNS] = 1
        common += dense[:top] @ dense[split:].T
    total = sizes[:top, None] + sizes[None, split:] - common
    i, j = np.nonzero((common >= similarity * total - 1e-6) & (total > 0))
    j = j + split
    if not split:
        once = i < j
        i, j = i[once], j[once]
    # the float test has slack; whole numbers decide
    inter = common[i, j - split].astype(np.int64)
    exact = inter >= np.ceil(similarity * (sizes[i] + sizes[j] - inter) - 1e-9)
    yield i[exact], j[exact]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` is linked with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def similar(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, n_links, n_set_links, set_key, text_key``.

    Two rows are linked if the Jaccard similarity of their texts' n-gram sets is
    ``similarity`` or more.  A class is a connected component of links; its id is
    the smallest ``doc_id`` in it (null last).  ``n_links`` counts the linked
    rows, ``n_set_links`` the linked n-gram sets that differ from the row's own.
    Null counts as empty; texts without words form one class.  Words are runs of
    anything but white space as they stand; short texts are their only n-gram.
    Rows that repeat are linked like copies.  An empty table gives no rows.

    1. One pass over the texts leaves a signature per row: the set's digest and
       the band hashes.  Equal sets are one from here on, with their number.
    2. Sets are dealt by band hash; each meets the smallest of its bucket, and
       these edges' components hold every pair that shares a band.  ``banding``
       sets the number of bands from the recall.  Components of over
       ``TILE_SETS`` sets are cut where no two sets of a bucket have alike
       sketches, as chains of slight likeness would otherwise grow with the corpus.
    3. Pairs of a component are verified on full n-gram sets, which are built
       from the text of one row per set.  Small components are packed into tasks;
       a large one is dealt to tiles of two blocks each, whose pairs are found by
       matrix products and leave the tile as counts per set and spanning links,
       never as pairs.
    4. Components of the verified links are the classes.
    """
    bands, rows = banding(similarity, recall)
    base = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    base = base.select("doc_id", "text", F.sha2("text", 256).alias("text_key"))
    signed = materialise(signatures(base.select("doc_id", "text_key", "text"), bands, rows, words), "signatures")

    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    sets = signed.groupBy("set_key").agg(
        F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    banded = sets.select("sid", F.explode("bands").alias("hash"))  # a hash holds its band's number
    buckets = banded.groupBy("hash").agg(F.min("sid").alias("least"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(buckets, "buckets")
    total = sets.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    edges = _joined(banded, buckets, "hash", total).select(F.col("least").alias("b"), F.col("sid").alias("a"))
    groups = materialise(components(edges), "candidate-groups")
    groups = materialise(_refined(groups, banded, sets, buckets.select("hash", "n")), "refined-groups")

    found = _verify(base, sets, groups, words, similarity)
    found = materialise(found, "links")
    counts = found.groupBy("sid").agg(F.sum("copies_met").alias("copies_met"), F.sum("sets_met").alias("sets_met"))
    classes = components(found.filter("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    sets = sets.drop("bands", "sketch").join(counts, "sid", "left").join(classes, sets["sid"] == classes["node"], "left")
    sets = sets.select(
        "set_key", "first", "copies", F.coalesce("comp", "sid").alias("comp"),
        F.coalesce("copies_met", F.lit(0)).alias("copies_met"), F.coalesce("sets_met", F.lit(0)).alias("sets_met"),
    )
    sets = materialise(sets, "set-classes")
    heads = sets.groupBy("comp").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    sets = sets.join(heads, "comp").select(
        "set_key", F.col("head.doc_id").alias("class_id"), F.col("head.text_key").alias("head_key"), "class_size",
        (F.col("copies") - 1 + F.col("copies_met")).alias("n_links"), F.col("sets_met").alias("n_set_links"),
    )
    return signed.select("doc_id", "text_key", "set_key").join(sets, "set_key").select(
        "doc_id", "class_id", "class_size", "n_links", "n_set_links", "set_key", "text_key", "head_key"
    )


def _verify(base: DataFrame, sets: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links of all pairs within each group: ``sid, root, copies_met, sets_met`` by tile."""
    members = groups.withColumnRenamed("node", "sid").join(sets.select("sid", "copies", "first", "n_grams"), "sid")
    # smaller tiles where there are fewer sets than would fill the tasks
    tile_sets = min(TILE_SETS, max(TILE_SETS // 4, groups.count() // parts(base)))
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    side = F.ceil(F.greatest(F.col("n") / tile_sets, F.col("grams") / TILE_GRAMS)).cast("int")
    # a component of many sets or n-grams has tasks of its own; others share tasks that hold a tile's worth on average
    sizes = sizes.withColumn("side", side).withColumn("tiled", F.greatest(F.col("n") / tile_sets, F.col("grams") / TILE_GRAMS) > 0.125)
    sizes = materialise(sizes, "candidate-sizes")
    total, grams = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("grams"), F.lit(0))).first()
    members = _joined(members, sizes, "comp", total).select("sid", "comp", "side", "tiled", "copies", "first")
    members = materialise(members, "members")
    bins = max(parts(base), 2 * -(-total // tile_sets), 2 * -(-grams // TILE_GRAMS))

    key = members.select("sid", "comp", "side", "tiled", "copies", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    texts = base.join(key, base["doc_id"].eqNullSafe(key["_id"]) & (base["text_key"] == key["_key"]))
    texts = texts.select("sid", "comp", "side", "tiled", "copies", "text")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_keeps("shingles")
        shingler = Shingler(words)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(grams=[shingler.grams(t).tobytes() for t in pdf["text"]])

    packed = texts.mapInPandas(shingled, "sid long, comp long, side int, tiled boolean, copies long, grams binary")
    # a block of a large group meets every block of it, itself included, once
    block = F.pmod(F.xxhash64("sid"), F.col("side")).cast("int")
    packed = packed.withColumn("block", F.when(F.col("side") > 1, block).otherwise(0))
    packed = packed.withColumn("other", F.explode(F.expr("if(side > 1, sequence(0, side - 1), array(0))")))
    packed = packed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    packed = packed.withColumn("owner", F.when(F.col("tiled"), F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins))))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["comp", "sid"])
        out = []
        for _, g in pdf.groupby("comp", sort=False) if not pdf["tiled"].iloc[0] else [(0, pdf)]:
            low, high = int(g["low"].iloc[0]), int(g["high"].iloc[0])
            g = g.sort_values(["block", "sid"])
            split = int((g["block"] == low).sum()) if low != high else 0
            if low != high and split in (0, len(g)):
                continue
            grams = [np.frombuffer(b, dtype=_U) for b in g["grams"]]
            count = np.array([len(x) for x in grams], dtype=np.int64)
            sid, copies = g["sid"].to_numpy(), g["copies"].to_numpy()
            met, sets_met = np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64)
            root = np.arange(len(g))
            by_sid = np.argsort(sid)
            for i, j in _links(count, grams, split, similarity):
                np.add.at(met, i, copies[j])
                np.add.at(met, j, copies[i])
                np.add.at(sets_met, i, 1)
                np.add.at(sets_met, j, 1)
                place = np.empty(len(g), dtype=np.int64)
                place[by_sid] = np.arange(len(g))
                root = by_sid[_roots(len(g), place[i], place[j])][place]
            linked = sets_met > 0
            out.append(pd.DataFrame({"sid": sid[linked], "root": sid[root][linked], "copies_met": met[linked], "sets_met": sets_met[linked]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("sid", "root", "copies_met", "sets_met")})

    return packed.groupBy("tiled", "owner", "low", "high").applyInPandas(tile, "sid long, root long, copies_met long, sets_met long")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The input's rows less all but one of each class, columns as they were.

    The row with the class's smallest identifier stays; of rows equal in
    identifier and text, one.
    """
    found = materialise(similar(docs, text, doc_id, **options), "classes")
    stays = found.filter("doc_id <=> class_id and text_key = head_key").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    again = stays.groupBy("_id", "_key").count().filter("count > 1").limit(1).count()
    marked = docs.select(
        row_of(docs).alias("_row"), docs[doc_id].alias("_d"), F.sha2(text_of(docs, text), 256).alias("_k")
    )
    one = marked.join(stays, marked["_d"].eqNullSafe(stays["_id"]) & (marked["_k"] == stays["_key"]), "left_semi")
    if again:
        one = one.dropDuplicates(["_k"])
    return one.select("_row.*")
