"""MinHash near-dedup: sparse signatures from darts, banded joining, checked links, classes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled, text_of, whole_row
from ledgerloom.llm.hashing import SPREAD, Powers, mixed, text_bytes, words

WORDS = 5  # words of a shingle
SIMILAR = 0.8  # Jaccard similarity from which two texts are near copies
BANDS, ROWS = 24, 4  # a pair at 0.8 shares a band but for 3 in a million, and most share several
PLANES, MISSED = 4, 1e-6  # bits of each coordinate in a sketch; chance that it hides a pair at the similarity
MIXED = 16  # pairs of different classes per member up to which a bucket's are compared at once
LEVELS = [0.0] + [4.0**k for k in range(-3, 12)]  # borders of the ranks that darts are thrown for
BINS = 2**20  # counters of how many sets have a shingle; some share one, which costs time and no pair
HEAVY = 500  # rarest shingles of one hash that are joined together, about
CHUNK = 4 * 2**20


def _poisson(mean: float) -> np.ndarray:
    """Cumulated chances of 0, 1, 2, ... darts."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    logs = n * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))
    return np.cumsum(np.exp(logs))


def _unit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)) / float(2**53)


def darts(items: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """Signatures (owner, k): for each coordinate the earliest dart that hits one of the owner's items.

    An item is a cell of unit weight; a weight is as many cells. Darts fall on cell x rank at
    rate 1, from a hash of cell and rank level, so that equal cells get the same darts in every
    set; each dart carries a coordinate. Levels are thrown in rising order and only for sets
    that still lack a coordinate: about k log k darts per set, however large it is.
    """
    out = np.zeros((owners, k), dtype=np.uint64)
    filled = np.zeros((owners, k), dtype=bool)
    for level in range(len(LEVELS) - 1):
        lacking = ~filled.all(axis=1)
        on = lacking[owner]
        own, cell = owner[on], items[on]
        if not own.size:
            break
        low, high = LEVELS[level], LEVELS[level + 1]
        seed = mixed(cell + np.uint64((level + 1) * int(SPREAD) % 2**64))
        thrown = np.searchsorted(_poisson(high - low), _unit(mixed(seed)), side="right")
        at = np.repeat(np.arange(own.size), thrown)
        nth = np.arange(at.size) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mixed(seed[at] ^ mixed(nth.astype(np.uint64) + np.uint64(7)))
        rank = np.argsort(_unit(mixed(dart)), kind="stable")[::-1]  # the earliest is written last
        slot = own[at] * k + (mixed(dart + np.uint64(1)) % np.uint64(k)).astype(np.int64)
        fresh = np.zeros(owners * k, dtype=np.uint64)
        hit = np.zeros(owners * k, dtype=bool)
        fresh[slot[rank]], hit[slot] = dart[rank], True
        new = hit.reshape(owners, k) & ~filled
        out[new] = fresh.reshape(owners, k)[new]
        filled |= new
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """The lowest PLANES bits of each coordinate, plane by plane, in two words a plane: (owner, 2 * PLANES)."""
    places = np.uint64(1) << np.arange(BANDS * ROWS // 2, dtype=np.uint64)
    halves = values.reshape(len(values), 2, places.size)
    planes = [((halves >> np.uint64(p) & np.uint64(1)) * places).sum(axis=2) for p in range(PLANES)]
    return np.concatenate(planes, axis=1)


def _unlike(x: str, y: str) -> Column:
    """How many coordinates differ in two sketches."""
    apart = lambda at: F.get(x, F.lit(at)).bitwiseXOR(F.get(y, F.lit(at)))
    halves = [reduce(Column.bitwiseOR, [apart(2 * p + half) for p in range(PLANES)]) for half in (0, 1)]
    return F.bit_count(halves[0]) + F.bit_count(halves[1])


def most_unlike(similar: float) -> int:
    """The number of differing coordinates that a pair at the similarity exceeds with a chance below MISSED."""
    k, q = BANDS * ROWS, (1 - similar) * (1 - 0.5**PLANES)
    chance = [math.comb(k, n) * q**n * (1 - q) ** (k - n) for n in range(k + 1)]
    return next(n for n in range(k + 1) if sum(chance[n + 1 :]) < MISSED)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, powers: Powers, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, text) of all texts: the different shingles of each, sorted by text and value.

    A text with fewer words is one shingle; one without words has none.
    """
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    starts, stops = words(data, fresh)
    if not starts.size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    each = powers.hashes(powers.sums(data), starts, stops)
    text = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    nth = np.arange(text.size) - np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero((nth == 0) | (nth <= count[text] - size))
    made = np.zeros(first.size, dtype=np.uint64)
    for k in range(size):
        at = np.minimum(first + k, text.size - 1)
        inside = (first + k < text.size) & (text[at] == text[first])
        made = mixed(made + np.where(inside, each[at], np.uint64(0)) + np.uint64(k))
    owner = text[first]
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.ones(made.size, dtype=bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[new], owner[new]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows [from, to) of a batch with about CHUNK bytes of text, or one row that has more."""
    _, offsets = text_bytes(batch.column("text"))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        yield low, high
        low = high


def _sets(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list]]:
    """Chunks of a batch with shingles, their text, and the 128-bit name of each text's set."""
    for low, high in _chunks(batch):
        part = batch.slice(low, high - low)
        made, owner = shingle_sets(*text_bytes(part.column("text")), powers)
        cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
        names = [
            hashlib.blake2b(made[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        yield part, made, owner, names


def signatures(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey (a hash of the text), node (the name of the shingle set; null without words), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part, made, owner, names in _sets(batch, powers):
                thrown = darts(made, owner, part.num_rows, BANDS * ROWS)
                values = thrown.reshape(part.num_rows, BANDS, ROWS)
                bands = np.zeros(values.shape[:2], dtype=np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands + values[:, :, r])
                rows_of = lambda table: pa.ListArray.from_arrays(
                    pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]),
                    pa.array(np.ascontiguousarray(table).reshape(-1).view(np.int64)),
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "tkey": part.column("tkey"),
                        "node": pa.array(names, pa.binary()),
                        "bands": rows_of(bands),
                        "sketch": rows_of(sketches(thrown)),
                    }
                )

    kind = df.schema[id].dataType.simpleString()
    return _keyed(df, id, text).mapInArrow(sign, f"doc_id {kind}, tkey long, node binary, bands array<long>, sketch array<long>")


def _keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(df[id].alias("doc_id"), text_of(df, text).alias("text")).withColumn("tkey", F.xxhash64("text"))


def _fetched(df: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (doc_id, tkey, node): one text each is read again."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            for part, made, owner, names in _sets(batch, powers):
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                nodes, sets = [], []
                for at, (name, node) in enumerate(zip(names, part.column("node").to_pylist(), strict=True)):
                    if name == node and node not in seen:  # repeated rows of one id and text lie in one task
                        seen.add(node)
                        nodes.append(node)
                        sets.append(np.unique((made[cuts[at] : cuts[at + 1]] >> np.uint64(32)).astype("<u4")).tobytes())
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "shingles": pa.array(sets, pa.binary())})

    rows, w = _keyed(df, id, text).alias("r"), wanted.alias("w")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.tkey") == F.col("w.tkey"))
    return rows.join(w, same).select("w.node", "r.text").mapInArrow(look, "node binary, shingles binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(center, node, sim): the exact Jaccard similarity of 32-bit shingle hashes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = np.intersect1d(x, y, assume_unique=True).size
                sims.append(both / (x.size + y.size - both))
            yield pa.RecordBatch.from_pydict(
                {"center": batch.column("center"), "node": batch.column("node"), "sim": pa.array(sims, pa.float64())}
            )

    of = lambda node, new: sets.select(F.col("node").alias(node), F.col("shingles").alias(new))
    joined = pairs.join(of("center", "a"), "center").join(of("node", "b"), "node")
    return joined.select("center", "node", "a", "b").mapInArrow(compare, "center binary, node binary, sim double")


def _reach(sets: DataFrame) -> DataFrame:
    """(node, size, shared): how many shingles a set has, and how many of them another set has, too.

    Two sets have at most the smaller ``shared`` in common, which rules out most sets that hold
    a common passage or a copy with many changes before any pair is made.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                shingle, (high, low) = np.frombuffer(data, "<i4"), np.frombuffer(node, ">i8")
                yield pa.RecordBatch.from_pydict(
                    {"shingle": shingle, "high": np.full(shingle.size, high), "low": np.full(shingle.size, low)}
                )

    rows = sets.mapInArrow(spell, "shingle int, high long, low long")
    by_shingle = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("high").alias("high"), F.min("low").alias("low"))
    own = by_shingle.filter("n = 1").groupBy("high", "low").agg(F.count("*").alias("own"))
    half = lambda at: F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("long")
    sized = sets.select("node", (F.length("shingles") / 4).cast("long").alias("size"), half(1).alias("high"), half(9).alias("low"))
    return sized.join(own, ["high", "low"], "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def _rare_pairs(sets: DataFrame, crowd: DataFrame, similar: float) -> DataFrame:
    """(center, node) of all pairs of different labels in ``crowd`` (node, label, sketch) that may have the similarity.

    Each set's shingles are put in one order, the rarest first. A pair with the similarity has
    so many in common that the larger set has one of them among its first (1 - similar), and the
    smaller one among even fewer: only these are joined, and no pair is left to chance but by its
    sketch. A passage that most sets hold comes last and is not among them. The order needs no
    exact counts, so they are kept in BINS counters, all that the driver sees.
    """
    held = sets.join(crowd.select("node"), "node")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u4") % BINS, minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    counted = held.mapInArrow(tally, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BINS, dtype=np.int64)
    often[counted.column("bin").to_numpy()] = counted.column("n").to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, places = [], [], []
            for row, data in enumerate(batch.column("shingles").to_pylist()):
                shingle = np.frombuffer(data, "<u4")
                n = often[shingle % BINS]
                first = np.lexsort((shingle, n))[: shingle.size - math.ceil(similar * shingle.size - 1e-6) + 1]
                at = np.flatnonzero(n[first] > 1)  # no other set has the rest
                rows.append(np.full(at.size, row))
                firsts.append(shingle[first[at]].view("<i4"))
                places.append(at)
            if rows:
                rows = pa.array(np.concatenate(rows), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "shingle": pa.array(np.concatenate(firsts), pa.int32()),
                        "at": pa.array(np.concatenate(places), pa.int32()),
                        **{name: batch.column(name).take(rows) for name in ("node", "label", "sketch", "size")},
                    }
                )

    sized = sets.join(crowd, "node").withColumn("size", (F.length("shingles") / 4).cast("int"))
    kinds = "shingle int, at int, node binary, label binary, sketch array<long>, size int"
    posts = settled(sized.mapInArrow(rarest, kinds), "rarest")
    need = similar / (1 + similar)
    small = posts.filter(F.col("at") <= F.col("size") - F.ceil(2 * need * F.col("size") - 1e-6))
    salts = small.groupBy("shingle").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("salts"))
    small = small.join(salts.filter("salts > 1"), "shingle", "left").withColumn(
        "salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    x = posts.join(salts, "shingle").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    y = small.alias("y")
    common = need * (F.col("x.size") + F.col("y.size")) - 1e-6
    fits = (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label"))
        & (F.struct("y.size", "y.node") < F.struct("x.size", "x.node"))
        & (F.col("x.size") - F.col("x.at") >= common) & (F.col("y.size") - F.col("y.at") >= common)
        & (_unlike("x.sketch", "y.sketch") <= most_unlike(similar))
    )
    ends = (F.least("x.node", "y.node").alias("center"), F.greatest("x.node", "y.node").alias("node"))
    return x.join(y, fits).select(*ends).distinct()


def _linked(df: DataFrame, nodes: DataFrame, id: str, text: str, similar: float) -> tuple[DataFrame, DataFrame]:
    """``links`` and the ``classes`` that they connect."""
    keys = F.posexplode("bands").alias("last", "band")
    keyed = nodes.select("node", keys).select("node", "last", F.xxhash64("last", "band").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1")
    members = settled(keyed.join(shared.drop("n"), "key"), "buckets")
    pairs = members.filter("node != center").select("center", "node").distinct()
    active = members.select("node").distinct()
    sets = settled(_fetched(df, nodes.drop("bands", "sketch").join(active, "node", "left_semi"), id, text), "sets")
    seen = settled(_compared(pairs, sets), "compared")
    found = seen.filter(F.col("sim") >= similar).select("center", "node")
    labels = classes(found)
    label = F.coalesce("label", "node")

    def may(size: Column, other: Column, common: Column) -> Column:
        return common * (1 + similar) >= (size + other) * similar - 1e-6

    far = most_unlike(similar)

    # only buckets of several classes go on, and of them only members that could be linked to one at least
    members = members.select("key", "node", "last")
    several = members.join(labels, "node", "left").select("key", label.alias("label")).groupBy("key")
    several = several.agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("key")
    members = settled(members.join(several, "key", "left_semi"), "buckets")
    reach = _reach(sets.join(members.select("node").distinct(), "node", "left_semi"))
    members = settled(members.join(reach.join(nodes.select("node", "sketch"), "node"), "node"), "reach")
    least = members.groupBy("key").agg(F.min("size").alias("least"))
    members = settled(members.join(least, "key").filter(may(F.col("size"), F.col("least"), F.col("shared"))).drop("least"), "able")
    sets = settled(sets.join(members.select("node").distinct(), "node", "left_semi"), "sets")  # later steps move these alone
    if members.isEmpty():
        return found, labels
    labelled = members.join(labels, "node", "left").withColumn("label", label)
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node", "size", "shared", "sketch"))  # buckets of one class get many centers
    by_class = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), drawn.alias("drawn"))
    n = F.col("n").cast("double")
    mixed_ = (
        by_class.groupBy("key")
        .agg(
            F.sum("n").alias("all"), F.count("*").alias("labels"), F.sum(n * n).alias("squares"),
            F.max(F.struct("n", "label", "drawn")).alias("most"),
        )
        .filter("labels > 1")
        .select(
            "key", F.col("most.label").alias("own"), F.col("most.drawn").alias("center"),
            ((F.col("all") * F.col("all") - F.col("squares")) / 2 > MIXED * F.col("all")).alias("large"),
        )
    )
    in_mixed = settled(labelled.join(mixed_, "key"), "members")
    few = in_mixed.filter("NOT large").withColumn("keys", F.collect_set("key").over(Window.partitionBy("node")))
    x, y = few.filter("label != own").alias("x"), few.alias("y")  # one of a pair at least is outside the largest class
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    once = (F.col("y.label") == F.col("y.own")) | (F.col("x.node") < F.col("y.node"))
    able = may(F.col("x.size"), F.col("y.size"), F.least("x.shared", "y.shared"))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # a pair is made in one of its buckets alone
    close = x.join(y, differ & once & able & (_unlike("x.sketch", "y.sketch") <= far) & first)
    able = may(F.col("size"), F.col("center.size"), F.least("shared", "center.shared"))
    star = in_mixed.filter("large AND label != own").filter(able & (_unlike("sketch", "center.sketch") <= far))
    ends = (F.least("center.node", "node").alias("center"), F.greatest("center.node", "node").alias("node"))
    pairs = close.select(F.least("x.node", "y.node").alias("center"), F.greatest("x.node", "y.node").alias("node")).union(star.select(*ends))
    fresh = settled(_compared(pairs.distinct().join(seen, ["center", "node"], "left_anti"), sets), "compared")
    seen = seen.unionByName(fresh)
    fresh = fresh.filter(F.col("sim") >= similar).select("center", "node")
    if not fresh.isEmpty():
        found = found.unionByName(fresh)
        labels = classes(found)
    crowd = in_mixed.filter("large").select("key", "node")  # pairs that the center left are made by their rarest shingles
    crowd = crowd.join(labels, "node", "left").withColumn("label", label)
    several = crowd.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b")
    crowd = crowd.join(several, "key", "left_semi").select("node", "label").distinct().join(nodes.select("node", "sketch"), "node")
    crowd = settled(crowd, "crowd")
    if not crowd.isEmpty():
        pairs = _rare_pairs(sets, crowd, similar).join(seen, ["center", "node"], "left_anti")
        fresh = settled(_compared(pairs, sets), "compared").filter(F.col("sim") >= similar).select("center", "node")
        if not fresh.isEmpty():
            found = found.unionByName(fresh)
            labels = classes(found)
    return found, labels


def links(df: DataFrame, nodes: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(center, node) pairs of different shingle sets with at least the similarity, enough to connect every class.

    Sets that share a band are a bucket. In the first round its smallest member is the center,
    and each other one is compared with it alone: no pairs within a bucket. From then on only
    pairs of members in different classes matter, and a bucket in one class is done. Members
    go that have too few shingles in common with all other sets for any link (``_reach``), and pairs
    whose sketches differ in more coordinates than a pair at the similarity would once in a million. A mixed
    bucket with few such pairs for its size has them compared. A larger one gets a
    center from its largest class, which members of other classes are compared with; the members of
    those that still have several classes are then joined by their rarest shingles
    (``_rare_pairs``), whatever bands they share. Members are never capped. Pairs compared before
    are not compared again.
    """
    return _linked(df, nodes, id, text, similar)[0]


def classes(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected class of each node in (center, node) pairs.

    Labels spread along the links and jump to the label of their label, until none changes; each
    round is written, so lineage stays short. A round shuffles links and labels only.
    """
    both = settled(
        pairs.select(F.col("center").alias("a"), F.col("node").alias("b"))
        .union(pairs.select(F.col("node").alias("a"), F.col("center").alias("b")))
        .distinct(),
        "links",
    )
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l"))
        spread = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = settled(
            spread.join(jump, spread["label"] == jump["at"]).select("node", "old", F.least("label", "far").alias("label")),
            "labels",
        )
        labels = moved.drop("old")
        if moved.filter("label != old").isEmpty():
            return labels


def near_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Every row's class of near copies: doc_id, class_id, class_size, kept, tkey.

    Texts are near copies when their sets of five-word shingles have a Jaccard similarity of at
    least ``similar``; a class is what such links connect, and ``class_id`` is its smallest id.
    Rows with the same shingle set are one node from the start. The row whose id is the class's
    stays. Null and wordless texts are classes of their own row's id; a text of fewer than five
    words is one shingle. A row without id belongs to its class, and stays only if no row of it
    has an id. Repeated rows share their class and mark. Other columns are ignored; an empty table
    gives no rows.
    """
    signed = settled(signatures(df, id, text), "signatures")
    one = F.min(F.struct("doc_id", "tkey"))
    nodes = settled(
        signed.filter("node IS NOT NULL").groupBy("node").agg(one.alias("one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select(
            "node", "one.doc_id", "one.tkey", "bands", "sketch"
        ),
        "nodes",
    )
    _, labels = _linked(df, nodes, id, text, similar)
    own = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    sizes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    named = own.join(sizes, "node")
    whole = named.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    named = settled(named.select("node", "label").join(whole, "label").drop("label"), "classes")
    alone = F.col("node").isNull()
    return signed.drop("bands", "sketch").join(named, "node", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        "tkey",
    )


def survivors(df: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df``, with all their columns, that stay: one for each class."""
    marks = near_dedup(df, id, text, similar).filter("kept").select("doc_id", "tkey").distinct().alias("m")
    rows = df.select(whole_row(df).alias("row"), df[id].alias("doc_id"), F.xxhash64(text_of(df, text)).alias("tkey")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.tkey") == F.col("m.tkey"))
    copies = Window.partitionBy("doc_id", "tkey").orderBy(F.xxhash64("row"))
    return rows.join(marks, same, "left_semi").withColumn("copy", F.row_number().over(copies)).filter("copy = 1").select("row.*")
