"""Suffix-array dedup: repeated byte strings found by induced sorting in shards dealt by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled, text_of
from ledgerloom.llm.hashing import Powers, text_bytes

LENGTH = 200  # bytes of a repeated string
SEED_BYTES = 32  # bytes whose hash decides where a string is compared
SHARD_BYTES = 2**20
HOT_BYTES = 2**24  # stretches of one seed beyond this are compared string by string
CHUNK = 2 * 2**20


def _dealt(sources: np.ndarray, text: np.ndarray, keep: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends the positions before ``sources``, in order, to the list of their own symbol."""
    before = sources[keep] - 1
    symbols = text[before]
    order = np.argsort(symbols, kind="stable")
    before, symbols = before[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(before, cuts) if before.size else []:
        into[text[part[0]]].append(part)


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones given in order.

    Buckets are gone through once upwards for the larger suffixes and once downwards for the
    smaller ones; within a bucket, what it induces into itself comes in waves. Each step takes a
    whole bucket, or wave, at a time.
    """
    size = int(text.max()) + 1
    given = [lms[text[lms] == c] for c in range(size)]
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    none = np.zeros(0, dtype=np.int64)
    for c in range(size):
        wave, own = np.concatenate(larger[c]) if larger[c] else none, []
        while wave.size:
            own.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
        larger[c] = [np.concatenate(own)] if own else [none]
        sources = np.concatenate((larger[c][0], given[c]))
        sources = sources[sources > 0]
        _dealt(sources, text, text[sources - 1] > c, larger)
    lesser: list[list[np.ndarray]] = [[] for _ in range(size)]
    out = []
    for c in range(size - 1, -1, -1):
        wave, own = np.concatenate(lesser[c]) if lesser[c] else none, []
        while wave.size:
            own.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & smaller[wave]]
        falling = np.concatenate([*own, larger[c][0][::-1]])
        if c == 0:  # the end mark, smallest of all
            falling = np.array([len(text) - 1])
        out.append(falling)
        sources = falling[falling > 0]
        _dealt(sources, text, text[sources - 1] < c, lesser)
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; its last symbol is 0 and occurs nowhere else.

    Suffixes are classified, the leftmost-smaller substrings sorted by inducing once and named,
    the string of names is sorted, and its order induces that of all suffixes. The reduced
    string has nearly as many symbols as positions, so it is sorted by doubling ranks, which
    numpy does at once, and not by inducing bucket after bucket again.
    """
    n = len(text)
    falls = np.flatnonzero(text[:-1] != text[1:])  # the next differing symbol decides the class
    nearest = np.searchsorted(falls, np.arange(n - 1))
    smaller = np.ones(n, dtype=bool)
    smaller[: n - 1] = text[falls[nearest]] < text[falls[nearest] + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = induce(text, smaller, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    stops = np.append(lms[1:] + 1, n)
    powers = Powers()
    stop = np.zeros(n, dtype=np.int64)
    stop[lms] = stops
    hashes = powers.hashes(powers.sums(text), order, stop[order])
    name = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
    ranks = np.zeros(n, dtype=np.int64)
    ranks[order] = name
    ranks, step, m = ranks[lms], 1, len(lms)
    while ranks.max() + 1 < m:
        key = ranks * (m + 1)
        key[: m - step] += ranks[step:] + 1
        at = np.argsort(key, kind="stable")
        ranks[at] = np.concatenate(([0], np.cumsum(key[at][1:] != key[at][:-1])))
        step *= 2
    return induce(text, smaller, lms[np.argsort(ranks)])


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the starts of strings of ``length`` bytes that start elsewhere in the segments, too.

    The common prefix of a suffix with its neighbours in the suffix array, permuted to the
    suffix's place, is needed only up to ``length``: it is told by a hash of that many bytes.
    """
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    text = np.frombuffer(b"\0".join([*segments, b""]), dtype=np.uint8).astype(np.uint16) + np.uint16(2)  # 16 bits are sorted by radix
    begins = np.cumsum(sizes + 1) - sizes - 1
    text[begins + sizes] = 1
    text = np.append(text, np.uint16(0))
    order = suffix_array(text)
    powers = Powers()
    sums = powers.sums(text)
    left = np.zeros(len(text), dtype=np.int64)  # bytes from here to the segment's end
    for begin, size in zip(begins, sizes, strict=True):
        left[begin : begin + size] = np.arange(size, 0, -1)
    whole = order[left[order] >= length]
    common = np.zeros(len(text), dtype=bool)
    if whole.size:
        hashes = powers.hashes(sums, whole, whole + length)
        twin = hashes[1:] == hashes[:-1]
        common[whole[1:][twin]] = True
        common[whole[:-1][twin]] = True
    return [np.flatnonzero(common[b : b + s]) for b, s in zip(begins, sizes, strict=True)]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as [first, last]."""
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(part[0]), int(part[-1])) for part in np.split(starts, cuts)] if starts.size else []


def stretches(data: np.ndarray, offsets: np.ndarray, powers: Powers, length: int = LENGTH, seed: int = SEED_BYTES):
    """(text, start, run, hash of the seed, hash of the stretch) of all texts.

    The seed of a string of ``length`` bytes is its ``seed`` bytes with the least hash, the
    leftmost of equal ones: it follows from the string alone. Neighbouring strings with the same
    seed are one stretch: ``run`` strings from ``start`` on, ``run + length - 1`` bytes. Every string
    of every text lies in exactly one stretch.
    """
    n, width = len(data), length - seed + 1
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    sums = powers.sums(data)
    at = np.arange(n - seed + 1)
    full = powers.hashes(sums, at, at + seed)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = ((full >> bits) << bits) | at.astype(np.uint64)
    reach = 1
    while reach < width:
        more = min(reach, width - reach)
        least = np.minimum(least[: len(least) - more], least[more:])
        reach += more
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the string from each byte on
    sizes = np.diff(offsets)
    room = np.repeat(offsets[1:], sizes)[: len(where)] - np.arange(len(where))
    valid = room >= length
    first = valid.copy()
    first[1:] &= (where[1:] != where[:-1]) | ~valid[:-1] | (room[1:] > room[:-1])
    starts = np.flatnonzero(first)
    ended = np.flatnonzero(valid & ~np.append(valid[1:] & ~first[1:], False))
    runs = ended - starts + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], runs, full[where[starts]], powers.hashes(sums, starts, ended + length)


def _stretch_rows(df: DataFrame, length: int) -> DataFrame:
    """Rows (seed, whole, tkey, dkey, start, run) of all stretches, narrow ones; texts are cut into no pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
                part = batch.slice(low, high - low)
                low = high
                text, start, run, seed, whole = stretches(*text_bytes(part.column("text")), powers, length)
                columns = {"seed": pa.array(seed.view(np.int64)), "whole": pa.array(whole.view(np.int64))}
                columns |= {name: part.column(name).take(pa.array(text)) for name in ("tkey", "dkey")}
                columns |= {"start": pa.array(start), "run": pa.array(run)}
                yield pa.RecordBatch.from_pydict(columns)

    return df.select("text", "tkey", "dkey").mapInArrow(cut, "seed long, whole long, tkey long, dkey long, start long, run long")


def _keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    value = text_of(df, text)
    return df.select(
        df[id].alias("doc_id"), value.alias("text"), F.xxhash64(value).alias("tkey"), F.xxhash64(df[id], F.length(value)).alias("dkey")
    )


def _segments(rows: DataFrame, wanted: DataFrame, length: int, strings: bool) -> DataFrame:
    """The bytes (seed, whole, data) of wanted stretches, or with ``strings`` their strings' hashes (seed, whole, at, string)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: dict[str, list] = {"seed": [], "whole": []} | ({"at": [], "string": []} if strings else {"data": []})
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                data = text.encode()
                for s in own:
                    piece = data[s["start"] : s["start"] + s["run"] + length - 1]
                    if strings:
                        at = np.arange(s["run"])
                        value = np.frombuffer(piece, dtype=np.uint8)
                        hashes = powers.hashes(powers.sums(value), at, at + length).view(np.int64)
                        more = ([s["seed"]] * s["run"], [s["whole"]] * s["run"], at.tolist(), hashes.tolist())
                    else:
                        more = ([s["seed"]], [s["whole"]], [piece])
                    for column, values in zip(out.values(), more, strict=True):
                        column += values
            kinds = {"data": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    own = wanted.groupBy("tkey", "dkey").agg(F.collect_list(F.struct("start", "run", "seed", "whole")).alias("own"))  # of one text
    schema = "seed long, whole long, " + ("at long, string long" if strings else "data binary")
    return rows.join(own, ["tkey", "dkey"]).select("doc_id", "text", "own").mapInArrow(read, schema)


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """(tkey, dkey, spans): for each text the runs of starts of strings that start elsewhere, too.

    Equal strings have the same seed. Seeds that occur once are dropped after counting them.
    Stretches that are equal as a whole are counted before any text is moved, so a group of
    copies leaves one stretch; all its strings are repeated. Different stretches with one seed are
    compared in shards of about SHARD_BYTES, each sorted into a suffix array. The stretches of a
    seed that exceed HOT_BYTES are compared as hashes of their strings instead, counted in tasks
    first, so that no shard grows with a passage that many texts share.
    """
    every = settled(_stretch_rows(rows, length), "every")
    often = every.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    found = settled(every.join(often, "seed", "left_semi"), "stretches")
    place = F.min(F.struct("tkey", "dkey", "start", "run")).alias("one")
    kinds = settled(found.groupBy("seed", "whole").agg(place, F.count("*").alias("n")).select("seed", "whole", "one.*", "n"), "kinds")
    seeds = (
        kinds.groupBy("seed").agg(F.count("*").alias("kinds"), F.sum(F.col("run") + length - 1).alias("bytes")).filter("kinds > 1")
    )
    marked = settled(kinds.join(seeds, "seed").withColumn("hot", F.col("bytes") > HOT_BYTES).drop("bytes", "kinds", "n"), "compared")
    total = marked.filter("NOT hot").agg(F.sum(F.col("run") + length - 1)).head()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def sort(shard: pa.Table) -> pa.Table:
        once: dict[tuple[int, int], bytes] = {}
        for seed, whole, data in zip(*(shard.column(c).to_pylist() for c in ("seed", "whole", "data")), strict=True):
            once[seed, whole] = data
        spans = [(key, span) for key, at in zip(once, repeated_starts(list(once.values()), length), strict=True) for span in _spans(at)]
        values = [[k[0] for k, _ in spans], [k[1] for k, _ in spans], [s[0] for _, s in spans], [s[1] for _, s in spans]]
        return pa.table([pa.array(v, pa.int64()) for v in values], names=["seed", "whole", "first", "last"])

    form = "seed long, whole long, first long, last long"
    cold = _segments(rows, marked.filter("NOT hot"), length, False)
    near = cold.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards))).groupBy("shard").applyInArrow(sort, form)
    if not marked.filter("hot").isEmpty():
        each = settled(_segments(rows, marked.filter("hot"), length, True).distinct(), "strings")
        twice = each.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1")
        near = near.unionByName(each.join(twice, "string").select("seed", "whole", F.col("at").alias("first"), F.col("at").alias("last")))
    copies = kinds.filter("n > 1").select("seed", "whole", F.lit(0).cast("long").alias("first"), (F.col("run") - 1).alias("last"))
    spans = found.select("seed", "whole", "tkey", "dkey", "start").join(near.unionByName(copies), ["seed", "whole"])
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return spans.select("tkey", "dkey", span.alias("span")).groupBy("tkey", "dkey").agg(F.collect_set("span").alias("spans"))  # of one text


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    Each byte is removed that lies in a string of ``length`` bytes which starts anywhere else as
    well, in the same text or another one; strings are those of the input, and overlaps count.
    Matches never cross texts. A null text is empty and keeps nothing; texts shorter than
    ``length`` stay whole. Rows that repeat id and text are copies of each other, so longer ones
    lose all bytes; other columns are ignored; an empty table gives no rows.
    """
    rows = _keyed(df, id, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, kept, at, removed, runs = value.encode(), [], 0, 0, 0
                joined: list[list[int]] = []
                for first, last in sorted((s["first"], s["last"] + length) for s in spans or []):
                    if joined and first <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], last)
                    else:
                        joined.append([first, last])
                for first, stop in joined:
                    kept.append(data[at:first])
                    removed, runs, at = removed + stop - first, runs + 1, stop
                rest = b"".join([*kept, data[at:]])
                for column, v in zip(out, (len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    kind = df.schema[id].dataType.simpleString()
    joined = rows.join(repeats(rows, length), ["tkey", "dkey"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
