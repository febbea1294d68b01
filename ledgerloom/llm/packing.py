"""Best-fit packing: bin completion over the counts of piece lengths, then places by rank."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled, text_of

CAPACITY = 1024
END = 2  # the id after each document
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json as ranks
ADDED, ADDED_ID = "<|endoftext|>", 50256  # the added token of byte_bpe_50k.json, which no rank has
CACHE = 400_000  # word ids kept per task
NODES = 4_000  # branches that the search looks at, at most
SETS = 300  # sets looked at for a node's fillings, at most
WIDTH = 4  # fillings tried at a node, best first
RANK_ROWS = 50_000  # rows that are numbered together, about


class Ids(dict):
    """Ids of a word with the blank before it, as little-endian 32-bit numbers, made once."""

    def __init__(self, path: str = RANKS) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.double = re.compile(r"\s\s|^\s|\s$")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        made = self[word] = self.whole(" " + word)
        return made

    def whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def of(self, text: str) -> bytes:
        """Ids of a text. Where no two spaces meet, a blank always begins a new pre-token, so the
        text's ids are those of its parts between blanks."""
        if self.double.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join([self[word] for word in rest])

    def document(self, text: str) -> bytes:
        """Ids of a text as tokenizers makes them: the added token stands for its literal and parts the text."""
        if ADDED not in text:
            return self.of(text)
        return array("I", [ADDED_ID]).tobytes().join([self.of(part) for part in text.split(ADDED)])


def pieces(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every row's token ids, cut to ``capacity``.

    Only longer documents are cut; the first piece takes what is left over, the others are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        tail = array("I", [end]).tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for at, value in enumerate(batch.column("text").to_pylist()):
                data = ids.document(value) + tail
                n = len(data) // 4
                stops = range(n % capacity or capacity, n + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    for column, v in zip(
                        rows, (at, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True
                    ):
                        column.append(v)
                    start = stop
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(rows[0], pa.int64())),
                    "piece": pa.array(rows[1], pa.int32()),
                    "start": pa.array(rows[2], pa.int64()),
                    "length": pa.array(rows[3], pa.int64()),
                    "ids_crc32": pa.array(rows[4], pa.int64()),
                }
            )

    kind = df.schema[id].dataType.simpleString()
    rows = df.select(df[id].alias("doc_id"), text_of(df, text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Filling = tuple[int, ...]  # lengths of one sequence, longest first


@dataclass
class Plan:
    """Fillings and how many sequences take each."""

    fillings: list[tuple[Filling, int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def _take(left: dict[int, int], filling: Filling) -> int:
    """Takes a filling out of the counts as often as they allow; returns how often."""
    times = min(left[size] // filling.count(size) for size in set(filling))
    for size in set(filling):
        left[size] -= times * filling.count(size)
        if not left[size]:
            del left[size]
    return times


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit on counts: behind the longest piece always the longest one that still fits."""
    left, out = dict(counts), []
    order = sorted(left, reverse=True)
    while left:
        room, filling = capacity, []
        used: dict[int, int] = {}
        for size in order:
            while size <= room and left.get(size, 0) > used.get(size, 0):
                filling.append(size)
                used[size] = used.get(size, 0) + 1
                room -= size
        out.append((tuple(filling), _take(left, tuple(filling))))
        order = [size for size in order if size in left]
    return Plan(out)


def _dominates(large: Filling, small: Filling) -> bool:
    """Whether ``small`` can be dealt out to bins of the sizes in ``large``."""
    if sum(small) > sum(large):
        return False

    def deal(rest: Filling, rooms: tuple[int, ...]) -> bool:
        if not rest:
            return True
        return any(
            deal(rest[1:], rooms[:i] + (room - rest[0],) + rooms[i + 1 :])
            for i, room in enumerate(rooms)
            if rest[0] <= room and room not in rooms[:i]
        )

    return deal(small, large)


def completions(counts: dict[int, int], longest: int, capacity: int, width: int = WIDTH, most: int = SETS) -> list[Filling]:
    """Undominated fillings around one piece of the longest length, fullest first.

    A single piece that fills the rest exactly dominates all others, so it is the only one then.
    Otherwise sets are built longest first; only those with a larger sum than the longest single
    piece that fits can be undominated. ``most`` bounds the sets looked at, ``width`` those
    returned; the best-fit filling is always among the sets.
    """
    left = dict(counts)
    left[longest] -= 1
    room = capacity - longest
    sizes = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
    if not sizes:
        return [(longest,)]
    if sizes[0] == room:
        return [(longest, room)]
    found: list[Filling] = []
    looked = exact = 0

    def full(chosen: list[int], space: int) -> bool:
        for size in reversed(sizes):
            if size > space:
                return True
            if left[size] > chosen.count(size):
                return False
        return True

    def grow(chosen: list[int], at: int, space: int) -> None:
        nonlocal looked, exact
        closed = True
        for i in range(at, len(sizes)):
            size = sizes[i]
            if looked >= most or exact >= width:
                break
            if size <= space and left[size] > chosen.count(size):
                closed = False
                looked += 1
                grow([*chosen, size], i, space - size)
        if closed and chosen and full(chosen, space):
            found.append(tuple(chosen))
            exact += space == 0

    grow([], 0, room)
    found.sort(key=lambda f: (-sum(f), len(f), tuple(-s for s in f)))
    kept: list[Filling] = []
    for filling in found:
        if len(kept) == width:
            break
        if not any(_dominates(other, filling) for other in kept):
            kept.append(filling)
    return [(longest, *filling) for filling in kept]


def search(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fewest sequences found by bin completion with branch and bound.

    At each node the longest piece left is completed in every undominated way, and the filling
    is taken as often as the counts allow: the counts of ``capacity`` lengths bound the depth,
    not the number of documents. A branch is pruned when its sequences and those that the rest
    needs at least reach the best plan known, i.e. when its waste is more than a better plan can
    have. Best-fit from the root and from each node of the first descent is the first such plan;
    the search ends at the lower bound or after ``nodes`` branches.
    """
    counts = {size: n for size, n in counts.items() if n}
    tokens = sum(size * n for size, n in counts.items())
    least = max(-(-tokens // capacity), sum(n for size, n in counts.items() if 2 * size > capacity))
    best = best_fit(counts, capacity)
    looked = 0
    stack = [(counts, tokens, (), 0)]  # what is left, its tokens, the fillings so far as nested pairs, their sequences
    while stack and best.sequences > least and looked < nodes:
        left, rest, done, used = stack.pop()
        looked += 1
        if used + -(-rest // capacity) >= best.sequences:
            continue
        if not left:
            best = Plan(_listed(done))
            continue
        if looked % 64 == 1:
            ended = best_fit(left, capacity)
            if used + ended.sequences < best.sequences:
                best = Plan(_listed(done) + ended.fillings)
        branches = []
        for filling in completions(left, max(left), capacity):
            after = dict(left)
            times = _take(after, filling)
            branches.append((after, rest - times * sum(filling), (done, (filling, times)), used + times))
        stack += reversed(branches)  # the fullest filling is looked at first
    return best


def _listed(done: tuple) -> list[tuple[Filling, int]]:
    out = []
    while done:
        done, last = done
        out.append(last)
    return out[::-1]


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, each, offset): the pieces of a length with ranks from low to
    before high go to sequences from ``sequence`` on, ``each`` to one, from ``offset`` on."""
    out, begun, sequence = [], {}, 0
    for filling, times in plan.fillings:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            each = filling.count(size)
            low = begun.get(size, 0)
            begun[size] = low + each * times
            out.append((size, low, low + each * times, sequence, each, offset))
            offset += each * size
        sequence += times
    return out


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts become token ids once; the pieces' lengths are counted, and only these counts, at most
    ``capacity`` numbers, are planned on the driver. Pieces of one length are interchangeable, so a
    piece's sequence follows from its rank among them. Ranks are made in two steps, inside blocks
    of about RANK_ROWS rows dealt by a hash and over the blocks' counts, so that no length meets
    in one task. The plan has a row per filling and length and is broadcast: its size is bound
    by ``capacity`` and the fillings, not by the input.

    A null or empty text is the one end id. Repeated rows are packed each; rows without id too;
    other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    made = settled(pieces(df, id, text, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    plan = spark.createDataFrame(
        places(search(counts, capacity, nodes)),
        "_length long, low long, high long, sequence long, each long, at long",
    )
    blocks = max(1, -(-sum(counts.values()) // RANK_ROWS))
    keyed = made.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(inside) - 1).join(firsts, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place"))
    hit = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(plan), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
