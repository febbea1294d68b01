"""Language ID: unigram piece models per language, summed over all segmentations of a word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of
from ledgerloom.llm.hashing import FACTOR, SPACE, SPREAD, Powers, text_bytes, words

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE = 1000  # rows to learn from per language, about
SMOOTHING = 0.1  # added to each piece's count
CHUNK = 2 * 2**20  # bytes of text looked at together
SLOT_BITS = 20
RESCALE = 16  # bytes after which long words are scaled, so that no probability vanishes
GROUP = 20_000  # words whose sums are made together


def pieces(path: str = VOCABULARY) -> list[tuple[int, bytes]]:
    """(id, bytes) of the vocabulary's pieces: a blank begins a word, and single bytes cover all."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        name = model.id_to_piece(i)
        data = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        if not model.is_byte(i) or data not in found:
            found[data] = i
    return [(i, data) for data, i in found.items()]


class Trie:
    """All beginnings of pieces in a hash table that numpy looks up many at a time."""

    def __init__(self, path: str = VOCABULARY) -> None:
        nodes: dict[bytes, int] = {}
        for i, data in pieces(path):
            for k in range(1, len(data)):
                nodes.setdefault(data[:k], -1)
            nodes[data] = i
        n = len(nodes)
        self.longest = max(map(len, nodes))
        self.keys = np.zeros(n + 1, dtype=np.uint64)
        self.piece = np.array([*nodes.values(), -1], dtype=np.int32)
        with np.errstate(over="ignore"):
            for at, data in enumerate(nodes):
                h = np.uint64(0)
                for byte in data:
                    h = h * FACTOR + np.uint64(byte + 1)
                self.keys[at] = h
            slots = self.slot(self.keys[:n])
        self.first = np.full(1 << SLOT_BITS, n, dtype=np.int32)
        self.next = np.full(n + 1, n, dtype=np.int32)
        for at, slot in enumerate(slots):
            self.next[at], self.first[slot] = self.first[slot], at
        self.none = n

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * SPREAD) >> np.uint64(64 - SLOT_BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The node of each hash, or ``none``."""
        at = self.first[self.slot(hashes)]
        wrong = np.flatnonzero((self.keys[at] != hashes) & (at != self.none))
        while wrong.size:
            at[wrong] = self.next[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != hashes[wrong]) & (at[wrong] != self.none)]
        return at


@dataclass(frozen=True)
class Model:
    """Languages, and the probability of each piece (rows) in each of them (columns)."""

    langs: tuple[str, ...]
    chances: np.ndarray


def word_scores(spelt: np.ndarray, trie: Trie, chances: np.ndarray) -> np.ndarray:
    """Log-probabilities (word, language) of words of one length, given as rows of bytes.

    The forward algorithm: what ends at a byte is the sum, over all pieces that end there, of
    what ended where the piece begins times the piece's probability.
    """
    n, length = spelt.shape
    ending = np.zeros((length + 1, n, chances.shape[1]))
    ending[0] = 1.0
    logs = np.zeros((n, chances.shape[1]))
    bytes_ = np.ascontiguousarray(spelt.T).astype(np.uint64) + np.uint64(1)
    for i in range(length):
        if i and i % RESCALE == 0:
            scale = ending[i].copy()
            ending[i : i + trie.longest + 1] /= scale
            logs += np.log(scale)
        live, hashes, begun = None, np.zeros(n, dtype=np.uint64), ending[i]
        for m in range(1, min(trie.longest, length - i) + 1):
            data = bytes_[i + m - 1]
            hashes = hashes * FACTOR + (data if live is None else data[live])
            node = trie.find(hashes)
            known = np.flatnonzero(node != trie.none)
            if known.size < node.size:
                live = known if live is None else live[known]
                hashes, node = hashes[known], node[known]
            if not node.size:
                break
            piece = trie.piece[node]
            whole = np.flatnonzero(piece >= 0)
            rows = whole if live is None else live[whole]
            ending[i + m][rows] += begun[rows] * chances[piece[whole]]
    return logs + np.log(ending[length])


def text_scores(data: np.ndarray, offsets: np.ndarray, trie: Trie, chances: np.ndarray, powers: Powers):
    """(scores by text and language, words by text) of texts that lie in ``data`` one after another."""
    texts = len(offsets) - 1
    totals, counts = np.zeros((texts, chances.shape[1])), np.zeros(texts, dtype=np.int64)
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    low = 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        while high < len(data) and not (SPACE[data[high]] or fresh[high]):  # never inside a word
            more = np.flatnonzero(SPACE[data[high : high + CHUNK]] | fresh[high : min(high + CHUNK, len(data))])
            high = high + int(more[0]) if more.size else min(len(data), high + CHUNK)
        part = data[low:high]
        starts, stops = words(part, fresh[low : high + 1])
        if starts.size:
            hashes = powers.hashes(powers.sums(part), starts, stops)
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            scores = np.empty((first.size, chances.shape[1]))
            lengths = (stops - starts)[first]
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for same in np.split(order, cuts):
                size = int(lengths[same[0]])
                for k in range(0, same.size, step := max(1, min(GROUP, 2**21 // (size + 1)))):
                    own = same[k : k + step]
                    spelt = np.empty((own.size, size + 1), dtype=np.uint8)
                    spelt[:, 0] = 32
                    spelt[:, 1:] = part[starts[first[own]][:, None] + np.arange(size)]
                    scores[own] = word_scores(spelt, trie, chances)
            text = np.searchsorted(offsets, starts + low, side="right") - 1
            counts += np.bincount(text, minlength=texts)
            each = scores[which]
            for lang in range(chances.shape[1]):
                totals[:, lang] += np.bincount(text, weights=each[:, lang], minlength=texts)
        low = high
    return totals, counts


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, path: str = VOCABULARY) -> Model:
    """Learns from about ``sample`` rows per language, those whose text's hash is lowest.

    The pieces of a row are those of the vocabulary's own segmentation. Counts are made in tasks
    and summed by (language, piece); the driver gets those sums, at most languages times pieces.
    Rows without text or language are left out.
    """
    rows = df.select(df[text].alias("text"), df[lang].alias("lang")).dropna()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    size = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    if not langs:
        return Model((), np.zeros((size, 0)))
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col("lang") == name, F.lit(sample / sizes[name])).otherwise(share)
    drawn = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(2**53))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for own, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for piece, n in Counter(model.encode(" ".join(value.split()))).items():
                    found[own, piece] += n
        if found:
            keys = list(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [k[0] for k in keys],
                    "piece": pa.array([k[1] for k in keys], pa.int32()),
                    "n": pa.array([found[k] for k in keys], pa.int64()),
                }
            )

    counted = rows.filter(drawn < share).mapInArrow(count, "lang string, piece int, n long")
    counts = np.full((size, len(langs)), SMOOTHING)
    for r in counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        counts[r["piece"], langs.index(r["lang"])] += r["n"]
    return Model(langs, counts / counts.sum(axis=0))


def predict(df: DataFrame, model: Model, text: str = "text", path: str = VOCABULARY, **keep: str) -> DataFrame:
    """``lang_pred`` and ``score`` of every row, next to the columns named in ``keep`` (new name = column).

    The score is the chance of the language among those learned, with the log-probabilities
    divided by the square root of the number of words, as words are not independent. ``und``
    with score 0 stands for a null text, one without letters, or where no language was learned.
    Whole texts are scored, CHUNK bytes at a time; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x pieces numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie, powers = shared.value, Trie(path), Powers()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            texts = len(offsets) - 1
            named = np.full(texts, "und", dtype=object)
            chance = np.zeros(texts)
            if known.langs:
                totals, counts = text_scores(data, offsets, trie, known.chances, powers)
                even = totals / np.sqrt(np.maximum(counts, 1))[:, None]
                even = np.exp(even - even.max(axis=1, keepdims=True))
                best = even.argmax(axis=1)
                usable = np.asarray(batch.column("usable").to_pylist(), dtype=bool)
                named[usable] = np.array(known.langs, dtype=object)[best[usable]]
                chance[usable] = (even.max(axis=1) / even.sum(axis=1))[usable]
            columns = {name: batch.column(name) for name in keep}
            columns |= {"lang_pred": pa.array(named, pa.string()), "score": pa.array(chance)}
            yield pa.RecordBatch.from_pydict(columns)

    usable = F.coalesce(df[text].rlike(r"\p{L}"), F.lit(False)).alias("usable")
    kinds = "".join(f"{new} {df.schema[old].dataType.simpleString()}, " for new, old in keep.items())
    rows = df.select(text_of(df, text).alias("text"), usable, *[df[old].alias(new) for new, old in keep.items()])
    return rows.mapInArrow(score, f"{kinds}lang_pred string, score double")


def held_out(df: DataFrame, id: str = "doc_id"):
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(df[id].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred and score; learned from rows with a language that are not held out.

    A row without id is neither held out nor learned from. Repeated rows and other columns change
    nothing; the empty table gives no rows.
    """
    train = df.filter(~held_out(df, id) & df[id].isNotNull())
    marked = df.select(df[id].alias("doc_id"), held_out(df, id).alias("held_out"), df[text].alias("text"))
    return predict(marked, fit(train, text, lang, sample), "text", doc_id="doc_id", held_out="held_out")
