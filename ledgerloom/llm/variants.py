"""Spelling variants by a variable-length gram index: words one edit apart, grouped under their commonest form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from math import ceil, floor, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled
from ledgerloom.operators.spread import lookup_join

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of lower-cased UTF-8; U+00C0 to U+00FF begin with C3
NOISE = 97  # every so many runs lose a code point
LEAST_LETTERS = 5
LEAST_COUNT = 3
TIMES = 2  # a form is so many times as frequent as its variant
GRAM = 2  # letters of the shortest gram
MOST = 8  # letters of the longest gram
RARE = 200  # a gram that starts at no more places is not extended
GRAMS = 200_000  # most frequent grams that the dictionary may hold
CHUNK = 300_000  # different words or grams that a task counts before it sends them on
END = "$"  # behind the last letter


def words(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts, as ``group`` defines them."""
    lower = bytes.maketrans(UPPER, LOWER)

    def result(run: bytes, crc: int) -> str | None:
        letters = run.decode()
        if crc % NOISE == 0:
            at = crc % len(letters)
            letters = letters[:at] + letters[at + 1 :]
        return letters if len(letters) >= LEAST_LETTERS else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for name, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUNS.findall(value.encode().translate(lower))).items():
                    if len(run) >= LEAST_LETTERS:
                        crc = zlib.crc32(run, start)
                        if crc % NOISE:
                            found[run] += n
                        elif (word := result(run, crc)) is not None:
                            found[word.encode()] += n
                if len(found) > CHUNK:
                    yield sent(found)
                    found = Counter()
        yield sent(found)

    def sent(found: Counter) -> pa.RecordBatch:
        kept = [(w.decode(), n) for w, n in found.items()]
        kept = [(w, n) for w, n in kept if len(w) >= LEAST_LETTERS]
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    rows = df.select(F.coalesce(df[id].cast("string"), F.lit("")).alias("id"), df[text].alias("text"))
    counted = rows.filter(F.col("text").isNotNull()).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_dictionary(vocabulary: DataFrame, rare: int = RARE, most: int = GRAMS) -> dict[str, int]:
    """The grams of GRAM to MOST - 1 letters that start at more than ``rare`` places, with their number.

    Such a gram is always extended by a letter; all others are left out, as none reaches them. Every
    place starts one gram of each length, so a bound of ``places * lengths / most`` or more keeps
    the dictionary within ``most`` grams, however many words there are; ``rare`` rises to that.
    """
    total = vocabulary.agg(F.sum(F.length("word"))).head()[0] or 0
    least = max(rare, ceil(total * (MOST - GRAM) / most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                whole = word + END
                found.update([whole[p : p + k] for k in range(GRAM, MOST) for p in range(max(0, len(whole) - k + 1))])
                if len(found) > CHUNK:
                    yield sent(found)
                    found = Counter()
        yield sent(found)

    def sent(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"gram": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counts = vocabulary.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.filter(F.col("n") > least).collect()}  # at most ``most`` rows


def longest(letters: int) -> int:
    """Letters that a gram may have in the class of words with so many letters, and of those with one more."""
    return min(MOST, ceil(letters / 2))


def decompose(word: str, letters: int, frequent: Mapping[str, int]) -> list[str]:
    """The gram at each letter of a word in the class ``letters``: the shortest that is not
    frequent, if the word and the longest gram of the class go so far.

    A gram hangs on its own letters alone: an edit elsewhere leaves it as it is.
    """
    whole, most = word + END, longest(letters)
    grams = []
    for p in range(len(word)):
        k = GRAM
        while k < most and p + k < len(whole) and whole[p : p + k] in frequent:
            k += 1
        grams.append(whole[p : p + k])
    return grams


def merged_lists(grams: list[str], frequent: Mapping[str, int]) -> list[int]:
    """The grams whose lists of words have to be merged to miss no word one edit away.

    An edit affects the grams that cover its place. Two grams that share no letter are never
    affected both, so the word shares at least 2 - 1 of them with any near word: the bound of
    affected grams for just those two. Of all such pairs that with the shortest lists is taken.
    """
    cost = [frequent.get(g, RARE * 4.0 ** -max(0, len(g) - 3)) for g in grams]
    best, first = None, (float("inf"), -1)
    ending: dict[int, list[int]] = {}
    for p, g in enumerate(grams):
        ending.setdefault(p + len(g), []).append(p)
    for p in range(len(grams)):
        for q in ending.get(p, []):
            first = min(first, (cost[q], q))
        if first[1] >= 0 and (best is None or first[0] + cost[p] < best[0]):
            best = first[0] + cost[p], first[1], p
    return [best[1], best[2]] if best else list(range(len(grams)))


def gram_lists(vocabulary: DataFrame, frequent: Mapping[str, int], probes: bool) -> DataFrame:
    """(word, n, longer, class, place, gram): the index of all grams, or with ``probes`` the lists that each word merges.

    A class holds the words of so many letters, and those with one more (``longer``), whose grams
    stand at their place from the front and from the back: without the added letter they are there.
    """
    dictionary = vocabulary.sparkSession.sparkContext.broadcast(dict(frequent))  # at most GRAMS short strings

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in batches:
            rows: list[tuple] = []
            for i, word in enumerate(batch.column("word").to_pylist()):
                size = len(word)
                grams = decompose(word, size, known)
                if probes:
                    rows += [(i, False, size, p, grams[p]) for p in merged_lists(grams, known)]
                    continue
                rows += [(i, False, size, p, g) for p, g in enumerate(grams)]
                if size > LEAST_LETTERS:
                    shorter = grams if longest(size - 1) == longest(size) else decompose(word, size - 1, known)
                    rows += [(i, True, size - 1, p, g) for p, g in enumerate(shorter)]
                    rows += [(i, True, size - 1, p - 1, g) for p, g in enumerate(shorter) if p]
            at, longer, sizes, places, grams = zip(*rows, strict=True) if rows else ((),) * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word").take(at), "n": batch.column("n").take(at), "longer": pa.array(longer, pa.bool_()),
                "class": pa.array(sizes, pa.int32()), "place": pa.array(places, pa.int32()), "gram": pa.array(grams, pa.string()),
            })

    return vocabulary.select("word", "n").mapInArrow(cut, "word string, n long, longer boolean, class int, place int, gram string")


def near_pairs(vocabulary: DataFrame, frequent: Mapping[str, int]) -> DataFrame:
    """(word, near, n_near_word): both directions of all pairs of words one edit apart; a pair may come twice.

    A word looks for those of its own length and those with one letter more; what its lists hold
    is verified. The lists lie in the shuffle by class, place and gram, so none is longer than
    the words of one length that share the gram at one place.
    """
    key = F.xxhash64("class", "place", "gram").alias("key")
    lists = gram_lists(vocabulary, frequent, False).select(key, F.col("word").alias("b"), F.col("n").alias("bn"), "longer")
    asked = gram_lists(vocabulary, frequent, True).select(key, F.col("word").alias("a"), F.col("n").alias("an"))
    met = asked.join(lists, "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    there = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m"), F.col("an").alias("n"))
    back = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m"), F.col("bn").alias("n"))
    return met.select(F.inline(F.when(F.col("longer"), F.array(there, back)).otherwise(F.array(there))))


def roots(forms: DataFrame, longest_chain: int) -> DataFrame:
    """(word, root) for the rows (word, form) of a forest: forms followed to the last.

    Each round doubles the way that a row has gone; rows known to have arrived are joined no
    more, and a form of very many words is salted.
    """
    ways = settled(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("over")), "ways")
    for _ in range(ceil(log2(max(2, longest_chain)))):
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("over").alias("last"))
        gone = lookup_join(ways.filter("NOT over").drop("over"), onward, ["root"], "left", ["word"])
        over = F.col("next").isNull() | F.col("last")
        gone = gone.select("word", F.coalesce("next", "root").alias("root"), over.alias("over"))
        ways = settled(ways.filter("over").unionByName(gone), "ways")
    return ways.select("word", "root")


def group(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their near words, forms and roots: word, form, root, n, n_near, form_n.

    Runs ``[A-Za-z\\u00C0-\\u00FF]+`` are taken with A-Z in lower case; of every NOISE-th, told by the
    CRC-32 of id and run, a code point is deleted. Words are the results of LEAST_LETTERS
    code points or more that occur LEAST_COUNT times or more; near words differ by one inserted,
    deleted or replaced code point. A word's form is its most frequent near word (of equals the
    first in code-point order) if that is TIMES as frequent or more, else null; the root is where
    forms lead, the word itself if it has none.

    A null text has no words, a row without id an empty one; repeated rows count each; an empty table
    gives no rows; other columns play no part. Texts and words of any length are taken whole.
    """
    vocabulary = settled(words(df, id, text), "vocabulary")
    pairs = near_pairs(vocabulary, gram_dictionary(vocabulary))
    once = pairs.repartition("word").groupBy("word", "near", "m", "n").agg(F.lit(1).alias("one"))
    best = F.min(F.struct(-F.col("m"), F.col("near"))).alias("best")
    found = once.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    form = F.when(-F.col("best.col1") >= TIMES * F.col("n"), F.col("best.near"))
    near = settled(found.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.col1")).alias("form_n")), "near")
    most = vocabulary.agg(F.max("n")).head()[0] or LEAST_COUNT
    chain = floor(log2(most / LEAST_COUNT)) + 1  # each form is twice as frequent as the word before
    ends = roots(near.filter("form IS NOT NULL"), chain)
    return vocabulary.join(near, "word", "left").join(ends, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form_n",
    )


SQL = r"""
    WITH t AS (
        SELECT list_transform(range(256), lambda b: list_reduce(range(8),
                   lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc),
    r AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS doc,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents),
    d AS (SELECT doc, run, count(*) AS n FROM r GROUP BY 1, 2),
    b AS (
        SELECT run, n, list_transform(string_split(doc || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS code FROM d),
    h AS (
        SELECT run, n, xor(list_reduce(
                   flatten(list_transform(code, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)),
                   lambda s, x: xor(s >> 8, t.crc[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) AS h
        FROM b, t),
    w AS (
        SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
    k AS (SELECT word, n, length(word) AS size, unnest(range(1, length(word) + 1)) AS pos FROM v),
    g AS (SELECT word, n, size, pos, word[1:pos - 1] || word[pos + 1:] AS rest FROM k),
    e AS (
        SELECT a.word, a.n, b.word AS near, b.n AS m
        FROM g a JOIN g b ON a.size = b.size AND a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT g.word, g.n, v.word, v.n FROM g JOIN v ON v.word = g.rest
        UNION SELECT v.word, v.n, g.word, g.n FROM g JOIN v ON v.word = g.rest),
    f AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m, max(m) >= 2 * any_value(n) AS fits
        FROM e GROUP BY 1),
    c AS (
        SELECT v.word, CASE WHEN fits THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN fits THEN m END AS form_n
        FROM v LEFT JOIN f USING (word)),
    z AS (
        WITH RECURSIVE z AS (
            SELECT word, form AS root FROM c WHERE form IS NOT NULL
            UNION ALL SELECT z.word, c.form FROM z JOIN c ON z.root = c.word WHERE c.form IS NOT NULL)
        SELECT word, arg_max(root, n) AS root FROM z JOIN (SELECT word AS root, n FROM v) USING (root) GROUP BY 1)
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM c LEFT JOIN z USING (word)
    """
