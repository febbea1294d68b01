"""Quality rules: base counts, and how far a document's histograms lie from its language's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, let, settled, text_of, words_of

FEW = 24  # repeated windows up to which a search in their list beats sorting
CLASSES = ("lower", "upper", "space", "digit", "symbol", "stop", "other")


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict. Distances are Jensen-Shannon distances, 0 (alike) to 1 (disjoint)."""

    min_words: int = 50
    max_repeated: int = 50  # percent of words in repeated three-word windows
    common: int = 100  # common words compared per language
    class_distance: float = 0.30
    word_spread: float = 2.5  # a text's words may lie so many times (median - lowest tenth) beyond the median
    word_least: float = 0.70  # but need not lie nearer than this, in distances of a text without common words
    word_most: float = 0.95  # nor may they lie further than this
    class_chars: int = 200  # shorter texts say too little about character classes
    word_words: int = 100  # and with fewer words, about common ones
    reference_words: int = 10_000  # a language needs as many to be a reference; else all languages together stand for its classes


RULES = Rules()


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, each with the sum 1; null where one is."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) / 2 + part(b, (a + b) / 2) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _shares(counts: Column) -> Column:
    def shared(made: Column) -> Column:
        total = F.greatest(_sum(made), F.lit(1).cast("long"))
        return let(total, lambda t: F.transform(made, lambda n: n / t))

    return let(counts, shared)


def _classed(df: DataFrame) -> DataFrame:
    """Adds ``classes``, the number of code points by CLASSES; each pass sees what the last one left."""
    rest, counts = df.withColumn("_t0", F.col("text")), []
    for i, chars in enumerate([r"\p{Ll}", r"\p{Lu}", SPACES, "0-9", "#*$%&|<>", r".,;:!?'\"()\-"]):
        rest = rest.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", f"[{chars}]+", ""))
        counts.append((F.length(f"_t{i}") - F.length(f"_t{i + 1}")).cast("long"))
    counts.append(F.length("_t6").cast("long"))
    return rest.withColumn("classes", F.array(*counts)).drop(*[f"_t{i}" for i in range(7)])


def _repeated(words: Column) -> Column:
    """Words in three-word windows found twice or more. Windows are compared by a 64-bit hash."""

    def union(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def placed(found: Column, windows: Column) -> Column:
        marked = F.transform(windows, lambda h, i: F.when(F.array_contains(found, h), i))
        return union(F.filter(marked, lambda i: i.isNotNull()))

    def paired(windows: Column) -> Column:
        def starts(s: Column) -> Column:
            twin = lambda e, j: F.get(s, j)["h"].eqNullSafe(e["h"])
            marked = F.transform(s, lambda e, j: F.when(twin(e, j - 1) | twin(e, j + 1), e["i"]))
            return F.filter(marked, lambda i: i.isNotNull())

        return union(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts))

    def covered(windows: Column) -> Column:
        """A few repeated windows are looked up one by one, many by sorting with their places."""
        again = let(F.sort_array(windows), lambda s: F.filter(s, lambda h, i: F.get(s, i + 1).eqNullSafe(h)))
        return let(
            F.array_distinct(again),
            lambda found: F.when(F.size(found) <= FEW, placed(found, windows)).otherwise(paired(windows)),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    count = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) < 4, 0).otherwise(count)


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def references(df: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = RULES) -> DataFrame:
    """One row per language: lang, ref_classes, common, ref_words, ref_none.

    Counted over all rows: the shares of character classes, and the language's most frequent
    words with their shares, all other words counting as one. A language with too few words
    has the shares of all languages together as its classes, and null as its words. Words are named by a
    hash and lie in its order. ``ref_none`` is the distance of a text without any of them. Null is a language, too.
    """
    rows = df.select(df[lang].alias("lang"), text_of(df, text).alias("text"))
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    classes = settled(_classed(rows).groupBy("lang").agg(*sums), "classes")
    names = [f"c{i}" for i in range(len(CLASSES))]
    pooled = classes.agg(_shares(F.array(*[F.sum(n) for n in names])).alias("pooled")).scalar()
    classes = classes.select("lang", _shares(F.array(*names)).alias("own"), pooled.alias("pooled"))
    counted = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = settled(counted.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    totals = counts.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("total"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= rules.common).withColumn("key", _word_key(F.col("word")))
    lists = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("top"))
    rest = F.col("total") - F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    shares = F.concat(F.transform("top", lambda x: x["n"] / F.col("total")), F.array(rest / F.col("total")))
    lists = lists.join(totals, F.col("lang").eqNullSafe(F.col("_lang"))).filter(F.col("total") >= rules.reference_words)
    lists = lists.select("_lang", F.transform("top", lambda x: x["key"]).alias("common"), shares.alias("ref_words"))
    empty = F.transform("ref_words", lambda x, i: F.when(i == F.size("ref_words") - 1, 1.0).otherwise(0.0))
    lists = lists.withColumn("ref_none", _js(empty, F.col("ref_words")))
    found = classes.join(lists, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    ref = F.when(F.col("common").isNotNull(), F.col("own")).otherwise(F.col("pooled"))
    return found.select("lang", ref.alias("ref_classes"), "common", "ref_words", "ref_none")


def judge(
    df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = RULES
) -> DataFrame:
    """Every row's base counts and verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance.

    ``kept`` is false where the base rules fail, or where the histogram of character classes or of
    common words lies too far from that of the row's language. ``rules`` bound the first. How far
    the words of a text lie hangs on its length, so they are bound by the distances, as parts of
    ``ref_none``, of all texts that pass the base rules and have as many words but for a factor of
    two: by their median and lowest tenth, which a lesser share of junk hardly moves. A distance is
    null, and says nothing, where the text is too short for it; the words' one also where the
    language has too few words, whose classes are then held against those of all languages. A null text has no words. Repeated rows, rows without id and other columns
    change nothing; an empty table gives no rows. References come from all rows; a document is
    looked at within its row, so no text is shuffled. The references, a row per language, and the
    counts and distances, without text, are written first.
    """
    known = settled(references(df, text, lang, rules), "references").withColumnRenamed("lang", "_lang")
    rows = df.select(df[id].alias("doc_id"), df[lang].alias("lang"), text_of(df, text).alias("text"))
    rows = _classed(rows).withColumn("words", words_of(F.col("text")))
    base = rows.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.col("classes")[2]).cast("long").alias("word_chars"),
        F.col("classes")[4].alias("n_symbols"),
        _repeated_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.when(
            F.length("text") >= rules.class_chars, _js(_shares(F.col("classes")), F.col("ref_classes"))
        ).alias("class_distance"),
        F.when(
            F.size("words") >= rules.word_words, _js(_word_shares(F.col("words"), F.col("common")), F.col("ref_words"))
        ).alias("word_distance"),
        "ref_none",
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words")
    )
    base = base.withColumn("base_failed", failed).withColumn("part", F.round(F.col("word_distance") / F.col("ref_none"), 3))
    base = settled(base.withColumn("_length", F.floor(F.log2("n_words")).cast("int")), "judged")
    bounds = base.filter("NOT base_failed AND part IS NOT NULL").groupBy(F.col("_length").alias("_of"))
    bounds = bounds.agg(F.percentile("part", F.array(F.lit(0.1), F.lit(0.5))).alias("q"))
    top = F.col("q")[1] + rules.word_spread * (F.col("q")[1] - F.col("q")[0])
    bounds = bounds.select("_of", F.least(F.lit(rules.word_most), F.greatest(F.lit(rules.word_least), top)).alias("bound"))
    base = base.join(F.broadcast(bounds), F.col("_length") == F.col("_of"), "left")
    far = (F.col("class_distance") > rules.class_distance) | (F.col("part") > F.col("bound"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return base.select(
        *names,
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        "class_distance",
        "word_distance",
    )


def _word_key(word: Column) -> Column:
    """A hash of a word whose last two bits are free."""
    return F.xxhash64(word).bitwiseAND(F.lit(-4).cast("long"))


def _word_shares(words: Column, common: Column) -> Column:
    """Shares of the common words, given as keys in order, and of all other words.

    One sort counts them all: each common key is put in as a mark before its words and one behind them.
    """
    marks = F.flatten(F.transform(common, lambda c: F.array(c, c + 2)))
    ordered = F.sort_array(F.concat(marks, F.transform(words, lambda w: _word_key(w) + 1)))

    def between(places: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(common) - 1), lambda j: (F.get(places, 2 * j + 1) - F.get(places, 2 * j) - 1).cast("long"))
        return let(each, lambda n: F.concat(n, F.array(F.size(words) - _sum(n))))

    placed = F.transform(ordered, lambda e, i: F.when(e.bitwiseAND(F.lit(1).cast("long")) == 0, i))
    return _shares(let(F.filter(placed, lambda i: i.isNotNull()), between))
