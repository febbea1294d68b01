"""Spelling variants against brute force: every word with every other."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(short, long)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    n = counted(rows)
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(others[w]), None if form[w] is None else n[form[w]]) for w in n}


def mixed_texts(seed, docs):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 11))) for _ in range(60)]
    base += ["x" * k for k in range(4, 12)] + ["abab" * k for k in (2, 3)] + ["z" * 900, "z" * 901]
    rows = [(i, " ".join(edited(r, r.choice(base)) for _ in range(r.randint(0, 60)))) for i in range(docs)]
    return [*rows, (None, "Repeat repeat repeaT repeats"), (None, None), (3, ""), (3, "Éteint éteint × ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷"), (4, "Lines lines-lines_lines lineß " * 5)]


def edited(r, word):
    kind, at = r.choice(["", "", "insert", "delete", "replace", "upper"]), r.randrange(len(word))
    if kind == "insert":
        return word[:at] + r.choice("abcdeéß") + word[at:]
    if kind == "delete":
        return word[:at] + word[at + 1 :]
    if kind == "replace":
        return word[:at] + r.choice("abcdeéß") + word[at + 1 :]
    return word.upper().replace("É", "é") if kind else word


@pytest.mark.parametrize(("seed", "rare", "most"), [(1, 200, 200_000), (2, 1, 200_000), (3, 5, 40)])
def test_against_brute_force(spark, monkeypatch, seed, rare, most):
    monkeypatch.setattr(variants, "CHUNK", 50)
    grams = variants.gram_dictionary
    monkeypatch.setattr(variants, "gram_dictionary", lambda v: grams(v, rare, most))
    rows = mixed_texts(seed, 200)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = variants.group(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows)


def test_lists_share_a_gram_with_every_near_word():
    """Whatever the dictionary, one of a word's two lists has each word one edit away, at its place."""
    r = random.Random(4)
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randint(5, 18)))
        frequent = {"".join(r.choice("abc") for _ in range(k)): 1000 for k in (2, 3, 4, 5) for _ in range(3**k // r.choice([1, 2, 9]))}
        frequent = {g: n for g, n in frequent.items() if len(g) == 2 or g[:-1] in frequent}
        grams = variants.decompose(word, len(word), frequent)
        lists = [(p, grams[p]) for p in variants.merged_lists(grams, frequent)]
        assert len(lists) == 2 and lists[0][0] + len(lists[0][1]) <= lists[1][0]
        at = r.randrange(len(word) + 1)
        longer = word[:at] + r.choice("abc") + word[at:]
        own = variants.decompose(longer, len(word), frequent)
        assert any((p, g) in lists or (p - 1, g) in lists for p, g in enumerate(own))
        at = r.randrange(len(word))
        same = word[:at] + "c" + word[at + 1 :]
        assert any((p, g) in lists for p, g in enumerate(variants.decompose(same, len(word), frequent)))


def test_the_dictionary_keeps_its_bound(spark):
    rows = [("".join(p), 3) for p in product("abcdef", repeat=5)]
    vocabulary = spark.createDataFrame(rows, "word string, n long")
    for most in (10, 500):
        found = variants.gram_dictionary(vocabulary, 1, most)
        assert (most == 10 or found) and len(found) <= most and all(len(g) == 2 or g[:-1] in found for g in found)


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"x{i}", "w40") for i in range(300)], "word string, form string")
    got = variants.roots(forms, 40).collect()
    assert len(got) == 340 and {r["root"] for r in got} == {"w40"}


def test_empty_tables(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).agg(F.count("*")).head()[0] == 0
