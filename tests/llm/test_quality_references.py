"""Distances that are unknown stay null, and rare languages are judged by the classes of all."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality

KINDS = [r"[^\W\d_]", r"[^\W\d_]", r"[\x20\x09-\x0D]", "[0-9]", r"[#*$%&|<>]", r"[.,;:!?'\"()\-]"]


def classes(text):
    found = Counter()
    for c in text:
        if c.islower() and c.isalpha():
            found[0] += 1
        elif c.isupper():
            found[1] += 1
        else:
            found[next((i for i, k in enumerate(KINDS) if i > 1 and re.match(k, c)), 6)] += 1
    return [found[i] for i in range(7)]


def distance(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    part = lambda a, b: a * math.log2(2 * a / (a + b)) / 2 if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q))))


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(6)
    words = ["the", "of", "and", "a", "to", *(f"{a}{b}{c}" for a in ("re", "con", "dis") for b in ("la", "mo", "ti") for c in ("re", "on", "ny"))]
    prose = lambda n: " ".join(r.choice(words[:5] if r.random() < 0.4 else words) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(300), "en") for i in range(60)] + [(100, prose(300), "xx")]
    rows += [(200 + i, " ".join("".join(r.choice("#*$%&|<>") for _ in range(6)) for _ in range(300)), "zz") for i in range(3)]
    return rows, {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}


def test_junk_of_a_rare_language_goes_and_its_prose_stays(made):
    _, got = made
    assert not any(got[i]["kept"] for i in (200, 201, 202)) and got[100]["kept"]
    assert all(got[i]["word_distance"] is None and got[i]["class_distance"] is not None for i in (100, 200, 201, 202))
    assert sum(got[i]["kept"] for i in range(60)) >= 58


def test_class_distances_against_brute_force(made):
    rows, got = made
    pooled = [sum(x) for x in zip(*(classes(t) for _, t, _ in rows))]
    english = [sum(x) for x in zip(*(classes(t) for _, t, lang in rows if lang == "en"))]
    for i, text, lang in rows:
        assert got[i]["class_distance"] == pytest.approx(distance(classes(text), english if lang == "en" else pooled), abs=1e-9)


def test_unknown_distances_are_null(spark):
    df = spark.createDataFrame([(None, [1.0]), ([1.0], None), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality._js(F.col("p"), F.col("q"))).collect()] == [None, None, 0.0]
