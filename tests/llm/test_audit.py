"""The filter audit against brute force over all orders, whatever the order in which files arrive."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from ledgerloom.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, mask string, part string, key string"
LABELS = "doc_id long, quality int, toxic int, n int"
PROSE = " ".join(f"w{i}" for i in range(250))
BIG = 2**60


def masks(rows):
    first = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", audit.LAST_ID), audit.LAST_ID if i is None else i)
    for i, text, source in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)), (audit.LAST_ID if i is None else i) > first[t],
        ]
        yield source or "", {f for f, fail in zip("ABCDE", fails) if fail}


def brute(rows, labels):
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    cells = Counter()
    for (i, *_), (part, failed) in zip(rows, masks(rows)):
        cells[part, frozenset(failed), i in quality, i in toxic] += 1
    want, shapley = Counter(), Counter()
    names = ["kept", "removed", "redundant", "unique", "good", "toxic"]
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part in {p for p, *_ in cells}:
        for order in orders:
            for step, own in enumerate(order, 1):
                row = dict.fromkeys(names, 0)
                for (p, failed, good, bad), n in cells.items():
                    if p != part:
                        continue
                    earlier = failed & set(order[: step - 1])
                    row["kept"] += n * (not earlier and own not in failed)
                    row["removed"] += n * (own in failed and not earlier)
                    row["redundant"] += n * (own in failed and bool(earlier))
                    row["unique"] += n * (failed == {own})
                    row["good"] += n * (good and own in failed and not earlier)
                    row["toxic"] += n * (bad and own in failed and not earlier)
                shapley[part, own] += row["removed"]
                want[part, order, step] = tuple(row.values())
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in want.items()}


def rows_of(n, seed):
    r = random.Random(seed)
    texts = [None, "", "one two", PROSE, PROSE + " #", "THE " * 300, "a b " * 150, PROSE.upper(), "€ $ x", PROSE + "\x1c|"]
    ids = [*range(1, n), BIG, BIG + 1, None, None, 5, 5]
    return [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in r.sample(ids, len(ids))]


@pytest.mark.parametrize("files", [1, 3])
def test_every_order_against_brute_force(spark, tmp_path, monkeypatch, files):
    """Ids arrive in any order, so smaller ones come after larger ones, in later batches and in the same."""
    monkeypatch.setattr(audit, "SLOT_ROWS", 20)
    monkeypatch.setattr(audit, "CHUNK_ROWS", 7)
    rows = rows_of(80, files)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 60)] + [(1, 0, 1), (BIG + 1, 1, 1), (None, 1, 1), (61, None, 1)]
    for k in range(files):
        part = [(*r, "x", "y", "z") for r in rows[k::files]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 1) for r in labels], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.audit(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == brute(rows, labels) and len(got) == 600 * len({s or "" for *_, s in rows})


def test_a_later_call_takes_back_what_a_smaller_id_changes(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    def add(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
        feed = spark.readStream.schema("doc_id long, text string, source string").parquet(f"{folder}/documents.parquet")
        found = audit.counters(feed, labels, 4, state)
        return {tuple(r) for r in found.collect()}

    assert add([(7, PROSE, "a"), (9, PROSE, "b")]) == {("a", 0, 0, 0, 1), ("b", 16, 0, 0, 1)}
    assert add([(8, PROSE, "b")]) == {("a", 0, 0, 0, 1), ("b", 16, 0, 0, 2)}
    assert add([(1, PROSE, "c"), (9, "x", "c")]) == {("a", 16, 0, 0, 1), ("b", 16, 0, 0, 2), ("c", 0, 1, 0, 1), ("c", 1, 0, 0, 1)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert audit.audit(spark, str(tmp_path)).count() == 0
