"""What the mix takes, document by document, against a plain version; any number of sources; overlaps."""

import itertools
import random
from collections import defaultdict

import pytest

from ledgerloom.llm import mixing


def made(spark, seed, n, sources):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.choice([0, 1, 1, 2, 3, 5, 8, 40])
        rows.append((i, None if r.random() < 0.05 else " ".join(["w"] * words), r.choice(sources)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def by_hand(docs):
    """What each document's source takes of it: whole rounds, then documents by draw, then later ones that fill the gap."""
    measures = mixing._measures(docs, "doc_id", "text", "source", mixing.SEED)
    rows = docs.select("doc_id", "source", measures["_size"].alias("size"), measures["_draw"].alias("draw")).collect()
    own = defaultdict(list)
    for r in rows:
        own[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in found) for s, found in own.items()}
    wanted = mixing.targets(sizes, sum(sizes.values()))
    taken = {}
    for source, found in own.items():
        routed = min(round(wanted[source]), mixing.EPOCHS * sizes[source])
        full, part = divmod(routed, sizes[source]) if sizes[source] else (0, 0)
        found = sorted((r for r in found if r["size"]), key=lambda r: r["draw"])
        chosen, held, at = set(), 0, 0
        while part and held < part and held + found[at]["size"] <= part:
            chosen.add(found[at]["doc_id"])
            held += found[at]["size"]
            at += 1
        gap, filled = part - held, 0
        for r in [r for r in found[at:] if r["size"] < 2 * gap]:
            before, filled = filled, filled + r["size"]
            if filled <= gap or filled - gap < gap - before:
                chosen.add(r["doc_id"])
            if filled >= gap:
                break
        taken |= {r["doc_id"]: r["size"] * (full + (r["doc_id"] in chosen)) for r in found}
    return taken, sizes, wanted


@pytest.mark.parametrize("seed,n,sources", [(1, 300, ["a", "b", "c", None]), (2, 60, [f"s{i}" for i in range(40)]), (3, 5, ["x"])])
def test_taken_document_by_document(spark, seed, n, sources):
    docs = made(spark, seed, n, sources).repartition(3)
    taken, _, _ = by_hand(docs)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == {i: taken.get(i, 0) for i in range(n)}


def test_any_number_of_sources(spark, monkeypatch):
    """A source per few documents: none of them reaches the driver, so the bound on overlaps does not matter."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    docs = made(spark, 4, 4000, [None, "", *[f"host{i}" for i in range(1500)], "\U0001f600", "￮"])
    taken, sizes, wanted = by_hand(docs)
    source = dict(docs.select("doc_id", "source").collect())
    for r in mixing.mix(docs).collect():
        own = source[r["doc_id"]]
        assert r["taken"] == taken.get(r["doc_id"], 0) and r["source_size"] == sizes[own]
        assert r["target"] == pytest.approx(wanted[own])


def best(capacity, members, quota, costs):
    """The most words that reach sources, and the least cost of that, over all ways to route them."""
    lanes = [(p, s) for p in members for s in members[p]]
    found = None
    for flows in itertools.product(*[range(min(len(costs) * capacity[p], quota[s]) + 1) for p, s in lanes]):
        out, into = defaultdict(int), defaultdict(int)
        for (p, s), x in zip(lanes, flows):
            out[p] += x
            into[s] += x
        if any(into[s] > quota[s] for s in quota) or any(out[p] > len(costs) * capacity[p] for p in members):
            continue
        cost = sum(costs[k // capacity[p]] for p in members for k in range(out[p]))
        answer = (-sum(flows), cost)
        found = answer if found is None else min(found, answer)
    return found


def test_flow_against_all_ways():
    r = random.Random(5)
    for _ in range(40):
        members = {"a": ["a"], "ab": ["a", "b"], "bc": ["b", "c"]} if r.random() < 0.5 else {"abc": ["a", "b", "c"], "a": ["a"]}
        capacity = {p: r.randint(1, 3) for p in members}
        quota = {s: r.randint(0, 4) for p in members for s in members[p]}
        routed = mixing.flow(capacity, members, quota)
        cost = sum(mixing.COSTS[k // capacity[p]] for p in members for k in range(routed[p]))
        assert (-sum(routed.values()), cost) == best(capacity, members, quota, mixing.COSTS)


def overlapping(spark):
    rows = [(i, "w " * (1 + i % 4), own) for i, own in enumerate([["a"], ["b", "a"], ["b"], ["c"], [], None, [None, "c"], ["d"], ["a", "b", "a"]] * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source array<string>")


def test_overlaps_and_sources_of_their_own(spark):
    docs = overlapping(spark)
    size = {r["doc_id"]: 1 + r["doc_id"] % 4 for r in docs.collect()}
    patterns, sizes = defaultdict(int), defaultdict(int)
    of = {}
    for r in docs.collect():
        of[r["doc_id"]] = tuple(mixing.in_order(list(set(r["source"] or [None]))))
        patterns[of[r["doc_id"]]] += size[r["doc_id"]]
    for own, n in patterns.items():
        for s in own:
            sizes[s] += n
    wanted = mixing.targets(sizes, sum(patterns.values()))
    names = {own: str(own) for own in patterns}
    routed = mixing.flow({names[o]: n for o, n in patterns.items()}, {names[o]: o for o in patterns}, {s: round(t) for s, t in wanted.items()})
    got = defaultdict(int)
    for r in mixing.mix(docs).collect():
        own = of[r["doc_id"]]
        got[own] += r["taken"]
        assert r["target"] == pytest.approx(wanted[own[0]]) and r["source_size"] == sizes[own[0]]
        assert r["taken"] <= mixing.EPOCHS * r["size"]
    assert sum(got.values()) == pytest.approx(sum(routed.values()), abs=4 * len(patterns))
    for s in (None, "c", "d"):  # words that reach them have no other way
        reach = sum(n for own, n in got.items() if s in own)
        assert reach >= round(wanted[s]) - 4


def test_too_many_overlaps_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(overlapping(spark)).count()
