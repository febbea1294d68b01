"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import settled, text_of, whole_row, words_of
from ledgerloom.operators.spread import fits_broadcast, ordered_scan, salted_join

WEIGHTS = (5, 2, 1)
EPOCHS = 3  # times a document may be taken at most
COSTS = (0, 1, 4)  # of a word's first, second and third use: each repetition costs more
SEED = 20240229
DRAW_BITS, STEP_BITS, STEPS = 63, 12, 3
MAX_PATTERNS = 100_000  # overlapping memberships that the flow on the driver takes

Source = str | None


def in_order(sources: Sequence[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: Mapping[Source, int], total: int, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS):
    """Words wanted of each source: shares of ``total`` by weight, none above ``epochs`` times its size."""
    order = in_order(list(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(total)
    while open_:
        whole = sum(weight[s] for s in order if s in open_)
        share = {s: left * weight[s] / whole for s in order if s in open_}
        above = [s for s in share if share[s] > epochs * sizes[s]]
        if not above:
            return want | share
        for s in above:
            want[s] = float(epochs * sizes[s])
            left -= want[s]
            open_.discard(s)
    return want


def flow(capacity: Mapping[str, int], members: Mapping[str, Sequence[Source]], quota: Mapping[Source, int],
         costs: Sequence[int] = COSTS) -> dict[str, int]:
    """Words routed from each pattern so that quotas are met as far as they can, at least cost.

    A pattern has one arc per epoch, each dearer than the one before. Patterns that share no
    source, directly or over others, are solved apart; each part by successive shortest paths.
    """
    by_source = defaultdict(list)
    for pattern, own in members.items():
        for s in own:
            by_source[s].append(pattern)
    out: dict[str, int] = {}
    seen: set[str] = set()
    for first in members:
        if first in seen:
            continue
        part, queue = [], deque([first])
        seen.add(first)
        while queue:
            pattern = queue.popleft()
            part.append(pattern)
            for s in members[pattern]:
                for other in by_source[s]:
                    if other not in seen:
                        seen.add(other)
                        queue.append(other)
        out |= _part_flow(part, capacity, members, quota, costs)
    return out


def _part_flow(part, capacity, members, quota, costs) -> dict[str, int]:
    arcs: list[list] = []  # to, room, cost; arc k ^ 1 is its way back
    at = defaultdict(list)

    def arc(a, b, room: int, cost: int) -> None:
        at[a].append(len(arcs))
        arcs.append([b, room, cost])
        at[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    given: dict[str, list[int]] = {}
    for p in part:
        given[p] = []
        for cost in costs:
            given[p].append(len(arcs))
            arc("from", ("p", p), capacity[p], cost)
        for s in members[p]:
            arc(("p", p), ("s", s), len(costs) * capacity[p], 0)
    for s in in_order(list({s for p in part for s in members[p]})):
        arc(("s", s), "to", quota[s], 0)
    while True:
        cost, way, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            node = queue.popleft()
            queued.discard(node)
            for k in at[node]:
                b, room, c = arcs[k]
                if room > 0 and cost[node] + c < cost.get(b, float("inf")):
                    cost[b], way[b] = cost[node] + c, k
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if "to" not in cost:
            return {p: sum(arcs[k ^ 1][1] for k in given[p]) for p in part}
        steps, node = [], "to"
        while node != "from":
            steps.append(way[node])
            node = arcs[way[node] ^ 1][0]
        most = min(arcs[k][1] for k in steps)
        for k in steps:
            arcs[k][1] -= most
            arcs[k ^ 1][1] += most


def _measures(df: DataFrame, id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """Membership pattern (JSON), size in words and a seeded 63-bit draw of a row."""
    own = df[source]
    if isinstance(df.schema[source].dataType, T.ArrayType):
        own = F.when(F.size(own) > 0, F.array_sort(F.array_distinct(own))).otherwise(F.array(F.lit(None).cast("string")))
    else:
        own = F.array(own.cast("string"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), df[id], text_of(df, text)), 1)
    return {"_pattern": F.to_json(own), "_size": F.size(words_of(text_of(df, text))).cast("long"), "_draw": draw}


def _quotas(sources: DataFrame, rows: int, total: int, weights: Sequence[float], epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): what ``targets`` gives, by a sweep over all sources instead of rounds.

    Sources are numbered by code point. In the order of bound (``epochs`` times the size) over weight, the
    first one that holds its share of what those before it leave is the first that is not bounded;
    its level of words per weight holds for all. Only that level comes to the driver.
    """
    known = sources.withColumns({"_null": F.col("source").isNull().cast("int"), "_one": F.lit(1).cast("long")})
    numbered = ordered_scan(known, [], ["_null", "source"], {"_place": "_one"}, "sum", rows=rows)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights)).cast("int"))
    bounded = numbered.withColumns({"_weight": weight, "_most": F.col("source_size") * F.lit(epochs)})
    bounded = bounded.withColumn("_ratio", F.col("_most") / F.col("_weight"))
    swept = ordered_scan(bounded, [], ["_ratio", "_place"], {"_mosts": "_most", "_weights": "_weight"}, "sum", rows=rows)
    every = sum(float(w) * len(range(i, rows, len(weights))) for i, w in enumerate(weights))
    left = F.lit(total).cast("double") - (F.col("_mosts") - F.col("_most"))
    whole = F.lit(every) - (F.col("_weights") - F.col("_weight"))
    free = swept.select("_ratio", "_place", "_most", "_weight", left.alias("left"), whole.alias("whole"))
    free = free.filter(F.col("left") * F.col("_weight") / F.col("whole") <= F.col("_most"))
    level = free.agg(F.min_by(F.struct("left", "whole"), F.struct("_ratio", "_place"))).head()[0]
    share = F.col("_most").cast("double")
    if level is not None:
        share = F.least(share, F.lit(level["left"]) * F.col("_weight") / F.lit(level["whole"]))
    return bounded.select("source", "source_size", share.alias("target"))


def _overlapping(members: DataFrame, costs: Sequence[int]) -> DataFrame:
    """(_pattern, routed) of patterns that share sources with others, directly or not, by the min-cost flow.

    ``members`` has a row per pattern and source: (_pattern, size, source, target, _many). The flow runs on
    the driver, over one row per membership; more than MAX_PATTERNS overlapping memberships are refused.
    """
    spark = members.sparkSession
    shared = members.filter("_many").select(F.col("source").alias("_shared")).distinct()
    tied = members.join(shared, members["source"].eqNullSafe(shared["_shared"]), "left_semi")
    ids = tied.select("_pattern").distinct()
    rows = members.join(ids, "_pattern", "left_semi").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"overlapping sources have more than {MAX_PATTERNS} memberships")
    rows.sort(key=lambda r: (r["_pattern"], r["source"] is None, r["source"] or ""))
    own: dict[str, list[Source]] = defaultdict(list)
    for r in rows:
        own[r["_pattern"]].append(r["source"])
    quota = {r["source"]: round(r["target"]) for r in rows}
    routed = flow({r["_pattern"]: r["size"] for r in rows}, own, quota, costs)
    return spark.createDataFrame(list(routed.items()), "_pattern string, routed long")


def plan_mix(narrow: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS,
             costs: Sequence[int] = COSTS) -> tuple[DataFrame, bool]:
    """One row per pattern: (_pattern, full, below, small, filled, source_size, target); and whether it may be broadcast.

    A document of the pattern is taken ``full`` times, and once more if its draw is less than
    ``below``, or less than ``filled`` where it has ``small`` words at most. ``narrow`` has (_pattern, _size, _draw).
    A pattern whose one source no other pattern has can only serve that source: its flow is the lesser of its
    words and the quota, found where it lies, for any number of sources. Patterns that overlap go through the min-cost flow.
    """
    costs = costs[:epochs]
    own = F.from_json("_pattern", "array<string>")
    patterns = narrow.groupBy("_pattern").agg(F.sum("_size").alias("size")).withColumn("_own", own)
    patterns = settled(patterns.withColumn("_many", F.size("_own") > 1), "patterns")
    members = patterns.select("_pattern", "size", "_many", F.explode("_own").alias("source"))
    total, overlaps, count = patterns.agg(F.sum("size"), F.bool_or("_many"), F.count(F.lit(1))).head()
    few = fits_broadcast(patterns.select("_pattern"), count)  # measured once; what is joined later has these patterns at most
    sources = settled(members.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    quotas = settled(_quotas(sources, sources.count(), total or 0, weights, epochs), "quotas")
    met = members.join(quotas.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    met = met.drop("_source")
    alone = F.least(F.bround("target").cast("long"), F.col("size") * F.lit(len(costs)))
    led = patterns.select("_pattern", F.get("_own", F.lit(0)).alias("_lead"))
    shares = met.join(led, "_pattern").filter(F.col("source").eqNullSafe(F.col("_lead")))
    shares = shares.select("_pattern", "size", "source_size", "target", alone.alias("_alone"))
    routed = F.col("_alone")
    if overlaps:
        shares = shares.join(_overlapping(met, costs), "_pattern", "left")
        routed = F.coalesce("routed", "_alone")
    shares = shares.withColumn("_routed", routed)
    whole = F.when(F.col("size") > 0, F.expr("_routed div size")).otherwise(F.lit(0).cast("long"))
    shares = settled(shares.withColumn("full", whole).withColumn("part", F.col("_routed") - whole * F.col("size")), "shares")
    wanted = shares.filter("part > 0").select("_pattern", F.col("part").alias("want"), F.lit(0).cast("long").alias("above"))
    first = _thresholds(narrow, wanted, False, few)
    gaps = first.filter("left > 0").select("_pattern", F.col("left").alias("want"), F.col("low").alias("above"))
    again = _thresholds(narrow, gaps, True, few)
    none = F.lit(0).cast("long")
    plan = shares.join(first.select("_pattern", F.col("low").alias("below"), "left"), "_pattern", "left").join(
        again.select("_pattern", F.col("low").alias("filled")), "_pattern", "left"
    )
    return settled(
        plan.select(
            "_pattern", F.col("full").cast("int").alias("full"), F.coalesce("below", none).alias("below"),
            F.greatest(none, F.coalesce("left", none) * 2 - 1).alias("small"),
            F.coalesce("filled", none).alias("filled"), "source_size", "target",
        ),
        "plan",
    ), few


def _thresholds(narrow: DataFrame, wanted: DataFrame, fill: bool, few: bool) -> DataFrame:
    """(_pattern, low, left): the draw below which a pattern's documents hold the wanted words, and the words still lacking.

    ``wanted`` has (_pattern, want, above). Each step counts the words of 2**STEP_BITS ranges of the draw and
    goes on inside the range in which the wanted sum lies; after the last step a range holds a
    document or none. The first round stops short of the document that
    would go over. The round that fills the gap, of ``above``, looks at later documents of less than
    twice the gap and takes the last one if that is nearer.
    """
    most = (1 << DRAW_BITS) - 1
    none = F.lit(0).cast("long")
    state = wanted.select(
        "_pattern", "want", "above", none.alias("low"), F.col("want").alias("need"), F.col("want").alias("left"),
        F.lit(True).alias("open"),
    )
    for step in range(1, STEPS + 1):
        shift = DRAW_BITS - STEP_BITS * step
        active = state.filter("open").select("_pattern", "want", "above", "low", "need")
        if active.isEmpty():
            break
        seen = _joined(narrow, active, few).filter(
            F.shiftright("_draw", shift + STEP_BITS) == F.shiftright("low", shift + STEP_BITS)
        )
        if fill:
            seen = seen.filter((F.col("_draw") >= F.col("above")) & (F.col("_size") <= F.col("want") * 2 - 1))
        ranges = seen.groupBy("_pattern", F.shiftright("_draw", shift).alias("range"), "need").agg(
            F.sum("_size").alias("size")
        )
        so_far = F.sum("size").over(Window.partitionBy("_pattern").orderBy("range"))  # 2**STEP_BITS rows at most
        hit = ranges.withColumn("upto", so_far).filter(
            (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("size") < F.col("need"))
        )
        hit = hit.select("_pattern", "range", (F.col("upto") - F.col("need")).alias("over"),
                         (F.col("need") - F.col("upto") + F.col("size")).alias("rest"))
        found = F.col("range").isNotNull()
        closed = F.col("over") == 0
        if fill and step == STEPS:
            closed = closed | (F.col("over") < F.col("rest"))
        begin = F.shiftleft("range", shift)
        end = F.when(F.col("range") == (1 << STEP_BITS * step) - 1, F.lit(most)).otherwise(begin + F.lit(1 << shift))
        # where fewer words are there than wanted, all of them are taken
        lost = F.lit(most) if step == 1 else F.col("low")
        moved = F.when(~F.col("open"), F.col("low")).when(~found, lost).when(closed, end).otherwise(begin)
        lack = F.when(~F.col("open") | ~found, F.col("left")).when(closed, none).otherwise(F.col("rest"))
        state = settled(
            state.join(hit, "_pattern", "left").select(
                "_pattern", "want", "above", moved.alias("low"), F.coalesce("rest", "need").alias("need"),
                lack.alias("left"), (F.col("open") & found & ~F.coalesce(closed, F.lit(True))).alias("open"),
            ),
            "thresholds",
        )
    return state.select("_pattern", "low", "left")


def _joined(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """``rows`` with what was found of their patterns, sent out if its measured size allows, else by a salted join."""
    if few:
        return rows.join(F.broadcast(found), "_pattern")
    return salted_join(rows, found, ["_pattern"], row_key=["_draw"])


def _taken(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    found = _joined(rows, plan, few)
    more = (F.col("_draw") < F.col("below")) | ((F.col("_size") <= F.col("small")) & (F.col("_draw") < F.col("filled")))
    return found.withColumn("copies", F.col("full") + more.cast("int"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Every row's part in the mix: doc_id, size, source_size, target, taken, copies.

    Sources (a string, or an array of them where they overlap) share all words by ``weights``,
    repeated in code point order, null last; targets stop at ``epochs`` times a source's words
    and what is left is shared again. Whole documents are taken, by a seeded draw of id and
    text, so reruns agree; where the next document would go over, later ones of less than
    twice the gap fill it, so a source misses its target by a small part of a document where it has such. ``source_size`` and ``target`` are those of the first of
    a row's sources. Null text has no words; an empty table gives no rows; repeated rows are
    taken or left together; other columns are ignored.
    """
    narrow = settled(df.select(df[id].alias("doc_id"), *[c.alias(n) for n, c in _measures(df, id, text, source, seed).items()]), "sizes")
    return _taken(narrow, *plan_mix(narrow, weights, epochs)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("copies")).alias("taken"), "copies",
    )


def mixed_rows(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``df`` with all their columns, each as often as it is taken."""
    measures = _measures(df, id, text, source, seed)
    narrow = settled(df.select(*[c.alias(n) for n, c in measures.items()]), "sizes")
    rows = df.select(whole_row(df).alias("row"), *[measures[n].alias(n) for n in measures])
    taken = _taken(rows, *plan_mix(narrow, weights, epochs)).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
