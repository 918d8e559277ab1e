"""Communities by modularity: parallel local moves, refinement inside communities and contraction, level by level.

What a contraction has made small enough, by count, is walked by one task in one go. Until then all state is in tables that are written between rounds, so a lost executor costs part of one round. A round is joins and
aggregations over edges; nodes and communities with any number of neighbours are combined before they are shuffled.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import written

#: Gains below this are rounding.
LEAST_GAIN = 1e-9
#: Links, each in both directions, of a graph that one task walks.
WALKED_LINKS = 1_000_000


def communities(edges: DataFrame, nodes: DataFrame | None = None, seed: int = 0, most_levels: int = 30, most_rounds: int = 200) -> DataFrame:
    """``(node, community)`` for every node of ``edges`` (a, b, weight) and of ``nodes`` (node), named by its smallest node.

    Each level moves nodes to the neighbouring community with the largest gain in modularity until none gains, splits
    the communities into parts that hold together by themselves, and goes on with these parts as nodes. In a round
    every second node has its turn, by a hash of ``seed``; if the round's moves together made modularity smaller, they
    are undone, and of the moves that touch a community only the best is made, which cannot lose. So modularity never
    falls, and the same input and seed give the same communities. Parallel edges add up, null ends, null weights and
    weights of zero or less are left out, loops stay where they are, a node without edges is alone. No rows: no rows.
    More than ``most_rounds`` rounds or ``most_levels`` levels are an error, not a result.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = written(edges.where("a is not null and b is not null and weight > 0").select(*ends, F.col("weight").cast("double").alias("weight")).groupBy("a", "b").agg(F.sum("weight").alias("w")))
    total = 2 * (pairs.agg(F.sum("w")).first()[0] or 0.0)
    both = pairs.where("a <> b").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
    alone = None
    if nodes is not None:
        alone = nodes.where("node is not null").select("node").distinct().join(degree.select("node"), "node", "left_anti")
    links, state = written(both), written(degree.select("node", "k", F.col("node").alias("label")))
    place = state.select("node", F.col("node").alias("at"))
    for level in range(most_levels + 1):
        if links.count() + state.count() <= WALKED_LINKS:
            kind = state.schema["node"].dataType.simpleString()
            rows = links.withColumn("label", F.lit(None).cast(kind)).unionByName(state.select(F.col("node").alias("a"), F.lit(None).cast(kind).alias("b"), F.col("k").alias("w"), "label"))
            ends = written(rows.repartition(1).sortWithinPartitions("a", "b").mapInArrow(_walk(total, seed), f"at {kind}, community {kind}"))
            place = place.join(ends, "at").select("node", "community")
            break
        if level == most_levels:
            raise RuntimeError(f"communities have not settled in {most_levels} levels")
        settled = _moved(links, state, total, f"{seed} {level}", most_rounds)
        # parts of communities: from single nodes, along edges inside, by nodes that are still alone
        names = settled.select("node", "label")
        inner = links.join(names.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x = y").select("a", "b", "w")
        single = settled.select("node", "k", F.col("node").alias("label"))
        parts = _moved(written(inner), written(single), total, f"{seed} {level} parts", most_rounds, merging=True)
        before, after, whole = settled.count(), parts.select("label").distinct().count(), settled.select("label").distinct().count()
        if after == before or whole == before:
            place = place.join(settled.select(F.col("node").alias("at"), F.col("label").alias("community")), "at").select("node", "community")
            break
        part = parts.select("node", F.col("label").alias("part"))
        place = written(place.join(part.withColumnRenamed("node", "at"), "at").select("node", F.col("part").alias("at")))
        state = written(settled.join(part, "node").groupBy("part").agg(F.sum("k").alias("k"), F.min("label").alias("label")).withColumnRenamed("part", "node"))
        links = written(
            links.join(part.withColumnRenamed("node", "a").withColumnRenamed("part", "x"), "a").join(part.withColumnRenamed("node", "b").withColumnRenamed("part", "y"), "b")
            .where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
        )
    least = place.groupBy("community").agg(F.min("node").alias("least"))
    h = F.xxhash64("community").alias("h")
    # the hash makes Spark shuffle for this join alone, so that it can split a community that holds much of the graph
    found = place.select("*", h).join(least.select("*", h), ["community", "h"]).select("node", F.col("least").alias("community"))
    return found if alone is None else found.unionByName(alone.select("node", F.col("node").alias("community")))


def _walk(total: float, seed: int):
    """Rows ``(a, b, w)`` of links and ``(node, null, k, label)`` of nodes to ``(at, community)``, by the same steps, one node after the other."""

    def run(batches):
        links, weight, label, kind = defaultdict(dict), {}, {}, None
        for batch in batches:
            kind = batch.schema.field("a").type
            for row in batch.to_pylist():
                if row["b"] is None:
                    weight[row["a"]], label[row["a"]] = row["w"], row["label"]
                else:
                    links[row["a"]][row["b"]] = row["w"]
        place, turn = {v: v for v in weight}, random.Random(seed)
        while weight:
            _gain(links, weight, label, total, turn)
            part = {v: v for v in weight}
            _gain(links, weight, part, total, turn, label)
            if len(set(part.values())) == len(part):
                break
            label = {part[v]: x for v, x in label.items()}
            heavier, closer = Counter(), defaultdict(Counter)
            for v, k in weight.items():
                heavier[part[v]] += k
                for u, w in links[v].items():
                    if part[u] != part[v]:
                        closer[part[v]][part[u]] += w
            weight, links, place = heavier, closer, {v: part[at] for v, at in place.items()}
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(place), kind), pa.array([label[at] for at in place.values()], kind)], ["at", "community"])

    return run


def _gain(links: dict, weight: dict, label: dict, total: float, turn: random.Random, within: dict | None = None) -> None:
    """Moves nodes to the label beside them that gains most until none gains; with ``within``, nodes that are alone, along links inside."""
    size, members = Counter(), Counter(label.values())
    for v, x in label.items():
        size[x] += weight[v]
    order = sorted(weight)
    turn.shuffle(order)
    waiting, queued = deque(order), set(order)
    while waiting:
        v = waiting.popleft()
        queued.discard(v)
        own = label[v]
        if within is not None and members[own] > 1:
            continue
        near = Counter()
        for u, w in links[v].items():
            if within is None or within[u] == within[v]:
                near[label[u]] += w
        worth = lambda x: near[x] - weight[v] * (size[x] - (weight[v] if x == own else 0)) / total  # noqa: B023, E731
        best = max(sorted(near), key=worth, default=own)
        if best != own and worth(best) > worth(own) + LEAST_GAIN:
            size[own] -= weight[v]
            size[best] += weight[v]
            members[own] -= 1
            members[best] += 1
            label[v] = best
            again = [u for u in links[v] if label[u] != best and u not in queued]
            waiting.extend(again)
            queued.update(again)


def _options(links: DataFrame, state: DataFrame, total: float, salt: str, merging: bool, safe: bool) -> DataFrame:
    """``(node, k, label, inside, next, gain)``: each node with the weight of its edges inside and the move it would make, null for none."""
    turn = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(2)) == 0
    sizes = state.groupBy("label").agg(F.sum("k").alias("s"), F.count("*").alias("n"), F.max(turn).alias("turn"))
    near = state.select(F.col("node").alias("b"), "label")
    around = links.join(near, "b").groupBy("a", "label").agg(F.round(F.sum("w"), 9).alias("w"))
    held = state.withColumnsRenamed({"node": "a", "label": "own"})
    rated = around.join(held, "a").join(sizes, "label")
    stays = F.col("label") == F.col("own")
    # a community of one that may leave in this round is no target, else two nodes could change places
    offered = ~stays if safe else ~stays & ((F.col("n") > 1) | ~F.col("turn"))
    worth = F.round(F.col("w") - F.col("k") * F.col("s") / total, 9)
    best = rated.groupBy("a").agg(F.max(F.when(stays, F.col("w"))).alias("inside"), F.max_by("label", F.when(offered, F.struct(worth, -F.xxhash64("label")))).alias("next"), F.max(F.when(offered, worth)).alias("worth"))
    own = state.join(sizes.select("label", "s", "n"), "label").join(best.withColumnRenamed("a", "node"), "node", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    gain = F.round(F.col("worth") - (F.col("inside") - F.col("k") * (F.col("s") - F.col("k")) / total), 9)
    goes = (gain > LEAST_GAIN) & F.lit(True if safe else turn) & (F.col("n") == 1 if merging else F.lit(True))
    return own.select("node", "k", "label", "inside", F.when(goes, F.col("next")).alias("next"), F.when(goes, gain).alias("gain"))


def _quality(options: DataFrame, total: float) -> tuple[float, int]:
    """(modularity up to what loops add, number of moves)."""
    by = options.groupBy("label").agg(F.sum("inside").alias("inside"), F.sum("k").alias("s"), F.count("next").alias("moves"))
    row = by.agg(F.sum(F.col("inside") / total - F.pow(F.col("s") / total, 2)).alias("q"), F.sum("moves").alias("moves")).first()
    return row["q"] or 0.0, row["moves"] or 0


def _disjoint(options: DataFrame) -> DataFrame:
    """Of the moves that leave or enter a community only the best: their gains then add up exactly."""
    moves = options.where("next is not null")
    order = F.struct("gain", F.xxhash64("node"), "node")
    ends = moves.select(F.explode(F.array("label", "next")).alias("end"), order.alias("move")).groupBy("end").agg(F.max("move").alias("first"))
    once = ends.groupBy("first.node").agg(F.count("*").alias("n")).where("n = 2")
    return options.join(once.select("node", F.lit(True).alias("made")), "node", "left").withColumn("next", F.when(F.col("made"), F.col("next"))).drop("made")


def _moved(links: DataFrame, state: DataFrame, total: float, salt: str, most_rounds: int, merging: bool = False) -> DataFrame:
    """``state`` (node, k, label) after moves until no node gains by one."""
    safe, best, before = False, None, state
    for r in range(most_rounds):
        options = written(_options(links, state, total, f"{salt} {r}", merging, safe))
        quality, moves = _quality(options, total)
        if best is not None and quality < best - LEAST_GAIN:
            # the last round's moves together lost: back, and only moves that cannot
            state, safe = before, True
            continue
        best = quality
        if not moves:
            # once no node whose turn it was has gained, all are asked
            if safe:
                return state
            safe = True
            continue
        if safe:
            options = _disjoint(options)
        before = state
        state = written(options.select("node", "k", F.coalesce("next", "label").alias("label")))
        safe = False
    raise RuntimeError(f"nodes still gain by moves after {most_rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of a partition; 0 for a graph without edges."""
    a, b = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    named = edges.join(a, "a").join(b, "b")
    total = named.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    inside = named.where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    degree = named.select(F.col("ca").alias("c"), "weight").unionByName(named.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / total - degree.agg(F.sum(F.pow(F.col("d") / (2 * total), 2))).first()[0]
