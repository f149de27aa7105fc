"""Graph loops over edge tables: reach, what is gathered along it, cheapest paths, communities, fused layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.components import connected_components
from loamgrid.plans.durable import durable


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Each pair once with src < dst, loops dropped; weights of a pair are summed."""
    e = edges.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return e.groupBy("src", "dst").agg(F.sum(weight).alias(weight)) if weight else e.select("src", "dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def within_hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) of nodes up to ``depth`` directed hops from each start. ``starts`` has one column, node."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("start", F.col("next").alias("node")).distinct()
        frontier = durable(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def upstream(edges: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """(start, node, depth) closure along src to dst edges, until nothing new is found; an error if that takes over ``most`` hops."""
    seen = durable(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    frontier = seen
    for k in range(1, most + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("start", F.col("next").alias("node")).distinct()
        frontier = durable(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
        if k % 20 == 0:  # keeps the plan short
            seen = durable(seen)
    else:
        raise RuntimeError(f"closure not complete after {most} hops")
    return seen


def gathered(edges: DataFrame, held: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, word, bits): the bits of a node and of all that it leads to along src to dst edges; ``held`` (node, word, bits) has their own.

    Rows are of fixed width, and no pairs of nodes are made. Where each src has one dst, links are walks of 1, 2, 4 ... edges, so the rounds
    are the logarithm of the longest way; else each round hands on over one edge what the last one added. Ends when nothing is added, so a
    cycle is no harm; an error if that takes over ``most`` rounds.
    """
    edges = edges.select("src", "dst").where("src <> dst")
    first = durable(edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("__far")))
    single = first.where("dst <> __far").limit(1).count() == 0
    links = first.select("src", "dst") if single else durable(edges.distinct())
    state = durable(held.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).withColumn("fresh", F.col("bits")))
    for _ in range(most):
        lead = (state if single else state.where("fresh <> 0")).select(F.col("node").alias("dst"), "word", "bits")
        gain = links.join(lead, "dst").select(F.col("src").alias("node"), "word", "bits", F.lit(0).cast("long").alias("had"))
        grown = state.select("node", "word", "bits", F.col("bits").alias("had")).unionByName(gain).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        state = durable(grown.select("node", "word", "bits", F.col("bits").bitwiseXOR(F.col("had")).alias("fresh")))
        if state.where("fresh <> 0").limit(1).count() == 0:
            break
        if single:
            links = durable(links.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("__next")), "dst").select("src", F.col("__next").alias("dst")))
            if links.limit(1).count() == 0:
                break
    else:
        raise RuntimeError(f"nothing settled in {most} rounds")
    return state.select("node", "word", "bits")


def cheapest(edges: DataFrame, starts: DataFrame, cost: str, budget: float | None = None, most: int = 10_000) -> DataFrame:
    """(start, node, cost): least cost over src to dst edges by relaxation; costs are positive. Nodes over ``budget`` are left out.

    Relaxes until no cost falls; an error if that takes over ``most`` rounds.
    """
    best = durable(starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost")))
    changed = best
    for _ in range(most):
        step = changed.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col(cost).alias("__c")), "node").groupBy("start", F.col("next").alias("node")).agg(F.min(F.col("cost") + F.col("__c")).alias("cost"))
        if budget is not None:
            step = step.where(F.col("cost") <= budget)
        better = step.join(best.withColumnRenamed("cost", "old"), ["start", "node"], "left").where("old is null or cost < old").select("start", "node", "cost")
        changed = durable(better)
        if changed.limit(1).count() == 0:
            break
        best = durable(best.unionByName(changed).groupBy("start", "node").agg(F.min("cost").alias("cost")))
    else:
        raise RuntimeError(f"costs did not settle in {most} rounds")
    return best


def label_communities(edges: DataFrame, weight: str, rounds: int = 1000) -> DataFrame:
    """(node, community) by weighted label propagation from the smallest member on; ties go to the smaller label.

    Only nodes of one half move in a round, and each round draws its halves anew, so that pairs don't swap
    for ever. Ends when no node of either half would move; an error if that takes over ``rounds`` rounds.
    """
    links = durable(both_ways(edges.select("src", "dst", F.col(weight).alias("w"))))
    labels = durable(links.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for k in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.round(F.sum("w"), 9).alias("w"))
        top = votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("community")).alias("minus"))).alias("t")).select("node", (-F.col("t.minus")).alias("new"))
        moves = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        wanted = durable(labels.join(top, "node").select("node", "community", "new"))
        if wanted.where("new <> community").limit(1).count() == 0:
            break
        labels = wanted.select("node", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community"))
    else:
        raise RuntimeError(f"communities did not settle in {rounds} rounds")
    size = labels.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    return labels.join(size, "community").select("node", F.col("least").alias("community"), "n")


def modularity(edges: DataFrame, weight: str, labels: DataFrame) -> DataFrame:
    """One row: weighted modularity of a grouping (node, community)."""
    e = edges.select("src", "dst", F.col(weight).alias("w"))
    total = e.agg(F.sum("w").alias("m"))
    of = lambda name, out: labels.select(F.col("node").alias(name), F.col("community").alias(out))
    inside = e.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    degree = both_ways(e).join(of("src", "a"), "src").groupBy("a").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.crossJoin(inside).crossJoin(degree).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def fuse_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Pairs of all layers (src, dst, weight): weights summed, names joined by +, and how many layers have the pair.

    All layers go through one grouping, whose sums are of fixed width.
    """
    parts = None
    for name, layer in layers.items():
        one = layer.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", F.lit(name).alias("rel"))
        parts = one if parts is None else parts.unionByName(one)
    names = sorted(layers)
    has = {name: F.max(F.col("rel") == name).alias(f"__{k}") for k, name in enumerate(names)}
    fused = parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), *has.values())
    rels = F.array_compact(F.array(*[F.when(F.col(f"__{k}"), F.lit(name)) for k, name in enumerate(names)]))
    return fused.select("src", "dst", "weight", F.array_join(rels, "+").alias("rels"), F.size(rels).cast("long").alias("support"))


def membership_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_c, new_c, jaccard) of groups (node, community) that share a member."""
    a, b = old.select("node", F.col("community").alias("old_c")), new.select("node", F.col("community").alias("new_c"))
    both = a.join(b, "node").groupBy("old_c", "new_c").agg(F.count("*").alias("inter"))
    na, nb = a.groupBy("old_c").agg(F.count("*").alias("na")), b.groupBy("new_c").agg(F.count("*").alias("nb"))
    return both.join(na, "old_c").join(nb, "new_c").select("old_c", "new_c", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


def carried(overlap: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches: pairs that are each other's best and reach ``least``; ties by the smaller id."""
    best = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("jaccard"), other))
    return overlap.where(F.col("jaccard") >= least).withColumn("a", best("old_c", "new_c")).withColumn("b", best("new_c", "old_c")).where("a = 1 and b = 1").select("old_c", "new_c", "jaccard")


def region_check(areas: DataFrame, pairs: DataFrame, key: str, labels: list[str], n_areas: int, n_regions: int) -> DataFrame:
    """One row a label column: (label, areas, without, regions, split, matched): is it a partition into ``n_regions`` connected regions?

    It is if the layer has ``n_areas`` areas, none without a label, exactly that many different labels, and every region is one
    piece under ``pairs`` (i, j) of areas that touch. All columns go through one run of components.
    """
    long = areas.select(F.col(key).alias("area"), F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("region")) for c in labels])).alias("l")).select("area", "l.label", "l.region")
    node = lambda a: F.struct("label", F.col(a).cast("string"))
    known = long.where("region is not null")
    a, b = (known.select("label", "region", F.col("area").alias(side)) for side in ("i", "j"))
    inside = pairs.join(a, "i").join(b, ["j", "label", "region"])
    found = connected_components(inside.select(node("i").alias("src"), node("j").alias("dst")))
    place = known.withColumn("node", node("area")).join(found, "node", "left").withColumn("piece", F.coalesce("component", "node"))
    pieces = place.groupBy("label", "region").agg(F.count_distinct("piece").alias("pieces")).groupBy("label").agg(F.count_if(F.col("pieces") > 1).alias("split"))
    counts = long.groupBy("label").agg(F.count("*").alias("areas"), F.count_if(F.col("region").isNull()).alias("without"), F.count_distinct("region").alias("regions"))
    out = counts.join(pieces, "label", "left").na.fill(0, ["split"])
    good = (F.col("areas") == n_areas) & (F.col("without") == 0) & (F.col("regions") == n_regions) & (F.col("split") == 0)
    return out.select("label", "areas", "without", "regions", "split", good.alias("matched"))
