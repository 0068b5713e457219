"""Reference closure, degrees, components, lineage and the pipeline registry's views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored, use_checkpoint_dir


def directory(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(ref) of every row of every namespace: namespace:id."""
    return reduce(DataFrame.union, (df.select(F.concat(F.lit(f"{ns}:"), F.col(pk).cast("string")).alias("ref")) for ns, (df, pk) in tables.items()))


def resolved(refs: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    return refs.join(known.select(F.col("ref").alias(ref)).distinct(), ref, "left_semi")


def orphans(refs: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    return refs.join(known.select(F.col("ref").alias(ref)).distinct(), ref, "left_anti")


def closure_report(refs: DataFrame, known: DataFrame, exempt: Column, tracked: Column) -> DataFrame:
    """Per family: references by fate, and the family's verdict."""
    marked = refs.join(known.select("ref").distinct().withColumn("hit", F.lit(True)), "ref", "left")
    fate = F.when(F.col("hit"), "resolved").when(exempt, "exempt").when(tracked, "unresolved_tracked").otherwise("orphan")
    counts = marked.select("family", fate.alias("fate")).groupBy("family").agg(F.count("*").alias("total"), *(F.count_if(F.col("fate") == f).alias(f) for f in ("resolved", "exempt", "unresolved_tracked", "orphan")))
    verdict = F.when(F.col("orphan") > 0, "fail").when(F.col("unresolved_tracked") > 0, "pass_with_unresolved").when(F.col("total") == 0, "no_rows").otherwise("pass")
    return counts.withColumn("status", verdict)


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def degree_buckets(edges: DataFrame, a: str, b: str) -> DataFrame:
    bucket = F.when(F.col("degree") == 1, "1").when(F.col("degree") <= 3, "2-3").when(F.col("degree") <= 10, "4-10").otherwise("11+")
    return degrees(edges, a, b).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("nodes"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) with the least node that is reachable.

    Labels pass along edges and jump to their label's label, so the rounds grow
    with the logarithm of the longest path; each round is a checkpoint in the
    session's checkpoint folder.
    """
    spark = edges.sparkSession
    use_checkpoint_dir(spark)
    links = edges.select(F.col(a).alias("s"), F.col(b).alias("t")).union(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    label = links.groupBy(F.col("s").alias("node")).agg(F.min("t").alias("m")).select("node", F.least("node", "m").alias("component")).checkpoint()
    for _ in range(rounds):
        near = links.join(label, links.t == label.node).groupBy("s").agg(F.min("component").alias("m"))
        step = label.join(near, label.node == near.s).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        up = step.select(F.col("node").alias("p"), F.col("component").alias("pc"))
        jumped = step.join(up, step.component == up.p).select("node", F.least("component", "pc").alias("component"), "old").checkpoint()
        label = jumped.select("node", "component")
        if jumped.filter("component != old").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_sizes(labels: DataFrame, top: int = 10) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(top)


def lineage(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Every path from the seeds along edges (src, dst): (seed, node, depth, chain), none through a node twice.

    Paths grow by one edge a round, from the ends that the last round reached
    (a checkpoint each), until none grows or has ``depth`` edges.
    """
    use_checkpoint_dir(edges.sparkSession)
    steps = edges.select(F.col("src").alias("node"), "dst")
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.concat(F.lit("|"), "node", F.lit("|")).alias("chain")).checkpoint()
    found = reached
    while depth is None or depth > 0:
        unseen = ~F.contains("chain", F.concat(F.lit("|"), "dst", F.lit("|")))
        grown = reached.join(steps, "node").filter(unseen).select("seed", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("chain", "dst", F.lit("|")).alias("chain"))
        reached = grown.checkpoint()
        if reached.isEmpty():
            break
        found = found.unionByName(reached)
        depth = None if depth is None else depth - 1
    return found


def artifact_chains(links: DataFrame, prompts: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Every chain of surfaces that artifacts join: (start, depth, producer, artifact_key, consumer, chain).

    ``links`` are (artifact_key, producer, consumer) as ``producer_consumer`` gives them: each starts a chain of its own,
    and so does each with a prompt before it that ``prompts`` (prompt, surface) says its producer uses.  A row is the chain's
    last link; no chain meets a surface twice.  Null ends join nothing.  Chains are as many as the paths are: where only
    what can be reached is asked, use ``reach``.

    Kept are the links and, of each round, chains that go on from their end in the next one, as surfaces and keys; the
    others are made where they are read, and their text last.
    """
    last = ["producer", "artifact_key", "consumer"]
    links = links.select(*last).dropna().distinct()
    makers = links.select(F.col("producer").alias("consumer"), F.lit(True).alias("onward")).distinct()
    links = stored(links.join(makers, "consumer", "left").select(*last, F.coalesce("onward", F.lit(False)).alias("onward")))
    reached = links.select(F.lit(False).alias("prompted"), F.array("producer", "consumer").alias("surfaces"), F.array("artifact_key").alias("keys"), "onward")
    if prompts is not None:
        bound = prompts.select("prompt", F.col("surface").alias("producer")).dropna().distinct().join(links, "producer")
        reached = reached.unionByName(bound.select(F.lit(True).alias("prompted"), F.array("prompt", "producer", "consumer").alias("surfaces"), F.array("artifact_key").alias("keys"), "onward"))
    found, level, tips = reached, 1, links.filter("onward").select(F.col("consumer").alias("producer"))
    while depth is None or level < depth:
        level += 1
        ends = reached.filter("onward").select("prompted", "surfaces", "keys", F.element_at("surfaces", -1).alias("producer"))
        grown = ends.join(links, "producer").filter(~F.array_contains("surfaces", F.col("consumer")))
        grown = grown.select("prompted", F.array_append("surfaces", F.col("consumer")).alias("surfaces"), F.array_append("keys", F.col("artifact_key")).alias("keys"), "onward")
        found = found.unionByName(grown)
        if level == depth or links.filter("onward").join(tips.distinct(), "producer", "left_semi").isEmpty():
            break
        reached = stored(grown.filter("onward"))
        if reached.isEmpty():
            break
        tips = reached.select(F.element_at("surfaces", -1).alias("producer"))
    used = F.when(F.col("prompted"), F.slice("surfaces", 2, F.size("surfaces"))).otherwise(F.col("surfaces"))
    steps = F.array_join(F.zip_with("keys", F.slice(used, 2, F.size("keys")), lambda k, c: F.concat(F.lit(" --"), k, F.lit("--> "), c)), "")
    chain = F.concat(F.when(F.col("prompted"), F.concat(F.element_at("surfaces", 1), F.lit(" --uses_prompt--> "))).otherwise(""), F.element_at(used, 1), steps)
    ends = [F.element_at("surfaces", -2).alias("producer"), F.element_at("keys", -1).alias("artifact_key"), F.element_at("surfaces", -1).alias("consumer")]
    return found.select(F.element_at("surfaces", 1).alias("start"), F.size("keys").alias("depth"), *ends, chain.alias("chain"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """What each seed reaches along edges (src, dst): (seed, node, depth), once each, with the least number of edges.

    A round follows only the edges of what the last one found first (a checkpoint each), so the work grows with the pairs
    of seed and node, whatever the number of paths; cycles end by themselves.  Null ends are not followed.
    """
    use_checkpoint_dir(edges.sparkSession)
    steps = edges.select(F.col("src").alias("node"), "dst").dropna().distinct()
    fresh = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).dropna().distinct().checkpoint()
    found, level = fresh, 0
    while depth is None or level < depth:
        level += 1
        ends = fresh.join(steps, "node").select("seed", F.col("dst").alias("node")).distinct()
        fresh = ends.join(found, ["seed", "node"], "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def inverse_edges(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """Edges turned round, by the predicate that (predicate, inverse) names."""
    turned = edges.join(F.broadcast(predicates), "predicate")  # the predicate registry: a few dozen rows
    return turned.select(F.col("to_object_ref").alias("from_object_ref"), F.col("from_object_ref").alias("to_object_ref"), F.col("inverse").alias("predicate"))


def producer_consumer(io: DataFrame) -> DataFrame:
    """(artifact_key, producer, consumer) of different surfaces, from rows of surface_key, artifact_key and direction."""
    made = io.filter(F.col("direction").isin("write", "read_write", "append")).select("artifact_key", F.col("surface_key").alias("producer")).distinct()
    used = io.filter(F.col("direction").isin("read", "read_write")).select("artifact_key", F.col("surface_key").alias("consumer")).distinct()
    return made.join(used, "artifact_key").filter("producer != consumer")


def blast_radius(links: DataFrame) -> DataFrame:
    """Per artifact: how many surfaces make and use it."""
    return links.groupBy("artifact_key").agg(F.count_distinct("producer").alias("producers"), F.count_distinct("consumer").alias("consumers"))


def departed(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")
