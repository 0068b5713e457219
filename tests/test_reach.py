"""Chains of artifacts with prompt seeds, and least depths, against plain Python."""

from ledgerlens.operators.graph import artifact_chains, lineage, reach

LINKS = [("a", "x1", "b"), ("a", "x2", "b"), ("b", "y", "c"), ("c", "z", "a"), ("b", "y", "d"), ("d", "w", "e"), ("b", "y", "d"), (None, "q", "b"), ("c", None, "e")]
PROMPTS = [("p", "a"), ("p", "d"), ("c", "b"), ("r", None), ("p", "a")]


def expected(links, prompts):
    whole = {x for x in links if None not in x}
    now = [(s, 1, s, k, t, f"{s} --{k}--> {t}", (s, t)) for s, k, t in whole]
    for p, used in {x for x in prompts if None not in x}:
        now += [(p, 1, s, k, t, f"{p} --uses_prompt--> {s} --{k}--> {t}", (p, s, t)) for s, k, t in whole if s == used]
    out = []
    while now:
        out += [x[:6] for x in now]
        now = [(x[0], x[1] + 1, s, k, t, f"{x[5]} --{k}--> {t}", (*x[6], t)) for x in now for s, k, t in whole if s == x[4] and t not in x[6]]
    return sorted(out)


def test_chains_name_artifacts_and_start_at_prompts_too(spark):
    links = spark.createDataFrame(LINKS, "producer string, artifact_key string, consumer string")
    prompts = spark.createDataFrame(PROMPTS, "prompt string, surface string")
    assert sorted(map(tuple, artifact_chains(links, prompts).collect())) == expected(LINKS, PROMPTS)
    assert sorted(map(tuple, artifact_chains(links).collect())) == expected(LINKS, [])
    assert sorted(map(tuple, artifact_chains(links, prompts, depth=2).collect())) == [x for x in expected(LINKS, PROMPTS) if x[1] <= 2]
    assert artifact_chains(links.limit(0), prompts).count() == 0


def test_reach_gives_least_depths_where_paths_are_many(spark):
    # a ladder of twelve diamonds has 2**12 paths; its end leads back to the start
    edges = [(f"{i}", f"{i}{side}") for i in range(12) for side in "lr"] + [(f"{i}{side}", f"{i + 1}") for i in range(12) for side in "lr"] + [("12", "0"), ("12", None), ("0", "0l")]
    frame = spark.createDataFrame(edges, "src string, dst string").repartition(2)
    got = {(r.seed, r.node): r.depth for r in reach(frame, spark.createDataFrame([("0",), ("11",), ("0",), (None,), ("gone",)], "node string")).collect()}
    for seed, begin in (("0", 0), ("11", 11)):
        for i in range(13):
            assert got[seed, str(i)] == (2 * (i - begin) if i >= begin else 2 * (12 - begin) + 1 + 2 * i)
    assert got["gone", "gone"] == 0
    assert len(got) == 2 * (13 + 24) + 1


def test_reach_agrees_with_the_path_listing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("c",)], "node string")
    least = {}
    for r in lineage(edges, seeds).collect():
        least[r.seed, r.node] = min(r.depth, least.get((r.seed, r.node), r.depth))
    assert {(r.seed, r.node): r.depth for r in reach(edges, seeds).collect()} == least
    assert {r.depth for r in reach(edges, seeds, depth=1).collect()} == {0, 1}


def test_only_chains_that_go_on_are_kept(spark):
    import glob
    import os

    from ledgerlens.session import use_checkpoint_dir

    links = [("a", f"x{i}", f"b{i}") for i in range(200)] + [("b0", "y", "c"), ("c", "z", "d"), ("d", "w", "e"), ("e", "v", "a|b")]
    prompts = [("p", "a"), ("c", "b0")]
    use_checkpoint_dir(spark)
    folder = os.path.dirname(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(glob.glob(f"{folder}/*/*"))
    got = artifact_chains(spark.createDataFrame(links, "producer string, artifact_key string, consumer string"), spark.createDataFrame(prompts, "prompt string, surface string"))
    kept = [spark.read.parquet(path) for path in set(glob.glob(f"{folder}/*/*")) - before]
    assert sorted(map(tuple, got.collect())) == expected(links, prompts)
    assert [t.count() for t in kept if "producer" in t.columns] == [len(links)]
    rest = [r for t in kept if "surfaces" in t.columns for r in t.collect()]
    assert {r.surfaces[-1] for r in rest} == {"c", "d", "e"} and len(rest) == len({tuple(r.surfaces) for r in rest}) < 12  # no chain that ends at once, no text
