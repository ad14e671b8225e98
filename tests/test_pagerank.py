import numpy as np
import pytest

from fitgrain.operators import pagerank as module
from fitgrain.operators import rank_blocks
from fitgrain.operators.pagerank import out_degrees, pagerank, ranks_by_name, vertices

EDGES = [(2, 1), (4, 1), (1, 2), (6, 3), (7, 3), (7, 6), (6, 7), (3, 7), (3, 9), (3, 9), (5, 5)]
# What GraphX gives for these edges at tolerance 1e-4.
RANKS = {
    1: 2.070108, 2: 1.972437, 3: 0.666954, 4: 0.212845,
    5: 1.418165, 6: 0.468097, 7: 0.600651, 9: 0.590743,
}


def graph(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint")


def ranks(df):
    return {row.id: row["rank"] for row in df.collect()}


def brute_force(edges, tolerance=1e-4):
    ids = sorted({v for edge in edges for v in edge})
    at = {v: i for i, v in enumerate(ids)}
    send = np.zeros((len(ids), len(ids)))
    for src, dst in edges:
        send[at[dst], at[src]] += 1.0
    send = 0.85 * send / np.maximum(send.sum(axis=0), 1.0)
    rank = np.full(len(ids), 0.15)
    change = rank.copy()
    while (change > tolerance).any():
        change = send @ np.where(change > tolerance, change, 0.0)
        rank = rank + change
    return dict(zip(ids, rank * len(ids) / rank.sum()))


def test_known_ranks(spark):
    found = ranks(pagerank(graph(spark, EDGES)))
    assert found == pytest.approx(RANKS, abs=1e-6)
    assert sum(found.values()) == pytest.approx(len(RANKS))
    assert found == pytest.approx(brute_force(EDGES))


def test_a_hub_is_sliced_and_nothing_else_changes(spark, monkeypatch):
    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (300, 2))]
    # Vertex 0 sends a third of all links, vertex 1 receives another third.
    edges += [(0, 100 + i) for i in range(150)] + [(200 + i, 1) for i in range(150)]
    edges += [(100 + i, 0) for i in range(150)]
    expected = brute_force(edges)
    whole = ranks(pagerank(graph(spark, edges)))
    assert whole == pytest.approx(expected)
    seen = []
    links = module._links
    monkeypatch.setattr(module, "LINKS_PER_PARTITION", 60)
    monkeypatch.setattr(module, "LIST_LINKS", 7)
    monkeypatch.setattr(
        module, "_links", lambda *args: seen.append(args[3]) or links(*args)
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert ranks(pagerank(graph(spark, edges))) == pytest.approx(expected)
    assert seen == [True]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_superstep_shuffles_once(spark, monkeypatch):
    plans = []
    build = module._superstep

    def watched(*args):
        step = build(*args)

        def run(state, linked):
            after = step(state, linked)
            plans.append(after._jdf.queryExecution().executedPlan().toString())
            return after

        return run

    monkeypatch.setattr(module, "LINKS_PER_PARTITION", 100)
    monkeypatch.setattr(module, "_superstep", watched)
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 100, (700, 2))]
    assert ranks(pagerank(graph(spark, edges))) == pytest.approx(brute_force(edges))
    # The first step after a checkpoint: the plan above the cached links and the state.
    plan = plans[2]
    above = plan[: plan.index("InMemoryTableScan")]
    assert above.count("Exchange") == 1
    assert "SortMergeJoin" in above
    # Lists of sources that send nothing are dropped before their links are looked at.
    assert above.index("Generate") < above.index("SortMergeJoin")


def test_parts_follow_the_number_of_links():
    assert module._partitions(0, 200) == 1
    assert module._partitions(150_000, 200) == 1
    assert module._partitions(1_000_000, 200) == 5
    assert module._partitions(10**9, 200) == 200
    assert module._partitions(10**12, 200) == 50_000


def test_few_tasks_send_however_many_partitions(spark, monkeypatch):
    assert module._tasks(10**6, 5, 12) == 5
    assert module._tasks(10**7, 12, 12) == 6
    assert module._tasks(10**9, 100, 12) == 10
    assert module._tasks(10**7, 2, 1) == 2
    plans, parts = [], []
    build, links = module._superstep, module._links

    def watched(*args):
        step = build(*args)

        def run(state, linked):
            after = step(state, linked)
            plans.append(after._jdf.queryExecution().executedPlan().toString())
            return after

        return run

    monkeypatch.setattr(module, "_superstep", watched)
    monkeypatch.setattr(module, "_links", lambda *args: parts.append(args[4]) or links(*args))
    monkeypatch.setattr(module, "LINKS_PER_PARTITION", 20)
    random = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 100, (700, 2))]
    expected = brute_force(edges)
    cores = spark.sparkContext.defaultParallelism
    with module.settings(spark, spark__sql__shuffle__partitions=30):
        assert ranks(pagerank(graph(spark, edges))) == pytest.approx(expected)
        # Partitions that would be full: more of them, and no more tasks.
        monkeypatch.setattr(module, "FULL_LINKS", 40)
        assert ranks(pagerank(graph(spark, edges))) == pytest.approx(expected)
    assert parts[0] == cores and cores < parts[1] <= 30
    for plan in (plans[0], plans[-1]):
        assert f"Coalesce {cores // 2}" in plan


def test_empty_graph(spark):
    assert pagerank(graph(spark, [])).collect() == []


def test_text_ids_and_sinks(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    found = ranks(pagerank(edges))
    assert sum(found.values()) == pytest.approx(3)
    assert found["b"] == pytest.approx(found["c"])


def test_degrees_vertices_and_names(spark):
    df = graph(spark, EDGES)
    assert {r.id: r.degree for r in out_degrees(df).collect()} == {
        1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 2, 7: 2,
    }
    assert sorted(r.id for r in vertices(df).collect()) == sorted(RANKS)
    ranked = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1)], "id bigint, rank double")
    names = spark.createDataFrame(
        [(1, "ann"), (1, "anna"), (3, "cy"), (8, "zed")], "id bigint, username string"
    )
    assert sorted(map(tuple, ranks_by_name(ranked, names).collect())) == [
        ("ann", 0.5), ("anna", 0.5), ("cy", 0.1),
    ]


def blocks(monkeypatch, links=1):
    """Pack every graph into blocks, several for each part, from several goes."""
    calls = []
    run = module.block_ranks
    monkeypatch.setattr(module, "PACKED_LINKS", links)
    for name, size in (
        ("BLOCK_LINKS", 50), ("TASK_LINKS", 300), ("PACK_LINKS", 50), ("ROW_LINKS", 3),
        ("MERGED_IDS", 20),
    ):
        monkeypatch.setattr(rank_blocks, name, size)
    monkeypatch.setattr(module, "block_ranks", lambda *args: calls.append(args[1]) or run(*args))
    return calls


def odd_edges():
    random = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in random.integers(-40, 40, (400, 2))]
    # A vertex that sends most links, one that receives many, sinks, copies and large ids.
    edges += [(0, 100 + i) for i in range(300)] + [(200 + i, 1) for i in range(150)]
    edges += [(3, 7)] * 300 + [(8, 8), (2**62, -(2**62)), (5, 2**62), (2**40, 5)]
    return edges


def test_many_links_are_packed_into_blocks(spark, monkeypatch):
    edges = odd_edges()
    expected = brute_force(edges)
    calls = blocks(monkeypatch)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert ranks(pagerank(graph(spark, edges))) == pytest.approx(expected)
    assert ranks(pagerank(graph(spark, EDGES))) == pytest.approx(RANKS, abs=1e-6)
    assert ranks(pagerank(graph(spark, edges + [(None, 1), (2, None)]))) == pytest.approx(expected)
    assert len(calls) == 3
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert pagerank(graph(spark, [])).collect() == []


def test_large_tables_are_packed_without_counting_first(spark, monkeypatch, tmp_path):
    edges = odd_edges()
    path = str(tmp_path / "edges")
    graph(spark, edges + [(None, 1), (2, None)]).write.parquet(path)
    calls = blocks(monkeypatch, 100)
    monkeypatch.setattr(module, "EDGE_BYTES", 16)
    monkeypatch.setattr(module, "_partitions", None)
    read = spark.read.parquet(path)
    assert ranks(pagerank(read)) == pytest.approx(brute_force(edges))
    assert ranks(pagerank(read.filter("src is null"))) == {}
    assert len(calls) == 2


def test_blocks_of_text_ids(spark, monkeypatch):
    edges = odd_edges()
    calls = []
    run = module.named_block_ranks
    blocks(monkeypatch)
    monkeypatch.setattr(
        module, "named_block_ranks", lambda *args: calls.append(args[2]) or run(*args)
    )
    text = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in edges], "src string, dst string")
    expected = {f"v{at}": rank for at, rank in brute_force(edges).items()}
    assert ranks(pagerank(text)) == pytest.approx(expected)
    assert len(calls) == 1


def test_a_packed_superstep_shuffles_once(spark, monkeypatch):
    plans = []
    make = rank_blocks._superstep
    blocks(monkeypatch)

    def watched(*args):
        step = make(*args)
        step.__name__ = "watched_step"
        return step

    monkeypatch.setattr(rank_blocks, "_superstep", watched)
    checkpoint = type(spark.range(0)).checkpoint

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, *args)

    monkeypatch.setattr(type(spark.range(0)), "checkpoint", seen)
    pagerank(graph(spark, odd_edges()))
    steps = [plan for plan in plans if "watched_step" in plan]
    # Four supersteps from one checkpoint to the next: a shuffle each, and no row meets another.
    top = steps[1][: steps[1].index("InMemoryTableScan")]
    assert top.count("watched_step") == top.count("Exchange") == rank_blocks.STEPS
    assert "Join" not in top and "Aggregate" not in top


def test_parts_and_lanes_follow_the_number_of_links():
    assert rank_blocks._parts(0, 8) == (1, 1)
    assert rank_blocks._parts(3_000_000, 8) == (3, 1)
    assert rank_blocks._parts(425_000_000, 8) == (8, 7)
    assert rank_blocks._parts(425_000_000, 2) == (6, 12)
    assert rank_blocks._parts(10**10, 64) == (128, 1)
