import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import components, features, graph, hops, labels, pagerank, patterns, rings, sampling, sequence, skew


def edges_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id bigint, src bigint, dst bigint, t bigint").withColumn("value", F.lit(1.0))


def random_edges(seed, n=160, nodes=7, span=4000):
    rng = random.Random(seed)
    hub = lambda: 0 if rng.random() < 0.35 else rng.randrange(nodes)
    return [(hub(), hub(), rng.randrange(span)) for _ in range(n)]


def brute_patterns(rows, gap):
    out, ends = defaultdict(list), defaultdict(list)
    for s, d, t in rows:
        out[s].append((d, t))
        ends[s].append((d, t, 1))
        ends[d].append((s, t, 0))
    result = {}
    for n in ends:
        ref = max(t for _, t, _ in ends[n])
        starts = [(b, t) for b, t in out[n] if abs(ref - t) <= gap]
        two = sum(1 for b, t1 in starts for c, t2 in out[b] if c == n and t1 < t2 <= t1 + gap)
        three = sum(1 for b, t1 in starts for c, t2 in out[b] if c != n and t1 < t2 <= t1 + gap
                    for z, t3 in out[c] if z == n and t2 < t3 <= t1 + 2 * gap)
        fan_out = len({b for b, _ in starts})
        fan_in = len({b for b, t, o in ends[n] if not o and abs(ref - t) <= gap})
        burst = sum(1 for _, t, _ in ends[n] if abs(ref - t) <= patterns.BURST_WINDOW)
        result[n] = (two, three, fan_out >= 3, fan_out >= 5, fan_in >= 3, fan_in >= 5, burst >= 10)
    return result


@pytest.mark.parametrize("seed,rows_per_task", [(1, 2_000_000), (2, 20)])
def test_patterns_against_brute_force(spark, seed, rows_per_task):
    """A hub holds a third of the rows; the second case splits it over several salts."""
    rows = random_edges(seed)
    got = patterns.pattern_features(edges_of(spark, rows), evicting=False, gap=900, rows_per_task=rows_per_task).collect()
    want = brute_patterns(rows, 900)
    assert len(got) == len(want)
    for r in got:
        assert (r.cycle_2, r.cycle_3, r.fan_out_3, r.fan_out_5, r.fan_in_3, r.fan_in_5, r.burst) == tuple(map(int, want[r.node_id]))
    assert sum(w[1] for w in want.values()) > 0


def test_eviction_cut_off(spark):
    rows = [(i % 5, (i + 1) % 5, i * 10) for i in range(25)]
    held = patterns.evict(edges_of(spark, rows), window=50, every=10)
    assert sorted(r.t for r in held.collect()) == [t for _, _, t in rows if t >= 190 - 50]
    assert patterns.evict(edges_of(spark, rows), window=50, every=100).count() == 25


def test_chain_and_star_extension(spark):
    e = edges_of(spark, [(1, 2, 10), (2, 3, 20), (3, 4, 30), (4, 1, 40), (1, 3, 50), (3, 1, 60), (2, 1, 70)])
    w, refs = patterns.collapse(e), graph.node_last_time(e)
    chains = {r.node: r["count"] for r in patterns.temporal_chains(w, refs, 3, 3600).collect()}
    assert chains[1] == 1 and chains[2] == 2
    assert {r.node: r["count"] for r in patterns.cycle_4_counts(w, refs).collect()} == {1: 1}
    stars = {r.node: r["count"] for r in patterns.star_flags(w, refs, 2, 3600).collect()}
    assert stars[1] == 1 and stars.get(2, 0) == 0
    wide = patterns.pattern_features(e, evicting=False, extended=True).filter("node_id = 1").first()
    assert (wide.chain_3, wide.cycle_4) == (1, 1)


def test_hot_key_join_keeps_every_row(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 700, 1).otherwise(F.col("id"))).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    joined = skew.hot_key_join(rows, keyed, ["k"], "n", ["id"], rows_per_task=50)
    assert joined.count() == 1000 and joined.filter("v <> k * 2").count() == 0


def test_dense_index_with_a_hot_second(spark):
    rows = [(1, 2, 0)] * 40 + [(1, 2, 90000 + i % 7) for i in range(60)]
    got = sequence.edge_seq(edges_of(spark, rows)).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(100))
    assert [(r.t, r.edge_id) for r in got] == sorted((r.t, r.edge_id) for r in got)


def test_addresses_with_one_prefix_spread_over_slices(spark):
    names = [f"0x{i:040x}" for i in range(400)]
    rows = spark.createDataFrame(list(zip(names, reversed(names))), "from_address string, to_address string")
    slices = skew.ranged(rows, F.col("from_address")).groupBy("_range").count().collect()
    assert len(slices) > 1 and max(r["count"] for r in slices) < 200
    index = graph.build_address_index(rows).orderBy("address").collect()
    assert [(r.address, r.node_id, r.n) for r in index] == [(a, i, 2) for i, a in enumerate(names)]


def brute_scc(rows):
    reach = defaultdict(set)
    for s, d, _ in rows:
        reach[s].add(d)
    nodes = {n for s, d, _ in rows for n in (s, d)}
    for k in nodes:
        for i in nodes:
            if k in reach[i]:
                reach[i] |= reach[k]
    groups = {}
    for n in nodes:
        mates = {m for m in reach[n] if n in reach[m]} | {n}
        if len(mates) > 1:
            groups[n] = min(mates)
    return groups


@pytest.mark.parametrize("seed", [3, 4])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(30), rng.randrange(30), i) for i in range(34)]
    e = edges_of(spark, rows)
    assert {r.node_id: r.component for r in components.strong_components(e).collect()} == brute_scc(rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, d, _ in rows:
        a, b = find(s), find(d)
        parent[max(a, b)] = min(a, b)
    assert {r.node_id: r.component for r in components.connected_components(e).collect()} == {n: find(n) for n in list(parent)}


def test_long_path_component(spark):
    rows = [(i, i + 1, i) for i in range(60)]
    got = components.connected_components(edges_of(spark, rows))
    assert got.count() == 61 and got.filter("component <> 0").count() == 0
    assert components.strong_components(edges_of(spark, rows)).count() == 0


def test_rings_of_the_example_graph(spark):
    rows = [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (4, 5, 5), (5, 6, 6), (6, 4, 7), (0, 4, 8), (0, 1, 9)]
    e = edges_of(spark, rows)
    labelled = spark.createDataFrame([(n, int(n != 4)) for n in range(7)], "node_id bigint, label int")
    members = rings.ring_members(e, labelled)
    summary = {r.ring_id: tuple(r)[1:] for r in rings.ring_summary(members, rings.fraud_edges(e, labelled)).collect()}
    assert summary == {0: (4, 2, 9, 4), 5: (2, 6, 6, 1)}
    dense = labels.dense_component_nodes(e)
    assert sorted(r.node_id for r in dense.collect()) == [0, 1, 2, 3, 4, 5, 6]
    near = rings.ring_neighbourhood(members, e).collect()
    assert sorted(tuple(r) for r in near) == [(0, 4), (5, 4)]


def test_pagerank(spark):
    rows = [(0, 1, 1), (1, 2, 2), (2, 0, 3), (3, 0, 4), (0, 4, 5)]
    got = {r.node_id: r.pagerank for r in pagerank.pagerank(edges_of(spark, rows), rows_per_task=1).collect()}
    out = defaultdict(list)
    for s, d, _ in rows:
        out[s].append(d)
    want = dict.fromkeys(range(5), 0.2)
    for _ in range(200):
        lost = sum(v for n, v in want.items() if not out[n])
        want = {n: 0.85 * (sum(want[s] / len(out[s]) for s in out if n in out[s]) + lost / 5) + 0.03 for n in want}
    assert all(abs(got[n] - want[n]) < 1e-4 for n in want)


def test_subgraph_node_times(spark):
    e = edges_of(spark, [(10, 20, 5), (20, 30, 8), (20, 99, 50)])
    nodes = spark.createDataFrame([(10,), (20,), (30,), (40,)], "node_id bigint")
    got = {r.node_id: r.last_time for r in graph.subgraph_node_time(nodes, e).collect()}
    assert got == {10: 5.0, 20: 8.0, 30: 8.0, 40: float("inf")}


def test_k_hop_follows_edges_backwards(spark):
    e = edges_of(spark, [(1, 2, 1), (2, 3, 2), (3, 4, 3), (0, 1, 4)])
    seeds = spark.createDataFrame([(3,)], "node_id bigint")
    assert sorted(r.node_id for r in hops.k_hop_nodes(e, seeds).collect()) == [1, 2, 3]
    nodes, inner = hops.subgraphs(e, seeds)
    pe = {r.node_id: (r.pe_0, r.pe_1, r.pe_2) for r in hops.position_encoding(nodes, inner).collect()}
    assert pe == {2: (1.0, 0.5, 0.5), 1: (0.5, 1.0, 0.0), 3: (0.5, 0.0, 1.0)}


def test_address_features(spark):
    e = edges_of(spark, [(1, 2, 0), (1, 2, 100), (2, 1, 400), (1, 3, 1000)])
    f = features.address_features(e).filter("node_id = 1").first()
    assert (f.in_degree, f.out_degree, f.tx_count, f.activity_span) == (1, 2, 3, 900.0)
    assert f.inter_tx_time_mean == 450.0 and abs(f.inter_tx_time_std - 150.0) < 1e-9 and f.pagerank > 0


def test_samples_are_stable(spark):
    marked = spark.range(400).select(F.col("id").alias("node_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = sampling.balanced_seeds(marked, 20)
    assert {r["label"]: r["count"] for r in a.groupBy("label").count().collect()} == {0: 20, 1: 20}
    ids = lambda df: sorted(r.node_id for r in df.collect())
    assert ids(a) == ids(sampling.balanced_seeds(marked.repartition(7), 20))
    with pytest.raises(ValueError):
        sampling.balanced_seeds(marked.filter("label = 0 OR node_id < 30"), 20)
    split = sampling.split_70_15_15(marked, "node_id", stratify="label").groupBy("label", "part").count().collect()
    train, upto_val = {0: int(0.7 * 360), 1: int(0.7 * 40)}, {0: int(0.85 * 360), 1: int(0.85 * 40)}
    want = {}
    for label, size in ((0, 360), (1, 40)):
        want |= {(label, "train"): train[label], (label, "val"): upto_val[label] - train[label], (label, "test"): size - upto_val[label]}
    assert {(r.label, r.part): r["count"] for r in split} == want


def test_augmentations_keep_their_minimum(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(6)], "seed bigint, node_id bigint")
    e = edges_of(spark, [(i, i + 1, i) for i in range(5)]).withColumn("seed", F.lit(1).cast("bigint"))
    assert sampling.drop_edges(e, rate=1.1).count() == 1
    kept, inner = sampling.drop_nodes(nodes, e, rate=1.1)
    assert kept.count() == 2 and inner.join(kept.withColumnRenamed("node_id", "src"), ["seed", "src"], "left_anti").count() == 0
    cropped, _ = sampling.crop(nodes, e, ratio=0.5)
    assert cropped.count() in (3, 6)
    assert sampling.mask_features(nodes.withColumn("x", F.lit(1.0)), ["x"], rate=1.1).agg(F.sum("x")).first()[0] == 0.0


def test_distances_from_many_sources_at_once(spark):
    """Forty sources need two masks; distances equal a search from each."""
    import random
    from collections import deque

    rng = random.Random(3)
    edges = [(s, rng.randrange(60), rng.randrange(60)) for s in (1, 2) for _ in range(70)] + [(1, 100, 100)]
    sources = [(s, a) for s in (1, 2) for a in rng.sample(range(60), 40)] + [(2, 999)]
    want = set()
    for seed, anchor in sources:
        near = {anchor: 0}
        queue = deque([anchor])
        while queue:
            x = queue.popleft()
            for s, a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if s == seed and p == x and q not in near:
                        near[q] = near[x] + 1
                        queue.append(q)
        want |= {(seed, anchor, node, d) for node, d in near.items()}
    sub = spark.createDataFrame(edges, "seed bigint, src bigint, dst bigint")
    got = hops.hop_distances(sub, spark.createDataFrame(sources, "seed bigint, anchor bigint"))
    assert {tuple(r) for r in got.collect()} == want
