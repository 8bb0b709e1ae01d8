"""Hand graphs, invariants and every query against its oracle."""

import duckdb
import numpy as np
import pytest

from graphloom.graph import Graph
from graphloom.operators import betweenness, bfs, components, katz, pagerank, triangles
from graphloom.operators.stars import star_components
from graphloom.plans import registry
from graphloom.session import Staging
from graphloom.sources import generators, readers, updates
from graphloom.streaming.incremental import BATCH, KatzState, TriangleState, run_stream

TABLES = "region nation customer supplier part orders lineitem events".split()


def graph(spark, pairs, symmetric=True, vertices=None):
    rows = [*pairs, *((b, a) for a, b in pairs)] if symmetric else list(pairs)
    edges = spark.createDataFrame(rows, "src long, dst long")
    v = spark.createDataFrame([(i,) for i in vertices], "id long") if vertices else None
    return Graph.from_edges(edges, v, directed=not symmetric)


def as_dict(df, key="id"):
    return {r[key]: r[[c for c in df.columns if c != key][0]] for r in df.collect()}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_oracle(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda frame: sorted(tuple(r) for r in frame[columns].astype(object).values.tolist())
    assert rows(got.toPandas()) == rows(want.df())


def test_path(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    for s in ("auto", "top_down", "bottom_up", "hybrid"):
        assert as_dict(bfs.bfs(g, 0, s)) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert bfs.level_count(bfs.bfs(g, 0)).first() == (4, 4)
    assert as_dict(betweenness.betweenness(g)) == {0: 0.0, 1: 4.0, 2: 4.0, 3: 0.0}
    assert as_dict(betweenness.betweenness(g, block=1, local_edges=0)) == {0: 0.0, 1: 4.0, 2: 4.0, 3: 0.0}


def test_triangle_and_isolated(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)], vertices=[0, 1, 2, 3])
    assert as_dict(triangles.per_vertex(g)) == {0: 2, 1: 2, 2: 2, 3: 0}
    assert triangles.total(g).first() == (1, 3, 6)
    labels = components.connected_components(g)
    assert components.component_count(g, labels).first()[0] == 1
    assert components.component_count(g, labels, singletons=True).first()[0] == 2
    assert as_dict(pagerank.page_rank(g)[0])[3] == 0.0
    assert as_dict(pagerank.page_rank(g, isolated="base")[0])[3] > 0


def test_k4_and_star(spark):
    k4 = graph(spark, [(a, b) for a in range(4) for b in range(a + 1, 4)])
    assert set(as_dict(triangles.per_vertex(k4)).values()) == {6}
    star = graph(spark, [(0, i) for i in range(1, 6)])
    assert katz.katz(star).alpha == 1 / 6


def test_components_small(spark):
    for s in ("auto", "baseline", "concurrent", "load_balanced", "delta"):
        labels, rounds = components.components_and_rounds(graph(spark, [(0, 1), (2, 3)]), s)
        assert as_dict(labels) == {0: 1, 1: 1, 2: 3, 3: 3} and rounds == (0 if s == "auto" else 2)
    chain = graph(spark, [(0, 1), (1, 2)], symmetric=False)
    labels = components.connected_components(chain)
    assert set(as_dict(labels).values()) == {2}
    assert components.component_count(chain, labels).first()[0] == 0


def test_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)], "u long, v long")
    found = as_dict(star_components(edges), "u")
    assert found == {**{i: 1 for i in range(2, 61)}, 200: 100, 300: 100}


def test_batches_are_idempotent(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    batch = spark.createDataFrame([(0, 2), (2, 0), (0, 2), (0, 1), (4, 4)], "src long, dst long")
    after = updates.insert(g, batch)
    assert after.edges.count() == 8
    assert updates.differences(updates.delete(after, batch.where("dst = 2 or dst = 0")), g).count() == 0


def test_streams_equal_recompute(spark, tmp_path):
    g = graph(spark, [(a, b) for a in range(8) for b in range(a + 1, 8) if (a * 3 + b) % 4])
    rows = [(0, "insert", 0, 9), (0, "insert", 1, 9), (0, "insert", 0, 1), (1, "delete", 0, 1), (1, "delete", 2, 3)]
    for b in (0, 1):
        spark.createDataFrame([r for r in rows if r[0] == b], BATCH).coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
    tri, kz = TriangleState(g), KatzState(g, 6, 1)
    assert run_stream(spark, tri, f"{tmp_path}/in/*", f"{tmp_path}/c1") >= 1
    run_stream(spark, kz, f"{tmp_path}/in/*", f"{tmp_path}/c2")
    end = tri.graph
    assert as_dict(tri.counts) == as_dict(triangles.per_vertex(end))
    want = as_dict(katz.scores_of(katz.fixed_rounds(end, len(kz.history) - 1, kz.alpha)))
    got = as_dict(kz.scores())
    assert all(abs(got[i] - want[i]) < 1e-10 for i in want)


def test_stream_goes_on_after_its_driver(spark, tmp_path):
    """A new state with the same paths takes up what the last one left, and applies no batch twice."""
    g = graph(spark, [(a, b) for a in range(7) for b in range(a + 1, 7) if (a * 3 + b) % 4])
    batches = [(0, "insert", 0, 8), (1, "delete", 0, 1), (2, "insert", 1, 8)]

    def put(i):
        spark.createDataFrame([batches[i]], BATCH).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")

    for name, make in (("t", lambda: TriangleState(g)), ("k", lambda: KatzState(g, 5, 0, 9))):
        where = {"path": f"{tmp_path}/in/*", "checkpoint_path": f"{tmp_path}/c{name}", "state_path": f"{tmp_path}/s{name}"}
        if name == "t":
            put(0), put(1)
            assert run_stream(spark, make(), **where) == 2
            put(2)
            again = make()
            assert run_stream(spark, again, **where) == 1 and again.graph.edges.count() == g.edges.count() + 2
            assert as_dict(again.counts) == as_dict(triangles.per_vertex(again.graph))
            # the stream forgets what it has done; the state does not
            where["checkpoint_path"] += "-new"
            last = make()
            assert run_stream(spark, last, **where) == 0 and as_dict(last.counts) == as_dict(again.counts)
        else:
            assert run_stream(spark, make(), **where) == 3
            last = make()
            assert run_stream(spark, last, **where) == 0 and last.graph.edges.count() == g.edges.count() + 2
            want = as_dict(katz.scores_of(katz.fixed_rounds(last.graph, 4, last.alpha)))
            assert all(abs(x - want[i]) < 1e-10 for i, x in as_dict(last.scores()).items())


@pytest.mark.parametrize("seed", range(4))
def test_kernels(seed):
    """The kernels against plain Python on random graphs, directed and not."""
    import numpy as np

    from graphloom.operators import small

    rng = np.random.default_rng(seed)
    ids = np.sort(rng.choice(2**40, 40, replace=False))
    src, dst = ids[rng.integers(0, 40, 70)], ids[rng.integers(0, 40, 70)]
    keep = np.unique(np.stack([src, dst])[:, src != dst], axis=1)
    src, dst = keep if seed % 2 else np.unique(np.concatenate([keep, keep[::-1]], axis=1), axis=1)
    out = {}
    for a, b in zip(src.tolist(), dst.tolist()):
        out.setdefault(a, []).append(b)

    def walk(root):
        level, paths, order = {root: 0}, {root: 1}, [root]
        for v in order:
            for w in out.get(v, []):
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        return level, paths, order

    every = np.unique(np.r_[src, dst])
    bc = dict.fromkeys(every.tolist(), 0.0)
    for root in every.tolist():
        level, paths, order = walk(root)
        assert dict(zip(*(x.tolist() for x in small.levels(src, dst, root)))) == level
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in out.get(v, []) if level[w] == level[v] + 1)
            bc[v] += delta[v] if v != root else 0
    place = lambda x: np.searchsorted(every, x)
    got = small.dependencies(every, place(src), place(dst), place(every), np.ones(len(every)))
    assert np.allclose(got, [bc[i] for i in every.tolist()])
    label = {i: i for i in every.tolist()}
    for _ in every:
        for a, b in zip(src.tolist(), dst.tolist()):
            label[a] = label[b] = max(label[a], label[b])
    assert dict(zip(*(x.tolist() for x in small.labels(src, dst)))) == label


def test_readers(spark, tmp_path):
    (tmp_path / "a.graph").write_text("% c\n3 2\n2\n1 3\n2\n")
    (tmp_path / "a.txt").write_text("# c\n10\t20\n20 30\n")
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n3 2\n")
    pairs = lambda g: sorted(map(tuple, g.edges.collect()))
    both = [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert pairs(readers.read_graph(spark, str(tmp_path / "a.graph"))) == both
    assert pairs(readers.read_graph(spark, str(tmp_path / "a.mtx"))) == both
    assert pairs(readers.read_graph(spark, str(tmp_path / "a.txt"))) == [(10, 20), (20, 30)]
    assert pairs(readers.read_snap(spark, str(tmp_path / "a.txt"), relabel=True)) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        readers.read_graph(spark, "a.xyz")
    g = graph(spark, [(0, 1)])
    readers.write_parquet(g, f"{tmp_path}/e.parquet", f"{tmp_path}/v.parquet")
    assert pairs(readers.read_parquet(spark, f"{tmp_path}/e.parquet", f"{tmp_path}/v.parquet")) == [(0, 1), (1, 0)]


def test_csr_and_generators(spark):
    g = Graph.from_csr(spark, [0, 1, 3, 3], [1, 0, 2], directed=True)
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 0), (1, 2)] and g.vertices.count() == 3
    made = generators.rmat(spark, 6, 500).agg({"src": "max", "dst": "max"}).first()
    assert max(made) < 64
    roots = betweenness.sample_roots(g, 20).collect()
    assert len(roots) == 20 and {r.root for r in roots} <= {0, 1, 2}


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert pagerank.page_rank(g)[0].count() == 0 and triangles.per_vertex(g).count() == 0
    assert components.connected_components(g).count() == 0 and bfs.bfs(g, 0).count() == 0


def test_triangles_in_turns_shuffle_no_wedges(spark, tmp_path):
    rng = np.random.default_rng(5)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (500, 2)) if a != b}
    edges = spark.createDataFrame(sorted(pairs) + [(b, a) for a, b in sorted(pairs)], "src long, dst long")
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(60)}
    want = {v: 2 * sum(1 for a in near[v] for b in near[v] if a < b and (a, b) in pairs) for v in range(60) if near[v]}
    for graph in (Graph.from_edges(edges), Graph.from_pairs(edges.where("src < dst"))):
        assert as_dict(triangles.per_vertex(graph, turn=100)) == want
        assert triangles.total(graph, turn=100).first()["six"] == sum(want.values())
    far = Graph.from_edges(edges.selectExpr("src - 5000000000 AS src", "dst - 5000000000 AS dst"))  # ids beyond 31 bits
    assert as_dict(triangles.per_vertex(far, turn=200)) == {v - 5000000000: n for v, n in want.items()}
    with Staging(spark, "test") as st:
        wedges = triangles._Wedges(Graph.from_edges(edges), st, 100)
        found = wedges.closed(0)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert wedges.turns > 1 and "BroadcastHashJoin" in plan and "hashpartitioning(x" not in plan and "hashpartitioning(pair" not in plan
        wedges.close()


def test_betweenness_by_components(spark):
    """Components dealt to tasks, the broadcast graph and the joins give the same, whatever component is too large."""
    rng = np.random.default_rng(11)
    pairs = {(int(a) + 30 * g, int(b) + 30 * g) for g in range(4) for a, b in rng.integers(0, 30, (20 + 15 * g, 2)) if a != b}
    edges = spark.createDataFrame([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs], "src long, dst long").distinct()
    g = Graph.from_edges(edges, spark.range(130).select("id"))
    roots = spark.createDataFrame([(i,) for i in range(0, 130, 3)] + [(3,), (129,)], "root long")
    near = lambda x, y: x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)
    want = as_dict(betweenness.betweenness(g, roots, local_edges=0, component_edges=0))
    deep = {tuple(r) for r in betweenness.levels(g, roots, local_edges=0, component_edges=0).collect()}
    assert sum(want.values()) > 0
    for local, component in ((1000, 1000), (0, 1000), (0, 60)):
        assert near(as_dict(betweenness.betweenness(g, roots, local_edges=local, component_edges=component)), want)
        got = [tuple(r) for r in betweenness.levels(g, roots, local_edges=local, component_edges=component).collect()]
        assert len(got) == len(deep) and set(got) == deep


def _slow_dependencies(n, src, dst, roots, times):
    """Brandes root by root."""
    total = np.zeros(n)
    for root, many in zip(roots, times):
        depth, paths, front = np.full(n, -1), np.zeros(n), [root]
        depth[root], paths[root], order = 0, 1, [root]
        while front:
            here, front = front, []
            for v in here:
                for w in dst[src == v]:
                    if depth[w] < 0:
                        depth[w] = depth[v] + 1
                        front.append(w)
                    if depth[w] == depth[v] + 1:
                        paths[w] += paths[v]
            order += front
        delta = np.zeros(n)
        for v in order[::-1]:
            for w in dst[src == v]:
                if depth[w] == depth[v] + 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
        delta[root] = 0
        total += many * delta
    return total


def test_dependencies_fold_trees_and_search_the_rest_in_lanes(monkeypatch):
    """Any edges (directed, repeated, loops, long paths): the same as root by root, in one part or three."""
    from graphloom.operators import small

    rng = np.random.default_rng(3)
    graphs = [(n, *rng.integers(0, n, (2, m))) for n, m in ((1, 0), (9, 12), (30, 25), (40, 60), (50, 45))]
    graphs += [(n, np.r_[s, d], np.r_[d, s]) for n, s, d in graphs]
    ring = np.arange(2 * small.UNREACHED + 10)
    graphs.append((len(ring), np.r_[ring, np.roll(ring, -1)], np.r_[np.roll(ring, -1), ring]))
    for n, s, d in graphs:
        roots = rng.choice(n, min(n, 12), replace=False)
        times = rng.integers(1, 4, len(roots)).astype(float)
        want = _slow_dependencies(n, s, d, roots, times)
        for cells in (1 << 20, 40):
            monkeypatch.setattr(small, "CELLS", cells)
            got = [small.dependencies(np.arange(n), s, d, roots, times, i, 3) for i in range(3)]
            assert np.allclose(sum(got), want) and np.allclose(small.dependencies(np.arange(n), s, d, roots, times), want)


def test_dependencies_search_no_trees(monkeypatch):
    from graphloom.operators import small

    searched = []
    monkeypatch.setattr(small.Paths, "search", lambda self, roots: searched.append(len(roots)))
    n = 600
    up = np.random.default_rng(4).integers(0, np.arange(1, n))
    src, dst = np.r_[up, np.arange(1, n)], np.r_[np.arange(1, n), up]
    got = small.dependencies(np.arange(n), src, dst, np.arange(n), np.ones(n))
    monkeypatch.undo()
    assert not searched and np.allclose(got[:5], _slow_dependencies(n, src, dst, np.arange(n), np.ones(n))[:5])


def test_components_by_one_task_where_pairs_are_few(spark, monkeypatch):
    """A graph with more edges than one task takes, but not more pairs of ends, needs no rounds of joins."""
    rng = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2)) if a != b} | {(3, 3)})
    g = graph(spark, pairs, vertices=range(92))
    want = as_dict(components.connected_components(g, "baseline"))
    monkeypatch.setattr(components.kernels, "is_small", lambda edges, bound=0: False)
    found, rounds = components.components_and_rounds(g)
    assert rounds == 0 and as_dict(found) == want
    monkeypatch.setattr(components.kernels, "LOCAL_EDGES", 5)
    found, rounds = components.components_and_rounds(g)
    assert rounds > 0 and as_dict(found) == want


def test_levels_search_components_side_by_side(spark, monkeypatch):
    """Many small components with a root each are one search, not one for each 64 roots."""
    from graphloom.operators import small

    searched, search = [], small.Lanes.search
    monkeypatch.setattr(small.Lanes, "search", lambda self, depths: searched.append(self.n) or search(self, depths))
    base = 3 * np.arange(300)
    src, dst = np.r_[base, base + 1], np.r_[base + 1, base + 2]
    got = [r for b in small._levels(np.r_[src, dst], np.r_[dst, src], base, np.ones(300)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert searched == [900] and sorted(got) == [(b, b + d, d, 1.0) for b in base.tolist() for d in range(3)]
