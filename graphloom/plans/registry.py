"""All queries of the graph engine by name, and their DuckDB oracles.

A query takes (spark, sf_dir) and returns a DataFrame over the whole fixture graph; floating results are rounded the same
way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.graph import Graph
from graphloom.operators import betweenness, bfs, components, katz, pagerank, traverse, triangles
from graphloom.plans import fixtures, oracles, work
from graphloom.plans.fixtures import BUCKET, D_SQL, S_SQL, T_SQL
from graphloom.plans.oracles import DEGREE, ENDS, PARTS
from graphloom.session import Staging, checkpoint
from graphloom.sources import generators, readers, updates
from graphloom.streaming.incremental import KatzState, TriangleState, run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def on(graph: Callable[[SparkSession, str], Graph], work_: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: work_(graph(spark, sf_dir))


def settled(column: str, scale: float) -> Column:
    """Rounded off the middle: Katz and betweenness values are often exact halves of the last digit, which noise would flip."""
    return F.floor(F.col(column) * F.lit(scale) + F.lit(0.37)) / F.lit(scale)


def root_of(graph: Graph) -> int:
    return graph.max_degree_vertex().first()["id"]


S, U, D, T = fixtures.sparse, fixtures.sparse_universe, fixtures.dense, fixtures.transitions
_with = oracles._with

# --- graph container -----------------------------------------------------------------------------------------------

query("degrees", _with(S_SQL, PARTS, DEGREE) + "SELECT u.id, coalesce(degree, 0) AS degree FROM u LEFT JOIN d USING (id)")(on(U, Graph.degrees))
query("degree_histogram", _with(S_SQL, PARTS, DEGREE) + "SELECT coalesce(degree, 0) AS degree, count(*) AS vertices FROM u LEFT JOIN d USING (id) GROUP BY 1")(on(U, Graph.degree_histogram))
query("edge_count", _with(D_SQL) + "SELECT count(*) AS edges FROM e")(on(D, Graph.edge_count))
query("vertex_universe", _with(T_SQL, ENDS) + "SELECT id FROM u")(on(T, lambda g: g.vertices))
query("max_degree_vertex", _with(D_SQL, DEGREE) + "SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 1")(on(D, Graph.max_degree_vertex))
query("transpose", _with(T_SQL) + "SELECT dst AS src, src AS dst FROM e")(on(T, lambda g: g.transpose().edges))
query("symmetrize", _with(T_SQL) + "SELECT src, dst FROM e UNION SELECT dst, src FROM e")(on(T, lambda g: g.symmetrize().edges))


@query("simple_graph", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return Graph.from_edges(lines, directed=True).simple().edges


query("adjacency", _with(S_SQL) + "SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")(
    on(S, lambda g: g.adjacency().select("id", F.array_join("neighbours", ",").alias("neighbours")))
)
query("nonzero_vertices", _with(S_SQL, DEGREE) + "SELECT id FROM d")(on(U, Graph.nonzero_vertices))
query("prefix_work", oracles.prefix(S_SQL))(on(S, work.prefix_work))
query("random_list", oracles.random_list(11))(on(S, lambda g: work.listed(g, zeros=False, seed=11)))
query("work_partitions", oracles.partitions(S_SQL))(on(S, work.work_partitions))

# --- traversal operators -------------------------------------------------------------------------------------------


def _degree_state(g: Graph) -> DataFrame:
    return g.degrees()


query("traverse_vertices", _with(S_SQL, PARTS, DEGREE) + "SELECT u.id, coalesce(degree, 0) AS degree, round(CASE WHEN degree > 0 THEN 1.0::DOUBLE / degree ELSE 0 END, 9) AS share FROM u LEFT JOIN d USING (id)")(
    on(U, lambda g: traverse.map_vertices(_degree_state(g), lambda: {"share": F.round(fn.contribution(F.lit(1.0), F.col("degree")), 9)}))
)
query("traverse_edges", _with(S_SQL, DEGREE) + "SELECT src AS id, CAST(sum(x.degree * y.degree) AS BIGINT) AS value FROM e JOIN d x ON x.id = e.src JOIN d y ON y.id = e.dst GROUP BY src")(
    on(S, lambda g: traverse.gather(g.edges, _degree_state(g), lambda: F.col("s_degree") * F.col("d_degree")))
)
query("traverse_listed_vertices", _with(S_SQL, PARTS, DEGREE) + "SELECT u.id, coalesce(degree, 0) * 2 AS degree FROM u LEFT JOIN d USING (id) WHERE u.id % 7 = 3")(
    on(U, lambda g: traverse.map_listed(_degree_state(g), g.vertices.where("id % 7 = 3"), lambda: {"degree": F.col("degree") * 2}))
)
query("traverse_listed_edges", _with(S_SQL) + "SELECT src, dst FROM e WHERE src % 7 = 3")(on(S, lambda g: traverse.expand_once(g.vertices.where("id % 7 = 3"), g.edges)))
query("traverse_frontier", _with(S_SQL) + "SELECT dst AS id, count(*) AS visits FROM e WHERE src % 5 = 0 GROUP BY dst")(
    on(S, lambda g: traverse.expand(g.vertices.where("id % 5 = 0"), g.edges).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("visits")))
)
query("traverse_batch", _with(S_SQL, DEGREE) + f"SELECT src, dst, x.degree + y.degree AS value FROM e JOIN d x ON x.id = e.src JOIN d y ON y.id = e.dst WHERE {BUCKET} = 8")(
    on(S, lambda g: traverse.batch_edges(g.edges.where(generators.bucket() == 8), _degree_state(g), lambda: F.col("s_degree") + F.col("d_degree")))
)

# --- breadth-first search ------------------------------------------------------------------------------------------

for _s in ("auto", "top_down", "bottom_up", "hybrid"):
    query(f"bfs_{_s}", oracles.bfs(S_SQL))(on(S, lambda g, s=_s: bfs.bfs(g, root_of(g), s)))
query("bfs_directed", oracles.bfs(T_SQL))(on(T, lambda g: bfs.bfs(g, root_of(g), "hybrid")))
query("bfs_summary", oracles.bfs_summary(S_SQL))(on(S, lambda g: bfs.level_count(bfs.bfs(g, root_of(g)))))
query("bfs_unreached", oracles.bfs_unreached())(on(U, lambda g: bfs.with_unreached(g, bfs.bfs(g, root_of(g)), bfs.UNREACHED)))

# --- components ----------------------------------------------------------------------------------------------------

_LABELS = "SELECT v AS id, lab AS label FROM cc"
for _s in ("auto", "baseline", "concurrent", "load_balanced", "delta"):
    query(f"cc_{_s}", oracles.components(S_SQL, PARTS, _LABELS))(on(U, lambda g, s=_s: components.connected_components(g, s)))
query("cc_weak_directed", oracles.components(T_SQL, ENDS, _LABELS))(on(T, components.connected_components))
query("cc_count", oracles.components(S_SQL, PARTS, "SELECT count(*) AS components FROM cc WHERE v = lab AND v IN (SELECT src FROM e)"))(
    on(U, lambda g: components.component_count(g, components.connected_components(g)))
)
query("cc_count_all", oracles.components(S_SQL, PARTS, "SELECT count(*) AS components FROM cc WHERE v = lab"))(
    on(U, lambda g: components.component_count(g, components.connected_components(g), singletons=True))
)
query("cc_sizes", oracles.components(S_SQL, PARTS, "SELECT lab AS label, count(*) AS size FROM cc GROUP BY lab"))(on(U, lambda g: components.component_sizes(components.connected_components(g))))
query("cc_shortcut", "WITH s AS (SELECT p_partkey AS id, greatest(p_partkey - 2, p_partkey % 2) AS label FROM part) SELECT a.id, b.label FROM s a JOIN s b ON b.id = a.label")(
    lambda spark, sf_dir: components.shortcut(
        spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.greatest(F.col("p_partkey") - 2, F.col("p_partkey") % 2).alias("label"))
    )
)

# --- PageRank ------------------------------------------------------------------------------------------------------

_SCORE = "SELECT id, round(score, 9) AS score FROM score"


def _rank(rounds: int, threshold: float = 0.0, **options) -> Callable[[Graph], DataFrame]:
    return lambda g: pagerank.page_rank(g, rounds, threshold, **options)[0].select("id", F.round("score", 9).alias("score"))


query("pagerank_5", oracles.page_rank(S_SQL, PARTS, 5, 0.0, _SCORE))(on(U, _rank(5)))
query("pagerank_20", oracles.page_rank(S_SQL, ENDS, 20, 0.0, _SCORE))(on(S, _rank(20)))
query("pagerank_converged", oracles.page_rank(S_SQL, ENDS, 20, 0.01, _SCORE))(on(S, _rank(20, 0.01)))
query("pagerank_dense", oracles.page_rank(D_SQL, ENDS, 5, 0.0, _SCORE))(on(D, _rank(5)))
query("pagerank_push", oracles.page_rank(T_SQL, ENDS, 10, 0.0, _SCORE, push=True))(on(T, _rank(10, direction="push")))
query("pagerank_top10", oracles.page_rank(S_SQL, ENDS, 5, 0.0, "SELECT id, round(score, 9) AS score FROM score ORDER BY round(score, 9) DESC, id LIMIT 10"))(
    on(S, lambda g: pagerank.ranking(_rank(5)(g)))
)
query("pagerank_sum", oracles.page_rank(S_SQL, PARTS, 5, 0.0, "SELECT round(sum(score), 6) AS total FROM score"))(
    on(U, lambda g: pagerank.total(pagerank.page_rank(g, 5, 0.0)[0]).select(F.round("total", 6).alias("total")))
)

query("pagerank_iterations", oracles.page_rank(S_SQL, ENDS, 20, 0.01, oracles.iterations(20, 0.01)))(
    on(S, lambda g: g.edges.sparkSession.createDataFrame([(pagerank.page_rank(g, 20, 0.01)[1],)], "iterations int"))
)

# --- triangles -----------------------------------------------------------------------------------------------------

query("triangles_per_vertex", oracles.triangles_per_vertex(D_SQL, (2, 2, 2)))(lambda spark, sf_dir: fixtures.on_dense_pairs(spark, sf_dir, triangles.per_vertex))
query("triangles_csr", oracles.triangles_per_vertex(S_SQL, (2, 1, 0)))(on(S, lambda g: triangles.per_vertex(g, "three")))
query("triangles_total", _with(D_SQL, oracles.TRI.format(e="e")) + "SELECT count(*) AS triangles, count(*) * 3 AS three, count(*) * 6 AS six FROM t")(lambda spark, sf_dir: fixtures.on_dense_pairs(spark, sf_dir, triangles.total))
query("common_neighbours", _with(S_SQL) + "SELECT e.src, e.dst, count(y.dst) AS common FROM e LEFT JOIN (SELECT x.src, x.dst AS via, y.dst FROM e x JOIN e y ON y.src = x.dst) y ON y.src = e.src AND y.dst = e.dst GROUP BY e.src, e.dst")(
    on(S, triangles.common_neighbours)
)

# --- Katz ----------------------------------------------------------------------------------------------------------

query("katz_scores", oracles.katz(S_SQL, ENDS, 20, 100, "SELECT id, floor(kc * 1e9 + 0.37) / 1e9 AS kc FROM k"))(on(S, lambda g: katz.katz(g, 20, 100).scores().select("id", settled("kc", 1e9).alias("kc"))))
query("katz_bounds", oracles.katz(S_SQL, ENDS, 20, 10, "SELECT id, floor(lower * 1e9 + 0.37) / 1e9 AS lower, floor(upper * 1e9 + 0.37) / 1e9 AS upper, active FROM k"))(
    on(S, lambda g: katz.katz(g, 20, 10).state.select("id", settled("lower", 1e9).alias("lower"), settled("upper", 1e9).alias("upper"), "active"))
)
query("katz_topk", oracles.katz(S_SQL, ENDS, 20, 10, "SELECT id, floor(kc * 1e9 + 0.37) / 1e9 AS kc FROM k WHERE active ORDER BY lower DESC, id LIMIT 10"))(
    on(S, lambda g: katz.katz(g, 20, 10).top(10).select("id", settled("kc", 1e9).alias("kc")))
)
query("katz_directed", oracles.katz(T_SQL, ENDS, 6, 0, "SELECT id, floor(kc * 1e9 + 0.37) / 1e9 AS kc FROM k"))(on(T, lambda g: katz.katz(g, 6, 0).scores().select("id", settled("kc", 1e9).alias("kc"))))
query("katz_npaths", oracles.walk_counts(S_SQL, ENDS, 6))(on(S, lambda g: katz.walk_counts(g, 6).select("it", "id", F.col("n").cast("long").alias("n"))))

query("katz_iterations", oracles.katz(S_SQL, ENDS, 20, 10, "SELECT CAST(max(it) AS INTEGER) AS iterations FROM k"))(
    on(S, lambda g: g.edges.sparkSession.createDataFrame([(katz.katz(g, 20, 10).iteration,)], "iterations int"))
)

# --- betweenness ---------------------------------------------------------------------------------------------------

_BC = lambda bc: bc.select("id", settled("bc", 1e6).alias("bc"))
query("bc_exact", oracles.betweenness("SELECT id FROM u"))(on(S, lambda g: _BC(betweenness.betweenness(g))))
query("bc_roots", oracles.betweenness("SELECT id FROM u WHERE id % 10 = 1"))(on(S, lambda g: _BC(betweenness.betweenness(g, g.vertices.where("id % 10 = 1").select(F.col("id").alias("root"))))))
query("bc_sampled", oracles.betweenness(oracles.sampled_roots(40)))(on(S, lambda g: _BC(betweenness.betweenness(g, betweenness.sample_roots(g, 40)))))
query("bc_joins", oracles.betweenness("SELECT id FROM u WHERE id % 97 = 1"))(
    on(S, lambda g: _BC(betweenness.betweenness(g, g.vertices.where("id % 97 = 1").select(F.col("id").alias("root")), local_edges=0)))
)
query("bc_levels", oracles.betweenness_levels("SELECT id FROM u WHERE id % 97 = 1"))(
    on(S, lambda g: betweenness.levels(g, g.vertices.where("id % 97 = 1").select(F.col("id").alias("root"))))
)

# --- updates -------------------------------------------------------------------------------------------------------


def _split(g: Graph) -> tuple[Graph, list[DataFrame]]:
    return generators.sampled_batches(g)


query("insert_batch", _with(S_SQL) + f"SELECT src, dst FROM e WHERE {BUCKET} <= 8")(on(S, lambda g: updates.insert(_split(g)[0], _split(g)[1][0]).edges))
query("delete_batch", _with(S_SQL) + f"SELECT src, dst FROM e WHERE {BUCKET} <> 0")(on(S, lambda g: updates.delete(g, g.edges.where(generators.bucket() == 0)).edges))
query("batch_sorted_new", _with(S_SQL) + f"SELECT src, dst FROM e WHERE {BUCKET} = 8")(on(S, lambda g: updates.sorted_batch(updates.new_edges(_split(g)[1][0], _split(g)[0].edges))))


@query(
    "batch_duplicates",
    _with(S_SQL) + f"""SELECT src, dst, count(*) AS rows, count(*) FILTER (WHERE d) AS duplicates FROM (
      SELECT src, dst, false AS d FROM e WHERE {BUCKET} = 8 UNION ALL SELECT src, dst, true FROM e WHERE {BUCKET} IN (8, 0)) GROUP BY src, dst""",
)
def batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batches = _split(S(spark, sf_dir))
    rows = batches[0].withColumn("row", F.monotonically_increasing_id())
    marks = updates.flagged(rows, base.edges)
    return marks.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("rows"), F.count_if("duplicate").alias("duplicates"))


query("graph_differences", _with(S_SQL) + f"SELECT src, dst, 'right' AS side FROM e WHERE {BUCKET} = 9")(on(S, lambda g: updates.differences(updates.delete(g, g.edges.where(generators.bucket() == 9)), g)))
query("triangles_delta_insert", oracles.triangles_delta(f"{BUCKET} < 8", f"{BUCKET} <= 8"))(on(S, lambda g: TriangleState(_split(g)[0]).insert(_split(g)[1][0])))
query("triangles_delta_delete", oracles.triangles_delta("true", f"{BUCKET} <> 0"))(on(S, lambda g: TriangleState(g).delete(g.edges.where(generators.bucket() == 0))))

_ROUNDS = 5


def _katz_after(g: Graph, inserts: bool) -> DataFrame:
    """Scores kept up to date through a batch; alpha is that of the whole graph on both sides."""
    state = _katz_state(_split(g)[0] if inserts else g, g)
    if inserts:
        state.insert(_split(g)[1][0])
    else:
        state.delete(g.edges.where(generators.bucket() == 0))
    return state.scores().select("id", settled("kc", 1e9).alias("kc"))


_ALPHA = "1.0::DOUBLE / (max(degree) + 1)"
query("katz_delta_insert", oracles.katz_fixed(S_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <= 8"))(on(S, lambda g: _katz_after(g, True)))
query("katz_delta_delete", oracles.katz_fixed(S_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <> 0"))(on(S, lambda g: _katz_after(g, False)))
query("katz_delta_insert_directed", oracles.katz_fixed(T_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <= 8"))(on(T, lambda g: _katz_after(g, True)))
query("katz_delta_delete_directed", oracles.katz_fixed(T_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <> 0"))(on(T, lambda g: _katz_after(g, False)))

# --- streams -------------------------------------------------------------------------------------------------------


def _streamed(g: Graph, state_of: Callable[[Graph], object], result: Callable[[object], DataFrame]) -> DataFrame:
    """Feeds both insert batches of the split, then a deletion of bucket 0, as files of a stream."""
    base, batches = _split(g)
    spark = g.edges.sparkSession
    state = state_of(base)
    with Staging(spark, "stream") as st:
        gone = g.edges.where(generators.bucket() == 0)
        for i, (op, rows) in enumerate([*(("insert", b) for b in batches), ("delete", gone)]):
            rows.select(F.lit(i).alias("batch_id"), F.lit(op).alias("op"), "src", "dst").write.mode("append").parquet(st.path("in"))
        run_stream(spark, state, st.path("in"), st.path("progress"), files_per_batch=1000, state_path=st.path("state"))
        return result(state)


query("triangles_stream", oracles.triangles_per_vertex(f"{S_SQL.replace('e AS MATERIALIZED', 'e0 AS MATERIALIZED')}, e AS MATERIALIZED (SELECT * FROM e0 WHERE {BUCKET} <> 0)", (2, 2, 2)).replace(ENDS, "u AS MATERIALIZED (SELECT src AS id FROM e0 UNION SELECT dst FROM e0)"))(
    on(S, lambda g: _streamed(g, TriangleState, lambda s: s.counts))
)


def _katz_state(g: Graph, whole: Graph) -> KatzState:
    """A state of fixed rounds whose alpha is that of the whole graph."""
    return KatzState(g, _ROUNDS + 1, 0, katz.max_degree(whole))


query("katz_stream", oracles.katz_fixed(S_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <> 0"))(
    on(S, lambda g: _streamed(g, lambda base: _katz_state(base, g), lambda s: s.scores().select("id", settled("kc", 1e9).alias("kc"))))
)

query("katz_stream_directed", oracles.katz_fixed(T_SQL, ENDS, _ALPHA, _ROUNDS, f"{BUCKET} <> 0"))(
    on(T, lambda g: _streamed(g, lambda base: _katz_state(base, g), lambda s: s.scores().select("id", settled("kc", 1e9).alias("kc"))))
)

# --- generators ----------------------------------------------------------------------------------------------------

_PARTS_N, _LINES_N, _SCALE = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM lineitem)", "(SELECT CAST(floor(log2(count(*))) AS BIGINT) FROM part)"


def _drawn(make: Callable[[SparkSession, int, int], DataFrame]) -> Query:
    """As many edges as there are lines, over as many vertices as there are parts."""
    count = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return lambda spark, sf_dir: make(spark, count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem"))


query("gen_uniform", oracles.uniform(_PARTS_N, _LINES_N, "SELECT row, src, dst FROM g"))(_drawn(generators.uniform))
query("gen_mirrored", oracles.uniform(_PARTS_N, _LINES_N, "SELECT row * 2 AS row, src, dst FROM g UNION ALL SELECT row * 2 + 1, dst, src FROM g"))(_drawn(generators.mirrored_uniform))
query("gen_inverted", oracles.uniform(_PARTS_N, _LINES_N, "SELECT row, dst AS src, src AS dst FROM g"))(_drawn(generators.inverted_uniform))
query("gen_rmat", oracles.rmat(_LINES_N, _SCALE))(_drawn(lambda spark, parts, lines: generators.rmat(spark, parts.bit_length() - 1, lines)))
_BATCHES = (50, 3, 20, 30)
query("batch_sampler", oracles.removed_batches(*_BATCHES))(on(S, lambda g: generators.removed_batches(g, *_BATCHES)[1]))

# --- readers: the sparse graph goes through a text file of each format ------------------------------------------------


def _through(write: Callable[[Graph, str], None], read: Callable[[SparkSession, str], Graph], name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Staging(spark, "reader") as st:
            write(S(spark, sf_dir), st.path(name))
            return checkpoint(read(spark, st.path(name)).edges.select("src", "dst"))

    return run


def _text(lines: DataFrame, path: str) -> None:
    """lines(at, value) as one file in the order of at: these formats are single files."""
    lines.orderBy("at").select("value").coalesce(1).write.text(path)


def _heads(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(i - len(values), v) for i, v in enumerate(values)], "at long, value string")


def _dimacs(g: Graph, path: str) -> None:
    top, lists = g.vertices.agg(F.max("id")).first()[0], g.adjacency()
    spark = g.edges.sparkSession
    shifted = lists.select("id", F.array_join(F.transform("neighbours", lambda x: x + 1), " ").alias("value"))
    body = spark.range(top + 1).join(shifted, "id", "left").select(F.col("id").alias("at"), F.coalesce("value", F.lit("")).alias("value"))
    _text(_heads(spark, "% made for a test", f"{top + 1} {g.edges.count() // 2}").unionByName(body), path)


def _pairs(g: Graph, path: str) -> None:
    body = g.edges.select(F.col("src").alias("at"), F.concat_ws("\t", "src", "dst").alias("value"))
    _text(_heads(g.edges.sparkSession, "# made for a test").unionByName(body), path)


def _matrix(g: Graph, path: str) -> None:
    top, half = g.vertices.agg(F.max("id")).first()[0] + 1, g.edges.where("src > dst")
    body = half.select(F.col("src").alias("at"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    _text(_heads(g.edges.sparkSession, "%%MatrixMarket matrix coordinate pattern symmetric", "% made for a test", f"{top} {top} {half.count()}").unionByName(body), path)


def _csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S(spark, sf_dir)
    top = g.vertices.agg(F.max("id")).first()[0]
    every = g.with_universe(spark.range(top + 2))  # the last has no edges: its offset ends the row before
    offsets = work.prefix_work(every).select("id", F.col("prefix").alias("offset"))
    adjacency = work.numbered(g.edges, F.col("src"), F.col("dst")).select("at", "dst")
    return Graph.from_csr_tables(offsets, adjacency).edges


_EDGES = _with(S_SQL) + "SELECT src, dst FROM e"
query("read_dimacs", _EDGES)(_through(_dimacs, readers.read_graph, "s.graph"))
query("read_snap", _EDGES)(_through(_pairs, readers.read_graph, "s.txt"))
query("read_matrix_market", _EDGES)(_through(_matrix, readers.read_graph, "s.mtx"))
query("read_snap_relabelled", _with(S_SQL, ENDS, "x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM u)") + "SELECT a.at AS src, b.at AS dst FROM e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst")(
    _through(_pairs, lambda spark, path: readers.read_snap(spark, path, relabel=True), "s.txt")
)
query("read_csr", _EDGES)(_csr)
