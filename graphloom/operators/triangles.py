"""Triangle counting on simple symmetric graphs.

Edges are oriented from the lower to the higher (degree, id); every triangle then has one source whose two out-edges
meet one edge, and no vertex has more than about sqrt(2 edges) out-edges, so hubs do not blow the join up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.session import Staging, checkpoint, release

BROADCAST_EDGES = 4_000_000  # pairs packed into one long each: about 100 MB
TURN_EDGES = 2_000_000  # of larger graphs, the pairs that are broadcast at a time
BROADCAST_DEGREES = 4_000_000  # vertices whose degrees are broadcast


def _pairs(graph: Graph) -> DataFrame:
    """(src, dst), src < dst: each edge once."""
    if graph.pairs is not None:
        return graph.pairs
    return graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


class _Wedges:
    """Oriented edges, staged and kept by their source; wedges and the edges that close them, a turn at a time.

    A wedge's ends x and y are in the order of (degree, id), so x -> y would be its closing edge. A turn has the x of
    some hash values: it makes their wedges and broadcasts their out-edges. So no wedge is ever shuffled, and every
    wedge is made in one turn. Ids beyond 31 bits are broadcast as two columns.
    """

    def __init__(self, graph: Graph, st: Staging, turn: int | None = None):
        spark = graph.edges.sparkSession
        pairs = st.write(_pairs(graph), "pairs") if graph.pairs is None else graph.pairs
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
        degree = st.write(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "degree")
        if degree.count() <= BROADCAST_DEGREES:
            degree = F.broadcast(degree)
        large = pairs.count() > TURN_EDGES
        if large:
            release(spark)
        pairs = pairs.join(degree.select(F.col("id").alias("src"), F.col("n").alias("ns")), "src")
        pairs = pairs.join(degree.select(F.col("id").alias("dst"), F.col("n").alias("nd")), "dst")
        up = F.col("ns") <= F.col("nd")  # at equal degree the smaller id, src, comes first
        pick = lambda yes, no, name: F.when(up, F.col(yes)).otherwise(F.col(no)).alias(name)
        oriented = st.write(pairs.select(pick("src", "dst", "u"), pick("dst", "src", "v"), pick("nd", "ns", "n")), "oriented")
        if large:
            release(spark)
        n, least, top = oriented.agg(F.count(F.lit(1)), F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))).first()
        self.packed = n > 0 and least >= 0 and top < 2**31  # one long a pair keeps the hash table compact
        if turn is None:
            turn = BROADCAST_EDGES if self.packed and n <= BROADCAST_EDGES else TURN_EDGES if self.packed else TURN_EDGES // 4
        self.turns, self.large = max(1, -(-n // turn)), large
        self.oriented, self.dealt = oriented, oriented
        if self.turns > 1:
            self.dealt = oriented.repartition("u").sortWithinPartitions("u").persist()

    def closed(self, turn: int) -> DataFrame:
        """(a, b, c), a < b < c: the triangles of a turn."""
        here = lambda x: F.pmod(F.xxhash64(x), F.lit(self.turns)) == turn
        x = self.dealt.where(here("v")).select("u", F.col("v").alias("x"), F.col("n").alias("nx"))
        y = self.dealt.select("u", F.col("v").alias("y"), F.col("n").alias("ny"))
        wedges = x.join(y, "u").where("nx < ny or (nx = ny and x < y)")
        closing = self.oriented.where(here("u")).select(F.col("u").alias("x"), F.col("v").alias("y"))
        if self.packed:
            pair = F.shiftleft("x", 31).bitwiseOR(F.col("y")).alias("pair")
            found = wedges.select("u", "x", "y", pair).join(F.broadcast(closing.select(pair)), "pair")
        else:
            found = wedges.join(F.broadcast(closing), ["x", "y"])
        ends = [F.col(c) for c in ("u", "x", "y")]
        middle = F.greatest(F.least("u", "x"), F.least(F.greatest("u", "x"), F.col("y")))
        return found.select(F.least(*ends).alias("a"), middle.alias("b"), F.greatest(*ends).alias("c"))

    def close(self) -> None:
        if self.turns > 1:
            self.dealt.unpersist()


def _summed(graph: Graph, part, whole, turn: int | None = None) -> DataFrame:
    """whole(union of part(triangles of a turn)), checkpointed: what the turns staged is gone."""
    with Staging(graph.edges.sparkSession, "triangles") as st:
        wedges = _Wedges(graph, st, turn)
        parts = []
        for t in range(wedges.turns):
            found = part(wedges.closed(t))
            if wedges.turns > 1:
                found = st.write(found, f"turn{t}")
                if wedges.large:
                    release(found.sparkSession)  # the turn's broadcast, too
            parts.append(found)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        out = checkpoint(whole(every))
        wedges.close()
    return out


def triangles(graph: Graph, turn: int | None = None) -> DataFrame:
    """(a, b, c), a < b < c: each triangle once. Loops, repeats and directions do not matter.

    turn: edges that are broadcast at a time (by the number of edges, if None).
    """
    return _summed(graph, lambda found: found, lambda found: found, turn)


def per_vertex(graph: Graph, convention: str = "six", turn: int | None = None) -> DataFrame:
    """(id, triangles) of the universe. six: twice a vertex's triangles (sum 6T); three: 2 for the least vertex of a
    triangle and 1 for the middle one (sum 3T); once: each vertex's triangles."""
    weight = {"six": (2, 2, 2), "three": (2, 1, 0), "once": (1, 1, 1)}[convention]
    ends = F.array(*[F.struct(F.col(c).alias("id"), F.lit(w).cast("long").alias("w")) for c, w in zip("abc", weight)])
    part = lambda found: found.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.w").alias("n"))
    counts = _summed(graph, part, lambda every: every.groupBy("id").agg(F.sum("n").alias("n")), turn)
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def total(graph: Graph, turn: int | None = None) -> DataFrame:
    """(triangles, three, six): each once, and the totals of the two conventions."""
    t = _summed(graph, lambda found: found.agg(F.count(F.lit(1)).alias("n")), lambda every: every.agg(F.sum("n").alias("triangles")), turn)
    return t.select("triangles", (F.col("triangles") * 3).alias("three"), (F.col("triangles") * 6).alias("six"))


def common_neighbours(graph: Graph) -> DataFrame:
    """(src, dst, common) of every stored edge of a simple symmetric graph."""
    pair = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    both = F.array(*[pair(x, y) for x, y in ("ab", "ba", "ac", "ca", "bc", "cb")])
    part = lambda found: found.select(F.explode(both).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("n"))
    counts = _summed(graph, part, lambda every: every.groupBy("src", "dst").agg(F.sum("n").alias("n")))
    return graph.edges.join(counts, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("common"))


def delta(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, triangles): what inserting adds at each vertex, in the convention six; only vertices it changes.

    before, fresh: simple symmetric edges without an edge in common. Triangles with a new edge are found from the new
    edges and counted once, whether one, two or all three of their edges are new.
    """
    after = before.select("src", "dst").unionByName(fresh.select("src", "dst"))
    new = fresh.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ids = new.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    degree = after.join(ids, F.col("src") == F.col("id"), "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    new = new.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    # a new edge is widened at its end of lower degree, so one at a hub costs the degree of its other end
    low = F.col("na") <= F.col("nb")
    new = new.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = new.join(after.select(F.col("src").alias("x"), F.col("dst").alias("z")), "x").where("z <> y")
    closed = wedge.join(after.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"], "left_semi")
    once = closed.select(F.array_sort(F.array("x", "y", "z")).alias("t")).distinct()
    return once.select(F.explode("t").alias("id")).groupBy("id").agg((F.count(F.lit(1)) * 2).alias("triangles"))
