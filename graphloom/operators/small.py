"""Kernels for graphs that were counted to be small: their edges fit one task, or a broadcast, many times over.

A loop of distributed joins costs a job or two a round whatever the size of the graph. A graph of at most LOCAL_EDGES
edges (two 64-bit numbers each: 32 MB at most) is therefore sent whole to the tasks that work on it: one task for a
search or components, one per group of roots for betweenness. Callers count edges first, and take the distributed
way beyond the bound. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_EDGES = 2_000_000
BUNDLE = 50_000  # edges of a bundle of components
SHARE = 10_000_000  # roots times edges of a unit of work
CELLS = 1 << 20  # vertices times roots that are searched side by side
LANES = 32  # of them, at most: more leave the cache
GROUP = 4096  # vertices of small components that are searched side by side
UNREACHED = 254  # depths in a byte; one more is still another number


def is_small(edges: DataFrame, bound: int = LOCAL_EDGES) -> bool:
    """Whether edges has at most `bound` rows; no more than bound + 1 are counted."""
    return bound > 0 and edges.limit(bound + 1).count() <= bound


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    read = list(batches)
    return tuple(np.concatenate([b.column(i).to_numpy() for b in read] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _sums(value: np.ndarray, first: np.ndarray, of: np.ndarray, n: int, add=np.add) -> np.ndarray:
    """value of the edges (sorted, groups from `first` on) added up by the vertices `of` of their groups."""
    out = np.zeros((n, *value.shape[1:]), value.dtype)
    if len(first):
        out[of] = add.reduceat(value, first, axis=0)
    return out


def _groups(sorted_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, sorted_ends[1:] != sorted_ends[:-1]]) if len(sorted_ends) else np.zeros(0, np.int64)
    return first, sorted_ends[first]


def levels(src: np.ndarray, dst: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, levels) of what the root reaches over the edges."""
    ids, code = np.unique(np.r_[src, dst, root], return_inverse=True)
    m = len(src)
    order = np.argsort(code[:m], kind="stable")
    to = code[m : 2 * m][order]
    ends = np.searchsorted(code[:m][order], np.arange(len(ids) + 1))
    level = np.full(len(ids), -1, np.int32)
    front, depth = code[-1:], 0
    level[front] = 0
    while len(front):
        size = ends[front + 1] - ends[front]
        at = _spread(ends[front], size)
        front = np.unique(to[at])
        front = front[level[front] < 0]
        depth += 1
        level[front] = depth
    seen = level >= 0
    return ids[seen], level[seen]


def labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, greatest id of their component) of the endpoints of edges, in either direction."""
    ids, code = np.unique(np.r_[src, dst], return_inverse=True)
    a, b = np.r_[code[: len(src)], code[len(src) :]], np.r_[code[len(src) :], code[: len(src)]]
    order = np.argsort(b, kind="stable")
    a = a[order]
    first, of = _groups(b[order])
    label = np.arange(len(ids))
    while len(ids):
        up = np.maximum(label, _sums(label[a], first, of, len(ids), np.maximum))
        np.maximum.at(up, label, up)  # roots learn what their trees have learnt
        while not (up[up] == up).all():
            up = up[up]
        if (up == label).all():
            break
        label = up
    return ids, ids[label]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)


class Paths:
    """Shortest paths over edges between the vertices `ids` (sorted; src and dst are places in it), for roots in groups.

    A group's roots are searched side by side, each in its own copy of the vertices, so that a level is a few array
    operations for all of them. A root's work is its edges, and one pass over the vertices.
    """

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray):
        self.n = len(ids)
        order = np.argsort(src, kind="stable")
        self.to, self.ends = dst[order], np.searchsorted(src[order], np.arange(self.n + 1))
        self.group = max(1, min(64, CELLS // max(1, self.n)))

    def search(self, roots: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """(per level (found, place in found of each edge's head, place in the level before of its tail), numbers of
        paths). Vertex v of the i-th root is i * n + v; edges are those of shortest paths."""
        size = self.n * len(roots)
        fresh, paths, place = np.ones(size, bool), np.zeros(size), np.zeros(size, np.int64)
        front = np.arange(len(roots)) * self.n + roots
        fresh[front], paths[front] = False, 1
        levels = [(front, None, None)]
        while True:
            v = front % max(1, self.n)
            degree = self.ends[v + 1] - self.ends[v]
            reached = self.to[_spread(self.ends[v], degree)] + np.repeat(front - v, degree)
            by = np.repeat(np.arange(len(front)), degree)
            new = fresh[reached]
            reached, by = reached[new], by[new]
            if not len(reached):
                return levels, paths
            every = np.arange(len(reached))
            place[reached] = every
            found = reached[place[reached] == every]
            place[found] = np.arange(len(found))
            at = place[reached]
            paths[found] = np.bincount(at, paths[front][by], len(found))
            fresh[found] = False
            levels.append((found, at, by))
            front = found


def fold(n: int, src: np.ndarray, dst: np.ndarray, times: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pendant trees, folded leaf by leaf into the vertices that they hang on: (mask of the vertices left with edges, roots
    and vertices folded into each vertex, itself included, and what its trees alone decide of its dependencies).

    Paths within trees are unique, so the pairs of a root and another vertex that are parted by x are counted: x's
    branches are its subtrees and the rest of its component. comp: component of each vertex; edges in both directions.
    """
    held, size, value = times.astype(float), np.ones(n), np.zeros(n)
    every, roots = np.bincount(comp)[comp].astype(float), np.bincount(comp, held)[comp]
    degree, key = np.bincount(src, minlength=n), np.zeros(n, np.int64)
    np.bitwise_xor.at(key, src, dst)  # of a leaf: its only neighbour
    leaf = np.flatnonzero(degree == 1)
    while len(leaf):
        up = key[leaf]
        first = (degree[up] > 1) | (leaf > up)  # of two leaves on one edge, one stays
        leaf, up = leaf[first], up[first]
        degree[leaf] = 0
        np.subtract.at(degree, up, 1)
        np.bitwise_xor.at(key, up, leaf)
        np.add.at(value, up, held[leaf] * (every[leaf] - 1 - size[leaf]))
        np.add.at(held, up, held[leaf])
        np.add.at(size, up, size[leaf])
        leaf = np.unique(up[degree[up] == 1])
    return degree > 0, held, size, value + (roots - held) * (size - 1)


class Lanes:
    """Shortest paths over edges between n vertices of components `comp`, from up to 64 lanes of roots at once.

    A lane has a root of each component at most, as components don't meet. Depths of all lanes are found as bits of a word
    for each vertex; then the edges of shortest paths are sorted by depth, and a depth is a few operations on slices. A
    vertex of a lane is a cell, lane * n + vertex. Vertices are numbered by falling number of in-edges.
    """

    COLUMNS = 16  # in-edges of a vertex that are taken one by one, for all vertices at once

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, comp: np.ndarray):
        order = np.argsort(dst, kind="stable")
        self.n, self.comp, self.tails, self.heads = n, comp, src[order], dst[order]
        many = np.bincount(dst, minlength=n)
        at = np.arange(len(dst)) - np.repeat(np.cumsum(many) - many, many)
        self.columns = [self.tails[at == c] for c in range(min(self.COLUMNS, int(many.max(initial=0))))]
        rest = at >= self.COLUMNS
        self.rest, (self.first, self.of) = self.tails[rest], _groups(self.heads[rest])
        self.cells = np.zeros(0, np.int64)  # of the edges' ends in each lane: head << 32 | tail

    def _around(self, front: np.ndarray) -> np.ndarray:
        """Bits of the tails of each vertex's in-edges."""
        out = _sums(front[self.rest], self.first, self.of, self.n, np.bitwise_or)
        for tails in self.columns:
            out[: len(tails)] |= front[tails]
        return out

    def depths(self, lane: np.ndarray, roots: np.ndarray) -> np.ndarray | None:
        """uint8[vertex, lane], UNREACHED where there is no path; None if paths are too long for that."""
        front, planes = np.zeros(self.n, np.uint64), []
        np.bitwise_or.at(front, roots, np.uint64(1) << lane.astype(np.uint64))
        unseen, depth = ~front, 0
        while True:
            depth += 1
            front = self._around(front) & unseen
            if not front.any():
                break
            if depth == UNREACHED:
                return None
            unseen &= ~front
            while depth >> len(planes):
                planes.append(np.zeros(self.n, np.uint64))
            for b in range(len(planes)):
                if depth >> b & 1:
                    planes[b] |= front
        bits = lambda x: np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little").reshape(self.n, 64)
        out = bits(unseen) * np.uint8(UNREACHED)
        for b, plane in enumerate(planes):
            out |= bits(plane) << np.uint8(b)
        return out

    def search(self, depths: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, tuple]:
        """Of depths[vertex, lane]: (cells that are reached, by depth; where each depth begins; numbers of paths; of each
        cell but roots, the place of the cell before it on one path; and for further edges of shortest paths, the places of
        head and tail, and where those of each depth begin)."""
        width = depths.shape[1]
        if len(self.cells) != width * len(self.tails):
            self.cells = ((self.heads << 32 | self.tails) + (np.arange(width) * (self.n << 32 | self.n))[:, None]).ravel()
        on = np.flatnonzero(np.ascontiguousarray((depths[self.tails] + np.uint8(1) == depths[self.heads]).T))
        depths = np.ascontiguousarray(depths.T).ravel()
        edges = self.cells[on]
        depth = depths[edges >> 32]
        edges = edges[np.argsort(depth, kind="stable")]
        heads, tails = edges >> 32, edges & 0xFFFFFFFF
        new = np.ones(len(heads), bool)
        new[1:] = heads[1:] != heads[:-1]
        first, more = np.flatnonzero(new), np.flatnonzero(~new)
        start = np.flatnonzero(depths == 0)
        k, cells = len(start), np.r_[start, heads[first]]
        place = np.empty(len(depths), np.int64)
        place[cells] = np.arange(len(cells))
        before, head, tail = place[tails[first]], place[heads[more]], place[tails[more]]
        edge = np.cumsum(np.bincount(depth, minlength=1))  # where those of depth 1, 2, ... begin
        most = len(edge) - 1
        begin, extra = [0, *(k + np.searchsorted(first, edge)).tolist()], np.searchsorted(more, edge).tolist()
        paths = np.ones(len(cells))
        for d in range(most):
            p, q = begin[d + 1 : d + 3]
            paths[p:q] = paths[before[p - k : q - k]]
            a, b = extra[d : d + 2]
            if a < b:
                paths[p:q] += np.bincount(head[a:b] - p, paths[tail[a:b]], q - p)
        return cells, begin, paths, before, (head, tail, extra)

    def backward(self, found: tuple, here: np.ndarray) -> np.ndarray:
        """Dependencies of each cell that search() found; here: how many vertices each of them stands for."""
        cells, begin, paths, before, (head, tail, extra) = found
        k, share = begin[1], here / paths  # of a cell: (vertices behind it and itself) / paths to it
        delta = np.zeros(len(cells))
        for d in range(len(extra) - 2, -1, -1):
            o, p, q = begin[d : d + 3]
            got = np.bincount(before[p - k : q - k] - o, share[p:q], p - o)
            a, b = extra[d : d + 2]
            if a < b:
                got += np.bincount(tail[a:b] - o, share[head[a:b]], p - o)
            share[o:p] += got
            delta[o:p] = got
        delta[:k] = 0
        return delta * paths


def _blocks(comp: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Roots (places) in blocks of lanes: (places in roots, their lanes, mask of the components that have any). Few lanes
    first, so that components with few roots leave before there are many."""
    order = np.argsort(comp[roots], kind="stable")
    sizes = np.bincount(comp[roots], minlength=int(comp.max(initial=-1)) + 1)
    rank = np.empty(len(roots), np.int64)
    rank[order] = _spread(np.zeros(len(sizes), np.int64), sizes)
    a, width = 0, 4
    while a < sizes.max(initial=0):
        at = np.flatnonzero((rank >= a) & (rank < a + width))
        yield at, rank[at] - a, sizes > a
        a, width = a + width, min(64, 4 * width)


def _searches(n: int, src: np.ndarray, dst: np.ndarray, comp: np.ndarray, roots: np.ndarray) -> Iterator[tuple]:
    """(vertices (places), Lanes or Paths over them, places in roots, their lanes or None, search) for all roots.

    Lanes, but Paths where paths are longer than depths in a byte. Components are taken in groups of about GROUP vertices,
    whose cells stay in the cache.
    """
    np.empty(31 << 20, np.uint8)  # glibc keeps what is freed for arrays up to the largest freed so far, instead of giving it back
    many, sizes = np.bincount(dst, minlength=n), np.bincount(comp)
    group = ((np.cumsum(sizes) - sizes) // GROUP)[comp[roots]]
    order = np.argsort(group, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else ():
        last, deep = None, False
        for at, lane, comps in _blocks(comp, roots[mine]):
            at = mine[at]
            if last is None or not np.array_equal(comps, last):
                last, some = comps, np.flatnonzero(comps[comp])
                some = some[np.argsort(-many[some], kind="stable")]
                place = np.full(n, -1)
                place[some] = np.arange(len(some))
                inside = place[src] >= 0
                a, b = place[src[inside]], place[dst[inside]]
                graph = Paths(some, a, b) if deep else Lanes(a, b, len(some), comp[some])
            depths = None if deep else graph.depths(lane, place[roots[at]])
            if depths is None:
                graph, deep = graph if deep else Paths(some, a, b), True
                for g in range(0, len(at), graph.group):
                    yield some, graph, at[g : g + graph.group], None, graph.search(place[roots[at[g : g + graph.group]]])
                continue
            width, top = max(1, min(LANES, CELLS // max(1, len(some)), 4 * CELLS // max(1, len(a)))), int(lane.max()) + 1
            for g in range(0, top, width):
                now = (lane >= g) & (lane < g + width)
                yield some, graph, at[now], lane[now] - g, graph.search(depths[:, g : min(g + width, top)])


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number from 0 on for each of the n vertices, equal within components."""
    label = np.arange(n)
    ends, found = labels(src, dst)
    label[ends] = found
    return np.unique(label, return_inverse=True)[1]


def dependencies(
    ids: np.ndarray, src: np.ndarray, dst: np.ndarray, roots: np.ndarray, times: np.ndarray, part: int = 0, parts: int = 1,
) -> np.ndarray:
    """Brandes' dependencies of the vertices `ids` (sorted; src, dst and roots are places in it), summed over roots; of
    the `parts` parts into which the work is cut, one: they add up to the whole. Symmetric edges let trees be folded."""
    n, real = len(ids), src != dst
    src, dst = src[real], dst[real]
    comp, held, size, total = _components(n, src, dst), np.bincount(roots, times, n), np.ones(n), np.zeros(n)
    if np.array_equal(np.sort(src * n + dst), np.sort(dst * n + src)):
        kept, held, size, value = fold(n, src, dst, held, comp)
        if part == 0:
            total += value
        inside = kept[src] & kept[dst]
        core = np.flatnonzero(kept)
        place = np.cumsum(kept) - 1
        src, dst = place[src[inside]], place[dst[inside]]
        comp = np.unique(comp[core], return_inverse=True)[1]
    else:
        core = np.arange(n)
    held, size = held[core], size[core]
    roots = np.flatnonzero(held)[part::parts]
    for some, graph, at, lane, found in _searches(len(core), src, dst, comp, roots):
        weight = held[roots[at]]
        if lane is None:
            value = weight @ _backward(*found, size[some]).reshape(len(at), graph.n)
        else:
            of = np.zeros((int(lane.max()) + 1, int(comp.max()) + 1))
            of[lane, comp[roots[at]]] = weight
            delta = np.zeros(of.shape[0] * graph.n)
            delta[found[0]] = graph.backward(found, np.tile(size[some], of.shape[0])[found[0]])
            value = np.einsum("ij,ij->j", of[:, graph.comp], delta.reshape(-1, graph.n))
        total[core[some]] += value
    return total


def _backward(found: list[tuple], paths: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Dependencies from what Paths.search() found."""
    delta = np.zeros(len(paths))
    for (front, _, _), (below, at, by) in zip(found[-2::-1], found[:0:-1]):
        share = (size[below % len(size)] + delta[below]) / paths[below]
        delta[front] = paths[front] * np.bincount(by, share[at], len(front))
    delta[found[0][0]] = 0
    return delta


def _dependent(src: np.ndarray, dst: np.ndarray, roots: np.ndarray, times: np.ndarray, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """(id, value) of the edges' endpoints, summed over those roots that are among them."""
    ids, code = np.unique(np.r_[src, dst], return_inverse=True)
    here = np.isin(roots, ids)
    at = np.searchsorted(ids, roots[here])
    value = dependencies(ids, code[: len(src)], code[len(src) :], at, times[here].astype(float), part, parts)
    at = np.flatnonzero(value)
    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(value[at])], names=["id", "value"])


def _levels(src: np.ndarray, dst: np.ndarray, roots: np.ndarray, times: np.ndarray, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """(root, id, level, sigma) of what each root reaches."""
    roots = roots[part::parts]
    ids, code = np.unique(np.r_[src, dst, roots], return_inverse=True)
    m, names = len(src), ["root", "id", "level", "sigma"]
    src, dst, starts = code[:m], code[m : 2 * m], code[2 * m :]
    comp = _components(len(ids), src, dst)
    for some, graph, at, lane, found in _searches(len(ids), src, dst, comp, starts):
        if lane is None:
            cells, paths = np.concatenate([f[0] for f in found[0]]), found[1]
            depth = np.repeat(np.arange(len(found[0]), dtype=np.int32), [len(f[0]) for f in found[0]])
            which, v = np.divmod(cells, graph.n)
            root, sigma = at[which], paths[cells]
        else:
            cells, begin, sigma = found[:3]
            depth = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))
            x, v = np.divmod(cells, graph.n)
            of = np.zeros((int(lane.max()) + 1, int(comp.max()) + 1), np.int64)
            of[lane, comp[starts[at]]] = at
            root = of[x, graph.comp[v]]
        root, v = roots[root], ids[some[v]]
        for c in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(y[c : c + 100_000]) for y in (root, v, depth, sigma)], names=names)


DEPENDENT, LEVELS = (_dependent, "id long, value double"), (_levels, "root long, id long, level int, sigma double")


def search(edges: DataFrame, root: int) -> DataFrame:
    """(id, level) by one task over all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, level = levels(*_columns(batches), root)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(level)], names=["id", "level"])

    return edges.select("src", "dst").repartition(1).mapInArrow(run, "id long, level int")


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label) of the endpoints by one task over all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label = labels(*_columns(batches))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(label)], names=["id", "label"])

    return edges.select("src", "dst").repartition(1).mapInArrow(run, "id long, label long")


def over_roots(work: tuple, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """work (DEPENDENT or LEVELS) for the roots(root, times) of a task; the edges are broadcast whole."""
    spark = edges.sparkSession
    table = edges.select("src", "dst").toArrow()
    shipped = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("src", "dst")))
    tasks, (kernel, schema) = max(1, spark.sparkContext.defaultParallelism), work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, times = _columns(batches)
        if len(some):
            yield from kernel(*shipped.value, some, times)

    return roots.select("root", "times").repartition(4 * tasks).mapInArrow(run, schema)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def over_components(work: tuple, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for edges(src, dst, label) and roots(root, times, label) of any number of components of at most
    LOCAL_EDGES edges each. Components are packed into bundles of about BUNDLE edges; a unit of work is a part of what a
    bundle has to do, of about SHARE roots times edges or a small share of the whole, if that is more."""
    spark = edges.sparkSession
    now = str(spark.conf.get(ARROW_BYTES)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= 8 << 20:
        spark.conf.set(ARROW_BYTES, str(8 << 20))  # a bundle is a row, and may have several MB
    tasks, (kernel, schema) = max(1, spark.sparkContext.defaultParallelism), work
    edges_n = edges.count()
    bundles = max(1, -(-edges_n // BUNDLE))
    bundle = F.pmod(F.xxhash64("label"), F.lit(bundles)).alias("bundle")
    share = max(SHARE, edges_n * roots.count() // (bundles * 8 * tasks))  # if each bundle had as many roots as the others
    packed = edges.select(bundle, "src", "dst").groupBy("bundle").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    dealt = roots.select(bundle, "root", "times").groupBy("bundle").agg(F.collect_list(F.struct("root", "times")).alias("roots"))
    parts = F.least(F.ceil(F.size("edges").cast("double") * F.size("roots") / F.lit(share)), F.lit(8 * tasks)).cast("int")
    units = packed.join(dealt, "bundle").withColumn("parts", parts)
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.repartition(8 * tasks + bundles, "bundle", "part").select("edges", "roots", "part", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                columns = [batch.column(i).slice(r, 1).flatten().field(c) for i, c in ((0, "src"), (0, "dst"), (1, "root"), (1, "times"))]
                yield from kernel(*(x.to_numpy(zero_copy_only=False) for x in columns), *(batch.column(i)[r].as_py() for i in (2, 3)))

    return units.mapInArrow(run, schema)
