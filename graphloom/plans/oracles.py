"""DuckDB SQL with the same rows as the queries of the graph engine, one statement each over the raw tables."""

from __future__ import annotations

from graphloom.plans.fixtures import BUCKET, D_SQL, S_SQL, T_SQL

DEGREE = "d AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM e GROUP BY src)"
ENDS = "u AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
PARTS = "u AS MATERIALIZED (SELECT p_partkey AS id FROM part)"
ROOT = "root AS (SELECT id FROM d ORDER BY degree DESC, id LIMIT 1)"
BFS = """b(v, l) USING KEY (v) AS (
  SELECT id, 0 FROM root
  UNION
  SELECT DISTINCT e.dst, f.l + 1 FROM b f JOIN e ON e.src = f.v
  LEFT JOIN recurring.b r ON r.v = e.dst WHERE r.v IS NULL)"""
CC = """cc(v, lab) USING KEY (v) AS (
  SELECT id, id FROM u
  UNION
  SELECT m.dst, max(f.lab) FROM cc f JOIN m ON m.src = f.v
  JOIN recurring.cc r ON r.v = m.dst WHERE f.lab > r.lab GROUP BY m.dst)"""
BOTH = "m AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
TRI = "t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {e} x JOIN {e} y ON y.src = x.dst JOIN {e} z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst)"


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"


def bfs(graph: str) -> str:
    return _with(graph, DEGREE, ROOT, BFS, recursive=True) + "SELECT v AS id, CAST(l AS INTEGER) AS level FROM b"


def bfs_summary(graph: str) -> str:
    return _with(graph, DEGREE, ROOT, BFS, recursive=True) + "SELECT CAST(max(l) + 1 AS INTEGER) AS levels, count(*) AS reached FROM b"


def bfs_unreached() -> str:
    return _with(S_SQL, DEGREE, ROOT, PARTS, BFS, recursive=True) + (
        "SELECT id, CAST(coalesce(l, 2147483647) AS INTEGER) AS level FROM u LEFT JOIN b ON b.v = u.id"
    )


def components(graph: str, universe: str, select: str) -> str:
    return _with(graph, universe, BOTH, CC, recursive=True) + select


def page_rank(graph: str, universe: str, rounds: int, threshold: float, select: str, push: bool = False, damping: float = 0.85) -> str:
    """A chain of rounds; once the L1 difference is at the threshold or below, scores stay."""
    give, fetch = ("dst", "src") if push else ("src", "dst")
    parts = [graph, universe, DEGREE, "n AS (SELECT count(*) AS nv FROM u)"]
    parts.append(f"r0 AS MATERIALIZED (SELECT d.id, d.degree, 1.0::DOUBLE / nv AS s, {threshold} + 1.0::DOUBLE AS l1 FROM d JOIN u USING (id), n)")
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"g{i} AS (SELECT e.{give} AS id, sum(x.s / x.degree) AS g FROM e JOIN {p} x ON x.id = e.{fetch} GROUP BY e.{give}),\n"
            f"f{i} AS MATERIALIZED (SELECT x.id, x.degree, x.s AS old, x.l1, {1 - damping!r}::DOUBLE / nv + {damping}::DOUBLE * coalesce(g, 0) AS s FROM {p} x LEFT JOIN g{i} USING (id), n),\n"
            f"r{i} AS MATERIALIZED (SELECT id, degree, CASE WHEN l1 > {threshold} THEN s ELSE old END AS s, "
            f"CASE WHEN l1 > {threshold} THEN (SELECT sum(abs(s - old)) FROM f{i}) ELSE l1 END AS l1 FROM f{i})"
        )
    parts.append(f"score AS (SELECT u.id, coalesce(r.s, 0) AS score FROM u LEFT JOIN r{rounds} r USING (id))")
    return _with(*parts) + select


def triangles_per_vertex(graph: str, weights: tuple[int, int, int]) -> str:
    a, b, c = weights
    return _with(graph, ENDS, TRI.format(e="e")) + (
        f"SELECT u.id, CAST(coalesce(sum(w), 0) AS BIGINT) AS triangles FROM u LEFT JOIN (SELECT a AS id, {a} AS w FROM t "
        f"UNION ALL SELECT b, {b} FROM t UNION ALL SELECT c, {c} FROM t) USING (id) GROUP BY u.id"
    )


def triangles_delta(before: str, after: str) -> str:
    """Change at each vertex, in the convention six, between two conditions on S's edges."""
    b = f"eb AS MATERIALIZED (SELECT * FROM e WHERE {before})"
    a = f"ea AS MATERIALIZED (SELECT * FROM e WHERE {after})"
    tb, ta = TRI.format(e="eb").replace("t AS", "tb AS", 1), TRI.format(e="ea").replace("t AS", "ta AS", 1)
    ends = lambda t, w: f"SELECT unnest([a, b, c]) AS id, {w} AS w FROM {t}"
    return _with(S_SQL, b, a, tb, ta) + (
        f"SELECT id, CAST(sum(w) AS BIGINT) AS triangles FROM ({ends('ta', 2)} UNION ALL {ends('tb', -2)}) GROUP BY id HAVING sum(w) <> 0"
    )


def katz(graph: str, universe: str, max_iterations: int, k: int, select: str) -> str:
    """Rounds that stop by themselves once at most k vertices are active."""
    parts = [graph, universe, DEGREE, "m AS (SELECT max(degree) AS m, 1.0::DOUBLE / (max(degree) + 1) AS alpha FROM d)"]
    parts.append("k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS c, 0.0::DOUBLE AS kc, 0.0::DOUBLE AS lower, 0.0::DOUBLE AS upper, true AS active, 1 AS it, (SELECT count(*) FROM u) AS n FROM u)")
    stays = "active AND upper > bound" if k else "active"
    for i in range(1, max_iterations):
        p = f"k{i - 1}"
        parts.append(
            f"w{i} AS (SELECT e.src AS id, sum(x.c) * any_value(alpha) AS c FROM e JOIN {p} x ON x.id = e.dst, m GROUP BY e.src),\n"
            f"s{i} AS MATERIALIZED (SELECT x.id, coalesce(w.c, 0) AS c, x.kc + coalesce(w.c, 0) AS kc, x.kc + coalesce(w.c, 0) + coalesce(w.c, 0) / m AS lower, "
            f"x.kc + coalesce(w.c, 0) + coalesce(w.c, 0) AS upper, x.active, x.n > {k} AS go FROM {p} x LEFT JOIN w{i} w USING (id), m),\n"
            f"q{i} AS (SELECT min(lower) AS bound FROM (SELECT lower FROM s{i} WHERE active ORDER BY lower DESC LIMIT {k})),\n"
            f"a{i} AS MATERIALIZED (SELECT s{i}.*, {stays} AS stays FROM s{i}, q{i}),\n"
            f"k{i} AS MATERIALIZED (SELECT x.id, CASE WHEN go THEN y.c ELSE x.c END AS c, CASE WHEN go THEN y.kc ELSE x.kc END AS kc, "
            f"CASE WHEN go THEN y.lower ELSE x.lower END AS lower, CASE WHEN go THEN y.upper ELSE x.upper END AS upper, "
            f"CASE WHEN go THEN y.stays ELSE x.active END AS active, CASE WHEN go THEN x.it + 1 ELSE x.it END AS it, "
            f"CASE WHEN go THEN (SELECT count(*) FILTER (WHERE stays) FROM a{i}) ELSE x.n END AS n FROM {p} x JOIN a{i} y USING (id))"
        )
    parts.append(f"k AS (SELECT * FROM k{max_iterations - 1})")
    return _with(*parts) + select


def katz_fixed(graph: str, universe: str, alpha: str, rounds: int, walked: str) -> str:
    """Scores after fixed rounds over the edges that meet the condition `walked`; alpha is of the whole graph."""
    parts = [graph, universe, DEGREE, f"m AS (SELECT {alpha} AS alpha FROM d)", f"g AS MATERIALIZED (SELECT * FROM e WHERE {walked})", "k0 AS (SELECT id, 1.0::DOUBLE AS c, 0.0::DOUBLE AS kc FROM u)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"w{i} AS (SELECT g.src AS id, sum(x.c) * any_value(alpha) AS c FROM g JOIN k{i - 1} x ON x.id = g.dst, m GROUP BY g.src),\n"
            f"k{i} AS MATERIALIZED (SELECT x.id, coalesce(w.c, 0) AS c, x.kc + coalesce(w.c, 0) AS kc FROM k{i - 1} x LEFT JOIN w{i} w USING (id))"
        )
    return _with(*parts) + f"SELECT id, floor(kc * 1e9 + 0.37) / 1e9 AS kc FROM k{rounds}"


def walk_counts(graph: str, universe: str, length: int) -> str:
    parts = [graph, universe, "n0 AS (SELECT id, 1::BIGINT AS n FROM u)"]
    for i in range(1, length + 1):
        parts.append(f"n{i} AS MATERIALIZED (SELECT u.id, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS n FROM u LEFT JOIN e ON e.src = u.id LEFT JOIN n{i - 1} x ON x.id = e.dst GROUP BY u.id)")
    return _with(*parts) + "\nUNION ALL ".join(f"SELECT {i} AS it, id, n FROM n{i}" for i in range(length + 1))


PATHS = """f(r, v, d, s) USING KEY (r, v) AS (
  SELECT id, id, 0, CAST(1 AS DOUBLE) FROM roots
  UNION
  SELECT w.r, e.dst, w.d + 1, sum(w.s) FROM f w JOIN e ON e.src = w.v
  LEFT JOIN recurring.f k ON k.r = w.r AND k.v = e.dst
  WHERE k.v IS NULL GROUP BY w.r, e.dst, w.d)"""


def betweenness_levels(roots: str) -> str:
    """roots: a query of ids."""
    return _with(S_SQL, ENDS, f"roots AS ({roots})", PATHS, recursive=True) + "SELECT r AS root, v AS id, d AS level, s AS sigma FROM f"


def betweenness(roots: str) -> str:
    """roots: a query of ids."""
    return _with(
        S_SQL, ENDS, f"roots AS (SELECT id, count(*) AS times FROM ({roots}) GROUP BY id)",
        PATHS,
        "f2 AS MATERIALIZED (SELECT * FROM f)",
        """g(r, v, d, s, dl) AS (
  SELECT r, v, d, s, CAST(0 AS DOUBLE) FROM f2 WHERE d = (SELECT max(d) FROM f2)
  UNION ALL
  SELECT p.r, p.v, p.d, any_value(p.s), coalesce(sum(CASE WHEN x.v IS NOT NULL THEN p.s / x.s * (1 + x.dl) END), 0)
  FROM f2 p LEFT JOIN e ON e.src = p.v LEFT JOIN g x ON x.r = p.r AND x.v = e.dst
  WHERE p.d = (SELECT max(d) - 1 FROM g) GROUP BY p.r, p.v, p.d)""",
        recursive=True,
    ) + "SELECT u.id, floor(coalesce(x.bc, 0) * 1e6 + 0.37) / 1e6 AS bc FROM u LEFT JOIN (SELECT v AS id, sum(dl * times) AS bc FROM g JOIN roots ON roots.id = r WHERE r <> v GROUP BY v) x USING (id)"


def prefix(graph: str) -> str:
    return _with(graph, ENDS, DEGREE) + (
        "SELECT id, coalesce(degree, 0) AS degree, CAST(coalesce(sum(coalesce(degree, 0)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM u LEFT JOIN d USING (id)"
    )


def partitions(graph: str) -> str:
    return prefix(graph).replace("SELECT id, coalesce(degree", ", x AS MATERIALIZED (SELECT id, coalesce(degree", 1) + """),
z AS (SELECT count(*) AS n, CAST(sum(degree) AS BIGINT) AS total, max(id) AS last FROM x),
c AS (SELECT *, greatest(1, least(n, CASE WHEN total / n < 4 THEN 200 WHEN total / n < 7 THEN 500 ELSE 1000 END)) AS parts FROM z),
i AS (SELECT unnest(range(parts + 1)) AS part, * FROM c)
SELECT CAST(part AS INTEGER) AS part, CAST((total * part) // parts AS BIGINT) AS needle,
  (SELECT count(*) FROM x WHERE x.id < i.last AND x.prefix < (total * part) // parts) AS boundary FROM i"""


def sampled_roots(k: int, seed: int = 7) -> str:
    """k draws with replacement over the ranked vertices."""
    return (
        f"SELECT x.id FROM (SELECT unnest(range({k}))::BIGINT AS i) q, (SELECT count(*) AS nv FROM u) n "
        f"JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM u) x ON x.at = {uniform_draw('q.i', 3, seed)} % n.nv"
    )


def iterations(rounds: int, threshold: float) -> str:
    """Rounds of a chain of page_rank that ran."""
    every = " UNION ALL ".join(f"SELECT max(l1) AS l FROM r{i}" for i in range(rounds))
    return f"SELECT CAST(count(*) FILTER (WHERE l > {threshold}) AS INTEGER) AS iterations FROM ({every})"


def random_list(seed: int) -> str:
    return _with(S_SQL, DEGREE) + f"SELECT id, degree, row_number() OVER (ORDER BY {uniform_draw('id', 5, seed)}, id) - 1 AS at FROM d"


def removed_batches(size: int, batches: int, repeats: int, present: int) -> str:
    top = batches * size
    return _with(
        S_SQL, f"p2 AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY (a * 1000003 + b * 8191) % 2147483647, a, b) - 1 AS pos FROM (SELECT src AS a, dst AS b FROM e WHERE src < dst))",
        f"o AS (SELECT pos // {size} AS batch, a, b, pos % {size} AS k FROM p2 WHERE pos < {top})",
        f"x AS (SELECT batch, a, b FROM o UNION ALL SELECT batch, a, b FROM o WHERE k < {repeats} UNION ALL "
        f"SELECT i.batch, a, b FROM p2, (SELECT unnest(range({batches})) AS batch) i WHERE pos >= {top} AND pos < {top + present})",
    ) + "SELECT CAST(batch AS INTEGER) AS batch, a AS src, b AS dst FROM x UNION ALL SELECT CAST(batch AS INTEGER), b, a FROM x"


def rmat(edges: str, scale: str, seed: int = 1, weights=(0.55, 0.15, 0.15, 0.25), noise: float = 0.05) -> str:
    """A row per drawn edge and bit, each with its five draws; bits are added up by place."""
    unit = lambda k: f"({uniform_draw('row', f'(bit * 5 + {k})', seed)} / 2147483647.0::DOUBLE)"
    w = ", ".join(f"{x}::DOUBLE * ({1 - noise!r}::DOUBLE + {2 * noise!r}::DOUBLE * {unit(k)}) AS w{k}" for k, x in enumerate(weights))
    return f"""WITH s AS (SELECT {scale} AS scale), r AS (SELECT unnest(range({edges}))::BIGINT AS row),
g AS (SELECT row, bit::BIGINT AS bit, scale FROM r, (SELECT scale, unnest(range(scale)) AS bit FROM s)),
q AS (SELECT row, bit, scale, {w}, {unit(4)} AS u FROM g),
z AS (SELECT *, u * (w0 + w1 + w2 + w3) AS pos FROM q),
y AS (SELECT row, 1::BIGINT << CAST(scale - 1 - bit AS BIGINT) AS place, pos >= w0 + w1 AS low, (pos >= w0 AND pos < w0 + w1) OR pos >= w0 + w1 + w2 AS right_ FROM z)
SELECT row, CAST(sum(CASE WHEN low THEN place ELSE 0 END) AS BIGINT) AS src, CAST(sum(CASE WHEN right_ THEN place ELSE 0 END) AS BIGINT) AS dst FROM y GROUP BY row"""


def uniform_draw(i: str, stream: int | str, seed: int) -> str:
    """The draw of sources.generators in SQL."""
    x = f"(({i} * 2654435 + {stream} * 7368787 + {seed * 15485863}) % 2147483647)"
    for a, b in ((48271, 11), (69621, 7919), (16807, 104729)):
        y = f"(({x} * {a} + {b}) % 2147483647)"
        x = f"(({y} * ({y} % 32749 + 1) + {b}) % 2147483647)"
    return x


def uniform(vertices: str, edges: str, select: str) -> str:
    return f"WITH n AS (SELECT {vertices} AS nv), r AS (SELECT unnest(range({edges}))::BIGINT AS row), g AS (SELECT row, {uniform_draw('row', 0, 1)} % nv AS src, {uniform_draw('row', 1, 1)} % nv AS dst FROM r, n) {select}"


BATCH_1 = f"{BUCKET} = 8"
