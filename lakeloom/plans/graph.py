"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import graph as op
from lakeloom.plans.registry import query, r

_N = "n AS (SELECT COUNT(*) AS n FROM nodes)"
_DEG = "d AS (SELECT id, COUNT(dst) AS degree FROM nodes LEFT JOIN edges ON id = src GROUP BY id)"
_LDEG = "d AS (SELECT id, COUNT(dst) AS degree FROM link_nodes LEFT JOIN links ON id = src GROUP BY id)"


def _unrolled(name: str, first: str, step: str, rounds: int) -> str:
    """CTEs name0, name1, ... of a fixed number of rounds; {p} in ``step`` is the one before."""
    parts = [f"{name}0 AS ({first})"]
    parts += [f"{name}{i} AS MATERIALIZED ({step.replace('{p}', f'{name}{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(parts)


@query("graph_degree_centrality", "graph/degree-centrality", "edges nodes", f"WITH {_N}, {_DEG} SELECT id, ROUND(degree / (n - 1), 8) AS score FROM d, n")
def _(e, n):
    return op.degree_centrality(e, n).select("id", r("score", 8))


@query("graph_out_degrees", "graph/density", "edges nodes", f"WITH {_DEG} SELECT id, degree FROM d")
def _(e, n):
    return op.out_degrees(e, n)


@query("graph_density", "graph/density", "edges nodes", f"WITH {_N} SELECT ROUND((SELECT COUNT(*) FROM edges) / (n * (n - 1)), 8) AS density FROM n")
def _(e, n):
    return op.density(e, n).select(r("density", 8))


_PR = _unrolled("p", "SELECT id, 1.0::DOUBLE / n AS s FROM nodes, n", "SELECT nodes.id, 0.15::DOUBLE / n.n + 0.85 * COALESCE(SUM(q.s / d.degree), 0) AS s FROM nodes CROSS JOIN n LEFT JOIN edges ON nodes.id = edges.src LEFT JOIN {p} q ON q.id = edges.dst LEFT JOIN d ON d.id = q.id AND d.degree > 0 GROUP BY nodes.id, n.n", 15)


@query("graph_pagerank", "graph/pagerank", "edges nodes", f"WITH {_N}, {_DEG}, {_PR} SELECT id, ROUND(s, 8) AS score FROM p15")
def _(e, n):
    return op.pagerank(e, n, rounds=15, tolerance=0.0).select("id", r("score", 8))


@query("graph_pagerank_in", "graph/pagerank", "edges nodes", f"""WITH {_N}, {_DEG}, {_unrolled("p", "SELECT id, 1.0::DOUBLE / n AS s FROM nodes, n", "SELECT nodes.id, 0.15::DOUBLE / n.n + 0.85 * COALESCE(SUM(q.s / d.degree), 0) AS s FROM nodes CROSS JOIN n LEFT JOIN edges ON nodes.id = edges.dst LEFT JOIN {p} q ON q.id = edges.src LEFT JOIN d ON d.id = q.id GROUP BY nodes.id, n.n", 10)} SELECT id, ROUND(s, 8) AS score FROM p10""")
def _(e, n):
    return op.pagerank(e, n, rounds=10, tolerance=0.0, direction="in").select("id", r("score", 8))


@query("graph_eigenvector_centrality", "graph/eigenvector-centrality", "links link_nodes", f"""WITH {_unrolled("x", "SELECT id, 1.0::DOUBLE / sqrt((SELECT COUNT(*) FROM link_nodes)) AS s FROM link_nodes",
 "SELECT id, v / sqrt(SUM(v * v) OVER ()) AS s FROM (SELECT l.id, COALESCE(SUM(q.s), 0) AS v FROM link_nodes l LEFT JOIN links ON l.id = src LEFT JOIN {p} q ON q.id = dst GROUP BY l.id)", 12)} SELECT id, ROUND(s, 7) AS score FROM x12""")  # fmt: skip
def _(e, n):
    return op.eigenvector_centrality(e, n, 12, 0.0).select("id", r("score", 7))


@query("graph_katz_centrality", "graph/katz-centrality", "links link_nodes", f"""WITH {_unrolled("x", "SELECT id, 0.0::DOUBLE AS s FROM link_nodes", "SELECT l.id, 0.02 * COALESCE(SUM(q.s), 0) + 1 AS s FROM link_nodes l LEFT JOIN links ON l.id = src LEFT JOIN {p} q ON q.id = dst GROUP BY l.id", 10)}
 SELECT id, ROUND(s / (SELECT MAX(s) FROM x10), 7) AS score FROM x10""")  # fmt: skip
def _(e, n):
    return op.katz_centrality(e, n, 0.02, 1.0, 10, 0.0).select("id", r("score", 7))


@query("graph_top_k", "graph/katz-centrality", "edges nodes", f"WITH {_N}, {_DEG} SELECT id, ROUND(degree / (n - 1), 8) AS score FROM d, n ORDER BY degree DESC, id LIMIT 10")
def _(e, n):
    return op.top_k(op.degree_centrality(e, n), 10).select("id", r("score", 8))


_BFS = """bfs(source, id, hops) AS (SELECT id, id, 0 FROM link_nodes UNION SELECT source, dst, hops + 1 FROM bfs JOIN links ON id = src WHERE hops < 20),
dist AS (SELECT source, id, MIN(hops) AS hops FROM bfs GROUP BY 1, 2)"""


@query("graph_distances", "graph/shortest-path", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT source, id, CAST(hops AS BIGINT) AS hops FROM dist")
def _(e, n):
    return op.all_distances(e, n).select("source", "id", "hops")


@query("graph_closeness", "graph/closeness-centrality", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT n.id, ROUND(COALESCE(COUNT(hops) / SUM(hops), 0), 8) AS score FROM link_nodes n LEFT JOIN dist ON n.id = source AND hops > 0 GROUP BY n.id")
def _(e, n):
    return op.closeness_centrality(e, n).select("id", r("score", 8))


@query("graph_harmonic", "graph/closeness-centrality", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT n.id, ROUND(COALESCE(SUM(1 / hops), 0) / (SELECT COUNT(*) - 1 FROM link_nodes), 8) AS score FROM link_nodes n LEFT JOIN dist ON n.id = source AND hops > 0 GROUP BY n.id")
def _(e, n):
    return op.closeness_centrality(e, n, True).select("id", r("score", 8))


@query("graph_betweenness", "graph/betweenness-centrality", "links link_nodes", f"""WITH RECURSIVE {_BFS},
paths(source, id, hops, k) AS (SELECT id, id, 0, 1.0::DOUBLE FROM link_nodes UNION ALL SELECT p.source, l.dst, p.hops + 1, SUM(p.k) FROM paths p JOIN links l ON p.id = l.src JOIN dist d ON d.source = p.source AND d.id = l.dst AND d.hops = p.hops + 1 GROUP BY p.source, l.dst, p.hops),
w AS (SELECT v.source AS s, t.id AS t, v.id AS v, v.k * u.k / t.k AS share FROM paths v JOIN paths u ON u.source = v.id JOIN paths t ON t.source = v.source AND t.id = u.id AND t.hops = v.hops + u.hops WHERE v.hops > 0 AND u.hops > 0)
SELECT n.id, ROUND(COALESCE(SUM(share), 0) / (SELECT (COUNT(*) - 1) * (COUNT(*) - 2) FROM link_nodes), 8) AS score FROM link_nodes n LEFT JOIN w ON n.id = v GROUP BY n.id""")  # fmt: skip
def _(e, n):
    return op.betweenness_centrality(e, n).select("id", r("score", 8))


@query("graph_path_metrics", "graph/average-path-length", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT ROUND(AVG(hops), 8) AS average_path_length, CAST(MAX(hops) AS BIGINT) AS diameter FROM dist WHERE hops > 0")
def _(e, n):
    return op.path_metrics(e, n).select(r("average_path_length", 8), "diameter")


@query("graph_eccentricity", "graph/shortest-path", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT source AS id, CAST(MAX(hops) AS BIGINT) AS eccentricity FROM dist GROUP BY 1")
def _(e, n):
    return op.eccentricity(e, n)


@query("graph_diameter_radius", "graph/shortest-path", "links link_nodes", f"WITH RECURSIVE {_BFS}, x AS (SELECT MAX(hops) AS e FROM dist GROUP BY source) SELECT CAST(MAX(e) AS BIGINT) AS diameter, CAST(MIN(e) FILTER (WHERE e > 0) AS BIGINT) AS radius FROM x")
def _(e, n):
    return op.diameter_and_radius(e, n)


@query("graph_weighted_shortest_paths", "graph/shortest-path", "links link_nodes", """WITH RECURSIVE w AS (SELECT src, dst, 1 + (src * 7 + dst * 3) % 10 / 4.0 AS w FROM links), p(id, distance, h) AS (SELECT 5, 0.0::DOUBLE, 0 UNION SELECT dst, MIN(distance + w.w), h + 1 FROM p JOIN w ON id = src WHERE h < 20 GROUP BY dst, h)
SELECT CAST(5 AS BIGINT) AS source, id, ROUND(MIN(distance), 6) AS distance FROM p GROUP BY id""")  # fmt: skip
def _(e, n):
    weighted = e.withColumn("w", 1 + (F.col("src") * 7 + F.col("dst") * 3) % 10 / 4.0)
    return op.shortest_paths(weighted, n.where("id = 5"), "w").select("source", "id", r("distance", 6))


@query("graph_path_between", "graph/shortest-path", "edges", """WITH RECURSIVE p(id, hops, path) AS (SELECT CAST(3 AS BIGINT), 0, [CAST(3 AS BIGINT)] UNION ALL SELECT dst, hops + 1, list_append(path, dst) FROM p JOIN edges ON id = src WHERE hops < 5 AND NOT list_contains(path, dst))
SELECT CAST(hops AS BIGINT) AS hops, array_to_string(MIN(path), '>') AS path FROM p WHERE id = 141 GROUP BY hops ORDER BY p.hops LIMIT 1""")  # fmt: skip
def _(e):
    return op.path_between(e, 3, 141).select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("graph_path_avoiding", "graph/shortest-path", "edges", """WITH RECURSIVE e AS (SELECT * FROM edges WHERE (src + dst) % 4 <> 1), p(id, hops, path) AS (SELECT CAST(3 AS BIGINT), 0, [CAST(3 AS BIGINT)] UNION ALL SELECT dst, hops + 1, list_append(path, dst) FROM p JOIN e ON id = src WHERE hops < 6 AND NOT list_contains(path, dst))
SELECT CAST(hops AS BIGINT) AS hops, array_to_string(MIN(path), '>') AS path FROM p WHERE id = 141 GROUP BY hops ORDER BY p.hops LIMIT 1""")  # fmt: skip
def _(e):
    return op.path_between(e, 3, 141, avoid=e.where("(src + dst) % 4 = 1")).select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("graph_k_shortest_paths", "graph/shortest-path", "edges", """WITH RECURSIVE p(id, hops, path) AS (SELECT CAST(3 AS BIGINT), 0, [CAST(3 AS BIGINT)] UNION ALL SELECT dst, hops + 1, list_append(path, dst) FROM p JOIN edges ON id = src WHERE hops < 5 AND id <> 141 AND NOT list_contains(path, dst))
SELECT CAST(hops AS BIGINT) AS hops, array_to_string(path, '>') AS path FROM p WHERE id = 141 ORDER BY p.hops, p.path LIMIT 3""")  # fmt: skip
def _(e):
    return op.k_shortest_paths(e, 3, 141, 3, 5).select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("graph_modularity", "graph/modularity-score", "edges nodes", f"WITH {_DEG}, m AS (SELECT COUNT(*) AS m FROM edges) SELECT ROUND(SUM((1 - a.degree * b.degree / (2 * m)) / (2 * m)), 8) AS modularity FROM edges JOIN d a ON src = a.id JOIN d b ON dst = b.id, m WHERE src % 8 = dst % 8")
def _(e, n):
    return op.modularity(e, n, n.withColumn("community", F.col("id") % 8)).select(r("modularity", 8))


@query("graph_louvain", "graph/louvain-community", "links link_nodes")
def _(e, n):
    return op.louvain(e, n, 10)


_LPA = _unrolled("x", "SELECT id, id AS label FROM nodes", "SELECT nodes.id, COALESCE(b.label, o.label) AS label FROM nodes JOIN {p} o ON o.id = nodes.id LEFT JOIN (SELECT src, label FROM (SELECT src, q.label, row_number() OVER (PARTITION BY src ORDER BY COUNT(*) DESC, q.label) AS k FROM edges JOIN {p} q ON q.id = dst GROUP BY src, q.label) WHERE k = 1) b ON b.src = nodes.id", 4)


@query("graph_label_propagation", "graph/label-propagation", "edges nodes", f"WITH {_LPA} SELECT id, label FROM x4")
def _(e, n):
    return op.label_propagation(e, n, 4)


_PAIRS = "e AS (SELECT DISTINCT src, dst FROM edges), k AS (SELECT src AS id, COUNT(*) AS k FROM e GROUP BY 1), c AS (SELECT x.src AS a, y.src AS b, COUNT(*) AS n, SUM(CASE WHEN kz.k > 1 THEN 1 / ln(kz.k) END) AS aa FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src LEFT JOIN k kz ON kz.id = x.dst GROUP BY 1, 2)"
for _kind, _kernel, _expr in (("jaccard", "graph/jaccard-similarity", "n / (ka.k + kb.k - n)"), ("cosine", "graph/cosine-similarity", "n / sqrt(ka.k * kb.k)"), ("common", "graph/common-neighbors", "CAST(n AS DOUBLE)"), ("adamic_adar", "graph/adamic-adar", "aa")):
    _sql = f"SELECT a, b, {_expr} AS score FROM c JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b WHERE ({_expr}) IS NOT NULL"
    query(f"graph_{_kind}", _kernel, "edges", f"WITH {_PAIRS} SELECT a, b, ROUND(score, 8) AS score FROM ({_sql}) q")(lambda e, kind=_kind: op.similarity(e, kind).select("a", "b", r("score", 8)))
    query(f"graph_top_{_kind}", _kernel, "edges", f"WITH {_PAIRS} SELECT a, b, score FROM (SELECT a, b, ROUND(score, 8) AS score FROM ({_sql}) q) z ORDER BY z.score DESC, a, b LIMIT 25")(lambda e, kind=_kind: op.top_pairs(op.similarity(e, kind).select("a", "b", r("score", 8)), 25))

_HIST = """v AS (SELECT o_custkey % 25 AS id, o_totalprice AS value FROM orders), s AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM v),
b AS (SELECT id, CAST(LEAST(floor((value - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM v, s GROUP BY 1, 2),
h AS (SELECT i.id, j.bin, COALESCE(n, 0) / SUM(COALESCE(n, 0)) OVER (PARTITION BY i.id) AS p FROM (SELECT DISTINCT id FROM v) i CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) j LEFT JOIN b ON b.id = i.id AND b.bin = j.bin),
pq AS (SELECT x.id AS a, y.id AS b, x.bin, x.p AS p, y.p AS q FROM h x JOIN h y ON x.bin = y.bin AND x.id < y.id)"""


def _values(o):
    return o.select((F.col("o_custkey") % 25).alias("id"), F.col("o_totalprice").alias("value"))


@query("graph_value_histograms", "graph/value-similarity", "orders", f"WITH {_HIST} SELECT id, bin, ROUND(p, 8) AS p FROM h")
def _(o):
    return op.value_histograms(_values(o)).select("id", "bin", r("p", 8))


@query("graph_value_jsd", "graph/value-similarity", "orders", f"WITH {_HIST} SELECT a, b, ROUND(1 - sqrt(GREATEST(SUM(0.5 * (p + 1e-10) * ln((p + 1e-10) / ((p + q + 2e-10) / 2)) + 0.5 * (q + 1e-10) * ln((q + 1e-10) / ((p + q + 2e-10) / 2))), 0) / ln(2.0::DOUBLE)), 6) AS score FROM pq GROUP BY 1, 2")
def _(o):
    return op.value_similarity(op.value_histograms(_values(o))).select("a", "b", r("score", 6))


@query("graph_value_wasserstein", "graph/value-similarity", "orders", f"WITH {_HIST}, c AS (SELECT a, b, SUM(p - q) OVER (PARTITION BY a, b ORDER BY bin) AS d FROM pq) SELECT a, b, ROUND(1 / (1 + SUM(ABS(d))), 6) AS score FROM c GROUP BY 1, 2")
def _(o):
    return op.value_similarity(op.value_histograms(_values(o)), "wasserstein").select("a", "b", r("score", 6))


@query("graph_find_similar_nodes", "graph/value-similarity", "orders", f"""WITH {_HIST}, z AS (SELECT CASE WHEN a = 4 THEN b ELSE a END AS b, ROUND(1 - sqrt(GREATEST(SUM(0.5 * (p + 1e-10) * ln((p + 1e-10) / ((p + q + 2e-10) / 2)) + 0.5 * (q + 1e-10) * ln((q + 1e-10) / ((p + q + 2e-10) / 2))), 0) / ln(2.0::DOUBLE)), 6) AS score FROM pq WHERE a = 4 OR b = 4 GROUP BY 1)
SELECT CAST(4 AS BIGINT) AS a, b, score FROM z ORDER BY z.score DESC, b LIMIT 5""")  # fmt: skip
def _(o):
    return op.top_pairs(op.value_similarity(op.value_histograms(_values(o)), target=4).select("a", "b", r("score", 6)), 5)


_CLOSED = "e AS (SELECT src, dst FROM links), k AS (SELECT src AS id, COUNT(*) AS degree FROM e GROUP BY 1), t AS (SELECT x.src AS id, COUNT(*) AS closed FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN e z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1), c AS (SELECT n.id, COALESCE(degree, 0) AS degree, COALESCE(closed, 0) AS closed, CASE WHEN degree >= 2 THEN COALESCE(closed, 0) / (degree * (degree - 1) / 2) ELSE 0 END AS coefficient FROM link_nodes n LEFT JOIN k USING (id) LEFT JOIN t USING (id))"


@query("graph_clustering", "graph/clustering-coefficient", "links link_nodes", f"WITH {_CLOSED} SELECT id, degree, closed, ROUND(coefficient, 8) AS coefficient FROM c")
def _(e, n):
    return op.clustering(e, n).withColumn("coefficient", r("coefficient", 8))


@query("graph_clustering_summary", "graph/clustering-coefficient", "links link_nodes", f'WITH {_CLOSED} SELECT ROUND(AVG(coefficient), 8) AS average, ROUND(SUM(closed) / SUM(degree * (degree - 1) / 2), 8) AS "global" FROM c')
def _(e, n):
    return op.clustering_summary(e, n).select(r("average", 8), r("global", 8))


@query("graph_connected_components", "graph/connected-components", "links link_nodes", f"WITH RECURSIVE {_BFS} SELECT source AS id, MIN(id) AS label FROM dist GROUP BY 1")
def _(e, n):
    return op.connected_components(e, n)


@query("graph_component_sizes", "graph/connected-components", "links link_nodes", f"WITH RECURSIVE {_BFS}, l AS (SELECT source AS id, MIN(id) AS label FROM dist GROUP BY 1) SELECT label, COUNT(*) AS size FROM l GROUP BY 1")
def _(e, n):
    return op.component_sizes(e, n)


@query("graph_full_metrics", "graph/full-metrics", "links link_nodes", f"""WITH RECURSIVE {_BFS}, {_CLOSED}, l AS (SELECT label, COUNT(*) AS size FROM (SELECT source, MIN(id) AS label FROM dist GROUP BY 1) GROUP BY 1)
SELECT ROUND((SELECT COUNT(*) FROM links) / (SELECT COUNT(*) * (COUNT(*) - 1) FROM link_nodes), 8) AS density, (SELECT ROUND(AVG(hops), 8) FROM dist WHERE hops > 0) AS average_path_length, (SELECT CAST(MAX(hops) AS BIGINT) FROM dist) AS diameter,
(SELECT ROUND(AVG(coefficient), 8) FROM c) AS clustering, (SELECT COUNT(*) FROM l) AS components, (SELECT MAX(size) FROM l) AS largest""")  # fmt: skip
def _(e, n):
    return op.full_metrics(e, n).select(r("density", 8), r("average_path_length", 8), "diameter", r("clustering", 8), "components", "largest")


_TRI = "u AS (SELECT DISTINCT LEAST(src, dst) AS x, GREATEST(src, dst) AS y FROM edges), tri AS (SELECT a.x AS u, a.y AS v, b.y AS w FROM u a JOIN u b ON a.y = b.x JOIN u c ON c.x = a.x AND c.y = b.y)"


@query("graph_triangle_counts", "graph/triangle-counting", "edges nodes", f"WITH {_TRI}, t AS (SELECT unnest([u, v, w]) AS id FROM tri) SELECT n.id, COUNT(t.id) AS triangles FROM nodes n LEFT JOIN t USING (id) GROUP BY 1")
def _(e, n):
    return op.triangle_counts(e, n)


@query("graph_triads", "graph/motif-detection", "links link_nodes", f"WITH {_CLOSED} SELECT 'triangle' AS motif, CAST(SUM(closed) // 3 AS BIGINT) AS n FROM c UNION ALL SELECT 'wedge', CAST(SUM(degree * (degree - 1) // 2) - SUM(closed) AS BIGINT) FROM c UNION ALL SELECT 'edge', COUNT(*) // 2 FROM links")
def _(e, n):
    return op.triads(e, n)


@query("graph_classify_triads", "graph/motif-detection", "links link_nodes", """WITH t AS (SELECT id AS a, (id * 7 + 3) % n AS b, (id * 13 + 5) % n AS c FROM link_nodes, (SELECT COUNT(*) AS n FROM link_nodes)), u AS (SELECT DISTINCT LEAST(src, dst) AS x, GREATEST(src, dst) AS y FROM links),
k AS (SELECT a, b, c, (SELECT COUNT(*) FROM u WHERE (x = LEAST(a, b) AND y = GREATEST(a, b))) + (SELECT COUNT(*) FROM u WHERE (x = LEAST(b, c) AND y = GREATEST(b, c))) + (SELECT COUNT(*) FROM u WHERE (x = LEAST(a, c) AND y = GREATEST(a, c))) AS n FROM t)
SELECT a, b, c, CASE n WHEN 0 THEN 'Empty' WHEN 1 THEN 'Edge' WHEN 2 THEN 'Wedge' ELSE 'Triangle' END AS kind FROM k""")  # fmt: skip
def _(e, n):
    size = n.count()
    return op.classify_triads(e, n.select(F.col("id").alias("a"), ((F.col("id") * 7 + 3) % size).alias("b"), ((F.col("id") * 13 + 5) % size).alias("c")))


@query("graph_cliques", "graph/k-clique", "links", "WITH u AS (SELECT DISTINCT LEAST(src, dst) AS x, GREATEST(src, dst) AS y FROM links) SELECT a.x || ',' || a.y || ',' || b.y AS clique FROM u a JOIN u b ON a.y = b.x JOIN u ac ON ac.x = a.x AND ac.y = b.y")
def _(e):
    return op.cliques(e, 3).select(F.array_join(F.transform("clique", lambda x: x.cast("string")), ",").alias("clique"))


_RATIO = f"""{_DEG}, i AS (SELECT id, COUNT(src) AS indeg FROM nodes LEFT JOIN edges ON id = dst GROUP BY id), v AS (SELECT src AS id, VAR_POP(d.degree) AS v FROM edges JOIN d ON d.id = dst GROUP BY 1),
q AS (SELECT d.id, indeg, degree AS outdeg, CASE WHEN degree > 0 THEN indeg / degree END AS ratio, COALESCE(v, 0) AS v, CASE WHEN indeg = 0 AND degree = 0 THEN 'Isolated' WHEN degree = 0 THEN 'Sink' WHEN indeg / degree > 5 THEN 'Sink' WHEN indeg / degree < 0.2 THEN 'Source' ELSE 'Balanced' END AS role FROM d JOIN i USING (id) LEFT JOIN v USING (id))"""


@query("graph_degree_ratios", "graph/degree-ratio", "edges nodes", f'WITH {_RATIO} SELECT id, indeg AS "in", outdeg AS "out", ROUND(ratio, 8) AS ratio, role, ROUND(v, 6) AS neighbour_variance FROM q')
def _(e, n):
    return op.degree_ratios(e, n).select("id", "in", "out", r("ratio", 8), "role", r("neighbour_variance", 6))


@query("graph_node_roles", "graph/degree-ratio", "edges nodes", f"WITH {_RATIO} SELECT role, COUNT(*) AS n FROM q GROUP BY 1")
def _(e, n):
    return op.node_roles(e, n)


_STAR = f"""{_RATIO}, s AS (SELECT src AS id, COUNT(*) AS spokes FROM edges GROUP BY 1 HAVING COUNT(*) >= 3), x AS (SELECT a.src AS id, COUNT(*) AS inter FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst JOIN edges c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1),
st AS (SELECT id, spokes, 1 - COALESCE(inter, 0) / 2 / (spokes * (spokes - 1) / 2) AS score, CASE WHEN indeg / (indeg + outdeg) > 0.9 THEN 'InStar' WHEN outdeg / (indeg + outdeg) > 0.9 THEN 'OutStar' ELSE 'Mixed' END AS kind FROM s JOIN q USING (id) LEFT JOIN x USING (id))"""


@query("graph_star_scores", "graph/star-topology", "edges nodes", f"WITH {_STAR} SELECT id, spokes, ROUND(score, 8) AS score, kind FROM st")
def _(e, n):
    return op.star_scores(e, n).withColumn("score", r("score", 8))


@query("graph_top_hubs", "graph/star-topology", "edges nodes", f"WITH {_STAR} SELECT id, ROUND(score, 8) AS score FROM st ORDER BY st.score DESC, id LIMIT 10")
def _(e, n):
    return op.top_k(op.star_scores(e, n), 10).select("id", r("score", 8))


for _kind in ("InStar", "OutStar"):
    query(f"graph_find_{_kind.lower()}s", "graph/star-topology", "edges nodes", f"WITH {_STAR} SELECT id, spokes, ROUND(score, 8) AS score FROM st WHERE kind = '{_kind}' AND score >= 0.2")(lambda e, n, kind=_kind: op.find_stars(op.star_scores(e, n), kind, 0.2).select("id", "spokes", r("score", 8)))

_CYC = f"""{_DEG}, c2 AS (SELECT a.src AS id, COUNT(*) AS c2 FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
c3 AS (SELECT unnest([a.src, a.dst, b.dst]) AS id FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst),
c4 AS (SELECT unnest([a.src, a.dst, b.dst, c.dst]) AS id FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src JOIN edges x ON x.src = a.src AND x.dst = c.dst WHERE a.src <> b.dst AND c.dst <> a.src AND c.dst <> a.dst),
q AS (SELECT d.id, degree, COALESCE(c2.c2, 0) AS c2, COALESCE(t.c3, 0) AS c3, COALESCE(f.c4, 0) // 4 AS c4 FROM d LEFT JOIN c2 USING (id) LEFT JOIN (SELECT id, COUNT(*) AS c3 FROM c3 GROUP BY 1) t USING (id) LEFT JOIN (SELECT id, COUNT(*) AS c4 FROM c4 GROUP BY 1) f USING (id)),
z AS (SELECT *, CASE WHEN degree > 0 THEN (c2 + c3 + c4) / degree ELSE 0 END AS ratio, CASE WHEN c4 > 3 THEN 'Critical' WHEN c4 > 0 THEN 'High' WHEN c3 >= 3 THEN 'Medium' WHEN c3 >= 1 OR c2 >= 3 THEN 'Low' ELSE 'Baseline' END AS risk FROM q)"""


@query("graph_cycle_counts", "graph/cycle-participation", "edges nodes", f"WITH {_CYC} SELECT id, degree, c2, c3, c4, ROUND(ratio, 8) AS ratio, risk FROM z")
def _(e, n):
    return op.cycle_counts(e, n).withColumn("ratio", r("ratio", 8))


@query("graph_high_risk_nodes", "graph/cycle-participation", "edges nodes", f"WITH {_CYC} SELECT id, c4, risk FROM z WHERE risk IN ('High', 'Critical')")
def _(e, n):
    return op.cycle_counts(e, n).where("risk IN ('High', 'Critical')").select("id", "c4", "risk")


def _features(n):
    return n.select("id", F.array(*[((F.col("id") * k) % 7 / 7.0) for k in (1, 2, 3)]).alias("h"))


_W1 = ([[0.5, -0.2, 0.1], [0.3, 0.8, -0.5]], [0.1, -0.1])
_W2 = ([[1.0, -1.0], [0.5, 0.5]], [0.0, 0.2])


_H = "f AS (SELECT id, id * 1 % 7 / 7.0::DOUBLE AS a, id * 2 % 7 / 7.0::DOUBLE AS b, id * 3 % 7 / 7.0::DOUBLE AS c FROM link_nodes), l AS (SELECT src, dst FROM links UNION SELECT id, id FROM link_nodes)"


@query("graph_gnn_inference", "graph/gnn-inference", "links link_nodes", f"""WITH {_H}, m AS (SELECT src AS id, AVG(a) AS a, AVG(b) AS b, AVG(c) AS c FROM l JOIN f ON f.id = dst GROUP BY 1), z AS (SELECT id, GREATEST(0.5 * a - 0.2 * b + 0.1 * c + 0.1, 0) AS u, GREATEST(0.3 * a + 0.8 * b - 0.5 * c - 0.1, 0) AS v FROM m),
n AS (SELECT id, (u - v) / 2 / sqrt((u - v) * (u - v) / 4 + 1e-5) AS u, (v - u) / 2 / sqrt((u - v) * (u - v) / 4 + 1e-5) AS v FROM z), k AS (SELECT src AS id, AVG(u) AS u, AVG(v) AS v FROM l JOIN n ON n.id = dst GROUP BY 1), o AS (SELECT id, u - v AS p, 0.5 * u + 0.5 * v + 0.2 AS q FROM k)
SELECT id, ROUND(1 / (1 + exp(q - p)), 6) AS p0, ROUND(1 / (1 + exp(p - q)), 6) AS p1, CASE WHEN p >= q THEN 0 ELSE 1 END AS prediction FROM o""")  # fmt: skip
def _(e, n):
    out = op.gnn_inference(e, _features(n), [_W1, _W2])
    return out.select("id", r(F.col("h")[0], 6, "p0"), r(F.col("h")[1], 6, "p1"), "prediction")


def _gat(e, n):
    wq, wk, wv = [[0.2, 0.1, -0.3], [0.4, 0.0, 0.2]], [[0.1, -0.1, 0.5], [0.3, 0.2, 0.0]], [[1.0, 0.0, 0.5], [0.0, 1.0, -0.5]]
    return op.graph_attention(e, _features(n), [(wq, wk, wv, [0.3, -0.2, 0.5, 0.1]), (wk, wq, wv, [0.1, 0.4, -0.3, 0.2])], ([[0.5, 0.5, 0.5, 0.5]], [0.1]))


_GAT = f"""{_H}, g AS (SELECT id, 0.2 * a + 0.1 * b - 0.3 * c AS q1, 0.4 * a + 0.2 * c AS q2, 0.1 * a - 0.1 * b + 0.5 * c AS k1, 0.3 * a + 0.2 * b AS k2, a + 0.5 * c AS v1, b - 0.5 * c AS v2 FROM f),
raw AS (SELECT src, dst, 0 AS head, 0.3 * s.q1 - 0.2 * s.q2 + 0.5 * d.k1 + 0.1 * d.k2 AS x, d.v1, d.v2 FROM l JOIN g s ON s.id = src JOIN g d ON d.id = dst UNION ALL SELECT src, dst, 1, 0.1 * s.k1 + 0.4 * s.k2 - 0.3 * d.q1 + 0.2 * d.q2, d.v1, d.v2 FROM l JOIN g s ON s.id = src JOIN g d ON d.id = dst),
e AS (SELECT *, exp(CASE WHEN x > 0 THEN x ELSE 0.2 * x END) AS e FROM raw), w AS (SELECT *, e / SUM(e) OVER (PARTITION BY head, src) AS w FROM e)"""


@query("graph_attention", "graph/graph-attention", "links link_nodes", f"WITH {_GAT} SELECT src AS id, ROUND(0.5 * SUM(w * (v1 + v2)) + 0.1, 6) AS h0 FROM w GROUP BY 1")
def _(e, n):
    return _gat(e, n)[0].select("id", r(F.col("h")[0], 6, "h0"))


@query("graph_node_importance", "graph/graph-attention", "links link_nodes", f"WITH {_GAT} SELECT dst AS id, ROUND(AVG(w), 6) AS score FROM w GROUP BY 1")
def _(e, n):
    return op.node_importance(_gat(e, n)[1]).select("id", r("score", 6))
