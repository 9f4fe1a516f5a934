"""DuckDB SQL for the registered queries. Iterations are unrolled into common table expressions, one pair per iteration."""

from __future__ import annotations

K, T = 8, 5
#: Large enough to stop before T iterations on the test tables (the moves fall from about 1 to 0.2), so both kinds of ending show.
TOL = 0.5
#: Fixed uniforms of the seeded start; the first two draw the same point.
UNIFORMS = [0.5, 0.5, 0.125, 0.875, 0.03125, 0.71875]


def points(batch: bool = False) -> str:
    owner = "CAST(label AS BIGINT)" if batch else "CAST(0 AS BIGINT)"
    return f"p AS MATERIALIZED (SELECT {owner} AS b, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 3)) AS x FROM embeddings)"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda v: v / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"


def first(k: int = K) -> str:
    return f"c0 AS MATERIALIZED (SELECT b, CAST(r - 1 AS INTEGER) AS cid, x AS c FROM (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY vec_id) AS r FROM p) WHERE r <= {k})"


def distance(metric: str, x: str = "p.x", c: str = "c.c") -> str:
    if metric == "euclidean":
        return f"greatest(0.0, list_dot_product({x}, {x}) + list_dot_product({c}, {c}) - 2 * list_dot_product({x}, {c}))"
    return f"-list_dot_product({x}, {c})"


def assigned(name: str, centers: str, metric: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT p.b, p.vec_id, min({{'d': {distance(metric)}, 'cid': c.cid}}) AS best FROM p JOIN {centers} c ON p.b = c.b GROUP BY p.b, p.vec_id)"


def updated(name: str, labels: str, old: str, normalize: bool) -> str:
    """labels: b, vec_id, best.cid. A cluster without points keeps its centroid."""
    c = "coalesce(m.c, o.c)"
    return f"""{name}s AS MATERIALIZED (
  SELECT b, cid, list(v ORDER BY i) AS c FROM (
    SELECT a.b, a.best.cid AS cid, u.i, avg(p.x[u.i]) AS v FROM {labels} a JOIN p ON a.b = p.b AND a.vec_id = p.vec_id, (SELECT unnest(range(1, 65)) AS i) u GROUP BY ALL)
  GROUP BY ALL),
{name} AS MATERIALIZED (SELECT o.b, o.cid, {unit(c) if normalize else c} AS c FROM {old} o LEFT JOIN {name}s m ON o.b = m.b AND o.cid = m.cid)"""


def moved(name: str, old: str, new: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT max(sqrt(list_sum(list_transform(list_zip(o.c, n.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS shift FROM {old} o JOIN {new} n ON o.b = n.b AND o.cid = n.cid)"


def drawn() -> str:
    """The start that the fixed uniforms draw."""
    draws = ", ".join(f"({i}, CAST({u} AS DOUBLE))" for i, u in enumerate(UNIFORMS))
    return f"""u(cid, u) AS (VALUES {draws}), r AS (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY b) AS n FROM p),
c0 AS MATERIALIZED (SELECT r.b, CAST(u.cid AS INTEGER) AS cid, r.x AS c FROM u JOIN r ON r.r = CAST(floor(u.u * r.n) AS BIGINT))"""


def iterations(metric: str, t: int, batch: bool = False, k: int = K, start: str | None = None) -> str:
    """a1 to at: labels of iteration i (by c(i-1)); c1 to ct: centroids after it; s1 to st: moves."""
    parts = [points(batch), start or first(k)]
    if metric == "cosine":
        parts = [points(batch).replace("p AS", "raw AS"), f"p AS MATERIALIZED (SELECT b, vec_id, {unit('x')} AS x FROM raw)", first(k)]
    for i in range(1, t + 1):
        parts += [assigned(f"a{i}", f"c{i - 1}", metric), updated(f"c{i}", f"a{i}", f"c{i - 1}", metric != "euclidean"), moved(f"s{i}", f"c{i - 1}", f"c{i}")]
    return "WITH " + ",\n".join(parts)


def labels_of(metric: str, t: int = T, batch: bool = False, k: int = K) -> str:
    own = "b AS batch_id, " if batch else ""
    return f"{iterations(metric, t, batch, k)} SELECT {own}vec_id, best.cid AS cluster_id FROM a{t}"


def exploded(source: str) -> str:
    return f"SELECT cid AS cluster_id, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 6) + 0.0 AS value FROM {source}, (SELECT unnest(range(1, 65)) AS i) u"


def centroids_of(metric: str, t: int = T) -> str:
    return f"{iterations(metric, t)} {exploded(f'c{t}')}"


def stopped(what: str, return_updated: bool) -> str:
    """A run with TOL: the first iteration that moves less is the last one."""
    last = "(SELECT coalesce(min(i), " + str(T) + ") AS i FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, shift FROM s{i}" for i in range(1, T + 1)) + f") WHERE shift < {TOL})"
    if what == "labels":
        rows = " UNION ALL ".join(f"SELECT {i} AS it, vec_id, best.cid AS cluster_id FROM a{i}" for i in range(1, T + 1))
        return f"{iterations('euclidean', T)}, stop AS {last} SELECT vec_id, cluster_id FROM ({rows}) JOIN stop ON it = stop.i"
    rows = " UNION ALL ".join(f"SELECT {i} AS it, cid, c FROM c{i}" for i in range(T + 1))
    moved_less = " OR ".join(f"(stop.i = {i} AND (SELECT shift FROM s{i}) < {TOL})" for i in range(1, T + 1))
    step = "stop.i" if return_updated else f"stop.i - CASE WHEN {moved_less} THEN 1 ELSE 0 END"
    return f"{iterations('euclidean', T)}, stop AS {last}, chosen AS (SELECT cid, c FROM ({rows}) JOIN stop ON it = {step}) {exploded('chosen')}"


def fixed_labels() -> str:
    return f"l AS MATERIALIZED (SELECT b, vec_id, {{'d': 0.0, 'cid': CAST(vec_id % {K - 1} AS INTEGER)}} AS best FROM p)"


def one_update(normalize: bool) -> str:
    return f"WITH {points()}, {first()}, {fixed_labels()}, {updated('n', 'l', 'c0', normalize)}"


def assign_of(metric: str, distances: bool) -> str:
    base = f"WITH {points()}, {first()}, {assigned('a', 'c0', metric)}"
    if metric == "cosine":
        base = f"WITH {points().replace('p AS', 'raw AS')}, p AS MATERIALIZED (SELECT b, vec_id, {unit('x')} AS x FROM raw), {first()}, {assigned('a', 'c0', metric)}"
    return f"{base} SELECT vec_id, best.cid AS cluster_id{', round(best.d, 6) + 0.0 AS d' if distances else ''} FROM a"


def oracle_sql() -> dict[str, str]:
    pairs = f"WITH {points()}, {first()} SELECT p.vec_id, c.cid AS cluster_id, round({{}}, 6) + 0.0 AS d FROM p JOIN c0 c ON p.b = c.b"
    sums = f"""WITH {points()}, {fixed_labels()}
SELECT l.best.cid AS cluster_id, count(*) AS cnt, CAST(i - 1 AS INTEGER) AS pos, round(sum(p.x[i]), 6) + 0.0 AS value
FROM l JOIN p ON l.vec_id = p.vec_id, (SELECT unnest(range(1, 65)) AS i) u GROUP BY l.best.cid, i"""
    draws = ", ".join(f"({i}, CAST({u} AS DOUBLE))" for i, u in enumerate(UNIFORMS))
    trace = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS iteration, round(shift, 6) + 0.0 AS shift FROM s{i}" for i in range(1, T + 1))
    tied = assigned("a", "twice", "euclidean")
    return {
        "scan_points": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
        "batch_lift": "SELECT CAST(label AS BIGINT) AS batch_id, vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
        "column_points": "SELECT p_partkey, round(CAST(p_size AS DOUBLE) * p_size + p_retailprice * p_retailprice, 3) + 0.0 AS sq_norm FROM part",
        "sq_norm": f"WITH {points()} SELECT vec_id, round(list_dot_product(x, x), 6) + 0.0 AS sq_norm FROM p",
        "centroid_sq_norm": f"WITH {points()}, {first()} SELECT cid AS cluster_id, round(list_dot_product(c, c), 6) + 0.0 AS sq_norm FROM c0",
        "l2_normalize": f"WITH {points()}, n AS (SELECT vec_id, {unit('x')} AS u FROM p) SELECT vec_id, round(list_dot_product(u, u), 6) + 0.0 AS norm_after, round(u[1], 6) + 0.0 AS first FROM n",
        "dot_cross": pairs.format("list_dot_product(p.x, c.c)"),
        "sq_dist": pairs.format(distance("euclidean")),
        "init_first_k": f"SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster_id, vec_id FROM embeddings ORDER BY vec_id LIMIT {K}",
        "init_seeded": f"""WITH u(cluster_id, u) AS (VALUES {draws}), r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)
SELECT CAST(u.cluster_id AS INTEGER) AS cluster_id, r.vec_id FROM u JOIN r ON r.r = CAST(floor(u.u * r.n) AS BIGINT)""",
        "assign_blocked": assign_of("euclidean", False),
        "assign_tie_duplicate_centroids": f"WITH {points()}, {first()}, twice AS (SELECT * FROM c0 UNION ALL SELECT b, cid + {K}, c FROM c0), {tied} SELECT vec_id, best.cid AS cluster_id FROM a",
        "assign_batched": f"WITH {points(True)}, {first(3)}, {assigned('a', 'c0', 'euclidean')} SELECT b AS batch_id, vec_id, best.cid AS cluster_id FROM a",
        "partial_sums_counts": sums,
        "merge_partials": sums,
        "update_euclid": f"{one_update(False)} {exploded('n')}",
        "update_cosine": f"{one_update(True)} {exploded('n')}",
        "update_empty_cluster": f"{one_update(False)} {exploded('n')} WHERE cid = {K - 1}",
        "update_id_clamp": f"SELECT CAST(CASE WHEN vec_id % {2 * K} >= {K} THEN 0 ELSE vec_id % {2 * K} END AS INTEGER) AS cluster_id, count(*) AS cnt FROM embeddings GROUP BY 1",
        "center_shift": f"{one_update(False)} SELECT o.cid AS cluster_id, round(sqrt(list_sum(list_transform(list_zip(o.c, n.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) + 0.0 AS shift FROM c0 o JOIN n ON o.b = n.b AND o.cid = n.cid",
        "max_shift": f"{one_update(False)}, {moved('s', 'c0', 'n')} SELECT round(shift, 6) + 0.0 AS shift FROM s",
        "kmeans_trace": f"{iterations('euclidean', T)} {trace}",
        "fit_predict": labels_of("euclidean"),
        "predict": f"{iterations('euclidean', T)}, {assigned('z', f'c{T}', 'euclidean')} SELECT vec_id, best.cid AS cluster_id FROM z",
        "cluster_sizes": f"{iterations('euclidean', T)} SELECT best.cid AS cluster_id, count(*) AS n FROM a{T} GROUP BY 1",
        "assign_join": assign_of("euclidean", True),
        "float_points": "SELECT p_partkey, round(CAST(CAST(p_retailprice / 3 AS FLOAT) AS DOUBLE), 6) + 0.0 AS x, round(CAST(CAST(p_size / 7 AS FLOAT) AS DOUBLE), 6) + 0.0 AS y FROM part",
        "write_labels_round_trip": labels_of("euclidean"),
        "estimator_auto": labels_of("euclidean", T, True, 3),
        "kmeans_seeded_labels": f"{iterations('euclidean', T, start=drawn())} SELECT vec_id, best.cid AS cluster_id FROM a{T}",
        "kmeans_seeded_events": f"""WITH u(cluster_id, u) AS (VALUES {draws}),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT CAST(ascii(event_type) AS BIGINT) AS batch_id, CAST(u.cluster_id AS INTEGER) AS cluster_id, round(r.value, 6) + 0.0 AS value FROM u JOIN r ON r.r = CAST(floor(u.u * r.n) AS BIGINT)""",
        "kmeans_sql_labels": labels_of("euclidean"),
        **{f"assign_{m}": assign_of(m, False) for m in ("euclidean", "cosine", "dot")},
        **{f"assign_{m}_with_dist": assign_of(m, True) for m in ("euclidean", "cosine", "dot")},
        **{f"kmeans_{m}_labels": labels_of(m) for m in ("euclidean", "cosine", "dot")},
        **{f"kmeans_{m}_centroids": centroids_of(m) for m in ("euclidean", "cosine", "dot")},
        **{f"kmeans_batched_{m}": labels_of(m, T, True, 3) for m in ("euclidean", "cosine", "dot")},
        **{f"kmeans_large_{w}": stopped(w, True) for w in ("labels", "centroids")},
        **{f"kmeans_converged_{w}": stopped(w, False) for w in ("labels", "centroids")},
    }
