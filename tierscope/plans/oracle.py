"""DuckDB SQL for the catalogue: CTEs by name, put together as a query needs them."""

from __future__ import annotations

import math
import re

from tierscope.plans import catalog as C

_D = range(1, C.DIMS + 1)


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def _mean(prefix: str = "") -> str:
    return "[" + ", ".join(f"round(avg({prefix}vec[{i}]), 6)" for i in _D) + "]"


def _md5(seed: int, column: str) -> str:
    return f"md5(concat('{seed}:', {column}::VARCHAR)), {column}"


#: Rounds that searches are unrolled to; those of the tables of sf0.01 end before.
HOPS = 32
CTE: dict[str, str] = {
    "emb": "SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings",
    "picked": f"SELECT vec_id FROM emb ORDER BY {_md5(7, 'vec_id')} LIMIT (SELECT greatest({C.N_QUERIES}, count(*) // 40) FROM emb)",
    "base": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS node_id, vec, label, vec_id FROM emb WHERE vec_id NOT IN (SELECT vec_id FROM picked)",
    "q": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query_id, vec AS qvec, vec_id FROM emb WHERE vec_id IN (SELECT vec_id FROM picked)",
    "exact": f"SELECT query_id, node_id, {l2('qvec', 'vec')} AS dist FROM q, base",
    "truth": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) - 1 AS rank FROM exact) WHERE rank < {C.K}",
    "wide": f"SELECT query_id, node_id, greatest(0, {_dot('qvec', 'qvec')} + {_dot('vec', 'vec')} - 2 * {_dot('qvec', 'vec')}) AS dist FROM q, base",
    "wide_k": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, node_id) - 1 AS rank FROM wide) WHERE rank < {C.K}",
    "edges": f"SELECT src, pos, dst FROM (SELECT a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.node_id ORDER BY {l2('a.vec', 'b.vec')}, b.node_id) - 1 AS pos FROM base a, base b WHERE a.node_id <> b.node_id) WHERE pos < {C.DEGREE}",
    "deg": "SELECT src AS node_id, count(*) AS degree FROM edges GROUP BY 1",
    "mid": f"SELECT {_mean()} AS center FROM base",
    "med": f"SELECT node_id, vec, {l2('vec', 'center')} AS dist FROM base, mid ORDER BY dist, node_id LIMIT 1",
    "label_mid": f"SELECT label, {_mean()} AS m FROM base GROUP BY label",
    "label_med": f"SELECT label AS ord, node_id, vec FROM (SELECT b.label, node_id, vec, row_number() OVER (PARTITION BY b.label ORDER BY {l2('vec', 'm')}, node_id) AS r FROM base b JOIN label_mid USING (label)) WHERE r = 1",
    "sample": f"SELECT node_id, vec, row_number() OVER (ORDER BY {_md5(11, 'node_id')}) - 1 AS centroid FROM base QUALIFY centroid < 16",
    "chunks": "SELECT unnest(range(32)) AS chunk",
    "book": "SELECT chunk, centroid, [vec[2 * chunk + 1] - center[2 * chunk + 1], vec[2 * chunk + 2] - center[2 * chunk + 2]] AS sub FROM sample, mid, chunks",
    "parts": "SELECT node_id, chunk, [vec[2 * chunk + 1] - center[2 * chunk + 1], vec[2 * chunk + 2] - center[2 * chunk + 2]] AS part FROM base, mid, chunks",
    "codes": f"SELECT node_id, chunk, code FROM (SELECT node_id, p.chunk, centroid AS code, row_number() OVER (PARTITION BY node_id, p.chunk ORDER BY {l2('part', 'sub')}, centroid) AS r FROM parts p JOIN book b ON p.chunk = b.chunk) WHERE r = 1",
    "adc": f"SELECT query_id, b.chunk, centroid, {l2('[qvec[2 * chunk + 1] - center[2 * chunk + 1], qvec[2 * chunk + 2] - center[2 * chunk + 2]]', 'sub')} AS d FROM q, mid, book b",
    "adcd": "SELECT query_id, node_id, list_sum(list(d ORDER BY c.chunk)) AS adc FROM codes c JOIN adc a ON c.chunk = a.chunk AND c.code = a.centroid GROUP BY 1, 2",
    "adc_k": f"SELECT query_id, node_id, adc AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adc, node_id) - 1 AS rank FROM adcd) WHERE rank < {C.K}",
    "indeg": "SELECT node_id, count(dst) AS in_degree FROM base LEFT JOIN edges ON dst = node_id GROUP BY 1",
    "walk": "SELECT node_id, 0 AS hop FROM med UNION SELECT dst, hop + 1 FROM walk JOIN edges ON src = node_id WHERE hop < 40",
    "hops": "SELECT node_id, coalesce(h, (SELECT max(m) + 1 FROM (SELECT min(hop) AS m FROM walk GROUP BY node_id))) AS hop FROM base LEFT JOIN (SELECT node_id, min(hop) AS h FROM walk GROUP BY 1) USING (node_id)",
    "walk_m": "SELECT node_id, 0 AS hop FROM label_med UNION SELECT dst, hop + 1 FROM walk_m JOIN edges ON src = node_id WHERE hop < 40",
    "hops_m": "SELECT node_id, coalesce(h, (SELECT max(m) + 1 FROM (SELECT min(hop) AS m FROM walk_m GROUP BY node_id))) AS hop FROM base LEFT JOIN (SELECT node_id, min(hop) AS h FROM walk_m GROUP BY 1) USING (node_id)",
    "o_sequential": "SELECT node_id, node_id AS rank FROM base",
    "o_in_degree": "SELECT node_id, row_number() OVER (ORDER BY in_degree DESC, node_id) - 1 AS rank FROM indeg",
    "o_tie_key": "SELECT node_id, row_number() OVER (ORDER BY in_degree DESC, md5(concat('99:', node_id::VARCHAR)), node_id) - 1 AS rank FROM indeg",
    "o_hop_distance": "SELECT node_id, row_number() OVER (ORDER BY hop, node_id) - 1 AS rank FROM hops",
    "n_groups": f"SELECT ceil(count(*) / {C.GROUP}) AS n FROM base",
    "log": "SELECT event_id, ts, value AS latency, (event_id % 11) / 10 AS recall FROM events",
    "p99": "SELECT quantile_cont(latency, 0.99) AS p FROM log",
    "win": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, avg(CASE WHEN latency > 1.02 * p THEN 0 ELSE recall END) AS recall, quantile_cont(latency, 0.99) AS p99, count(*) AS n FROM log, p99 GROUP BY 1",
    "gains": "SELECT group_id, sum(in_degree)::DOUBLE AS g FROM g_sequential JOIN indeg USING (node_id) GROUP BY 1",
    "units": "SELECT group_id, unnest(['CODES', 'ADJ', 'VEC']) AS tier, unnest([codes_bytes, adj_bytes_actual, vec_bytes]) AS bytes, unnest([g, g * 4, g * 2]) AS gain FROM b_sequential JOIN gains USING (group_id)",
    "staged": "SELECT *, CASE tier WHEN 'CODES' THEN 0 WHEN 'ADJ' THEN 1 ELSE 2 END AS stage, min(gain / bytes) OVER (PARTITION BY group_id ORDER BY CASE tier WHEN 'CODES' THEN 0 WHEN 'ADJ' THEN 1 ELSE 2 END) AS key FROM units",
    "plan": "SELECT row_number() OVER (ORDER BY key DESC, group_id, stage) - 1 AS pos, group_id, tier, bytes, gain, sum(bytes) OVER (ORDER BY key DESC, group_id, stage) AS done FROM staged",
    "mlog": "SELECT v * 100000 + node_id AS lsn, node_id, v FROM (SELECT node_id, unnest(range(node_id % 3 + 1)) AS v FROM base)",
    "mlast": "SELECT node_id, max(lsn) AS lsn, max(v) AS v FROM mlog GROUP BY 1",
    "pol": "SELECT 'greedy' AS policy, done / 1e4 AS t, bytes FROM plan UNION ALL SELECT 'B3', sum(bytes) OVER (ORDER BY group_id, tier) / 1e4, bytes FROM units UNION ALL SELECT 'B4', sum(bytes) OVER (ORDER BY tier, group_id) / 1e4, bytes FROM units",
    "sim": "SELECT p AS policy, k.t::DOUBLE AS t, coalesce((SELECT sum(bytes) FROM pol WHERE policy = p AND pol.t <= k.t), 0) AS bytes FROM (SELECT unnest(['greedy', 'B3', 'B4']) AS p), (SELECT unnest(range(30)) AS t) k",
    "simr": "SELECT policy, t, bytes, (SELECT max(i / 10) FROM (SELECT unnest(range(11)) AS i, sum(bytes) AS b FROM units) WHERE i * b / 10 <= sim.bytes) AS recall FROM sim",
}
for _s in C.SEEDS:
    CTE[f"o_random_{_s}"] = f"SELECT node_id, row_number() OVER (ORDER BY {_md5(_s, 'node_id')}) - 1 AS rank FROM base"
ORDERS = ["sequential", "in_degree", "hop_distance", *(f"random_{s}" for s in C.SEEDS)]
for _o in ORDERS:
    CTE[f"g_{_o}"] = f"SELECT node_id, rank // {C.GROUP} AS group_id FROM o_{_o}"
    CTE[f"b_{_o}"] = (
        f"SELECT group_id, count(*) AS n_nodes, count(*) * 32.0::DOUBLE AS codes_bytes, sum(4 + 4 * degree)::DOUBLE AS adj_bytes_actual, "
        f"(count(*) * {4 + 4 * C.SLOTS})::DOUBLE AS adj_bytes_reserved, (count(*) * {4 * C.DIMS})::DOUBLE AS vec_bytes FROM g_{_o} JOIN deg USING (node_id) GROUP BY 1"
    )


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def pred(order: str, fractions: dict[str, float], tiers=("CODES", "ADJ", "VEC"), prefix: str = "") -> str:
    """ceil on binary doubles: the group number is below ceil(fraction * n)."""
    rows = _values([(prefix + m, f) for m, f in fractions.items()], "mask_id, f")
    ok = [f"(group_id < ceil(f * n)) AND {str(t in tiers).upper()} AS {t.lower()}_ok" for t in ("CODES", "ADJ", "VEC")]
    return f"SELECT mask_id, node_id, {', '.join(ok)} FROM g_{order}, n_groups, {rows}"


def beam(pred_sql: str, length: int = C.SEARCH.L, width: int = C.SEARCH.W, io: int | None = None, hops: int = HOPS) -> dict[str, str]:
    """CTEs of a search that ends within ``hops`` rounds: r0 .. result
    tables ``done`` (expanded), ``hits``, ``stats``, with ``pred`` and ``start``."""
    out = {
        "pred": pred_sql,
        "fall": "SELECT mask_id, arg_min(node_id, hop * 1000000 + node_id) AS fallback FROM pred JOIN hops USING (node_id) WHERE codes_ok GROUP BY 1",
        "start": "SELECT p.mask_id, query_id, CASE WHEN codes_ok THEN med.node_id ELSE fallback END AS seed, NOT codes_ok AS used_fallback FROM q, med JOIN pred p ON p.node_id = med.node_id LEFT JOIN fall ON fall.mask_id = p.mask_id",
        "s0": "SELECT mask_id, s.query_id, seed AS node_id, adc, NULL::INT AS hop FROM start s JOIN adcd a ON a.query_id = s.query_id AND a.node_id = seed",
    }
    for h in range(1, hops + 1):
        out[f"r{h}"] = f"SELECT *, row_number() OVER (PARTITION BY mask_id, query_id ORDER BY adc, node_id) <= {length} AND hop IS NULL AS open, count(hop) OVER (PARTITION BY mask_id, query_id) AS ios FROM s{h - 1}"
        out[f"m{h}"] = f"SELECT mask_id, query_id, node_id, adc, CASE WHEN open AND {"true" if io is None else f"ios < {io}"} AND row_number() OVER (PARTITION BY mask_id, query_id, open ORDER BY adc, node_id) <= {width} THEN {h} ELSE hop END AS hop FROM r{h}"
        out[f"s{h}"] = (
            f"SELECT * FROM m{h} UNION ALL SELECT x.mask_id, x.query_id, x.dst, adc, NULL FROM (SELECT DISTINCT m.mask_id, m.query_id, e.dst FROM m{h} m JOIN pred a ON a.mask_id = m.mask_id AND a.node_id = m.node_id AND a.adj_ok "
            f"JOIN edges e ON e.src = m.node_id JOIN pred c ON c.mask_id = m.mask_id AND c.node_id = e.dst AND c.codes_ok WHERE m.hop = {h}) x "
            f"JOIN adcd USING (query_id) ANTI JOIN m{h} k ON k.mask_id = x.mask_id AND k.query_id = x.query_id AND k.node_id = x.dst WHERE adcd.node_id = x.dst"
        )
    out["done"] = f"SELECT s.mask_id, s.query_id, s.node_id, s.hop, adj_ok, vec_ok, CASE WHEN vec_ok THEN e.dist ELSE s.adc END AS dist FROM s{hops} s JOIN pred USING (mask_id, node_id) JOIN exact e ON e.query_id = s.query_id AND e.node_id = s.node_id WHERE hop IS NOT NULL"
    out["hits"] = f"SELECT mask_id, query_id, rank, node_id, dist, vec_ok AS is_exact FROM (SELECT *, row_number() OVER (PARTITION BY mask_id, query_id ORDER BY dist, node_id) - 1 AS rank FROM done) WHERE rank < {C.K}"
    out["stats"] = "SELECT mask_id, query_id, used_fallback, coalesce(hops, 0) AS hops, coalesce(n, 0) AS num_expanded, coalesce(miss, 0) AS miss_count, coalesce(co, 0) AS code_only_count FROM start LEFT JOIN (SELECT mask_id, query_id, count(DISTINCT hop) AS hops, count(*) AS n, count_if(NOT adj_ok)::BIGINT AS miss, count_if(NOT vec_ok)::BIGINT AS co FROM done GROUP BY 1, 2) USING (mask_id, query_id)"
    out["recall"] = f"SELECT s.mask_id, s.query_id, count(t.node_id) / {C.K} AS recall FROM stats s LEFT JOIN hits h ON h.mask_id = s.mask_id AND h.query_id = s.query_id LEFT JOIN truth t ON t.query_id = h.query_id AND t.node_id = h.node_id GROUP BY 1, 2"
    out["ceiling"] = "SELECT mask_id, query_id, avg(codes_ok::INT) AS ceiling FROM truth JOIN pred USING (node_id) GROUP BY 1, 2"
    out["rec"] = "SELECT mask_id, avg(recall) AS mean_recall, avg(ceiling) AS mean_ceiling, sum(used_fallback::INT)::BIGINT AS fallbacks, count(*) AS n_queries, avg(hops) AS mean_hops, sum(miss_count)::BIGINT AS misses, sum(code_only_count)::BIGINT AS code_only FROM stats JOIN recall USING (mask_id, query_id) JOIN ceiling USING (mask_id, query_id) GROUP BY 1"
    return out


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """The final SELECT with the CTEs it needs, in order."""
    known, order = CTE | (extra or {}), []

    def need(text: str, path: tuple[str, ...] = ()) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|,)\s+\(?([a-z_]\w*)", text)):
            if name in known and name not in order and name not in path:
                need(known[name], (*path, name))
                if name not in order:
                    order.append(name)

    need(final)
    recursive = "RECURSIVE " if any(n.startswith("walk") for n in order) else ""
    kind = lambda n: "" if n.startswith("walk") else "MATERIALIZED "
    return (f"WITH {recursive}" + ",\n".join(f"{n} AS {kind(n)}({known[n]})" for n in order) + "\n" if order else "") + final


_SWEEP_PRED = " UNION ALL ".join(pred(o, C.CURVE, prefix=f"{o}|") for o in ORDERS)
_SWEEP = beam(_SWEEP_PRED) | {
    "sizes": " UNION ALL ".join(
        f"SELECT '{o}|' || m AS mask_id, '{o}' AS \"order\", ceil(f * n) AS n_groups, coalesce((SELECT sum(codes_bytes + adj_bytes_actual + vec_bytes) FROM b_{o} WHERE group_id < ceil(f * n)), 0) AS bytes_total FROM n_groups, {_values([(m, f) for m, f in C.CURVE.items()], 'm, f')}" for o in ORDERS
    ),
    "points": 'SELECT mask_id, "order", n_groups, bytes_total, mean_recall, mean_ceiling FROM sizes JOIN rec USING (mask_id)',
    "curve": "SELECT \"order\", bytes_total, mean_recall, mean_ceiling FROM points WHERE \"order\" NOT LIKE 'random_%' UNION ALL SELECT 'random_avg', avg(bytes_total), avg(mean_recall), avg(mean_ceiling) FROM points WHERE \"order\" LIKE 'random_%' GROUP BY n_groups",
    "norm": 'SELECT "order", bytes_total, mean_recall, mean_recall / (SELECT avg(mean_recall) FROM curve WHERE mean_ceiling = 1.0) AS normalized_recall FROM curve',
    "steps": 'SELECT "order", bytes_total AS x1, normalized_recall AS y1, lag(bytes_total) OVER (PARTITION BY "order" ORDER BY bytes_total, normalized_recall) AS x0, lag(normalized_recall) OVER (PARTITION BY "order" ORDER BY bytes_total, normalized_recall) AS y0 FROM norm',
    "cross_at": 'SELECT "order", arg_min(x0 + (0.9 - y0) / (y1 - y0) * (x1 - x0), x1) AS crossing FROM steps WHERE y0 < 0.9 AND y1 >= 0.9 GROUP BY 1',
    "crossed": 'SELECT "order", crossing FROM (SELECT DISTINCT "order" FROM norm) LEFT JOIN cross_at USING ("order")',
    "split": "SELECT \"order\", crossing, \"order\" IN ('in_degree', 'hop_distance', 'traversal_frequency') AS imp FROM crossed WHERE crossing IS NOT NULL",
    "best": 'SELECT arg_min("order", crossing) FILTER (NOT imp) AS baseline, min(crossing) FILTER (NOT imp) AS baseline_bytes, arg_min("order", crossing) FILTER (imp) AS importance, min(crossing) FILTER (imp) AS importance_bytes FROM split',
}
_RANDOM = beam(pred("random_101", C.FRACTIONS))
_LIMITED = beam(pred("random_101", C.FRACTIONS), C.LIMITED.L, C.LIMITED.W, C.LIMITED.io_limit, 9)
_ALL = beam(pred("sequential", {"all": 1.0}))
_TIER = beam(" UNION ALL ".join(pred("sequential", {m: 1.0}, t) for m, t in (("codes", ("CODES",)), ("codes_adj", ("CODES", "ADJ")), ("full", ("CODES", "ADJ", "VEC")))))
_NAMED = {t: [(m, g) for m, x in C.NAMED.items() for g in x.get(t, [])] for t in ("CODES", "ADJ", "VEC")}


def _bytes(convention: str) -> str:
    other = "reserved" if convention == "actual" else "actual"
    of = lambda c: f"coalesce(sum({c}), 0)::DOUBLE"
    return sql(
        f"SELECT mask_id, {of('codes_bytes')} AS codes, {of('adj_bytes_' + convention)} AS adj, {of('vec_bytes')} AS vec, {of('codes_bytes')} + {of('adj_bytes_' + convention)} + {of('vec_bytes')} AS total, {of('adj_bytes_' + other)} AS adj_other, '{convention}' AS adj_convention "
        f"FROM {_values([(m, x) for m, x in C.FRACTIONS.items()], 'mask_id, f')} CROSS JOIN n_groups LEFT JOIN b_in_degree ON group_id < ceil(f * n) GROUP BY 1"
    )


_REC = "SELECT mask_id, round(mean_recall, 6) AS mean_recall, round(mean_ceiling, 6) AS mean_ceiling, fallbacks, n_queries, round(mean_hops, 6) AS mean_hops, misses, code_only FROM rec"
_ROUND = "round({0}, 6) AS {0}"


def _beams() -> str:
    parts = []
    for i, (b, w) in enumerate(C.BEAMS):
        ctes = {f"{k}_{i}": v for k, v in beam(pred("random_101", {"f50": 0.5}), b, w).items()}
        names = sorted((k[: -len(f"_{i}")] for k in ctes), key=len, reverse=True)
        for k, v in ctes.items():
            for n in names:
                v = re.sub(rf"\b(FROM|JOIN|,) {n}\b", rf"\1 {n}_{i}", v)
                v = re.sub(rf"\b{n}\.(mask_id|fallback)", rf"{n}_{i}.\1", v)
            ctes[k] = v
        parts.append((ctes, f"SELECT {b}::BIGINT AS L, {w}::BIGINT AS W, round(mean_recall, 6) AS mean_recall, round(mean_ceiling, 6) AS mean_ceiling, round(mean_ceiling - mean_recall, 6) AS broken_navigation, round(mean_hops, 6) AS mean_hops FROM rec_{i}"))
    return sql(" UNION ALL ".join(s for _, s in parts), {k: v for c, _ in parts for k, v in c.items()})


def oracle_sql() -> dict[str, str]:
    overlap = "SELECT query_id, count(*) AS n FROM truth JOIN adc_k USING (query_id, node_id) GROUP BY 1"
    out = {
        "heldout_split": "SELECT vec_id, false AS is_query, node_id AS new_id FROM base UNION ALL SELECT vec_id, true, query_id FROM q",
        "workload_eval_split": f"SELECT query_id, pos, pos < (SELECT round_even(count(*) * 0.5, 0) FROM q) AS workload FROM (SELECT query_id, row_number() OVER (ORDER BY {_md5(1234, 'query_id')}) - 1 AS pos FROM q)",
        "l2_entry_distance": f"SELECT query_id, node_id AS entry, round(d, 6) AS entry_dist FROM (SELECT query_id, node_id, {l2('qvec', 'vec')} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {l2('qvec', 'vec')}, ord) AS r FROM q, label_med) WHERE r = 1",
        "exact_knn_top10": "SELECT query_id, node_id, round(dist, 6) AS dist, rank FROM truth",
        "exact_knn_expanded_form": "SELECT query_id, rank, node_id FROM wide_k",
        "knn_selftest_agreement": "SELECT (SELECT count(*) FROM (SELECT query_id, list(node_id ORDER BY node_id) AS a, max(dist) AS x FROM truth GROUP BY 1) JOIN (SELECT query_id, list(node_id ORDER BY node_id) AS b, max(dist) AS y FROM wide_k GROUP BY 1) USING (query_id) WHERE a <> b AND abs(x - y) > 0.001) AS mismatches, (SELECT count(*) FROM q) AS queries, (SELECT round(max(abs(t.dist - w.dist)), 4) FROM truth t JOIN wide_k w USING (query_id, rank)) AS max_diff",
        "knn_graph_edges": "SELECT src, pos, dst FROM edges",
        "medoid": "SELECT node_id, round(dist, 6) AS dist FROM med",
        "entry_points_by_label": "SELECT ord::BIGINT AS ord, node_id FROM label_med",
        "degrees": "SELECT node_id, degree FROM deg",
        "neighbors_of_ids": "SELECT src, pos, dst FROM edges WHERE src IN (SELECT node_id FROM truth)",
        "point_lookup_vectors": "SELECT node_id, round(vec[1], 6) AS x0, round(vec[64], 6) AS x63 FROM base WHERE node_id IN (SELECT node_id FROM truth)",
        "pq_codes": "SELECT node_id, chunk, code FROM codes",
        "pq_decode_error": f"SELECT node_id, round(sqrt({l2('decoded', 'vec')}) / greatest(sqrt({_dot('vec', 'vec')}), 1e-6), 6) AS rel_err FROM (SELECT node_id, list_transform(list_zip(flatten(list(sub ORDER BY c.chunk)), any_value(center)), lambda x: x[1] + x[2]) AS decoded FROM codes c JOIN book b ON c.chunk = b.chunk AND c.code = b.centroid JOIN mid ON true GROUP BY 1) JOIN base USING (node_id)",
        "adc_table": "SELECT query_id, chunk, centroid, round(d, 6) AS d FROM adc",
        "adc_scan_top10": "SELECT query_id, rank, node_id, round(dist, 6) AS dist FROM adc_k",
        "adc_exact_rank_overlap": f"SELECT query_id, coalesce(n, 0) AS overlap FROM q LEFT JOIN ({overlap}) USING (query_id)",
        "in_degree": "SELECT node_id, in_degree FROM indeg",
        "hop_distance": "SELECT node_id, hop::BIGINT AS hop FROM hops",
        "hop_distance_multi": "SELECT node_id, hop::BIGINT AS hop FROM hops_m",
        "order_sequential": "SELECT node_id, rank FROM o_sequential",
        "order_in_degree": "SELECT node_id, rank FROM o_in_degree",
        "order_in_degree_tie_key": "SELECT node_id, rank FROM o_tie_key",
        "order_hop": "SELECT node_id, rank FROM o_hop_distance",
        "order_random": "SELECT node_id, rank FROM o_random_101",
        "rank_grouping": "SELECT node_id, group_id FROM g_in_degree",
        "group_byte_stats": "SELECT * FROM b_in_degree",
        "mask_fraction_nodes": pred("in_degree", C.FRACTIONS, ("CODES", "ADJ")),
        "mask_named_groups": "SELECT mask_id, node_id, " + ", ".join(f"EXISTS (SELECT 1 FROM {_values(_NAMED[t], 'm, g')} WHERE m = mask_id AND g = group_id) AS {t.lower()}_ok" for t in _NAMED) + f" FROM g_sequential, {_values([(m,) for m in C.NAMED], 'mask_id')}",
        "mask_cumulative_check": "SELECT count(*) AS violations FROM (SELECT unnest(range(ceil(0.25 * n)::INT)) AS g FROM n_groups) ANTI JOIN (SELECT unnest(range(ceil(0.5 * n)::INT)) AS g FROM n_groups) USING (g)",
        "absence_ceiling_per_query": f"SELECT mask_id, query_id, round(avg(codes_ok::INT), 6) AS ceiling FROM truth JOIN ({pred('sequential', C.FRACTIONS)}) USING (node_id) GROUP BY 1, 2",
        "absence_ceiling_curve": f"SELECT mask_id, round(avg(codes_ok::INT), 6) AS mean_ceiling FROM truth JOIN ({pred('sequential', C.CURVE)}) USING (node_id) GROUP BY 1",
        "fallback_seed_per_mask": f"SELECT mask_id, arg_min(node_id, hop * 1000000 + node_id) AS fallback FROM ({pred('random_101', C.FRACTIONS)}) JOIN hops USING (node_id) WHERE codes_ok GROUP BY 1",
        "recall_at_10_adc_scan": f"SELECT 'adc' AS mask_id, query_id, round(coalesce(n, 0) / {C.K}, 6) AS recall FROM q LEFT JOIN ({overlap}) USING (query_id)",
        "adc_exact_agreement": f"SELECT count(*) AS n_queries, round(avg(r), 6) AS recall_a, 1.0::DOUBLE AS recall_b, round(avg(r), 6) AS mean_overlap, round(avg((r = 1)::INT), 6) AS exact_match, round(abs(avg(r) - 1) * 100, 6) AS gap_points, abs(avg(r) - 1) * 100 <= 0.5 AS passed FROM (SELECT coalesce(n, 0) / {C.K} AS r FROM q LEFT JOIN ({overlap}) USING (query_id))",
        "sweep_cache_antijoin": "SELECT md5(node_id::VARCHAR) AS run_id, node_id FROM base WHERE node_id % 3 <> 0",
        "windowed_p99_recall": "SELECT start, round(recall, 6) AS recall, round(p99, 6) AS p99, n FROM win",
        "ttrs": "SELECT min(start) AS ttrs FROM win a WHERE NOT EXISTS (SELECT 1 FROM win b WHERE b.start >= a.start AND b.recall < 0.2)",
        "recall_deficit_integral": "SELECT round(sum(greatest(0, 0.5 - recall)) * 3600, 6) AS deficit FROM win",
        "planner_greedy_order": "SELECT pos, group_id, tier, bytes, gain, round(done / 1e6, 6) AS at FROM plan",
        "neighbor_closure": "SELECT DISTINCT a.group_id, b.group_id AS needs FROM edges JOIN g_sequential a ON a.node_id = src JOIN g_sequential b ON b.node_id = dst WHERE a.group_id <> b.group_id",
        "gain_deciles": "SELECT decile, count(*) AS n, sum(bytes) AS bytes, round(avg(gain), 6) AS mean_gain FROM (SELECT *, ntile(10) OVER (ORDER BY gain DESC, group_id, tier) AS decile FROM units) GROUP BY 1",
        "mutation_replay": "SELECT m.node_id, m.v + 3 AS degree, string_agg(e.dst::VARCHAR, ',' ORDER BY e.pos) AS nbrs, any_value(m.lsn) AS lsn FROM mlast m JOIN edges e ON e.src = m.node_id AND e.pos < m.v + 3 GROUP BY 1, 2",
        "mutation_replay_watermark": "SELECT node_id, max(v) + 3 AS degree, max(lsn) AS lsn FROM mlog WHERE lsn <= 150000 GROUP BY 1",
        "miss_policy": "SELECT event_id, CASE WHEN latency / 100 <= recall AND event_id % 4 > 0 THEN 'fetch' ELSE 'skip' END AS action FROM log",
        "checkpoint_manifest": "SELECT tier, group_id, group_id % 3 + 1 AS epoch, concat_ws('/', tier, group_id, group_id % 3 + 1) AS path FROM units",
        "simulate_policies": "SELECT policy, t, round(bytes, 6) AS bytes, round(recall, 6) AS recall FROM simr",
        "h2_ratio": "SELECT s AS system, b AS baseline, round(s / b, 6) AS ratio, s / b <= 0.5 AS passed FROM (SELECT min(t) FILTER (policy = 'greedy') AS s, min(t) FILTER (policy <> 'greedy') AS b FROM simr WHERE recall >= 0.5)",
        "estimator_calibration": f"SELECT bucket, round(avg(p), 6) AS predicted, round(avg(r), 6) AS actual, round(avg(p) - avg(r), 6) AS error FROM (SELECT query_id / 50 AS p, coalesce(n, 0) / {C.K} AS r, ntile(5) OVER (ORDER BY query_id / 50, query_id) AS bucket FROM q LEFT JOIN ({overlap}) USING (query_id)) GROUP BY 1",
    }
    out = {k: sql(v) for k, v in out.items()} | {"mask_bytes_sweep": _bytes("actual"), "mask_bytes_reserved": _bytes("reserved"), "beam_sweep_broken_nav": _beams()}
    out["exact_knn_unrolled"] = out["exact_knn_top10"]
    hits = "SELECT mask_id, query_id, rank, node_id, round(dist, 6) AS dist, is_exact FROM hits"
    out |= {
        "masked_search_iolimited": sql(hits, _LIMITED),
        "masked_search_bsp": sql(hits, _RANDOM),
        "masked_search_full": sql(hits, _RANDOM),
        "masked_search_stats": sql("SELECT mask_id, query_id, used_fallback, hops, num_expanded, miss_count, code_only_count FROM stats", _RANDOM),
        "masked_search_expanded": sql("SELECT mask_id, query_id, node_id, hop::BIGINT AS hop FROM done", _RANDOM),
        "run_records": sql(_REC, _RANDOM),
        "traversal_frequency": sql("SELECT node_id, count(d.query_id) AS visits FROM base LEFT JOIN done d USING (node_id) GROUP BY 1", _ALL),
        "never_visited_fraction": sql("SELECT round(avg((v = 0)::INT), 6) AS never_visited FROM (SELECT node_id, count(d.query_id) AS v FROM base LEFT JOIN done d USING (node_id) GROUP BY 1)", _ALL),
        "tier_contributions": sql("SELECT round(a, 6) AS codes_only, round(b, 6) AS with_adj, round(c, 6) AS with_vec, codes_misses, adj_code_only, round(b - a, 6) AS adj_adds, round(c - b, 6) AS vec_adds FROM (SELECT max(mean_recall) FILTER (mask_id = 'codes') AS a, max(mean_recall) FILTER (mask_id = 'codes_adj') AS b, max(mean_recall) FILTER (mask_id = 'full') AS c, max(misses) FILTER (mask_id = 'codes') AS codes_misses, max(code_only) FILTER (mask_id = 'codes_adj') AS adj_code_only FROM rec)", _TIER),
        "ceiling_curve": sql("SELECT \"order\", round(bytes_total, 6) AS bytes_total, round(mean_ceiling, 6) AS mean_ceiling FROM points WHERE \"order\" NOT LIKE 'random_%'", _SWEEP),
        "random_avg_ceiling_curve": sql("SELECT round(bytes_total, 6) AS bytes_total, round(mean_ceiling, 6) AS mean_ceiling FROM curve WHERE \"order\" = 'random_avg'", _SWEEP),
        "restoration_curve": sql("SELECT \"order\", round(bytes_total, 6) AS bytes_total, round(mean_recall, 6) AS mean_recall FROM curve WHERE \"order\" <> 'random_avg'", _SWEEP),
        "random_avg_curve": sql("SELECT n_groups::BIGINT AS n_groups, round(avg(bytes_total), 6) AS bytes_total, round(avg(mean_recall), 6) AS mean_recall, count(*) AS n_seeds FROM points WHERE \"order\" LIKE 'random_%' GROUP BY 1", _SWEEP),
        "normalized_curve": sql('SELECT "order", round(bytes_total, 6) AS bytes_total, round(mean_recall, 6) AS mean_recall, round(normalized_recall, 6) AS normalized_recall FROM norm', _SWEEP),
        "crossing_bytes": sql('SELECT "order", round(crossing, 6) AS crossing FROM crossed', _SWEEP),
        "h1_ratio": sql("SELECT baseline, round(baseline_bytes, 6) AS baseline_bytes, importance, round(importance_bytes, 6) AS importance_bytes, round(importance_bytes / baseline_bytes, 6) AS ratio, importance_bytes / baseline_bytes <= 1 / 3 AS passed FROM best", _SWEEP),
    }
    assert math.ceil(0.07 * 100) == 8  # fractions are binary doubles on both sides
    return out
