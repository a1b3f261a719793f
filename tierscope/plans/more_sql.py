"""DuckDB SQL for the queries of ``more``."""

from __future__ import annotations

from tierscope.operators.policies import SHARD, SWITCHES
from tierscope.plans import catalog as C
from tierscope.plans.more import RATE, TICKS
from tierscope.plans.oracle import _ALL, CTE, _values, l2, pred, sql

_STAGE = "CASE tier WHEN 'CODES' THEN 0 WHEN 'ADJ' THEN 1 ELSE 2 END"
_TAIL = "group_id, stage"
_KEYS = {
    "sequential": _TAIL,
    "random": f"md5(concat('5:', group_id::VARCHAR)), {_TAIL}",
    "density": f"density DESC, {_TAIL}",
    "group_density": f"group_density DESC, {_TAIL}",
    "gain": f"group_gain DESC, {_TAIL}",
    "visits": f"visits DESC, {_TAIL}",
    "asked": f"asked ASC NULLS LAST, {_TAIL}",
}


def _policy(name: str) -> str:
    switch = SWITCHES[name]
    order = _KEYS[switch.order]
    at = {"replay": f"max(done) OVER () / {RATE} + 2.0", "rebuild": "25.0", "shards": f"max(done) OVER (PARTITION BY group_id // {SHARD}) / {RATE}"}.get(switch.ready, f"done / {RATE}")
    if switch.whole:
        at = f"max(done) OVER (PARTITION BY group_id) / {RATE}"
    return f"SELECT '{name}' AS policy, pos, group_id, tier, bytes, {at} AS at FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, sum(bytes) OVER (ORDER BY {order}) AS done FROM keyed)"


_POLICIES = _ALL | {
    "by_group": "SELECT group_id, count(*) AS visits, min(query_id * 100000 + hop) AS asked FROM done JOIN g_sequential USING (node_id) GROUP BY 1",
    "keyed": f"SELECT u.group_id, tier, bytes, gain, coalesce(visits, 0) AS visits, asked, {_STAGE} AS stage, min(gain / bytes) OVER (PARTITION BY u.group_id ORDER BY {_STAGE}) AS density, sum(gain) OVER (PARTITION BY u.group_id) / sum(bytes) OVER (PARTITION BY u.group_id) AS group_density, sum(gain) OVER (PARTITION BY u.group_id) AS group_gain FROM units u LEFT JOIN by_group b ON b.group_id = u.group_id",
    "plans": " UNION ALL ".join(_policy(p) for p in SWITCHES),
    "ticks": f"SELECT unnest([{', '.join(repr(p) for p in SWITCHES)}]) AS policy, unnest([{', '.join(repr(s.beam) for s in SWITCHES.values())}])::DOUBLE AS beam, unnest([{', '.join(repr(s.miss) for s in SWITCHES.values())}]) AS miss",
    "reached": f"SELECT k.policy, beam, miss, t::DOUBLE AS t, coalesce((SELECT sum(bytes) FROM plans p WHERE p.policy = k.policy AND p.at <= t), 0) AS bytes FROM ticks k, (SELECT unnest(range({TICKS})) AS t)",
    "whole": "SELECT sum(bytes) AS b FROM units",
}
_EST = f"SELECT query_id, query_id / 50 AS predicted, coalesce(n, 0) / {C.K} AS actual FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM truth JOIN adc_k USING (query_id, node_id) GROUP BY 1) USING (query_id)"
_NODE_BYTES = 4 * C.DIMS + 4 + 4 * C.SLOTS
_PER = 4096 // _NODE_BYTES
#: One round of k-means from the sampled codebook.
_ROUND1 = {
    "moved": f"SELECT p.chunk, centroid, part FROM (SELECT p.chunk, p.part, b.centroid, row_number() OVER (PARTITION BY p.node_id, p.chunk ORDER BY {l2('part', 'sub')}, b.centroid) AS r FROM parts p JOIN book b ON p.chunk = b.chunk) p WHERE r = 1",
}


def oracle_sql() -> dict[str, str]:
    from tierscope.plans.oracle import oracle_sql as first

    sample256 = CTE["sample"].replace("centroid < 16", "centroid < 256")
    named = [(m, t, g) for m, x in C.NAMED.items() for t, gs in x.items() for g in gs]
    checkpoint = "FROM base JOIN g_sequential USING (node_id) JOIN deg USING (node_id)"
    lists = "SELECT src AS node_id, string_agg(dst::VARCHAR, ',' ORDER BY pos) AS list FROM edges GROUP BY 1"

    def objects(later: str, epoch: str) -> str:
        return sql(f"SELECT 'ADJ' AS tier, group_id, node_id, list || {later} AS payload{epoch} FROM lists JOIN g_sequential USING (node_id) UNION ALL SELECT 'CODES', group_id, node_id, degree::VARCHAR{epoch.replace('CASE WHEN group_id % 3 = 0 THEN 2 ELSE 1 END', '1')} {checkpoint}", {"lists": lists})

    out = {
        "source_matrix_header": f"SELECT count(*) AS rows, {C.DIMS}::BIGINT AS cols FROM base",
        "source_matrix_scan": f"SELECT node_id AS row_id, round(vec[1]::FLOAT::DOUBLE, 6) AS x0, round(vec[{C.DIMS}]::FLOAT::DOUBLE, 6) AS x63 FROM base",
        "source_result_ids": "SELECT query_id, rank, node_id FROM truth",
        "source_truth": "SELECT query_id, rank, node_id, round(dist::FLOAT::DOUBLE, 6) AS dist FROM truth",
        "source_index_meta": f"SELECT count(*) AS npts, {C.DIMS}::BIGINT AS ndims, (SELECT node_id FROM med) AS medoid, {_NODE_BYTES}::BIGINT AS node_bytes, {_PER}::BIGINT AS per_sector, {C.SLOTS}::BIGINT AS slots, ((count(*) + {_PER} - 1) // {_PER} + 1) * 4096 AS file_size FROM base",
        "source_index_nodes": f"SELECT node_id, degree, round(vec[1]::FLOAT::DOUBLE, 6) AS x0, round(vec[{C.DIMS}]::FLOAT::DOUBLE, 6) AS x63 FROM base JOIN deg USING (node_id)",
        "source_index_edges": "SELECT src, pos, dst FROM edges",
        "source_index_offsets": f"SELECT node_id, (node_id // {_PER} + 1) * 4096 + node_id % {_PER} * {_NODE_BYTES} AS offset FROM base",
        "source_index_lookup": "SELECT src AS node_id, count(*) AS degree, min(dst) FILTER (pos = 0) AS first FROM edges GROUP BY 1",
        "source_entry_points": "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, node_id, round(vec[1]::FLOAT::DOUBLE, 6) AS x0 FROM label_med",
        "source_curve_csv": f"SELECT 'sequential' AS \"order\", bytes_total, round(r, 6) AS mean_recall, round(r, 6) AS normalized_recall FROM (SELECT m AS mask_id, coalesce((SELECT sum(codes_bytes + adj_bytes_actual + vec_bytes) FROM b_sequential WHERE group_id < ceil(f * n)), 0)::DOUBLE AS bytes_total FROM n_groups, {_values([(m, x) for m, x in C.CURVE.items()], 'm, f')}) JOIN (SELECT mask_id, avg(codes_ok::INT) AS r FROM truth JOIN ({pred('sequential', C.CURVE)}) USING (node_id) GROUP BY 1) USING (mask_id)",
        "expand_mask": f"SELECT mask_id, tier, group_id::BIGINT AS group_id FROM {_values(named, 'mask_id, tier, group_id')}",
        "stream_windowed_quality": "SELECT start, round(recall, 6) AS recall, n FROM win",
        "arrivals_poisson": "SELECT node_id AS query_id, round(sum(gap) OVER (ORDER BY node_id), 6) AS at FROM (SELECT node_id, -ln((('0x' || substr(md5(concat('3:', node_id::VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296) / 20 AS gap FROM base)",
        "checkpoint_objects": f"SELECT tier, group_id, epoch::BIGINT AS epoch, rows, concat('epoch=', epoch, '/tier=', tier, '/group_id=', group_id) AS path FROM (SELECT unnest(['ADJ', 'CODES']) AS tier, group_id, 1 AS epoch, rows FROM (SELECT group_id, count(*) AS rows {checkpoint} GROUP BY 1) UNION ALL SELECT 'ADJ', group_id, 2, count(*) {checkpoint} WHERE group_id % 3 = 0 GROUP BY 2)",
        "estimator_ablation": f"SELECT 'global' AS estimator, round(avg(abs(actual - (SELECT avg(actual) FROM ({_EST})))), 6) AS mean_error FROM ({_EST}) UNION ALL SELECT 'per_query', round(avg(abs(predicted - actual)), 6) FROM ({_EST})",
    }
    out = {k: sql(v) for k, v in out.items()}
    out["report_json"] = first()["adc_exact_agreement"]
    out["source_records"] = f"SELECT mask_id, round(total, 6) AS total, unnest(['CODES', 'ADJ', 'VEC']) AS tier, unnest([codes, adj, vec]) AS bytes FROM ({first()['mask_bytes_sweep']})"
    out["source_pivots"] = sql("SELECT chunk, centroid, round(sub[1]::FLOAT::DOUBLE, 4) AS a, round(sub[2]::FLOAT::DOUBLE, 4) AS b FROM book", {"sample": sample256})
    out["checkpoint_read"] = objects("CASE WHEN group_id % 3 = 0 THEN '+' ELSE '' END", ", (CASE WHEN group_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS epoch")
    out["checkpoint_read_epoch"] = objects("''", "")
    out["restore_policies"] = sql('SELECT policy, pos, group_id, tier, bytes, round("at", 6) AS at FROM plans', _POLICIES)
    out["simulate_all_policies"] = sql("SELECT policy, t, round(bytes, 6) AS bytes, (SELECT max(i / 10) FROM (SELECT unnest(range(11)) AS i) WHERE i * b / 10 <= bytes) AS recall, round(beam * 0.1 + CASE WHEN miss = 'fetch' OR miss = 'adaptive' AND bytes / b >= 0.5 THEN (1 - least(1, bytes / b)) * 0.4 ELSE 0 END, 6) AS p99 FROM reached, whole", _POLICIES)
    out["pq_trained_codebook"] = sql("SELECT b.chunk, b.centroid, coalesce(a, round(any_value(sub)[1], 6)) AS a, coalesce(b, round(any_value(sub)[2], 6)) AS b FROM book b LEFT JOIN (SELECT chunk, centroid, round(avg(part[1]), 6) AS a, round(avg(part[2]), 6) AS b FROM moved GROUP BY 1, 2) m USING (chunk, centroid) GROUP BY ALL".replace("coalesce(b,", "coalesce(m.b,").replace("coalesce(a,", "coalesce(m.a,").replace("any_value(sub)", "sub"), _ROUND1)
    return out
