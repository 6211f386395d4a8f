"""SQL for DuckDB that states the result of each registered query independently."""

from __future__ import annotations

from contract.fixtures import FLOWS_SQL, PROBABILITY_WEIGHTS, SCORED_SQL
from contract.queries import DISTANCE_FEATURES, EDGE, GROUPS, K_HOOD, K_KNN, KEYS, LINEITEM_COLUMNS, N_BASELINE
from skein.schema import (
    BAR_STATISTICS,
    CLASSES,
    HOMOLOGY_DIMS,
    KEY_FEATURES,
    MANIFOLD_FEATURES,
    MANIFOLDS,
    NETWORK_FEATURES,
    NORMAL,
    RAW_FEATURES,
)

ORACLE: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def safe(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0)"


def unions(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- common table expressions --------------------------------------------------

FLOWS = "flows AS (" + FLOWS_SQL.format(events="events") + ")"
SCORED = FLOWS + ", scored AS (" + SCORED_SQL.format(flows="flows") + ")"
ENCODED = (
    FLOWS
    + """, encoded AS (
  SELECT *, CAST(string_split(src_addr, '.')[4] AS INT) AS src_addr_octet,
         CAST(string_split(dst_addr, '.')[4] AS INT) AS dst_addr_octet,
         CASE src_port WHEN 9 THEN 0 WHEN 654 THEN 1 END AS src_port_binary,
         CASE dst_port WHEN 9 THEN 0 WHEN 654 THEN 1 END AS dst_port_binary,
         mean_delay_s AS phys_mean_delay_s, average_hop_count AS phys_average_hop_count
  FROM flows)"""
)
SPLIT = (
    FLOWS
    + """, counts AS (SELECT label, count(*) AS n FROM flows GROUP BY label),
total AS (SELECT sum(n) AS n, CAST(ceil(0.2 * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS want FROM counts),
alloc0 AS (SELECT label, counts.n, want, (want * counts.n) // total.n AS base, (want * counts.n) % total.n AS rest
           FROM counts, total),
alloc AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                 <= want - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM alloc0),
hashed AS (SELECT flow_id, label, row_number() OVER (PARTITION BY label
             ORDER BY md5(concat('42:', CAST(flow_id AS STRING))), flow_id) AS rk FROM flows),
split AS (SELECT flow_id, label, CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split
          FROM hashed JOIN alloc USING (label))"""
)
SIGMA_STATS = ", ".join(
    f"avg({g}_distance) AS m_{g}, stddev_samp({g}_distance) AS s_{g}" for g in GROUPS
)
DETECTED = (
    SCORED
    + f", st AS (SELECT {SIGMA_STATS} FROM scored WHERE label = '{NORMAL}'), z AS (SELECT scored.*, "
    + ", ".join(f"({g}_distance - m_{g}) / s_{g} AS {g}_zscore" for g in GROUPS)
    + " FROM scored, st), det0 AS (SELECT *, "
    + ", ".join(f"{g}_zscore > 3 AS {g}_anomaly" for g in GROUPS)
    + " FROM z), det AS (SELECT *, c2_anomaly OR network_anomaly OR physical_anomaly AS anomaly_detected, "
    + "concat("
    + ", ".join(f"CAST(CAST({g}_anomaly AS INT) AS STRING)" for g in GROUPS)
    + ") AS pattern, greatest(c2_zscore, network_zscore, physical_zscore) AS overall_zscore FROM det0)"
)
Z_COLUMNS = {"overall": "overall_zscore", **{g: f"{g}_zscore" for g in GROUPS}}


def cells(columns: list[str], source: str, keep: str = "") -> str:
    """Long form: one SELECT per column."""
    keep = f"{keep}, " if keep else ""
    return unions(
        [f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns]
    )


def auc_ctes(long: str) -> str:
    """From rows (name, target, score, pos) to (name, target, auc, n_pos, n_neg)."""
    return f"""auc_rows AS ({long}),
auc_groups AS (SELECT name, target, score, sum(pos) AS p, sum(1 - pos) AS q FROM auc_rows GROUP BY ALL),
auc_ranked AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY name, target ORDER BY score
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM auc_groups),
auc AS (SELECT name, target, sum(CAST(p AS DOUBLE) * (below + q / 2.0))
   / nullif(CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE), 0) AS auc,
   CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM auc_ranked GROUP BY name, target)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


# --- preparation and reports ---------------------------------------------------

FLOW_COLUMNS = [
    "flow_id", "src_addr", "src_port", "dst_addr", "dst_port", "protocol", "flow_duration_s",
    *NETWORK_FEATURES, "label",
]
_no_id = ", ".join(c for c in FLOW_COLUMNS if c != "flow_id")
ORACLE["scan_profile"] = with_(
    FLOWS,
    f"SELECT {n('count(*)')} AS n_rows, {n(len(FLOW_COLUMNS))} AS n_columns, "
    + n("sum(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FLOW_COLUMNS) + ")")
    + f" AS n_nulls, {n('count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flows))')} AS duplicate_rows, "
    + n(f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_no_id} FROM flows))")
    + " AS duplicate_records FROM flows",
)
ORACLE["prep_summary"] = with_(
    FLOWS,
    "SELECT count(*) AS n_flows, "
    + ", ".join(f"{len(c)} AS {m.lower()}_dims" for m, c in MANIFOLD_FEATURES.items())
    + ", count(DISTINCT label) AS n_classes, string_agg(DISTINCT label, '|' ORDER BY label) AS classes FROM flows",
)
ORACLE["class_distribution"] = with_(
    FLOWS + ", c AS (SELECT label, count(*) AS n FROM flows GROUP BY label)",
    f"""SELECT label, n, {r('n * 100.0 / sum(n) OVER ()')} AS pct,
    {r('CAST(max(n) OVER () AS DOUBLE) / min(n) OVER ()')} AS imbalance,
    max(n) OVER () * 100.0 / sum(n) OVER () > 95 AS imbalanced FROM c""",
)
ORACLE["encode_c2"] = with_(
    ENCODED, f"SELECT flow_id, {', '.join(MANIFOLD_FEATURES['C2'])} FROM encoded"
)
def sorted_values(column: str) -> str:
    return f"(SELECT string_agg(CAST(p AS STRING), '|' ORDER BY p) FROM (SELECT DISTINCT {column} AS p FROM encoded))"


ORACLE["encode_ranges"] = with_(
    ENCODED,
    f"""SELECT min(src_addr_octet) AS src_octet_min, max(src_addr_octet) AS src_octet_max,
    min(dst_addr_octet) AS dst_octet_min, max(dst_addr_octet) AS dst_octet_max,
    {sorted_values('src_port')} AS src_ports, {sorted_values('dst_port')} AS dst_ports FROM encoded""",
)
ORACLE["distinct_by_class"] = with_(
    ENCODED
    + f", cells AS ({cells(RAW_FEATURES, 'encoded', 'label')}), "
    + "t AS (SELECT feature, count(DISTINCT value) AS n_total FROM cells GROUP BY feature), "
    + "c AS (SELECT feature, label, count(DISTINCT value) AS n_distinct FROM cells GROUP BY feature, label)",
    "SELECT feature, n_total, label, n_distinct FROM t JOIN c USING (feature) WHERE n_total > 100",
)
ORACLE["class_means"] = with_(
    FLOWS
    + f", cells AS ({cells(KEY_FEATURES, 'flows', 'label')}), "
    + "m AS (SELECT feature, label, avg(value) AS mean FROM cells GROUP BY feature, label)",
    f"""SELECT m.feature, m.label, {r('m.mean', 4)} AS mean,
    {r('CASE WHEN b.mean > 0 THEN m.mean / b.mean END', 4)} AS ratio_to_normal
    FROM m LEFT JOIN m b ON m.feature = b.feature AND b.label = '{NORMAL}'""",
)
ORACLE["range_overlap"] = with_(
    FLOWS
    + f", cells AS ({cells(KEY_FEATURES, 'flows', 'label')}), x AS (SELECT feature, "
    + "min(value) FILTER (label = 'Blackhole Attack') AS a0, max(value) FILTER (label = 'Blackhole Attack') AS a1, "
    + "min(value) FILTER (label <> 'Blackhole Attack') AS b0, max(value) FILTER (label <> 'Blackhole Attack') AS b1 "
    + "FROM cells GROUP BY feature)",
    f"SELECT feature, {r('a0')} AS class_min, {r('a1')} AS class_max, {r('b0')} AS rest_min, {r('b1')} AS rest_max, "
    "a0 <= b1 AND b0 <= a1 AS overlap FROM x",
)
ORACLE["feature_health"] = with_(
    ENCODED
    + f", cells AS ({cells(RAW_FEATURES, 'encoded')}), x AS (SELECT feature, "
    + "count(*) FILTER (value IS NULL OR isnan(value)) AS nan, count(*) FILTER (isinf(value)) AS inf, "
    + "coalesce(bool_and(value = 0), false) AS zero, count(DISTINCT value) AS d, avg(value) AS mean, stddev_samp(value) AS std "
    + "FROM cells GROUP BY feature)",
    f"""SELECT count(*) AS n_features, {n('sum(nan)')} AS nan_cells, {n('sum(inf)')} AS inf_cells,
    count(*) FILTER (zero) AS zero_columns, min(d) AS min_distinct, {r('avg(mean)', 3)} AS mean_of_means,
    {r('avg(std)', 3)} AS mean_of_stds FROM x""",
)
ORACLE["label_encode"] = with_(
    FLOWS + ", names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM flows))",
    f"SELECT flow_id, {n('i')} AS label_index FROM flows JOIN names USING (label)",
)
ORACLE["class_weights"] = with_(
    FLOWS + ", c AS (SELECT label, count(*) AS n FROM flows GROUP BY label)",
    f"SELECT label, n, {r('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)', 8)} AS weight FROM c",
)
ORACLE["stratified_split"] = with_(SPLIT, "SELECT flow_id, label, split FROM split")
_shares = ", ".join(
    r(f"{c} * 100.0 / sum({c}) OVER ()") + f" AS {c.replace('n_', 'pct_')}" for c in ("n_total", "n_train", "n_test")
)
ORACLE["split_report"] = with_(
    SPLIT
    + ", c AS (SELECT label, count(*) AS n_total, count(*) FILTER (split = 'train') AS n_train, "
    + "count(*) FILTER (split = 'test') AS n_test FROM split GROUP BY label)",
    f"SELECT label, n_total, n_train, n_test, {_shares} FROM c",
)
ORACLE["split_semi"] = with_(
    SPLIT,
    "SELECT flow_id, label, flow_duration_s FROM flows WHERE flow_id IN (SELECT flow_id FROM split WHERE split = 'test')",
)
ORACLE["split_disjoint"] = with_(
    SPLIT,
    """SELECT 'in_both' AS "check", count(*) AS n FROM (SELECT flow_id FROM split WHERE split = 'train'
      INTERSECT SELECT flow_id FROM split WHERE split = 'test')
    UNION ALL SELECT 'unassigned', count(*) FROM (SELECT flow_id FROM flows EXCEPT ALL SELECT flow_id FROM split)
    UNION ALL SELECT 'unknown', count(*) FROM (SELECT flow_id FROM split EXCEPT ALL SELECT flow_id FROM flows)""",
)
ORACLE["cv_folds"] = with_(
    SPLIT, "SELECT flow_id, label, CAST((rk - 1) % 5 AS INT) AS fold FROM hashed"
)
ORACLE["baseline_sample"] = with_(
    FLOWS,
    f"""SELECT flow_id, label, flow_duration_s FROM flows WHERE label = '{NORMAL}'
    ORDER BY md5(concat('42:', CAST(flow_id AS STRING))), flow_id LIMIT 1000""",
)
ORACLE["scale_manifold"] = with_(
    "s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_COLUMNS)
    + " FROM lineitem)",
    "SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"{r(f'avg(({c} - m_{c}) / s_{c})', 4)} AS {c}_z" for c in LINEITEM_COLUMNS)
    + " FROM lineitem, s GROUP BY l_returnflag",
)

# Points of the embeddings, one row per (flow_id, manifold).
POINTS = """b AS (SELECT vec_id AS flow_id, CAST(embedding AS DOUBLE[]) AS v, label % 5 AS c FROM embeddings),
raw_points AS (SELECT flow_id, unnest(['C2','Network','Physical']) AS manifold,
    unnest([v[1:5], v[6:20], v[21:22]]) AS vec, c,
    CASE WHEN md5(concat('42:', CAST(flow_id AS STRING))) < '3333' THEN 'test' ELSE 'train' END AS split FROM b)"""
CLASS_OF = "CASE c " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
_raw_rounded = ", ".join(
    f"{r(c)} AS {c}" if not c.endswith(("octet", "binary")) else f"e.{c}" for c in RAW_FEATURES
)
ORACLE["combine_features"] = with_(
    f"{ENCODED}, {POINTS}, w AS (SELECT flow_id, {CLASS_OF} AS label_2, vec[1] AS c2_first, split FROM raw_points WHERE manifold = 'C2')",
    f"SELECT flow_id, label, {_raw_rounded}, label_2, {r('c2_first')} AS c2_first, split FROM encoded e JOIN w USING (flow_id)",
)
ORACLE["alignment_check"] = with_(
    f"{FLOWS}, l AS (SELECT flow_id, count(*) AS n FROM flows GROUP BY flow_id), "
    "q AS (SELECT vec_id AS flow_id, count(*) AS n FROM embeddings GROUP BY vec_id)",
    f"""SELECT {n('sum(l.n)')} AS left_rows, {n('sum(q.n)')} AS right_rows, count(*) FILTER (q.n IS NULL) AS left_only,
    count(*) FILTER (l.n IS NULL) AS right_only, count(*) FILTER (l.n > 1 OR q.n > 1) AS repeated_ids
    FROM l FULL JOIN q USING (flow_id)""",
)

# --- detection -------------------------------------------------------------------

ORACLE["normal_stats"] = with_(
    DETECTED,
    unions(
        [
            f"SELECT '{g}' AS manifold, {r(f'm_{g}', 4)} AS mean, {r(f's_{g}', 4)} AS std, "
            f"{r(f'm_{g} + 3 * s_{g}', 4)} AS threshold FROM st"
            for g in GROUPS
        ]
    ),
)
ORACLE["zscore_detect"] = with_(
    DETECTED,
    "SELECT flow_id, label, predicted, "
    + ", ".join(f"{r(f'{g}_{x}')} AS {g}_{x}" for g in GROUPS for x in ("distance", "zscore"))
    + ", "
    + ", ".join(f"{g}_anomaly" for g in GROUPS)
    + ", anomaly_detected, pattern FROM det",
)
_rates = [(g, f"{g}_anomaly", f"{g}_zscore") for g in GROUPS] + [("combined", "anomaly_detected", "overall_zscore")]
ORACLE["flag_rates"] = with_(
    DETECTED,
    unions(
        [
            f"SELECT '{g}' AS manifold, count(*) FILTER ({f}) AS flagged, {r(f'avg(CAST({f} AS INT)) * 100.0')} AS pct, "
            f"{r(f'min({z})')} AS z_min, {r(f'max({z})')} AS z_max FROM det"
            for g, f, z in _rates
        ]
    ),
)
ORACLE["detection_summary"] = with_(
    DETECTED,
    "SELECT label, count(*) AS total_samples, count(*) FILTER (anomaly_detected) AS detected, "
    + r("count(*) FILTER (anomaly_detected) * 100.0 / count(*)")
    + " AS detection_rate_pct, "
    + ", ".join(f"count(*) FILTER ({g}_anomaly) AS {g}_flags" for g in GROUPS)
    + " FROM det GROUP BY label",
)
ORACLE["pattern_counts"] = with_(
    DETECTED + ", c AS (SELECT pattern, count(*) AS n FROM det GROUP BY pattern)",
    f"SELECT pattern, n, {r('n * 100.0 / sum(n) OVER ()')} AS pct FROM c ORDER BY n DESC, pattern LIMIT 10",
)
_others = {g: [h for h in GROUPS if h != g] for g in GROUPS}
ORACLE["exclusive_flags"] = with_(
    DETECTED,
    "SELECT "
    + ", ".join(
        f"count(*) FILTER ({g}_anomaly AND NOT {_others[g][0]}_anomaly AND NOT {_others[g][1]}_anomaly) AS {g}_anomaly_only"
        for g in GROUPS
    )
    + ", count(*) FILTER (CAST(c2_anomaly AS INT) + CAST(network_anomaly AS INT) + CAST(physical_anomaly AS INT) > 1) AS multiple, "
    + "bool_and(anomaly_detected = (c2_anomaly OR network_anomaly OR physical_anomaly)) AS union_is_or FROM det",
)
ORACLE["distance_describe"] = with_(
    SCORED,
    unions(
        [
            f"SELECT '{g}_distance' AS name, count({d}) AS count, {r(f'avg({d})', 4)} AS mean, "
            f"{r(f'stddev_samp({d})', 4)} AS std, {r(f'min({d})', 4)} AS min, "
            + ", ".join(f"{r(f'quantile_cont({d}, 0.{p})', 4)} AS p{p}" for p in (25, 50, 75))
            + f", {r(f'max({d})', 4)} AS max FROM scored"
            for g in GROUPS
            for d in [f"{g}_distance"]
        ]
    ),
)
ORACLE["distance_histogram"] = with_(
    SCORED
    + ", v AS ("
    + unions(
        [
            f"SELECT '{g}_distance' AS name, CASE WHEN label = '{NORMAL}' THEN 'normal' ELSE 'attack' END AS grp, "
            f"CAST({g}_distance AS DOUBLE) AS x FROM scored"
            for g in GROUPS
        ]
    )
    + """), sp AS (SELECT name, grp, count(*) AS total, min(x) AS lo, max(x) AS hi FROM v GROUP BY name, grp),
    c AS (SELECT name, grp, least(floor((x - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM v JOIN sp USING (name, grp) GROUP BY ALL),
    grid AS (SELECT *, unnest(generate_series(0, 49)) AS bin FROM sp)""",
    f"""SELECT grid.name, grid.grp, CAST(grid.bin AS INT) AS bin, {r('lo + (hi - lo) / 50 * grid.bin')} AS left_edge,
    {n('coalesce(c.n, 0)')} AS n, {r('coalesce(c.n, 0) / (total * ((hi - lo) / 50))')} AS density
    FROM grid LEFT JOIN c ON grid.name = c.name AND grid.grp = c.grp AND grid.bin = c.bin""",
)
ORACLE["nth_of_class"] = with_(
    SCORED
    + ", k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY flow_id) AS rn FROM scored "
    + "WHERE label IN ('Normal Traffic', 'Blackhole Attack', 'Wormhole Attack'))",
    "SELECT flow_id, label, "
    + ", ".join(f"{r(f'{g}_distance')} AS {g}_distance" for g in GROUPS)
    + ", predicted FROM k WHERE rn = 101",
)

# --- evaluation ------------------------------------------------------------------


def binary_sql(flag: str, source: str = "det") -> str:
    """One row of counts and metrics of a flag against 'is an attack'."""
    return f"""SELECT tn, fp, fn, tp, {safe('tp + tn', 'tp + tn + fp + fn')} AS accuracy, p AS precision, q AS recall,
      {safe('2 * p * q', 'p + q')} AS f1_score, {safe('fp * 100', 'fp + tn')} AS fpr_pct, {safe('tp * 100', 'tp + fn')} AS tpr_pct
    FROM (SELECT *, {safe('tp', 'tp + fp')} AS p, {safe('tp', 'tp + fn')} AS q FROM (
      SELECT count(*) FILTER (label = '{NORMAL}' AND NOT ({flag})) AS tn, count(*) FILTER (label = '{NORMAL}' AND ({flag})) AS fp,
             count(*) FILTER (label <> '{NORMAL}' AND NOT ({flag})) AS fn, count(*) FILTER (label <> '{NORMAL}' AND ({flag})) AS tp
      FROM {source}))"""


_ratios = ["accuracy", "precision", "recall", "f1_score", "fpr_pct", "tpr_pct"]
ORACLE["binary_confusion"] = with_(
    DETECTED,
    "SELECT tn, fp, fn, tp, "
    + ", ".join(f"{r(c)} AS {c}" for c in _ratios)
    + f" FROM ({binary_sql('anomaly_detected')})",
)
ORACLE["confusion_matrix"] = with_(
    SCORED,
    "SELECT label AS actual, "
    + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c.lower().replace(' ', '_')}" for c in CLASSES)
    + " FROM scored GROUP BY label",
)
ORACLE["confusion_pct"] = with_(
    SCORED + ", c AS (SELECT label AS actual, predicted, count(*) AS n FROM scored GROUP BY ALL)",
    f"SELECT actual, predicted, n, {r('n * 100.0 / sum(n) OVER (PARTITION BY actual)')} AS pct FROM c",
)
PRF = (
    SCORED
    + """, names AS (SELECT label FROM scored UNION SELECT predicted FROM scored),
cnt AS (SELECT names.label, (SELECT count(*) FROM scored s WHERE s.label = names.label) AS support,
  (SELECT count(*) FROM scored s WHERE s.predicted = names.label) AS claimed,
  (SELECT count(*) FROM scored s WHERE s.predicted = names.label AND s.label = names.label) AS tp FROM names),"""
    + f" prf0 AS (SELECT label, {safe('tp', 'claimed')} AS precision, {safe('tp', 'support')} AS recall, support FROM cnt),"
    + f" prf AS (SELECT *, {safe('2 * precision * recall', 'precision + recall')} AS f1_score FROM prf0)"
)
_prf = ["precision", "recall", "f1_score"]
ORACLE["per_class_prf"] = with_(
    PRF,
    "SELECT label, "
    + ", ".join(f"{r(c)} AS {c}" for c in _prf)
    + ", support, recall < 0.5 AS low_recall, "
    + ", ".join(f"{r(f'avg({c}) OVER ()')} AS macro_{c}" for c in _prf)
    + " FROM prf",
)
_acc = "sum(recall * support) / sum(support)"
ORACLE["classification_report"] = with_(
    PRF,
    unions(
        [
            "SELECT label, " + ", ".join(f"{r(c)} AS {c}" for c in _prf) + ", CAST(support AS DOUBLE) AS support FROM prf",
            f"SELECT 'accuracy', {r(_acc)}, {r(_acc)}, {r(_acc)}, {r(_acc)} FROM prf",
            "SELECT 'macro avg', " + ", ".join(r(f"avg({c})") for c in _prf) + ", CAST(sum(support) AS DOUBLE) FROM prf",
            "SELECT 'weighted avg', "
            + ", ".join(r(f"sum({c} * support) / sum(support)") for c in _prf)
            + ", CAST(sum(support) AS DOUBLE) FROM prf",
        ]
    ),
)
ORACLE["weighted_metrics"] = with_(
    PRF,
    f"SELECT {r(_acc)} AS accuracy, "
    + ", ".join(f"{r(f'sum({c} * support) / sum(support)')} AS {c}" for c in _prf)
    + f", {n('sum(support)')} AS support FROM prf",
)
ATTACKS = [c for c in CLASSES if c != NORMAL]


def z_auc_rows(scores: dict[str, str], targets: dict[str, str], source: str = "det") -> str:
    return unions(
        [
            f"SELECT '{s}' AS name, '{t}' AS target, {col} AS score, CASE WHEN {cond} THEN 1 ELSE 0 END AS pos FROM {source}"
            for s, col in scores.items()
            for t, cond in targets.items()
        ]
    )


IS_ATTACK = {"attack": f"label <> '{NORMAL}'"}
EACH_ATTACK = {c: f"label = '{c}'" for c in ATTACKS}
_auc_out = f"SELECT name, target, {r('auc')} AS auc, n_pos, n_neg FROM auc"
ORACLE["auc_overall"] = with_(f"{DETECTED}, {auc_ctes(z_auc_rows(Z_COLUMNS, IS_ATTACK))}", _auc_out)
ORACLE["auc_per_class"] = with_(f"{DETECTED}, {auc_ctes(z_auc_rows(Z_COLUMNS, EACH_ATTACK))}", _auc_out)

_w = [f"CAST({w} AS DOUBLE)" for w in PROBABILITY_WEIGHTS]
PROBS = (
    SCORED
    + ", weights AS (SELECT flow_id, label, predicted, "
    + ", ".join(f"{w} AS w{i}" for i, w in enumerate(_w))
    + " FROM scored), probs AS (SELECT flow_id, label, predicted, "
    + ", ".join(f"w{i} / (w0 + w1 + w2 + w3 + w4) AS p{i}" for i in range(5))
    + " FROM weights)"
)
_ovr = unions(
    [
        f"SELECT '{c}' AS name, '{c}' AS target, p{i} AS score, CASE WHEN label = '{c}' THEN 1 ELSE 0 END AS pos FROM probs"
        for i, c in enumerate(CLASSES)
    ]
)
ORACLE["auc_multiclass"] = with_(
    f"{PROBS}, {auc_ctes(_ovr)}",
    f"""SELECT target, {r('auc')} AS auc, n_pos AS support FROM auc
    UNION ALL SELECT 'macro', {r('avg(auc)')}, {n('sum(n_pos)')} FROM auc
    UNION ALL SELECT 'weighted', {r('sum(auc * n_pos) / sum(n_pos)')}, {n('sum(n_pos)')} FROM auc""",
)
ORACLE["roc_points"] = with_(
    f"""{DETECTED}, rr AS ({z_auc_rows({'overall': 'round(overall_zscore, 9)'}, EACH_ATTACK)}),
    g AS (SELECT target, score, sum(pos) AS p, sum(1 - pos) AS q FROM rr GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY target) AS np,
      sum(q) OVER (PARTITION BY target) AS nq FROM g
      WINDOW w AS (PARTITION BY target ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    f"""SELECT target, {r('score', 4)} AS threshold, {r('CAST(fp AS DOUBLE) / nq')} AS fpr, {r('CAST(tp AS DOUBLE) / np')} AS tpr FROM c
    UNION ALL SELECT DISTINCT target, NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c""",
)
_own = "CASE label " + " ".join(f"WHEN '{c}' THEN p{i}" for i, c in enumerate(CLASSES)) + " END"
_stats = "count(*) AS n, " + ", ".join(
    f"{r(f)} AS {name}"
    for f, name in [("avg(x)", "mean"), ("stddev_pop(x)", "std"), ("min(x)", "min"), ("max(x)", "max")]
)
ORACLE["prob_stats"] = with_(
    PROBS,
    f"""SELECT 'ALL' AS label, {_stats}, {r('quantile_cont(x, 0.5)')} AS median
    FROM (SELECT greatest(p0, p1, p2, p3, p4) AS x FROM probs)
    UNION ALL SELECT label, {_stats}, CAST(NULL AS DOUBLE) FROM (SELECT label, {_own} AS x FROM probs) GROUP BY label""",
)

# --- comparison of models --------------------------------------------------------

_plain_flags = {g: f"{g}_zscore > 3" for g in GROUPS}
_helped_flags = {g: f"{g}_zscore > 2 OR physical_zscore > 2" for g in GROUPS}
_score_rows = unions(
    [
        z_auc_rows({f"plain_{g}": f"{g}_zscore" for g in GROUPS}, IS_ATTACK),
        z_auc_rows({f"helped_{g}": f"{g}_zscore + physical_zscore" for g in GROUPS}, IS_ATTACK),
    ]
)


def metric_rows(kind: str, flags: dict[str, str]) -> str:
    return unions(
        [
            f"SELECT '{g}' AS model, accuracy, f1_score AS f1, (SELECT auc FROM auc WHERE name = '{kind}_{g}') AS auc "
            f"FROM ({binary_sql(flags[g])})"
            for g in GROUPS
        ]
    )


METRIC_CTES = (
    f"{DETECTED}, {auc_ctes(_score_rows)}, base AS ({metric_rows('plain', _plain_flags)}), "
    f"enh AS ({metric_rows('helped', _helped_flags)})"
)
_m = ["accuracy", "f1", "auc"]
DELTA = METRIC_CTES + ", delta AS (SELECT base.model, " + ", ".join(
    f"base.{m} AS baseline_{m}, enh.{m} AS enhanced_{m}, enh.{m} - base.{m} AS {m}_delta, "
    f"(enh.{m} - base.{m}) / nullif(base.{m}, 0) * 100 AS {m}_delta_pct"
    for m in _m
) + " FROM base JOIN enh USING (model))"
_delta_columns = [f"{side}_{m}" for side in ("baseline", "enhanced") for m in _m] + [
    f"{m}_{x}" for m in _m for x in ("delta", "delta_pct")
]
ORACLE["model_delta"] = with_(
    DELTA, "SELECT model, " + ", ".join(f"{r(c)} AS {c}" for c in _delta_columns) + " FROM delta"
)
ORACLE["mean_delta"] = with_(
    DELTA, "SELECT " + ", ".join(f"{r(f'avg({m}_delta_pct)')} AS {m}_delta_pct" for m in _m) + " FROM delta"
)
ORACLE["percent_table"] = with_(
    DELTA,
    f"""SELECT model, {r('baseline_accuracy * 100', 2)} AS baseline_pct, {r('enhanced_accuracy * 100', 2)} AS enhanced_pct,
    {r('accuracy_delta_pct', 2)} AS improvement_pct FROM delta""",
)
ORACLE["best_model"] = with_(
    METRIC_CTES, f"SELECT model, {r('accuracy')} AS accuracy FROM enh ORDER BY enh.accuracy DESC, model LIMIT 1"
)
_metric_select = f"{r('accuracy')} AS accuracy, {r('f1')} AS f1, {r('auc')} AS auc"
ORACLE["metrics_union"] = with_(
    METRIC_CTES,
    f"""SELECT model, {_metric_select}, CAST(0 AS DOUBLE) AS "CV_Mean", 'Baseline' AS type FROM base
    UNION ALL SELECT model, {_metric_select}, NULL, 'Enhanced' FROM enh""",
)
ORACLE["metrics_pivot"] = with_(
    METRIC_CTES,
    f"""SELECT model, {r('base.accuracy')} AS "Baseline", {r('enh.accuracy')} AS "Enhanced" FROM base JOIN enh USING (model)""",
)
ORACLE["ttest_delta"] = with_(
    DELTA,
    f"""SELECT count(*) AS n, {r('avg(accuracy_delta_pct)')} AS mean,
    {r('avg(accuracy_delta_pct) / nullif(stddev_samp(accuracy_delta_pct) / sqrt(count(*)), 0)')} AS t FROM delta""",
)
ORACLE["auc_improvement"] = with_(
    f"""{DETECTED}, {auc_ctes(z_auc_rows({'c2': 'c2_zscore', 'overall': 'overall_zscore'}, EACH_ATTACK))},
    pair AS (SELECT a.target, a.auc AS x, b.auc AS y, a.n_pos AS w FROM auc a JOIN auc b ON a.target = b.target AND a.name = 'c2' AND b.name = 'overall'),
    every AS (SELECT target, x, y FROM pair UNION ALL SELECT 'macro', avg(x), avg(y) FROM pair
      UNION ALL SELECT 'weighted', sum(x * w) / sum(w), sum(y * w) / sum(w) FROM pair)""",
    f"SELECT target, {r('x')} AS baseline_auc, {r('y')} AS enhanced_auc, {r('y - x')} AS improvement FROM every",
)
_imp_names = [*RAW_FEATURES, *DISTANCE_FEATURES]
IMPORTANCE = (
    ENCODED
    + ", scored AS ("
    + SCORED_SQL.format(flows="flows")
    + "), feats AS (SELECT encoded.*, "
    + ", ".join(f'{src} AS "{name}"' for name, src in DISTANCE_FEATURES.items())
    + " FROM encoded JOIN scored USING (flow_id)), "
    + f"cells AS ({cells(_imp_names, 'feats', 'label')}), "
    + "cm AS (SELECT feature, label, avg(value) AS m FROM cells GROUP BY feature, label), "
    + "sd AS (SELECT feature, stddev_pop(value) AS s FROM cells GROUP BY feature), "
    + "imp AS (SELECT feature, coalesce((max(m) - min(m)) / nullif(any_value(s), 0), 0) AS importance "
    + "FROM cm JOIN sd USING (feature) GROUP BY feature)"
)
_is_topo = "(contains(feature, 'C2_') OR contains(feature, 'Network_') OR contains(feature, 'Physical_'))"
_type = f"CASE WHEN {_is_topo} THEN 'topology' ELSE 'original' END"
ORACLE["importance_topk"] = with_(
    IMPORTANCE,
    f"SELECT feature, {r('importance')} AS importance, {_type} AS type FROM imp ORDER BY imp.importance DESC, feature LIMIT 20",
)
_facets = {
    "type": _type,
    "manifold": "CASE WHEN contains(feature, 'C2_') THEN 'C2' WHEN contains(feature, 'Network_') THEN 'Network' "
    "WHEN contains(feature, 'Physical_') THEN 'Physical' ELSE 'Original' END",
    "dimension": "CASE WHEN regexp_extract(feature, '_(H[0-2])_', 1) = '' THEN '-' ELSE regexp_extract(feature, '_(H[0-2])_', 1) END",
}
ORACLE["importance_by_group"] = with_(
    IMPORTANCE
    + ", tops AS (SELECT feature FROM imp ORDER BY round(importance, 9) DESC, feature LIMIT 20), facets AS ("
    + unions([f"SELECT '{f}' AS facet, {e} AS name, feature, importance FROM imp" for f, e in _facets.items()])
    + ")",
    f"""SELECT facet, name, count(*) AS n_features, {r('sum(importance)')} AS importance,
    {r('sum(importance) * 100.0 / (SELECT sum(importance) FROM imp)')} AS pct,
    count(*) FILTER (feature IN (SELECT feature FROM tops)) AS n_top FROM facets GROUP BY facet, name""",
)

# --- neighbourhoods and barcodes -------------------------------------------------


def distance_sql(a: str, b: str) -> str:
    return f"list_distance({a}, {b})"


# Scaled points, then k nearest neighbours by a plain self-join.
SCALED = (
    POINTS
    + """, comps AS (SELECT flow_id, manifold, split, c, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM raw_points),
fit AS (SELECT manifold, i, avg(x) AS m, stddev_pop(x) AS s FROM comps GROUP BY manifold, i),
points AS (SELECT flow_id, manifold, split, c, list((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS vec
  FROM comps JOIN fit USING (manifold, i) GROUP BY flow_id, manifold, split, c)"""
)


def knn_ctes(k: int) -> str:
    return f"""{SCALED}, pairs AS (SELECT a.split, a.manifold, a.flow_id, b.flow_id AS neighbor_id,
    {distance_sql('a.vec', 'b.vec')} AS d FROM points a JOIN points b ON a.split = b.split AND a.manifold = b.manifold),
    nn AS (SELECT *, row_number() OVER (PARTITION BY split, manifold, flow_id
      ORDER BY d, neighbor_id <> flow_id, neighbor_id) - 1 AS i FROM pairs),
    kn AS (SELECT * FROM nn WHERE i < {k})"""


_keys = ", ".join(KEYS)
ORACLE["knn_join"] = with_(
    knn_ctes(K_KNN), f"SELECT {_keys}, neighbor_id, i AS rank, {r('d')} AS distance FROM kn"
)
ORACLE["leak_check"] = with_(
    knn_ctes(K_KNN) + ", home AS (SELECT DISTINCT flow_id, split FROM points)",
    f"""SELECT count(*) AS neighbors, count(*) FILTER (h.split <> kn.split) AS leaks,
    count(*) FILTER (h.split IS NULL) AS unknown FROM kn LEFT JOIN home h ON kn.neighbor_id = h.flow_id""",
)
ORACLE["order_neighborhood"] = with_(
    FLOWS,
    f"""SELECT flow_id, count(*) OVER w AS n_rows, min(flow_id) OVER w AS first_id, max(flow_id) OVER w AS last_id,
    {r('avg(flow_duration_s) OVER w')} AS mean_value FROM flows
    WINDOW w AS (ORDER BY flow_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)""",
)
EDGES = (
    knn_ctes(K_HOOD)
    + f""", members AS (SELECT kn.split, kn.manifold, kn.flow_id, kn.i, p.vec FROM kn JOIN points p
  ON kn.neighbor_id = p.flow_id AND kn.manifold = p.manifold),
edges AS (SELECT a.split, a.manifold, a.flow_id, a.i, b.i AS j, {distance_sql('a.vec', 'b.vec')} AS length
  FROM members a JOIN members b ON a.split = b.split AND a.manifold = b.manifold AND a.flow_id = b.flow_id AND a.i < b.i)"""
)
ORACLE["rips_edges"] = with_(
    EDGES, f"SELECT {_keys}, i, j, {r('length')} AS length FROM edges WHERE length <= {EDGE}"
)
_same = "{0}.split = {1}.split AND {0}.manifold = {1}.manifold AND {0}.flow_id = {1}.flow_id"
ORACLE["rips_triangles"] = with_(
    EDGES + f", e AS (SELECT * FROM edges WHERE length <= {EDGE})",
    f"""SELECT e.split, e.manifold, e.flow_id, e.i, e.j, f.j AS l, {r('greatest(e.length, f.length, g.length)')} AS value
    FROM e JOIN e f ON {_same.format('e', 'f')} AND f.i = e.j
    JOIN e g ON {_same.format('e', 'g')} AND g.i = e.i AND g.j = f.j""",
)


def square(new: str, old: str) -> str:
    return f"""{new} AS (SELECT a.split, a.manifold, a.flow_id, a.i, b.j, min(greatest(a.w, b.w)) AS w
  FROM {old} a JOIN {old} b ON {_same.format('a', 'b')} AND a.j = b.i GROUP BY ALL)"""


# H0: minimax path lengths by repeated squaring, then the elder rule.
H0 = (
    EDGES
    + """, m0 AS (SELECT split, manifold, flow_id, i, j, length AS w FROM edges
  UNION ALL SELECT split, manifold, flow_id, j, i, length FROM edges
  UNION ALL SELECT split, manifold, flow_id, i, i, 0.0 FROM members), """
    + ", ".join([square("m1", "m0"), square("m2", "m1"), square("m3", "m2")])
    + """, h0_all AS (SELECT split, manifold, flow_id, i, least(min(w), 5.0) AS death FROM m3 WHERE j < i GROUP BY ALL
  UNION ALL SELECT split, manifold, flow_id, 0, 5.0 FROM members WHERE i = 0),
h0 AS (SELECT split, manifold, flow_id, 0 AS dim, CAST(0 AS DOUBLE) AS birth, CAST(death AS DOUBLE) AS death FROM h0_all WHERE death > 0)"""
)
ORACLE["h0_bars"] = with_(H0, f"SELECT {_keys}, dim, birth, {r('death')} AS death FROM h0")
ORACLE["bars_cap"] = with_(
    H0,
    f"""SELECT split, manifold, count(*) AS n_bars, count(*) FILTER (death = 5.0) AS n_capped,
    {r('sum(death - birth)', 4)} AS total_life FROM h0 GROUP BY split, manifold""",
)
# H1: columns of bit masks (edges over points, triangles over edges) in filtration order, reduced
# one addition at a time: a column whose lowest mark is new is paired with it, any other takes the
# earlier column with the same lowest mark.
H1 = (
    "RECURSIVE "
    + H0
    + f""", er AS (SELECT *, row_number() OVER (PARTITION BY {_keys} ORDER BY length, i, j) - 1 AS e FROM edges WHERE length <= 5.0),
tri AS (SELECT a.split, a.manifold, a.flow_id, greatest(a.length, b.length, c.length) AS value, greatest(a.e, b.e, c.e) AS top,
    (CAST(1 AS BIGINT) << a.e) | (CAST(1 AS BIGINT) << b.e) | (CAST(1 AS BIGINT) << c.e) AS mask
  FROM er a JOIN er b ON {_same.format('a', 'b')} AND b.i = a.j JOIN er c ON {_same.format('a', 'c')} AND c.i = a.i AND c.j = b.j),
cols AS (SELECT {_keys}, 1 AS over, list((CAST(1 AS BIGINT) << i) | (CAST(1 AS BIGINT) << j) ORDER BY e) AS masks, list(length ORDER BY e) AS vals
    FROM er GROUP BY {_keys}
  UNION ALL SELECT {_keys}, 2, list(mask ORDER BY top, mask), list(value ORDER BY top, mask) FROM tri GROUP BY {_keys}),
steps AS (SELECT {_keys}, over, 1 AS k, masks[1] AS col, CAST({[0] * (K_HOOD * (K_HOOD - 1) // 2)} AS BIGINT[]) AS pivots,
    -1 AS low, 0 AS paired FROM cols
  UNION ALL SELECT {_keys}, over,
    CASE WHEN free OR col = 0 THEN k + 1 ELSE k END,
    CASE WHEN free OR col = 0 THEN masks[k + 1] ELSE xor(col, pivots[top]) END,
    CASE WHEN free AND col <> 0 THEN list_concat(list_append(pivots[:top - 1], col), pivots[top + 1:]) ELSE pivots END,
    CASE WHEN free AND col <> 0 THEN top - 1 ELSE -1 END,
    CASE WHEN free AND col <> 0 THEN k ELSE 0 END
  FROM (SELECT *, pivots[top] = 0 AS free FROM (SELECT *, CASE WHEN col = 0 THEN 1 ELSE CAST(floor(log2(col)) AS INT) + 1 END AS top
    FROM steps JOIN cols USING ({_keys}, over) WHERE k <= len(masks)))),
paired AS (SELECT {_keys}, over, low, steps.paired AS k, vals[steps.paired] AS value FROM steps JOIN cols USING ({_keys}, over) WHERE low >= 0),
h1_all AS (SELECT {_keys}, er.length AS birth, p.value AS death FROM er JOIN paired p USING ({_keys}) WHERE p.over = 2 AND p.low = er.e
  UNION ALL SELECT {_keys}, er.length, 5.0 FROM er WHERE NOT EXISTS (SELECT 1 FROM paired p
    WHERE {_same.format('p', 'er')} AND (p.over = 2 AND p.low = er.e OR p.over = 1 AND p.k = er.e + 1))),
h1 AS (SELECT {_keys}, 1 AS dim, CAST(birth AS DOUBLE) AS birth, CAST(death AS DOUBLE) AS death FROM h1_all WHERE death > birth),
bars AS (SELECT * FROM h0 UNION ALL SELECT {_keys}, dim, birth, death FROM h1)"""
)
ORACLE["h1_bars"] = with_(H1, f"SELECT {_keys}, dim, {r('birth')} AS birth, {r('death')} AS death FROM h1")
ORACLE["bars_by_dim"] = with_(
    H1,
    f"""SELECT {_keys}, count(*) FILTER (dim = 0) AS n_h0, count(*) FILTER (dim = 1) AS n_h1,
    {r('max(death) FILTER (dim = 0)')} AS last_death FROM bars GROUP BY {_keys}""",
)
ORACLE["diagram_summary"] = with_(
    H1 + ", rows_ AS (SELECT split, manifold, count(*) AS k FROM points GROUP BY split, manifold)",
    f"""SELECT manifold, split, dim, count(birth) AS n_bars, {r('CAST(count(birth) AS DOUBLE) / any_value(k)')} AS mean_bars,
    {r('coalesce(avg(death - birth), 0)')} AS mean_life, {r('coalesce(max(death - birth), 0)')} AS max_life
    FROM (SELECT *, CAST(unnest(range(3)) AS INT) AS dim FROM rows_) LEFT JOIN bars USING (split, manifold, dim)
    GROUP BY manifold, split, dim""",
)
ORACLE["diagram_by_class"] = with_(
    H1 + f", per AS (SELECT {_keys}, count(*) FILTER (dim = 0) AS k, count(*) FILTER (dim = 1) AS k1 FROM bars GROUP BY {_keys})",
    f"""SELECT manifold, split, c, {r('avg(k)')} AS mean_h0_bars, {r('avg(k1)')} AS mean_h1_bars
    FROM per JOIN points USING (split, manifold, flow_id) GROUP BY manifold, split, c""",
)


def feature_columns() -> str:
    out = []
    for m in MANIFOLDS:
        for d in HOMOLOGY_DIMS:
            for s in BAR_STATISTICS:
                value = f"max(CASE WHEN manifold = '{m}' AND dim = {d} THEN {s} END)"
                out.append(f"{r(f'coalesce({value}, 0)', 5)} AS \"{m}_H{d}_{s}\"")
    return ", ".join(out)


ORACLE["bar_features"] = with_(
    H1
    + """, tot AS (SELECT split, manifold, flow_id, dim, sum(death - birth) AS t FROM bars GROUP BY ALL),
stats AS (SELECT manifold, flow_id, dim, CAST(count(*) AS DOUBLE) AS count, avg(death - birth) AS mean_persistence,
  stddev_pop(death - birth) AS std_persistence, max(death - birth) AS max_persistence, sum(death - birth) AS total_persistence,
  avg(birth) AS mean_birth, avg(death) AS mean_death,
  -sum((death - birth) / t * ln((death - birth) / t + 1e-10)) AS entropy
  FROM bars JOIN tot USING (split, manifold, flow_id, dim) GROUP BY manifold, flow_id, dim)""",
    f"SELECT flow_id, {feature_columns()} FROM stats GROUP BY flow_id",
)
ORACLE["example_bars"] = with_(
    H1
    + f""", labelled AS (SELECT vec_id AS flow_id, {CLASS_OF.replace('CASE c', 'CASE label % 5')} AS name FROM embeddings),
pick AS (SELECT flow_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY flow_id) AS rn FROM labelled
  WHERE name IN ('Normal Traffic', 'Blackhole Attack', 'Wormhole Attack')) WHERE rn = 21)""",
    f"""SELECT flow_id, manifold, dim, {r('birth')} AS birth, {r('death')} AS death,
    row_number() OVER (PARTITION BY flow_id, manifold ORDER BY dim, bars.birth, bars.death) - 1 AS position
    FROM bars WHERE flow_id IN (SELECT flow_id FROM pick)""",
)


# Distances of one-dimensional diagrams: bars from 0 are numbers, and an optimal matching never
# crosses, so it is an alignment of two sorted lists. d[j] is the least cost of the bars so far
# against the first j of the baseline.
def _base_square(new: str, old: str) -> str:
    return f"""{new} AS (SELECT a.manifold, a.i, b.j, min(greatest(a.w, b.w)) AS w
  FROM {old} a JOIN {old} b ON a.manifold = b.manifold AND a.j = b.i GROUP BY ALL)"""


BASELINE = (
    f""", base AS (SELECT manifold, vec, row_number() OVER (PARTITION BY manifold ORDER BY md5(concat('42:', CAST(flow_id AS STRING))), flow_id) AS i
  FROM points WHERE c = {CLASSES.index(NORMAL)} QUALIFY i <= {N_BASELINE}),
q0 AS (SELECT a.manifold, a.i, b.i AS j, list_distance(a.vec, b.vec) AS w FROM base a JOIN base b USING (manifold)), """
    + ", ".join(_base_square(f"q{i + 1}", f"q{i}") for i in range(6))
    + """, target AS (SELECT manifold, least(min(w), 5.0) AS death FROM q6 WHERE j < i GROUP BY manifold, i
  UNION ALL SELECT DISTINCT manifold, 5.0 FROM base)"""
)
ALIGNED = (
    H0
    + BASELINE
    + f""", y AS (SELECT manifold, death AS b, row_number() OVER (PARTITION BY manifold ORDER BY death DESC) AS j FROM target WHERE death > 0),
x AS (SELECT {_keys}, death AS a, row_number() OVER (PARTITION BY {_keys} ORDER BY death DESC) AS i FROM h0),
y0 AS (SELECT manifold, j, b, sum(b * b / 4) OVER (PARTITION BY manifold ORDER BY j) AS left_out FROM y
  UNION ALL SELECT DISTINCT manifold, 0, NULL, 0 FROM y),
d0 AS (SELECT {_keys}, j, b, left_out, left_out AS d FROM (SELECT DISTINCT {_keys} FROM h0) JOIN y0 USING (manifold))"""
    + "".join(
        f""", e{i} AS (SELECT p.*, a, least(d + a * a / 4, lag(d) OVER (PARTITION BY {_keys} ORDER BY j) + (a - b) ** 2) AS e
    FROM d{i - 1} p LEFT JOIN (SELECT * FROM x WHERE i = {i}) USING ({_keys})),
d{i} AS (SELECT {_keys}, j, b, left_out, CASE WHEN a IS NULL THEN d
    ELSE left_out + min(e - left_out) OVER (PARTITION BY {_keys} ORDER BY j) END AS d FROM e{i})"""
        for i in range(1, K_HOOD + 1)
    )
    + f""", apart AS (SELECT flow_id, manifold, c, sqrt(arg_max(d, j)) AS distance FROM d{K_HOOD} JOIN points USING ({_keys}) GROUP BY flow_id, manifold, c),
distances AS (SELECT flow_id, {CLASS_OF} AS label, """
    + ", ".join(f"max(distance) FILTER (manifold = '{m}') AS {m.lower()}_distance" for m in MANIFOLDS)
    + " FROM apart GROUP BY flow_id, c)"
)
ORACLE["distance_table"] = with_(
    ALIGNED, "SELECT flow_id, label, " + ", ".join(f"{r(f'{g}_distance')} AS {g}_distance" for g in GROUPS) + " FROM distances"
)
ORACLE["distance_detection"] = with_(
    ALIGNED + f", st AS (SELECT {SIGMA_STATS} FROM distances WHERE label = '{NORMAL}')",
    "SELECT flow_id, label, "
    + ", ".join(f"{r(f'({g}_distance - m_{g}) / s_{g}', 5)} AS {g}_zscore" for g in GROUPS)
    + ", "
    + " OR ".join(f"({g}_distance - m_{g}) / s_{g} > 3" for g in GROUPS)
    + " AS anomaly_detected FROM distances, st",
)
ORACLE["baseline_counts"] = with_(
    SCALED + BASELINE,
    """SELECT manifold, n AS n_samples, CAST(0 AS INT) AS dim, k AS n_bars FROM (SELECT manifold, count(*) AS n FROM base GROUP BY manifold)
    JOIN (SELECT manifold, count(*) AS k FROM target WHERE death > 0 GROUP BY manifold) USING (manifold)
    UNION ALL SELECT manifold, count(*), 2, 0 FROM base GROUP BY manifold""",
)


# --- models ---------------------------------------------------------------------

_sorted_classes = sorted(CLASSES)
_test_rows = "SELECT count(*) AS n FROM split WHERE split = 'test'"
ORACLE["logistic_optimality"] = f"""SELECT class, feature, true AS flat FROM (SELECT unnest({_sorted_classes}) AS class),
    (SELECT unnest({[*RAW_FEATURES, 'intercept']}) AS feature)"""
ORACLE["forest_scoring"] = with_(
    SPLIT, f"SELECT n AS n_rows, n AS n_sum_one, n AS n_likeliest, {n(str(len(CLASSES)))} AS n_classes FROM ({_test_rows})"
)
ORACLE["svm_scoring"] = with_(
    SPLIT,
    f"""SELECT n AS n_rows, n AS n_sum_one, n AS n_likeliest, {n(str(len(CLASSES)))} AS n_classes,
    (SELECT count(*) FROM (SELECT DISTINCT label FROM split) a JOIN (SELECT DISTINCT label FROM split) b ON a.label < b.label) AS n_pairs
    FROM ({_test_rows})""",
)
ORACLE["logistic_scoring"] = with_(
    SPLIT, f"SELECT n AS n_rows, n AS n_sum_one, n AS n_likeliest, {n(str(len(CLASSES)))} AS n_classes, n AS n_same FROM ({_test_rows})"
)
ORACLE["forest_importance"] = f"SELECT unnest({RAW_FEATURES}) AS feature, true AS valid, true AS whole"
ORACLE["model_catalogue"] = with_(
    SPLIT,
    f"""SELECT unnest(['Logistic Regression', 'Random Forest']) AS model, CAST({len(RAW_FEATURES)} AS INT) AS n_features,
    CAST(count(DISTINCT label) AS INT) AS n_classes, false AS untuned FROM split WHERE split = 'train'""",
)
ORACLE["class_order"] = with_(
    SPLIT, "SELECT row_number() OVER (ORDER BY label) - 1 AS position, label FROM (SELECT DISTINCT label FROM split WHERE split = 'train')"
)
ORACLE["isolation_forest"] = with_(
    FLOWS,
    """SELECT CAST(100 AS BIGINT) AS n_trees, least(256, count(*)) AS least, least(256, count(*)) AS most, count(*) AS n_scored,
    count(*) AS n_valid FROM flows""",
)
ORACLE["aligned_features"] = with_(
    SPLIT + ", " + ENCODED.removeprefix(FLOWS + ", "),
    f"SELECT e.flow_id, e.label, {_raw_rounded}, split FROM encoded e JOIN split USING (flow_id)",
)
ORACLE["throughput"] = with_(
    FLOWS,
    f"""SELECT count(*) AS n_samples, CAST(3180 AS DOUBLE) AS seconds, {r('count(*) / 3180.0')} AS per_second,
    CAST(2 AS DOUBLE) AS size_ratio FROM flows""",
)
ORACLE["approx_distinct"] = with_(
    f"{ENCODED}, cells AS ({cells(RAW_FEATURES, 'encoded', 'label')})",
    "SELECT feature, label, count(DISTINCT value) AS exact, true AS within FROM cells WHERE value IS NOT NULL GROUP BY feature, label",
)
_vectors = {m: ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) for m, columns in MANIFOLD_FEATURES.items()}
ORACLE["knn_flows"] = with_(
    SPLIT
    + ", "
    + ENCODED.removeprefix(FLOWS + ", ")
    + ", raw_points AS ("
    + unions([f"SELECT flow_id, '{m}' AS manifold, [{v}] AS vec FROM encoded" for m, v in _vectors.items()])
    + """), comps AS (SELECT flow_id, manifold, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM raw_points),
fit AS (SELECT manifold, i, avg(x) AS m, stddev_pop(x) AS s FROM comps GROUP BY manifold, i),
points AS (SELECT flow_id, manifold, split, list((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS vec
  FROM comps JOIN fit USING (manifold, i) JOIN split USING (flow_id) GROUP BY flow_id, manifold, split),
near AS (SELECT a.split, a.manifold, a.flow_id, min(list_distance(a.vec, b.vec), 100) AS d
  FROM points a JOIN points b ON a.split = b.split AND a.manifold = b.manifold GROUP BY ALL)""",
    f"SELECT split, manifold, flow_id, len(d) AS n, {r('list_max(d)', 4)} AS farthest, {r('list_sum(d)', 4)} AS total FROM near",
)
