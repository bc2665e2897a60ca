"""Independent DuckDB SQL for the registered queries, written by brute force over whole tables.

Common table expressions are kept in one registry; :func:`sql` adds the ones a statement needs.
"""

from __future__ import annotations

import re

from tidewatch.functions import columns as H
from tidewatch.functions.columns import ERF_A, ERF_P
from tidewatch.operators.alerts import DIRECTIONS, LADDERS, RECOMMENDATIONS, REVIEW_ADVICE
from tidewatch.operators.controller import ACTIONS, MESSAGES
from tidewatch.plans import model as M

FEATS = M.FEATURES


def lit(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def bits(key: str, salt: int) -> str:
    m, (a, b), (s, t) = H.HASH_MODULUS, H.HASH_MULTIPLIERS, H.HASH_SHIFTS
    k = f"((({key}) % {m}) + ((({key}) >> 31) % {m}) * {H.HASH_FOLD}) % {m}"
    x = f"((({k}) * {a} + {H.HASH_INCREMENT + salt * H.HASH_SALT_STRIDE}) % {m})"
    x = f"((xor({x}, {x} >> {s}) * {b}) % {m})"
    return f"xor({x}, {x} >> {t})"


def uniform(key: str, salt: int) -> str:
    return f"(({bits(key, salt)} + 1) / {H.HASH_MODULUS}.0::DOUBLE)"


def normal(key: str, salt: int) -> str:
    return f"(sqrt({lit(-2)} * ln({uniform(key, salt)})) * cos({lit(6.283185307179586)} * {uniform(key, salt + 2)}))"


def ladder_sql(x: str, edges, labels) -> str:
    whens = " ".join(f"WHEN {x} < {lit(e)} THEN '{v}'" for e, v in zip(edges, labels))
    return f"CASE {whens} ELSE '{labels[-1]}' END"


def phase_sql(i: str, n: str) -> str:
    return (
        f"CASE WHEN {n} <= 0 OR {i} < floor({n} * {lit(0.4)}) THEN 'phase1' "
        f"WHEN {i} < floor({n} * {lit(0.65)}) THEN 'phase2' ELSE 'phase3' END"
    )


def two_sided(z: str) -> str:
    x = f"(abs({z}) / {lit(2 ** 0.5)})"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {lit(ERF_P)} * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {lit(a)}) * {t})"
    return f"least(greatest({poly} * exp(-({x}) * ({x})), 0.0), 1.0)"


def safe(num: str, den: str, default: str = "0.0") -> str:
    return f"CASE WHEN ({den}) <> 0 THEN ({num})::DOUBLE / ({den}) ELSE {default} END"


def _moved(col: str) -> str:
    out = f"{col}"
    for i, s in enumerate(M.SHIFTS):
        if col in s.columns(FEATS):
            moved = f"({out}) * {lit(s.multiply)} + {lit(s.add)}"
            if s.noise_std:
                moved = f"({moved}) + {normal('row_idx', 10 * (i + 1))} * {lit(s.noise_std)}"
            out = f"CASE WHEN phase = '{s.phase}' THEN {moved} ELSE {out} END"
    return f"round({out}, 6)"


def _phi(f: str) -> str:
    return f"{lit(M.WEIGHT[f])} * (({f} - {lit(M.CENTER[f])}) / {lit(M.SCALE[f])})"


MARGIN = " + ".join([lit(M.INTERCEPT)] + [_phi(f) for f in FEATS])
SHIFTED_Y = (
    f"(CASE WHEN phase = '{M.FLIP.phase}' AND {uniform('row_idx', 7)} <= {lit(M.FLIP.rate)} THEN 1 - y ELSE y END)::INTEGER"
)


def unpivot(src: str, keys: str, cols, value: str = "value") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, {c}::DOUBLE AS {value} FROM {src}" for c in cols)


CTE: dict[str, str] = {}
CTE["order_rows"] = """
SELECT l_orderkey AS entity_id, arrival, qty_mean, qty_std, price_mean, disc_mean, tax_mean, n_lines,
       o_totalprice AS total_price, c_acctbal AS acct_bal, y, c_mktsegment AS grp, o_orderpriority AS prio,
       (o_custkey % 2)::INTEGER AS gender, (18 + o_custkey % 80)::DOUBLE AS age
FROM (SELECT l_orderkey, round(avg(l_quantity), 6) AS qty_mean, round(stddev_samp(l_quantity), 6) AS qty_std,
             round(avg(l_extendedprice), 6) AS price_mean, round(avg(l_discount), 6) AS disc_mean,
             round(avg(l_tax), 6) AS tax_mean, count(*)::DOUBLE AS n_lines,
             max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS y, min(l_shipdate) AS arrival
      FROM lineitem GROUP BY l_orderkey) l
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"""
CTE["cohort"] = f"""
SELECT *, {phase_sql('row_idx', 'n_all')} AS phase FROM (
  SELECT *, row_number() OVER (ORDER BY arrival, entity_id) - 1 AS row_idx, count(*) OVER () AS n_all FROM order_rows)"""
CTE["moved"] = (
    "SELECT row_idx, entity_id, arrival, phase, grp, prio, gender, age, "
    + ", ".join(f"{_moved(f)} AS {f}" for f in FEATS)
    + f", {SHIFTED_Y} AS y FROM cohort"
)
CTE["meds"] = "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}" for f in FEATS) + " FROM cohort WHERE phase = 'phase1'"
CTE["filled"] = (
    "SELECT row_idx, entity_id, arrival, phase, grp, prio, gender, age, y, "
    + ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATS)
    + " FROM moved CROSS JOIN meds"
)
CTE["stream"] = f"SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({MARGIN}))), 6) AS p FROM filled"
CTE["ref"] = "SELECT * FROM stream WHERE phase = 'phase1'"
CTE["win"] = f"""
SELECT stream.*, w.window_id FROM stream, LATERAL (SELECT unnest(generate_series(
  greatest(0, ceil((row_idx - {M.WINDOW_SIZE - 1}) / {M.WINDOW_STEP}.0)::BIGINT),
  floor(row_idx / {M.WINDOW_STEP}.0)::BIGINT)) AS window_id) w"""
CTE["ref_long"] = unpivot("ref", "", FEATS + ["p"])
CTE["win_long"] = unpivot("win", "window_id", FEATS + ["p"])
CTE["batch"] = "SELECT *, prio AS batch_id FROM stream WHERE phase <> 'phase1'"
CTE["batch_long"] = unpivot("batch", "batch_id", FEATS + ["p"])


def ecdf(cur: str, key: str) -> str:
    return f"""
SELECT {key}, feature, value, sum(a) OVER w AS ca, sum(b) OVER w AS cb,
       sum(a) OVER (PARTITION BY {key}, feature) AS na, sum(b) OVER (PARTITION BY {key}, feature) AS nb,
       lead(value) OVER (PARTITION BY {key}, feature ORDER BY value) AS nxt
FROM (SELECT {key}, feature, value, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (
        SELECT k.{key}, r.feature, r.value, r.n AS a, 0 AS b
        FROM (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY ALL) r
        JOIN (SELECT DISTINCT {key}, feature FROM {cur}) k ON k.feature = r.feature
        UNION ALL SELECT {key}, feature, value, 0, count(*) FROM {cur} GROUP BY ALL) GROUP BY ALL)
WINDOW w AS (PARTITION BY {key}, feature ORDER BY value)"""


def ks(src: str, key: str) -> str:
    lam2 = "(d * d * (na * nb) / (na + nb))"
    return f"""
SELECT {key}, feature, na::BIGINT AS n_ref, nb::BIGINT AS n_cur, d AS statistic,
       CASE WHEN {lam2} < 0.04 THEN 1.0::DOUBLE ELSE least(greatest(
         (SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp({lit(-2)} * k * k * {lam2})) FROM range(1, 101) t(k)),
         0.0), 1.0) END AS p_value
FROM (SELECT {key}, feature, max(abs(ca / na - cb / nb)) AS d, any_value(na) AS na, any_value(nb) AS nb FROM {src} GROUP BY ALL)"""


def psi_counts(cur: str, key: str) -> str:
    return f"""
SELECT {key}, feature, bin, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, any_value(lo) AS lo, any_value(hi) AS hi FROM (
  SELECT {key}, feature, a, b, lo, hi, {' + '.join(f'(value >= lo + {lit(k)} * ((hi - lo) / {lit(10)}))::INTEGER' for k in range(1, 10))} AS bin
  FROM (SELECT *, min(value) OVER (PARTITION BY {key}, feature) AS lo, max(value) OVER (PARTITION BY {key}, feature) AS hi FROM (
    SELECT k.{key}, r.feature, r.value, r.n AS a, 0 AS b FROM (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY ALL) r
      JOIN (SELECT DISTINCT {key}, feature FROM {cur}) k ON k.feature = r.feature
    UNION ALL SELECT {key}, feature, value, 0, count(*) FROM {cur} GROUP BY ALL))) GROUP BY {key}, feature, bin
UNION ALL SELECT {key}, feature, bin, 0, 0, NULL, NULL FROM (SELECT DISTINCT {key}, feature FROM {cur}), range(0, 10) g(bin)"""


def psi(counts: str, key: str, variant: str) -> str:
    eps = lit({"detector": 1e-6, "index": 1e-10, "additive": 1e-6}[variant])
    if variant == "additive":
        r, c = f"(a / na + {eps})", f"(b / nb + {eps})"
    else:
        r, c = f"((a + {eps}) / (na + 10 * {eps}))", f"((b + {eps}) / (nb + 10 * {eps}))"
    total = f"sum(({c} - {r}) * ln({c} / {r}))"
    if variant == "index":
        total = f"greatest({total}, 0.0)"
    return f"""
SELECT {key}, feature, CASE WHEN max(hi) - min(lo) > 0 THEN {total} ELSE 0.0 END AS psi FROM (
  SELECT {key}, feature, bin, sum(a) AS a, sum(b) AS b, max(hi) AS hi, min(lo) AS lo,
         sum(sum(a)) OVER (PARTITION BY {key}, feature) AS na, sum(sum(b)) OVER (PARTITION BY {key}, feature) AS nb
  FROM {counts} GROUP BY {key}, feature, bin) GROUP BY {key}, feature"""


def w1(src: str, key: str) -> str:
    return f"""SELECT {key}, feature, coalesce(sum(abs(ca / na - cb / nb) * (nxt - value)), 0.0) AS w1 FROM {src} GROUP BY ALL"""


CTE["win_ecdf"] = ecdf("win_long", "window_id")
CTE["batch_ecdf"] = ecdf("batch_long", "batch_id")
CTE["mon_long"] = "SELECT 0 AS k, feature, value FROM batch_long WHERE feature <> 'p'"
CTE["mon_ecdf"] = ecdf("mon_long", "k")
CTE["mon_bins"] = psi_counts("mon_long", "k")
CTE["ks_all"] = ks("win_ecdf", "window_id")
CTE["ks"] = "SELECT * FROM ks_all WHERE feature <> 'p'"
CTE["batch_ks"] = "SELECT * FROM (" + ks("batch_ecdf", "batch_id") + ") WHERE feature <> 'p'"
CTE["win_bins"] = psi_counts("win_long", "window_id")
CTE["batch_bins"] = psi_counts("batch_long", "batch_id")
for _v in ("detector", "index", "additive"):
    CTE[f"psi_{_v}"] = f"SELECT * FROM ({psi('win_bins', 'window_id', _v)}) WHERE feature <> 'p'"
CTE["batch_psi"] = f"SELECT * FROM ({psi('batch_bins', 'batch_id', 'additive')}) WHERE feature <> 'p'"
CTE["w1_p"] = f"SELECT * FROM ({w1('win_ecdf', 'window_id')}) WHERE feature = 'p'"
CTE["batch_w1"] = f"SELECT * FROM ({w1('batch_ecdf', 'batch_id')}) WHERE feature = 'p'"


def phi_long(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{f}' AS feature, round({_phi(f)}, 9) AS phi FROM {src}" for f in FEATS)


def fp(src: str, key: str | None) -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""
SELECT *, row_number() OVER ({part}ORDER BY mean_abs DESC, feature)::INTEGER AS rank FROM (
  SELECT {k}feature, round(avg(abs(phi)), 9) AS mean_abs, round(avg(phi), 9) AS mean, round(stddev_pop(phi), 9) AS std,
         count(phi) AS n FROM {src} GROUP BY ALL)"""


CTE["phi_ref"] = phi_long("ref", "")
CTE["phi_win"] = phi_long("win", "window_id")
CTE["phi_batch"] = phi_long("batch", "batch_id")
CTE["fp_ref"] = fp("phi_ref", None)
CTE["fp_win"] = fp("phi_win", "window_id")
CTE["fp_batch"] = fp("phi_batch", "batch_id")

_MOM = "count(*)::DOUBLE AS n, avg(phi) AS mu, stddev_samp(phi) AS sd, stddev_pop(phi) AS sp, min(phi) AS lo, max(phi) AS hi"
CTE["kl_stats"] = f"""
SELECT *, lo - mg AS g0, (hi + mg) - (lo - mg) AS gw FROM (
 SELECT c.window_id, c.feature, r.lo AS rlo, r.hi AS rhi, r.n AS rn, c.n AS cn, r.sp AS rsp, c.sp AS csp, r.mu AS rmu, c.mu AS cmu,
        r.sd * pow(r.n, -0.2) AS rh, c.sd * pow(c.n, -0.2) AS ch, least(r.lo, c.lo) AS lo, greatest(r.hi, c.hi) AS hi,
        {lit(0.1)} * (greatest(r.hi, c.hi) - least(r.lo, c.lo) + {lit(1e-10)}) AS mg
 FROM (SELECT window_id, feature, {_MOM} FROM phi_win GROUP BY ALL) c
 JOIN (SELECT feature, {_MOM} FROM phi_ref GROUP BY ALL) r ON r.feature = c.feature)"""
CTE["kl_ref_cells"] = "SELECT feature, phi AS x, count(*) AS w FROM phi_ref GROUP BY ALL"
CTE["kl_win_cells"] = "SELECT window_id, feature, phi AS x, count(*) AS w FROM phi_win GROUP BY ALL"


def density(cells: str, using: str, hh: str, n: str) -> str:
    z = f"((g0 + k * gw / {lit(99)} - x) / {hh})"
    return f"""
SELECT window_id, feature, k, greatest(sum(w * exp({lit(-0.5)} * {z} * {z})) / (any_value({n}) * any_value({hh}) * {lit(2.5066282746310002)}), {lit(1e-10)}) AS d
FROM (SELECT window_id, feature, g0, gw, {hh}, {n} FROM kl_stats) s JOIN {cells} USING ({using}), range(0, 100) t(k) GROUP BY ALL"""


CTE["kl_p"] = density("kl_ref_cells", "feature", "rh", "rn")
CTE["kl_q"] = density("kl_win_cells", "window_id, feature", "ch", "cn")
CTE["kl"] = """
SELECT window_id, feature, CASE WHEN rn < 5 OR cn < 5 THEN 0.0
   WHEN rsp < 1e-10 AND csp < 1e-10 AND abs(rmu - cmu) < 1e-10 THEN 0.0 WHEN rsp < 1e-10 AND csp < 1e-10 THEN 10.0
   WHEN rsp < 1e-10 OR csp < 1e-10 THEN 5.0 ELSE greatest(kl, 0.0) END AS kl
FROM kl_stats JOIN (SELECT window_id, feature, sum(p / sp * ln((p / sp) / (q / sq))) AS kl FROM (
  SELECT window_id, feature, p.d AS p, q.d AS q, sum(p.d) OVER w AS sp, sum(q.d) OVER w AS sq
  FROM kl_p p JOIN kl_q q USING (window_id, feature, k) WINDOW w AS (PARTITION BY window_id, feature)) GROUP BY ALL)
USING (window_id, feature)"""


def comps(cur: str, key: str, kl: str, flip: str, extra: str = "") -> str:
    return f"""
SELECT c.{key}, c.feature, {kl} AS kl, abs(c.rank - r.rank)::DOUBLE / count(*) OVER (PARTITION BY c.{key}) AS rank_shift,
       CASE WHEN {flip} THEN 1.0 ELSE 0.0 END AS direction_flip, r.rank AS ref_rank, c.rank AS new_rank,
       r.mean AS ref_mean, c.mean AS new_mean, r.mean_abs AS ref_abs, c.mean_abs AS new_abs
FROM {cur} c JOIN fp_ref r USING (feature) {extra}"""


CTE["comps"] = comps(
    "fp_win", "window_id", "kl.kl", "r.mean > 0 AND c.mean < 0 OR r.mean < 0 AND c.mean > 0", "JOIN kl USING (window_id, feature)"
)
CTE["sadi"] = f"SELECT *, {lit(0.5)} * kl + {lit(0.3)} * rank_shift + {lit(0.2)} * direction_flip AS sadi FROM comps"
CTE["phi_before"] = "SELECT window_id + 1 AS window_id, feature, phi FROM phi_win"
CTE["before_stats"] = f"""
SELECT *, lo - mg AS g0, (hi + mg) - (lo - mg) AS gw FROM (
 SELECT c.window_id, c.feature, r.n AS rn, c.n AS cn, r.sp AS rsp, c.sp AS csp, r.mu AS rmu, c.mu AS cmu,
        r.sd * pow(r.n, -0.2) AS rh, c.sd * pow(c.n, -0.2) AS ch, least(r.lo, c.lo) AS lo, greatest(r.hi, c.hi) AS hi,
        {lit(0.1)} * (greatest(r.hi, c.hi) - least(r.lo, c.lo) + {lit(1e-10)}) AS mg
 FROM (SELECT window_id, feature, {_MOM} FROM phi_win GROUP BY ALL) c
 JOIN (SELECT window_id, feature, {_MOM} FROM phi_before GROUP BY ALL) r USING (window_id, feature))"""
CTE["before_cells"] = "SELECT window_id, feature, phi AS x, count(*) AS w FROM phi_before GROUP BY ALL"
CTE["before_p"] = density("before_cells", "window_id, feature", "rh", "rn").replace("FROM kl_stats", "FROM before_stats")
CTE["before_q"] = density("kl_win_cells", "window_id, feature", "ch", "cn").replace("FROM kl_stats", "FROM before_stats")
CTE["before_kl"] = CTE["kl"].replace("kl_stats", "before_stats").replace("FROM kl_p", "FROM before_p").replace("JOIN kl_q", "JOIN before_q")
CTE["fp_before"] = "SELECT * REPLACE (window_id + 1 AS window_id) FROM fp_win"
CTE["sadi_previous"] = f"SELECT *, {lit(0.5)} * kl + {lit(0.3)} * rank_shift + {lit(0.2)} * direction_flip AS sadi FROM (" + comps(
    "fp_win", "window_id", "before_kl.kl", "r.mean > 0 AND c.mean < 0 OR r.mean < 0 AND c.mean > 0", "JOIN before_kl USING (window_id, feature)"
).replace("JOIN fp_ref r USING (feature)", "JOIN fp_before r USING (window_id, feature)") + ")"
_KLB = f"least(abs(c.mean_abs - r.mean_abs) / greatest(r.mean_abs, {lit(1e-3)}), {lit(2)})"
CTE["sadi_batch"] = (
    f"SELECT *, {lit(0.5)} * kl + {lit(0.3)} * rank_shift + {lit(0.2)} * direction_flip AS sadi FROM ("
    + comps("fp_batch", "batch_id", _KLB, "(r.mean > 0) <> (c.mean > 0) AND abs(r.mean) > 1e-3")
    + ")"
)
CTE["d_total"] = f"""
SELECT window_id, d_shap, d_feature, d_confidence,
       {lit(0.5)} * d_shap + {lit(0.3)} * d_feature + {lit(0.2)} * d_confidence AS d_total
FROM (SELECT window_id, avg(sadi) AS d_shap FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY sadi DESC, feature) AS rk FROM sadi)
      WHERE rk <= 10 GROUP BY 1)
JOIN (SELECT window_id, avg(psi) AS d_feature FROM psi_index GROUP BY 1) USING (window_id)
JOIN (SELECT window_id, w1 AS d_confidence FROM w1_p) USING (window_id)"""


def ap(src: str, keys: str, score: str, label: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
SELECT {k}threshold, n_at, pos_at, sum(n_at) OVER w AS n_pred, sum(pos_at) OVER w AS tp,
       sum(n_at) OVER ({part}) AS n, sum(pos_at) OVER ({part}) AS n_pos
FROM (SELECT {k}{score} AS threshold, count(*)::DOUBLE AS n_at, sum({label})::DOUBLE AS pos_at FROM {src} GROUP BY ALL)
WINDOW w AS ({part} ORDER BY threshold DESC)"""


AP = "coalesce(sum(pos_at / nullif(n_pos, 0) * (tp / n_pred)), 0.0)"
AUROC = safe(
    "sum(pos_at * ((n - n_pos) - (n_pred - tp) + (n_at - pos_at) / 2))", "max(n_pos * (n - n_pos))", "0.5"
)
_P, _R = "(tp / n_pred)", f"({safe('tp', 'n_pos')})"
F1 = f"round({safe(f'2 * {_P} * {_R}', f'{_P} + {_R}')}, 12)"
CTE["base_curve"] = ap("ref", "", "p", "y")
CTE["base"] = f"SELECT CASE WHEN max(n) < 10 THEN 0.5 WHEN max(n_pos) IN (0, max(n)) THEN 0.0 ELSE {AP} END AS baseline_auprc FROM base_curve"
CTE["w_phase"] = """
SELECT window_id, arg_max(phase, (c, -f)) AS true_phase FROM (
  SELECT window_id, phase, count(*) AS c, min(row_idx) AS f FROM win GROUP BY ALL) GROUP BY 1"""


def age_band(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 AND {x} <= 40 THEN 'young_0-40' WHEN {x} > 40 AND {x} <= 65 THEN 'middle_40-65' "
        f"WHEN {x} > 65 AND {x} <= 200 THEN 'elderly_65+' ELSE 'unknown' END"
    )


def fair(src: str, key: str, grp: str, pred: str, label: str = "y") -> str:
    return f"""
SELECT {key}, count(*) AS n_groups, round(max(sel) - min(sel), 4) AS dpd, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 4) AS eod
FROM (SELECT {key}, g, avg(pr) AS sel, {safe('sum(pr * yy)', 'sum(yy)')} AS tpr, {safe('sum(pr * (1 - yy))', 'sum(1 - yy)')} AS fpr
      FROM (SELECT {key}, {grp} AS g, ({pred})::INTEGER::DOUBLE AS pr, {label}::DOUBLE AS yy FROM {src}) GROUP BY ALL) GROUP BY {key}"""


CTE["fair"] = fair("win", "window_id", age_band("age"), "p >= 0.5")


def top_list(src: str, score: str, n: int = 5, key: str = "window_id") -> str:
    return f"""SELECT {key}, list(feature ORDER BY rk) AS feats FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, feature) AS rk FROM {src}) WHERE rk <= {n} GROUP BY 1"""


LEVEL = (
    f"CASE WHEN d_total < {lit(0.3)} AND risk < {lit(0.05)} THEN 0 WHEN d_total < {lit(0.3 * 1.3)} OR risk < {lit(0.05)} THEN 1 "
    f"WHEN d_total < {lit(0.3 * 1.7)} OR risk < {lit(0.1)} THEN 2 WHEN d_total < {lit(0.3 * 2.2)} THEN 3 ELSE 4 END"
)


def case_list(x: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def clip(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least(greatest({x}, {lit(lo)}), {lit(hi)})"


CTE["split"] = f"""
SELECT row_idx, y, CASE WHEN rn <= floor(n * {lit(0.2)}) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT row_idx, y, row_number() OVER (PARTITION BY y ORDER BY {bits('row_idx', 42)}, row_idx) AS rn, count(*) OVER (PARTITION BY y) AS n FROM ref)"""


# ---- domain classifiers: Newton steps of a penalised logistic fit, one statement per step ------------------------


def _solved(source: str, p: int, keys: str, beta: list[str]) -> str:
    """SQL of beta + A^-1 g for a row of sums h{i}_{j} (j >= i) and g{i}: elimination, then back-substitution."""
    table = source
    for i in range(p - 1):
        rest = [f"h{j}_{k} - h{i}_{j} * h{i}_{k} / h{i}_{i} AS h{j}_{k}" for j in range(i + 1, p) for k in range(j, p)]
        rest += [f"g{j} - h{i}_{j} * g{i} / h{i}_{i} AS g{j}" for j in range(i + 1, p)]
        kept = [f"h{a}_{k}" for a in range(i + 1) for k in range(a, p)] + [f"g{a}" for a in range(i + 1)]
        table = f"(SELECT {keys}, {', '.join(beta + kept + rest)} FROM {table})"
    for i in reversed(range(p)):
        known = " - ".join([f"g{i}", *[f"h{i}_{k} * d{k}" for k in range(i + 1, p)]])
        table = f"(SELECT *, ({known}) / h{i}_{i} AS d{i} FROM {table})"
    return f"SELECT {keys}, {', '.join(f'{b} + d{i} AS {b}' for i, b in enumerate(beta))} FROM {table}"


NEWTON_STEPS = 12


def domain_ctes(prefix: str, train: str) -> None:
    """Register {prefix}_beta: the fits of the models that ``train`` (window_id, m, dom, x1..) lists rows for."""
    p = len(FEATS) + 1
    x = ["1.0", *[f"x{i}" for i in range(1, p)]]
    beta = [f"b{i}" for i in range(p)]
    CTE[f"{prefix}_train"] = f"""
    SELECT *, n / (2.0::DOUBLE * CASE WHEN dom = 1 THEN n1 ELSE n - n1 END) AS w FROM (
      SELECT *, count(*) OVER (PARTITION BY window_id, m) AS n, sum(dom) OVER (PARTITION BY window_id, m) AS n1 FROM ({train}))"""
    CTE[f"{prefix}_step0"] = f"SELECT DISTINCT window_id, m, {', '.join(f'0.0::DOUBLE AS {b}' for b in beta)} FROM {prefix}_train"
    for step in range(NEWTON_STEPS):
        eta = " + ".join(f"{b} * {c}" for b, c in zip(beta, x))
        pen = [lit(1e-9) if i == 0 else lit(1.0) for i in range(p)]
        sums = [f"sum(c * {x[i]} * {x[j]})" + (f" + {pen[i]}" if i == j else "") + f" AS h{i}_{j}" for i in range(p) for j in range(i, p)]
        sums += [f"sum(e * {x[i]}) - {pen[i]} * any_value(b{i}) AS g{i}" for i in range(p)]
        rows = f"SELECT *, w * q * (1 - q) AS c, w * (dom - q) AS e FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS q FROM {prefix}_train JOIN {prefix}_step{step} USING (window_id, m))"
        inner = f"(SELECT window_id, m, {', '.join(f'any_value({b}) AS {b}' for b in beta)}, {', '.join(sums)} FROM ({rows}) GROUP BY window_id, m)"
        CTE[f"{prefix}_step{step + 1}"] = _solved(inner, p, "window_id, m", beta)


_X = [f"({f} - avg({f}) OVER w) / CASE WHEN stddev_pop({f}) OVER w > 0 THEN stddev_pop({f}) OVER w ELSE 1.0 END AS x{i}" for i, f in enumerate(FEATS, 1)]
CTE["domains"] = f"""
SELECT window_id, dom, k, (pos * k) // nd AS fold, {', '.join(_X)} FROM (
  SELECT window_id, 0 AS dom, row_number() OVER (PARTITION BY window_id ORDER BY row_idx) - 1 AS pos, nr AS nd, least(3, least(nw, nr) // 2) AS k, {', '.join(FEATS)}
  FROM ref JOIN split USING (row_idx), (SELECT window_id, count(*) AS nw FROM win GROUP BY 1), (SELECT count(*) AS nr FROM split WHERE split = 'val') WHERE split = 'val'
  UNION ALL
  SELECT window_id, 1, row_number() OVER (PARTITION BY window_id ORDER BY row_idx) - 1, count(*) OVER (PARTITION BY window_id),
    least(3, least(count(*) OVER (PARTITION BY window_id), (SELECT count(*) FROM split WHERE split = 'val')) // 2), {', '.join(FEATS)} FROM win)
WINDOW w AS (PARTITION BY window_id)"""
domain_ctes("cv", "SELECT d.*, m FROM domains d, range(0, 3) r(m) WHERE m < k AND k >= 2 AND fold <> m")
domain_ctes("all_rows", "SELECT *, 0 AS m FROM domains")
_ETA = " + ".join(["b0", *[f"b{i} * x{i}" for i in range(1, len(FEATS) + 1)]])
CTE["adversarial"] = f"""
SELECT window_id, coalesce(adv_score, 0.5) AS adv_score, CASE WHEN adv_score IS NULL THEN 'too_small' ELSE 'ok' END AS status
FROM (SELECT DISTINCT window_id FROM win) LEFT JOIN (
  SELECT window_id, avg(auc) AS adv_score FROM (
    SELECT window_id, m, (sum(r) FILTER (WHERE dom = 1) - count(*) FILTER (WHERE dom = 1) * (count(*) FILTER (WHERE dom = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE dom = 1) * count(*) FILTER (WHERE dom = 0)) AS auc FROM (
      SELECT window_id, m, dom, rank() OVER (PARTITION BY window_id, m ORDER BY eta) + (count(*) OVER (PARTITION BY window_id, m, eta) - 1) / 2.0 AS r FROM (
        SELECT d.window_id, m, dom, round({_ETA}, 9) AS eta FROM domains d JOIN cv_step{NEWTON_STEPS} b ON b.window_id = d.window_id AND b.m = d.fold)) GROUP BY 1, 2) GROUP BY 1)
  USING (window_id)"""
CTE["adv_importance"] = " UNION ALL ".join(f"SELECT window_id, '{f}' AS feature, abs(b{i}) AS importance FROM all_rows_step{NEWTON_STEPS}" for i, f in enumerate(FEATS, 1))

CTE["results"] = f"""
SELECT window_id AS window_idx, window_id AS window_num, true_phase, round(d_total, 6) AS D_total, round(d_shap, 6) AS D_shap,
       round(adv_score, 6) AS adv_score, round({lit(0.6)} * {clip('d_total')} + {lit(0.4)} * {clip('(adv_score - 0.5) * 2')}, 6) AS drift_belief,
       round(risk, 6) AS risk_score, round(est, 6) AS est_auprc, round(baseline_auprc, 6) AS baseline_auprc,
       level AS intervention_level, {case_list('level', ACTIONS)} AS intervention_action,
       coalesce(top_f, []) AS top_sadi_features, ks_f IS NOT NULL AS ks_detected, psi_f IS NOT NULL AS psi_detected,
       coalesce(ks_f, []) AS ks_flagged_features, coalesce(psi_f, []) AS psi_flagged_features, dpd, eod, n_samples
FROM (SELECT *, {LEVEL} AS level FROM (SELECT *, {clip('baseline_auprc - est')} AS risk FROM (
  SELECT *, {clip('baseline_auprc * (1 - least(d_confidence, 1.0))')} AS est
  FROM d_total JOIN w_phase USING (window_id) JOIN fair USING (window_id) JOIN (SELECT window_id, adv_score FROM adversarial) USING (window_id)
  JOIN (SELECT window_id, count(*) AS n_samples FROM win GROUP BY 1) USING (window_id)
  LEFT JOIN (SELECT window_id, feats AS top_f FROM ({top_list('sadi', 'sadi')})) USING (window_id)
  LEFT JOIN (SELECT window_id, feats AS ks_f FROM ({top_list('(SELECT * FROM ks WHERE p_value < 0.05)', 'statistic')})) USING (window_id)
  LEFT JOIN (SELECT window_id, feats AS psi_f FROM ({top_list('(SELECT * FROM psi_detector WHERE psi > 0.2)', 'psi')})) USING (window_id)
  CROSS JOIN base)))"""
# ---- adaptive windows: one bucket operation a step (append, merge the two oldest of a crowded level, drop the oldest) ------


def adwin_runs(source: str, key: str, order: str, value: str, grain: int) -> str:
    return f"""SELECT k, (rn - 1) // {grain} AS run, max(rn) AS last_position, count(*)::DOUBLE AS n, sum(v) AS s, var_pop(v) * count(*) AS d FROM (
      SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} WHERE {value} IS NOT NULL) GROUP BY 1, 2"""


def adwin_walk(runs: str) -> str:
    """(k, run, last_position, drift, window_size)."""
    return f"""
WITH RECURSIVE walk AS (
  SELECT DISTINCT k, -1::BIGINT AS run, []::STRUCT(l BIGINT, n DOUBLE, s DOUBLE, d DOUBLE)[] AS rows, false AS cut, true AS ready, false AS due FROM {runs}
  UNION ALL
  SELECT k, CASE WHEN ready THEN run + 1 ELSE run END,
    CASE WHEN ready THEN list_append(rows, fresh)
         WHEN spot IS NOT NULL THEN rows[:spot - 1] || [merged] || rows[spot + 2:]
         WHEN has_cut THEN rows[2:] ELSE rows END,
    CASE WHEN ready THEN false ELSE cut OR (spot IS NULL AND has_cut) END,
    NOT ready AND spot IS NULL AND NOT has_cut, CASE WHEN ready THEN fresh_due ELSE due END
  FROM (
    SELECT *, struct_pack(l := rows[spot].l + 1, n := rows[spot].n + rows[spot + 1].n, s := rows[spot].s + rows[spot + 1].s,
        d := rows[spot].d + rows[spot + 1].d + pow(rows[spot].s / rows[spot].n - rows[spot + 1].s / rows[spot + 1].n, 2) * rows[spot].n * rows[spot + 1].n / (rows[spot].n + rows[spot + 1].n)) AS merged,
      due AND len(rows) > 1 AND n > 10 AND len(list_filter(range(1, len(rows)), lambda i: n0[i] >= 5 AND n - n0[i] >= 5 AND
        abs(s0[i] / n0[i] - (total - s0[i]) / (n - n0[i])) > sqrt(2.0 * (1 / n0[i] + 1 / (n - n0[i])) * var * lg) + 2.0 / 3.0 * (1 / n0[i] + 1 / (n - n0[i])) * lg)) > 0 AS has_cut
    FROM (
      SELECT *, ln(2.0 * ln(greatest(n, 2)) / 0.002) AS lg, list_sum(list_transform(rows, lambda x: x.d + x.n * pow(x.s / x.n - total / n, 2))) / n AS var,
        list_transform(range(1, len(rows) + 1), lambda i: list_sum(list_transform(rows[:i], lambda x: x.n))) AS n0,
        list_transform(range(1, len(rows) + 1), lambda i: list_sum(list_transform(rows[:i], lambda x: x.s))) AS s0,
        list_position(list_transform(rows, lambda x: x.l), list_min(list_filter(list_transform(rows, lambda x: x.l), lambda v: len(list_filter(rows, lambda y: y.l = v)) > 5))) AS spot
      FROM (
        SELECT w.k, w.run, rows, cut, ready, due, r.last_position // 32 <> (r.last_position - r.n::BIGINT) // 32 AS fresh_due, list_sum(list_transform(rows, lambda x: x.n)) AS n, list_sum(list_transform(rows, lambda x: x.s)) AS total, struct_pack(l := 0::BIGINT, n := r.n, s := r.s, d := r.d) AS fresh
        FROM walk w LEFT JOIN {runs} r ON r.k = w.k AND r.run = w.run + 1 WHERE NOT (ready AND r.run IS NULL)))) AS step)
SELECT k, run, last_position, cut AS drift, list_sum(list_transform(rows, lambda x: x.n)) AS window_size FROM walk JOIN {runs} USING (k, run) WHERE ready AND run >= 0"""


PRED_GRAIN = 100
CTE["pred_runs"] = adwin_runs("stream", "0", "row_idx", "p", PRED_GRAIN)
CTE["pred_adwin"] = adwin_walk("pred_runs")
CTE["readings"] = """
SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hour,
""" + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}" for k in M.READING_KINDS) + """,
       (event_type = 'error')::INTEGER AS label, value FROM events"""
CTE["docs"] = """
SELECT d.doc_id, lang, source, quality AS y, toxic, round(least(greatest(n_chars / 4000.0::DOUBLE, 0.01), 0.99), 6) AS p
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
READING_GRAIN = 64
CTE["stepped"] = """SELECT *, least(value / 500.0 + CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 0.5 ELSE 0.0 END, 1.0) AS moved FROM readings"""
CTE["reading_runs"] = adwin_runs("stepped", "label", "ts, event_id", "moved", READING_GRAIN)
CTE["reading_adwin"] = adwin_walk("reading_runs")
CTE["kind_runs"] = adwin_runs("(SELECT *, least(value / 500.0 + CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 0.5 ELSE 0.0 END, 1.0) AS moved FROM events)", "event_type", "ts", "moved", 1)
CTE["kind_adwin"] = adwin_walk("kind_runs")
CTE["truth"] = " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{s.base}' AS base_feature, '{s.phase}' AS phase, '{s.component}' AS component"
    for s in M.SHIFTS
    for c in s.columns(FEATS)
)
CTE["flags"] = """
SELECT window_num, true_phase, 'index' AS detector, D_total > 0.3 AS fired FROM results
UNION ALL SELECT window_num, true_phase, 'ks', ks_detected FROM results
UNION ALL SELECT window_num, true_phase, 'psi', psi_detected FROM results"""
CTE["ordered_windows"] = """
SELECT *, row_number() OVER (ORDER BY drift, said, window_num) - 1 AS pos, count(*) OVER () AS n FROM (
  SELECT window_num, true_phase <> 'phase1' AS drift, list(fired ORDER BY detector) AS said FROM flags GROUP BY 1, 2)"""
CTE["resample"] = f"""
SELECT detector, resample, {safe('2.0 * tp', '2 * tp + fp + fn')} AS f1 FROM (
  SELECT detector, resample, count(*) FILTER (fired AND drift) AS tp, count(*) FILTER (fired AND NOT drift) AS fp,
         count(*) FILTER (NOT fired AND drift) AS fn
  FROM (SELECT resample, least(floor(({bits('resample * n + i', 42)} + {bits('resample * n + i', 45)} / {H.HASH_MODULUS}.0::DOUBLE)
          / {H.HASH_MODULUS}.0::DOUBLE * n)::BIGINT, n - 1) AS pos
        FROM (SELECT n, pos AS i FROM ordered_windows), range(0, 1000) r(resample)) draws
  JOIN ordered_windows USING (pos) JOIN flags USING (window_num) GROUP BY 1, 2)"""
CTE["events_f"] = """
SELECT window_num, feature, rank, true_phase AS phase FROM (
  SELECT window_num, true_phase, unnest(top_sadi_features) AS feature, generate_subscripts(top_sadi_features, 1)::INTEGER AS rank FROM results)"""
CTE["freq"] = "SELECT feature, count(*) AS n FROM events_f GROUP BY 1 ORDER BY n DESC, feature LIMIT 15"


def sql(body: str, instead: dict[str, str] | None = None) -> str:
    """Prefix the statement with the expressions it uses, in dependency order; ``instead`` replaces some."""
    order: list[str] = []
    ctes = CTE | (instead or {})

    def visit(text: str, inside: frozenset = frozenset()) -> None:
        for name in ctes:
            if name in inside or name in order:
                continue
            if re.search(rf"\b(FROM|JOIN)\s*\(*\s*{name}\b", text):
                visit(ctes[name], inside | {name})
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in order) + "\n" + body
