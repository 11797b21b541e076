"""Models with given parameters: one round from them, and what they say of every row.

The parameters are fixed, so SQL can follow the recursions row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import if_zero, round_doubles
from ..operators import models as md
from ..operators.features import compute_features
from ..operators.layout import POS
from ..operators.packing import number_complete_rows, pack
from ..session import stage
from ..sources.tables import daily_bars
from .sqlparts import BARS, RETURNS, query

KEYS = ["series_id"]
#: Two states of the daily return: calm and wild.
CALM_WILD = {"means": [0.01, 0.1], "vars": [0.03, 0.4], "start": [0.6, 0.4], "trans": [0.9, 0.1, 0.25, 0.75]}
#: Three centres and components of (return, range).
THREE = {
    "means": [-0.2, 0.5, 0.0, 1.0, 0.3, 1.5], "vars": [0.05, 0.2, 0.04, 0.25, 0.3, 0.6], "start": [0.3, 0.5, 0.2],
    "trans": [0.8, 0.1, 0.1, 0.1, 0.8, 0.1, 0.1, 0.1, 0.8],
}


def _given(spark, sf, features: list[str], theta: dict):
    """Numbered rows, their links, and one model per series with the given parameters."""
    df = compute_features(daily_bars(spark, sf), "returns").withColumn("ret", if_zero(F.col("ret_simple")))
    df = df.withColumn("width", (F.col("raw_high") - F.col("raw_low")) / F.col("raw_close"))
    rows = stage(number_complete_rows(df, KEYS, features).select(*KEYS, "date", POS, *features))
    packed = pack(rows, KEYS, features)
    models = md.model_table(packed, KEYS, [len(theta["start"])])
    return rows, packed, stage(models.withColumns({n: F.array(*[F.lit(float(x)) for x in v]) for n, v in theta.items()}))


def _dated(rows, params, found):
    """Row results beside their dates."""
    named = found.join(params.select("model_id", *KEYS), "model_id")
    return rows.withColumnRenamed(POS, "pos").select(*KEYS, "date", "pos").join(named, [*KEYS, "pos"]).drop("model_id", "pos")


def _numbered(prefix: str, array: str, n: int):
    return [F.col(array)[i].alias(f"{prefix}{i}") for i in range(n)]


def q_posterior(spark, sf):
    rows, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    out = _dated(rows, params, md.hmm_posterior(packed, params, KEYS, 1))
    return round_doubles(out.select(*KEYS, "date", *_numbered("p", "proba", 2)))


def q_switching(spark, sf):
    rows, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    out = _dated(rows, params, md.msr_probabilities(packed, params, KEYS))
    return round_doubles(out.select(*KEYS, "date", *_numbered("filtered", "filtered", 2), *_numbered("smoothed", "smoothed", 2)))


def q_path(spark, sf):
    rows, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    return _dated(rows, params, md.hmm_decode(packed, params, KEYS, 1)).select(*KEYS, "date", "state")


def q_score(spark, sf):
    _, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    score = md.hmm_score(packed, params, KEYS, 1).join(params.select("model_id", *KEYS, "k", "lo", "hi"), "model_id")
    out = md.information_criteria(score, "hmm", 1)
    return round_doubles(out.select(*KEYS, "log_likelihood", "aic", "bic"), 5)


def q_baum_welch(spark, sf):
    _, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    new = md.em_round("hmm", packed, params, KEYS, 1)
    cells = [*_numbered("mean", "means", 2), *_numbered("var", "vars", 2), *_numbered("start", "start", 2), *_numbered("move", "trans", 4)]
    return round_doubles(new.select(*KEYS, *cells))


def _components(new):
    """One row per component of two-column models of three components."""
    cell = lambda i: F.struct(
        F.lit(i).alias("state"), F.col("start")[i].alias("weight"), *[F.col("means")[2 * i + j].alias(f"mean{j}") for j in (0, 1)],
        *[F.col("vars")[2 * i + j].alias(f"var{j}") for j in (0, 1)],
    )
    return new.select(*KEYS, "log_likelihood", F.inline(F.array(*[cell(i) for i in range(3)])))


def q_kmeans(spark, sf):
    _, packed, params = _given(spark, sf, ["ret", "width"], THREE)
    return round_doubles(_components(md.em_round("kmeans", packed, params, KEYS, 2)).drop("var0", "var1").withColumnRenamed("log_likelihood", "minus_inertia"), 5)


def q_mixture(spark, sf):
    _, packed, params = _given(spark, sf, ["ret", "width"], THREE)
    return round_doubles(_components(md.em_round("gmm", packed, params, KEYS, 2)), 5)


QUERIES = {
    "posterior_given": q_posterior,
    "switching_given": q_switching,
    "viterbi_given": q_path,
    "score_given": q_score,
    "baum_welch_round": q_baum_welch,
    "kmeans_round": q_kmeans,
    "mixture_round": q_mixture,
}


# --- SQL: recursions over the positions of a series -----------------------------------------

_D = "::DOUBLE"
_M, _V, _S, _T = (CALM_WILD[n] for n in ("means", "vars", "start", "trans"))


def _log_normal(x: str, mean, var) -> str:
    return f"(-0.5{_D} * ({x} - {mean}{_D}) * ({x} - {mean}{_D}) / {var}{_D} - 0.5{_D} * ln(2.0{_D} * pi() * {var}{_D}))"


# densities are scaled by the larger one, whose logarithm is top
_OBS = f"""lg AS (SELECT series_id, date, ret, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n,
  {_log_normal('ret', _M[0], _V[0])} AS l0, {_log_normal('ret', _M[1], _V[1])} AS l1 FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date)),
obs AS MATERIALIZED (SELECT *, greatest(l0, l1) AS top, exp(l0 - greatest(l0, l1)) AS d0, exp(l1 - greatest(l0, l1)) AS d1 FROM lg)"""
# u: weights before scaling; a: filtered probabilities; c: density of the row given the rows before
_AHEAD = f"""fw AS (SELECT series_id, pos, u0 / (u0 + u1) AS a0, u1 / (u0 + u1) AS a1, u0 + u1 AS c
    FROM (SELECT *, {_S[0]}{_D} * d0 AS u0, {_S[1]}{_D} * d1 AS u1 FROM obs WHERE pos = 0)
  UNION ALL SELECT series_id, pos, u0 / (u0 + u1), u1 / (u0 + u1), u0 + u1 FROM (SELECT o.series_id, o.pos,
    (a0 * {_T[0]}{_D} + a1 * {_T[2]}{_D}) * d0 AS u0, (a0 * {_T[1]}{_D} + a1 * {_T[3]}{_D}) * d1 AS u1
    FROM fw JOIN obs o ON o.series_id = fw.series_id AND o.pos = fw.pos + 1))"""
_BACK = f"""bw AS (SELECT series_id, pos, 1.0{_D} AS b0, 1.0{_D} AS b1 FROM obs WHERE pos = n - 1
  UNION ALL SELECT series_id, pos, v0 / (v0 + v1), v1 / (v0 + v1) FROM (SELECT o.series_id, o.pos - 1 AS pos,
    {_T[0]}{_D} * d0 * b0 + {_T[1]}{_D} * d1 * b1 AS v0, {_T[2]}{_D} * d0 * b0 + {_T[3]}{_D} * d1 * b1 AS v1
    FROM bw JOIN obs o ON o.series_id = bw.series_id AND o.pos = bw.pos WHERE o.pos > 0))"""
_SMOOTH = """sm AS MATERIALIZED (SELECT o.*, a0, a1, b0, b1, a0 * b0 / (a0 * b0 + a1 * b1) AS g0, a1 * b1 / (a0 * b0 + a1 * b1) AS g1
  FROM obs o JOIN fw USING (series_id, pos) JOIN bw USING (series_id, pos))"""
_HEAD = "WITH RECURSIVE " + ",\n".join([BARS, RETURNS, _OBS])
_LOG = [f"ln({p + 1e-15}{_D})" for p in _T]
_BEST = f"""vt AS (SELECT series_id, pos, ln({_S[0]}{_D}) + l0 AS v0, ln({_S[1]}{_D}) + l1 AS v1, 0 AS c0, 0 AS c1 FROM obs WHERE pos = 0
  UNION ALL SELECT o.series_id, o.pos, greatest(v0 + {_LOG[0]}, v1 + {_LOG[2]}) + l0, greatest(v0 + {_LOG[1]}, v1 + {_LOG[3]}) + l1,
    CASE WHEN v0 + {_LOG[0]} >= v1 + {_LOG[2]} THEN 0 ELSE 1 END, CASE WHEN v0 + {_LOG[1]} >= v1 + {_LOG[3]} THEN 0 ELSE 1 END
  FROM vt JOIN obs o ON o.series_id = vt.series_id AND o.pos = vt.pos + 1)"""
_XI = f"""xi AS (SELECT series_id, pos, p0 * {_T[0]}{_D} * d0 * b0 AS x00, p0 * {_T[1]}{_D} * d1 * b1 AS x01,
    p1 * {_T[2]}{_D} * d0 * b0 AS x10, p1 * {_T[3]}{_D} * d1 * b1 AS x11
  FROM (SELECT *, lag(a0) OVER (PARTITION BY series_id ORDER BY pos) AS p0, lag(a1) OVER (PARTITION BY series_id ORDER BY pos) AS p1 FROM sm) WHERE pos > 0),
mv AS (SELECT series_id, sum(x00 / t) AS m00, sum(x01 / t) AS m01, sum(x10 / t) AS m10, sum(x11 / t) AS m11
  FROM (SELECT *, x00 + x01 + x10 + x11 AS t FROM xi) GROUP BY 1),
em AS (SELECT series_id, sum(g0) AS w0, sum(g1) AS w1, sum(g0 * ret) / sum(g0) AS e0, sum(g1 * ret) / sum(g1) AS e1,
    sum(g0 * ret * ret) / sum(g0) AS q0, sum(g1 * ret * ret) / sum(g1) AS q1, max(g0) FILTER (pos = 0) AS s0, max(g1) FILTER (pos = 0) AS s1 FROM sm GROUP BY 1)"""


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


_WIDTH = "x AS MATERIALIZED (SELECT series_id, date, ret, (high - low) / b.close AS width, row_number() OVER () AS rid FROM rets JOIN bars b USING (series_id, date))"
_C = [THREE["means"][2 * i : 2 * i + 2] for i in range(3)]
_W = [THREE["vars"][2 * i : 2 * i + 2] for i in range(3)]
_far = lambda a, b: f"((ret - {a}) * (ret - {a}) + (width - {b}) * (width - {b}))"
_least = "CASE WHEN f0 <= f1 AND f0 <= f2 THEN 0 WHEN f1 <= f2 THEN 1 ELSE 2 END"
_new_far = "(ret - mean0) * (ret - mean0) + (width - mean1) * (width - mean1)"
_logs = ", ".join(f"ln({THREE['start'][i]}{_D}) + {_log_normal('ret', _C[i][0], _W[i][0])} + {_log_normal('width', _C[i][1], _W[i][1])} AS l{i}" for i in range(3))
_log_density = "ln(weight) - 0.5::DOUBLE * ((ret - mean0) * (ret - mean0) / var0 + (width - mean1) * (width - mean1) / var1) - ln(2.0::DOUBLE * pi() * sqrt(var0 * var1))"

ORACLES = {
    "posterior_given": f"{_HEAD},\n{_AHEAD},\n{_BACK},\n{_SMOOTH}\nSELECT series_id, date, {_r('g0', 'p0')}, {_r('g1', 'p1')} FROM sm",
    "switching_given": f"{_HEAD},\n{_AHEAD},\n{_BACK},\n{_SMOOTH}\nSELECT series_id, date, {_r('a0', 'filtered0')}, {_r('a1', 'filtered1')}, "
    f"{_r('g0', 'smoothed0')}, {_r('g1', 'smoothed1')} FROM sm",
    "viterbi_given": f"""{_HEAD},
{_BEST}, vm AS MATERIALIZED (SELECT * FROM vt),
bk AS (SELECT o.series_id, o.pos, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END AS state FROM vm JOIN obs o USING (series_id, pos) WHERE pos = n - 1
  UNION ALL SELECT vm.series_id, vm.pos - 1, CASE WHEN state = 0 THEN c0 ELSE c1 END FROM bk JOIN vm ON vm.series_id = bk.series_id AND vm.pos = bk.pos WHERE vm.pos > 0)
SELECT series_id, date, state::INTEGER AS state FROM bk JOIN obs USING (series_id, pos)""",
    "score_given": f"""{_HEAD},\n{_AHEAD}, sc AS (SELECT series_id, sum(ln(c) + top) AS ll, count(*) AS n FROM fw JOIN obs USING (series_id, pos) GROUP BY 1)
SELECT series_id, {_r('ll', 'log_likelihood', 5)}, {_r('14 - 2 * ll', 'aic', 5)}, {_r('7 * ln(n) - 2 * ll', 'bic', 5)} FROM sc""",
    "baum_welch_round": f"""{_HEAD},\n{_AHEAD},\n{_BACK},\n{_SMOOTH},\n{_XI}
SELECT series_id, {_r('e0', 'mean0')}, {_r('e1', 'mean1')}, {_r('greatest(q0 - e0 * e0, 0.001)', 'var0')}, {_r('greatest(q1 - e1 * e1, 0.001)', 'var1')},
  {_r('s0', 'start0')}, {_r('s1', 'start1')}, {_r('m00 / (m00 + m01)', 'move0')}, {_r('m01 / (m00 + m01)', 'move1')},
  {_r('m10 / (m10 + m11)', 'move2')}, {_r('m11 / (m10 + m11)', 'move3')} FROM em JOIN mv USING (series_id)""",
    "kmeans_round": query(
        BARS, RETURNS, _WIDTH, "f AS (SELECT *, " + ", ".join(f"{_far(*c)} AS f{i}" for i, c in enumerate(_C)) + " FROM x)",
        f"""c AS (SELECT series_id, {_least} AS state, avg(ret) AS mean0, avg(width) AS mean1, count(*) AS n FROM f GROUP BY 1, 2)""",
        f"""g AS (SELECT g.series_id, s.state, coalesce(mean0, [{_C[0][0]}, {_C[1][0]}, {_C[2][0]}][s.state + 1]) AS mean0,
          coalesce(mean1, [{_C[0][1]}, {_C[1][1]}, {_C[2][1]}][s.state + 1]) AS mean1, coalesce(n, 0) / sum(n) OVER (PARTITION BY g.series_id) AS weight
          FROM (SELECT DISTINCT series_id FROM x) g CROSS JOIN range(3) s(state) LEFT JOIN c ON c.series_id = g.series_id AND c.state = s.state)""",
        f"i AS (SELECT series_id, -sum(d) AS cost FROM (SELECT x.series_id, rid, min({_new_far}) AS d FROM x JOIN g USING (series_id) GROUP BY 1, 2) GROUP BY 1)",
        f"SELECT series_id, state::INTEGER AS state, {_r('weight', 'weight', 5)}, {_r('mean0', 'mean0', 5)}, {_r('mean1', 'mean1', 5)}, {_r('cost', 'minus_inertia', 5)} FROM g JOIN i USING (series_id)",
    ),
    "mixture_round": query(
        BARS, RETURNS, _WIDTH, f"q AS (SELECT *, {_logs} FROM x)",
        "p AS (SELECT *, " + ", ".join(f"exp(l{i} - greatest(l0, l1, l2)) AS p{i}" for i in range(3)) + " FROM q)",
        "r AS (" + " UNION ALL ".join(f"SELECT series_id, {i} AS state, ret, width, p{i} / (p0 + p1 + p2) AS g FROM p" for i in range(3)) + ")",
        """m AS (SELECT series_id, state, sum(g) AS w, sum(g * ret) / sum(g) AS mean0, sum(g * width) / sum(g) AS mean1,
          sum(g * ret * ret) / sum(g) AS q0, sum(g * width * width) / sum(g) AS q1 FROM r GROUP BY 1, 2)""",
        """n AS (SELECT series_id, state, w / sum(w) OVER (PARTITION BY series_id) AS weight, mean0, mean1,
          q0 - mean0 * mean0 + 1e-6 AS var0, q1 - mean1 * mean1 + 1e-6 AS var1 FROM m)""",
        f"k AS (SELECT x.series_id, rid, {_log_density} AS d FROM x JOIN n USING (series_id))",
        "l AS (SELECT series_id, sum(top + ln(s)) AS ll FROM (SELECT series_id, rid, max(top) AS top, sum(exp(d - top)) AS s "
        "FROM (SELECT *, max(d) OVER (PARTITION BY series_id, rid) AS top FROM k) GROUP BY 1, 2) GROUP BY 1)",
        "SELECT series_id, state::INTEGER AS state, " + ", ".join(_r(c, c, 5) for c in ("weight", "mean0", "mean1", "var0", "var1"))
        + f", {_r('ll', 'log_likelihood', 5)} FROM n JOIN l USING (series_id)",
    ),
}
