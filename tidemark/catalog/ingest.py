"""Queries on ingest, cleaning, validation, metadata and feature selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import attach, round_doubles
from ..operators import ingest, selection, validate
from ..operators.features import compute_features, feature_layout
from ..operators.layout import POS, plain
from ..session import ensure_checkpoint_dir
from ..sources.sinks import commit_table, dataset_metadata, read_committed, versions
from ..sources.tables import daily_bars, daily_covariate
from .sqlparts import BARS, COVARIATE, LOGS, frame, query, rounded, whole

AS_OF = "2001-06-30"
PERIOD = ("1996-02-01", "1996-05-31")


def raw_text(spark, sf):
    """The bars as a raw export: other headers, text numbers, some unreadable cells."""
    b = plain(daily_bars(spark, sf))
    day = F.dayofmonth("date")
    money = lambda c: F.concat(F.lit(" ₹"), F.format_number(F.col(c), 10), F.lit(" "))
    return b.select(
        "series_id",
        F.when(day == 9, F.lit("unknown")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("Date"),
        money("open").alias(" Open Price"),
        F.when(day == 17, F.lit("n/a")).otherwise(money("high")).alias("HIGH"),
        money("low").alias("Low"),
        money("close").alias("Index Value"),
        F.format_number("volume", 0).alias("Shares Traded"),
    )


def dirty_bars(spark, sf):
    """Bars with planted faults by day of the month, and their arrival order."""
    b = daily_bars(spark, sf)
    day = F.dayofmonth("date")
    row = F.when(day == 6, F.col(POS) * 10 - 15).otherwise(F.col(POS) * 10)
    bad = b.select(
        "series_id", row.alias("arrival"), "date",
        F.when(day == 2, F.lit("n/a")).otherwise(F.col("open").cast("string")).alias("open"),
        F.when(day == 3, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(day == 4, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(day == 5, -F.col("volume")).when(day == 7, F.lit(None)).otherwise(F.col("volume")).alias("volume"),
    )
    again = bad.filter(F.dayofmonth("date") == 1).withColumn("arrival", F.col("arrival") + 1)
    return bad.unionByName(again)


def q_normalize(spark, sf):
    return round_doubles(ingest.normalize_bars(raw_text(spark, sf)))


def written_files(spark, sf) -> str:
    """The bars as CSV files, one per year: rows of the 6th come early, lines of the 13th are cut short, even years have slash dates."""
    b = daily_bars(spark, sf)
    day, year = F.dayofmonth("date"), F.year("date")
    date = F.when(year % 2 == 0, F.date_format("date", "MM/dd/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    cells = [F.format_number(F.col(c), 6) for c in ("open", "high", "low", "close", "volume")]
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.when(day == 13, F.concat_ws(",", "series_id", date)).otherwise(F.concat_ws(",", F.col("series_id"), date, *[text(c) for c in cells]))
    place = F.when(day == 6, F.col(POS) * 10 - 25).otherwise(F.col(POS) * 10)
    rows = b.select(year.alias("file"), place.alias("place"), "series_id", line.alias("value"))
    head = rows.select("file").distinct().select("file", F.lit(-1000).cast("long").alias("place"), F.lit("").alias("series_id"), F.lit("series_id,Date,Open,High,Low,Close,Volume").alias("value"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/bar-files-{uuid.uuid4().hex}"
    dealt = rows.unionByName(head).repartition("file").sortWithinPartitions("file", "place", "series_id")
    dealt.select("file", "value").write.partitionBy("file").text(path)
    return path


def q_files(spark, sf):
    """Checks in arrival order over several files, with the lines that are no record."""
    rows, broken = ingest.read_bars_files(spark, written_files(spark, sf))
    report = validate.validate_bars(ingest.normalize_bars(rows), order="arrival", as_of=AS_OF)
    lost = broken.groupBy(F.split("line", ",")[0].alias("series_id")).agg(F.count(F.lit(1)).alias("broken_lines"))
    return report.select(
        "series_id", "total_rows", "unsorted_dates_count", "impossible_returns_count", "duplicate_rows_count"
    ).join(lost, "series_id", "left").fillna(0, ["broken_lines"])


def q_align(spark, sf):
    out = ingest.align_covariate(daily_bars(spark, sf), daily_covariate(spark, sf), ["vix_close"])
    return round_doubles(plain(out).select("series_id", "date", "close", "vix_close"))


def q_external(spark, sf):
    """Covariate and highest bar of a day as two external series; orders and bars begin and end on different days."""
    cov = daily_covariate(spark, sf, "orders_mean")
    items = daily_bars(spark, sf).groupBy("date").agg(F.max("high").alias("bars_high"))
    return round_doubles(ingest.join_external([cov, items]))


def q_missing_cells(spark, sf):
    df = compute_features(daily_bars(spark, sf), "returns")
    return ingest.count_missing(df)


def q_between(spark, sf):
    return round_doubles(plain(ingest.between_dates(daily_bars(spark, sf, *PERIOD), *PERIOD)))


def q_drop_policy(spark, sf):
    df = compute_features(daily_bars(spark, sf), "returns")
    feats = ["ret_log", "ret_21d", "ret_cum_63d"]
    return round_doubles(ingest.apply_missing_policy(df, feats, "drop").select("series_id", "date", *feats, "raw_close"))


def q_validate(spark, sf):
    report = validate.validate_bars(dirty_bars(spark, sf), order="arrival", as_of=AS_OF)
    return report.drop("missing_columns")


def q_verdict(spark, sf):
    return validate.dataset_verdict(validate.validate_bars(dirty_bars(spark, sf), order="arrival", as_of=AS_OF))


def q_issues(spark, sf):
    return validate.validation_issues(dirty_bars(spark, sf), order="arrival", as_of=AS_OF)


def q_missing_days(spark, sf):
    return validate.missing_business_days(daily_bars(spark, sf))


def q_metadata(spark, sf):
    return dataset_metadata(daily_bars(spark, sf), "lineitem")


def q_committed(spark, sf):
    """Bars committed twice and read back: what the table and its manifest say, and how many versions are left."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/committed-{uuid.uuid4().hex}"
    bars = daily_bars(spark, sf)
    commit_table(bars.filter(F.col("volume") > 10), path)
    commit_table(bars, path)
    table, manifest = read_committed(spark, path)
    listed = manifest.agg(F.sum("n_rows").alias("listed_rows"), F.min("least_date").alias("least_date"), F.max("most_series_id").alias("most_series"))
    rows = table.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("most_date"), F.round(F.sum("volume"), 2).alias("volume"))
    return attach(rows, listed).withColumn("versions", F.lit(len(versions(spark, path))))


PICK = ["ret_log", "ret_3d", "ret_5d", "ret_10d", "ret_21d", "ret_63d", "ret_cum_21d", "ret_cum_63d"]


def _returns(spark, sf):
    return compute_features(daily_bars(spark, sf), "returns")


def q_variances(spark, sf):
    return round_doubles(selection.variances(_returns(spark, sf), PICK, ["series_id"]))


def q_correlations(spark, sf):
    return round_doubles(selection.correlations(_returns(spark, sf), PICK, ["series_id"]))


def q_selected(spark, sf):
    """Every feature of every series: selected, or dropped for its variance or its correlation with another."""
    found = selection.selection_table(_returns(spark, sf), PICK, ["series_id"], 0.15, 0.6)
    chosen, order = F.array_contains("selected", F.col("feature")), F.array_position("dropped", F.col("feature")).cast("int")
    rows = found.select("series_id", "selected", "dropped", F.explode(F.array(*[F.lit(c) for c in PICK])).alias("feature"))
    return rows.select("series_id", "feature", chosen.alias("selected"), order.alias("dropped_as"))


def q_scaler(spark, sf):
    return round_doubles(selection.scaler_table(_returns(spark, sf), PICK, ["series_id"]))


def q_standardized(spark, sf):
    df = _returns(spark, sf)
    train = ingest.between_dates(df, "1995-01-01", "1998-12-31")
    scaler = selection.scaler_table(train, PICK, ["series_id"])
    return round_doubles(selection.standardize(df, scaler, PICK, ["series_id"]).select("series_id", "date", *PICK))


def q_components(spark, sf):
    return round_doubles(selection.principal_components(_returns(spark, sf), PICK, 3, ["series_id", "date"]), 6)


def q_component_sums(spark, sf):
    """Sums that components keep: total variance, square sum of the covariance matrix, uncorrelated scores."""
    k, pcs = len(PICK), [f"pc{i + 1}" for i in range(len(PICK))]
    df = _returns(spark, sf)
    scores = selection.principal_components(df, PICK, k, ["series_id"], ["series_id"])
    values = selection.components(df, PICK, k, ["series_id"]).select("series_id", "values")
    var = scores.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.var_samp(c) for c in pcs]).alias("v"),
        F.greatest(*[F.abs(F.covar_samp(a, b)) for i, a in enumerate(pcs) for b in pcs[i + 1:]]).alias("off_diagonal"),
    ).join(values, "series_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    gap = F.array_max(F.transform(F.zip_with("v", "values", lambda a, b: F.abs(a - b)), lambda g: g))
    return round_doubles(var.select(
        "series_id", "n", total("v").alias("total"), total(F.transform("v", lambda v: v * v)).alias("squares"),
        total(F.transform("v", lambda v: v * v * v)).alias("cubes"), "off_diagonal", gap.alias("gap_to_values"),
    ), 5)


QUERIES = {
    "normalize_bars": q_normalize,
    "bar_files": q_files,
    "align_covariate": q_align,
    "external_series": q_external,
    "missing_cells": q_missing_cells,
    "between_dates": q_between,
    "missing_policy_drop": q_drop_policy,
    "validate_bars": q_validate,
    "validation_verdict": q_verdict,
    "validation_issues": q_issues,
    "missing_business_days": q_missing_days,
    "dataset_metadata": q_metadata,
    "committed_table": q_committed,
    "feature_variances": q_variances,
    "feature_correlations": q_correlations,
    "selected_features": q_selected,
    "scaler_parameters": q_scaler,
    "standardized_features": q_standardized,
    "principal_components": q_components,
    "component_sums": q_component_sums,
}

_DIRTY = """pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS p, day(date) AS d FROM bars),
once AS (SELECT series_id, CASE WHEN d = 6 THEN p * 10 - 15 ELSE p * 10 END AS arrival, date, d,
  CASE WHEN d = 2 THEN NULL ELSE open END AS open, CASE WHEN d = 3 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN d = 4 THEN -close ELSE close END AS close,
  CASE WHEN d = 5 THEN -volume WHEN d = 7 THEN NULL ELSE volume END AS volume FROM pos),
dirty AS (SELECT * FROM once UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM once WHERE d = 1),
seq AS (SELECT *, lag(date) OVER w AS pd, lag(close) OVER w AS pc FROM dirty
  WINDOW w AS (PARTITION BY series_id ORDER BY arrival)),
chk AS (SELECT *, coalesce(open > high + 1e-5 OR open < low - 1e-5 OR close > high + 1e-5 OR close < low - 1e-5, false) AS outside,
  coalesce(close <= 0 OR open <= 0, false) AS badp, coalesce(abs(close / pc - 1.0) > 0.30, false) AS jump,
  coalesce(date < pd, false) AS uns FROM seq)"""
_GAPS = """span AS (SELECT series_id, min(date) AS a, max(date) AS b FROM {0} GROUP BY 1),
expd AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
gaps AS (SELECT * FROM expd e WHERE isodow(date) < 6
  AND NOT EXISTS (SELECT 1 FROM {0} x WHERE x.series_id = e.series_id AND x.date = e.date))"""
_REPORT = """rep AS (SELECT series_id, count(*) AS total_rows,
  count_if(open IS NULL) + count_if(volume IS NULL) AS non_numeric_count,
  count_if(high < low) + count_if(outside) AS invalid_ohlc_relation_count,
  count_if(badp) AS invalid_price_count, count_if(uns) AS unsorted_dates_count,
  count_if(date > DATE '2001-06-30') AS future_dates_count, count_if(volume < 0) AS negative_volume_count,
  count_if(jump) AS impossible_returns_count,
  count_if(open IS NULL) + count_if(volume IS NULL) AS missing_values_count FROM chk GROUP BY 1),
dup AS (SELECT series_id, count(*) AS duplicate_rows_count FROM
  (SELECT series_id, date FROM dirty GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
gp AS (SELECT series_id, count(*) AS missing_dates_count FROM gaps GROUP BY 1),
full_ AS (SELECT rep.* REPLACE (CAST(non_numeric_count AS BIGINT) AS non_numeric_count,
    CAST(invalid_ohlc_relation_count AS BIGINT) AS invalid_ohlc_relation_count,
    CAST(invalid_price_count AS BIGINT) AS invalid_price_count, CAST(unsorted_dates_count AS BIGINT) AS unsorted_dates_count,
    CAST(future_dates_count AS BIGINT) AS future_dates_count, CAST(negative_volume_count AS BIGINT) AS negative_volume_count,
    CAST(impossible_returns_count AS BIGINT) AS impossible_returns_count, CAST(missing_values_count AS BIGINT) AS missing_values_count),
  coalesce(duplicate_rows_count, 0) AS duplicate_rows_count, coalesce(missing_dates_count, 0) AS missing_dates_count,
  non_numeric_count = 0 AND invalid_ohlc_relation_count = 0 AND invalid_price_count = 0 AND unsorted_dates_count = 0
  AND future_dates_count = 0 AND negative_volume_count = 0 AND impossible_returns_count = 0
  AND missing_values_count = 0 AND coalesce(duplicate_rows_count, 0) = 0 AS is_valid
  FROM rep LEFT JOIN dup USING (series_id) LEFT JOIN gp USING (series_id))"""

_RET = "f AS (SELECT series_id, date, close AS raw_close, ret_log, " + ", ".join(
    [f"close / lag(close, {n}) OVER (PARTITION BY series_id ORDER BY date) - 1.0 AS ret_{n}d" for n in (3, 5, 10, 21, 63)]
    + [f"exp({whole(n, 'sum', 'ret_log')}) - 1.0 AS ret_cum_{n}d" for n in (21, 63)]
) + ", close / prev - 1.0 AS ret_simple, open, high, low, volume FROM logs)"
_ALL_OK = " AND ".join(f"{c} IS NOT NULL" for c in PICK)
_long = lambda what: " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, {what.format(c)} FROM f GROUP BY 1" for c in PICK)
_pairs = [(a, b) for i, a in enumerate(PICK) for b in PICK[i + 1:]]
_missing = {"series_id": "series_id", "date": "date", "ret_simple": "ret_simple", "ret_log": "ret_log"}
_missing |= {f"ret_{n}d": f"ret_{n}d" for n in (3, 5, 10, 21, 63)}
_missing |= {c: c for c in ("ret_cum_21d", "ret_cum_63d", "raw_close")}
_missing |= {f"raw_{c}": c for c in ("open", "high", "low", "volume")}

def selection_sql(feats: list[str], var_min: float, corr_max: float) -> list[str]:
    """CTEs over ``ok`` (series_id and features of complete rows) that end in ``chosen`` (series_id, i, feature, selected, dropped_as).

    The walk over the pairs (later, earlier) is a recursion that carries what is gone.
    """
    return [
    "v AS (" + " UNION ALL ".join(f"SELECT series_id, {i} AS i, '{c}' AS feature, var_samp({c}) >= {var_min} AS high FROM ok GROUP BY 1" for i, c in enumerate(feats)) + ")",
    "r AS (" + " UNION ALL ".join(
        f"SELECT series_id, {i} AS i, {j} AS j, " + ("1.0::DOUBLE" if i == j else f"abs(corr({a}, {b}))") + " AS r FROM ok GROUP BY 1"
        for i, a in enumerate(feats) for j, b in enumerate(feats)) + ")",
    "k AS (SELECT r.* FROM r JOIN v a ON a.series_id = r.series_id AND a.i = r.i AND a.high JOIN v b ON b.series_id = r.series_id AND b.i = r.j AND b.high)",
    "s AS (SELECT series_id, i, avg(r) AS strength FROM k GROUP BY 1, 2)",
    """p AS (SELECT k.series_id, k.i, k.j, a.strength > b.strength + 1e-9 AS first_goes, row_number() OVER (PARTITION BY k.series_id ORDER BY k.j, k.i) AS nth
      FROM k JOIN s a ON a.series_id = k.series_id AND a.i = k.i JOIN s b ON b.series_id = k.series_id AND b.i = k.j WHERE k.i < k.j AND r > """ + f"{corr_max})",
    """w AS (SELECT DISTINCT series_id, 0::BIGINT AS nth, []::INTEGER[] AS gone FROM v
      UNION ALL SELECT w.series_id, p.nth, CASE WHEN list_contains(gone, p.i) OR list_contains(gone, p.j) THEN gone
        ELSE list_append(gone, CASE WHEN first_goes THEN p.i ELSE p.j END) END FROM w JOIN p ON p.series_id = w.series_id AND p.nth = w.nth + 1)""",
    "e AS (SELECT series_id, arg_max(gone, nth) AS gone FROM w GROUP BY 1)",
    "l AS (SELECT series_id, i, row_number() OVER (PARTITION BY series_id ORDER BY i) AS nth FROM v WHERE NOT high)",
    "n AS (SELECT series_id, count(*) AS n FROM l GROUP BY 1)",
    "o AS (SELECT series_id, bool_or(high) AS any_high FROM v GROUP BY 1)",
    """chosen AS (SELECT v.series_id, v.i, v.feature, NOT any_high OR (high AND NOT list_contains(gone, v.i)) AS selected,
      CAST(CASE WHEN NOT any_high THEN 0 WHEN NOT high THEN l.nth WHEN list_contains(gone, v.i) THEN coalesce(n, 0) + list_position(gone, v.i) ELSE 0 END AS INTEGER) AS dropped_as
      FROM v JOIN e USING (series_id) JOIN o USING (series_id) LEFT JOIN l ON l.series_id = v.series_id AND l.i = v.i LEFT JOIN n ON n.series_id = v.series_id)""",
    ]


_SELECTED = query(
    BARS, LOGS, _RET, f"ok AS (SELECT * FROM f WHERE {_ALL_OK})", *selection_sql(PICK, 0.15, 0.6),
    "SELECT series_id, feature, selected, dropped_as FROM chosen",
).replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES = {
    "normalize_bars": query(
        BARS,
        f"SELECT series_id, date, {rounded(['open', 'high', 'low', 'close', 'volume'])} FROM bars WHERE day(date) NOT IN (9, 17)",
    ),
    "bar_files": query(
        BARS,
        "p AS (SELECT *, year(date) AS file, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM bars)",
        "o AS (SELECT *, CASE WHEN day(date) = 6 THEN pos * 10 - 25 ELSE pos * 10 END AS place, round(close, 6) AS c FROM p WHERE day(date) <> 13)",
        "l AS (SELECT *, lag(date) OVER w AS before, lag(c) OVER w AS last FROM o WINDOW w AS (PARTITION BY series_id ORDER BY file, place))",
        "n AS (SELECT series_id, count(*) AS broken_lines FROM p WHERE day(date) = 13 GROUP BY 1)",
        "SELECT series_id, count(*) AS total_rows, count_if(date < before) AS unsorted_dates_count, count_if(abs(c / last - 1.0) > 0.30) AS impossible_returns_count, "
        "CAST(0 AS BIGINT) AS duplicate_rows_count, coalesce(any_value(broken_lines), 0) AS broken_lines FROM l LEFT JOIN n USING (series_id) GROUP BY 1",
    ),
    "align_covariate": query(
        BARS, COVARIATE,
        f"""j AS (SELECT b.series_id, b.date, b.close, c.vix_close AS v FROM bars b LEFT JOIN cov c USING (date))""",
        f"""SELECT series_id, date, round(close, 6) + 0.0 AS close, round(coalesce(
            last_value(v IGNORE NULLS) {frame(None)},
            first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            ), 6) + 0.0 AS vix_close FROM j""",
    ),
    "external_series": query(
        BARS, COVARIATE,
        "a AS (SELECT date, vix_close AS orders_mean FROM cov)",
        "b AS (SELECT date, max(high) AS bars_high FROM bars GROUP BY 1)",
        "SELECT date, round(orders_mean, 6) + 0.0 AS orders_mean, round(bars_high, 6) + 0.0 AS bars_high FROM a FULL JOIN b USING (date)",
    ),
    "missing_cells": query(
        BARS, LOGS, _RET,
        " UNION ALL ".join(f"SELECT '{k}' AS column_name, CAST(count_if({v} IS NULL) AS BIGINT) AS missing FROM f" for k, v in _missing.items()),
    ),
    "between_dates": query(
        BARS, f"SELECT series_id, date, {rounded(['open', 'high', 'low', 'close', 'volume'])} FROM bars "
        "WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'",
    ),
    "missing_policy_drop": query(
        BARS, LOGS, _RET,
        f"SELECT series_id, date, {rounded(['ret_log', 'ret_21d', 'ret_cum_63d', 'raw_close'])} FROM f "
        "WHERE ret_log IS NOT NULL AND ret_21d IS NOT NULL AND ret_cum_63d IS NOT NULL",
    ),
    "validate_bars": query(BARS, _DIRTY, _GAPS.format("dirty"), _REPORT, "SELECT * FROM full_"),
    "validation_verdict": query(
        BARS, _DIRTY, _GAPS.format("dirty"), _REPORT,
        "SELECT count(*) AS series, CAST(sum(total_rows) AS BIGINT) AS total_rows, bool_and(is_valid) AS is_valid FROM full_",
    ),
    "validation_issues": query(
        BARS, _DIRTY, _GAPS.format("dirty"),
        " UNION ALL ".join(
            f"SELECT series_id, '{n}' AS check_name, date FROM chk WHERE {c}"
            for n, c in {
                "non_numeric_open": "open IS NULL", "non_numeric_volume": "volume IS NULL", "invalid_prices": "badp",
                "high_less_than_low": "high < low", "price_outside_high_low": "outside",
                "future_dates": "date > DATE '2001-06-30'", "negative_volume": "volume < 0",
                "impossible_returns": "jump", "unsorted_dates": "uns",
            }.items()
        )
        + " UNION ALL SELECT series_id, 'duplicate_dates', date FROM dirty GROUP BY 1, 3 HAVING count(*) > 1"
        + " UNION ALL SELECT series_id, 'missing_business_days', date FROM gaps",
    ),
    "missing_business_days": query(
        BARS, _GAPS.format("bars"), "SELECT series_id, date FROM gaps"
    ),
    "committed_table": query(
        BARS, "t AS (SELECT count(*) AS listed_rows, min(date) AS least_date, max(series_id) AS most_series FROM bars)",
        "SELECT series_id, count(*) AS n_rows, max(date) AS most_date, round(sum(volume), 2) AS volume, listed_rows, least_date, most_series, 1 AS versions "
        "FROM bars, t GROUP BY series_id, listed_rows, least_date, most_series",
    ),
    "dataset_metadata": query(
        BARS,
        "h AS (SELECT *, md5(concat_ws('|', " + ", ".join(
            f"'{c}=' || CAST({c} AS {'VARCHAR' if c in ('date', 'series_id') else 'DECIMAL(38,6)'})::VARCHAR" for c in sorted(["series_id", "date", "open", "high", "low", "close", "volume"])
        ) + ")) AS h FROM bars)",
        "SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS row_count, "
        "CAST(0 AS BIGINT) AS missing_value_count, 'lineitem' AS source, count(*) || '-' || "
        + " || '-' || ".join(f"(sum(('0x' || h[{a}:{a + 15}])::UBIGINT::HUGEINT) % 18446744073709551616)" for a in (1, 17))
        + " AS fingerprint FROM h GROUP BY 1",
    ),
    "selected_features": _SELECTED,
    "component_sums": query(
        BARS, LOGS, _RET, f"ok AS (SELECT * FROM f WHERE {_ALL_OK})",
        "m AS (SELECT series_id, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PICK) + " FROM ok GROUP BY 1)",
        "z AS (SELECT series_id, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in PICK) + " FROM ok JOIN m USING (series_id))",
        "c AS (" + " UNION ALL ".join(f"SELECT series_id, {i} AS i, {j} AS j, covar_samp({a}, {b}) AS v FROM z GROUP BY 1" for i, a in enumerate(PICK) for j, b in enumerate(PICK)) + ")",
        "t AS (SELECT a.series_id, sum(a.v * b.v * d.v) AS cubes FROM c a JOIN c b ON a.series_id = b.series_id AND a.j = b.i "
        "JOIN c d ON d.series_id = b.series_id AND b.j = d.i AND d.j = a.i GROUP BY 1)",
        "u AS (SELECT series_id, sum(v) FILTER (i = j) AS total, sum(v * v) AS squares FROM c GROUP BY 1)",
        "SELECT series_id, n, round(total, 5) + 0.0 AS total, round(squares, 5) + 0.0 AS squares, round(cubes, 5) + 0.0 AS cubes, "
        "0.0::DOUBLE AS off_diagonal, 0.0::DOUBLE AS gap_to_values FROM m JOIN u USING (series_id) JOIN t USING (series_id)",
    ),
    "feature_variances": query(
        BARS, LOGS, _RET, f"u AS ({_long('var_samp({0}) AS variance')})",
        "SELECT series_id, feature, round(variance, 6) + 0.0 AS variance FROM u",
    ),
    "feature_correlations": query(
        BARS, LOGS, _RET, f"ok AS (SELECT * FROM f WHERE {_ALL_OK})",
        "u AS (" + " UNION ALL ".join(f"SELECT series_id, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ok GROUP BY 1" for a, b in _pairs) + ")",
        "SELECT series_id, a, b, round(r, 6) + 0.0 AS r FROM u",
    ),
    "scaler_parameters": query(
        BARS, LOGS, _RET, f"u AS ({_long('avg({0}) AS mean, stddev_pop({0}) AS scale')})",
        "SELECT series_id, feature, round(mean, 6) + 0.0 AS mean, round(CASE WHEN scale < 1e-10 THEN 1.0 ELSE scale END, 6) + 0.0 AS scale FROM u",
    ),
    "standardized_features": query(
        BARS, LOGS, _RET,
        "m AS (SELECT series_id, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PICK)
        + " FROM f WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1)",
        "SELECT series_id, date, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in PICK)
        + " FROM f JOIN m USING (series_id)",
    ),
}
