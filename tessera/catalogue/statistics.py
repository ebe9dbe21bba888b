"""Statistics over the result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.catalogue import query
from tessera.fixtures import METRICS, with_views
from tessera.operators import statistics as st

KEY = "location_id"


def r(name, digits=6):
    return F.round(F.col(name), digits).alias(name)


def oracle(sql, ctes=""):
    return with_views(sql, "location_metrics", ctes=ctes)


def table(spark, sf_dir):
    return fx.location_metrics(spark, sf_dir)


LONG = "long AS (UNPIVOT location_metrics ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)"

BOUNDS = LONG + ", b AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY metric)"


@query(
    "describe",
    oracle(
        """SELECT metric, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
          round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
          round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
          round(max(value), 6) AS max FROM long GROUP BY metric""",
        LONG,
    ),
)
def describe(spark, sf_dir):
    names = ["mean", "std", "min", "q1", "median", "q3", "max"]
    return st.describe(table(spark, sf_dir), METRICS).select("metric", "count", *map(r, names))


@query(
    "metric_summary",
    oracle(
        """SELECT metric, round(min(value), 6) AS min, round(max(value), 6) AS max,
          round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1,
          round(quantile_cont(value, 0.75), 6) AS q3 FROM long GROUP BY metric""",
        LONG,
    ),
)
def metric_summary(spark, sf_dir):
    names = ["min", "max", "median", "q1", "q3"]
    out = st.metric_summary(table(spark, sf_dir), [*METRICS, "absent"])
    return out.select("metric", *map(r, names))


@query(
    "correlation",
    oracle("SELECT round(corr(sparsity, permeability), 6) AS correlation FROM location_metrics"),
)
def correlation(spark, sf_dir):
    return st.correlation(table(spark, sf_dir), "sparsity", "permeability").select(r("correlation"))


def _corr_sql(condition):
    parts = []
    for i, x in enumerate(METRICS):
        for j, y in enumerate(METRICS):
            both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
            parts.append(
                f"""SELECT {i} AS i, {j} AS j, '{x}' AS metric_x, '{y}' AS metric_y,
                round((covar_pop({x}, {y}) {both}) / nullif((stddev_pop({x}) {both}) * (stddev_pop({y}) {both}), 0), 6)
                AS correlation FROM location_metrics"""
            )
    body = " UNION ALL ".join(parts)
    return oracle(
        f"SELECT metric_x, metric_y, correlation, j < i AS lower_triangle FROM ({body}) WHERE {condition}"
    )


@query("correlation_matrix", _corr_sql("true"))
def correlation_matrix(spark, sf_dir):
    return st.correlation_matrix(table(spark, sf_dir), METRICS).select(
        "metric_x", "metric_y", r("correlation"), "lower_triangle"
    )


@query("correlation_pairs", _corr_sql("i < j"))
def correlation_pairs(spark, sf_dir):
    out = st.correlation_matrix(table(spark, sf_dir), METRICS).filter("pair")
    return out.select("metric_x", "metric_y", r("correlation"), "lower_triangle")


def _scaled_sql(form):
    picks = ", ".join(
        f"round({form.format(m=m)}, 6) AS {m}_normalized" for m in METRICS
    )
    limits = ", ".join(f"min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in METRICS)
    return oracle(
        f"SELECT location_id, {picks} FROM location_metrics, (SELECT {limits} FROM location_metrics)"
    )


@query(
    "normalise",
    _scaled_sql(
        "CASE WHEN {m} IS NOT NULL THEN least(greatest(({m} - lo_{m}) / greatest(hi_{m} - lo_{m}, 1e-9), 0), 1) END"
    ),
)
def normalise(spark, sf_dir):
    out = st.normalise_minmax(table(spark, sf_dir), METRICS)
    return out.select(KEY, *[r(f"{m}_normalized") for m in METRICS])


@query(
    "metric_scale",
    oracle("SELECT metric, lo, hi FROM b", BOUNDS),
)
def metric_scale(spark, sf_dir):
    return st.bounds(table(spark, sf_dir), METRICS)


@query(
    "normalise_guarded",
    _scaled_sql("CASE WHEN hi_{m} = lo_{m} THEN 0 ELSE ({m} - lo_{m}) / nullif(hi_{m} - lo_{m}, 0) END"),
)
def normalise_guarded(spark, sf_dir):
    out = st.normalise_isclose(table(spark, sf_dir), METRICS)
    return out.select(KEY, *[F.round(m, 6).alias(f"{m}_normalized") for m in METRICS])


@query("normalise_unguarded", _scaled_sql("({m} - lo_{m}) / nullif(hi_{m} - lo_{m}, 0)"))
def normalise_unguarded(spark, sf_dir):
    out = st.normalise_isclose(table(spark, sf_dir), METRICS, guarded=False)
    return out.select(KEY, *[F.round(m, 6).alias(f"{m}_normalized") for m in METRICS])


@query(
    "relative_position",
    oracle(
        """SELECT location_id, metric, value, round((value - lo) / span, 6) AS position,
          round((q1 - lo) / span, 6) AS q1_position, round((med - lo) / span, 6) AS median_position,
          round((q3 - lo) / span, 6) AS q3_position
        FROM long JOIN (SELECT metric, min(value) AS lo, greatest(max(value) - min(value), 1e-9) AS span,
          quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
          FROM long GROUP BY metric) USING (metric)""",
        LONG,
    ),
)
def relative_position(spark, sf_dir):
    names = ["position", "q1_position", "median_position", "q3_position"]
    return st.relative_position(table(spark, sf_dir), METRICS).select(
        KEY, "metric", "value", *map(r, names)
    )


def _histogram_sql(bins):
    return oracle(
        f"""SELECT metric, CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_start,
          round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_end, count(value) AS count
        FROM w CROSS JOIN range({bins}) t(bin) LEFT JOIN (
          SELECT metric AS m, value, least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) AS k
          FROM long JOIN w USING (metric)) ON m = metric AND k = bin
        GROUP BY metric, bin, lo, hi""",
        BOUNDS
        + """, w AS (SELECT metric, CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS lo,
          CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS hi FROM b)""",
    )


for _bins in (20, 16):

    @query(f"histogram_{_bins}", _histogram_sql(_bins))
    def histogram(spark, sf_dir, bins=_bins):
        return st.histogram(table(spark, sf_dir), METRICS, bins).select(
            "metric", "bin", r("bin_start"), r("bin_end"), "count"
        )


@query(
    "kde",
    oracle(
        """SELECT metric, CAST(i AS INTEGER) AS i, round(any_value(x), 6) AS x,
          round(sum(exp(-0.5::DOUBLE * power((x - value) / bw, 2)) / (n * bw)) / sqrt(2 * pi()), 6) AS density
        FROM (SELECT metric, i, n, bw, lo - 3 * bw + (hi + 3 * bw - (lo - 3 * bw)) * i / 199.0::DOUBLE AS x
          FROM (SELECT metric, count(value) AS n, min(value) AS lo, max(value) AS hi,
            stddev_samp(value) * power(count(value), -0.2::DOUBLE) AS bw FROM long GROUP BY metric HAVING stddev_samp(value) > 0),
          range(200) t(i)) JOIN long USING (metric) GROUP BY metric, i""",
        LONG,
    ),
)
def kde(spark, sf_dir):
    out = st.density_curve(table(spark, sf_dir), METRICS)
    return out.select("metric", "i", r("x"), r("density"))


@query(
    "boxplot",
    oracle(
        """SELECT metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          round(min(v) FILTER (v BETWEEN q1 - reach AND q3 + reach), 6) AS whisker_low,
          round(max(v) FILTER (v BETWEEN q1 - reach AND q3 + reach), 6) AS whisker_high,
          count(*) FILTER (NOT v BETWEEN q1 - reach AND q3 + reach) AS outliers
        FROM scaled JOIN (SELECT metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
            quantile_cont(v, 0.75) AS q3, 1.5::DOUBLE * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS reach
          FROM scaled GROUP BY metric) USING (metric) GROUP BY metric, q1, median, q3""",
        BOUNDS
        + """, scaled AS (SELECT metric, (value - lo) / (hi - lo) AS v FROM long JOIN b USING (metric) WHERE hi > lo)""",
    ),
)
def boxplot(spark, sf_dir):
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return st.box_plot(table(spark, sf_dir), METRICS).select("metric", *map(r, names), "outliers")


def _pairplot_sql():
    limits = ", ".join(f"min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in METRICS)
    scale = "({m} - lo_{m}) / greatest(hi_{m} - lo_{m}, 1e-9)"
    parts = [
        f"""SELECT location_id, '{METRICS[i]}' AS x_metric, '{METRICS[j]}' AS y_metric,
          {METRICS[i]} AS x, {METRICS[j]} AS y, round({scale.format(m=METRICS[i])}, 6) AS x_normalized,
          round({scale.format(m=METRICS[j])}, 6) AS y_normalized FROM s"""
        for j in range(len(METRICS))
        for i in range(j)
    ]
    return oracle(
        " UNION ALL ".join(parts),
        f"s AS (SELECT * FROM location_metrics, (SELECT {limits} FROM location_metrics))",
    )


@query("pairplot_frame", _pairplot_sql())
def pairplot_frame(spark, sf_dir):
    return st.pairplot_frame(table(spark, sf_dir), METRICS).select(
        KEY, "x_metric", "y_metric", "x", "y", r("x_normalized"), r("y_normalized")
    )


@query("highlight", oracle("SELECT * FROM location_metrics WHERE location_id = 42"))
def highlight(spark, sf_dir):
    return st.highlight(table(spark, sf_dir), 42)


@query(
    "geo_extent",
    oracle(
        """SELECT min(latitude) AS min_latitude, max(latitude) AS max_latitude,
          min(longitude) AS min_longitude, max(longitude) AS max_longitude FROM location_metrics"""
    ),
)
def geo_extent(spark, sf_dir):
    return st.geographic_extent(table(spark, sf_dir))


@query(
    "stat_cards",
    oracle(
        """SELECT count(*) AS locations, round(avg(sparsity), 6) AS mean_sparsity, round(avg(resilience), 6) AS mean_resilience,
          round(avg(multi_nodality), 6) AS mean_multi_nodality, round(avg(permeability), 6) AS mean_permeability,
          round(max(sparsity), 6) AS max_sparsity, round(max(resilience), 6) AS max_resilience,
          round(corr(sparsity, resilience), 6) AS sparsity_resilience_correlation FROM location_metrics"""
    ),
)
def stat_cards(spark, sf_dir):
    out = st.stat_cards(table(spark, sf_dir))
    return out.select("locations", *[r(c) for c in out.columns if c != "locations"])


@query(
    "representative_points",
    oracle(
        """SELECT location_id, CAST(quadrant AS INTEGER) AS quadrant, multi_nodality FROM (
          SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY multi_nodality, location_id) - 1 AS k,
            count(*) OVER (PARTITION BY quadrant) AS n
          FROM (SELECT *, CASE WHEN sparsity <= ms THEN 0 ELSE 1 END + CASE WHEN resilience <= mr THEN 0 ELSE 2 END AS quadrant
            FROM location_metrics, (SELECT median(sparsity) AS ms, median(resilience) AS mr FROM location_metrics)))
        WHERE n < 3 OR k IN (n // 4, n // 2, 3 * n // 4)"""
    ),
)
def representative_points(spark, sf_dir):
    return st.representative_points(table(spark, sf_dir)).select(KEY, "quadrant", "multi_nodality")


@query(
    "value_counts",
    with_views("SELECT type, count(*) AS count FROM buildings GROUP BY type", "buildings"),
)
def value_counts(spark, sf_dir):
    return st.value_counts(fx.buildings(spark, sf_dir), "type")


def _title(column):
    return f"""array_to_string(list_transform(string_split({column}, '_'),
      lambda w: upper(w[1]) || w[2:]), ' ')"""


def _report_sql():
    pairs = []
    for i, x in enumerate(METRICS):
        for y in METRICS[i + 1 :]:
            both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
            pairs.append(
                f"""SELECT 'correlation' AS section, '{x}' AS a, '{y}' AS b,
                (covar_pop({x}, {y}) {both}) / nullif((stddev_pop({x}) {both}) * (stddev_pop({y}) {both}), 0) AS value
                FROM location_metrics"""
            )
    return oracle(
        f"""SELECT section, {_title('a')} AS item, statistic, round(value, 6) AS value FROM (
          SELECT 'summary' AS section, metric AS a, statistic, value FROM (
            UNPIVOT (SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
              FROM long GROUP BY metric) ON mean, std, min, max INTO NAME statistic VALUE value)
          UNION ALL SELECT section, a, {_title('b')}, value FROM ({" UNION ALL ".join(pairs)}))
        UNION ALL SELECT 'extent', item, statistic, round(value, 6) FROM (
          SELECT 'latitude' AS item, 'min' AS statistic, min(latitude) AS value FROM location_metrics
          UNION ALL SELECT 'latitude', 'max', max(latitude) FROM location_metrics
          UNION ALL SELECT 'longitude', 'min', min(longitude) FROM location_metrics
          UNION ALL SELECT 'longitude', 'max', max(longitude) FROM location_metrics)""",
        LONG,
    )


@query("report", _report_sql())
def report(spark, sf_dir):
    return st.report(table(spark, sf_dir), METRICS).select("section", "item", "statistic", r("value"))
