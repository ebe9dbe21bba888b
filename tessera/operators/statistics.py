"""Table-wide statistics over the result table.

Sums, extremes and moments are single map-combined aggregates; one-row results are used as scalar
subqueries. Quantiles and ranks go through the range-partitioned helpers, so no step sorts or
holds a whole column in one task. Null and NaN are both skipped, as pandas does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import fixed, title_case
from tessera.operators.ordering import exact_quantiles, running_positions, usable

KEY = "location_id"
#: Groups of tasks whose arrays are added up first.
MERGE_PARTS = 64
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def present(df: DataFrame, metrics: list[str]) -> list[str]:
    return [m for m in metrics if m in df.columns]


def long_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """``location_id, metric, value`` without null, NaN."""
    columns = [usable(F.col(m).cast("double")).alias(m) for m in present(df, metrics)]
    wide = df.select(KEY, *columns)
    return wide.unpivot([KEY], present(df, metrics), "metric", "value").filter("value IS NOT NULL")


def _per_metric(df: DataFrame, metrics: list[str], aggregates: dict) -> DataFrame:
    """One aggregate pass over the wide table, returned as one row per metric."""
    names = present(df, metrics)
    row = df.agg(
        *[
            F.struct(F.lit(m).alias("metric"), *[f(usable(F.col(m))).alias(a) for a, f in aggregates.items()]).alias(m)
            for m in names
        ]
    )
    return row.select(F.inline(F.array(*names)))


def bounds(df: DataFrame, metrics: list[str]) -> DataFrame:
    return _per_metric(df, metrics, {"lo": F.min, "hi": F.max})


def _scalar_bounds(df: DataFrame, column: str) -> Column:
    value = usable(F.col(column))
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()


def describe(df: DataFrame, metrics: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per metric."""
    moments = _per_metric(
        df,
        metrics,
        {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )
    quartiles = exact_quantiles(long_metrics(df, metrics), ["metric"], "value", QUARTILES)
    return moments.join(F.broadcast(quartiles), "metric", "left")


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """min, max, median, q1, q3; metrics that are absent or empty are left out."""
    extremes = _per_metric(df, metrics, {"min": F.min, "max": F.max}).filter("min IS NOT NULL")
    quartiles = exact_quantiles(long_metrics(df, metrics), ["metric"], "value", QUARTILES)
    return extremes.join(F.broadcast(quartiles), "metric")


def _pearson(x: str, y: str) -> Column:
    # corr() raises on a constant column under ANSI, so divide explicitly.
    a = F.when(usable(F.col(y)).isNotNull(), usable(F.col(x)))
    b = F.when(usable(F.col(x)).isNotNull(), usable(F.col(y)))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(_pearson(x, y).alias("correlation"))


def correlation_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Long matrix over pairwise-complete rows, all pairs in one aggregate pass."""
    names = present(df, metrics)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*[_pearson(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(names[i]).alias("metric_x"),
            F.lit(names[j]).alias("metric_y"),
            F.col(f"c{min(i, j)}_{max(i, j)}").alias("correlation"),
            F.lit(j < i).alias("lower_triangle"),
            F.lit(i < j).alias("pair"),
        )
        for i in range(len(names))
        for j in range(len(names))
    ]
    return row.select(F.inline(F.array(*cells)))


def _clip01(value: Column) -> Column:
    # greatest/least skip nulls, so a missing value must be kept missing by hand.
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def normalise_minmax(df: DataFrame, metrics: list[str]) -> DataFrame:
    """``<metric>_normalized`` in [0, 1]; a constant metric becomes 0."""
    out = df
    for m in present(df, metrics):
        b = _scalar_bounds(df, m)
        span = F.greatest(b.getField("hi") - b.getField("lo"), F.lit(1e-9))
        out = out.withColumn(
            f"{m}_normalized", _clip01((usable(F.col(m)) - b.getField("lo")) / span)
        )
    return out


def _is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def normalise_isclose(df: DataFrame, metrics: list[str], guarded: bool = True) -> DataFrame:
    """In-place min-max; a (nearly) constant metric is 0 when guarded, else null if constant."""
    out = df
    for m in present(df, metrics):
        b = _scalar_bounds(df, m)
        lo, hi = b.getField("lo"), b.getField("hi")
        scaled = F.try_divide(usable(F.col(m)) - lo, hi - lo)
        out = out.withColumn(m, F.when(_is_close(hi, lo), 0.0).otherwise(scaled) if guarded else scaled)
    return out


def relative_position(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Each location's value and the quartiles on the [0, 1] scale of min..max."""
    summary = metric_summary(df, metrics)
    span = F.greatest(F.col("max") - F.col("min"), F.lit(1e-9))

    def scaled(column: str) -> Column:
        return _clip01((F.col(column) - F.col("min")) / span)

    return (
        long_metrics(df, metrics)
        .join(F.broadcast(summary), "metric")  # one row per metric
        .select(
            KEY,
            "metric",
            "value",
            scaled("value").alias("position"),
            scaled("q1").alias("q1_position"),
            scaled("median").alias("median_position"),
            scaled("q3").alias("q3_position"),
        )
    )


def histogram(df: DataFrame, metrics: list[str], bins: int = 20) -> DataFrame:
    """Equal-width counts per metric, empty bins included."""
    limits = bounds(df, metrics).filter("lo IS NOT NULL")
    # A constant column gets a unit-wide range round its value.
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ranged = F.broadcast(limits.select("metric", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi")))
    slot = F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
        F.lit(bins - 1),
    )
    counts = (
        long_metrics(df, metrics)
        .join(ranged, "metric")
        .groupBy("metric", slot.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (
        ranged.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .join(counts, ["metric", "bin"], "left")
        .select(
            "metric",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("count"),
        )
    )


def density_curve(df: DataFrame, metrics: list[str], points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid.

    Every task adds its values' kernels up in one array of ``points`` numbers for each metric; only these
    arrays move, and are added by position in two steps.
    """
    shape = _per_metric(
        df, metrics, {"n": F.count, "sd": F.stddev_samp, "lo": F.min, "hi": F.max}
    ).filter("sd > 0")
    width = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    shape = shape.withColumn("bw", width)
    start, stop = F.col("lo") - cut * F.col("bw"), F.col("hi") + cut * F.col("bw")
    grid_at = start + (stop - start) * F.col("i") / F.lit(float(points - 1))
    spans = {  # one row for each of the named metrics
        r.metric: (r.start + (r.stop - r.start) * np.arange(points) / float(points - 1), r.bw)
        for r in shape.select("metric", start.alias("start"), stop.alias("stop"), "bw").collect()
    }

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            for name in set(names) & set(spans):
                at, bw = spans[name]
                own = values[names == name]
                for lo in range(0, len(own), 1000):
                    z = (at[None, :] - own[lo : lo + 1000, None]) / bw
                    totals[name] = totals.get(name, 0.0) + np.exp(-0.5 * z * z).sum(axis=0)
        yield _arrays(totals)

    def added(rows: pa.Table) -> pa.Table:
        totals = {}
        for name, k in zip(rows.column("metric").to_pylist(), rows.column("k").to_pylist()):
            totals[name] = totals.get(name, 0.0) + np.array(k)
        return pa.Table.from_batches([_arrays(totals)])

    values = long_metrics(df, metrics).select("metric", F.col("value").cast("double").alias("value"))
    kind = "metric string, k array<double>"
    parts = values.mapInArrow(kernels, kind)
    deal = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    merged = parts.withColumn("part", deal).groupBy("metric", "part").applyInArrow(added, kind)
    total = merged.groupBy("metric").applyInArrow(added, kind)
    return (
        total.join(F.broadcast(shape), "metric")  # one row per metric
        .select("metric", "n", "bw", "lo", "hi", F.posexplode("k").alias("i", "k"))
        .select(
            "metric", "i", grid_at.alias("x"),
            (F.col("k") / (F.col("n") * F.col("bw")) / F.lit(math.sqrt(2 * math.pi))).alias("density"),
        )
    )


def _arrays(totals: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()), pa.array([list(k) for k in totals.values()], pa.list_(pa.float64()))],
        ["metric", "k"],
    )


def box_plot(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers and outlier count of the min-max scaled metrics."""
    scaled = normalise_isclose(df, metrics, guarded=False)
    values = long_metrics(scaled, metrics)
    quartiles = F.broadcast(exact_quantiles(values, ["metric"], "value", QUARTILES))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        values.join(quartiles, "metric")
        .groupBy("metric", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def pairplot_frame(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Lower-triangle scatter rows, built within the row: no self-join, no shuffle."""
    names = present(df, metrics)
    scaled = normalise_minmax(df, names)
    panels = [
        F.struct(
            F.lit(names[i]).alias("x_metric"),
            F.lit(names[j]).alias("y_metric"),
            F.col(names[i]).alias("x"),
            F.col(names[j]).alias("y"),
            F.col(f"{names[i]}_normalized").alias("x_normalized"),
            F.col(f"{names[j]}_normalized").alias("y_normalized"),
        )
        for j in range(len(names))
        for i in range(j)
    ]
    return scaled.select(KEY, F.inline(F.array(*panels)))


def highlight(df: DataFrame, location_id: int) -> DataFrame:
    return df.filter(F.col(KEY) == location_id).limit(1)


def geographic_extent(df: DataFrame) -> DataFrame:
    return df.agg(
        *[
            f(c).alias(f"{n}_{c}")
            for c in ("latitude", "longitude")
            for n, f in (("min", F.min), ("max", F.max))
        ]
    )


def stat_cards(df: DataFrame) -> DataFrame:
    means = ["sparsity", "resilience", "multi_nodality", "permeability"]
    return df.agg(
        F.count("*").alias("locations"),
        *[F.avg(usable(F.col(m))).alias(f"mean_{m}") for m in means],
        F.max("sparsity").alias("max_sparsity"),
        F.max("resilience").alias("max_resilience"),
        _pearson("sparsity", "resilience").alias("sparsity_resilience_correlation"),
    )


def representative_points(df: DataFrame) -> DataFrame:
    """Low, middle and high multi-nodality picks from each median quadrant."""
    medians = exact_quantiles(
        long_metrics(df, ["sparsity", "resilience"]), ["metric"], "value", {"median": 0.5}
    )

    def median(metric: str) -> Column:
        return medians.filter(F.col("metric") == metric).select("median").scalar()

    side = F.when(F.col("sparsity") <= median("sparsity"), 0).when(
        F.col("sparsity") > median("sparsity"), 1
    )
    level = F.when(F.col("resilience") <= median("resilience"), 0).when(
        F.col("resilience") > median("resilience"), 2
    )
    quartered = df.withColumn("quadrant", side + level).filter("quadrant IS NOT NULL")
    placed = running_positions(
        quartered, ["quadrant"], [F.col("multi_nodality").asc_nulls_last(), F.col(KEY)]
    )
    n, at = F.col("group_total"), F.col("before")
    picks = F.array(F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4))
    return placed.filter((n < 3) | F.array_contains(picks, at)).drop("before", "group_total")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def report(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Summary, correlations and extent as one long table."""
    stats = describe(df, metrics).unpivot(
        ["metric"], ["mean", "std", "min", "max"], "statistic", "value"
    )
    summary = stats.select(
        F.lit("summary").alias("section"),
        title_case(F.col("metric")).alias("item"),
        F.col("statistic"),
        "value",
    )
    pairs = correlation_matrix(df, metrics).filter("pair").select(
        F.lit("correlation").alias("section"),
        title_case(F.col("metric_x")).alias("item"),
        title_case(F.col("metric_y")).alias("statistic"),
        F.col("correlation").alias("value"),
    )
    box = geographic_extent(df)
    where = box.select(
        F.lit("extent").alias("section"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("item"),
                        F.lit(n).alias("statistic"),
                        F.col(f"{n}_{c}").alias("value"),
                    )
                    for c in ("latitude", "longitude")
                    for n in ("min", "max")
                ]
            )
        ),
    )
    return summary.unionByName(pairs).unionByName(where)


# --- table rows ---------------------------------------------------------------------------


def clean_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Infinities count as missing; rows missing any metric are dropped."""
    out = df
    for m in present(df, metrics):
        value = usable(F.col(m))
        out = out.withColumn(m, F.when(F.abs(value) != F.lit(float("inf")), value))
    return out.dropna(subset=present(df, metrics))


TABLE_COLUMNS = [
    "location_id", "name", "latitude", "longitude", "sparsity", "resilience", "multi_nodality",
    "permeability", "emergence", "overlap",
]


def formatted_table(df: DataFrame, columns: list[str] = TABLE_COLUMNS, n: int = 15) -> DataFrame:
    """The first ``n`` rows with the numbers as 4-decimal strings (missing: ``nan``)."""

    def shown(name: str) -> Column:
        if dict(df.dtypes)[name] != "double":
            return F.col(name)
        text = fixed(F.col(name), 4)
        return F.when(usable(F.col(name)).isNull(), F.lit("nan")).otherwise(text).alias(name)

    return df.orderBy(KEY).limit(n).select(*[shown(c) for c in present(df, columns)])


def bubble_size(df: DataFrame, column: str, small: float = 40.0, large: float = 220.0) -> Column:
    b = _scalar_bounds(df, column)
    lo, hi = b.getField("lo"), b.getField("hi")
    scaled = F.lit(small) + (F.col(column) - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(large - small)
    return F.when(hi > lo, scaled).otherwise(F.lit(100.0))


def degree_distance(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = lat - lat2, lon - lon2
    return F.sqrt(dlat * dlat + dlon * dlon)


def nearest_location(df: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """The row closest to a point, in degrees; a top-1, not a sort."""
    distance = degree_distance(
        F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude)
    )
    return df.orderBy(distance, KEY).limit(1)


def nearest_site(df: DataFrame, sites: DataFrame, max_sites: int = 1000) -> DataFrame:
    """The closest of a short list of sites for every row; the list rides along as one array.

    ``sites`` has ``location_id, latitude, longitude, name, radius``. Longer lists than
    ``max_sites`` are searched through a pyramid of cells instead, with the same result. A row without finite coordinates has no site.
    """
    listed = sites.select(
        F.col(KEY).alias("site_id"),
        F.col("latitude").alias("site_lat"),
        F.col("longitude").alias("site_lon"),
        F.col("name").alias("site"),
        "radius",
    )
    rows = listed.limit(max_sites + 1).collect()
    if len(rows) > max_sites:
        from tessera.operators.proximity import nearest_targets

        plane, place = F.lit(0).alias("_plane"), ["latitude", "longitude"]
        probes = df.select(
            plane, *place, F.col("longitude").cast("double").alias("px"), F.col("latitude").cast("double").alias("py")
        ).distinct()
        targets = listed.select(
            plane, "site_id", F.col("site_lon").alias("tx"), F.col("site_lat").alias("ty")
        )
        found = nearest_targets(probes, targets, place, "site_id", size=0.5, plane="_plane")
        sites_found = found.select(*place, "site_id").join(listed.drop("site_lat", "site_lon"), "site_id")
        kept = [c for c in df.columns if c not in ("site_id", "site", "radius")]
        return df.select(kept).join(sites_found, place, "left").select(*kept, "site_id", "site", "radius")
    columns = ["site_id", "site", "radius"]
    array = F.array(
        *[F.struct(*[F.lit(row[c]).alias(c) for c in listed.columns]) for row in rows]
    )
    best = F.array_min(
        F.transform(
            array,
            lambda s: F.struct(
                degree_distance(F.col("latitude"), F.col("longitude"), s.site_lat, s.site_lon).alias("d"),
                *[s.getField(c).alias(c) for c in columns],
            ),
        )
    )
    finite = (F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf"))
    return df.withColumn("_best", F.when(finite, best)).select(
        *[c for c in df.columns if c not in columns], *[F.col(f"_best.{c}").alias(c) for c in columns]
    )
