"""Whole chains over all dekads: correction in stages, its parameter sweeps and failing periods, verification with quality, station validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.functions.scalar import dekad_columns
from hyetos.operators import align, correction, density, metrics, network, order, quality, stations, taylor
from hyetos.params import Params
from hyetos.plans.stages import Stage, Stages

CELL = correction.CELL
PERIOD = correction.PERIOD
METHODS = {"ls": "scaled", "lseqm": "value", "lseqmdl": "blended"}


def chain(
    stages: Stages, pairs: Stage, params: Params, *, native: Stage | None = None, confidence: Stage | None = None, models: Stage | None = None, net: network.Network | None = None,
    shape: tuple[int, int] | None = None, training: Mapping | None = None, isolate: bool = False, mapper: Callable | None = None,
) -> dict[str, Stage]:
    """The stages scaled, parameters, mapped, models, predicted and blended; each is run once and read by all that follow.

    `pairs` has ref and test on (month, dekad, lat_i, lon_i, time). `native`: parameters fitted on the coarse reference
    and brought to this grid (`fine_parameters`); else both sides are fitted on the days they share. `models`: trained
    filters; else trained here: with `net` and `shape` the network, with `training` for its options, else the linear filter.
    `confidence`: (lat_i, lon_i, confidence). `isolate`: errors of a period become texts in its column `error`.
    """
    out = {"scaled": stages.stage("scaled", lambda p: correction.scale(p).withColumn("scaled", F.greatest("scaled", F.lit(0.0))), pairs)}
    options = {"wet": params.wet_day, "percentile": params.gpd_percentile}
    how = {"isolate": isolate, "mapper": mapper}
    if native is not None:
        made = lambda s, p: correction.quantile_map(s.select(*CELL, "time", "ref", F.col("scaled").alias("value")), p, **options, **how)
        out["parameters"] = native
    else:
        made = lambda s, p: correction.quantile_map_pairs(s.select(*CELL, "time", "ref", F.col("scaled").alias("test")), fitted=p, **options, **how)
        out["parameters"] = stages.stage("parameters", lambda s: correction.pair_parameters(s, **options), out["scaled"], **options)
    kept = [*CELL, "time", F.when(F.col("mapped").isNotNull(), F.greatest("mapped", F.lit(0.0))).alias("value"), "ref", *(["error"] if isolate else [])]
    said = {"native": native is not None, "isolate": isolate, "mapper": getattr(mapper, "__qualname__", None)}
    out["mapped"] = stages.stage("mapped", lambda s, p: made(s, p).select(*kept), out["scaled"], out["parameters"], **said, **options)
    well = lambda m: m.filter("error is null").drop("error") if isolate else m
    if net is not None:
        height, width = shape
        said = {"net": asdict(net), "shape": shape, "training": dict(training or {})}
        if models is None:
            fields = stages.stage("fields", lambda m: network.day_fields(well(m), height, width), out["mapped"], shape=shape)
            models = stages.stage("network", lambda f: network.train(f, height, width, net, **(training or {})), fields, **said)
        predict = lambda m, w: network.apply(m, w, height, width, net)
    else:
        said = {"net": None}
        models = models or stages.stage("filter", lambda m: correction.train_filter(well(m)), out["mapped"])
        predict = lambda m, w: correction.apply_filter(m, w)
    out["models"] = models
    # A cell's rows are brought together once, with their limit and the reference: all settings of the blending, and scores of them, follow without another shuffle.
    share = {"percentile": params.gpd_percentile}
    out["predicted"] = stages.stage("predicted", lambda m, w: correction.with_limits(predict(well(m), w), **share), out["mapped"], models, **said, **share)
    blending = {"alpha": params.blend_alpha, "limited": True}
    if confidence is None:
        out["blended"] = stages.stage("blended", lambda p: correction.blend(p, **blending), out["predicted"], **blending)
    else:
        known = lambda p, c: p.join(c.select("lat_i", "lon_i", "confidence"), ["lat_i", "lon_i"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        out["blended"] = stages.stage("blended", lambda p, c: correction.blend(known(p, c), confidence="confidence", **blending), out["predicted"], confidence, **blending)
    return out


def values_of(made: Mapping[str, Stage]) -> DataFrame:
    """(cell, time, method, value) for the methods ls, lseqm and lseqmdl."""
    take = lambda df, name, value: df.select(*CELL, "time", F.lit(name).alias("method"), F.col(value).alias("value"))
    return _union([take(made[stage].df, name, METHODS[name]) for name, stage in (("ls", "scaled"), ("lseqm", "mapped"), ("lseqmdl", "blended"))])


def correct(
    pairs: DataFrame, params: Params, *, native: DataFrame | None = None, confidence: DataFrame | None = None, models: DataFrame | None = None, stages: Stages | None = None, **options,
) -> DataFrame:
    """(cell, time, method, value) of `chain`. Tables, where stages are wanted again, are told apart by the caller's `stages`."""
    stages = stages or Stages(pairs.sparkSession)
    given = {k: stages.source(v) for k, v in (("native", native), ("confidence", confidence), ("models", models)) if v is not None}
    source = stages.source(pairs.select(*CELL, "time", "ref", "test"))
    stations.checked(source.df, ["ref", "test"], "the field")
    return values_of(chain(stages, source, params, **given, **options))


def period_status(pairs: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """(keys, n, message) of each period; the message says what keeps it from being corrected, else it is NULL."""
    r, t = F.col("ref"), F.col("test")
    found = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count(r).alias("_r"), F.count(t).alias("_t"), F.count(F.when(r.isNotNull() & t.isNotNull(), 1)).alias("_b"), F.count(F.when((r < 0) | (t < 0), 1)).alias("_neg"))
    message = F.when(F.col("_r") == 0, "no reference value").when(F.col("_t") == 0, "no test value").when(F.col("_b") == 0, "no day with both").when(F.col("_neg") > 0, "negative values")
    return found.select(*keys, "n", message.alias("message"))


def run_periods(stages: Stages, pairs: Stage, params: Params, keys: Sequence[str] = PERIOD, **options) -> tuple[DataFrame, DataFrame]:
    """(values of the periods that went well, status of all): one bad period doesn't stop the others.

    Periods that can't be corrected are left out beforehand. What fails in a task becomes the period's text; all its
    values are taken back. Status: keys, n, status (ok or failed), message. `report.pending` of the failed ones is the next run's plan.
    """
    keys = list(keys)
    before = stages.stage("guards", lambda p: period_status(p, keys), pairs)
    good = stages.stage("good", lambda p, s: p.join(s.filter("message is null"), keys, "left_semi"), pairs, before)
    made = chain(stages, good, params, isolate=True, **options)
    trained = made["models"].df.filter("weights is not null").select(*keys, F.lit(True).alias("trained"))
    failure = F.coalesce("failure", F.when(F.col("trained").isNull(), F.lit("no weights could be trained")))
    found = made["mapped"].df.groupBy(*keys).agg(F.min("error").alias("failure")).join(trained, keys, "left").select(*keys, failure.alias("failure")).filter("failure is not null")
    failed = stages.stage("failed", lambda m, w: found, made["mapped"], made["models"])
    status = before.df.join(failed.df, keys, "left").withColumn("message", F.coalesce("message", "failure")).drop("failure")
    status = status.withColumn("status", F.when(F.col("message").isNull(), "ok").otherwise("failed"))
    return values_of(made).join(failed.df, keys, "left_anti"), status


def confidence_table(stages: Stages, counts: Stage, rows: int, columns: int, sigma: float = 1.0, saturation: float = 2.0) -> Stage:
    """(lat_i, lon_i, confidence), built once for each table of counts, shape of the grid and parameters, and looked up afterwards."""
    said = {"shape": (rows, columns), "sigma": sigma}
    smooth = stages.stage("smooth", lambda c: density.gaussian(c.select("lat_i", "lon_i", F.col("count").cast("double").alias("value")), rows, columns, sigma), counts, **said)
    return stages.stage("confidence", lambda s: density.saturated(s, saturation), smooth, saturation=saturation)


def sweep(stages: Stages, pairs: Stage, counts: Stage, plan: Sequence[tuple[str, float, float, float]], params: Params, shape: tuple[int, int], **options) -> DataFrame:
    """(parameter, saturation, alpha, percentile, rmse, bias): the chain for each setting, and medians over cells of its errors.

    A setting runs anew only from the first stage on that depends on it; its scores are a stage too, so a broken sweep goes on.
    """
    rows = []
    for name, saturation, alpha, percentile in plan:
        own = replace(params, saturation=saturation, blend_alpha=alpha, gpd_percentile=percentile)
        sure = confidence_table(stages, counts, *shape, params.sigma, saturation)
        made = chain(stages, pairs, own, confidence=sure, **options)
        scored = stages.stage("scores", _scores, made["blended"])
        rows.append(scored.df.select(F.lit(name).alias("parameter"), *[F.lit(float(v)).alias(k) for k, v in (("saturation", saturation), ("alpha", alpha), ("percentile", percentile))], "rmse", "bias"))
    return _union(rows)


def _scores(blended: DataFrame) -> DataFrame:
    off = F.col("blended") - F.col("ref")
    cells = blended.filter("ref is not null").groupBy(*CELL).agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"))
    # Kept, as exact medians read their rows twice.
    return order.medians(order.kept(cells), [], ["rmse", "bias"])


def fine_parameters(coarse: DataFrame, lat: tuple[DataFrame, DataFrame], lon: tuple[DataFrame, DataFrame], values: Sequence[str] = correction.PARAMETERS) -> DataFrame:
    """Parameters fitted on a coarse grid, at finer coordinates: bilinear, else nearest, and kept in their ranges.

    `coarse` has lat and lon; `lat` and `lon` are (source axis, target axis).
    """
    keys = ["month", "dekad"]
    near = align.regrid_nearest(coarse, align.nearest(*lat), align.nearest(*lon), values, keys)
    linear = align.regrid_bilinear(coarse, align.brackets(*lat), align.brackets(*lon), values, keys)
    out = align.fill_from(linear, near, [*keys, "lat", "lon"], values)
    least = {c: F.greatest(F.col(c), F.lit(1e-6)) for c in ("gamma_shape", "gamma_scale") if c in values}
    share = {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in ("p_dry",) if c in values}
    return out.withColumns({k: F.when(F.col(k).isNotNull(), v) for k, v in (least | share).items()})


def verify(references: Mapping[str, DataFrame], methods: Mapping[str, DataFrame], params: Params, keys: Sequence[str] = CELL, by_year: bool = False, pvalue: bool = True) -> DataFrame:
    """Metrics and quality of every reference with every method: their names are grouping keys, so all run as one job.

    Without `pvalue` the distance of the distributions, from one, stands for its p-value, for engines that have no such function.
    """
    tag = lambda frames, name: _union([df.select(*keys, "time", "value").withColumn(name, F.lit(k)) for k, df in frames.items()])
    r, t = tag(references, "reference").withColumnRenamed("value", "ref"), tag(methods, "method").withColumnRenamed("value", "test")
    return _verified(r.join(t, [*keys, "time"]), params, keys, by_year, pvalue)


def verify_columns(rows: DataFrame, references: Mapping[str, Column], methods: Mapping[str, Column], params: Params, keys: Sequence[str] = CELL, by_year: bool = False, pvalue: bool = True) -> DataFrame:
    """`verify` of series that stand side by side in the same rows: nothing is joined, and rows that lie together by their keys stay there."""
    pairs = [F.struct(F.lit(a).alias("reference"), F.lit(b).alias("method"), r.cast("double").alias("ref"), t.cast("double").alias("test")) for a, r in references.items() for b, t in methods.items()]
    return _verified(rows.select(*keys, "time", F.explode(F.array(*pairs)).alias("_p")).select(*keys, "time", "_p.*"), params, keys, by_year, pvalue)


def _verified(pairs: DataFrame, params: Params, keys: Sequence[str], by_year: bool, pvalue: bool) -> DataFrame:
    run = metrics.yearly if by_year else metrics.metrics31
    made = run(pairs, ["reference", "method", *keys], params.wet_day, pvalue=pvalue)
    return quality.assess(made if pvalue else made.withColumn("ks_pvalue", 1 - F.col("ks_stat")), params.quality_weights, params.categories)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def taylor_pass(obs: DataFrame, cells: DataFrame, places: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame, keys: Sequence[str] = ("product", "station_id", *PERIOD)) -> DataFrame:
    """Taylor statistics by product, station, month and dekad: grids at the stations, paired with their series.

    `obs`: (station_id, time, value); `cells`: (lat, lon, time, product, value).
    """
    at = align.station_cells(places.select("station_id", "lat", "lon"), lat_axis, lon_axis)
    # Series get their cell first and meet it day by day: a cell's days aren't spread over all its stations before they are paired.
    series = obs.select("station_id", "time", F.col("value").alias("ref")).join(at, "station_id")
    pairs = series.join(cells.withColumnRenamed("value", "test"), ["lat", "lon", "time"]).withColumns(dekad_columns())
    return taylor.stats(taylor.sums(pairs, list(keys)))


def validate(obs: DataFrame, cells: DataFrame, places: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics of each station with its metadata, scores by threshold, description of the metrics).

    `obs`: (station_id, time, value); `cells`: (lat, lon, time, value); `places`: station_id, lat, lon and metadata. An
    error where the two sides have no values, or share no day of a station.
    """
    at = align.at_stations(cells.select("lat", "lon", "time", "value"), places.select("station_id", "lat", "lon"), lat_axis, lon_axis)
    pairs = metrics.paired(stations.checked(obs, ["value"], "the observations"), stations.checked(at, ["value"], "the grid at the stations"), ["station_id", "time"])
    if pairs.isEmpty():
        raise ValueError("observations and grid share no day of a station")
    each = stations.station_metrics(pairs, threshold=params.wet_day, min_days=params.min_valid_days)
    scores = stations.multi_threshold(pairs, thresholds=params.thresholds, min_days=params.min_valid_days, min_events=params.min_events)
    return stations.with_metadata(each, places), scores, stations.describe(each, ["station_id"], metrics.NAMES)
