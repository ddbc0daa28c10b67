"""Command line: ``python -m plumbline.cli COMMAND ...``; errors end with status 2."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import BASIS
from .operators import crossval, figures, raster, verify
from .operators.selection import RATES, SIGMAS, Rules, has_sigmas, require_columns, require_unique
from .plans import pipelines
from .plans.lineage import cut
from .plans.report import build_report, labeled_path
from .plans.ship import ship_package
from .sources import geotiff, sinks, tables
from .sources.metadata import SIGMA_MODEL, load_metadata

STATION_COLUMNS = ("station_id", "longitude_deg", "latitude_deg", *RATES)
NOTE = "Preflight checks structure, not whether the declared conventions are true."


def session() -> SparkSession:
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    spark.dataSource.register(geotiff.GeoTiffSource)
    return spark


def load_raster(spark: SparkSession, path: str, raster_id: str) -> tuple[DataFrame, DataFrame]:
    """Cells and header of a GeoTIFF, or of a Parquet pair ``<path>`` and
    ``<path>.meta.parquet``."""
    if str(path).endswith(".parquet"):
        cells, meta = spark.read.parquet(str(path)), spark.read.parquet(f"{path}.meta.parquet")
        return cells.withColumn("raster_id", F.lit(raster_id)), meta.withColumn("raster_id", F.lit(raster_id))
    row = geotiff.meta_row(path, raster_id)
    meta = spark.createDataFrame([tuple(row.values())], "raster_id string, crs string, width int, height int, a double, b double, c double, d double, e double, f double, nodata double, dtype string, band_count int")
    return spark.read.format("geotiff").option("rasterId", raster_id).load(str(path)), meta


def _rules(a: argparse.Namespace) -> Rules:
    status = {}
    for text in a.require_status:
        column, mark, value = text.partition("=")
        if not mark or not column.strip() or not value.strip():
            raise ValueError(f"expected COLUMN=VALUE, not {text!r}")
        status[column.strip()] = value.strip()
    return Rules(tuple(sorted(set(a.exclude_station_id))), status, a.min_duration_years, a.min_distance_from_fitting_m, a.max_component_sigma, a.deduplicate_within_m)


def _selection(r: Rules) -> dict:
    return {"exclude_station_ids": list(r.exclude_ids), "require_status": [f"{k}={v}" for k, v in r.require_status.items()], "min_duration_years": r.min_duration_years, "min_distance_from_fitting_m": r.min_distance_from_fitting_m, "deduplicate_within_m": r.deduplicate_within_m, "max_component_sigma": r.max_component_sigma}


def compare(a: argparse.Namespace) -> None:
    """``validate los`` and ``validate vlm``."""
    paths = {"stations": a.stations, "metadata": a.metadata, **({"vlm": a.vlm} if a.mode == "vlm" else {k: getattr(a, k) for k in ("los", "incidence", "heading")})}
    _exist(paths.values())
    rules = _rules(a)
    if a.tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    out = sinks.prepare_output(a.output_dir, a.overwrite)
    spark = session()
    stations = tables.with_source_row(tables.read_stations(spark, a.stations))
    require_columns(stations, STATION_COLUMNS)
    metadata = load_metadata(a.metadata, a.mode, any(s in stations.columns for s in SIGMAS))
    has_sigmas(stations)
    require_unique(stations, "station_id")
    grids = [load_raster(spark, paths[k], k) for k in paths if k not in ("stations", "metadata")]
    cells, meta = grids[0]
    for c, m in grids[1:]:
        cells, meta = cells.unionByName(c), meta.unionByName(m)
    raster.audit_coregistration(meta, [k for k in paths if k not in ("stations", "metadata")])
    options = pipelines.metadata_options({"los_sign": "toward_satellite", **metadata})
    if a.mode == "vlm":
        values = pipelines.vlm_station_values(stations, cells, meta, rules, crs=options["crs"])
        insar, gnss = "insar_vlm_mm_per_year", "gnss_up_mm_per_year"
    else:
        values = pipelines.los_station_values(stations, cells, meta, "los", "incidence", "heading", rules, positive_direction=options["positive_direction"], crs=options["crs"])
        insar, gnss = "insar_los_mm_per_year", "gnss_los_mm_per_year"
    values = values.drop("raster_id").persist()
    n, included = values.agg(F.count(F.lit(1)), F.count_if("include_in_metrics")).first()
    if not included:
        raise ValueError("no station is left to compare")
    row = ("source_row",)
    sinks.write_table(values, out / "station_values", row, a.overwrite, a.format, row)
    sinks.write_table(pipelines.metrics_frame(values, insar, gnss, a.label, metadata["comparison_role"], a.tolerance), out / "metrics", (), a.overwrite)
    sinks.write_table(pipelines.exclusions(values, keep=row), out / "exclusions", row, a.overwrite, a.format, row)
    sinks.write_json(out / "provenance.json", sinks.provenance(a.mode, metadata, paths, _selection(rules), {"stations": n, "included": included}))
    values.unpersist()
    print(out)


def cross_validate(a: argparse.Namespace) -> None:
    _exist([a.observations, a.metadata])
    metadata = load_metadata(a.metadata, "cross-validate")
    out = sinks.prepare_output(a.output_dir, a.overwrite)
    spark = session()
    own = crossval.gate(tables.with_source_row(tables.read_observations(spark, a.observations))).persist()
    found = crossval.CrossValidation(own, a.trials, a.holdout_fraction, a.seed, a.maximum_condition_number, a.tolerance, "numpy")
    orders = {"loocv_folds": ("orbit", "fold"), "cv_trials": ("orbit", "trial"), "cv_assignments": ("orbit", "trial", "group_id"), "cv_distribution": ("orbit", "scope")}
    for name in found.TABLES:
        df = found.table(name)
        order = tuple(c for c in orders.get(name, ("orbit",)) if c in df.columns)
        if name == "loocv_station_values":
            order = ("source_row",)
        sinks.write_table(df, out / name, order, a.overwrite, a.format, ("source_row",))
    counts = own.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("orbit").alias("orbits"), F.count_distinct("orbit", "group_id").alias("orbit_groups")).first().asDict()
    model = {"basis": list(BASIS), "trials": a.trials, "holdout_fraction": a.holdout_fraction, "seed": a.seed, "maximum_condition_number": a.maximum_condition_number}
    sinks.write_json(out / "provenance.json", sinks.provenance("cross-validate", metadata, {"observations": a.observations, "metadata": a.metadata}, {}, counts, model=model))
    print(out)


def preflight(a: argparse.Namespace) -> dict:
    """Structure of the inputs of a mode, as one JSON object."""
    table = a.observations if a.mode == "cross-validate" else a.stations
    rasters = [] if a.mode == "cross-validate" else [a.vlm] if a.mode == "vlm" else [a.los, a.incidence, a.heading]
    _exist([table, a.metadata, *rasters])
    spark = session()
    df = tables.read_table(spark, table)
    require_columns(df, crossval.COLUMNS if a.mode == "cross-validate" else (*STATION_COLUMNS, *(SIGMAS if a.require_rate_uncertainties else ())))
    sigmas = a.mode != "cross-validate" and has_sigmas(df)
    metadata = load_metadata(a.metadata, a.mode, sigmas)
    if a.mode == "los" and a.require_rate_uncertainties and metadata.get("los_uncertainty_model") != SIGMA_MODEL:
        raise ValueError(f"los_uncertainty_model must be {SIGMA_MODEL}")
    rows = [geotiff.meta_row(p, Path(p).stem) for p in rasters]
    for r in rows:
        if r["band_count"] != 1:
            raise ValueError(f"{r['raster_id']} has {r['band_count']} bands")
        if not raster.crs_matches(metadata["coordinate_crs"], r["crs"]):
            raise ValueError(f"{r['raster_id']} is in {r['crs']}, not {metadata['coordinate_crs']}")
    if len({tuple(v for k, v in r.items() if k in ("width", "height", *"abcdef")) for r in rows}) > 1:
        raise ValueError("the rasters are not on one grid")
    result = {"status": "ok", "mode": a.mode, "table": {"file": Path(table).name, "sha256": tables.file_sha256(table), "rows": df.count(), "columns": df.columns}, "metadata": metadata, "rasters": rows, "warnings": [NOTE]}
    print(json.dumps(result, indent=2, sort_keys=True))
    return result


def _filters(a: argparse.Namespace) -> dict[str, str]:
    found = [t.partition("=") for t in a.metric_filter]
    wrong = [c + m + v for c, m, v in found if not m or not c.strip()]
    if wrong:
        raise ValueError(f"expected COLUMN=VALUE, not {wrong[0]!r}")
    return {c.strip(): v.strip() for c, _, v in found}


def _map_inputs(a: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, dict, dict, tuple[DataFrame, DataFrame]]:
    """Saved values and metrics of a map and its raster, all held against each
    other: the values, the metrics made anew, the raster's facts, the raster."""
    values = cut(verify.read_station_values(spark, a.station_values, a.mode))
    own = verify.verify_metrics(values, tables.select_one(tables.read_strict(spark, a.metrics), _filters(a)), a.mode)
    cells, meta = load_raster(spark, a.raster, "map")
    facts = raster.inspect(cells, meta)
    insar = verify.VALUE[a.mode][0]
    verify.verify_samples(values.withColumn("raster_id", F.lit("map")), cells, meta, a.sample_tolerance, value=insar)
    return values, own, facts, (cells, meta)


def _positive(*limits: float | None) -> None:
    for v in limits:
        if v is not None and not 0 < v < float("inf"):
            raise ValueError("limits and widths must be positive and finite")


def _trial_groups(a: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    trials = cut(tables.read_trials(spark, a.trials, a.group_column))
    if a.metrics is None:
        return trials, None
    loocv = tables.read_loocv_metrics(spark, a.metrics, a.group_column)
    tables.check_group_cover(loocv, trials, a.group_column)
    return trials, loocv


def _show(result: dict, output: str | None = None, overwrite: bool = False) -> dict:
    if output is not None:
        if Path(output).exists() and not overwrite:
            raise FileExistsError(f"{output} exists")
        sinks.write_json(output, result)
    print(json.dumps(result, indent=2, sort_keys=True))
    return result


def plot_data(a: argparse.Namespace) -> dict:
    """Verify saved values, metrics and raster samples and give what a figure needs."""
    _exist([a.station_values, a.metrics, a.raster])
    value_limit, bin_width, scatter = a.value_limit, getattr(a, "hist_bin_width", None), getattr(a, "scatter_range", None)
    _positive(value_limit, a.residual_limit, bin_width)
    if scatter and not scatter[0] < scatter[1]:
        raise ValueError("the scatter range is empty")
    spark = session()
    values, own, facts, (cells, meta) = _map_inputs(a, spark)
    insar, gnss, sigma = verify.VALUE[a.mode]
    inc = values.where(tables.parse_flag("include_in_metrics"))
    region = a.region or facts["region"]
    shown = raster.crop(cells, meta, *region)
    limits = figures.robust_symmetric_limit(shown, "cell_value", quantile=a.color_quantile).first()[0]
    if limits is None:
        raise ValueError("the region holds no data")
    residual_limit = a.residual_limit or figures.robust_symmetric_limit(inc, "residual_mm_per_year", quantile=a.color_quantile).first()[0]
    result = {"command": a.mode, "metrics": own, "raster": facts, "region": list(region), "value_limit": value_limit or limits, "residual_limit": residual_limit, "legend": figures.legend_values(inc, sigma), "offset_removed": False}
    if a.mode == "vlm":
        width = bin_width or figures.bin_width(inc, "residual_mm_per_year").first()[0]
        most = max(residual_limit, 1.05 * max(abs(own["minimum_residual_mm_per_year"]), abs(own["maximum_residual_mm_per_year"])))
        low, high = scatter or figures.axis_range(inc, insar, gnss, sigma).first()
        bins = [r.asDict() for r in figures.histogram(inc, "residual_mm_per_year", most, width).orderBy("bin").collect()]
        result |= {"bin_width": width, "histogram": bins, "axis": [low, high], "tick": figures.tick_step(high - low, 5)}
    return _show(result, a.output, a.overwrite)


def plot_cv(a: argparse.Namespace) -> dict:
    """Medians of the trials of each group and its leave-one-out RMS, with the axis."""
    _exist([a.trials, *([a.metrics] if a.metrics else [])])
    _positive(a.rms_limit)
    spark = session()
    trials, loocv = _trial_groups(a, spark)
    g = a.group_column
    found = figures.trial_medians(trials, loocv, g).collect()
    top = max((r["largest"] for r in found), default=0.0)
    groups = {r[g]: {k: r[k] for k in ("trials", "all_median_rms_mm_per_year", "holdout_median_rms_mm_per_year", "loocv_rms_mm_per_year")} for r in found}
    axis = a.rms_limit or (1.12 * top if top > 0 else 1.0)
    return _show({"command": "cv-rms", "groups": groups, "axis": [0.0, axis], "tick": figures.tick_step(axis, 5), "note": "Only the held-out RMS is fully out of sample."}, a.output, a.overwrite)


def plot_preflight(a: argparse.Namespace) -> dict:
    """Whether saved tables can be drawn, and the versions in use; nothing is drawn."""
    result = {"status": "ok", "mode": a.mode, **sinks.versions()}
    needed = {"vlm": ("station_values", "metrics", "raster"), "los": ("station_values", "metrics", "raster"), "cv-rms": ("trials",), "dependencies": ()}[a.mode]
    lacking = [n for n in needed if getattr(a, n) is None]
    if lacking:
        raise ValueError(f"{a.mode} needs {', '.join('--' + n.replace('_', '-') for n in lacking)}")
    _exist([p for p in (a.station_values, a.metrics, a.raster, a.trials) if p is not None])
    if a.mode in verify.VALUE:
        values, own, facts, _ = _map_inputs(a, session())
        n, included = values.agg(F.count(F.lit(1)), F.count_if(tables.parse_flag("include_in_metrics"))).first()
        result |= {"station_rows": n, "included_in_metrics": included, "raw_metrics": own, "raster": {"file": Path(a.raster).name, **facts}, "exact_pixel_sampling_verified": True, "offset_removed": False}
    elif a.mode == "cv-rms":
        trials, loocv = _trial_groups(a, session())
        found = figures.trial_medians(trials, loocv, a.group_column).collect()
        result["groups"] = {r[a.group_column]: {"trials": r["trials"], "has_loocv_metric": r["loocv_rms_mm_per_year"] is not None} for r in found}
    return _show(result)


def report(a: argparse.Namespace) -> None:
    _exist([a.metadata, *[p for _, p in a.metric_table]])
    with open(a.metadata, encoding="utf-8") as f:
        metadata = json.load(f)
    print(build_report(a.title, metadata, a.metric_table, a.output, a.overwrite))


def _exist(paths) -> None:
    for p in paths:
        if not Path(p).exists():
            raise FileNotFoundError(str(p))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for command in ("validate", "preflight"):
        modes = commands.add_parser(command).add_subparsers(dest="mode", required=True)
        for mode in ("los", "vlm", "cross-validate"):
            p = modes.add_parser(mode)
            p.add_argument("--metadata", required=True)
            if mode == "cross-validate":
                p.add_argument("--observations", required=True)
            else:
                p.add_argument("--stations", required=True)
                for r in ("vlm",) if mode == "vlm" else ("los", "incidence", "heading"):
                    p.add_argument(f"--{r}", required=True)
            if command == "preflight":
                p.add_argument("--require-rate-uncertainties", action="store_true")
                p.set_defaults(run=preflight)
                continue
            p.add_argument("--output-dir", required=True)
            p.add_argument("--overwrite", action="store_true")
            p.add_argument("--format", choices=sinks.FORMS, default="csv", help="form of the larger tables")
            p.add_argument("--tolerance", type=float, default=2.0)
            if mode == "cross-validate":
                p.add_argument("--trials", type=int, default=100)
                p.add_argument("--holdout-fraction", type=float, default=0.2)
                p.add_argument("--seed", type=int, default=0)
                p.add_argument("--maximum-condition-number", type=float, default=1e12)
                p.set_defaults(run=cross_validate)
                continue
            p.add_argument("--exclude-station-id", action="append", default=[])
            p.add_argument("--require-status", action="append", default=[], metavar="COLUMN=VALUE")
            for option in ("min-duration-years", "min-distance-from-fitting-m", "deduplicate-within-m", "max-component-sigma"):
                p.add_argument(f"--{option}", type=float)
            p.add_argument("--label", default="formal")
            p.set_defaults(run=compare)
    modes = commands.add_parser("plot-data").add_subparsers(dest="mode", required=True)
    for mode in ("vlm", "los"):
        p = modes.add_parser(mode)
        for option in ("raster", "station-values", "metrics"):
            p.add_argument(f"--{option}", required=True)
        p.add_argument("--metric-filter", action="append", default=[], metavar="COLUMN=VALUE")
        p.add_argument("--region", nargs=4, type=float, metavar=("W", "E", "S", "N"))
        p.add_argument("--residual-limit", type=float)
        p.add_argument(f"--{mode}-limit", type=float, dest="value_limit")
        p.add_argument("--color-quantile", type=float, default=98.0)
        p.add_argument("--sample-tolerance", type=float, default=1e-4)
        if mode == "vlm":
            p.add_argument("--hist-bin-width", type=float)
            p.add_argument("--scatter-range", nargs=2, type=float, metavar=("MIN", "MAX"))
        p.set_defaults(run=plot_data)
    p = modes.add_parser("cv-rms")
    p.add_argument("--trials", required=True)
    p.add_argument("--metrics")
    p.add_argument("--group-column", default="orbit")
    p.add_argument("--rms-limit", type=float)
    p.set_defaults(run=plot_cv)
    for p in modes.choices.values():
        p.add_argument("--output", help="also write the JSON there")
        p.add_argument("--overwrite", action="store_true")
    p = commands.add_parser("plot-preflight")
    p.add_argument("--mode", choices=("dependencies", "vlm", "los", "cv-rms"), default="dependencies")
    for option in ("station-values", "metrics", "raster", "trials"):
        p.add_argument(f"--{option}")
    p.add_argument("--group-column", default="orbit")
    p.add_argument("--metric-filter", action="append", default=[], metavar="COLUMN=VALUE")
    p.add_argument("--sample-tolerance", type=float, default=1e-4)
    p.set_defaults(run=plot_preflight)
    p = commands.add_parser("report")
    p.add_argument("--title", required=True)
    p.add_argument("--metadata", required=True)
    p.add_argument("--metric-table", action="append", type=labeled_path, default=[], metavar="LABEL=PATH")
    p.add_argument("--output", required=True)
    p.add_argument("--overwrite", action="store_true")
    p.set_defaults(run=report)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except Exception as e:
        print(f"ERROR: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
