"""Station, observation and result tables from CSV or Parquet.

Ids and status words are read verbatim: ``0001`` stays, ``NA`` is an id.
Numbers are read as text and converted, so that a bad one becomes null (or, in
strict reading, an error) instead of changing the type of its column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import as_col, to_double

STATION_NUMBERS = (
    "longitude_deg", "latitude_deg", "east_mm_per_year", "north_mm_per_year", "up_mm_per_year",
    "sigma_east_mm_per_year", "sigma_north_mm_per_year", "sigma_up_mm_per_year", "duration_years", "nearest_fitting_distance_m",
)
OBSERVATION_NUMBERS = ("normalized_pixel_x", "normalized_pixel_y", "residual_before_fit_mm_per_year")
TRUE, FALSE = ("1", "true", "yes", "y", "include", "included"), ("0", "false", "no", "n", "exclude", "excluded")


def read_table(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    """A CSV file (UTF-8, with header, a byte-order mark is dropped) as text with
    the named columns as numbers, or a Parquet table with NaN made null."""
    if str(path).rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(str(path))
        floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
        return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in floats})
    df = spark.read.csv(str(path), header=True, multiLine=True, escape='"')
    return df.withColumns({c: to_double(c) for c in numbers if c in df.columns})


def with_source_row(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Add the place of each row in its table, by which results can be put back
    into the order of the input. It grows along each file as it is read; for a
    CSV file, which one task reads, it is the row's number from zero."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, STATION_NUMBERS)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, OBSERVATION_NUMBERS)


def read_strict(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV file as trimmed text; ValueError for a missing header, repeated or
    missing columns, or no rows."""
    raw = spark.read.csv(str(path), header=False, multiLine=True, escape='"').limit(1).collect()
    names = [(v or "").strip() for v in raw[0]] if raw else []
    if not any(names):
        raise ValueError(f"{Path(path).name}: no header")
    if names:
        names[0] = names[0].lstrip("﻿")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{Path(path).name}: columns occur twice: {', '.join(twice)}")
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"{Path(path).name}: columns missing: {', '.join(missing)}")
    df = spark.read.csv(str(path), header=True, multiLine=True, escape='"').toDF(*names)
    df = df.select(*[F.trim(F.col(f"`{n}`")).alias(n) for n in names])
    if df.isEmpty():
        raise ValueError(f"{Path(path).name}: no rows")
    return df


def number_fault(column: str, allow_gap: bool = False) -> Column:
    """The text of a field that is no finite number (or, unless allowed, a gap); null if it is one."""
    text = F.trim(F.col(column))
    value, gap = to_double(text), F.coalesce(F.lower(text).isin("", "nan"), F.lit(True))
    wrong = value.isNull() | (F.abs(value) == float("inf"))
    shown = F.coalesce(F.nullif(text, F.lit("")), F.lit("(nothing)"))
    return F.when(gap, F.lit(None).cast("string") if allow_gap else shown).when(wrong, shown)


def strict_number(column: str, allow_gap: bool = False) -> Column:
    """Text as a number; another text (or, unless allowed, a gap) stops the job
    with an error that names column and text."""
    fault = number_fault(column, allow_gap)
    stop = F.raise_error(F.concat(F.lit(f"{column}: not a finite number: "), fault)).cast("double")
    return F.when(fault.isNotNull(), stop).otherwise(to_double(F.trim(F.col(column))))


def faults(rows: DataFrame, numbers: Sequence[str] = (), gaps: Sequence[str] = (), flags: Sequence[str] = (), key: str = "source_row") -> DataFrame:
    """``key, column_name, found``: every field that is not what its column
    needs, a number (in ``gaps`` also nothing or NaN) or a flag."""
    checks = [(c, number_fault(c)) for c in numbers] + [(c, number_fault(c, True)) for c in gaps]
    checks += [(c, F.when(parse_flag(c).isNull(), F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("(nothing)")))) for c in flags]
    each = F.array_compact(F.array(*[F.when(bad.isNotNull(), F.struct(F.lit(c).alias("column_name"), bad.alias("found"))) for c, bad in checks]))
    return rows.select(key, F.inline(each))


def require_sound(rows: DataFrame, name: str, numbers: Sequence[str] = (), gaps: Sequence[str] = (), flags: Sequence[str] = ()) -> None:
    """ValueError for the first fault of a table with ``source_row``, by the
    line of the file (the header being line one) and the column."""
    first = faults(rows, numbers, gaps, flags).orderBy("source_row", "column_name").limit(1).collect()
    if first:
        raise ValueError(f"{name} line {first[0]['source_row'] + 2}, {first[0]['column_name']}: {first[0]['found']!r} is not allowed")


def parse_flag(column: Column | str) -> Column:
    """1/0, true/false, yes/no, y/n, include(d)/exclude(d) in any case; else null."""
    word = F.lower(F.trim(as_col(column).cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def select_one(df: DataFrame, filters: dict[str, str]) -> dict:
    """The one row that meets all equality filters; ValueError for none or several."""
    missing = sorted(set(filters) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    for column, value in filters.items():
        df = df.where(F.trim(F.col(column).cast("string")) == value)
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no row' if not rows else 'several rows'} for {filters}")
    return rows[0].asDict()


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table, after a check that no combination of the keys occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(8).collect()
    if twice:
        raise ValueError(f"not unique by {', '.join(keys)}: {[tuple(r)[:-1] for r in twice]}")
    return df


TRIAL_NUMBERS = ("all_rms_mm_per_year", "holdout_rms_mm_per_year")


def read_trials(spark: SparkSession, path: str, group: str = "orbit") -> DataFrame:
    """Saved trials: ``group, trial`` and the RMS columns, checked line by line."""
    raw = with_source_row(read_strict(spark, path, [group, "trial", *TRIAL_NUMBERS]))
    require_sound(raw, Path(path).name, TRIAL_NUMBERS)
    return load_trials(raw.withColumns({c: to_double(c) for c in TRIAL_NUMBERS}), group)


def read_loocv_metrics(spark: SparkSession, path: str, group: str = "orbit") -> DataFrame:
    raw = with_source_row(read_strict(spark, path, [group, "rms_mm_per_year"]))
    require_sound(raw, Path(path).name, ["rms_mm_per_year"])
    return load_loocv_metrics(raw.withColumn("rms_mm_per_year", to_double("rms_mm_per_year")), group)


def load_trials(df: DataFrame, group: str = "group") -> DataFrame:
    """Trials with unique (group, trial), a group, and RMS values that are finite and not negative."""
    unique_rows(df, [group, "trial"])
    ok = F.coalesce(F.trim(F.col(group).cast("string")) != "", F.lit(False))
    for n in TRIAL_NUMBERS:
        ok = ok & F.coalesce((F.col(n) >= 0) & (F.col(n) < float("inf")), F.lit(False))
    wrong = df.where(~ok).select(group, "trial").limit(1).collect()
    if wrong:
        raise ValueError(f"trial {wrong[0][1]} of {wrong[0][0]} has no group, or an RMS that is negative or not finite")
    return df


def load_loocv_metrics(df: DataFrame, group: str = "orbit") -> DataFrame:
    return unique_rows(df, [group]).select(group, "rms_mm_per_year")


def uncovered_groups(loocv: DataFrame, trials: DataFrame, group: str = "orbit") -> DataFrame:
    """Groups of the leave-one-out table without trials."""
    return loocv.join(trials.select(group).distinct(), group, "left_anti").select(group)


def check_group_cover(loocv: DataFrame, trials: DataFrame, group: str = "orbit") -> None:
    """Every group of the leave-one-out table must have trials."""
    lost = uncovered_groups(loocv, trials, group).limit(8).collect()
    if lost:
        raise ValueError(f"no trials for {[r[0] for r in lost]}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, sha256`` of every file under a path, by base name, hashed
    where the file is read."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    """SHA-256 of one local file of any size, in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()
