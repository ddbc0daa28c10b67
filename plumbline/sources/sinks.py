"""Sinks: guarded output folders, single files written whole, result bundles."""

from __future__ import annotations

import csv
import json
import os
import platform
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import Any, TextIO

import numpy as np
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import file_sha256

# Names of the files that a run may write.
GENERATED = (
    "station_values", "metrics", "exclusions", "full_fit_metrics", "loocv_station_values", "loocv_metrics", "loocv_folds", "cv_trials", "cv_assignments", "cv_distribution", "provenance",
)
FORMS = ("csv", "parquet")


def prepare_output(folder: str | Path, overwrite: bool = False) -> Path:
    """The folder, made if need be; FileExistsError if it holds generated names."""
    folder = Path(folder)
    there = sorted(p.name for p in folder.iterdir() if p.name.split(".")[0] in GENERATED) if folder.is_dir() else []
    if there and not overwrite:
        raise FileExistsError(f"{folder} already holds {', '.join(there)}")
    folder.mkdir(parents=True, exist_ok=True)
    return folder


@contextmanager
def _whole(path: str | Path) -> Iterator[TextIO]:
    """A text file that takes its place when it is complete, or not at all."""
    path = Path(path)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            yield f
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_text(path: str | Path, text: str) -> None:
    """Write a file whole: a temporary file in its folder takes its place."""
    with _whole(path) as f:
        f.write(text)


def presentable(df: DataFrame) -> DataFrame:
    """NaN made null (an empty field), arrays joined by ``;``."""
    cols = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            cols[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast(kind))
        elif kind.startswith("array<"):
            cols[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ";")
    return df.withColumns(cols) if cols else df


def _cell(value: Any) -> Any:
    return "" if value is None else repr(value) if isinstance(value, float) else value


def write_table(df: DataFrame, path: str | Path, order: tuple[str, ...] = (), overwrite: bool = False, form: str = "csv", drop: tuple[str, ...] = ()) -> None:
    """``<path>.csv``, or with ``form="parquet"`` the folder ``<path>.parquet``.

    The form never depends on the size. A CSV file is one file in the order
    asked for, which the driver writes row by row as partitions arrive, so its
    memory holds one partition; large tables are better asked for as Parquet,
    which the executors write. Overwriting removes the table's other form.
    Columns in ``drop`` are for the order only.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form {form!r}")
    path = Path(path)
    target, other = path.with_name(f"{path.name}.{form}"), path.with_name(f"{path.name}.{FORMS[1 - FORMS.index(form)]}")
    there = [p for p in (target, other) if p.exists()]
    if there and not overwrite:
        raise FileExistsError(f"{there[0]} exists")
    rows = df.orderBy(*order) if order else df
    if form == "parquet":
        rows.drop(*drop).write.mode("overwrite").parquet(str(target))
    else:
        shown = presentable(rows.drop(*drop))
        with _whole(target) as f:
            out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            out.writerow(shown.columns)
            for r in shown.toLocalIterator(prefetchPartitions=True):
                out.writerow([_cell(v) for v in r])
    if other.is_dir():
        shutil.rmtree(other)
    else:
        other.unlink(missing_ok=True)


def versions() -> dict[str, str]:
    return {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__}


def provenance(mode: str, metadata: Mapping[str, Any], inputs: Mapping[str, str | Path], selection: Mapping[str, Any], counts: Mapping[str, int], **more: Any) -> dict[str, Any]:
    """The record of a run. Inputs appear by base name and hash, never by path."""
    return {
        "mode": mode,
        "metadata": dict(metadata),
        "inputs": {name: {"file": Path(p).name, "sha256": file_sha256(p)} for name, p in inputs.items() if Path(p).is_file()},
        "selection": {**selection, "sampling": "station_containing_pixel", "nearest_valid_fallback": "none", "constant_offset_removed": False},
        "counts": dict(counts),
        "software": versions(),
        **more,
    }


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True) + "\n")
