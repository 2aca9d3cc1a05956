"""Small files beside the tables: manifests, summaries, and the inputs of a sensitivity run. All stay on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.guards import require

#: The column of detectable effects, and its name in older tables.
EFFECT = "minimum_detectable_beta_residual_SD_per_allele"
EFFECT_BEFORE = "minimum_detectable_standardized_per_allele_beta"


def first_file(root: str | Path, names: Sequence[str]) -> Path:
    """The first of several names, newest convention first, that is a file under ``root``."""
    found = next((p for n in names if (p := Path(root) / n).is_file()), None)
    if found is None:
        raise FileNotFoundError(f"none of {list(names)} under {root}")
    return found


def _plain(x: Any) -> Any:
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, Path):
        return str(x)
    raise TypeError(f"{type(x).__name__} has no form in JSON")


def write_manifest(path: str | Path, content: Mapping[str, Any]) -> None:
    """JSON with numbers of numpy and paths as plain values."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, default=_plain) + "\n", encoding="utf-8")


def read_manifest(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def source_entry(root: str | Path, path: Path) -> dict[str, str]:
    """Where an input came from, for a manifest."""
    with path.open("rb") as f:
        return {"relative_source": str(path.relative_to(root)), "sha256": hashlib.file_digest(f, "sha256").hexdigest()}


def current_power_columns(power: DataFrame) -> DataFrame:
    """A table of detectable effects by its present names, without shares of variance explained."""
    if EFFECT not in power.columns:
        power = power.withColumnRenamed(EFFECT_BEFORE, EFFECT)
    require(EFFECT in power.columns, "the table has no detectable effects")
    return power.select(*(F.col(f"`{c}`") for c in power.columns if "variance_explained" not in c))
