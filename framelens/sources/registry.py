"""Configured datasets, and configuration files. These are small and live on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from framelens.schema import VIEWS
from framelens.sources.sinks import is_remote
from framelens.sources.manifest import normalized, read_payload, records, require_all_valid


@dataclass(frozen=True)
class Dataset:
    """A manifest and the views that its samples must have."""

    name: str
    data_file: str
    views: tuple[str, ...] = VIEWS

    def records(self, spark: SparkSession) -> DataFrame:
        if not self.data_file:
            raise ValueError("Dataset config must define a non-empty data_file.")
        return records(read_payload(spark, self.data_file))

    def valid(self, spark: SparkSession) -> DataFrame:
        return normalized(self.records(spark), self.views)

    def all(self, spark: SparkSession) -> DataFrame:
        return require_all_valid(self.records(spark), self.views)


#: Kinds of datasets by name; a configuration file names its own with ``register_datasets``.
DATASETS: dict[str, type[Dataset]] = {"sample": Dataset}


def register_datasets(config: dict, kind: type[Dataset] = Dataset) -> None:
    """Makes every dataset of a configuration's ``datasets`` known."""
    DATASETS.update({name: kind for name in config.get("datasets") or {}})


def build_dataset(name: str, config: dict) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    return DATASETS[name](name, config.get("data_file", ""), tuple(config.get("expected_camera_views") or VIEWS))


def load_config(path: str) -> dict:
    """YAML or JSON, by suffix; the top level must be an object."""
    text = "\n".join(r[0] for r in SparkSession.active().read.text(path).collect()) if is_remote(path) else Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold an object")
    return found
