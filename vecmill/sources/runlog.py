"""Run log: tags, parameters, metrics, texts and datasets of runs, as one long table of Parquet
files that writers only append to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.session import literal_rows
from vecmill.sources.versions import latest_version, read_version

ENTRY = (
    "run_id string, kind string, key string, value string, metric double, step long, ts timestamp"
)


@dataclass(frozen=True)
class Dataset:
    """A version-pinned dataset."""

    path: str
    version: int

    def read(self, spark: SparkSession) -> DataFrame:
        return read_version(spark, self.path, self.version)


class RunLog:
    """The log at ``path``. A run is continued by using its id again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def entries(self, run_id: str | None = None, kind: str | None = None) -> DataFrame:
        log = self.spark.read.schema(ENTRY).parquet(self.path)
        if run_id is not None:
            log = log.filter(F.col("run_id") == run_id)
        if kind is not None:
            log = log.filter(F.col("kind") == kind)
        return log

    def start_run(
        self, name: str, description: str = "", use_case: str = "", run_id: str | None = None
    ) -> str:
        run_id = run_id or uuid.uuid4().hex
        tags = {"run_name": name, "run_description": description, "use_case": use_case}
        self._append(run_id, "tag", tags)
        return run_id

    def log_params(self, run_id: str, params: Mapping[str, Any]) -> None:
        self._append(run_id, "param", params)

    def log_text(self, run_id: str, text: str, name: str) -> None:
        self._append(run_id, "text", {name: text})

    def log_metric(self, run_id: str, key: str, value: float, step: int | None = None) -> None:
        row = (run_id, "metric", key, None, float(value), step, datetime.now(timezone.utc))
        self._write(literal_rows(self.spark, [row], ENTRY))

    def log_metrics(self, run_id: str, metrics: DataFrame) -> None:
        """Append a whole series given as ``(key, metric, step)``; written where it is computed."""
        self._write(
            metrics.select(
                F.lit(run_id).alias("run_id"),
                F.lit("metric").alias("kind"),
                "key",
                F.lit(None).cast("string").alias("value"),
                F.col("metric").cast("double").alias("metric"),
                F.col("step").cast("long").alias("step"),
                F.current_timestamp().alias("ts"),
            )
        )

    def log_datasets(self, run_id: str, datasets: Mapping[str, Dataset | str]) -> None:
        """Log path, version and schema of each dataset; a bare path means its latest version."""
        values = {}
        for name, dataset in datasets.items():
            if isinstance(dataset, str):
                dataset = Dataset(dataset, latest_version(self.spark, dataset))
            schema = json.loads(dataset.read(self.spark).schema.json())
            values[_dataset_key(name)] = json.dumps(
                {"path": dataset.path, "version": dataset.version, "schema": schema}
            )
        self._append(run_id, "dataset", values)

    def tracked_datasets(self, run_id: str) -> dict[str, Dataset]:
        """The datasets of a run by key ``dataset_<name>_metadata``: the entry logged last."""
        fields = F.from_json("value", "path string, version long")
        rows = (
            self.entries(run_id, "dataset")
            .groupBy("key")
            .agg(F.max_by("value", "ts").alias("value"))
            .select("key", fields.alias("d"))
        )
        # As many rows as the run has datasets.
        return {r["key"]: Dataset(r["d"]["path"], r["d"]["version"]) for r in rows.collect()}

    def last_per_epoch(self, run_id: str, key: str, steps_per_epoch: int) -> DataFrame:
        """``(epoch, metric)`` of a metric series: its value at the last step of each epoch."""
        series = self.entries(run_id, "metric").filter(F.col("key") == key)
        epoch = F.call_function("div", F.col("step"), F.lit(steps_per_epoch))
        return series.groupBy(epoch.alias("epoch")).agg(F.max_by("metric", "step").alias("metric"))

    def _append(self, run_id: str, kind: str, values: Mapping[str, Any]) -> None:
        now = datetime.now(timezone.utc)
        rows = [(run_id, kind, k, str(v), None, None, now) for k, v in values.items()]
        if rows:
            self._write(literal_rows(self.spark, rows, ENTRY))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def _dataset_key(name: str) -> str:
    return f"dataset_{name}_metadata"
