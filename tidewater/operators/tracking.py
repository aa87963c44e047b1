"""Run tracking: an append-only table of runs and a registry of model versions.

A run is one row (parameters, metrics, tags, where its artifacts are), appended as a file of its own, so runs
are logged from anywhere at once and queried as a DataFrame. The registry is a folder of numbered decisions for each model name;
each is created only if its number is still free, which the file system decides, so of two writers that saw the same state
one wins and the other is told.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

RUNS = "run_id string, model string, started timestamp, params map<string,string>, metrics map<string,double>, tags map<string,string>, artifacts string"
STAGES = ("registered", "production", "archived")


class Conflict(RuntimeError):
    """Another writer changed the registry since it was read."""


@dataclass(frozen=True)
class Version:
    version: int
    run_id: str
    stage: str


class Tracker:
    """Runs and versions under one folder of any file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self, model: str, params: Mapping[str, object], metrics: Mapping[str, float], tags: Mapping[str, str] | None = None, artifacts: str | None = None, run_id: str | None = None) -> str:
        """Append a run; its identifier is returned."""
        run_id = run_id or uuid.uuid4().hex
        row = (run_id, model, dt.datetime.now(dt.timezone.utc), {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, dict(tags or {}), artifacts)
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return run_id

    def runs(self, model: str | None = None) -> DataFrame:
        """All runs, or those of a model."""
        if not files.exists(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], RUNS)
        rows = self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")
        return rows if model is None else rows.where(F.col("model") == model)

    def best(self, model: str, metric: str, highest: bool = True) -> str:
        """The run with the best value of a metric; ties go to the first identifier."""
        value = F.col("metrics")[metric]
        row = self.runs(model).where(value.isNotNull()).orderBy(value.desc() if highest else value.asc(), "run_id").select("run_id").first()
        if row is None:
            raise LookupError(f"no run of {model} has {metric}")
        return row["run_id"]

    def _folder(self, model: str) -> str:
        if not re.fullmatch(r"[\w-]+", model):
            raise ValueError("a model's name has letters, digits, - and _ only")
        return f"{self.path}/registry/{model}"

    def _state(self, model: str) -> tuple[int, list[dict]]:
        folder = self._folder(model)
        found = [n for n in files.names(self.spark, folder) if re.fullmatch(r"\d+\.json", n)]
        return len(found), [json.loads(files.read_text(self.spark, f"{folder}/{n}")) for n in found]

    def revision(self, model: str) -> int:
        """How many decisions the registry holds on a model: what a change is checked against."""
        return self._state(model)[0]

    def versions(self, model: str) -> list[Version]:
        """Every version with its present stage; one at most is in production."""
        out: dict[int, Version] = {}
        for d in self._state(model)[1]:
            if d["stage"] == "production":
                out = {v: Version(v, x.run_id, "archived" if x.stage == "production" else x.stage) for v, x in out.items()}
            out[d["version"]] = Version(d["version"], d["run_id"], d["stage"])
        return list(out.values())

    def _decide(self, model: str, decision: dict, revision: int | None) -> None:
        now = self.revision(model) if revision is None else revision
        if not files.write_text(self.spark, f"{self._folder(model)}/{now + 1:012d}.json", json.dumps(decision), overwrite=False) or self.revision(model) != now + 1:
            raise Conflict(f"the registry of {model} is not at revision {now} any more")

    def register(self, model: str, run_id: str, revision: int | None = None) -> int:
        """A new version for a logged run; its number is returned."""
        if self.runs(model).where(F.col("run_id") == run_id).isEmpty():
            raise LookupError(f"no run {run_id} of {model}")
        version = max([0, *(v.version for v in self.versions(model))]) + 1
        self._decide(model, {"version": version, "run_id": run_id, "stage": "registered"}, revision)
        return version

    def move(self, model: str, version: int, stage: str, revision: int | None = None) -> None:
        """Change a version's stage; a version put in production archives the one before. ``revision`` is the state that the decision rests on."""
        if stage not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}")
        known = {v.version: v for v in self.versions(model)}
        if version not in known:
            raise LookupError(f"{model} has no version {version}")
        self._decide(model, {"version": version, "run_id": known[version].run_id, "stage": stage}, revision)

    def production(self, model: str) -> Version | None:
        return next((v for v in self.versions(model) if v.stage == "production"), None)
