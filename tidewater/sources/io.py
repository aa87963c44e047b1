"""Landing, scanning and small JSON, YAML and text files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import marts
from . import files


class WarehouseUnavailable(RuntimeError):
    """A table of the warehouse cannot be read."""


# -- builds: tables in a folder of their own each, published together by a manifest -----------------------------------

#: Manifests, one JSON file for each version; the highest one says where every table is.
MANIFESTS = "_published"


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in files.names(spark, f"{path}/{MANIFESTS}") if re.fullmatch(r"\d+\.json", n)]


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(version, folder of each "layer.name" below ``path``); version 0 before the first publication.

    A file that is still being written, by a writer that may have died, is passed over."""
    for version in sorted(_versions(spark, path), reverse=True):
        try:
            got = json.loads(files.read_text(spark, f"{path}/{MANIFESTS}/{version:012d}.json"))
        except ValueError:
            continue
        return version, got["tables"]
    return 0, {}


def publish(spark: SparkSession, path: str, tables: Mapping[str, str], after: int) -> int:
    """Make ``tables`` current at once, with what version ``after`` holds besides; RuntimeError if that isn't the last version any more."""
    version, now = manifest(spark, path)
    new = max([after, *_versions(spark, path)]) + 1
    text = json.dumps({"tables": {**now, **tables}}, indent=1)
    if version != after or not files.write_text(spark, f"{path}/{MANIFESTS}/{new:012d}.json", text, overwrite=False):
        raise RuntimeError(f"version {after} of {path} is not the last one: another build was published meanwhile")
    return new


def _write(df: DataFrame, path: str, folder: str, layer: str, name: str) -> str:
    where = f"_builds/{folder}/{layer}/{name}"
    df.write.parquet(f"{path}/{where}")
    return where


def _land(tables: Mapping[str, DataFrame], path: str, folder: str, layer: str) -> tuple[dict[str, int], dict[str, str]]:
    counts, found = {}, {}
    for name, df in tables.items():
        found[f"{layer}.{name}"] = where = _write(df, path, folder, layer, name)
        sent, got = df.count(), df.sparkSession.read.parquet(f"{path}/{where}").count()
        if got != sent:
            raise RuntimeError(f"{name}: {sent} rows written, {got} read")
        counts[name] = got
    return counts, found


def land_tables(tables: Mapping[str, DataFrame], path: str, layer: str = "raw") -> dict[str, int]:
    """Write the tables, check each written row count against the source's, and publish them together.

    No Observation counts while writing: after one, plans that refer to the session can't be sent to tasks."""
    spark = next(iter(tables.values())).sparkSession
    version, _ = manifest(spark, path)
    counts, found = _land(tables, path, uuid.uuid4().hex, layer)
    publish(spark, path, found, version)
    return counts


def land_hidden(latent: DataFrame, path: str) -> None:
    """Ground truth goes to a layer of its own that no catalog lists."""
    latent.write.mode("overwrite").parquet(f"{path}/sim_hidden/users_latent")


def scan(spark: SparkSession, path: str, layer: str, name: str) -> DataFrame:
    """A published table, as of now."""
    where = manifest(spark, path)[1].get(f"{layer}.{name}")
    try:
        if where is not None:
            return spark.read.parquet(f"{path}/{where}")
    except AnalysisException as e:
        raise WarehouseUnavailable(f"{layer}.{name} cannot be read") from e
    raise WarehouseUnavailable(f"{layer}.{name} is not published under {path}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the build folders that none of the last ``keep`` versions uses, and the manifests before those."""
    versions = sorted(_versions(spark, path))
    used = {where.split("/")[1] for v in versions[-keep:] for where in json.loads(files.read_text(spark, f"{path}/{MANIFESTS}/{v:012d}.json"))["tables"].values()}
    gone = [f for f in files.names(spark, f"{path}/_builds") if f not in used]
    for v in versions[:-keep]:
        files.delete(spark, f"{path}/{MANIFESTS}/{v:012d}.json")
    for f in gone:
        files.delete(spark, f"{path}/_builds/{f}")
    return gone


#: Models: a builder over ``ref(layer, name)``. What a builder refers to is what it depends on; the order here means nothing.
MODELS: dict[str, Callable] = {
    "mart_daily_channel": lambda ref: marts.mart_daily_channel(marts.stg_ad_spend_daily(ref("raw", "ad_spend_daily")), marts.stg_signups(ref("raw", "signups")), ref("marts", "fct_transactions")),
    "fct_transactions": lambda ref: marts.fct_transactions(marts.stg_transactions(ref("raw", "transactions")), ref("marts", "dim_users")),
    "dim_users": lambda ref: marts.dim_users(marts.stg_signups(ref("raw", "signups"))),
}


@dataclass
class Build:
    """One run of models: ``order`` is the order they were finished in, ``edges`` what each referred to."""

    tables: dict[str, str]
    order: list[str]
    edges: dict[str, list[str]]
    version: int = 0


def run_models(spark: SparkSession, path: str, models: Mapping[str, Callable], tables: Mapping[str, str], folder: str, only: Sequence[str] | None = None) -> Build:
    """Write the models below ``path`` without publishing them, each after the ones that it refers to.

    A reference to another model of the build is that model, just built; any other is read from ``tables``. ``only`` names the models
    to build, with what they need from the build."""
    done = Build(dict(tables), [], {})

    def make(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("models refer to each other in a circle: " + " -> ".join([*above[above.index(name) :], name]))
        if f"marts.{name}" in fresh:
            return
        done.edges[name] = []

        def ref(layer: str, wanted: str) -> DataFrame:
            done.edges[name].append(f"{layer}.{wanted}")
            if layer == "marts" and wanted in models:
                make(wanted, (*above, name))
            where = done.tables.get(f"{layer}.{wanted}")
            if where is None:
                raise WarehouseUnavailable(f"{name} refers to {layer}.{wanted}, which is not there")
            return spark.read.parquet(f"{path}/{where}")

        df = models[name](ref)
        done.tables[f"marts.{name}"] = _write(df, path, folder, "marts", name)
        fresh.add(f"marts.{name}")
        done.order.append(name)

    fresh: set[str] = set()
    for name in only or models:
        make(name, ())
    return done


def build_models(spark: SparkSession, path: str, models: Mapping[str, Callable] | None = None, only: Sequence[str] | None = None) -> list[str]:
    """Build the models over the published tables and publish them together; staging stays lazy views.

    A build that fails leaves what was published before as it is."""
    version, tables = manifest(spark, path)
    done = run_models(spark, path, MODELS if models is None else models, tables, uuid.uuid4().hex, only)
    publish(spark, path, {k: v for k, v in done.tables.items() if tables.get(k) != v}, version)
    return done.order


def build_all(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, models: Mapping[str, Callable] | None = None) -> dict[str, int]:
    """Land the raw tables, build the models on them, and publish all of it at once."""
    version, now = manifest(spark, path)
    folder = uuid.uuid4().hex
    counts, found = _land(tables, path, folder, "raw")
    done = run_models(spark, path, MODELS if models is None else models, {**now, **found}, folder)
    publish(spark, path, {k: v for k, v in done.tables.items() if now.get(k) != v}, version)
    return counts


def rows_json(df: DataFrame) -> str:
    """Records with ISO dates, for the delivery edge."""
    return df.toPandas().to_json(orient="records", date_format="iso")


def export_mmm(fit, mean_spend, path: str) -> dict:
    """Response parameters as JSON, rounded."""
    out = {
        "r2": round(fit.r2, 4),
        "channels": {c: {"beta": round(float(fit.beta[k]), 2), "decay": round(float(fit.decay[k]), 3), "half_sat": round(float(fit.half_sat[k]), 2), "mean_spend": round(float(mean_spend[k]), 2)} for k, c in enumerate(fit.channels)},
    }
    write_text(path, json.dumps(out, indent=1))
    return out


def read_mmm(path: str) -> dict[str, dict[str, float]]:
    """The exported channels; anything malformed is a ValueError."""
    try:
        channels = json.loads(read_text(path))["channels"]
        out = {str(c): {k: float(v[k]) for k in ("beta", "decay", "half_sat", "mean_spend")} for c, v in channels.items()}
    except (OSError, KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"malformed response parameters: {e}") from e
    if not out:
        raise ValueError("no channels")
    return out


def write_text(path: str, text: str) -> None:
    """To a file of any scheme, by the session's file systems; a plain path is the driver's own."""
    if "://" in path:
        files.write_text(SparkSession.active(), path, text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def read_text(path: str) -> str:
    if "://" in path:
        return files.read_text(SparkSession.active(), path)
    with open(path, encoding="utf-8") as f:
        return f.read()


@dataclass(frozen=True)
class Truth:
    """Parameters of the simulator."""

    start: str
    horizon_days: int
    seed: int
    dow: tuple[float, ...]
    channels: Mapping[str, Mapping[str, float]]
    plans: Mapping[str, Mapping[str, float]]
    subscribe: Mapping[str, float]
    fraud_rate: float


def load_truth(path: str) -> Truth:
    """Parse and check a YAML (or JSON) file of simulator parameters."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    return check_truth(Truth(**{**raw, "dow": tuple(raw["dow"])}))


def check_truth(t: Truth) -> Truth:
    if len(t.dow) != 7:
        raise ValueError("seven weekday multipliers are needed")
    if t.horizon_days <= 0:
        raise ValueError("the horizon is positive")
    shares = [t.fraud_rate, *t.subscribe.values(), *(c[k] for c in t.channels.values() for k in ("ctr", "cvr", "high_intent") if k in c), *(p[k] for p in t.plans.values() for k in ("churn", "share"))]
    if not all(0 < p < 1 for p in shares):
        raise ValueError("probabilities lie between 0 and 1")
    return t


class PrometheusText:
    """Request counters and duration sums in the text exposition format."""

    def __init__(self):
        self.count: dict[tuple[str, int], int] = {}
        self.seconds: dict[str, float] = {}

    def observe(self, route: str, status: int, seconds: float) -> None:
        self.count[route, status] = self.count.get((route, status), 0) + 1
        self.seconds[route] = self.seconds.get(route, 0.0) + seconds

    def render(self) -> str:
        lines = ["# TYPE requests_total counter", *(f'requests_total{{route="{r}",status="{s}"}} {n}' for (r, s), n in sorted(self.count.items()))]
        lines += ["# TYPE request_seconds_sum counter", *(f'request_seconds_sum{{route="{r}"}} {v:.6f}' for r, v in sorted(self.seconds.items()))]
        return "\n".join(lines) + "\n"
