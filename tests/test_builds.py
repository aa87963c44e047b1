"""Builds published at once, artifacts on any file system, runs and versions."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import churn, tracking
from tidewater.sources import files, io, settle


@pytest.fixture(params=["file", "viewfs"])
def store(spark, tmp_path, request):
    """The same folder by two schemes; the second only Hadoop's file systems can open."""
    if request.param == "file":
        return f"file://{tmp_path}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name}.link./at", f"file://{tmp_path}")
    return f"viewfs://{tmp_path.name}/at"


def rows(spark, n, k=1):
    return spark.range(n).withColumn("v", F.col("id") * k)


MODELS = {
    "c": lambda ref: ref("marts", "b").join(ref("raw", "x").select("id"), "id"),
    "a": lambda ref: ref("raw", "x").where("id % 2 = 0"),
    "b": lambda ref: ref("marts", "a").withColumn("v", F.col("v") + 1),
}


def test_builds_follow_their_references(spark, store):
    io.build_all(spark, {"x": rows(spark, 10)}, store, MODELS)
    assert io.scan(spark, store, "marts", "c").count() == 5
    done = io.run_models(spark, store, MODELS, io.manifest(spark, store)[1], "try")
    assert done.order == ["a", "b", "c"] and done.edges == {"c": ["marts.b", "raw.x"], "b": ["marts.a"], "a": ["raw.x"]}
    assert io.build_models(spark, store, MODELS, only=["b"]) == ["a", "b"]
    with pytest.raises(ValueError, match="circle"):
        io.build_models(spark, store, {"p": lambda ref: ref("marts", "q"), "q": lambda ref: ref("marts", "p")})
    with pytest.raises(io.WarehouseUnavailable):
        io.build_models(spark, store, {"p": lambda ref: ref("raw", "missing")})


def test_a_killed_build_leaves_the_old_tables(spark, store):
    io.build_all(spark, {"x": rows(spark, 10)}, store, MODELS)
    before = {t: sorted(map(tuple, io.scan(spark, store, "marts", t).collect())) for t in MODELS}

    def killed(ref):
        ref("marts", "b")
        raise KeyboardInterrupt  # the first models are written by now

    with pytest.raises(KeyboardInterrupt):
        io.build_all(spark, {"x": rows(spark, 30, 7)}, store, {**MODELS, "c": killed})
    failing = {**MODELS, "c": lambda ref: ref("marts", "b").select(F.raise_error(F.lit("broken")).cast("int").alias("z"))}
    with pytest.raises(Exception, match="broken"):
        io.build_all(spark, {"x": rows(spark, 30, 7)}, store, failing)
    assert {t: sorted(map(tuple, io.scan(spark, store, "marts", t).collect())) for t in MODELS} == before
    assert io.scan(spark, store, "raw", "x").count() == 10
    io.build_all(spark, {"x": rows(spark, 30, 7)}, store, MODELS)
    assert io.scan(spark, store, "marts", "c").count() == 15 and io.scan(spark, store, "raw", "x").count() == 30


def test_readers_of_an_old_version_and_vacuum(spark, store):
    io.build_all(spark, {"x": rows(spark, 4)}, store, MODELS)
    old = io.scan(spark, store, "marts", "a")
    io.build_all(spark, {"x": rows(spark, 40)}, store, MODELS)
    assert old.count() == 2  # a plan made before goes on reading its own files
    assert io.vacuum(spark, store, keep=2) == []
    assert len(io.vacuum(spark, store, keep=1)) == 1 and io.scan(spark, store, "marts", "a").count() == 20


def test_sweep_deletes_old_intermediate_tables_only(spark):
    kept = rows(spark, 3)
    table = settle.settle(kept)
    name = table.inputFiles()[0].split("/")[-2]
    assert name not in settle.sweep(spark, hours=1) and table.count() == 3
    fs, at = files._at(spark, f"{settle.shared(spark)}/{name}")
    fs.setTimes(at, 1000, -1)
    other = f"{settle.shared(spark)}/settled-of-a-user"
    kept.write.mode("overwrite").parquet(other)
    fs.setTimes(files._at(spark, other)[1], 1000, -1)
    assert settle.sweep(spark, hours=1) == [name] and not files.exists(spark, f"{settle.shared(spark)}/{name}") and files.exists(spark, other)
    files.delete(spark, other)


def test_parameters_on_any_file_system(spark, store):
    io.write_text(f"{store}/mmm.json", json.dumps({"channels": {"a": {"beta": 1, "decay": 0.5, "half_sat": 2, "mean_spend": 3}}}))
    assert io.read_mmm(f"{store}/mmm.json") == {"a": {"beta": 1.0, "decay": 0.5, "half_sat": 2.0, "mean_spend": 3.0}}
    with pytest.raises(ValueError):
        io.read_mmm(f"{store}/missing.json")


def test_of_two_builders_one_publishes(spark, store):
    version, _ = io.manifest(spark, store)
    io.publish(spark, store, {"raw.x": "somewhere"}, version)
    with pytest.raises(RuntimeError, match="meanwhile"):
        io.publish(spark, store, {"raw.x": "elsewhere"}, version)
    assert io.manifest(spark, store)[1] == {"raw.x": "somewhere"}
    files.write_text(spark, f"{store}/{io.MANIFESTS}/{version + 2:012d}.json", '{"tables": {"raw')  # a writer that died
    assert io.manifest(spark, store) == (version + 1, {"raw.x": "somewhere"})
    assert io.publish(spark, store, {"raw.y": "there"}, version + 1) == version + 3


def test_bundle_on_any_file_system(spark, store):
    r = [(k, k % 2, float(k % 7 + 3 * (k % 2)), float(k % 5)) for k in range(120)]
    df = spark.createDataFrame(r, "user_id long, churned int, a double, b double")
    model = churn.candidates(("a", "b"))["logistic"].fit(df)
    made = churn.Trained("logistic", model, ("a", "b"), {"logistic": 0.9}, {"roc_auc": 0.9}, {"a": 1.0}, 120, 0.5)
    card = churn.save_bundle(made, f"{store}/bundle")
    got, read = churn.load_bundle(f"{store}/bundle", ("a", "b"))
    assert read == json.loads(json.dumps(card))
    want = {x["user_id"]: x["p"] for x in churn.score(model, df).collect()}
    assert all(x["p"] == pytest.approx(want[x["user_id"]]) for x in churn.score(got, df).collect())
    with pytest.raises(ValueError, match="contract"):
        churn.load_bundle(f"{store}/bundle", ("b", "a"))
    part = next(n for n in files.names(spark, f"{store}/bundle/model/metadata") if n.startswith("part"))
    files.write_text(spark, f"{store}/bundle/model/metadata/{part}", "{}")
    with pytest.raises(ValueError, match="card"):
        churn.load_bundle(f"{store}/bundle", ("a", "b"))


def test_a_tracked_training_run(spark, store):
    r = [(k, k % 2, float(k % 7 + 3 * (k % 2)), float(k % 5)) for k in range(120)]
    model = churn.candidates(("a", "b"))["logistic"].fit(spark.createDataFrame(r, "user_id long, churned int, a double, b double"))
    made = churn.Trained("logistic", model, ("a", "b"), {"logistic": 0.9, "gbt": 0.8}, {"roc_auc": 0.91}, {"a": 1.0}, 120, 0.5)
    t = tracking.Tracker(spark, f"{store}/tracking")
    run = churn.track(made, t, f"{store}/bundles/1")
    t.move("churn", 1, "production")
    row = t.runs("churn").first()
    assert row["run_id"] == run == t.production("churn").run_id and row["metrics"]["cv_roc_auc_gbt"] == 0.8
    _, card = churn.load_bundle(row["artifacts"], ("a", "b"))
    assert card["sha256"] == row["tags"]["sha256"]


def test_two_runs_one_promoted(spark, store):
    t = tracking.Tracker(spark, f"{store}/tracking")
    assert t.runs().count() == 0 and t.production("churn") is None
    first = t.log("churn", {"depth": 3, "rate": 0.1}, {"auc": 0.71, "brier": 0.2}, {"champion": "gbt"}, f"{store}/one")
    second = t.log("churn", {"depth": 5}, {"auc": 0.74})
    t.log("other", {}, {"auc": 0.99})
    assert t.best("churn", "auc") == second and t.best("churn", "brier", highest=False) == first
    one, two = t.register("churn", first), t.register("churn", second)
    t.move("churn", one, "production")
    seen = t.revision("churn")
    t.move("churn", two, "production", seen)
    with pytest.raises(tracking.Conflict):  # decided on what was there before
        t.move("churn", one, "production", seen)
    assert [(v.version, v.run_id, v.stage) for v in t.versions("churn")] == [(1, first, "archived"), (2, second, "production")]
    row = t.runs("churn").where(F.col("run_id") == t.production("churn").run_id).first()
    assert row["params"] == {"depth": "5"} and row["metrics"] == {"auc": 0.74}
    assert {r["run_id"] for r in t.runs("churn").collect()} == {first, second}
    with pytest.raises(LookupError):
        t.register("churn", "unknown")
    with pytest.raises(LookupError):
        t.best("churn", "missing")
    with pytest.raises(ValueError):
        t.move("churn", two, "lost")
    with pytest.raises(ValueError):
        t.revision("../churn")
