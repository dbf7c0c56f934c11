"""The model registry, and tree explanations against brute force over all subsets."""
import itertools
import math
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from pastcast.ml.explain import LOG_ODDS, TreeExplainer, node_table
from pastcast.ml.registry import ModelRegistry, put_if_absent


@pytest.fixture(scope="module")
def rows(spark):
    a, b = F.col("id") % 7, F.rand(1) * 5
    df = spark.range(600).select("id", a.cast("double").alias("a"), b.alias("b"), (F.col("id") % 5).cast("double").alias("d"),
                                 F.concat(F.lit("k"), F.col("id") % 4).alias("c"))
    return df.withColumn("label", ((F.col("a") + F.col("b") > 5) | (F.col("c") == "k1")).cast("int")).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    """One-hot slots, and an indexed column with four categories."""
    stages = [StringIndexer(inputCols=["c"], outputCols=["i"]), OneHotEncoder(inputCols=["i"], outputCols=["o"]),
              VectorAssembler(inputCols=["a", "b", "o", "i", "d"], outputCol="features"),
              GBTClassifier(maxIter=4, maxDepth=4, labelCol="label", seed=1, stepSize=0.3, subsamplingRate=0.8)]
    return Pipeline(stages=stages).fit(rows)


def expected_value(nodes, at, x, known):
    """A tree's value where only the features in ``known`` are seen: other branches by their share of rows."""
    r = nodes[at]
    if r["left"] < 0:
        return r["prediction"]
    if r["feature"] in known:
        v = x[r["feature"]]
        left = v in r["split"] if r["categories"] >= 0 else v <= r["split"][0]
        return expected_value(nodes, r["left"] if left else r["right"], x, known)
    return sum(nodes[c]["n"] / r["n"] * expected_value(nodes, c, x, known) for c in (r["left"], r["right"]))


def test_contributions_against_all_subsets(spark, rows, fitted):
    explainer = TreeExplainer(fitted, spark)
    trees = {}
    for r in node_table(fitted.stages[-1], spark).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    assert any(r["categories"] > 2 for t in trees.values() for r in t.values())
    got = {r["id"]: r for r in explainer.contributions(rows, ["id"]).collect()}
    assert len(got) == 600
    few = fitted.transform(rows.where("id % 60 = 0")).collect()
    weights, n = fitted.stages[-1].treeWeights, explainer.slots
    for row in few:
        x, phi = row["features"].toArray(), np.zeros(n)
        value = {s: sum(LOG_ODDS * weights[t] * expected_value(nodes, 0, x, s) for t, nodes in trees.items())
                 for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            for s in value:
                if i not in s:
                    w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                    phi[i] += w * (value[tuple(sorted((*s, i)))] - value[s])
        assert np.allclose(got[row["id"]]["contribution"], phi, atol=1e-9)
        assert abs(explainer.base_value - value[()]) < 1e-9


def test_contributions_add_up_on_every_row(spark, rows, fitted):
    explainer = TreeExplainer(fitted, spark)
    c = explainer.contributions(rows, ["id"])
    off = F.abs(F.col("base_value") + F.aggregate("contribution", F.lit(0.0), lambda s, v: s + v) - F.log(F.col("p") / (1 - F.col("p"))))
    assert c.agg(F.max(off)).first()[0] < 1e-9
    assert explainer.contributions(rows.limit(0), ["id"]).count() == 0
    names = ["a", "b", "c_k0", "c_k1", "c_k2", "c", "d"]
    long = explainer.explain(rows, ["id"], names, ["a", "b", "c", "d"])
    sums = long.groupBy("id", "p", "base_value").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n"))
    bad = sums.where((F.col("n") != 4) | (F.abs(F.col("base_value") + F.col("s") - F.log(F.col("p") / (1 - F.col("p")))) > 1e-9))
    assert sums.count() == 600 and bad.count() == 0
    assert long.where("feature = 'c' AND value IS NOT NULL").count() == 0 and long.where("feature = 'a' AND value IS NULL").count() == 0


def _text(spark, text):
    return lambda path: spark.createDataFrame([(text,)], "t string").coalesce(1).write.text(path)


def test_put_if_absent(spark, tmp_path):
    assert put_if_absent(spark, f"{tmp_path}/x.json", "one")
    assert not put_if_absent(spark, f"{tmp_path}/x.json", "two")
    assert (tmp_path / "x.json").read_text() == "one" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]


def test_registry_resolves_stage_then_fallback_then_error(spark, tmp_path):
    reg = ModelRegistry(spark, f"{tmp_path}/reg")
    with pytest.raises(LookupError):
        reg.resolve("m", "production")
    _text(spark, "local")(f"{tmp_path}/local")
    assert reg.resolve("m", "production", f"{tmp_path}/local") == (f"{tmp_path}/local", None)
    assert reg.publish("m", _text(spark, "one"), {"trees": 3}, {"auc": 0.5}, stage="production") == 1
    assert reg.publish("m", _text(spark, "two")) == 2
    assert reg.publish("other", _text(spark, "three"), stage="production") == 1
    path, version = reg.resolve("m", "production", f"{tmp_path}/local")
    assert version == 1 and spark.read.text(path).first()[0] == "one"
    reg.set_stage("m", 2, "production")
    assert reg.resolve("m", "production")[1] == 2  # the latest of the stage
    reg.set_stage("m", 2, "archived")
    assert reg.resolve("m", "production")[1] == 1
    with pytest.raises(LookupError):
        reg.set_stage("m", 3, "production")
    with pytest.raises(LookupError):
        reg.resolve("m", "staging", f"{tmp_path}/nothing")
    got = {(r["name"], r["version"], r["stage"]) for r in reg.versions().collect()}
    assert got == {("m", 1, "production"), ("m", 2, "archived"), ("other", 1, "production")}
    assert reg.versions().where("name = 'm' AND version = 1").first()["params"] == '{"trees": 3}'


def test_a_failed_save_publishes_nothing(spark, tmp_path):
    reg = ModelRegistry(spark, f"{tmp_path}/reg")

    def fails(path):
        raise OSError("disk")
    with pytest.raises(OSError):
        reg.publish("m", fails)
    assert reg.log().count() == 0


def test_two_writers_never_take_one_version(spark, tmp_path):
    got, errors = [], []

    def work(k):
        try:
            reg = ModelRegistry(spark, f"{tmp_path}/reg")
            got.extend(reg.publish("m", _text(spark, f"{k}-{i}"), stage="production") for i in range(3))
        except Exception as e:  # shown below
            errors.append(e)
    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(got) == list(range(1, 13))
    reg = ModelRegistry(spark, f"{tmp_path}/reg")
    assert reg.versions().where("stage = 'production'").select("path").distinct().count() == 12
    assert reg.log().select("seq").distinct().count() == reg.log().count() == 24


def test_tables_of_the_selection_and_the_split_are_made_once(spark):
    """Counted values are read, not counted again; features go to one table, not by way of a checkpoint."""
    import datetime as dt
    from pyspark.sql import functions as F
    from pastcast.operators.selection import value_table
    from pastcast.plans import ml_plans
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, "b", 0), (None, None, 1), (2.0, "a", 0)], "x DOUBLE, g STRING, label INT")
    values = value_table(df, ["x"], ["g"], "label")
    assert "Generate" not in plan(values) and "Aggregate" not in plan(values)
    assert sorted((r.feature, r.x, r.pos, r.neg) for r in values.collect()) == [
        ("g_a", 0.0, 0, 1), ("g_a", 1.0, 2, 1), ("g_b", 0.0, 2, 1), ("g_b", 1.0, 0, 1), ("x", 1.0, 1, 0), ("x", 2.0, 1, 2)]
    runs = spark.range(40).select(
        (F.col("id") % 4).alias("entity_id"), (F.col("id") % 3).alias("rider_id"), F.col("id").alias("contest_id"), F.col("id").cast("double").alias("px"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("event_date"), F.lit(1).alias("venue_id"), F.lit(1000).alias("distance_m"),
        F.lit(50.0).alias("load_kg"), (F.col("id") % 5 + 1).cast("int").alias("finish_pos"), F.lit(1.0).alias("dividend"), F.lit(1).alias("label"))
    assert not any("Scan ExistingRDD" in plan(part) for part in ml_plans._frozen(spark, runs))


def test_only_the_features_that_are_asked_for_are_written(spark, tmp_path, monkeypatch):
    from pastcast.plans import ml_plans
    made = []
    monkeypatch.setattr(ml_plans, "read_through", lambda spark, name, build: made.append(name.split("_")[1]))
    monkeypatch.setattr(ml_plans, "source_key", lambda spark, sf_dir: "key")
    assert len(ml_plans._split_features(spark, "no folder", ("test",))) == 1
    assert len(ml_plans._split_features(spark, "no folder")) == 2
    assert made == ["test", "train", "test"]


def test_tasks_of_features_are_small(spark):
    """Rows of a shuffle above 16 MB are dealt out to more tasks (AQE gave a task 64 MB before)."""
    from pastcast.operators.asof import TASK_BYTES, co_partition
    co_partition(spark)
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").rstrip("b")) == TASK_BYTES
    assert TASK_BYTES <= 16 << 20


def test_leaves_add_what_their_tables_say():
    """Contributions by columns are those of the tables by the number of met conditions; questions of a tree are asked once."""
    import numpy as np
    from pastcast.ml import explain as X
    rng, inf = np.random.default_rng(1), float("inf")
    leaves = X.Leaves(np.array([[0, 2], [0, 1], [3, 0]]), np.array([[-inf, 0.2], [0.5, -inf], [-inf, 0.1]]),
                      np.array([[0.5, inf], [inf, 0.4], [inf, 0.9]]), {(2, 0): np.array([True, False, True])},
                      np.array([[0.3, 0.6], [0.7, 0.2], [0.4, 0.8]]), np.array([1.5, -2.0, 0.25]))
    x = rng.random((200, 4))
    x[:, 3] = rng.integers(-1, 5, 200)
    x[::7, 0], x[::11, 2] = np.nan, 0.2
    want, table = np.zeros((200, 4)), leaves.table()
    for r in range(200):
        for leaf in range(3):
            bits = 0
            for place, f in enumerate(leaves.features[leaf]):
                mask, v = leaves.masks.get((leaf, place)), x[r, f]
                met = 0 <= v < 3 and mask[int(v)] if mask is not None else leaves.low[leaf, place] < v <= leaves.high[leaf, place]
                bits |= bool(met) << place
            for place, f in enumerate(leaves.features[leaf]):
                want[r, f] += table[leaf, bits, place]
    out, known = np.zeros((4, 200)), {}
    leaves.add(leaves.columns(), np.ascontiguousarray(x.T), out, known)
    assert np.allclose(out.T, want, atol=1e-12) and len(known) == 6
    assert leaves.table_bytes() == leaves.columns().nbytes
    leaves.add(leaves.columns(), np.ascontiguousarray(x.T), out, known)
    assert np.allclose(out.T, 2 * want, atol=1e-12) and len(known) == 6


def test_both_parts_of_a_split_are_made_in_one_pass(spark, monkeypatch):
    """The one pass gives the rows of two jobs, with days, contests and rows repeated, and keys and days missing."""
    import datetime as dt
    import uuid
    from pyspark.sql import functions as F
    from pastcast.plans import ml_plans
    i = F.col("id")
    runs = spark.range(300).select(
        F.when(i % 13 != 0, i % 7).alias("entity_id"), (i % 5).alias("rider_id"), F.floor(i / 3).alias("contest_id"), (i % 50).cast("double").alias("px"),
        F.when(i % 29 != 0, F.date_add(F.lit(dt.date(2020, 1, 1)), F.floor(i / 9).cast("int"))).alias("event_date"), (i % 3).cast("int").alias("venue_id"),
        (1000 + i % 4 * 50).cast("int").alias("distance_m"), (50 + i % 6).cast("double").alias("load_kg"), (i % 5 + 1).cast("int").alias("finish_pos"),
        (i % 4).cast("double").alias("dividend"), F.lit(1).alias("label"))
    runs = runs.union(runs.where("contest_id % 10 = 0"))
    want = [sorted(map(str, part.collect())) for part in ml_plans._frozen(spark, runs)]
    calls, whole = [], ml_plans.point_in_time_features
    monkeypatch.setattr(ml_plans, "point_in_time_features", lambda *a, **kw: calls.append(1) or whole(*a, **kw))
    names = [f"split_{part}_{uuid.uuid4().hex}" for part in ("train", "test")]
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    got = ml_plans._split_tables(spark, names, [0, 1], lambda: runs)
    assert [sorted(map(str, part.collect())) for part in got] == want and len(calls) == 1
    assert [part.columns for part in got] == [part.columns for part in ml_plans._frozen(spark, runs)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    ml_plans._split_tables(spark, names, [0, 1], lambda: 1 / 0)  # they are there


def test_a_part_without_rows_is_a_table(spark):
    import uuid
    from pyspark.sql import functions as F
    from pastcast.sources.tables import has_table, publish_parts, read_through
    names = [f"parts_{i}_{uuid.uuid4().hex}" for i in range(3)]
    publish_parts(spark, names, spark.range(5), F.when(F.col("id") < 2, 0).otherwise(2))
    tables = [read_through(spark, name, None) for name in names]
    assert [sorted(r[0] for r in t.collect()) for t in tables] == [[0, 1], [], [2, 3, 4]] and all(t.columns == ["id"] for t in tables)
    publish_parts(spark, names[:1], spark.range(9), F.lit(0))  # another job was first: its table stays
    assert read_through(spark, names[0], None).count() == 2 and has_table(spark, names[0]) and not has_table(spark, "none")


def test_train_classifier_fits_the_whole_model(spark, tmp_path, monkeypatch):
    """The fit has the reference's 600 trees, by the query's own rows; the other keys' model, of its own name, is as it was."""
    from pastcast.plans import ml_plans
    rows = spark.range(40).select(F.col("id").alias("contest_id"), F.lit(1.0).alias("px"), (F.col("id") % 2).cast("int").alias("label"),
                                  (F.col("id") % 7).cast("double").alias("career_runs"), F.lit("M").alias("sex_code"), F.lit("1").alias("racetrack_id"))
    fits, fit = [], ml_plans.ML.fit
    monkeypatch.setattr(ml_plans.ML, "fit", lambda train, num, cat, params: fits.append(params) or fit(train, num, cat, {**params, "maxIter": 1}))
    monkeypatch.setattr(ml_plans, "_registry", lambda spark: ModelRegistry(spark, f"{tmp_path}/registry"))
    monkeypatch.setattr(ml_plans, "_prepared", lambda *a: (rows, rows, ["career_runs"]))
    monkeypatch.setattr(ml_plans, "_split_features", lambda *a: (rows, rows))
    monkeypatch.setattr(ml_plans, "source_key", lambda spark, sf_dir, *more: "".join(filter(str.isalnum, "".join(more))))
    assert ml_plans._train_classifier(spark, "no folder").count() == 40
    assert ml_plans.ML.build_pipeline(["career_runs"], [], fits[0]).getStages()[-1].getMaxIter() == ml_plans.ML.REFERENCE_PARAMS["maxIter"] == 600
    ml_plans._fitted(spark, "no folder", ["career_runs"])
    ml_plans._train_classifier(spark, "no folder")
    assert [p["maxIter"] for p in fits] == [600, 40]  # each is fitted once
