import random
import threading

import pytest

from orderlens.operators import ml_data, ml_metrics, ml_models
from orderlens.plans import registry
from orderlens.schema import order_input_schema
from orderlens.sources.star import Star

STAR_DIR = "/root/testdata/sf0.001"
SMALL = {ml_models.RANDOM_FOREST: dict(numTrees=10, maxDepth=5), ml_models.GRADIENT_BOOSTING: dict(maxIter=5)}


@pytest.fixture(scope="module")
def parts(spark):
    star = Star(spark, STAR_DIR)
    return registry._part(star, "train"), registry._part(star, "test")


@pytest.fixture(scope="module")
def models(parts):
    return ml_models.fit_models(parts[0], overrides=SMALL)


def metrics_of(frame):
    return {r["metric"]: r["value"] for r in ml_metrics.ml_metrics(frame).collect()}


def test_all_models_beat_the_majority(parts, models):
    base = ml_metrics.ml_majority_baseline(*parts).collect()[0]["accuracy"]
    for name, model in models.items():
        found = metrics_of(ml_models.predict(model, parts[1], name))
        assert found["accuracy"] > base and found["roc_auc"] > 0.65


def test_unseen_category_is_scored(parts, models):
    row = parts[1].drop("label").limit(1)
    changed = row.withColumn("order_region", registry.F.lit("Atlantis"))
    scored = ml_models.ml_batch_score(models[ml_models.DECISION_TREE], changed).collect()
    assert len(scored) == 1 and 0.0 <= scored[0]["late_delivery_probability"] <= 1.0


def test_scoring_layout(spark, models):
    order = (4, 250.0, 2, 0.05, 125.0, "Standard Class", "NATION_1", "AFRICA", "Brand#1", "ECONOMY", "BUILDING", "A", "Monday")
    scored = ml_models.ml_batch_score(models[ml_models.LOGISTIC_REGRESSION], spark.createDataFrame([order], order_input_schema()))
    row = scored.collect()[0]
    assert row["predicted_late"] == (row["late_delivery_probability"] >= 0.5)


def test_importance_has_named_features(spark, models):
    top = ml_models.ml_feature_importance(spark, models[ml_models.RANDOM_FOREST]).collect()
    assert len(top) == 15 and "days_for_shipment_scheduled" in {r["feature"] for r in top}
    assert any(r["feature"].startswith("shipping_mode_") for r in top)


def test_split_is_stable_and_proportional(spark):
    df = spark.range(20000).selectExpr("id", "CAST(id % 3 = 0 AS int) AS label")
    split = ml_data.ml_stratified_split(df, identity=["id"])
    shares = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label in (0, 1):
        share = shares[label, "test"] / (shares[label, "test"] + shares[label, "train"])
        assert abs(share - 0.2) < 0.01
    again = ml_data.ml_stratified_split(df.repartition(5), identity=["id"])
    assert split.exceptAll(again).count() == 0


def counted(split):
    return {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 999, 20011])
def test_split_is_exact_for_every_class(spark, n):
    df = spark.range(n).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 3 = 0 AS int) END AS label")
    shares = counted(ml_data.ml_stratified_split(df, identity=["id"]))
    for label, size in {(r["label"], r["count"]) for r in df.groupBy("label").count().collect()}:
        assert shares.get((label, "test"), 0) == size // 5
        assert shares.get((label, "train"), 0) == size - size // 5


def test_split_of_repeated_rows_is_exact_and_keeps_columns(spark):
    df = spark.range(3000).selectExpr("id % 3 AS id", "CAST(1 AS int) AS label", "id % 2 AS extra")
    split = ml_data.ml_stratified_split(df, identity=["id"])
    assert counted(split) == {(1, "test"): 600, (1, "train"): 2400} and split.columns == ["id", "label", "extra", "split"]
    again = ml_data.ml_stratified_split(df.repartition(5), identity=["id"])
    assert split.exceptAll(again).count() == 0 and again.exceptAll(split).count() == 0


def test_split_takes_the_smallest_hashes(spark):
    df = spark.range(500).selectExpr("id", "CAST(id % 2 AS int) AS label")
    rows = ml_data.ml_stratified_split(df, identity=["id"]).withColumn("h", ml_data.split_hash(["id"])).collect()
    for label in (0, 1):
        mine = sorted((r["h"], r["split"]) for r in rows if r["label"] == label)
        assert [s for _, s in mine] == ["test"] * 50 + ["train"] * 200


def test_leakage_guard():
    assert ml_data.ml_leakage_guard(["sales"]) == ["sales"]
    with pytest.raises(ValueError):
        ml_data.ml_leakage_guard(["sales", "delivery_status"])
    with pytest.raises(ValueError):
        ml_data.ml_leakage_guard(["late_delivery_risk"], "B")


def scored(spark, data, model="m"):
    return spark.createDataFrame([(model, *row) for row in data], "model string, label int, prediction int, score double")


def test_auc_and_curve_match_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 1), 0, round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, _, s in data if y], [s for y, _, s in data if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    frame = scored(spark, data)
    assert ml_metrics.roc_auc(frame).collect()[0]["auc"] == pytest.approx(expected, abs=1e-12)
    for r in ml_metrics.ml_roc_curve(frame).collect():
        assert r["tpr"] == round(sum(s >= r["threshold"] for s in pos) / len(pos), 6)
        assert r["fpr"] == round(sum(s >= r["threshold"] for s in neg) / len(neg), 6)


def test_metrics_without_positive_predictions(spark):
    found = metrics_of(scored(spark, [(1, 0, 0.1), (0, 0, 0.2)]))
    assert found == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1_score": 0.0, "roc_auc": 0.0}


def test_confusion_matrix_shows_empty_cells(spark):
    cells = {(r["label"], r["prediction"]): r["n"] for r in ml_metrics.ml_confusion_matrix(scored(spark, [(1, 1, 0.9)])).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_best_model_by_auc(spark):
    good, bad = scored(spark, [(1, 1, 0.9), (0, 0, 0.1)], "good"), scored(spark, [(1, 1, 0.1), (0, 0, 0.9)], "bad")
    assert ml_metrics.ml_best_model(ml_metrics.ml_metrics(good.unionByName(bad))).collect()[0]["best_model"] == "good"


def test_models_do_not_depend_on_cores_or_files(spark, parts):
    """The same forest at 2 and 64 partitions and from other files: equal scores, row by row."""

    def scores(train, partitions):
        small = {ml_models.RANDOM_FOREST: dict(numTrees=6, maxDepth=4), ml_models.DECISION_TREE: dict(maxDepth=4)}
        found = ml_models.fit_models(train, list(small), overrides=small, partitions=partitions)
        return {
            name: sorted(r["score"] for r in ml_models.predict(model, parts[1], name).collect()) for name, model in found.items()
        }

    assert scores(parts[0].repartition(2), 2) == scores(parts[0].repartition(11), 64)


def test_partitions_follow_rows_or_cores():
    assert ml_models.training_partitions(0, 8) == 8
    assert ml_models.training_partitions(200_000 * 8 + 1, 8) == 9
    assert ml_models.training_partitions(10**9, 8) == 5000


def test_bootstrap_weights_are_poisson_and_go_by_row(spark):
    rows = spark.range(40_000).selectExpr("xxhash64(id) AS place")
    one = ml_models.with_poisson_weight(rows, 0, 42)
    shares = {r["weight"]: r["count"] / 40_000 for r in one.groupBy("weight").count().collect()}
    for k, share in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert abs(shares[float(k)] - share) < 0.01
    assert one.exceptAll(ml_models.with_poisson_weight(rows.repartition(7), 0, 42)).count() == 0
    other = ml_models.with_poisson_weight(rows, 1, 42)
    same = one.join(other.withColumnRenamed("weight", "w"), "place").filter("weight = w").count() / 40_000
    assert 0.25 < same < 0.37


def test_the_forest_survives_storing(spark, parts, models):
    name = ml_models.RANDOM_FOREST
    path = registry.scratch_path(spark, "forest")
    ml_models.save_model(models[name], path)
    gap = ml_models.score_difference(models[name], ml_models.load_model(path), parts[1]).collect()[0]
    assert gap["n"] > 0 and gap["n_different"] == 0


def test_a_forest_has_partitions_by_core_and_the_same_trees(spark, monkeypatch):
    assert ml_models.forest_partitions(36_000_000, 12) == 12
    assert ml_models.forest_partitions(4_000_000 * 12 + 1, 12) == 13
    taken = []
    fit = ml_models._fit_forest

    def seen(vectors, seed, options):
        taken.append(vectors.rdd.getNumPartitions())
        return fit(vectors, seed, options)

    monkeypatch.setattr(ml_models, "_fit_forest", seen)
    train = registry._part(Star(spark, "/root/testdata/sf0.001"), "train")
    options = {ml_models.RANDOM_FOREST: dict(numTrees=4, maxDepth=4)}
    trees = [
        ml_models.fit_models(train, [ml_models.RANDOM_FOREST], overrides=options, partitions=n)[ml_models.RANDOM_FOREST].stages[-2].toDebugString
        for n in (40, 3)
    ]
    assert taken == [8, 3]
    assert trees[0].split("\n")[1:] == trees[1].split("\n")[1:]


def test_rows_of_the_split_are_hashed_once(spark):
    hashed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            hashed.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr("id", "id % 2 AS label").mapInArrow(counted, "id long, label long")
    split = ml_data.ml_stratified_split(rows, identity=["id"])
    assert hashed.value == 1000
    assert sorted(tuple(r) for r in split.groupBy("split", "label").count().collect()) == [
        ("test", 0, 100), ("test", 1, 100), ("train", 0, 400), ("train", 1, 400),
    ]


def test_equal_rows_are_trained_once_with_their_number(spark, parts, monkeypatch):
    """Three copies of the rows: no more rows to pass over, and the same scores."""
    sizes, plain = [], ml_models.classifier

    def seen(*args, **options):
        made = plain(*args, **options)
        fit = made.fit
        made.fit = lambda rows: sizes.append(rows.count()) or fit(rows)
        return made

    monkeypatch.setattr(ml_models, "classifier", seen)
    options = {ml_models.DECISION_TREE: dict(maxDepth=4), ml_models.GRADIENT_BOOSTING: dict(maxIter=2)}
    once, thrice = parts[0], parts[0].unionByName(parts[0]).unionByName(parts[0])
    found = [ml_models.fit_models(rows, list(options), overrides=options) for rows in (once, thrice)]
    assert sizes == [once.distinct().count()] * 4
    for name in options:
        scores = [sorted(r["score"] for r in ml_models.predict(models[name], parts[1], name).collect()) for models in found]
        assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_models_of_one_query_share_their_preparation(spark, monkeypatch):
    prepared, plain = [], ml_models.ml_preprocess
    monkeypatch.setattr(ml_models, "ml_preprocess", lambda variant="A": prepared.append(variant) or plain(variant))
    monkeypatch.setattr(registry, "_FITTED", {})
    small = {ml_models.RANDOM_FOREST: dict(numTrees=4, maxDepth=3), ml_models.GRADIENT_BOOSTING: dict(maxIter=2)}
    fit = ml_models.fit_models
    monkeypatch.setattr(ml_models, "fit_models", lambda train, names, variant="A": fit(train, names, variant, overrides=small))
    assert registry._all_predictions(Star(spark, STAR_DIR)).select("model").distinct().count() == 4
    assert prepared == ["A"]


def test_held_out_rows_are_scored_once(spark, monkeypatch):
    """Metrics read stored predictions: no plan of theirs holds a model, and no model scores again."""
    scored, plain = [], ml_models.predict
    monkeypatch.setattr(ml_models, "predict", lambda model, rows, name: scored.append(name) or plain(model, rows, name))
    monkeypatch.setattr(registry, "_SHARED", {})
    star, name = Star(spark, STAR_DIR), ml_models.DECISION_TREE
    found = [ml_metrics.ml_metrics(registry._predictions(star, name)) for _ in range(2)]
    assert scored == [name]
    assert "UDF" not in found[0]._jdf.queryExecution().optimizedPlan().toString()
    direct = metrics_of(plain(registry._model(star, name), registry._part(star, "test"), name))
    assert [{r["metric"]: r["value"] for r in f.collect()} for f in found] == [direct, direct]


def test_models_of_one_query_are_fitted_at_once(parts, monkeypatch):
    """Each fit waits for the other to begin, which one after the other never would."""
    both, plain = threading.Barrier(2), ml_models.classifier

    def met(name, *args, **options):
        both.wait(60)
        return plain(name, *args, **options)

    monkeypatch.setattr(ml_models, "classifier", met)
    options = {ml_models.DECISION_TREE: dict(maxDepth=2), ml_models.GRADIENT_BOOSTING: dict(maxIter=1)}
    assert list(ml_models.fit_models(parts[0], list(options), overrides=options)) == list(options)


def test_samples_of_a_forest_share_its_partitions():
    """Samples fitted at once fill the cores together, where each once had all partitions."""
    assert [ml_models.samples_at_once(4, n) for n in (1, 2, 3, 4, 6, 8, 12)] == [1, 1, 1, 2, 2, 4, 4]
    assert ml_models.sample_partitions(480_000, 8, 4) == 2
    assert ml_models.sample_partitions(480_000, 6, 2) == 3
    assert ml_models.sample_partitions(3_000_000, 12, 4) == 6
    assert ml_models.sample_partitions(10**9, 250, 4) == 250
    assert ml_models.sample_partitions(0, 1, 1) == 1


def test_a_forest_leaves_cores_to_the_models_beside_it(parts, monkeypatch):
    taken, fit = [], ml_models._fit_forest
    monkeypatch.setattr(ml_models, "_fit_forest", lambda rows, *rest: taken.append(rows.rdd.getNumPartitions()) or fit(rows, *rest))
    options = {ml_models.RANDOM_FOREST: dict(numTrees=4, maxDepth=3), ml_models.DECISION_TREE: dict(maxDepth=2)}
    ml_models.fit_models(parts[0], list(options), overrides=options)
    assert taken == [parts[0].sparkSession.sparkContext.defaultParallelism // 2]


def test_held_out_rows_are_scored_on_all_cores(spark, monkeypatch):
    """A small table is read in one task; the rows are scored in one per core, and all of them."""
    seen, plain = [], ml_models.predict
    monkeypatch.setattr(
        ml_models, "predict", lambda model, rows, name: seen.append(rows.rdd.getNumPartitions()) or plain(model, rows, name)
    )
    monkeypatch.setattr(registry, "_SHARED", {})
    star = Star(spark, STAR_DIR)
    scored = registry._predictions(star, ml_models.DECISION_TREE)
    assert seen == [spark.sparkContext.defaultParallelism]
    assert scored.count() == registry._part(star, "test").count()


def test_models_of_one_query_score_at_once(spark, monkeypatch):
    """Each model waits for the three others to begin scoring, which one after the other never would."""
    all_four, plain = threading.Barrier(4), ml_models.predict

    def met(*args):
        all_four.wait(60)
        return plain(*args)

    monkeypatch.setattr(ml_models, "predict", met)
    monkeypatch.setattr(registry, "_FITTED", {})
    monkeypatch.setattr(registry, "_SHARED", {})
    small = {ml_models.RANDOM_FOREST: dict(numTrees=4, maxDepth=3), ml_models.GRADIENT_BOOSTING: dict(maxIter=2)}
    fit = ml_models.fit_models
    monkeypatch.setattr(ml_models, "fit_models", lambda train, names, variant="A": fit(train, names, variant, overrides=small))
    assert registry._all_predictions(Star(spark, STAR_DIR)).select("model").distinct().count() == 4
