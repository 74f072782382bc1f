import random

import pytest
from pyspark.sql import functions as F

from growthlens.config import PAIR, PeriodSpec, Splits
from growthlens.models import learned
from growthlens.models.learned import (
    FactorisationMachine,
    FactorTrees,
    MatrixFactorisation,
    TARGET,
    als_grid_search,
    evaluate,
)
from growthlens.operators.baseline import carry_forward
from growthlens.plans.materialise import materialise
from growthlens.plans.pipeline import RunConfig, prep_tables, recommend_from_store, run_pipeline, save_run, split_features
from growthlens.sources.catalog import PREP_KEYS, TableCatalog

from conftest import by_key

SPLITS = Splits(PeriodSpec(1995, 1996, 1997), PeriodSpec(1997, 1998, 1999))
PANEL = "location_id long, product_id long, year int, export_value double, import_value double"


@pytest.fixture(scope="module")
def panel(frame):
    """Values are a location level times a product level, with noise and gaps."""
    rng = random.Random(11)
    size = {loc: rng.uniform(1, 10) for loc in range(8)}
    weight = {prod: rng.uniform(1, 10) for prod in range(25)}
    rows = [
        (loc, prod, year, round(size[loc] * weight[prod] * rng.uniform(0.8, 1.2), 2), 1.0)
        for loc in size
        for prod in weight
        for year in range(1995, 1999)
        if rng.random() < 0.85
    ]
    return materialise(frame(rows, PANEL))


@pytest.fixture(scope="module")
def classes(frame):
    return frame([(p, f"product {p}", "2digit") for p in range(25)], "index long, name string, level string")


@pytest.fixture(scope="module")
def split(panel):
    train, test = split_features(panel, SPLITS)
    return train, test


def test_trend_run_for_every_location(panel, classes):
    result = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="trend", n=3))
    recs = result.recommendations.collect()
    assert len(recs) == 8 * 3 and all(r["name"] == f"product {r['product_id']}" for r in recs)
    assert result.scored.filter("year not in (1997, 1998)").count() == 0
    assert result.scored.count() == result.test.rows.count()
    metrics = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert 0.9 < metrics["cosine_train_test_value"] <= 1.0


def test_options_change_what_they_say(panel, classes, frame):
    locations = frame([(i, f"L{i}") for i in range(8)], "index long, name_en string")
    base = RunConfig(splits=SPLITS, model="trend", n=5)
    one = run_pipeline(panel, classes, base, locations, "L3").recommendations
    assert {r["location_id"] for r in one.collect()} == {3} and one.count() == 5
    inverted = run_pipeline(
        panel, classes, RunConfig(splits=SPLITS, model="trend", n=5, inverted=True), locations, "L3"
    ).recommendations
    a, b = (by_key(x, "product_id") for x in (one, inverted))
    assert [a[k]["export_pct_change_rank_loc"] for k in a] == [6 - b[k]["export_pct_change_rank_loc"] for k in a]
    new = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="trend", n=50, new_goods_only=True))
    assert {r["export_period_train"] for r in new.scored.join(new.recommendations, PAIR, "left_semi").collect()} == {0.0}
    pairs = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="trend", level="pair"))
    assert pairs.scored.agg(F.max("export_pct_change_rank")).first()[0] <= pairs.test.pairs.count()


def test_knn_run_covers_every_test_row(panel, classes):
    result = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="knn", moments="train", base="period_mean"))
    assert result.scored.filter("predictions is null").count() == 0
    assert result.scored.count() == result.test.rows.count()


def in_sample_mse(model, rows):
    """Error on the training rows, of the model and of the mean (whose error is the variance)."""
    z = model.predict(rows.select(*PAIR, "export_trend_class", "export_trend_pct_rank").distinct())
    return rows.join(z, PAIR).agg(F.avg((F.col(TARGET) - F.col("z")) ** 2), F.var_pop(TARGET)).first()


@pytest.mark.parametrize(
    "make,load",
    [
        (lambda: MatrixFactorisation(iterations=5), MatrixFactorisation.load),
        (lambda: FactorisationMachine(iterations=4), FactorisationMachine.load),
        (lambda: FactorTrees(trees=5), FactorTrees.load),
        (lambda: FactorTrees(full_features=False, trees=5), lambda s, p: FactorTrees.load(s, p, False)),
    ],
    ids=["als", "fm", "gbt", "gbt-ids-only"],
)
def test_models_beat_the_mean_and_survive_saving(spark, split, tmp_path, make, load):
    train, test = split
    rows = materialise(train.rows)
    model = make().fit(rows)
    error, variance = in_sample_mse(model, rows)
    assert error < 0.7 * variance
    model.save(str(tmp_path / "model"))
    carried = materialise(carry_forward(test.pairs, train.pairs))
    before = by_key(model.predict(carried), *PAIR)
    after = by_key(load(spark, str(tmp_path / "model")).predict(carried), *PAIR)
    assert before == after and len(before) == test.pairs.count()


@pytest.mark.parametrize("make", [MatrixFactorisation, FactorisationMachine, FactorTrees])
def test_wide_ids_give_what_narrow_ids_give_and_unseen_pairs_give_zero(split, make):
    rows = materialise(split[0].rows)
    wide = {c: F.col(c) * 2**40 - 2**62 for c in PAIR}
    settings = {"iterations": 3} if make is not FactorTrees else {"trees": 2}
    narrow_model, wide_model = make(**settings).fit(rows), make(**settings).fit(materialise(rows.withColumns(wide)))
    pairs = rows.select(*PAIR, *learned.TREND_FEATURES).distinct()
    extra = pairs.limit(1).withColumn("product_id", F.lit(999).cast("long"))
    pairs = materialise(pairs.unionByName(extra))
    a = by_key(narrow_model.predict(pairs).withColumns(wide), *PAIR)
    b = by_key(wide_model.predict(materialise(pairs.withColumns(wide))), *PAIR)
    assert set(a) == set(b)
    for key in a:
        assert a[key]["z"] == pytest.approx(b[key]["z"], abs=1e-6)
    assert [r["z"] for k, r in a.items() if k[1] == 999 * 2**40 - 2**62] == [0.0]


def test_recommendations_are_ordered_and_carry_their_position(panel, classes, frame):
    locations = frame([(i, f"L{i}") for i in range(8)], "index long, name_en string")
    run = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="trend", n=9), locations, "L2")
    rows = run.recommendations.collect()
    assert [r["position"] for r in rows] == list(range(1, 10))
    growth = [r["pred_pct_change"] for r in rows]
    assert growth == sorted(growth, reverse=True)


@pytest.mark.parametrize("kind", ["trend", "als", "knn"])
def test_recommending_from_stores_gives_what_the_run_gave(spark, panel, classes, tmp_path, kind):
    cfg = RunConfig(splits=SPLITS, model=kind, n=4, model_options={"iterations": 3} if kind == "als" else {})
    result = run_pipeline(panel, classes, cfg)
    clean, predictions = TableCatalog(spark, str(tmp_path / "clean")), TableCatalog(spark, str(tmp_path / "out"))
    save_run(result, clean, predictions, "df_predictions", classes=classes, model_path=str(tmp_path / "model"))
    assert predictions.read("df_predictions").filter("name is null").count() == 0
    path = str(tmp_path / "model") if kind == "als" else None
    again = recommend_from_store(clean, classes, cfg, model_path=path)
    assert by_key(again.recommendations, "location_id", "position") == by_key(result.recommendations, "location_id", "position")
    if kind == "als":
        with pytest.raises(ValueError):
            recommend_from_store(clean, classes, cfg)


def test_scenarios_and_losses_on_carried_features(panel, classes, split):
    seen = []

    def rising(test_pairs, train_pairs):
        seen.append(1)
        return carry_forward(test_pairs, train_pairs).withColumn("export_trend_class", F.lit(1))

    cfg = RunConfig(splits=SPLITS, model="gbt", n=2, model_options={"trees": 2}, scenario=rising)
    result = run_pipeline(panel, classes, cfg)
    assert seen and result.recommendations.count() == 16
    carried = materialise(carry_forward(split[1].pairs, split[0].pairs))
    losses = evaluate(result.model, split[1].rows, carried)
    assert {r["metric"] for r in losses.collect()} == {"mse", "mae", "logcosh", "huber", "cosine"}


def test_evaluation_and_saved_run(spark, panel, classes, split, tmp_path):
    model = MatrixFactorisation(iterations=5).fit(split[0].rows)
    losses = {r["metric"]: r["value"] for r in evaluate(model, split[1].rows).collect()}
    assert set(losses) == {"mse", "mae", "logcosh", "huber", "cosine"} and losses["cosine"] > 0.8

    result = run_pipeline(panel, classes, RunConfig(splits=SPLITS, model="als"), model=model)
    assert result.model is model
    clean, predictions = TableCatalog(spark, str(tmp_path / "clean")), TableCatalog(spark, str(tmp_path / "out"))
    predictions.write("df_knn", panel.limit(1))
    save_run(result, clean, predictions, "df_predictions_als")
    wanted = sorted(f"{t}{part}" for t in ("test", "train") for part in ("", "_groups", "_pairs"))
    assert clean.keys() == wanted and predictions.keys() == ["df_knn", "df_predictions_als"]
    stored = clean.read("train")
    assert stored.columns == result.train.rows.columns and stored.count() == result.train.rows.count()


def test_unseen_products_are_kept(spark, split, frame):
    train, _ = split
    pairs = frame([(0, 999, 0, 0.5), (77, 1, 0, 0.5)], "location_id long, product_id long, export_trend_class int, export_trend_pct_rank double")
    for model in (MatrixFactorisation(iterations=2), FactorTrees(trees=2), FactorisationMachine(iterations=2)):
        assert [r["z"] for r in model.fit(train.rows).predict(pairs).collect()] == [0.0, 0.0]


def test_grid_search_marks_the_best(split):
    _, table = als_grid_search(split[0].rows, regs=(0.05, 5.0), ranks=(3,), iterations=2)
    rows = table.collect()
    assert [r["reg"] for r in rows if r["best"]] == [0.05] and len(rows) == 2


def test_prep_tables_are_written_and_read_back(spark, panel, split, tmp_path):
    tables = prep_tables(panel, SPLITS, *split)
    assert list(sorted(tables)) == sorted(PREP_KEYS)
    catalog = TableCatalog(spark, str(tmp_path / "prep"))
    catalog.write_all({k: tables[k] for k in ("df_groupsum", "df_95_04_sum2", "train_trend_std")})
    assert catalog.read("train_trend_std").count() == split[0].rows.count()
    assert catalog.keys() == ["df_95_04_sum2", "df_groupsum", "train_trend_std"]
