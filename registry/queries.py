"""Every registered query: ``name -> (spark, folder of Parquet tables) -> DataFrame``.

The panel is built from order lines: location is the nation, exports by the
supplier's nation and imports by the customer's. Training covers 1995-1996 and
validation 1997-1998, with halves of one year. Doubles are rounded on the way
out so that they can be compared with SQL results.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from growthlens.config import CELL, PAIR, PeriodSpec, Splits
from growthlens.functions.growth import sign_class
from growthlens.functions.scaling import destandardise, share, unminmax
from growthlens.models.learned import (
    FactorisationMachine,
    FactorTrees,
    MatrixFactorisation,
    TARGET,
    TREND_FEATURES,
    als_grid_search,
    evaluate,
    training_rows,
)
from growthlens.operators.aggregates import (
    key_cardinality,
    location_year_totals,
    null_report,
    period_sums,
    shape,
    trend_table,
)
from growthlens.operators.baseline import (
    carry_forward,
    expand,
    growth_baseline,
    rank_pairs,
    score,
    trend_carry_predictions,
)
from growthlens.operators.features import build_features, global_moments, pair_features
from growthlens.operators.metrics import loss_report as losses
from growthlens.operators.metrics import validation_report as validate
from growthlens.operators.neighbours import index_ratings, knn_predict, ratings_of
from growthlens.operators.neighbours import user_similarity as similarities
from growthlens.operators.panel import clean_panel as clean
from growthlens.operators.panel import split_panel
from growthlens.operators.profile import profile as profile_of
from growthlens.operators.ranking import global_rank
from growthlens.operators.recommend import in_order, location_id_of, rank_within, top_n, top_n_all, with_names
from growthlens.operators.refresh import period_state, refresh_year, save_state, state_trends
from growthlens.operators.scaling import scale_global as scaled_globally
from growthlens.operators.scaling import scale_grouped as scaled_by_group
from growthlens.operators.sketches import column_sketches, merged_sketches, rank_error, sketched_quantiles, true_ranks
from growthlens.plans.attach import attach
from growthlens.plans.materialise import materialise, session_folder
from growthlens.plans.pipeline import RunConfig, prep_tables, run_pipeline, save_run
from growthlens.plans.pipeline import recommend_from_store as stored_recommendations
from growthlens.sources.catalog import build_sample, load_panel, open_stores
from growthlens.sources.transactions import (
    event_panel as panel_of_events,
    fine_classes,
    nations_as_locations,
    parts_as_classes,
    trade_panel as panel_of_trade,
)

SPLITS = Splits(PeriodSpec(1995, 1996, 1997), PeriodSpec(1997, 1998, 1999))
LONG = PeriodSpec(1995, 1997, 1999)
EVENT_DAYS = PeriodSpec(1, 9, 17)
LOCATION = "NATION_3"
#: The column of a stored intermediate table that is added up, the first of these that it has.
PREP_AMOUNTS = [
    "export_trend", "export_pct_norm", "export_pct_std", "export_trend_std", "export_period1", "export_period2",
    "export_total_loc_year", "export_value",
]
TOP = 50


def _round(column: str, places: int):
    """Like ``round``, without its detour over decimals; adding 0.0 makes a negative zero positive."""
    step = F.lit(10.0**places)
    return F.rint(F.col(column) * step) / step + F.lit(0.0)


def rounded(df: DataFrame, places: int = 6, **per_column: int) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: _round(c, per_column.get(c, places)) for c in doubles})


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    """The clean panel of both periods, written once per query."""
    return materialise(clean(panel_of_trade(spark, folder, years=SPLITS.years())), "panel")


def _trend_pairs(panel: DataFrame, spec: PeriodSpec, name: str) -> DataFrame:
    return materialise(trend_table(panel, spec), name)


def _both_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    panel = _panel(spark, folder)
    return panel, _trend_pairs(panel, SPLITS.train, "train_pairs"), _trend_pairs(panel, SPLITS.test, "test_pairs")


# --- panel and cleaning -------------------------------------------------------------------------


def trade_panel(spark, folder):
    return panel_of_trade(spark, folder)


def trade_panel_brand(spark, folder):
    return panel_of_trade(spark, folder, product="p_brand")


def trade_panel_type(spark, folder):
    return panel_of_trade(spark, folder, product="p_type")


def event_panel(spark, folder):
    return panel_of_events(spark, folder)


def _sample(spark, folder):
    return build_sample(
        panel_of_trade(spark, folder, product="p_brand"),
        parts_as_classes(spark, folder),
        nations_as_locations(spark, folder),
    )


def panel_sample(spark, folder):
    return _sample(spark, folder)["df2_sample"]


def coarse_classes(spark, folder):
    return _sample(spark, folder)["df_classes"]


def clean_panel(spark, folder):
    return clean(panel_of_trade(spark, folder))


def location_totals(spark, folder):
    return rounded(location_year_totals(clean(panel_of_trade(spark, folder))), 4)


def null_counts(spark, folder):
    return null_report(panel_of_trade(spark, folder))


def profile(spark, folder):
    panel = materialise(clean(panel_of_trade(spark, folder)), "panel")
    return rounded(profile_of(panel, ["export_value", "import_value"]))


def cardinality(spark, folder):
    return key_cardinality(panel_of_trade(spark, folder), CELL)


# --- features -----------------------------------------------------------------------------------


def half_period_sums(spark, folder):
    years = (SPLITS.train.start, SPLITS.train.end)
    return rounded(period_sums(clean(panel_of_trade(spark, folder, years=years)), SPLITS.train), 4)


def trends(spark, folder):
    years = (SPLITS.train.start, SPLITS.train.end)
    return rounded(trend_table(clean(panel_of_trade(spark, folder, years=years)), SPLITS.train))


def trends_long(spark, folder):
    """Halves of two years, and the percentile rank of their trend over panel rows."""
    years = (LONG.start, LONG.end)
    panel = materialise(clean(panel_of_trade(spark, folder, years=years)), "panel")
    return rounded(pair_features(panel, LONG).drop("import_period1", "import_period2"), export_trend_pct_rank=9)


def export_share(spark, folder):
    panel = materialise(clean(panel_of_trade(spark, folder)), "panel")
    totals = location_year_totals(panel).select("location_id", "year", "export_total_loc_year")
    rows = attach(panel, totals, ["location_id", "year"], ["product_id"], "inner")
    pct = share(F.col("export_value"), F.col("export_total_loc_year"))
    return rounded(rows.select(*CELL, pct.alias("export_pct")), 9)


def scale_global(spark, folder):
    rows = split_panel(_panel(spark, folder), SPLITS.train)
    scaled = scaled_globally(rows, {"export_value": {"norm": "export_val_norm_all", "std": "export_val_std_all"}})
    return rounded(scaled.select(*CELL, "export_val_norm_all", "export_val_std_all"))


def scale_grouped(spark, folder):
    rows = split_panel(_panel(spark, folder), SPLITS.train)
    targets = {
        "export_value": {"norm": "export_val_norm", "std": "export_val_std"},
        "import_value": {"norm": "import_val_norm", "std": "import_val_std"},
    }
    scaled = scaled_by_group(rows, ["location_id", "year"], targets, ["product_id"])
    return rounded(
        scaled.select(*CELL, "export_val_norm", "export_val_std", "import_val_norm", "import_val_std")
    )


def trend_classes(spark, folder):
    years = (SPLITS.train.start, SPLITS.train.end)
    pairs = trend_table(clean(panel_of_trade(spark, folder, years=years)), SPLITS.train)
    return pairs.select(*PAIR, sign_class(F.col("export_trend")).alias("export_trend_class"))


def pct_rank(spark, folder):
    ranked = pair_features(_panel(spark, folder), SPLITS.train)
    return rounded(ranked.select(*PAIR, "export_trend_pct_rank"), 9)


FEATURE_PLACES = {"export_total_loc_year": 4, "export_pct": 9}


def feature_table_train(spark, folder):
    return rounded(build_features(_panel(spark, folder), SPLITS.train).rows, **FEATURE_PLACES)


def feature_table_test(spark, folder):
    return rounded(build_features(_panel(spark, folder), SPLITS.test).rows, **FEATURE_PLACES)


# --- change and carry-forward -------------------------------------------------------------------


def baseline(spark, folder):
    _, train, test = _both_pairs(spark, folder)
    out = growth_baseline(train, test)
    return rounded(out.select(*PAIR, "export_period_train", "export_period_test", "export_pct_change"))


def change_classes(spark, folder):
    _, train, test = _both_pairs(spark, folder)
    return growth_baseline(train, test).select(*PAIR, "export_class")


def min_rank(spark, folder):
    panel, train, test = _both_pairs(spark, folder)
    pairs = materialise(growth_baseline(train, test), "baseline")
    ranked = global_rank(pairs, {"export_pct_change": "export_pct_change_rank"}, PAIR, weight="rows")
    return expand(ranked.select(*PAIR, "export_pct_change_rank"), panel, SPLITS.test)


def min_rank_pairs(spark, folder):
    _, train, test = _both_pairs(spark, folder)
    pairs = materialise(growth_baseline(train, test), "baseline")
    ranked = global_rank(pairs, {"export_pct_change": "export_pct_change_rank"}, PAIR)
    return ranked.select(*PAIR, "export_pct_change_rank")


def carry_forward_features(spark, folder):
    panel = _panel(spark, folder)
    train = pair_features(panel, SPLITS.train)
    test = trend_table(panel, SPLITS.test)
    return rounded(carry_forward(test, train).drop("rows"), 9)


def trend_carry(spark, folder):
    _, train, test = _both_pairs(spark, folder)
    return rounded(trend_carry_predictions(test, train), 4)


def _trend_scored(spark, folder, **options) -> tuple[DataFrame, DataFrame]:
    """Panel, and test pairs scored with the trend-carry predictor."""
    panel, train, test = _both_pairs(spark, folder)
    predictions = trend_carry_predictions(test, train)
    return panel, score(growth_baseline(train, test), predictions, **options)


def pred_pct_change(spark, folder):
    _, scored = _trend_scored(spark, folder)
    return rounded(scored.select(*PAIR, "predictions", "pred_pct_change"))


def pred_pct_change_mean_base(spark, folder):
    _, scored = _trend_scored(spark, folder, base="period_mean", train_years=2)
    return rounded(scored.select(*PAIR, "pred_pct_change"))


def _pair_mean(features, column: str) -> DataFrame:
    return features.rows.groupBy(*PAIR).agg(F.avg(column).alias("z"))


def destandardize(spark, folder):
    panel = _panel(spark, folder)
    train, test = build_features(panel, SPLITS.train, ranks=False), build_features(panel, SPLITS.test, ranks=False)
    m = global_moments(test.groups)
    value = destandardise(F.col("z"), m["value_mean"], m["value_std"])
    return rounded(_pair_mean(train, "export_val_std_all").select(*PAIR, value.alias("predictions")), 2)


def destandardize_train_moments(spark, folder):
    train = build_features(_panel(spark, folder), SPLITS.train, ranks=False)
    m = global_moments(train.groups)
    value = destandardise(F.col("z"), m["value_mean"], m["value_std"])
    return rounded(_pair_mean(train, "export_val_std_all").select(*PAIR, value.alias("predictions")))


def unminmaxed(spark, folder):
    panel = _panel(spark, folder)
    train, test = build_features(panel, SPLITS.train, ranks=False), build_features(panel, SPLITS.test, ranks=False)
    m = global_moments(test.groups)
    value = unminmax(F.col("z"), m["value_min"], m["value_max"])
    return rounded(_pair_mean(train, "export_val_norm_all").select(*PAIR, value.alias("predictions")), 2)


# --- recommendation -----------------------------------------------------------------------------

SHOWN = ["position", "location_id", "product_id", "export_period_test", "export_pct_change", "predictions", "pred_pct_change"]


def _scored_rows(spark, folder) -> DataFrame:
    panel, scored = _trend_scored(spark, folder)
    return expand(scored, panel, SPLITS.test)


def _parts(spark, folder) -> DataFrame:
    return fine_classes(spark, folder)


def top_n_location(spark, folder):
    location = location_id_of(nations_as_locations(spark, folder), LOCATION)
    top = top_n(_scored_rows(spark, folder), location, SPLITS.test.last_year, TOP)
    named = in_order(with_names(top.select(*SHOWN), _parts(spark, folder)))
    return rounded(named.withColumn("position", F.col("position").cast("long")))


def top_n_new_goods(spark, folder):
    """New goods of one location by their growth as the neighbourhood model predicts it."""
    cfg = RunConfig(splits=SPLITS, model="knn", n=20, new_goods_only=True)
    panel = clean(panel_of_trade(spark, folder, years=SPLITS.years()))
    run = run_pipeline(panel, _parts(spark, folder), cfg, nations_as_locations(spark, folder), LOCATION)
    return _displayed(run.recommendations)


def _displayed(top: DataFrame, places: int = 2) -> DataFrame:
    whole = {c: F.col(c).cast("long") for c in ("position", "export_pct_change_rank_loc")}
    return rounded(top.withColumns(whole), 4, predictions=places, pred_pct_change=places)


def top_n_all_locations(spark, folder):
    top = top_n_all(_scored_rows(spark, folder), SPLITS.test.last_year, TOP)
    named = with_names(top.select(*SHOWN), _parts(spark, folder))
    return rounded(named.withColumn("position", F.col("position").cast("long")))


def rank_within_top_n(spark, folder):
    panel, scored = _trend_scored(spark, folder)
    ranked = global_rank(
        materialise(scored, "scored"), {"export_pct_change": "export_pct_change_rank"}, PAIR, weight="rows"
    )
    top = top_n_all(expand(ranked, panel, SPLITS.test), SPLITS.test.last_year, TOP)
    top = rank_within(top).withColumnRenamed("export_pct_change_rank_loc", "rank_loc")
    top = rank_within(top, inverted=True).withColumnRenamed("export_pct_change_rank_loc", "rank_loc_inverted")
    return top.select(
        *PAIR, F.col("rank_loc").cast("long"), F.col("rank_loc_inverted").cast("long")
    )


# --- neighbourhood ------------------------------------------------------------------------------


def _trade_ratings(features) -> DataFrame:
    return ratings_of(features.rows, *PAIR, "export_val_norm_all")


def _as_targets(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("location_id").alias("user_id"), F.col("product_id").alias("item_id"))


def ratings(spark, folder):
    return rounded(_trade_ratings(build_features(_panel(spark, folder), SPLITS.train, ranks=False)), 9)


def user_similarity(spark, folder):
    train = build_features(_panel(spark, folder), SPLITS.train, ranks=False)
    return rounded(similarities(index_ratings(_trade_ratings(train))).drop("distance"))


def user_similarity_raw(spark, folder):
    """Similarities of unscaled amounts, shown by the distance they stand for."""
    rows = split_panel(_panel(spark, folder), SPLITS.train)
    known = ratings_of(rows, *PAIR, "export_value")
    out = similarities(index_ratings(known))
    return out.select("user_a", "user_b", "support", _round("distance", 0).alias("distance"))


def knn_predictions(spark, folder):
    panel = _panel(spark, folder)
    train = build_features(panel, SPLITS.train, ranks=False)
    targets = _as_targets(trend_table(panel, SPLITS.test))
    return rounded(knn_predict(index_ratings(_trade_ratings(train)), targets), 9)


def knn_predictions_k5_others(spark, folder):
    """Five neighbours, never the user, at least two of them, with three common items or more."""
    panel = _panel(spark, folder)
    train = build_features(panel, SPLITS.train, ranks=False)
    targets = _as_targets(trend_table(panel, SPLITS.test))
    indexed = index_ratings(_trade_ratings(train))
    return rounded(
        knn_predict(indexed, targets, k=5, min_neighbours=2, min_support=3, include_self=False), 9
    )


def knn_recommendations(spark, folder):
    cfg = RunConfig(splits=SPLITS, model="knn", n=20)
    panel = clean(panel_of_trade(spark, folder, years=SPLITS.years()))
    return _displayed(run_pipeline(panel, _parts(spark, folder), cfg).recommendations)


def recommend_from_store(spark, folder):
    """A run in three stages: raw tables stored, a run stored, recommendations from what was stored."""
    stores = open_stores(spark, f"{session_folder(spark)}/project-{uuid.uuid4().hex}")
    stores["data_full"].write("country_hsproduct6digit_year", panel_of_trade(spark, folder, years=SPLITS.years()))
    stores["data_full"].write("classifications/hs_product", _parts(spark, folder))
    classes = stores["data_full"].classes("classifications/hs_product")
    cfg = RunConfig(splits=SPLITS, model="trend", n=20)
    result = run_pipeline(load_panel(stores, "data_full"), classes, cfg)
    save_run(result, stores["data_full_clean"], stores["data_sample"], "df_predictions", classes=classes)
    return _displayed(stored_recommendations(stores["data_full_clean"], classes, cfg).recommendations, places=4)


def _store(spark, name: str = "data_full"):
    return open_stores(spark, f"{session_folder(spark)}/project-{uuid.uuid4().hex}")[name]


def stored_prep_tables(spark, folder):
    """All named intermediate tables, published together and read back: rows and the sum of one column of each."""
    panel = _panel(spark, folder)
    train, test = (build_features(panel, s, ranks=False) for s in (SPLITS.train, SPLITS.test))
    store = _store(spark)
    store.write_all(prep_tables(panel, SPLITS, train, test), replace=True)
    store, parts = store.pinned(), []
    for key in store.keys():
        table = store.read(key)
        column = next(c for c in PREP_AMOUNTS if c in table.columns)
        parts.append(table.agg(F.lit(key).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(column).alias("amount")))
    return rounded(reduce(DataFrame.unionByName, parts), 1)


def stored_year_replaced(spark, folder):
    """A panel stored by year, one year of it replaced; totals of the years from then on."""
    store, year = _store(spark), SPLITS.test.start
    stored = store.write("panel", panel_of_trade(spark, folder, years=SPLITS.years()), partition_by=["year"])
    corrected = clean(stored.filter(F.col("year") == year)).filter(F.col("location_id") < 10)
    now = store.replace_partitions("panel", corrected.withColumn("export_value", F.col("export_value") + 1000))
    return rounded(location_year_totals(clean(now.filter(F.col("year") >= year))), 4)


def refreshed_trends(spark, folder):
    """Trends of the test split from a stored state of its first year and the second year appended."""
    store, spec = _store(spark), SPLITS.test
    stored = store.write("panel", clean(panel_of_trade(spark, folder, years=SPLITS.years())), partition_by=["year"])
    save_state(store, "test", period_state(stored.filter(F.col("year") < spec.last_year), spec))
    return rounded(state_trends(refresh_year(store, "panel", "test", spec.last_year)))


def sketched_quartiles(spark, folder):
    """Quartiles from sketches stored per year, and whether their true ranks are within twice the stated error."""
    store = _store(spark)
    stored = store.write("panel", clean(panel_of_trade(spark, folder)), partition_by=["year"])
    sketches = store.write("sketches", column_sketches(stored, ["export_value", "import_value"], ["year"]), partition_by=["year"])
    found = true_ranks(stored, sketched_quantiles(merged_sketches(sketches), [0.25, 0.5, 0.75]))
    return found.select("column", "probability", F.col("n").alias("rows"), (F.col("off") <= 2 * rank_error()).alias("within"))


def table_shapes(spark, folder):
    """Rows and columns of the features of both splits."""
    panel = _panel(spark, folder)
    found = [(name, *shape(build_features(panel, s, ranks=False).rows)) for name, s in (("train", SPLITS.train), ("test", SPLITS.test))]
    return spark.createDataFrame(found, "table string, rows long, columns int")


def panel_head(spark, folder):
    """The first rows of the panel in key order."""
    return clean(panel_of_trade(spark, folder)).orderBy("location_id", "product_id", "year").limit(20)


def _event_ratings(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Scaled ratings of the first days, and the user-item pairs of the later ones."""
    panel = materialise(clean(panel_of_events(spark, folder)), "events")
    rows = split_panel(panel, EVENT_DAYS)
    scaled = scaled_globally(rows, {"export_value": {"norm": "rating"}})
    return ratings_of(scaled, *PAIR, "rating"), _as_targets(panel.filter(F.col("year") >= EVENT_DAYS.end))


def event_user_similarity(spark, folder):
    known, _ = _event_ratings(spark, folder)
    return rounded(similarities(index_ratings(known)).drop("distance"))


def event_knn_predictions(spark, folder):
    known, targets = _event_ratings(spark, folder)
    return rounded(knn_predict(index_ratings(known), targets), 9)


# --- metrics ------------------------------------------------------------------------------------


def _rounded_report(report: DataFrame) -> DataFrame:
    is_cosine = F.col("metric").startswith("cosine")
    return report.withColumn("value", F.when(is_cosine, _round("value", 6)).otherwise(_round("value", 2)))


def validation_report(spark, folder):
    _, scored = _trend_scored(spark, folder)
    report = validate(rank_pairs(materialise(scored, "scored")))
    return _rounded_report(report)


def validation_report_pairs(spark, folder):
    _, scored = _trend_scored(spark, folder)
    report = validate(rank_pairs(materialise(scored, "scored"), level="pair"), weight=None)
    return _rounded_report(report)


def loss_report(spark, folder):
    """Standardised test values against the pair's mean standardised training value, 0 if unseen."""
    panel = _panel(spark, folder)
    train, test = build_features(panel, SPLITS.train, ranks=False), build_features(panel, SPLITS.test, ranks=False)
    known = _pair_mean(train, "export_val_std_all")
    rows = test.rows.select(*PAIR, "export_val_std_all").join(known, PAIR, "left").fillna(0.0, ["z"])
    return rounded(losses(rows, "export_val_std_all", "z"))


# --- trained models: no SQL equivalent ----------------------------------------------------------


def _model_predictions(spark, folder, model) -> DataFrame:
    panel = _panel(spark, folder)
    train, test = build_features(panel, SPLITS.train), build_features(panel, SPLITS.test)
    m = global_moments(test.groups)
    fitted = model.fit(training_rows(train.rows))
    z = fitted.predict(carry_forward(test.pairs, train.pairs))
    return z.select(*PAIR, destandardise(F.col("z"), m["value_mean"], m["value_std"]).alias("predictions"))


def _model_checks(spark, folder, model) -> DataFrame:
    """Per test pair whether it has a finite prediction, and whether the model beats the mean on what it was trained on.

    The amounts of the test tables are drawn at random, so nothing beats the mean on the later years.
    """
    panel = _panel(spark, folder)
    train = build_features(panel, SPLITS.train)
    rows = training_rows(train.rows)
    fitted = model.fit(rows)
    test = trend_table(panel, SPLITS.test)
    z = materialise(fitted.predict(carry_forward(test, train.pairs)), "model_predictions")
    own = fitted.predict(rows.select(*PAIR, *TREND_FEATURES).distinct())
    known = rows.select(*PAIR, TARGET).join(own, PAIR)
    errors = known.agg(F.avg((F.col(TARGET) - F.col("z")) ** 2).alias("model"), F.var_pop(TARGET).alias("mean")).first()
    finite = F.col("z").isNotNull() & ~F.isnan("z")
    return z.select(*PAIR, finite.alias("predicted"), F.lit(errors["model"] < errors["mean"]).alias("beats_mean"))


def als_checks(spark, folder):
    return _model_checks(spark, folder, MatrixFactorisation())


def gbt_checks(spark, folder):
    return _model_checks(spark, folder, FactorTrees())


def fm_checks(spark, folder):
    return _model_checks(spark, folder, FactorisationMachine())


def als_predictions(spark, folder):
    return _model_predictions(spark, folder, MatrixFactorisation())


def fm_predictions(spark, folder):
    return _model_predictions(spark, folder, FactorisationMachine())


def gbt_predictions(spark, folder):
    return _model_predictions(spark, folder, FactorTrees())


def model_evaluation(spark, folder):
    """Losses of the boosted trees on the test rows."""
    panel = _panel(spark, folder)
    train, test = build_features(panel, SPLITS.train), build_features(panel, SPLITS.test)
    model = FactorTrees().fit(training_rows(train.rows))
    return evaluate(model, training_rows(test.rows))


def als_grid(spark, folder):
    train = build_features(_panel(spark, folder), SPLITS.train)
    return rounded(als_grid_search(train.rows, regs=(0.01, 0.1), ranks=(1, 2), folds=2, iterations=2)[1], mse=5)


def als_fixed_start(spark, folder):
    """Two rounds of two factors from the start that the ids' hashes give: predictions for the test pairs."""
    panel = _panel(spark, folder)
    train = build_features(panel, SPLITS.train)
    model = MatrixFactorisation(factors=2, iterations=2).fit(training_rows(train.rows))
    return rounded(model.predict(trend_table(panel, SPLITS.test)), 5)


def als_rounds(spark, folder):
    """Losses per round on the training and the held-out pairs, and which round a stored and reloaded model is."""
    train = build_features(_panel(spark, folder), SPLITS.train)
    model = MatrixFactorisation(factors=2, iterations=3, validation=0.25).fit(training_rows(train.rows))
    path = f"{session_folder(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    return rounded(MatrixFactorisation.load(spark, path).history(spark), 5)


def recommend_end_to_end(spark, folder):
    panel = clean(panel_of_trade(spark, folder, years=SPLITS.years()))
    return run_pipeline(panel, _parts(spark, folder), RunConfig(splits=SPLITS, model="als")).recommendations


QUERIES = {
    "trade_panel": trade_panel,
    "trade_panel_brand": trade_panel_brand,
    "trade_panel_type": trade_panel_type,
    "event_panel": event_panel,
    "panel_sample": panel_sample,
    "coarse_classes": coarse_classes,
    "clean_panel": clean_panel,
    "location_year_totals": location_totals,
    "null_report": null_counts,
    "profile": profile,
    "key_cardinality": cardinality,
    "period_sums": half_period_sums,
    "trend_table": trends,
    "export_share": export_share,
    "scale_global": scale_global,
    "scale_grouped": scale_grouped,
    "trend_table_long": trends_long,
    "trend_class": trend_classes,
    "pct_rank": pct_rank,
    "feature_table_train": feature_table_train,
    "feature_table_test": feature_table_test,
    "growth_baseline": baseline,
    "change_class": change_classes,
    "min_rank": min_rank,
    "min_rank_pairs": min_rank_pairs,
    "carry_forward_features": carry_forward_features,
    "trend_carry_predictions": trend_carry,
    "pred_pct_change": pred_pct_change,
    "pred_pct_change_mean_base": pred_pct_change_mean_base,
    "destandardize": destandardize,
    "destandardize_train_moments": destandardize_train_moments,
    "unminmax": unminmaxed,
    "top_n_location": top_n_location,
    "top_n_new_goods": top_n_new_goods,
    "top_n_all_locations": top_n_all_locations,
    "rank_within_top_n": rank_within_top_n,
    "ratings": ratings,
    "user_similarity": user_similarity,
    "knn_predictions": knn_predictions,
    "knn_predictions_k5_others": knn_predictions_k5_others,
    "knn_recommendations": knn_recommendations,
    "recommend_from_store": recommend_from_store,
    "stored_prep_tables": stored_prep_tables,
    "stored_year_replaced": stored_year_replaced,
    "refreshed_trends": refreshed_trends,
    "sketched_quartiles": sketched_quartiles,
    "table_shapes": table_shapes,
    "panel_head": panel_head,
    "user_similarity_raw": user_similarity_raw,
    "event_user_similarity": event_user_similarity,
    "event_knn_predictions": event_knn_predictions,
    "validation_report": validation_report,
    "validation_report_pairs": validation_report_pairs,
    "loss_report": loss_report,
    "als_checks": als_checks,
    "gbt_checks": gbt_checks,
    "fm_checks": fm_checks,
    "als_predictions": als_predictions,
    "fm_predictions": fm_predictions,
    "gbt_predictions": gbt_predictions,
    "model_evaluation": model_evaluation,
    "als_grid_search": als_grid,
    "als_fixed_start": als_fixed_start,
    "als_rounds": als_rounds,
    "recommend_end_to_end": recommend_end_to_end,
}
