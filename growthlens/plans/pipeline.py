"""The whole run: features of both periods, a model, scores, recommendations, metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from growthlens.config import CELL, DECADES, PAIR, Splits
from growthlens.functions.scaling import destandardise, unminmax
from growthlens.models.learned import MODELS, training_rows
from growthlens.operators.aggregates import location_year_totals
from growthlens.operators.baseline import (
    carry_forward,
    expand,
    growth_baseline,
    rank_pairs,
    score,
    trend_carry_predictions,
)
from growthlens.operators.features import Features, build_features, global_moments
from growthlens.operators.metrics import validation_report
from growthlens.operators.neighbours import index_ratings, knn_predict, ratings_of
from growthlens.operators.panel import split_panel
from growthlens.operators.recommend import (
    DISPLAY_COLUMNS,
    in_order,
    location_id_of,
    rank_within,
    top_n,
    top_n_all,
    with_names,
)
from growthlens.plans.materialise import materialise, materialise_by
from growthlens.sources.catalog import TableCatalog


COLOCATE_ROWS = 10_000_000


@dataclass(frozen=True)
class RunConfig:
    """What to predict with, and how to measure and rank it."""

    splits: Splits = DECADES
    model: str = "als"  # als, fm, gbt, knn or trend
    full_features: bool = True  # fm and gbt: use the trend features
    base: str = "period_total"  # or period_mean
    moments: str = "test"  # period whose moments undo the scaling; or train
    level: str = "row"  # ranks and metrics over panel rows; or pair
    n: int = 50
    new_goods_only: bool = False
    inverted: bool = False  # rank of actual change within the top: 1 is the lowest
    colocate: bool | None = None  # bucket panel and pairs by pair; None: from COLOCATE_ROWS rows on
    model_options: dict = field(default_factory=dict)
    # What the test pairs carry into the model: (test pairs, train pairs) -> pairs with trend class and rank.
    scenario: Callable[[DataFrame, DataFrame], DataFrame] = carry_forward


@dataclass(frozen=True)
class RunResult:
    recommendations: DataFrame
    scored: DataFrame
    metrics: DataFrame
    train: Features
    test: Features
    model: object


def write_panel(panel: DataFrame, colocate: bool | None = None) -> tuple[DataFrame, bool]:
    """The panel as a written table, and whether it is bucketed by pair.

    A run groups the panel by pair and joins it with pair tables several times.
    For a large one a single shuffle into buckets replaces those.
    """
    panel = materialise(panel, "panel")
    if colocate is None:
        colocate = panel.count() >= COLOCATE_ROWS
    return (materialise_by(panel, PAIR, "panel") if colocate else panel), colocate


def split_features(panel: DataFrame, splits: Splits, colocate: bool = False) -> tuple[Features, Features]:
    """Features of both periods from one written panel."""
    train, test = (build_features(panel, spec, colocate=colocate) for spec in (splits.train, splits.test))
    return train, test


def prep_tables(panel: DataFrame, splits: Splits, train: Features, test: Features) -> dict[str, DataFrame]:
    """The named intermediate tables, lazily; write them with a catalog if wanted."""
    tables = {"df": panel, "df_groupsum": location_year_totals(panel)}
    for name, split_name, spec, features in (
        ("df_95_04", "train", splits.train, train),
        ("df_05_14", "test", splits.test, test),
    ):
        rows = split_panel(panel, spec)
        tables[name] = rows
        for half, inside in (("1", spec.in_first_half), ("2", spec.in_second_half)):
            tables[f"{name}_sum{half}"] = (
                rows.filter(inside(F.col("year")))
                .groupBy(*PAIR)
                .agg(
                    F.sum("export_value").alias(f"export_period{half}"),
                    F.sum("import_value").alias(f"import_period{half}"),
                )
            )
        tables[f"{name}_trend"] = features.pairs
        for column in ("pct_norm", "pct_std", "trend_std"):
            tables[f"{split_name}_{column}"] = features.rows.select(*CELL, f"export_{column}")
    return tables


def _undo(kind: str, value: Column, features: Features) -> Column:
    """Back from scaled to amounts, by the moments of the given period."""
    moment = global_moments(features.groups)
    if kind == "knn":
        return unminmax(value, moment["value_min"], moment["value_max"])
    return destandardise(value, moment["value_mean"], moment["value_std"])


def fit_model(train: Features, cfg: RunConfig):
    options = dict(cfg.model_options)
    if cfg.model in ("fm", "gbt"):
        options.setdefault("full_features", cfg.full_features)
    return MODELS[cfg.model](**options).fit(training_rows(train.rows))


def predict(train: Features, test: Features, cfg: RunConfig, model=None) -> tuple[DataFrame, object]:
    """Predicted amount of every test pair, and the model that gave it."""
    scale = {"test": test, "train": train}[cfg.moments]
    if cfg.model == "trend":
        return trend_carry_predictions(test.pairs, train.pairs), None
    if cfg.model == "knn":
        indexed = index_ratings(ratings_of(train.rows, *PAIR, "export_val_norm_all"))
        wanted = test.pairs.select(F.col("location_id").alias("user_id"), F.col("product_id").alias("item_id"))
        rated = knn_predict(indexed, wanted, **cfg.model_options)
        amounts = rated.select(
            F.col("user_id").alias("location_id"),
            F.col("item_id").alias("product_id"),
            _undo("knn", F.col("prediction"), scale).alias("predictions"),
        )
        return amounts, None
    model = model or fit_model(train, cfg)
    carried = cfg.scenario(test.pairs, train.pairs)
    amounts = model.predict(carried).select(*PAIR, _undo(cfg.model, F.col("z"), scale).alias("predictions"))
    return amounts, model


def score_pairs(train: Features, test: Features, predictions: DataFrame, cfg: RunConfig) -> DataFrame:
    """Written table of test pairs with actual and predicted change and all four ranks."""
    years = cfg.splits.train.end - cfg.splits.train.start
    scored = score(growth_baseline(train.pairs, test.pairs), predictions, cfg.base, years)
    return materialise(rank_pairs(materialise(scored, "scored"), cfg.level), "ranked")


def recommend(scored: DataFrame, classes: DataFrame, cfg: RunConfig, location: int | None = None) -> DataFrame:
    """Top rows of one location, from the best down, or of every location by ``position``; with names and the rank within the top."""
    year = cfg.splits.test.last_year
    if location is not None:
        top = top_n(scored, location, year, cfg.n, new_goods_only=cfg.new_goods_only)
    else:
        rows = scored.filter(F.col("export_period_train") == 0) if cfg.new_goods_only else scored
        top = top_n_all(rows, year, cfg.n)
    named = with_names(rank_within(top, cfg.inverted), classes).select("location_id", *DISPLAY_COLUMNS)
    return in_order(named) if location is not None else named


def run_pipeline(
    panel: DataFrame,
    classes: DataFrame,
    cfg: RunConfig = RunConfig(),
    locations: DataFrame | None = None,
    location_name: str | None = None,
    model=None,
) -> RunResult:
    """Clean panel in, recommendations out. Pass ``model`` to use one fitted earlier."""
    panel, colocate = write_panel(panel, cfg.colocate)
    train, test = split_features(panel, cfg.splits, colocate)
    return finish_run(train, test, panel, classes, cfg, locations, location_name, model)


def finish_run(
    train: Features,
    test: Features,
    cells: DataFrame,
    classes: DataFrame,
    cfg: RunConfig,
    locations: DataFrame | None = None,
    location_name: str | None = None,
    model=None,
) -> RunResult:
    """Predict, score and recommend from features; ``cells`` holds location, product and year of the test rows."""
    location = location_id_of(locations, location_name) if location_name is not None else None
    predictions, model = predict(train, test, cfg, model)
    pairs = score_pairs(train, test, predictions, cfg)
    scored = expand(pairs, cells, cfg.splits.test)
    metrics = validation_report(pairs, "rows" if cfg.level == "row" else None)
    return RunResult(recommend(scored, classes, cfg, location), scored, metrics, train, test, model)


def save_run(
    result: RunResult,
    clean: TableCatalog,
    predictions: TableCatalog,
    predictions_key: str,
    prep: TableCatalog | None = None,
    prep_frames: dict[str, DataFrame] | None = None,
    classes: DataFrame | None = None,
    model_path: str | None = None,
) -> None:
    """Store a run: train and test with their pairs and groups replace the clean store, the model goes
    to ``model_path``, and predictions, with names if ``classes`` are given, keep the keys beside theirs.

    The named intermediate tables are written only when a store for them is given.
    """
    tables = {}
    for name, features in (("train", result.train), ("test", result.test)):
        tables |= {name: features.rows, f"{name}_pairs": features.pairs, f"{name}_groups": features.groups}
    clean.write_all(tables, replace=True)
    if model_path is not None and result.model is not None:
        result.model.save(model_path)
    predictions.write(predictions_key, result.scored if classes is None else with_names(result.scored, classes))
    if prep is not None:
        prep.write_all(prep_frames or {}, replace=True)


def load_features(clean: TableCatalog) -> tuple[Features, Features]:
    """Train and test features of a stored run, all of one publication."""
    clean = clean.pinned()
    train, test = (
        Features(clean.read(name), clean.read(f"{name}_pairs"), clean.read(f"{name}_groups")) for name in ("train", "test")
    )
    return train, test


def recommend_from_store(
    clean: TableCatalog,
    classes: DataFrame,
    cfg: RunConfig = RunConfig(),
    locations: DataFrame | None = None,
    location_name: str | None = None,
    model_path: str | None = None,
) -> RunResult:
    """Recommendations and metrics from the stored features and a stored model; nothing is cleaned or trained anew.

    Without a model path the neighbourhood and trend predictors work from the stored tables; the others need one.
    """
    model = None
    if cfg.model in MODELS:
        if model_path is None:
            raise ValueError(f"a stored {cfg.model} model is needed")
        options = {"full_features": cfg.full_features} if cfg.model in ("fm", "gbt") else {}
        model = MODELS[cfg.model].load(clean.spark, model_path, **options)
    train, test = load_features(clean)
    return finish_run(train, test, test.rows.select(*CELL), classes, cfg, locations, location_name, model)
