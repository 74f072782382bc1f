"""SQL twins of the registered queries, for DuckDB on the same Parquet tables.

They follow the definitions row by row (outer joins, unpartitioned windows,
self-joins), not the way the Spark side computes them. Rounding adds 0.0 so
that a negative zero equals zero.
"""

from __future__ import annotations


def r(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0)"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def panel_raw(product: str = "l_partkey", extra: str = "") -> str:
    """Order lines to panel: exports and imports grouped apart, then outer-joined."""
    return f"""
lines AS (
  SELECT s_nationkey::BIGINT AS exporter, c_nationkey::BIGINT AS importer, ({product})::BIGINT AS product_id,
         year(o_orderdate)::INTEGER AS year,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey {extra}
),
exports AS (
  SELECT exporter AS location_id, product_id, year, CAST(sum(value) AS DOUBLE) AS export_value
  FROM lines GROUP BY ALL
),
imports AS (
  SELECT importer AS location_id, product_id, year, CAST(sum(value) AS DOUBLE) AS import_value
  FROM lines GROUP BY ALL
),
panel_raw AS (
  SELECT location_id, product_id, year, export_value, import_value
  FROM exports FULL OUTER JOIN imports USING (location_id, product_id, year)
)"""


PANEL = (
    panel_raw()
    + """,
panel AS (
  SELECT location_id, product_id, year, coalesce(export_value, 0) AS export_value,
         coalesce(import_value, 0) AS import_value
  FROM panel_raw WHERE coalesce(export_value, 0) >= 0
)"""
)


def coded_panel(column: str) -> str:
    codes = f"""
codes AS (
  SELECT {column}, dense_rank() OVER (ORDER BY {column}) - 1 AS code
  FROM (SELECT DISTINCT {column} FROM part)
)"""
    extra = f"JOIN part ON l_partkey = p_partkey JOIN codes USING ({column})"
    return codes + "," + panel_raw("code", extra)


def growth(new: str, old: str) -> str:
    return f"(({new}) - ({old})) / ({old})"


def pairs(split: str, start: int, mid: int, end: int) -> str:
    """Half sums, totals and trends of one split; ``{split}_all`` also keeps pairs without a first half."""
    sums = ", ".join(
        f"""sum({f}_value) FILTER (year < {mid}) AS {f}_period1,
    sum({f}_value) FILTER (year >= {mid}) AS {f}_period2, sum({f}_value) AS {f}_period_total"""
        for f in ("export", "import")
    )
    trends = ", ".join(
        f"""{f}_period1, coalesce({f}_period2, 0) AS {f}_period2,
    CASE WHEN {f}_period2 IS NULL THEN 0.0
         WHEN {f}_period1 = 0 THEN abs({f}_period2)
         ELSE {growth(f + "_period2", f + "_period1")} END AS {f}_trend, {f}_period_total"""
        for f in ("export", "import")
    )
    return f"""
{split}_all AS (
  SELECT location_id, product_id, {sums},
         count(*) FILTER (year < {mid}) AS rows1, count(*) AS "rows"
  FROM panel WHERE year >= {start} AND year < {end} GROUP BY location_id, product_id
),
{split}_pairs AS (
  SELECT location_id, product_id, {trends}, "rows" FROM {split}_all WHERE rows1 > 0
)"""


TRAIN_PAIRS = pairs("train", 1995, 1996, 1997)
TEST_PAIRS = pairs("test", 1997, 1998, 1999)
TOTALS = """
totals AS (
  SELECT location_id, year, sum(export_value) AS export_total_loc_year,
         sum(import_value) AS import_total_loc_year
  FROM panel GROUP BY location_id, year
)"""


def minmax(x: str, over: str) -> str:
    low, high = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return f"coalesce(CASE WHEN {high} > {low} THEN ({x} - {low}) / ({high} - {low}) END, 0)"


def standard(x: str, over: str) -> str:
    low, high = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    mean, std = f"avg({x}) OVER ({over})", f"stddev_samp({x}) OVER ({over})"
    return f"coalesce(CASE WHEN {high} > {low} THEN ({x} - {mean}) / {std} END, 0)"


def features(split: str, start: int, end: int) -> str:
    """Feature rows by plain windows, and the class and percentile rank over them."""
    group, location = "PARTITION BY location_id, year", "PARTITION BY location_id"
    scaled = ",\n         ".join(
        f"{f(column, over)} AS {name}_{kind}{suffix}"
        for name, column, over, suffix in (
            ("export_val", "export_value", "", "_all"),
            ("export_pct", "export_pct", "", "_all"),
            ("export_val", "export_value", group, ""),
            ("export_pct", "export_pct", group, ""),
            ("export_trend", "export_trend", location, ""),
        )
        for kind, f in (("norm", minmax), ("std", standard))
    )
    return f"""
{split}_rows AS (
  SELECT location_id, product_id, year, export_value, export_total_loc_year, export_period1, export_period2,
         export_period_total, export_trend,
         CASE WHEN export_total_loc_year <> 0 THEN export_value / export_total_loc_year END AS export_pct
  FROM panel JOIN totals USING (location_id, year) JOIN {split}_pairs USING (location_id, product_id)
  WHERE year >= {start} AND year < {end}
),
{split} AS (
  SELECT * REPLACE (coalesce(export_pct, 0) AS export_pct),
         {scaled},
         CAST(sign(export_trend) AS INTEGER) AS export_trend_class,
         (rank() OVER (ORDER BY export_trend)
          + (count(*) OVER (PARTITION BY export_trend) - 1) / 2.0) / count(*) OVER () AS export_trend_pct_rank
  FROM {split}_rows
)"""


TRAIN = features("train", 1995, 1997)
TEST = features("test", 1997, 1999)

RATED = """
rated AS MATERIALIZED (SELECT location_id, product_id, year, export_val_std_all AS y FROM train)"""


def share_of(*parts: str) -> str:
    return f"(('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:8])::BIGINT / 4294967296.0)"


def ridge(name: str, rows: str, other: str, key: str, theirs: str, rank: int, reg: float) -> str:
    """The half step of least squares for every ``key``, solved in closed form for one or two factors."""
    sums = "a + {r} * n AS a, b, c + {r} * n AS c, s0, s1".format(r=reg)
    inner = f"""SELECT {key}, count(*) AS n, sum(v0 * v0) AS a, sum(v0 * v1) AS b, sum(v1 * v1) AS c, sum(v0 * y) AS s0, sum(v1 * y) AS s1
    FROM {rows} JOIN {other} USING ({theirs}) GROUP BY {key}"""
    if rank == 1:
        solved = "s0 / a AS v0, 0.0 AS v1"
    else:
        solved = "(c * s0 - b * s1) / (a * c - b * b) AS v0, (a * s1 - b * s0) / (a * c - b * b) AS v1"
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, {solved} FROM (SELECT {key}, {sums} FROM ({inner}))
)"""


def factorised(prefix: str, rows: str, rank: int, reg: float, rounds: int, seed: int = 42) -> list[str]:
    """Alternating least squares from the fixed start; ``{prefix}_u{i}`` and ``{prefix}_q{i}`` after round ``i``."""
    start = [f"({share_of(f"'{seed}:start:{j}'", 'number')} - 0.5) * {2 / rank**0.5!r} AS v{j}" for j in range(rank)]
    start += ["0.0 AS v1"] * (rank == 1)
    steps = [f"{prefix}_q0 AS MATERIALIZED (SELECT product_id, {', '.join(start)} FROM (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS number FROM (SELECT DISTINCT product_id FROM {rows})))"]
    for i in range(1, rounds + 1):
        steps.append(ridge(f"{prefix}_u{i}", rows, f"{prefix}_q{i - 1}", "location_id", "product_id", rank, reg))
        steps.append(ridge(f"{prefix}_q{i}", rows, f"{prefix}_u{i}", "product_id", "location_id", rank, reg))
    return steps


def predicted(rows: str, u: str, q: str) -> str:
    """``y`` and the model's value of rows, 0 without a side."""
    return f"""SELECT location_id, product_id, y, coalesce({u}.v0 * {q}.v0 + {u}.v1 * {q}.v1, 0) AS z
  FROM {rows} LEFT JOIN {u} USING (location_id) LEFT JOIN {q} USING (product_id)"""


def grid(regs=(0.01, 0.1), ranks=(1, 2), folds: int = 2, rounds: int = 2, seed: int = 42) -> str:
    fold = f"floor({share_of(f"'{seed}:fold'", 'location_id', 'product_id', 'year')} * {folds})::INTEGER"
    steps = [f"folded AS MATERIALIZED (SELECT *, {fold} AS fold FROM rated)"]
    cells = []
    for f in range(folds):
        steps += [f"in{f} AS (SELECT * FROM folded WHERE fold <> {f})", f"out{f} AS (SELECT * FROM folded WHERE fold = {f})"]
        for i, reg in enumerate(regs):
            for rank in ranks:
                name = f"m{f}_{i}_{rank}"
                steps += factorised(name, f"in{f}", rank, reg, rounds)
                cells.append(
                    f"SELECT {reg} AS reg, {rank} AS factors, (y - z) * (y - z) AS e FROM ({predicted(f'out{f}', f'{name}_u{rounds}', f'{name}_q{rounds}')})"
                )
    steps.append("scores AS (SELECT reg, factors, avg(e) AS mse FROM (" + "\nUNION ALL ".join(cells) + ") GROUP BY reg, factors)")
    return with_ctes(
        PANEL, TOTALS, TRAIN_PAIRS, TRAIN, RATED, *steps,
        select=f"""SELECT reg::DOUBLE AS reg, factors::INTEGER AS factors, {r('mse', 5)} AS mse,
  row_number() OVER (ORDER BY mse, reg, factors) = 1 AS best FROM scores""",
    )


def rounds_of(validation: float, rank: int = 2, reg: float = 0.1, rounds: int = 3, seed: int = 42) -> str:
    held = f"{share_of(f"'{seed}:validation'", 'location_id', 'product_id')} < {validation}"
    steps = [f"inside AS MATERIALIZED (SELECT * FROM rated WHERE NOT {held})", f"outside AS MATERIALIZED (SELECT * FROM rated WHERE {held})"]
    steps += factorised("m", "inside", rank, reg, rounds)
    loss = lambda rows, i: f"(SELECT avg((y - z) * (y - z)) FROM ({predicted(rows, f'm_u{i}', f'm_q{i}')}))"
    table = "\nUNION ALL ".join(f"SELECT {i} AS round, {loss('inside', i)} AS t, {loss('outside', i)} AS v" for i in range(1, rounds + 1))
    steps.append(f"losses AS ({table})")
    return with_ctes(
        PANEL, TOTALS, TRAIN_PAIRS, TRAIN, RATED, *steps,
        select=f"""SELECT round::INTEGER AS round, {r('t', 5)} AS training_loss, {r('v', 5)} AS validation_loss,
  row_number() OVER (ORDER BY v, round) = 1 AS kept FROM losses""",
    )


BASELINE = """
baseline AS (
  SELECT location_id, product_id, test_pairs."rows" AS weight,
         coalesce(train_pairs.export_period_total, 0) AS export_period_train,
         test_pairs.export_period_total AS export_period_test,
         CASE WHEN train_pairs.export_period_total IS NULL THEN test_pairs.export_period_total
              WHEN train_pairs.export_period_total = 0 THEN abs(test_pairs.export_period_total)
              ELSE (test_pairs.export_period_total - train_pairs.export_period_total)
                   / train_pairs.export_period_total END AS export_pct_change,
         greatest(5 * coalesce(train_pairs.export_period2, 0) - 3 * coalesce(train_pairs.export_period1, 0), 0)
           AS predictions
  FROM test_pairs LEFT JOIN train_pairs USING (location_id, product_id)
),
scored AS (
  SELECT *, CASE WHEN export_period_train = 0 THEN predictions
                 ELSE (predictions - export_period_train) / export_period_train END AS pred_pct_change
  FROM baseline
)"""
SCORED_ROWS = """
scored_rows AS (
  SELECT scored.*, panel.year FROM scored JOIN panel USING (location_id, product_id)
  WHERE year >= 1997 AND year < 1999
)"""
RANKED_ROWS = """
ranked_rows AS (
  SELECT *, rank() OVER (ORDER BY export_pct_change DESC) AS export_pct_change_rank,
         rank() OVER (ORDER BY pred_pct_change DESC) AS pred_pct_change_rank,
         rank() OVER (ORDER BY export_period_train DESC) AS export_period_train_rank,
         rank() OVER (ORDER BY export_period_test DESC) AS export_period_test_rank
  FROM {rows}
)"""

CHANGE = (PANEL, TRAIN_PAIRS, TEST_PAIRS, BASELINE)
SCORED = (*CHANGE, SCORED_ROWS)
TRAIN_FEATURES = (PANEL, TRAIN_PAIRS, TOTALS, TRAIN)
BOTH_FEATURES = (PANEL, TRAIN_PAIRS, TEST_PAIRS, TOTALS, TRAIN, TEST)

DISPLAYED = (
    f"location_id, product_id, p_name AS name, {r('export_period_test')} AS export_period_test, "
    f"{r('export_pct_change')} AS export_pct_change, {r('predictions')} AS predictions, "
    f"{r('pred_pct_change')} AS pred_pct_change"
)


def feature_select(split: str) -> str:
    places = {"export_total_loc_year": 4, "export_pct": 9}
    doubles = [
        "export_value", "export_total_loc_year", "export_period1", "export_period2", "export_period_total",
        "export_trend", "export_pct", "export_val_norm_all", "export_val_std_all", "export_pct_norm_all",
        "export_pct_std_all", "export_val_norm", "export_val_std", "export_pct_norm", "export_pct_std",
        "export_trend_norm", "export_trend_std", "export_trend_pct_rank",
    ]
    shown = ", ".join(f"{r(c, places.get(c, 6))} AS {c}" for c in doubles)
    return f"SELECT location_id, product_id, year, {shown}, export_trend_class FROM {split}"


# Distances that agree to twelve digits are equal but for the order of their sums.
nearness = "CASE WHEN b.distance > 0 THEN round(b.distance / pow(10, floor(log10(b.distance))), 11) * pow(10, floor(log10(b.distance))) ELSE 0 END"


def neighbours(
    ratings: str, targets: str, k: int = 40, least: int = 1, support: int = 1, include_self: bool = True
) -> tuple[str, ...]:
    """Nearest-neighbour predictions by self-join on the item."""
    own = (
        "UNION ALL SELECT user_id, user_id, 1.0, 0.0 FROM (SELECT DISTINCT user_id FROM ratings)"
        if include_self
        else ""
    )
    return (
        f"ratings AS ({ratings})",
        f"targets AS (SELECT DISTINCT user_id, item_id FROM ({targets}))",
        f"""
alike AS (
  SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS support,
         avg((a.rating - b.rating) * (a.rating - b.rating)) AS distance, 1 / (distance + 1) AS similarity
  FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id < b.user_id
  GROUP BY a.user_id, b.user_id HAVING count(*) >= {support}
)""",
        f"""
both_ways AS (
  SELECT user_a AS u, user_b AS v, similarity, distance FROM alike
  UNION ALL SELECT user_b, user_a, similarity, distance FROM alike {own}
)""",
        f"""
near AS (
  SELECT t.user_id, t.item_id, b.similarity, x.rating
  FROM targets t JOIN ratings x ON t.item_id = x.item_id JOIN both_ways b ON b.u = t.user_id AND b.v = x.user_id
  QUALIFY row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY {nearness}, x.user_id) <= {k}
)""",
        f"""
estimates AS (
  SELECT user_id, item_id, sum(similarity * rating) / sum(similarity) AS estimate, count(*) AS neighbours
  FROM near GROUP BY user_id, item_id HAVING count(*) >= {least}
)""",
        """
predicted AS (
  SELECT user_id, item_id, coalesce(estimate, (SELECT avg(rating) FROM ratings)) AS prediction,
         coalesce(neighbours, 0) AS neighbours, estimate IS NULL AS impossible
  FROM targets LEFT JOIN estimates USING (user_id, item_id)
)""",
    )


TRADE_RATINGS = """
SELECT location_id AS user_id, product_id AS item_id, avg(export_val_norm_all) AS rating
FROM train GROUP BY location_id, product_id"""
TRADE_TARGETS = "SELECT location_id AS user_id, product_id AS item_id FROM test_pairs"
TRADE_KNN = (PANEL, TRAIN_PAIRS, TEST_PAIRS, TOTALS, TRAIN)

EVENT_PANEL = """
event_panel AS (
  SELECT user_id AS location_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
         CAST(date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS INTEGER) AS year,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS export_value,
         CAST(NULL AS DOUBLE) AS import_value
  FROM events GROUP BY ALL
)"""
EVENT_RATINGS = """
SELECT location_id AS user_id, product_id AS item_id,
       avg((export_value - low) / (high - low)) AS rating
FROM (SELECT *, min(export_value) OVER () AS low, max(export_value) OVER () AS high
      FROM event_panel WHERE export_value >= 0 AND year < 17)
GROUP BY 1, 2"""
EVENT_TARGETS = """
SELECT location_id AS user_id, product_id AS item_id FROM event_panel
WHERE coalesce(export_value, 0) >= 0 AND year >= 17"""

SIMILAR_SELECT = f"SELECT user_a, user_b, support, {r('similarity')} AS similarity FROM alike"
PREDICTED_SELECT = (
    f"SELECT user_id, item_id, {r('prediction', 9)} AS prediction, neighbours, impossible FROM predicted"
)


def cosine(a: str, b: str) -> str:
    return f"coalesce(sum({a} * {b}::DOUBLE) / nullif(sqrt(sum({a} * {a}::DOUBLE)) * sqrt(sum({b} * {b}::DOUBLE)), 0), 0)"


def report(rows: str) -> str:
    change, rank = ("export_pct_change", "pred_pct_change"), ("export_pct_change_rank", "pred_pct_change_rank")
    metrics = {
        "cosine_value": r(cosine("export_period_test", "predictions")),
        "cosine_change": r(cosine(*change)),
        "cosine_change_rank": r(cosine(*rank)),
        "cosine_train_test_value": r(cosine("export_period_train", "export_period_test")),
        "cosine_train_test_rank": r(cosine("export_period_train_rank", "export_period_test_rank")),
    }
    for name, (a, b) in {"change": change, "change_rank": rank}.items():
        metrics[f"mae_{name}"] = r(f"avg(abs({a} - {b}))", 2)
        metrics[f"mse_{name}"] = r(f"avg(({a} - {b}) * ({a} - {b})::DOUBLE)", 2)
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS metric, {value}::DOUBLE AS value FROM {rows}" for name, value in metrics.items()
    )


def _profile(column: str) -> str:
    stats = {
        "mean": f"avg({column})",
        "std": f"stddev_samp({column})",
        "min": f"min({column})",
        '"25%"': f"quantile_cont({column}, 0.25)",
        '"50%"': f"quantile_cont({column}, 0.5)",
        '"75%"': f"quantile_cont({column}, 0.75)",
        "max": f"max({column})",
    }
    shown = ", ".join(f"{r(value)} AS {name}" for name, value in stats.items())
    return f"""SELECT '{column}' AS "column", count({column}) AS count, {shown} FROM panel"""


def _nulls(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS "rows", count(*) FILTER ({column} IS NULL) AS nulls,
  count(*) FILTER ({column} IS NULL) > 0 AS has_nulls FROM panel_raw"""


def _cardinality(column: str) -> str:
    return f"""SELECT '{column}' AS "column", max({column})::DOUBLE AS max_value,
  count(DISTINCT {column}) + max(({column} IS NULL)::INTEGER) AS distinct_values FROM panel_raw"""


PANEL_COLUMNS = ["location_id", "product_id", "year", "export_value", "import_value"]
LOCATION_3 = "location_id = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')"
TEST_MOMENTS = "(SELECT avg(export_value) AS mean, stddev_samp(export_value) AS std FROM test)"
TRAIN_MOMENTS = "(SELECT avg(export_value) AS mean, stddev_samp(export_value) AS std FROM train)"
CHANGE_CLASS = """CASE WHEN export_period_test > 0 AND export_period_train = 0 THEN 2
  WHEN export_pct_change < 0 THEN -1 WHEN export_pct_change = 0 THEN 0
  WHEN export_pct_change > 0 AND export_period_train <> 0 THEN 1 END"""


def _destandardised(moments: str, places: int) -> str:
    value = r("avg(export_val_std_all) * any_value(std) + any_value(mean)", places)
    return f"""SELECT location_id, product_id, {value} AS predictions
FROM train, {moments} GROUP BY location_id, product_id"""


def _losses() -> str:
    d = "abs(actual - z)"
    metrics = {
        "mse": "avg((actual - z) * (actual - z))",
        "mae": f"avg({d})",
        "logcosh": f"avg({d} + ln(1 + exp(-2 * {d})) - ln(2.0))",
        "huber": f"avg(CASE WHEN {d} < 1 THEN 0.5 * {d} * {d} ELSE {d} - 0.5 END)",
        "cosine": cosine("actual", "z"),
    }
    return "\nUNION ALL ".join(f"SELECT '{k}' AS metric, {r(v)} AS value FROM losses" for k, v in metrics.items())


KNN_RANKED = (
    *BOTH_FEATURES,
    *neighbours(TRADE_RATINGS, TRADE_TARGETS),
    BASELINE.split("scored AS (")[0].strip().rstrip(","),
    """
amounts AS (
  SELECT baseline.* EXCLUDE (predictions), prediction * (high - low) + low AS predictions
  FROM baseline JOIN predicted ON location_id = user_id AND product_id = item_id,
       (SELECT min(export_value) AS low, max(export_value) AS high FROM test)
),
scored AS (
  SELECT *, CASE WHEN export_period_train = 0 THEN predictions
                 ELSE (predictions - export_period_train) / export_period_train END AS pred_pct_change
  FROM amounts
)""",
    SCORED_ROWS,
    RANKED_ROWS.format(rows="scored_rows"),
)


def recommended(n: int, where: str, places: int = 2) -> str:
    """The best rows of every location as the run shows them."""
    return f"""SELECT location_id, product_id, position, p_name AS name, {r('export_period_test', 4)} AS export_period_test,
  {r('export_pct_change', 4)} AS export_pct_change,
  rank() OVER (PARTITION BY location_id ORDER BY export_pct_change_rank) AS export_pct_change_rank_loc,
  {r('predictions', places)} AS predictions, {r('pred_pct_change', places)} AS pred_pct_change
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY pred_pct_change DESC, product_id) AS position
      FROM ranked_rows WHERE {where} QUALIFY position <= {n})
LEFT JOIN part ON product_id = p_partkey"""


def _prep_tables() -> str:
    """Rows and one sum of every named intermediate table."""
    years = "year >= 1995 AND year < 1999"
    parts = {
        "df": f"SELECT export_value AS x FROM panel WHERE {years}",
        "df_groupsum": f"SELECT export_total_loc_year AS x FROM totals WHERE {years}",
    }
    for name, split, start in (("df_95_04", "train", 1995), ("df_05_14", "test", 1997)):
        parts[name] = f"SELECT export_value AS x FROM panel WHERE year >= {start} AND year < {start + 2}"
        for half in (0, 1):
            parts[f"{name}_sum{half + 1}"] = f"SELECT sum(export_value) AS x FROM panel WHERE year = {start + half} GROUP BY location_id, product_id"
        parts[f"{name}_trend"] = f"SELECT export_trend AS x FROM {split}_pairs"
        for column in ("pct_norm", "pct_std", "trend_std"):
            parts[f"{split}_{column}"] = f"SELECT export_{column} AS x FROM {split}"
    rows = "\nUNION ALL ".join(f"""SELECT '{k}' AS "table", count(*) AS "rows", {r('sum(x)', 1)} AS amount FROM ({q})""" for k, q in parts.items())
    return with_ctes(PANEL, TOTALS, TRAIN_PAIRS, TEST_PAIRS, TRAIN, TEST, select=rows)


def _trend_columns(split: str) -> str:
    return (
        "SELECT location_id, product_id, "
        + ", ".join(f"{r(f'{f}_{p}')} AS {f}_{p}" for f in ("export", "import") for p in ("period1", "period2", "trend", "period_total"))
        + f', "rows" FROM {split}_pairs'
    )


SQL: dict[str, str] = {
    "trade_panel": with_ctes(panel_raw(), select="SELECT * FROM panel_raw"),
    "trade_panel_brand": with_ctes(coded_panel("p_brand"), select="SELECT * FROM panel_raw"),
    "trade_panel_type": with_ctes(coded_panel("p_type"), select="SELECT * FROM panel_raw"),
    "event_panel": with_ctes(EVENT_PANEL, select="SELECT * FROM event_panel"),
    "panel_sample": with_ctes(
        coded_panel("p_brand"), select="SELECT * FROM panel_raw WHERE location_id IN (0, 1)"
    ),
    "coarse_classes": """SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS "index", p_brand AS name,
  '2digit' AS level FROM (SELECT DISTINCT p_brand FROM part)""",
    "clean_panel": with_ctes(PANEL, select="SELECT * FROM panel"),
    "location_year_totals": with_ctes(
        PANEL,
        TOTALS,
        select=f"""SELECT location_id, year, {r('export_total_loc_year', 4)} AS export_total_loc_year,
  {r('import_total_loc_year', 4)} AS import_total_loc_year FROM totals""",
    ),
    "null_report": with_ctes(panel_raw(), select="\nUNION ALL ".join(_nulls(c) for c in PANEL_COLUMNS)),
    "profile": with_ctes(
        PANEL, select="\nUNION ALL ".join(_profile(c) for c in ("export_value", "import_value"))
    ),
    "key_cardinality": with_ctes(
        panel_raw(), select="\nUNION ALL ".join(_cardinality(c) for c in PANEL_COLUMNS[:3])
    ),
    "period_sums": with_ctes(
        PANEL,
        TRAIN_PAIRS,
        select="SELECT location_id, product_id, "
        + ", ".join(
            f"{r(f'{f}_{p}', 4)} AS {f}_{p}"
            for f in ("export", "import")
            for p in ("period1", "period2", "period_total")
        )
        + ', rows1, "rows" FROM train_all',
    ),
    "trend_table": with_ctes(
        PANEL,
        TRAIN_PAIRS,
        select="SELECT location_id, product_id, "
        + ", ".join(
            f"{r(f'{f}_{p}')} AS {f}_{p}"
            for f in ("export", "import")
            for p in ("period1", "period2", "trend", "period_total")
        )
        + ', "rows" FROM train_pairs',
    ),
    "export_share": with_ctes(
        PANEL,
        TOTALS,
        select=f"""SELECT location_id, product_id, year,
  {r('CASE WHEN export_total_loc_year <> 0 THEN export_value / export_total_loc_year END', 9)} AS export_pct
FROM panel JOIN totals USING (location_id, year)""",
    ),
    "scale_global": with_ctes(
        PANEL,
        select=f"""SELECT location_id, product_id, year, {r(minmax('export_value', ''))} AS export_val_norm_all,
  {r(standard('export_value', ''))} AS export_val_std_all
FROM panel WHERE year >= 1995 AND year < 1997""",
    ),
    "scale_grouped": with_ctes(
        PANEL,
        select="SELECT location_id, product_id, year, "
        + ", ".join(
            f"{r(f(f'{flow}_value', 'PARTITION BY location_id, year'))} AS {flow}_val_{kind}"
            for flow in ("export", "import")
            for kind, f in (("norm", minmax), ("std", standard))
        )
        + " FROM panel WHERE year >= 1995 AND year < 1997",
    ),
    "trend_class": with_ctes(
        PANEL,
        TRAIN_PAIRS,
        select="""SELECT location_id, product_id, CASE WHEN export_trend > 0 THEN 1 WHEN export_trend < 0 THEN -1
  ELSE 0 END AS export_trend_class FROM train_pairs""",
    ),
    "pct_rank": with_ctes(
        *TRAIN_FEATURES,
        select=f"""SELECT DISTINCT location_id, product_id, {r('export_trend_pct_rank', 9)} AS export_trend_pct_rank
FROM train""",
    ),
    "feature_table_train": with_ctes(*TRAIN_FEATURES, select=feature_select("train")),
    "feature_table_test": with_ctes(PANEL, TEST_PAIRS, TOTALS, TEST, select=feature_select("test")),
    "growth_baseline": with_ctes(
        *CHANGE,
        select=f"""SELECT location_id, product_id, {r('export_period_train')} AS export_period_train,
  {r('export_period_test')} AS export_period_test, {r('export_pct_change')} AS export_pct_change FROM baseline""",
    ),
    "change_class": with_ctes(
        *CHANGE, select=f"SELECT location_id, product_id, {CHANGE_CLASS} AS export_class FROM baseline"
    ),
    "min_rank": with_ctes(
        *SCORED,
        select="""SELECT location_id, product_id, year,
  rank() OVER (ORDER BY export_pct_change DESC) AS export_pct_change_rank FROM scored_rows""",
    ),
    "min_rank_pairs": with_ctes(
        *CHANGE,
        select="""SELECT location_id, product_id,
  rank() OVER (ORDER BY export_pct_change DESC) AS export_pct_change_rank FROM baseline""",
    ),
    "carry_forward_features": with_ctes(
        *TRAIN_FEATURES,
        TEST_PAIRS,
        select=f"""SELECT location_id, product_id, coalesce(c.export_trend_class, 0) AS export_trend_class,
  {r('coalesce(c.export_trend_pct_rank, (SELECT avg(export_trend_pct_rank) FROM train))', 9)} AS export_trend_pct_rank
FROM test_pairs LEFT JOIN (SELECT DISTINCT location_id, product_id, export_trend_class, export_trend_pct_rank
                           FROM train) c USING (location_id, product_id)""",
    ),
    "trend_carry_predictions": with_ctes(
        *CHANGE, select=f"SELECT location_id, product_id, {r('predictions', 4)} AS predictions FROM baseline"
    ),
    "pred_pct_change": with_ctes(
        *CHANGE,
        select=f"""SELECT location_id, product_id, {r('predictions')} AS predictions,
  {r('pred_pct_change')} AS pred_pct_change FROM scored""",
    ),
    "pred_pct_change_mean_base": with_ctes(
        *CHANGE,
        select=f"""SELECT location_id, product_id,
  {r('''CASE WHEN export_period_train = 0 THEN predictions
    ELSE (predictions - export_period_train / 2.0) / (export_period_train / 2.0) END''')} AS pred_pct_change
FROM scored""",
    ),
    "destandardize": with_ctes(*BOTH_FEATURES, select=_destandardised(TEST_MOMENTS, 2)),
    "destandardize_train_moments": with_ctes(*TRAIN_FEATURES, select=_destandardised(TRAIN_MOMENTS, 6)),
    "unminmax": with_ctes(
        *BOTH_FEATURES,
        select=f"""SELECT location_id, product_id,
  {r('avg(export_val_norm_all) * any_value(high - low) + any_value(low)', 2)} AS predictions
FROM train, (SELECT min(export_value) AS low, max(export_value) AS high FROM test)
GROUP BY location_id, product_id""",
    ),
    "top_n_location": with_ctes(
        *SCORED,
        select=f"""SELECT {DISPLAYED}, position
FROM (SELECT *, row_number() OVER (ORDER BY pred_pct_change DESC, product_id) AS position
      FROM scored_rows WHERE year = 1998 AND {LOCATION_3} QUALIFY position <= 50)
LEFT JOIN part ON product_id = p_partkey""",
    ),
    "top_n_new_goods": with_ctes(
        *KNN_RANKED, select=recommended(20, f"year = 1998 AND export_period_train = 0 AND {LOCATION_3}")
    ),
    "top_n_all_locations": with_ctes(
        *SCORED,
        select=f"""SELECT {DISPLAYED}, position
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY pred_pct_change DESC, product_id) AS position
      FROM scored_rows WHERE year = 1998 QUALIFY position <= 50) LEFT JOIN part ON product_id = p_partkey""",
    ),
    "rank_within_top_n": with_ctes(
        *SCORED,
        RANKED_ROWS.format(rows="scored_rows"),
        select="""SELECT location_id, product_id,
  rank() OVER (PARTITION BY location_id ORDER BY export_pct_change_rank) AS rank_loc,
  rank() OVER (PARTITION BY location_id ORDER BY export_pct_change_rank DESC) AS rank_loc_inverted
FROM (SELECT * FROM ranked_rows WHERE year = 1998
      QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY pred_pct_change DESC, product_id) <= 50)""",
    ),
    "ratings": with_ctes(
        *TRAIN_FEATURES,
        f"ratings AS ({TRADE_RATINGS})",
        select=f"SELECT user_id, item_id, {r('rating', 9)} AS rating FROM ratings",
    ),
    "user_similarity": with_ctes(*TRADE_KNN, *neighbours(TRADE_RATINGS, TRADE_TARGETS), select=SIMILAR_SELECT),
    "knn_predictions": with_ctes(*TRADE_KNN, *neighbours(TRADE_RATINGS, TRADE_TARGETS), select=PREDICTED_SELECT),
    "knn_predictions_k5_others": with_ctes(
        *TRADE_KNN,
        *neighbours(TRADE_RATINGS, TRADE_TARGETS, k=5, least=2, support=3, include_self=False),
        select=PREDICTED_SELECT,
    ),
    "knn_recommendations": with_ctes(*KNN_RANKED, select=recommended(20, "year = 1998")),
    "recommend_from_store": with_ctes(
        *SCORED, RANKED_ROWS.format(rows="scored_rows"), select=recommended(20, "year = 1998", places=4)
    ),
    "user_similarity_raw": with_ctes(
        PANEL,
        """
ratings AS (
  SELECT location_id AS user_id, product_id AS item_id, avg(export_value) AS rating
  FROM panel WHERE year >= 1995 AND year < 1997 GROUP BY ALL
)""",
        select=f"""SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS support,
  {r('avg((a.rating - b.rating) * (a.rating - b.rating))', 0)} AS distance
FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY a.user_id, b.user_id""",
    ),
    **{
        f"{model}_checks": with_ctes(
            PANEL, TEST_PAIRS, select="SELECT location_id, product_id, true AS predicted, true AS beats_mean FROM test_pairs"
        )
        for model in ("als", "gbt", "fm")
    },
    "stored_prep_tables": _prep_tables(),
    "stored_year_replaced": with_ctes(
        PANEL,
        """
stored AS (
  SELECT * FROM panel WHERE year = 1998
  UNION ALL SELECT location_id, product_id, year, export_value + 1000, import_value FROM panel WHERE year = 1997 AND location_id < 10
)""",
        select=f"""SELECT location_id, year, {r('sum(export_value)', 4)} AS export_total_loc_year,
  {r('sum(import_value)', 4)} AS import_total_loc_year FROM stored GROUP BY location_id, year""",
    ),
    "sketched_quartiles": with_ctes(
        PANEL,
        select="""SELECT c AS "column", p::DOUBLE AS probability, (SELECT count(*) FROM panel) AS "rows", true AS "within"
FROM (VALUES ('export_value'), ('import_value')) AS a(c), (VALUES (0.25), (0.5), (0.75)) AS b(p)""",
    ),
    "refreshed_trends": with_ctes(PANEL, TEST_PAIRS, select=_trend_columns("test")),
    "table_shapes": with_ctes(
        PANEL, TOTALS, TRAIN_PAIRS, TEST_PAIRS, TRAIN, TEST,
        select="""SELECT 'train' AS "table", count(*) AS "rows", 22 AS "columns" FROM train
UNION ALL SELECT 'test', count(*), 22 FROM test""",
    ),
    "panel_head": with_ctes(PANEL, select="SELECT * FROM panel ORDER BY location_id, product_id, year LIMIT 20"),
    "als_grid_search": grid(),
    "als_rounds": rounds_of(0.25),
    "als_fixed_start": with_ctes(
        PANEL, TOTALS, TRAIN_PAIRS, TRAIN, TEST_PAIRS, RATED, *factorised("m", "rated", 2, 0.1, 2),
        "wanted AS (SELECT location_id, product_id, 0 AS y FROM test_pairs)",
        select=f"""SELECT location_id, product_id, {r('z', 5)} AS z FROM ({predicted('wanted', 'm_u2', 'm_q2')})""",
    ),
    "trend_table_long": with_ctes(
        PANEL,
        pairs("train", 1995, 1997, 1999),
        """
ranked AS (
  SELECT location_id, product_id, (rank() OVER (ORDER BY export_trend)
          + (count(*) OVER (PARTITION BY export_trend) - 1) / 2.0) / count(*) OVER () AS export_trend_pct_rank
  FROM panel JOIN train_pairs USING (location_id, product_id) WHERE year >= 1995 AND year < 1999
)""",
        select="SELECT location_id, product_id, "
        + ", ".join(
            f"{r(c)} AS {c}"
            for c in (
                "export_period1", "export_period2", "export_trend", "export_period_total", "import_trend", "import_period_total",
            )
        )
        + f""", "rows", {r('any_value(export_trend_pct_rank)', 9)} AS export_trend_pct_rank,
  CASE WHEN export_trend > 0 THEN 1 WHEN export_trend < 0 THEN -1 ELSE 0 END AS export_trend_class
FROM train_pairs JOIN ranked USING (location_id, product_id) GROUP BY ALL""",
    ),
    "event_user_similarity": with_ctes(
        EVENT_PANEL, *neighbours(EVENT_RATINGS, EVENT_TARGETS), select=SIMILAR_SELECT
    ),
    "event_knn_predictions": with_ctes(
        EVENT_PANEL, *neighbours(EVENT_RATINGS, EVENT_TARGETS), select=PREDICTED_SELECT
    ),
    "validation_report": with_ctes(
        *SCORED, RANKED_ROWS.format(rows="scored_rows"), select=report("ranked_rows")
    ),
    "validation_report_pairs": with_ctes(
        *CHANGE, RANKED_ROWS.format(rows="scored"), select=report("ranked_rows")
    ),
    "loss_report": with_ctes(
        *BOTH_FEATURES,
        """
known AS (
  SELECT location_id, product_id, avg(export_val_std_all) AS mean_z FROM train GROUP BY location_id, product_id
),
losses AS (
  SELECT export_val_std_all AS actual, coalesce(mean_z, 0) AS z
  FROM test LEFT JOIN known USING (location_id, product_id)
)""",
        select=_losses(),
    ),
}
