"""Bands, histograms, densities, boxes, labels (survey group G)."""

from tenura import schema as S
from tenura.functions import bins as B
from tenura.operators import distributions as D
from tenura.operators.ltv import ltv_target
from tenura.plans import registry as R
from tenura.plans.registry import query
from tenura.plans.report_queries import GROUP_SQL
from tenura.sources.subscribers import customers


@query("tenure_groups", f"WITH {R.CUSTOMERS_SQL} SELECT k, {GROUP_SQL} AS tenure_group FROM customers")
def tenure_groups(spark, folder):
    return customers(spark, folder).select("k", B.tenure_group().alias("tenure_group"))


@query(
    "tenure_bands",
    f"""WITH {R.CUSTOMERS_SQL} SELECT k, CASE WHEN tenure <= 12 THEN '0-12 mo' WHEN tenure <= 24 THEN '13-24 mo'
    WHEN tenure <= 48 THEN '25-48 mo' ELSE '49-72 mo' END AS tenure_band FROM customers""",
)
def tenure_bands(spark, folder):
    return customers(spark, folder).select("k", B.tenure_band().alias("tenure_band"))


def histogram_sql(view: str, table: str, column: str, bins: int, by: str, common: bool = False) -> str:
    """Every bin is found by comparing values with the edges, a different way than the operator's arithmetic."""
    scope = "" if common else f"WHERE {by} = g.{by}"
    return R.rounded_sql(
        f"""WITH {view}, source AS (SELECT {by}, CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL),
        span AS (SELECT g.{by}, (SELECT min(v) FROM source {scope}) AS lo, (SELECT max(v) FROM source {scope}) AS hi
          FROM (SELECT DISTINCT {by} FROM source) AS g),
        edge AS (SELECT {by}, CAST(b AS INTEGER) AS bin, b * ((hi - lo) / {bins}) + lo AS left_edge,
          (b + 1) * ((hi - lo) / {bins}) + lo AS right_edge FROM span, range({bins}) AS r(b)),
        cell AS (SELECT {by}, v, count(*) AS c FROM source GROUP BY {by}, v)
        SELECT e.{by}, bin, any_value(left_edge) AS left_edge, any_value(right_edge) AS right_edge,
          CAST(coalesce(sum(c), 0) AS BIGINT) AS rows
        FROM edge AS e LEFT JOIN cell ON cell.{by} = e.{by} AND (bin = 0 OR v >= left_edge)
          AND (bin = {bins - 1} OR v < right_edge) GROUP BY e.{by}, bin""",
        "left_edge right_edge",
    )


@query("histogram_tenure", histogram_sql(R.CUSTOMERS_SQL, "customers", "tenure", 30, "churn"), digits=6)
def histogram_tenure(spark, folder):
    return D.histogram(customers(spark, folder), "tenure", 30, "churn")


@query(
    "histogram_monthly_charges",
    histogram_sql(R.CUSTOMERS_SQL, "customers", "monthly_charges", 40, "churn", common=True),
    digits=6,
)
def histogram_monthly_charges(spark, folder):
    return D.histogram(customers(spark, folder), "monthly_charges", 40, "churn", common=True)


_ALL = f"{R.TARGET_SQL}, everyone AS (SELECT 0 AS one, ltv_historical, ltv_projected FROM target)"


@query(
    "histogram_ltv",
    f"SELECT * EXCLUDE (one) FROM ({histogram_sql(_ALL, 'everyone', 'ltv_projected', 50, 'one')}) AS h",
    digits=6,
)
def histogram_ltv(spark, folder):
    return D.histogram(ltv_target(R.featured(spark, folder)), "ltv_projected", 50)


def density_sql(view: str, table: str, column: str, grid: int) -> str:
    """From the rows themselves, equal values together: no cells."""
    return R.rounded_sql(
        f"""WITH {view}, source AS (SELECT churn, CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL),
        stat AS (SELECT churn, min(v) AS lo, max(v) AS hi, count(*) AS n,
          stddev_samp(v) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS h FROM source GROUP BY churn),
        held AS (SELECT churn, v, count(*) AS w FROM source GROUP BY churn, v),
        point AS (SELECT churn, h, n, CAST(b AS INTEGER) AS point,
          lo - (hi - lo) * CAST(0.5 AS DOUBLE) + b * ((hi - lo) * CAST(2 AS DOUBLE) / {grid - 1}) AS x FROM stat, range({grid}) AS r(b))
        SELECT p.churn, point, x, sum(w * exp(CAST(-0.5 AS DOUBLE) * ((x - v) / h) * ((x - v) / h)))
          / (any_value(n) * any_value(h) * sqrt(CAST(2 AS DOUBLE) * pi())) AS density
        FROM point AS p JOIN held ON held.churn = p.churn GROUP BY p.churn, point, x""",
        "x density",
        8,
    )


@query("density_tenure", density_sql(R.CUSTOMERS_SQL, "customers", "tenure", 1000), digits=8)
def density_tenure(spark, folder):
    return D.density(customers(spark, folder), "tenure", "churn")


def _feature_density(feature: str):
    @query(f"density_{feature}", density_sql(R.FEATURED_SQL, "featured", feature, 200), digits=8)
    def build(spark, folder):
        return D.density(R.featured(spark, folder), feature, "churn", grid=200)


for _feature in ("charge_per_tenure", "charge_to_value_ratio", "tenure_contract_risk"):
    _feature_density(_feature)


def box_sql(view: str, table: str, column: str, by: str) -> str:
    q = ", ".join(f"{R.quantile_sql(p)} AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    low, high = "q1 - CAST(1.5 AS DOUBLE) * (q3 - q1)", "q3 + CAST(1.5 AS DOUBLE) * (q3 - q1)"
    return R.rounded_sql(
        f"""WITH {view}, ordered AS (SELECT {by}, CAST({column} AS DOUBLE) AS v,
          row_number() OVER (PARTITION BY {by} ORDER BY {column}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n
          FROM {table} WHERE {column} IS NOT NULL),
        box AS (SELECT {by}, {q} FROM ordered GROUP BY {by})
        SELECT b.{by}, count(*) AS n, least(min(v) FILTER (WHERE v >= {low}), any_value(q1)) AS whisker_low,
          any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
          greatest(max(v) FILTER (WHERE v <= {high}), any_value(q3)) AS whisker_high,
          count(*) FILTER (WHERE v < {low} OR v > {high}) AS outliers
        FROM ordered AS o JOIN box AS b ON o.{by} = b.{by} GROUP BY b.{by}""",
        "whisker_low q1 median q3 whisker_high",
    )


def _box_query(column: str):
    engineered = column in S.ENGINEERED
    view, table = (R.FEATURED_SQL, "featured") if engineered else (R.CUSTOMERS_SQL, "customers")

    @query(f"box_{column}", box_sql(view, table, column, "churn"), digits=6)
    def build(spark, folder):
        rows = R.featured(spark, folder) if engineered else customers(spark, folder)
        return D.box_stats(rows, column, "churn")


for _column in ("tenure", "monthly_charges", *S.ENGINEERED):
    _box_query(_column)


def _ltv_box_query(by: str):
    @query(f"box_ltv_by_{by}", box_sql(R.STORED_SQL, "stored", "ltv_projected", by), digits=6)
    def build(spark, folder):
        return D.box_stats(R.stored(spark, folder), "ltv_projected", by)


for _by in ("contract", "churn"):
    _ltv_box_query(_by)


def scatter_sql(view: str, table: str, x: str, y: str, bins: int, by: str | None = None) -> str:
    cell = lambda c, n: (
        f"CAST(least(floor((CAST({c} AS DOUBLE) - lo_{n}) / (hi_{n} - lo_{n}) * {bins}), {bins - 1}) AS INTEGER)"
    )
    edge = lambda i, n: f"({i} * ((hi_{n} - lo_{n}) / {bins}) + lo_{n})"
    fixed = lambda v, g, n: (
        f"CASE WHEN {v} < {edge(g, n)} THEN {g} - 1 "
        f"WHEN {g} < {bins - 1} AND {v} >= {edge(f'({g} + 1)', n)} THEN {g} + 1 ELSE {g} END"
    )
    group = f"{by}, " if by else ""
    return f"""WITH {view}, span AS (SELECT CAST(min({x}) AS DOUBLE) AS lo_x, CAST(max({x}) AS DOUBLE) AS hi_x,
          CAST(min({y}) AS DOUBLE) AS lo_y, CAST(max({y}) AS DOUBLE) AS hi_y FROM {table}),
        guessed AS (SELECT {group}CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, lo_x, hi_x, lo_y, hi_y,
          {cell(x, 'x')} AS gx, {cell(y, 'y')} AS gy FROM {table}, span)
        SELECT {group}{fixed('x', 'gx', 'x')} AS x_bin, {fixed('y', 'gy', 'y')} AS y_bin, count(*) AS rows
        FROM guessed GROUP BY ALL"""


@query("scatter_ltv_tenure", scatter_sql(R.STORED_SQL, "stored", "tenure", "ltv_projected", 50, "churn"))
def scatter_ltv_tenure(spark, folder):
    return D.scatter_bins(R.stored(spark, folder), "tenure", "ltv_projected", 50, ["churn"])


@query("scatter_actual_predicted", scatter_sql(R.REGRESSED_SQL, "regressed", "actual", "predicted", 50))
def scatter_actual_predicted(spark, folder):
    return D.scatter_bins(R.regressed(spark, folder), "actual", "predicted", 50)


@query("decision_columns", f"WITH {R.DECIDED_SQL} SELECT * FROM decided")
def decision_columns(spark, folder):
    return R.decided(spark, folder)
