"""The registered queries over the star-schema panel, each with the SQL that returns the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import adapters, eda, evaluate, forecast, hierarchy, panel, weights
from tidegrid.plans import store
from tidegrid.sources import panels
from tidegrid.spec import DEFAULT, LEVELS

CUTOFF = "2001-06-30"
HORIZON = 28
DIGITS = 4


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.star(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.clean(raw(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.split(cleaned(spark, sf_dir), CUTOFF)[0]


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.lit(CUTOFF))
    rows = raw(spark, sf_dir).select("id", "date", "sales_quantity")
    return rows.where((F.col("date") > day) & (F.col("date") <= F.date_add(day, HORIZON)))


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.static_columns(history(spark, sf_dir))


#: Prices are quotients of cents, so many stand exactly between two rounded values; both sides add this before they round.
OFF_TIES = 3e-7


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    off = lambda c: F.lit(OFF_TIES) if "price" in c else F.lit(0.0)
    return df.withColumns({c: F.round(F.col(c).cast("double") + off(c), digits) for c in columns})


# ---- the SQL side: common table expressions that the queries' SQL begins with

PANEL = """
lines AS (
  SELECT p.p_brand AS item_id, CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS INTEGER) AS brand, n.n_name AS store_id, r.r_name AS state_id,
         CAST(l.l_shipdate AS DATE) AS date, l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS price
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
daily AS (
  SELECT item_id, brand, store_id, state_id, date, sum(quantity) AS sales_quantity, avg(price) AS sell_price FROM lines GROUP BY item_id, brand, store_id, state_id, date),
raw AS (
  SELECT item_id || '_' || store_id AS id, date, sales_quantity, sell_price, item_id, 'DEPT_' || CAST((brand - 1) // 5 AS VARCHAR) AS dept_id,
         'CAT_' || CAST(((brand - 1) // 5) // 2 AS VARCHAR) AS cat_id, store_id, state_id,
         CAST(date_diff('day', DATE '1994-12-31', date) // 7 AS SMALLINT) AS wm_yr_wk, CAST(date_diff('day', DATE '1994-12-31', date) % 7 + 1 AS TINYINT) AS wday,
         CAST(month(date) AS TINYINT) AS month, CAST(year(date) AS SMALLINT) AS year,
         CASE WHEN day(date) = 1 THEN 'MonthStart_' || CAST(month(date) AS VARCHAR) END AS event_name_1, CASE WHEN day(date) = 1 THEN 'Calendar' END AS event_type_1,
         CAST(day(date) <= 10 AS TINYINT) AS snap_CA, CAST(day(date) BETWEEN 6 AND 15 AS TINYINT) AS snap_TX, CAST(day(date) BETWEEN 11 AND 20 AS TINYINT) AS snap_WI
  FROM daily),
panel AS (SELECT * REPLACE (coalesce(event_name_1, 'none') AS event_name_1, coalesce(event_type_1, 'none') AS event_type_1) FROM raw),
hist AS (SELECT * FROM panel WHERE date <= DATE '2001-06-30'),
future AS (SELECT * EXCLUDE (sales_quantity) FROM panel WHERE date > DATE '2001-06-30'),
actual AS (SELECT id, date, sales_quantity FROM panel WHERE date > DATE '2001-06-30' AND date <= DATE '2001-07-28'),
static AS (SELECT id, min(item_id) AS item_id, min(dept_id) AS dept_id, min(cat_id) AS cat_id, min(store_id) AS store_id, min(state_id) AS state_id FROM hist GROUP BY id)"""

GRID = """,
dates AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS t FROM (SELECT DISTINCT date FROM hist)),
latest AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM (SELECT date FROM dates ORDER BY date DESC LIMIT 14)),
grid AS (SELECT (SELECT max(t) FROM dates) AS last_t, max(date) AS last_date, CASE WHEN count(*) >= 3 AND min(gap) = max(gap) THEN min(gap) ELSE 1 END AS step FROM latest),
horizon AS (SELECT CAST(h AS INTEGER) AS h, CAST(last_date + CAST(h * step AS INTEGER) AS DATE) AS date FROM grid, range(1, 29) AS x(h)),
cells AS (SELECT i.id, d.t, d.date, coalesce(h.sales_quantity, 0) AS y, h.sell_price AS price FROM (SELECT DISTINCT id FROM hist) i CROSS JOIN dates d LEFT JOIN hist h ON h.id = i.id AND h.date = d.date),
begun AS (SELECT id, coalesce(min(t) FILTER (WHERE y <> 0), 1) AS first FROM cells GROUP BY id),
trimmed AS (SELECT c.*, c.t - b.first AS i, count(*) OVER (PARTITION BY c.id) AS n FROM cells c JOIN begun b ON c.id = b.id WHERE c.t >= b.first)"""

NAIVE = """,
naive AS (SELECT c.id, h.date, greatest(c.y, 0) AS sales_quantity FROM cells c JOIN grid ON c.t = grid.last_t CROSS JOIN horizon h)"""


def _levels(table: str, columns: str, total: str) -> str:
    """SQL: the rows of a table that has the static keys, once for each level, with the label of the series."""
    out = []
    for level, keys in LEVELS.items():
        label = " || '_' || ".join(keys) if keys else f"'{total}'"
        where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "TRUE"
        out.append(f"SELECT {level} AS level, {label} AS agg_id, {columns} FROM {table} WHERE {where}")
    return "\n  UNION ALL ".join(out)


def _scale(source: str, keys: str, mode: str = "from_first") -> str:
    """SQL: the dense form. source has keys, t and y on the whole grid."""
    if mode == "inclusive":
        return f"""
  SELECT {keys}, greatest(coalesce(avg(d * d) FILTER (WHERE started AND d IS NOT NULL), 1e-8), 1e-8) AS scale
  FROM (SELECT {keys}, t, y - lag(y) OVER (PARTITION BY {keys} ORDER BY t) AS d, max(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY t) = 1 AS started FROM {source}) GROUP BY {keys}"""
    return f"""
  SELECT {keys}, greatest(coalesce(CASE WHEN any_value(demands) >= 2 THEN avg(d * d) FILTER (WHERE t > first) END, 1e-8), 1e-8) AS scale
  FROM (SELECT {keys}, t, y - lag(y) OVER (PARTITION BY {keys} ORDER BY t) AS d, min(CASE WHEN y <> 0 THEN t END) OVER (PARTITION BY {keys}) AS first,
               count(CASE WHEN y <> 0 THEN 1 END) OVER (PARTITION BY {keys}) AS demands FROM {source}) GROUP BY {keys}"""


WEIGHTS = f""",
filled AS (SELECT *, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                              first_value(price IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS full_price FROM cells),
valued AS (SELECT s.*, f.t, f.y, CASE WHEN f.t > grid.last_t - 28 THEN f.y * f.full_price ELSE 0 END AS revenue FROM filled f JOIN static s ON f.id = s.id CROSS JOIN grid),
leveled AS (SELECT level, agg_id AS id, t, sum(y) AS y, sum(revenue) AS revenue FROM (
  {_levels("valued", "t, y, revenue", "All")}) GROUP BY level, agg_id, t),
scaled AS ({_scale("leveled", "level, id")}),
earned AS (SELECT level, id, sum(revenue) AS revenue FROM leveled GROUP BY level, id),
ws AS (SELECT e.level, e.id, s.scale, CASE WHEN sum(revenue) OVER (PARTITION BY e.level) > 0 THEN revenue / sum(revenue) OVER (PARTITION BY e.level) ELSE 1.0 / count(*) OVER (PARTITION BY e.level) END AS weight
       FROM earned e JOIN scaled s ON e.level = s.level AND e.id = s.id)"""

PAIRS = """,
common AS (SELECT date FROM naive INTERSECT SELECT date FROM actual),
pairs AS (SELECT s.*, d.date, coalesce(f.sales_quantity, 0) AS f, coalesce(a.sales_quantity, 0) AS a FROM static s CROSS JOIN common d
          LEFT JOIN naive f ON f.id = s.id AND f.date = d.date LEFT JOIN actual a ON a.id = s.id AND a.date = d.date)"""

SCORES = f"""{PAIRS},
summed AS (SELECT level, agg_id AS id, date, sum(f) AS f, sum(a) AS a FROM (
  {_levels("pairs", "date, f, a", "All")}) GROUP BY level, agg_id, date),
errors AS (SELECT level, id, avg((a - f) * (a - f)) AS mse FROM summed GROUP BY level, id),
series AS (SELECT w.level, w.id, e.mse, w.scale, w.weight, sqrt(e.mse / w.scale) AS rmsse FROM ws w JOIN errors e ON w.level = e.level AND w.id = e.id),
scores AS (SELECT level, sum(weight * rmsse) AS score FROM series GROUP BY level)"""

STATS = """,
stats AS (SELECT id, count(date) AS raw_length, avg(CASE WHEN sales_quantity = 0 THEN 1.0 ELSE 0.0 END) AS zero_frac, min(date) FILTER (WHERE sales_quantity > 0) AS first_sale_date, max(date) AS last_date,
  min(item_id) AS item_id, min(dept_id) AS dept_id, min(cat_id) AS cat_id, min(store_id) AS store_id, min(state_id) AS state_id,
  CAST(date_diff('day', min(date) FILTER (WHERE sales_quantity > 0), max(date)) + 1 AS INTEGER) AS active_length FROM panel GROUP BY id)"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH {PANEL.strip()}{''.join(parts)}\n{select}"


_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


_ROW = "id, date, round(sales_quantity, 4) AS sales_quantity"
_MEANS = "round({a}(wm_yr_wk){z}, 4) AS wm_yr_wk, round({a}(wday){z}, 4) AS wday, round({a}(month){z}, 4) AS month, round({a}(year){z}, 4) AS year, round({a}(sell_price){z} + 3e-7, 4) AS sell_price"


@query("scan_panel", _sql(f"SELECT {_ROW}, round(sell_price + 3e-7, 4) AS sell_price, item_id, dept_id, cat_id, store_id, state_id, wm_yr_wk, wday, month, year, event_name_1, event_type_1, snap_CA, snap_TX, snap_WI FROM raw"))
def scan_panel(spark, sf_dir):
    return rounded(panels.star_panel(spark, sf_dir), "sales_quantity", "sell_price")


@query("clean_events", _sql("SELECT id, date, event_name_1, event_type_1 FROM panel"))
def clean_events(spark, sf_dir):
    return cleaned(spark, sf_dir).select("id", "date", "event_name_1", "event_type_1")


def _add_level(level: int) -> None:
    keys = LEVELS[level]
    label = " || '_' || ".join(keys) if keys else "'All'"
    columns = ", ".join(k for k in keys if k != "id")
    more = f", {columns}" if columns else ""
    static_sql = ", min(item_id) AS item_id, min(dept_id) AS dept_id, min(cat_id) AS cat_id, min(store_id) AS store_id, min(state_id) AS state_id" if level == 12 else more
    sql = f"SELECT {label} AS id, date, round(sum(sales_quantity), 4) AS sales_quantity, {_MEANS.format(a='avg', z='')}, min(event_name_1) AS event_name_1, min(event_type_1) AS event_type_1, max(snap_CA) AS snap_CA, max(snap_TX) AS snap_TX, max(snap_WI) AS snap_WI{static_sql} FROM panel GROUP BY {', '.join((*keys, 'date'))}"

    @query(f"agg_level_{level}", _sql(sql))
    def agg_level(spark, sf_dir):
        return rounded(panel.aggregate_level(cleaned(spark, sf_dir), level), "sales_quantity", "wm_yr_wk", "wday", "month", "year", "sell_price")


for _level in LEVELS:
    _add_level(_level)


@query("split_hist", _sql(f"SELECT {_ROW} FROM hist"))
def split_hist(spark, sf_dir):
    return rounded(history(spark, sf_dir).select("id", "date", "sales_quantity"), "sales_quantity")


@query("split_future", _sql("SELECT id, date, wday, month, year, event_name_1, snap_CA, round(sell_price + 3e-7, 4) AS sell_price FROM future"))
def split_future(spark, sf_dir):
    return rounded(panel.split(cleaned(spark, sf_dir), CUTOFF)[1].select("id", "date", "wday", "month", "year", "event_name_1", "snap_CA", "sell_price"), "sell_price")


#: For the trims: some rows become 0, and one store's all do, so that leading zeros and empty series occur.
_HOLED = "SELECT id, date, CASE WHEN store_id = 'NATION_3' OR year < 1996 THEN 0 ELSE sales_quantity END AS sales_quantity FROM hist"


def _holed(spark, sf_dir):
    gone = (F.col("store_id") == "NATION_3") | (F.col("year") < 1996)
    return history(spark, sf_dir).select("id", "date", F.when(gone, 0.0).otherwise(F.col("sales_quantity")).alias("sales_quantity"))


def _trim_sql(active: str, empty: str) -> str:
    return _sql(f"SELECT {_ROW} FROM (SELECT *, min(CASE WHEN {active} THEN date END) OVER (PARTITION BY id) AS first FROM holed) WHERE {empty}date >= first", f", holed AS ({_HOLED})")


@query("trim_active", _trim_sql("sales_quantity > 0", "first IS NULL OR "))
def trim_active(spark, sf_dir):
    return rounded(panel.trim(_holed(spark, sf_dir), "positive"), "sales_quantity")


@query("trim_active_nonzero", _trim_sql("sales_quantity <> 0", "first IS NULL OR "))
def trim_active_nonzero(spark, sf_dir):
    return rounded(panel.trim(_holed(spark, sf_dir), "nonzero"), "sales_quantity")


@query("trim_active_drop_empty", _trim_sql("sales_quantity > 0", ""))
def trim_active_drop_empty(spark, sf_dir):
    return rounded(panel.trim(_holed(spark, sf_dir), "drop_empty"), "sales_quantity")


@query("static_dim", _sql("SELECT * FROM static"))
def static_dim(spark, sf_dir):
    return static(spark, sf_dir)


@query("densify", _sql("SELECT id, date, round(y, 4) AS sales_quantity FROM cells", GRID))
def densify(spark, sf_dir):
    return rounded(panel.densify(history(spark, sf_dir)), "sales_quantity")


_DAYS = 28


@query("melt_truth", _sql(f"SELECT id, date, round(sum(sales_quantity), 4) AS sales_quantity FROM (SELECT s.id, DATE '2001-07-01' + CAST(k AS INTEGER) AS date, 0.0 AS sales_quantity FROM (SELECT DISTINCT id FROM actual) s CROSS JOIN range(0, {_DAYS}) AS r(k) UNION ALL SELECT id, date, sales_quantity FROM actual) GROUP BY id, date"))
def melt_truth(spark, sf_dir):
    """Pivots the actuals into a wide table of day columns, as the truth comes, and melts it back."""
    day = F.datediff("date", F.to_date(F.lit(CUTOFF)))
    names = [f"d_{k}" for k in range(1, _DAYS + 1)]
    wide = actuals(spark, sf_dir).groupBy("id").agg(*[F.coalesce(F.sum(F.when(day == k, F.col("sales_quantity"))), F.lit(0.0)).alias(n) for k, n in enumerate(names, 1)])
    k = F.explode(F.sequence(F.lit(1), F.lit(_DAYS))).alias("k")
    calendar = spark.range(1).select(k).select(F.concat(F.lit("d_"), F.col("k").cast("string")).alias("d"), F.date_add(F.to_date(F.lit(CUTOFF)), F.col("k")).alias("date"))
    return rounded(panels.melt_truth(wide, calendar), "sales_quantity")


@query("future_dates", _sql("SELECT h AS horizon, date FROM horizon", GRID))
def future_dates(spark, sf_dir):
    return panel.future_dates(history(spark, sf_dir), HORIZON)


def _naive(spark, sf_dir):
    return forecast.naive(history(spark, sf_dir), HORIZON)


@query("naive", _sql(f"SELECT {_ROW} FROM naive", GRID, NAIVE))
def naive(spark, sf_dir):
    return rounded(_naive(spark, sf_dir), "sales_quantity")


@query("snaive", _sql("SELECT p.id, h.date, round(greatest(c.y, 0), 4) AS sales_quantity FROM (SELECT DISTINCT id, least(7, n) AS k FROM trimmed) p CROSS JOIN horizon h CROSS JOIN grid JOIN cells c ON c.id = p.id AND c.t = grid.last_t - p.k + 1 + (h.h - 1) % p.k", GRID))
def snaive(spark, sf_dir):
    return rounded(forecast.seasonal_naive(history(spark, sf_dir), HORIZON), "sales_quantity")


_MA = ", ".join(f"avg(CASE WHEN i >= {k} THEN (y - m{k}) * (y - m{k}) END) AS e{k}, avg(CASE WHEN i >= n - {k} THEN y END) AS f{k}" for k in range(2, 15))
_MA_WINDOWS = ", ".join(f"avg(y) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS m{k}" for k in range(2, 15))
_MA_BEST = "CASE " + " ".join("WHEN " + " AND ".join(f"coalesce(e{k}, 1e300) {'<' if j < k else '<='} coalesce(e{j}, 1e300)" for j in range(2, 15) if j != k) + f" THEN f{k}" for k in range(2, 15)) + " ELSE f2 END"


@query("ma", _sql(f"SELECT x.id, h.date, round(greatest(x.f, 0), 4) AS sales_quantity FROM (SELECT id, {_MA_BEST} AS f FROM (SELECT id, {_MA} FROM (SELECT *, {_MA_WINDOWS} FROM trimmed) GROUP BY id)) x CROSS JOIN horizon h", GRID))
def ma(spark, sf_dir):
    return rounded(forecast.moving_average(history(spark, sf_dir), HORIZON), "sales_quantity")


_INTERVALS = ", gaps AS (SELECT id, row_number() OVER w AS k, y AS demand, coalesce(t - lag(t) OVER w, 1) AS gap FROM cells WHERE y <> 0 WINDOW w AS (PARTITION BY id ORDER BY t))"


@query("intervals", _sql("SELECT id, CAST(k AS INTEGER) AS k, round(demand, 4) AS demand, CAST(gap AS DOUBLE) AS gap FROM gaps", GRID, _INTERVALS))
def intervals(spark, sf_dir):
    return rounded(forecast.intervals(history(spark, sf_dir)).select("id", "k", "demand", "gap"), "demand")


def _croston_sql(factor: str) -> str:
    rate = f", sized AS (SELECT *, max(k) OVER (PARTITION BY id) AS m FROM gaps), rate AS (SELECT id, {factor} * sum(w * demand) / greatest(sum(w * gap), 1e-8) AS y FROM (SELECT *, CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END * pow(0.9, m - k) AS w FROM sized) GROUP BY id)"
    return _sql("SELECT i.id, h.date, round(greatest(coalesce(r.y, 0), 0), 4) AS sales_quantity FROM (SELECT DISTINCT id FROM hist) i CROSS JOIN horizon h LEFT JOIN rate r ON r.id = i.id", GRID, _INTERVALS, rate)


@query("croston", _croston_sql("1.0"))
def croston(spark, sf_dir):
    return rounded(forecast.croston(history(spark, sf_dir), HORIZON), "sales_quantity")


@query("sba", _croston_sql("0.95"))
def sba(spark, sf_dir):
    return rounded(forecast.sba(history(spark, sf_dir), HORIZON), "sales_quantity")


@query("ses_fixed", _sql("SELECT x.id, h.date, round(greatest(x.y, 0), 4) AS sales_quantity FROM (SELECT id, sum(CASE WHEN i = 0 THEN 1.0 ELSE 0.1 END * pow(0.9, n - 1 - i) * y) AS y FROM trimmed GROUP BY id) x CROSS JOIN horizon h", GRID))
def ses_fixed(spark, sf_dir):
    return rounded(forecast.ses_fixed(history(spark, sf_dir), 0.1, HORIZON), "sales_quantity")


@query("block_sums", _sql("SELECT id, CAST((n - 1 - i) // 7 + 1 AS INTEGER) AS block, round(sum(y), 4) AS total FROM trimmed WHERE i >= n - n // 7 * 7 GROUP BY id, (n - 1 - i) // 7", GRID))
def block_sums(spark, sf_dir):
    return rounded(forecast.block_sums(history(spark, sf_dir), 7), "total")


def _add_local(name: str) -> None:
    @query(name)
    def one(spark, sf_dir):
        return rounded(forecast.local(history(spark, sf_dir), (name,), HORIZON), "sales_quantity")


for _name in ("ses", "optcroston", "tsb", "adida", "imapa"):
    _add_local(_name)


@query("local_all")
def local_all(spark, sf_dir):
    return rounded(forecast.local(history(spark, sf_dir), horizon=HORIZON), "sales_quantity")


@query("es_bu")
def es_bu(spark, sf_dir):
    return rounded(adapters.run(("es_bu",), history(spark, sf_dir), horizon=HORIZON), "sales_quantity")


@query("arima_bu")
def arima_bu(spark, sf_dir):
    return rounded(adapters.run(("arima_bu",), history(spark, sf_dir), horizon=HORIZON), "sales_quantity")


@query(
    "bottom_up",
    _sql(
        f"SELECT level, agg_id AS id, date, round(sum(sales_quantity), 4) AS sales_quantity FROM ({_levels('(SELECT s.*, f.date, f.sales_quantity FROM naive f LEFT JOIN static s ON f.id = s.id)', 'date, sales_quantity', 'Total')}) GROUP BY level, agg_id, date",
        GRID,
        NAIVE,
    ),
)
def bottom_up(spark, sf_dir):
    return rounded(hierarchy.bottom_up(_naive(spark, sf_dir), static(spark, sf_dir)), "sales_quantity")


@query("align", _sql("SELECT id, date, round(f, 4) AS f, round(a, 4) AS a FROM pairs WHERE f <> 0 OR a <> 0", GRID, NAIVE, PAIRS))
def align(spark, sf_dir):
    rows = evaluate.aligned(_naive(spark, sf_dir), actuals(spark, sf_dir), static(spark, sf_dir)).where("f <> 0 or a <> 0")
    return rounded(rows.select("id", "date", "f", "a"), "f", "a")


@query("missing_ids", _sql("SELECT id FROM static WHERE id NOT IN (SELECT id FROM actual)"))
def missing_ids(spark, sf_dir):
    return evaluate.missing_series(static(spark, sf_dir), actuals(spark, sf_dir))


_PRICE = "SELECT f.id, f.date, round(f.full_price + 3e-7, 4) AS price FROM filled f CROSS JOIN grid WHERE f.t > grid.last_t - 28"


@query("price_fill", _sql(_PRICE, GRID, WEIGHTS))
def price_fill(spark, sf_dir):
    return rounded(panel.price_fill(history(spark, sf_dir)), "price")


@query("price_fill_window", _sql(_PRICE, GRID, WEIGHTS.replace("FROM cells)", "FROM (SELECT c.* FROM cells c CROSS JOIN grid WHERE c.t > grid.last_t - 28))", 1)))
def price_fill_window(spark, sf_dir):
    return rounded(panel.price_fill(history(spark, sf_dir), "window"), "price")


def _scales(spark, sf_dir, mode):
    rows = forecast.indexed(history(spark, sf_dir))
    return rounded(weights.scales_of(rows, ["id"], "y", mode), "scale")


@query("scales", _sql(f"SELECT id, round(scale, 4) AS scale FROM ({_scale('cells', 'id')})", GRID))
def scales(spark, sf_dir):
    return _scales(spark, sf_dir, "from_first")


@query("scales_inclusive", _sql(f"SELECT id, round(scale, 4) AS scale FROM ({_scale('cells', 'id', 'inclusive')})", GRID))
def scales_inclusive(spark, sf_dir):
    return _scales(spark, sf_dir, "inclusive")


def _ws(spark, sf_dir):
    return weights.weights_scales(history(spark, sf_dir))


@query("weights", _sql("SELECT level, id, round(weight, 6) AS weight FROM ws", GRID, WEIGHTS))
def weights_(spark, sf_dir):
    return rounded(_ws(spark, sf_dir).select("level", "id", "weight"), "weight", digits=6)


@query("weights_scales", _sql("SELECT level, id, round(scale, 4) AS scale, round(weight, 6) AS weight FROM ws", GRID, WEIGHTS))
def weights_scales(spark, sf_dir):
    return rounded(rounded(_ws(spark, sf_dir), "scale"), "weight", digits=6)


def _by_series(spark, sf_dir):
    return evaluate.rmsse_by_series(_naive(spark, sf_dir), actuals(spark, sf_dir), _ws(spark, sf_dir), static(spark, sf_dir))


@query("rmsse_by_series", _sql("SELECT level, id, round(mse, 4) AS mse, round(rmsse, 4) AS rmsse FROM series", GRID, NAIVE, WEIGHTS, SCORES))
def rmsse_by_series(spark, sf_dir):
    return rounded(_by_series(spark, sf_dir).select("level", "id", "mse", "rmsse"), "mse", "rmsse")


@query("level_scores", _sql("SELECT level, round(score, 6) AS score FROM scores", GRID, NAIVE, WEIGHTS, SCORES))
def level_scores(spark, sf_dir):
    return rounded(evaluate.level_scores(_by_series(spark, sf_dir)), "score", digits=6)


@query("wrmsse", _sql("SELECT round(avg(score), 6) AS wrmsse FROM scores", GRID, NAIVE, WEIGHTS, SCORES))
def wrmsse(spark, sf_dir):
    return evaluate.wrmsse(evaluate.level_scores(_by_series(spark, sf_dir)))


@query("point_metrics", _sql("SELECT round(sum(abs(a - f)) / greatest(sum(a), 1e-8), 6) AS wape, round(sqrt(avg((a - f) * (a - f))), 6) AS rmse, round(avg(abs(a - f)), 6) AS mae FROM pairs", GRID, NAIVE, PAIRS))
def point_metrics(spark, sf_dir):
    return rounded(evaluate.point_metrics(_naive(spark, sf_dir), actuals(spark, sf_dir), static(spark, sf_dir)), "wape", "rmse", "mae", digits=6)


_TEXT = "CASE level " + " ".join("WHEN {} THEN '{}'".format(k, str(list(v)).replace("'", "''")) for k, v in LEVELS.items()) + " END"


@query("level_report", _sql(f"SELECT level, round(score, 6) AS wrmsse, {_TEXT} AS description FROM scores", GRID, NAIVE, WEIGHTS, SCORES))
def level_report(spark, sf_dir):
    return evaluate.level_report(evaluate.level_scores(_by_series(spark, sf_dir)))


def _stats(spark, sf_dir):
    return eda.series_stats(cleaned(spark, sf_dir))


@query("series_stats", _sql("SELECT * REPLACE (round(zero_frac, 6) AS zero_frac) FROM stats", STATS))
def series_stats(spark, sf_dir):
    return rounded(_stats(spark, sf_dir), "zero_frac", digits=6)


def _describe_sql(column: str) -> str:
    rows = [("count", f"CAST(count({column}) AS DOUBLE)"), ("mean", f"avg({column})"), ("std", f"stddev_samp({column})"), ("min", f"CAST(min({column}) AS DOUBLE)"), *[(f"{q}%", f"quantile_cont(CAST({column} AS DOUBLE), {q / 100})") for q in (25, 50, 75)], ("max", f"CAST(max({column}) AS DOUBLE)")]
    return ", ".join(f"round({e}, 1) AS \"{n}|{column}\"" for n, e in rows)


_STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


@query("describe_stats", _sql(" UNION ALL ".join(f"SELECT '{n}' AS statistic, \"{n}|raw_length\" AS raw_length, \"{n}|zero_frac\" AS zero_frac, \"{n}|active_length\" AS active_length FROM described" for n in _STATISTICS), STATS, ", described AS (SELECT " + ", ".join(map(_describe_sql, ("raw_length", "zero_frac", "active_length"))) + " FROM stats)"))
def describe_stats(spark, sf_dir):
    return eda.describe(_stats(spark, sf_dir), ["raw_length", "zero_frac", "active_length"])


@query("count_by_cat", _sql("SELECT cat_id, count(*) AS series FROM stats GROUP BY cat_id", STATS))
def count_by_cat(spark, sf_dir):
    return eda.counts_by(_stats(spark, sf_dir), "cat_id")


@query("median_zero_by_dept", _sql("SELECT dept_id, round(median(zero_frac), 6) AS median_zero_frac FROM stats GROUP BY dept_id", STATS))
def median_zero_by_dept(spark, sf_dir):
    return rounded(eda.median_by(_stats(spark, sf_dir), "dept_id", "zero_frac"), "median_zero_frac", digits=6)


@query("median_len_by_store", _sql("SELECT store_id, CAST(median(active_length) AS DOUBLE) AS median_active_length FROM stats GROUP BY store_id", STATS))
def median_len_by_store(spark, sf_dir):
    return eda.median_by(_stats(spark, sf_dir), "store_id", "active_length")


_WEEK = "CASE CAST(wday AS INTEGER) " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(eda.WEEKDAYS, 1)) + " END"


@query("dow_avg", _sql(f"SELECT CAST(wday AS INTEGER) AS wday, {_WEEK} AS weekday, round(avg(sales_quantity), 4) AS mean_target FROM panel GROUP BY wday"))
def dow_avg(spark, sf_dir):
    return rounded(eda.weekday_profile(cleaned(spark, sf_dir)), "mean_target")


def _histogram_sql(source: str, value: str, bins: int) -> str:
    at = f"CASE WHEN b = a THEN 0 ELSE least(floor((x - a) / ((b - a) / {bins})), {bins} - 1) END"
    return f"SELECT CAST(bin AS INTEGER) AS bin, round(a + bin * (b - a) / {bins}, 4) AS low, round(a + (bin + 1) * (b - a) / {bins}, 4) AS high, count(*) AS n FROM (SELECT a, b, {at} AS bin FROM (SELECT CAST({value} AS DOUBLE) AS x, min(CAST({value} AS DOUBLE)) OVER () AS a, max(CAST({value} AS DOUBLE)) OVER () AS b FROM {source} WHERE {value} IS NOT NULL)) GROUP BY bin, a, b"


def _add_histogram(name: str, source: str, value: str, bins: int, sql_source: str, sql_value: str) -> None:
    @query(name, _sql(_histogram_sql(sql_source, sql_value, bins), STATS))
    def one(spark, sf_dir):
        frame = _stats(spark, sf_dir).withColumn("first_sale_day", F.datediff("first_sale_date", F.to_date(F.lit("1970-01-01")))) if source == "stats" else cleaned(spark, sf_dir).where("sales_quantity > 0")
        return rounded(eda.histogram(frame, value, bins), "low", "high")


for _args in (
    ("hist_raw_len", "stats", "raw_length", 40, "stats", "raw_length"),
    ("hist_active_len", "stats", "active_length", 40, "stats", "active_length"),
    ("hist_first_sale", "stats", "first_sale_day", 30, "stats", "date_diff('day', DATE '1970-01-01', first_sale_date)"),
    ("hist_zero_frac", "stats", "zero_frac", 50, "stats", "zero_frac"),
    ("hist_quantity", "panel", "sales_quantity", 60, "(SELECT * FROM panel WHERE sales_quantity > 0)", "sales_quantity"),
):
    _add_histogram(*_args)


@query("sample_nonzero")
def sample_nonzero(spark, sf_dir):
    return eda.sample_nonzero(cleaned(spark, sf_dir))


@query("event_panel", "SELECT event_type AS id, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS sales_quantity FROM events GROUP BY event_type, CAST(ts AS DATE)")
def event_panel(spark, sf_dir):
    return panels.event_panel(spark, sf_dir)


@query("covariate_frames", _sql("SELECT 'train' AS frame, id, date, round(sales_quantity, 4) AS sales_quantity, wday, month, event_type_1 FROM hist UNION ALL SELECT 'future', id, date, NULL, wday, month, event_type_1 FROM future"))
def covariate_frames(spark, sf_dir):
    hist, future = panel.split(cleaned(spark, sf_dir), CUTOFF)
    train, ahead = panel.covariate_frames(hist, future, ("wday", "month", "event_type_1", "unknown"))
    both = train.withColumn("frame", F.lit("train")).unionByName(ahead.withColumn("frame", F.lit("future")), allowMissingColumns=True)
    return rounded(both.select("frame", "id", "date", "sales_quantity", "wday", "month", "event_type_1"), "sales_quantity")


@query("leaderboard")
def leaderboard(spark, sf_dir):
    """Scores of the naive and seasonal naive forecasts, written as metrics files and read back as a ranking."""
    base = f"{store.shared_folder(spark)}/leaderboard-{store.stamp(spark, [f'{sf_dir}/{t}.parquet' for t in store.STAR_TABLES])[:32]}"
    hist, truth, ws, keys = history(spark, sf_dir), actuals(spark, sf_dir), _ws(spark, sf_dir), static(spark, sf_dir)
    for name, f in (("naive", forecast.naive), ("snaive", forecast.seasonal_naive)):
        store.save_metrics(spark, evaluate.evaluate(f(hist, HORIZON), truth, ws, keys), base, "star", CUTOFF, name)
    return store.leaderboard(spark, base, "star", CUTOFF).select("exp_tag", "WRMSSE", "WAPE_L12", "RMSE_L12", "MAE_L12")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


assert DEFAULT.horizon == HORIZON
