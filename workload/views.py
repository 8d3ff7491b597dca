"""Named SQL views over the test tables, from which the expected results are built.

They follow the textbook route (calendar tables, joins, one query per feature),
not the one the Spark code takes. Later views may use earlier ones.
"""

from __future__ import annotations

W = "(PARTITION BY unique_id ORDER BY ds)"
WHOLE = "(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def rows(first: str, last: str) -> str:
    return f"(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {first} AND {last})"


def full(function: str, column: str, n: int, lag: int = 0) -> str:
    frame = rows(f"{lag + n - 1} PRECEDING", f"{lag} PRECEDING" if lag else "CURRENT ROW")
    return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {function}({column}) OVER {frame} END"


def bars_of(source: str, extra: str = "") -> str:
    return f"""
    SELECT unique_id, ds, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, k) AS close, sum(size) AS volume {extra} FROM ({source}) GROUP BY unique_id, ds"""


def calendar_of(bars: str) -> str:
    return f"""
    SELECT unique_id, CAST(d AS DATE) AS ds FROM (
      SELECT unique_id, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS d
      FROM (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM {bars} GROUP BY unique_id))
    WHERE isodow(d) < 6"""


def aligned_of(bars: str, calendar: str) -> str:
    return f"""
    SELECT c.unique_id, c.ds, b.open, b.high, b.low, b.close, b.volume
    FROM {calendar} c LEFT JOIN {bars} b ON b.unique_id = c.unique_id AND b.ds = c.ds"""


def filled_of(aligned: str) -> str:
    past = rows("UNBOUNDED PRECEDING", "CURRENT ROW")
    cols = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {past}, first_value({c} IGNORE NULLS) OVER {WHOLE}) AS {c}"
        for c in ("open", "high", "low", "close", "volume")
    )
    return f"""
    SELECT unique_id, ds, open, high, low, close,
           CAST(round_even(greatest(coalesce(volume, 1), 1), 0) AS BIGINT) AS volume
    FROM (SELECT unique_id, ds, {cols} FROM {aligned})"""


def features_of(source: str, c: str) -> str:
    """Every default lag feature of column `c`."""
    parts = [f"lag({c}, {k}) OVER {W} AS lag{k}" for k in (1, 2, 3, 5, 7, 14, 21)]
    before = rows("UNBOUNDED PRECEDING", "1 PRECEDING")
    parts += [f"avg({c}) OVER {before} AS expandingmean_lag1", f"stddev_samp({c}) OVER {before} AS expandingstd_lag1"]
    parts += [f"{full('avg', c, w, k)} AS rollingmean_lag{k}_{w}" for k, w in ((5, 5), (10, 10), (21, 21))]
    parts += [f"{full('stddev_samp', c, w, k)} AS rollingstd_lag{k}_{w}" for k, w in ((5, 5), (21, 21))]
    smooth = f"list({c}) OVER {rows('400 PRECEDING', '10 PRECEDING')}"
    parts.append(f"list_reduce({smooth}, lambda s, v: CAST(0.8 AS DOUBLE) * s + CAST(0.2 AS DOUBLE) * v)"
                 " AS exponentiallyweightedmean_lag10_0_2")
    season = " + ".join(f"lag({c}, {21 + 5 * i}) OVER {W}" for i in range(4))
    parts.append(f"({season}) / 4 AS seasonalrollingmean_lag21_5_4")
    return f"SELECT *, row_number() OVER {W} AS rn, {', '.join(parts)} FROM {source}"


def scaled(source: str, c: str = "y") -> str:
    return f"""
    SELECT *, ({c} - mean) / std AS z FROM (
      SELECT *, avg({c}) OVER (PARTITION BY unique_id) AS mean,
        CASE WHEN stddev_pop({c}) OVER (PARTITION BY unique_id) > 0
             THEN stddev_pop({c}) OVER (PARTITION BY unique_id) ELSE 1 END AS std
      FROM {source})"""


def ridge_of(p: str, source: str, weights: str = "") -> dict[str, str]:
    """Ridge on lags 1 and 5 of the scaled target, by its normal equations, and its 14-step path.

    `weights` names another fit whose weights the path uses instead.
    """
    used = weights or f"{p}_w"
    return {
        f"{p}_z": f"""
    SELECT *, lag(z, 1) OVER {W} AS x1, lag(z, 5) OVER {W} AS x5 FROM ({scaled(source)})""",
        f"{p}_m": f"""
    SELECT count(*) AS n, avg(x1) AS m1, avg(x5) AS m5, avg(z) AS mz, stddev_pop(z) AS sz,
      var_pop(x1) * count(*) + 1 AS s11, var_pop(x5) * count(*) + 1 AS s55,
      covar_pop(x1, x5) * count(*) AS s15,
      covar_pop(x1, z) * count(*) AS s1z, covar_pop(x5, z) * count(*) AS s5z
    FROM {p}_z WHERE x5 IS NOT NULL""",
        f"{p}_w": f"""
    SELECT w1, w5, mz - w1 * m1 - w5 * m5 AS w0 FROM (
      SELECT *, (s55 * s1z - s15 * s5z) / (s11 * s55 - s15 * s15) AS w1,
                (s11 * s5z - s15 * s1z) / (s11 * s55 - s15 * s15) AS w5 FROM {p}_m)""",
        f"{p}_fit": f"""
    SELECT unique_id, ds, (w0 + w1 * x1 + w5 * x5) * std + mean AS ridge
    FROM {p}_z, {p}_w WHERE x5 IS NOT NULL""",
        f"{p}_path": f"""
    SELECT unique_id, 0 AS step, max(ds) AS last_ds, any_value(mean) AS mean, any_value(std) AS std,
           list(z ORDER BY ds) FILTER (WHERE age <= 5) AS h
    FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age FROM {p}_z) GROUP BY unique_id
    UNION ALL
    SELECT unique_id, step + 1, last_ds, mean, std, list_append(h[2:5], w0 + w1 * h[5] + w5 * h[1])
    FROM {p}_path, {used} WHERE step < 14""",
        f"{p}_ahead": f"""
    SELECT p.unique_id, p.step, f.ds, p.h[5] * p.std + p.mean AS ridge
    FROM {p}_path p JOIN ({future_of(source)}) f ON f.unique_id = p.unique_id AND f.step = p.step""",
    }


def future_of(source: str, horizon: int = 14) -> str:
    return f"""
    SELECT unique_id, ds, step FROM (
      SELECT unique_id, CAST(d AS DATE) AS ds, row_number() OVER (PARTITION BY unique_id ORDER BY d) AS step
      FROM (SELECT unique_id, unnest(generate_series(CAST(max(ds) AS TIMESTAMP) + INTERVAL 1 DAY,
              CAST(max(ds) AS TIMESTAMP) + INTERVAL {2 * horizon + 7} DAY, INTERVAL 1 DAY)) AS d
            FROM {source} GROUP BY unique_id)
      WHERE isodow(d) < 6) WHERE step <= {horizon}"""


LINE_KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
VIEWS: dict[str, str] = {}
VIEWS["trades"] = f"""
    SELECT upper(n_name) AS unique_id, CAST(l_shipdate AS DATE) AS ds, l_extendedprice / l_quantity AS price,
           l_quantity AS size, r_name AS sector, {LINE_KEY} AS k
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""
VIEWS["bars"] = bars_of("SELECT * FROM trades")
VIEWS["brand_bars"] = bars_of(f"""
    SELECT upper(p_brand) AS unique_id, CAST(l_shipdate AS DATE) AS ds, l_extendedprice / l_quantity AS price,
           l_quantity AS size, {LINE_KEY} AS k FROM lineitem JOIN part ON l_partkey = p_partkey""")
VIEWS["order_bars"] = bars_of("""
    SELECT upper(n_name) AS unique_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS price,
           CAST(1 AS DOUBLE) AS size, row(o_orderkey, o_totalprice) AS k
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
VIEWS["event_bars"] = bars_of("""
    SELECT upper(event_type) AS unique_id, CAST(ts AS DATE) AS ds, value AS price,
           CAST(1 AS DOUBLE) AS size, row(ts, event_id, value) AS k FROM events""")
VIEWS["sectors"] = """
    SELECT upper(n_name) AS unique_id, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey"""
VIEWS["quotes"] = """
    SELECT lower(n_name) AS unique_id, l_shipdate AS ds,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_returnflag
                ELSE CAST(l_extendedprice / l_quantity AS VARCHAR) END AS open,
           l_extendedprice / l_quantity * (1 + l_tax) AS high,
           l_extendedprice / l_quantity * (1 - l_discount) AS low,
           l_extendedprice / l_quantity AS close,
           CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS volume
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
VIEWS["typed_quotes"] = """
    SELECT upper(unique_id) AS unique_id, CAST(ds AS DATE) AS ds, TRY_CAST(open AS DOUBLE) AS open,
           high, low, close, CAST(volume AS DOUBLE) AS volume FROM quotes"""
VIEWS["traded_quotes"] = """
    SELECT * FROM typed_quotes WHERE open IS NOT NULL AND close > 0 AND volume > 0"""
VIEWS["clean_quotes"] = """
    SELECT unique_id, ds, open, high, low, close, volume FROM (
      SELECT *, row_number() OVER (PARTITION BY unique_id, ds ORDER BY open, high, low, close, volume) AS nth
      FROM traded_quotes) WHERE nth = 1"""
VIEWS["calendar"] = calendar_of("bars")
VIEWS["aligned"] = aligned_of("bars", "calendar")
VIEWS["panel"] = filled_of("aligned")
VIEWS["quote_calendar"] = calendar_of("clean_quotes")
VIEWS["quote_panel"] = filled_of(f"({aligned_of('clean_quotes', 'quote_calendar')})")
VIEWS["order_calendar"] = calendar_of("order_bars")
VIEWS["order_panel"] = filled_of(f"({aligned_of('order_bars', 'order_calendar')})")
VIEWS["event_calendar"] = calendar_of("event_bars")
VIEWS["event_panel"] = filled_of(f"({aligned_of('event_bars', 'event_calendar')})")


def training_of(panel: str) -> str:
    ratio = full("avg", "volume", 20)
    return f"""
    SELECT unique_id, ds, open, high, low, close, volume, coalesce(ret, 0) AS y,
      coalesce(sector, 'Unknown') AS sector, 'equity' AS asset_class,
      dense_rank() OVER (ORDER BY coalesce(sector, 'Unknown')) AS sector_code, 1 AS asset_class_code,
      greatest(volume / CAST(max(volume) OVER (PARTITION BY unique_id) AS DOUBLE), CAST(0.05 AS DOUBLE)) AS sample_weight,
      CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN day(ds) = 1 THEN 1 ELSE 0 END AS is_month_start,
      CASE WHEN ds = last_day(ds) THEN 1 ELSE 0 END AS is_month_end,
      weekofyear(ds) AS week_of_year,
      sin(2 * pi() * month(ds) / 12) AS month_sin, cos(2 * pi() * month(ds) / 12) AS month_cos,
      coalesce({full('stddev_samp', 'ret', 5)}, 0) AS volatility_5d,
      coalesce({full('stddev_samp', 'ret', 20)}, 0) AS volatility_20d,
      coalesce(close / lag(close, 5) OVER {W} - 1, 0) AS momentum_5d,
      coalesce(close / lag(close, 20) OVER {W} - 1, 0) AS momentum_20d,
      coalesce((high - low) / close, 0) AS range_pct,
      least(greatest(coalesce(volume / ({ratio}), 1), 0.1), 10) AS volume_ma_ratio
    FROM (SELECT p.*, s.sector, ln(p.close / lag(p.close) OVER (PARTITION BY p.unique_id ORDER BY p.ds)) AS ret
          FROM {panel} p LEFT JOIN sectors s ON s.unique_id = p.unique_id)"""


VIEWS["training"] = training_of("panel")
VIEWS["scaled_training"] = scaled("training")
VIEWS["lagged"] = features_of("training", "y")
VIEWS["lagged_z"] = features_of("scaled_training", "z")
VIEWS["aged"] = "SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS age FROM training"
VIEWS["last_rows"] = "SELECT * FROM aged WHERE age = 1"
VIEWS["future"] = future_of("training")
# two simple stand-in models: repeat the last value, and average the last five
VIEWS["simple_fit"] = f"""
    SELECT unique_id, ds, y, close, lag(y) OVER {W} AS naive,
           avg(y) OVER {rows('5 PRECEDING', '1 PRECEDING')} AS mean5 FROM training"""
VIEWS["simple_ahead"] = """
    SELECT f.unique_id, f.ds, f.step, l.y / f.step AS naive, m.mean_y AS mean5, l.close AS last_close
    FROM future f JOIN last_rows l ON l.unique_id = f.unique_id
    JOIN (SELECT unique_id, avg(y) AS mean_y FROM training GROUP BY unique_id) m ON m.unique_id = f.unique_id"""
VIEWS["splits"] = """
    SELECT a.*, w AS "window", CASE WHEN age > off + 14 THEN 'train' ELSE 'test' END AS role,
           max(CASE WHEN age > off + 14 THEN ds END) OVER (PARTITION BY unique_id, w) AS cutoff
    FROM aged a JOIN (SELECT 0 AS w, 7 AS off UNION ALL SELECT 1, 0) ON age > off"""
VIEWS["simple_cv"] = """
    SELECT s.unique_id, s.ds, s.cutoff, s."window", s.y, f.naive, f.mean5
    FROM splits s JOIN simple_fit f ON f.unique_id = s.unique_id AND f.ds = s.ds WHERE s.role = 'test'"""
for fold in (0, 1):
    VIEWS[f"fold{fold}"] = f"""SELECT unique_id, ds, y, close FROM splits WHERE "window" = {fold} AND role = 'train'"""
    VIEWS |= ridge_of(f"r{fold}", f"fold{fold}")
VIEWS |= ridge_of("r", "training")
for fold, age in ((0, 28), (1, 14)):
    VIEWS[f"calibration{fold}"] = f"SELECT unique_id, ds, y, close FROM aged WHERE age > {age}"
VIEWS |= ridge_of("c0", "calibration0") | ridge_of("c1", "calibration1", weights="c0_w")
# each fold's own calibration: two windows at the end of its training rows, one fit
for fold, off in ((0, 7), (1, 0)):
    for part, age in ((0, 28), (1, 14)):
        VIEWS[f"f{fold}part{part}"] = f"SELECT unique_id, ds, y, close FROM aged WHERE age > {off + 14 + age}"
    VIEWS |= ridge_of(f"f{fold}c0", f"f{fold}part0") | ridge_of(f"f{fold}c1", f"f{fold}part1", weights=f"f{fold}c0_w")
VIEWS["universe"] = "SELECT c_custkey AS position, lower(c_name) || '.us' AS ticker FROM customer"
VIEWS["companies"] = """
    SELECT upper(c_name) AS ticker, c_name AS name, n_name AS sector
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"""
VIEWS["customer_days"] = """
    SELECT upper(c_name) || '.US' AS unique_id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS close
    FROM orders JOIN customer ON o_custkey = c_custkey"""
VIEWS["listing"] = """
    SELECT upper(u.ticker) AS ticker, replace(upper(u.ticker), '.US', '') AS symbol,
           coalesce(c.name, replace(upper(u.ticker), '.US', '')) AS name, coalesce(c.sector, 'Unknown') AS sector,
           upper(u.ticker) IN (SELECT unique_id FROM customer_days) AS has_data
    FROM universe u LEFT JOIN companies c ON c.ticker = replace(upper(u.ticker), '.US', '')"""
