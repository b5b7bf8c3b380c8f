"""The same queries in ANSI SQL, formulated independently where that is possible: recursion in
place of window algebra, joins in place of arrays."""

from __future__ import annotations

ORACLES: dict[str, str] = {}
IN_BRANDS = "ticker IN ('Brand#3', 'Brand#11', 'Brand#24')"
RANGE = "date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
MONEY = "DECIMAL(18,2)"


def _panel(name: str, unit: str) -> str:
    return f"""{name} AS (
        SELECT p_brand AS ticker, date_trunc('{unit}', l_shipdate)::DATE AS date, sum(l_extendedprice::{MONEY})::DOUBLE / sum(l_quantity::{MONEY})::DOUBLE AS adj_close,
               sum(l_quantity::{MONEY})::DOUBLE AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


#: Common tables that an oracle can ask for, with those that each needs.
TABLES = {
    "panel": ((), _panel("panel", "week")),
    "daily": ((), _panel("daily", "day")),
    "market": ((), f"""market AS (
        SELECT date_trunc('week', l_shipdate)::DATE AS date, sum(l_extendedprice::{MONEY})::DOUBLE / sum(l_quantity::{MONEY})::DOUBLE AS adj_close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""),
    "held": ((), "held AS (SELECT p_brand AS ticker, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM part) AS weight FROM part GROUP BY 1)"),
    "va": ((), f"""va AS (SELECT p_brand AS ticker, date_trunc('week', l_shipdate)::DATE AS date,
        sum(l_extendedprice::{MONEY}::DECIMAL(18,4))::DOUBLE / sum(l_quantity::{MONEY})::DOUBLE AS price_a
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A' GROUP BY 1, 2)"""),
    "vb": ((), f"""vb AS (SELECT p_brand AS ticker, date_trunc('week', l_shipdate)::DATE AS date,
        sum((l_extendedprice::{MONEY} * (1 - l_discount::{MONEY}))::DECIMAL(18,4))::DOUBLE / sum(l_quantity::{MONEY})::DOUBLE AS price_b
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2)"""),
    "sparse": (("daily",), """sparse AS (
        SELECT t.ticker, c.date, d.adj_close, d.volume FROM (SELECT DISTINCT ticker FROM daily) t
        CROSS JOIN (SELECT DISTINCT date FROM daily) c LEFT JOIN daily d ON d.ticker = t.ticker AND d.date = c.date)"""),
    "ordinals": (("panel",), "ordinals AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS ordinal FROM (SELECT DISTINCT ticker FROM panel))"),
    "market_r": (("market",), "market_r AS (SELECT date, r AS market FROM (SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS r FROM market) WHERE r IS NOT NULL)"),
    "both_r": (("panel", "market_r"), """both_r AS (
        SELECT ticker, date, stock, market FROM (SELECT ticker, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS stock FROM panel)
        JOIN market_r USING (date) WHERE stock IS NOT NULL)"""),
    "reversion": (("panel", "ordinals"), """reversion AS (
        SELECT ticker AS portfolio_id, ordinal * 100000 + (date - DATE '1970-01-01') AS seq, date, CASE WHEN adj_close < m THEN 'BUY' ELSE 'SELL' END AS side,
               ticker, 100.0::DOUBLE AS quantity, 'shares' AS sizing, adj_close
        FROM (SELECT *, avg(adj_close) OVER w AS m, count(adj_close) OVER w AS n FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
        JOIN ordinals USING (ticker) WHERE n = 100)"""),
    "latch": (("panel",), """signals AS (
        SELECT ticker, date, adj_close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, adj_close >= hi * (1 - 0.02::DOUBLE) AS b, adj_close <= lo * (1 + 0.02::DOUBLE) AS s
        FROM (SELECT *, max(adj_close) OVER w AS hi, min(adj_close) OVER w AS lo, count(adj_close) OVER w AS n FROM panel
              WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING)) WHERE n = 125),
        latch(ticker, i, date, adj_close, before, state) AS (
        SELECT ticker, i, date, adj_close, 0, CASE WHEN b THEN 1 ELSE 0 END FROM signals WHERE i = 1
        UNION ALL
        SELECT s.ticker, s.i, s.date, s.adj_close, l.state, CASE WHEN l.state = 0 AND s.b THEN 1 WHEN l.state = 1 AND s.s THEN 0 ELSE l.state END
        FROM latch l JOIN signals s ON s.ticker = l.ticker AND s.i = l.i + 1)"""),
    "momentum": (("latch", "ordinals"), """momentum AS (
        SELECT ticker AS portfolio_id, ordinal * 100000 + (date - DATE '1970-01-01') AS seq, date, CASE WHEN state = 1 THEN 'BUY' ELSE 'SELL' END AS side, ticker,
               CASE WHEN state = 1 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS quantity, 'pct' AS sizing, adj_close
        FROM latch JOIN ordinals USING (ticker) WHERE state <> before)"""),
    "ran_reversion": (("reversion",), """steps AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY seq) AS i FROM reversion),
        ran_reversion(portfolio_id, i, date, cash, quantity) AS (
        SELECT DISTINCT portfolio_id, 0::BIGINT, NULL::DATE, 1000000.0::DOUBLE, 0.0::DOUBLE FROM steps
        UNION ALL
        SELECT s.portfolio_id, s.i, s.date,
               CASE WHEN s.side = 'BUY' THEN CASE WHEN r.cash >= s.adj_close * 100 THEN r.cash - s.adj_close * 100 ELSE r.cash END ELSE r.cash + s.adj_close * least(100.0, r.quantity) END,
               CASE WHEN s.side = 'BUY' THEN CASE WHEN r.cash >= s.adj_close * 100 THEN r.quantity + 100 ELSE r.quantity END ELSE r.quantity - least(100.0, r.quantity) END
        FROM ran_reversion r JOIN steps s ON s.portfolio_id = r.portfolio_id AND s.i = r.i + 1)"""),
    "ran_momentum": (("momentum",), """steps AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY seq) AS i FROM momentum),
        ran_momentum(portfolio_id, i, date, cash, quantity) AS (
        SELECT DISTINCT portfolio_id, 0::BIGINT, NULL::DATE, 1000000.0::DOUBLE, 0.0::DOUBLE FROM steps
        UNION ALL
        SELECT portfolio_id, i, date, cash - adj_close * change, held + change FROM (
            SELECT s.portfolio_id, s.i, s.date, s.adj_close, r.cash, r.quantity AS held,
                   CASE WHEN s.side = 'SELL' THEN -least(floor(r.quantity * s.quantity), r.quantity)
                        WHEN r.cash >= s.adj_close * floor((r.cash + r.quantity * s.adj_close) * s.quantity / s.adj_close) THEN floor((r.cash + r.quantity * s.adj_close) * s.quantity / s.adj_close)
                        ELSE 0 END AS change
            FROM ran_momentum r JOIN steps s ON s.portfolio_id = r.portfolio_id AND s.i = r.i + 1))"""),
}
for _ran, _orders in (("ran_reversion", "reversion"), ("ran_momentum", "momentum")):
    TABLES[f"days_{_orders}"] = ((_ran, "panel"), f"""days_{_orders} AS (
        SELECT p.portfolio_id, c.date, coalesce(r.cash, 1000000.0) AS cash, coalesce(r.quantity, 0.0) AS quantity, r.date IS NOT NULL AS started, px.adj_close
        FROM (SELECT DISTINCT portfolio_id FROM {_orders}) p CROSS JOIN (SELECT DISTINCT date FROM panel) c
        ASOF LEFT JOIN (SELECT * FROM {_ran} WHERE i > 0) r ON r.portfolio_id = p.portfolio_id AND c.date >= r.date
        LEFT JOIN panel px ON px.ticker = p.portfolio_id AND px.date = c.date)""")
    TABLES[f"values_{_orders}"] = ((f"days_{_orders}",), f"""values_{_orders} AS (
        SELECT portfolio_id, date, CASE WHEN started THEN cash + quantity * adj_close ELSE cash END AS portfolio_value FROM days_{_orders})""")
TABLES["returns_reversion"] = (("values_reversion",), """returns_reversion AS (
    SELECT portfolio_id, date, r FROM (
        SELECT portfolio_id, date, v / lag(v) OVER (PARTITION BY portfolio_id ORDER BY date) - 1 AS r FROM (
            SELECT portfolio_id, date, last_value(portfolio_value IGNORE NULLS) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM values_reversion))
    WHERE r IS NOT NULL)""")
TABLES["idx"] = (("panel", "held"), """idx AS (
    SELECT date, sum(filled / first_price * weight / (SELECT sum(weight) FROM held)) AS index_value FROM (
        SELECT ticker, date, filled, first_value(filled) OVER (PARTITION BY ticker ORDER BY date) AS first_price FROM (
            SELECT t.ticker, c.date, coalesce(
                last_value(p.adj_close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.date ROWS UNBOUNDED PRECEDING),
                first_value(p.adj_close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
            FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = c.date))
    JOIN held USING (ticker) GROUP BY date)""")
TABLES["checked"] = (("market", "idx"), """checked AS (
    SELECT date, fr, ir, abs(fr - ir) AS diff FROM (
        SELECT date, f / lag(f) OVER (ORDER BY date) - 1 AS fr, x / lag(x) OVER (ORDER BY date) - 1 AS ir FROM (
            SELECT date, adj_close / first_value(adj_close) OVER (ORDER BY date) AS f, index_value / first_value(index_value) OVER (ORDER BY date) AS x FROM market JOIN idx USING (date)))
    WHERE fr IS NOT NULL AND ir IS NOT NULL)""")


def oracle(name: str, tables: str, columns: str, body: str) -> None:
    """columns: ``a b:d c:f``: dates (d) as text and doubles (f) at 6 places, as the queries show them."""
    needed: dict[str, str] = {}

    def need(table: str) -> None:
        if table not in needed:
            for other in TABLES[table][0]:
                need(other)
            needed[table] = TABLES[table][1]

    for table in tables.split():
        need(table)
    shown = []
    for column in columns.split():
        c, _, kind = column.partition(":")
        shown.append({"d": f"strftime({c}, '%Y-%m-%d') AS {c}", "f": f"round({c}, 6) + 0.0 AS {c}"}.get(kind, c))
    with_ = "WITH RECURSIVE " + ",\n".join(needed.values()) if needed else ""
    ORACLES[name] = f"{with_}\nSELECT {', '.join(shown)} FROM (\n{body}\n)"


PX = "ticker date:d adj_close:f"
oracle("scan_filter_panel", "panel", f"{PX} volume:f", f"SELECT * FROM panel WHERE {IN_BRANDS} AND {RANGE} AND ticker <> 'Brand#3'")
oracle("scan_half_open", "daily", f"{PX} volume:f", f"SELECT * FROM daily WHERE {IN_BRANDS} AND date >= DATE '1996-01-01' AND date < DATE '1997-12-31'")
oracle("missing_tickers", "panel", "ticker", f"SELECT ticker FROM (VALUES ('Brand#3'), ('Brand#11'), ('Brand#24'), ('Brand#99')) v(ticker) WHERE ticker NOT IN (SELECT ticker FROM panel WHERE {RANGE})")
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
WIDE = "SELECT date, " + ", ".join(f"max(adj_close) FILTER (WHERE ticker = '{b}') AS {b.replace('#', '_').lower()}" for b in ALL_BRANDS) + " FROM {} GROUP BY date"
oracle("panel_pivot", "panel", "date:d " + " ".join(f"brand_{i}:f" for i in range(1, 26)), WIDE.format("panel"))
oracle("panel_unpivot", "daily", "ticker date:d volume:f", "SELECT * FROM daily")
oracle("bulk_vendor_unpivot", "panel", f"{PX} volume:f", """SELECT t.ticker, c.date, adj_close, volume FROM (SELECT 'Brand#' || i AS ticker FROM range(1, 26) r(i)) t
    CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = c.date WHERE c.date >= DATE '1996-01-01' AND c.date < DATE '1997-12-31'""")
oracle("csv_roundtrip", "panel", "ticker date:d volume:f", "SELECT * FROM panel")
STATED_LINES = """(SELECT CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' AND l_tax = 0 THEN 'B' END AS code, l_quantity = 1 AS undated, l_discount, l_quantity, l_shipdate FROM lineitem)"""
oracle("csv_rejects", "", "kind code n total:f", f"""SELECT 'good' AS kind, '' AS code, count(*) AS n, sum(l_discount::{MONEY})::DOUBLE AS total FROM {STATED_LINES} WHERE code IS NULL AND NOT undated
    UNION ALL SELECT concat_ws(',', CASE WHEN undated THEN 'DATE' END, CASE WHEN code IS NOT NULL THEN 'RET' END), coalesce(code, ''), count(*), sum(l_quantity::{MONEY})::DOUBLE
    FROM {STATED_LINES} WHERE code IS NOT NULL OR undated GROUP BY 1, 2""")
oracle("csv_lenient", "", "year n n_known total:f", f"""SELECT CASE WHEN NOT undated THEN year(l_shipdate) END AS year, count(*) AS n, count(*) FILTER (WHERE code IS NULL) AS n_known,
    sum(CASE WHEN code IS NULL THEN l_discount::{MONEY} END)::DOUBLE AS total FROM {STATED_LINES} GROUP BY 1""")
oracle("parquet_roundtrip", "panel", f"{PX} volume:f", f"SELECT * FROM panel WHERE {IN_BRANDS} AND {RANGE}")
oracle("bucketed_panels", "va vb", "ticker date:d adj_close:f other:f change:f", f"""SELECT ticker, date, price_a AS adj_close, price_b AS other, price_a / lag(price_a) OVER (PARTITION BY ticker ORDER BY date) - 1 AS change
    FROM (SELECT * FROM va WHERE {RANGE}) JOIN vb USING (ticker, date)""")
oracle("source_fallback", "panel", f"{PX} volume:f", f"SELECT * FROM panel WHERE {IN_BRANDS} AND {RANGE}")
oracle("vendor_adjusted", "", f"{PX} volume:f", f"""SELECT 'ALL' AS ticker, l_shipdate::DATE AS date, max(l_extendedprice) * max(l_discount) AS adj_close, sum(l_quantity::{MONEY})::DOUBLE AS volume
    FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 2""")
oracle("rename_dictionary", "", "key tic p_size described", "SELECT p_partkey AS key, p_brand AS tic, p_size, 'key=Part key (internal; tic=Ticker Symbol' AS described FROM part")
oracle("ticker_remap", "", "ticker n", "SELECT CASE p_brand WHEN 'Brand#11' THEN 'Brand-11' ELSE p_brand END AS ticker, count(*) AS n FROM part GROUP BY 1")
oracle("header_detect", "held", "rid ticker weight:f", """SELECT 3 + row_number() OVER (ORDER BY k) AS rid, ticker, weight / 100 AS weight FROM (
    SELECT ticker AS k, ticker, round(weight, 4) AS weight FROM held UNION ALL SELECT 'Brand#19x', NULL, 1.0)""")
oracle("universe_append", "", "ticker", "SELECT DISTINCT 'BR-' || translate(substr(p_brand, 7, 2), '0123456789', 'ABCDEFGHIJ') AS ticker FROM part UNION SELECT 'SPY'")
oracle("profile_nulls", "daily", "column_name data_type n_rows n_null", f"WITH w AS ({WIDE.format('daily')}) SELECT 'date' AS column_name, 'date' AS data_type, count(*) AS n_rows, count(*) - count(date) AS n_null FROM w "
    + " ".join(f"UNION ALL SELECT 'brand_{i}', 'double', count(*), count(*) - count(brand_{i}) FROM w" for i in range(1, 26)))
oracle("profile_topk", "daily", "ticker times", "SELECT ticker, count(*) AS times FROM daily GROUP BY 1 ORDER BY times DESC, ticker LIMIT 10")
oracle("profile_summary", "daily", "first_date:d last_date:d n_keys n_rows", "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS n_keys, count(*) AS n_rows FROM daily")
oracle("completeness", "daily", "ticker n_present complete_pct:f", "SELECT ticker, count(adj_close) AS n_present, 100.0::DOUBLE * count(adj_close) / (SELECT count(DISTINCT date) FROM daily) AS complete_pct FROM daily GROUP BY 1")
oracle("complete_tickers", "panel", "ticker", "SELECT ticker FROM panel GROUP BY 1 HAVING count(adj_close) = (SELECT count(DISTINCT date) FROM panel) OR ticker = 'Brand#11'")
oracle("inner_align", "panel market", f"{PX} market:f", "SELECT ticker, date, p.adj_close, m.adj_close AS market FROM panel p JOIN market m USING (date)")
oracle("left_align_first", "daily", PX, f"""SELECT t.ticker, a.date, d.adj_close FROM (SELECT date FROM daily WHERE ticker = 'Brand#3') a CROSS JOIN (SELECT DISTINCT ticker FROM daily WHERE {IN_BRANDS}) t
    LEFT JOIN daily d ON d.ticker = t.ticker AND d.date = a.date""")
oracle("outer_grid", "panel", PX, "SELECT t.ticker, c.date, adj_close FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = c.date")
oracle("anti_left", "va vb", "ticker date:d price_a:f", "SELECT * FROM va WHERE NOT EXISTS (SELECT 1 FROM vb WHERE vb.ticker = va.ticker AND vb.date = va.date)")
oracle("anti_right", "va vb", "ticker date:d price_b:f", "SELECT * FROM vb WHERE NOT EXISTS (SELECT 1 FROM va WHERE vb.ticker = va.ticker AND vb.date = va.date)")
oracle("semi_dates", "daily", "ticker date:d volume:f", "SELECT * FROM daily WHERE date IN (SELECT date FROM daily WHERE ticker = 'Brand#3')")
oracle("append_absent", "", "ticker", "SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'SPY' UNION SELECT 'Brand#11'")
oracle("asof_month_end", "daily", "ticker date:d as_of_date:d adj_close:f", """SELECT a.ticker, a.date, d.date AS as_of_date, d.adj_close FROM (
        SELECT ticker, (m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS date FROM (SELECT DISTINCT ticker FROM daily), generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH) g(m)) a
    ASOF LEFT JOIN daily d ON a.ticker = d.ticker AND a.date >= d.date""")
oracle("asof_next_lines", "daily", "ticker date:d was:f as_of_date:d volume:f", """SELECT a.ticker, a.date, a.was, d.date AS as_of_date, d.volume
    FROM (SELECT ticker, date + 14 AS date, volume AS was FROM daily) a ASOF LEFT JOIN daily d ON a.ticker = d.ticker AND a.date <= d.date""")
oracle("asof_events", "", "event_id as_of price:f", """SELECT e.event_id, strftime(l.ts, '%Y-%m-%d') AS as_of, l.price FROM (SELECT event_id, ts::TIMESTAMP - INTERVAL 25 YEAR AS ts FROM events) e
    ASOF LEFT JOIN (SELECT l_shipdate::TIMESTAMP AS ts, max(l_extendedprice) AS price FROM lineitem GROUP BY 1) l ON e.ts >= l.ts""")
OVER = "OVER (PARTITION BY ticker ORDER BY date ROWS"
oracle("rolling_mean", "panel", "ticker date:d mean_100:f", f"SELECT ticker, date, avg(adj_close) {OVER} BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean_100 FROM panel QUALIFY count(adj_close) {OVER} BETWEEN 99 PRECEDING AND CURRENT ROW) = 100")
LONG = f"{OVER} BETWEEN 999 PRECEDING AND CURRENT ROW)"
oracle("rolling_long", "daily", "ticker date:d high:f low:f mean:f", f"""SELECT ticker, date, CASE WHEN n = 1000 THEN hi END AS high, CASE WHEN n = 1000 THEN lo END AS low, CASE WHEN n = 1000 THEN m END AS mean FROM (
    SELECT ticker, date, max(adj_close) {LONG} AS hi, min(adj_close) {LONG} AS lo, avg(adj_close) {LONG} AS m, count(adj_close) {LONG} AS n FROM daily)""")
oracle("scan_lines", "", "place quantity_so_far:f highest:f last_returned:f price_before:f", f"""SELECT place, sum(quantity) OVER w::DOUBLE AS quantity_so_far, max(price) OVER w AS highest,
    last_value(CASE WHEN flag = 'R' THEN price END IGNORE NULLS) OVER w AS last_returned, lag(price) OVER (ORDER BY place) AS price_before
    FROM (SELECT l_orderkey * 10 + l_linenumber AS place, sum(l_quantity::{MONEY}) AS quantity, max(l_extendedprice) AS price, max(l_returnflag) AS flag FROM lineitem GROUP BY 1)
    WINDOW w AS (ORDER BY place ROWS UNBOUNDED PRECEDING)""")
oracle("rolling_bands", "panel", "ticker date:d high:f low:f", f"""SELECT ticker, date, CASE WHEN n = 125 THEN hi END AS high, CASE WHEN n = 125 THEN lo END AS low FROM (
    SELECT ticker, date, max(adj_close) {OVER} BETWEEN 125 PRECEDING AND 1 PRECEDING) AS hi, min(adj_close) {OVER} BETWEEN 125 PRECEDING AND 1 PRECEDING) AS lo,
    count(adj_close) {OVER} BETWEEN 125 PRECEDING AND 1 PRECEDING) AS n FROM panel)""")
oracle("returns_pad", "sparse", "ticker date:d r:f", f"""SELECT ticker, date, f / lag(f) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM (
    SELECT ticker, date, last_value(adj_close IGNORE NULLS) {OVER} UNBOUNDED PRECEDING) AS f FROM sparse)""")
oracle("returns_nofill", "sparse", "ticker date:d r:f", "SELECT ticker, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM sparse")
oracle("cum_vwap", "panel", "ticker date:d vwap:f", f"SELECT ticker, date, sum(adj_close * volume) {OVER} UNBOUNDED PRECEDING) / sum(volume) {OVER} UNBOUNDED PRECEDING) AS vwap FROM panel")
oracle("cum_return", "panel", "ticker date:d cumulative:f", "SELECT ticker, date, adj_close / first_value(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS cumulative FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) > 1")
oracle("drawdown", "panel", "ticker date:d drawdown:f", f"SELECT ticker, date, adj_close / max(adj_close) {OVER} UNBOUNDED PRECEDING) - 1 AS drawdown FROM panel")
oracle("ffill_bfill", "sparse", "ticker date:d filled:f", f"""SELECT ticker, date, coalesce(last_value(volume IGNORE NULLS) {OVER} UNBOUNDED PRECEDING),
    first_value(volume IGNORE NULLS) {OVER} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM sparse""")
oracle("rebase", "panel", "ticker date:d multiple:f", "SELECT ticker, date, adj_close / first_value(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS multiple FROM panel")
oracle("beta_full", "both_r", "ticker beta:f n", "SELECT ticker, covar_samp(stock, market) / var_samp(market) AS beta, count(*) AS n FROM both_r GROUP BY 1")
BETAS = """SELECT m.rebalance_date, r.ticker, r.beta FROM (
        SELECT (g + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS rebalance_date
        FROM (SELECT date_trunc('month', min(date)) AS a, date_trunc('month', max(date)) AS z FROM market_r), LATERAL (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH)) AS g)
    ) m, (SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS following FROM (
        SELECT ticker, date, regr_slope(stock, market) OVER w AS beta, count(*) OVER w AS n FROM both_r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))) r
    WHERE r.n = 60 AND r.date <= m.rebalance_date AND (r.following IS NULL OR r.following > m.rebalance_date)
      AND m.rebalance_date BETWEEN (SELECT date FROM market_r ORDER BY date LIMIT 1 OFFSET 60) AND (SELECT max(date) FROM market_r)"""
oracle("beta_rolling", "both_r market_r", "rebalance_date:d ticker beta:f", BETAS)
oracle("pearson", "both_r", "ticker pearson:f", "SELECT ticker, corr(stock, market) AS pearson FROM both_r GROUP BY 1")
oracle("spearman", "both_r", "ticker spearman:f", """SELECT ticker, corr(a, b) AS spearman FROM (
    SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY stock) + (count(*) OVER (PARTITION BY ticker, stock) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY ticker ORDER BY market) + (count(*) OVER (PARTITION BY ticker, market) - 1) / 2.0 AS b FROM both_r) GROUP BY 1""")
oracle("spearman_lines", "", "a b spearman:f", " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, corr(x, y) AS spearman FROM (
    SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)"""
    for a, b in (("l_extendedprice", "l_quantity"), ("l_discount", "l_tax"), ("l_extendedprice", "l_discount"))))
oracle("worst_days", "checked", "date:d diff:f", "SELECT date, diff FROM checked ORDER BY diff DESC, date LIMIT 5")
ORDERS = "portfolio_id seq date:d side ticker quantity:f sizing"
oracle("orders_mean_reversion", "reversion", ORDERS, "SELECT * REPLACE ('mean_reversion' AS portfolio_id) FROM reversion")
oracle("orders_momentum", "momentum", ORDERS, "SELECT * REPLACE ('momentum' AS portfolio_id) FROM momentum")
BAB = f"""SELECT 'bab' AS portfolio_id, (rebalance_date - DATE '1970-01-01') * 100000 + n AS seq, rebalance_date AS date, 'BUY' AS side, ticker, trunc(100000 * mh / (ml + mh) / k) AS quantity, 'shares' AS sizing FROM legs WHERE lo <= k
    UNION ALL SELECT 'bab', (rebalance_date - DATE '1970-01-01') * 100000 + 50000 + n_high, rebalance_date, 'SELL', ticker, trunc(100000 * ml / (ml + mh) / k), 'shares' FROM legs WHERE hi <= k"""
BAB = f"""WITH betas AS ({BETAS}), enough AS (SELECT * FROM betas QUALIFY count(*) OVER (PARTITION BY rebalance_date) >= 20),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY beta, ticker) AS lo, row_number() OVER (PARTITION BY rebalance_date ORDER BY beta DESC, ticker DESC) AS hi,
        greatest(1, floor(count(*) OVER (PARTITION BY rebalance_date) * 0.1)) AS k FROM enough WHERE beta IS NOT NULL),
    legs AS (SELECT *, lo AS n, lo AS n_high, avg(beta) FILTER (WHERE lo <= k) OVER (PARTITION BY rebalance_date) AS ml, avg(beta) FILTER (WHERE hi <= k) OVER (PARTITION BY rebalance_date) AS mh FROM ranked)
    {BAB}"""
oracle("orders_bab", "both_r market_r", ORDERS, BAB)
HELD = """SELECT ticker, first_date, last_date, q, row_number() OVER (ORDER BY ticker) AS n FROM ({}), (SELECT min(date) AS first_date, max(date) AS last_date FROM {}) WHERE q > 0"""
SIDES = """SELECT '{0}' AS portfolio_id, n AS seq, first_date AS date, 'BUY' AS side, ticker, q AS quantity, CASE WHEN q <= 1 THEN 'pct' ELSE 'shares' END AS sizing FROM ({1})
    UNION ALL SELECT '{0}', 100000 + n, last_date, 'SELL', ticker, q, CASE WHEN q <= 1 THEN 'pct' ELSE 'shares' END FROM ({1})"""
oracle("orders_weighted", "panel held", ORDERS, SIDES.format("weighted", HELD.format(
    "SELECT ticker, 100000 * (weight / (SELECT sum(weight) FROM held)) / adj_close AS q FROM held JOIN panel USING (ticker) WHERE date = (SELECT min(date) FROM panel)", "panel")))
ONE = "(SELECT * FROM panel WHERE ticker = 'Brand#11')"
oracle("orders_simple", "panel", ORDERS, SIDES.format("single", HELD.format(f"SELECT ticker, 100000 / adj_close AS q FROM {ONE} WHERE date = (SELECT min(date) FROM {ONE})", ONE)))
oracle("order_prefix", "reversion", "portfolio_id seq date:d side ticker", """SELECT 'mean_reversion' AS portfolio_id, seq, date, side, ticker FROM reversion
    WHERE seq < coalesce((SELECT min(seq) FROM (SELECT seq, date < lag(date) OVER (ORDER BY seq) AS back FROM reversion) WHERE back), 9223372036854775807)""")
oracle("order_sorted", "both_r market_r panel", "seq date:d side ticker", f"SELECT * FROM ({BAB}) WHERE date IN (SELECT date FROM panel)")
oracle("order_snapped", "both_r market_r panel", "seq date:d side ticker", f"""SELECT seq, (SELECT min(p.date) FROM panel p WHERE p.date >= b.date) AS date, side, ticker FROM ({BAB}) b
    WHERE date <= (SELECT max(date) FROM panel)""")
oracle("backtest_values", "values_reversion", "portfolio_id date:d portfolio_value:f", "SELECT * FROM values_reversion")
oracle("backtest_cash", "days_reversion", "portfolio_id date:d cash:f", "SELECT * FROM days_reversion")
oracle("backtest_holdings", "days_reversion", "portfolio_id ticker date:d quantity:f", """SELECT portfolio_id, portfolio_id AS ticker, date, quantity FROM days_reversion d
    WHERE date >= (SELECT min(r.date) FROM (SELECT a.* FROM ran_reversion a JOIN ran_reversion b ON a.portfolio_id = b.portfolio_id AND a.i = b.i + 1 JOIN steps s ON s.portfolio_id = a.portfolio_id AND s.i = a.i
                                        WHERE s.side = 'SELL' OR a.cash <> b.cash) r WHERE r.portfolio_id = d.portfolio_id)""")
oracle("backtest_pct_sizing", "values_momentum", "portfolio_id date:d portfolio_value:f", "SELECT * FROM values_momentum")
EXCESS = "(r - 0.0045::DOUBLE / 252)"
oracle("metrics_core", "returns_reversion values_reversion", "portfolio_id max_drawdown:f daily_return:f cumulative_return:f log_return:f volatility:f sharpe_ratio:f", f"""SELECT portfolio_id, max_drawdown, avg(r) AS daily_return,
    product(1 + r) - 1 AS cumulative_return, avg(ln(1 + r)) AS log_return, stddev_samp(r) * sqrt(252.0) AS volatility, avg({EXCESS}) / stddev_samp({EXCESS}) * sqrt(252.0) AS sharpe_ratio
    FROM returns_reversion JOIN (SELECT portfolio_id, min(d) AS max_drawdown FROM (
        SELECT portfolio_id, portfolio_value / max(portfolio_value) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM values_reversion) GROUP BY 1) USING (portfolio_id) GROUP BY 1, 2""")
oracle("metrics_turnover", "days_reversion", "portfolio_id average_turnover:f daily_turnover:f", """SELECT portfolio_id, CASE WHEN count(t) = count(*) THEN avg(t) END AS average_turnover, CASE WHEN count(t) = count(*) THEN avg(t) END * 252 AS daily_turnover FROM (
    SELECT portfolio_id, date, i, CASE WHEN base > 0 THEN traded / base ELSE 0 END AS t FROM (
        SELECT portfolio_id, date, row_number() OVER w AS i, CASE WHEN started THEN abs(quantity - coalesce(lag(quantity) OVER w, 0)) * adj_close ELSE 0 END AS traded,
               lag(cash) OVER w + CASE WHEN lag(started) OVER w THEN lag(quantity) OVER w * lag(adj_close) OVER w ELSE 0 END AS base
        FROM days_reversion WINDOW w AS (PARTITION BY portfolio_id ORDER BY date))) WHERE i > 1 GROUP BY 1""")
oracle("benchmark_curve", "returns_reversion market_r", "portfolio_id date:d cumulative:f benchmark_cumulative:f", """SELECT portfolio_id, date, product(1 + r) OVER w - 1 AS cumulative, product(1 + coalesce(market, 0)) OVER w - 1 AS benchmark_cumulative
    FROM returns_reversion LEFT JOIN market_r USING (date) WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)""")
oracle("final_values", "values_reversion", "portfolio_id final_value:f", "SELECT portfolio_id, portfolio_value AS final_value FROM values_reversion WHERE date = (SELECT max(date) FROM panel)")
oracle("weighted_index", "idx", "date:d index_value:f", "SELECT * FROM idx")
RANKS = "(SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS b FROM {2}))"
oracle("verify_index", "checked idx market", "max_diff:f mean_diff:f within_threshold pearson:f n_days spearman:f fund_missing index_missing", f"""SELECT max(diff) AS max_diff, avg(diff) AS mean_diff, coalesce(bool_and(diff <= 0.01), true) AS within_threshold,
    corr(fr, ir) AS pearson, count(*) AS n_days, {RANKS.format("fr", "ir", "checked")} AS spearman, (SELECT count(*) - count(adj_close) FROM market) AS fund_missing, (SELECT count(*) - count(index_value) FROM idx) AS index_missing FROM checked""")
STATS = "mean_diff:f min_diff:f max_diff:f n_matched n_beyond share_beyond:f mean_beyond:f min_beyond:f max_beyond:f only_left only_right"
STAT = """SELECT avg(d) AS mean_diff, min(d) AS min_diff, max(d) AS max_diff, count(*) AS n_matched, count(*) FILTER (WHERE abs(d) > 0.0001) AS n_beyond,
    count(*) FILTER (WHERE abs(d) > 0.0001)::DOUBLE / count(*) AS share_beyond, avg(d) FILTER (WHERE abs(d) > 0.0001) AS mean_beyond, min(d) FILTER (WHERE abs(d) > 0.0001) AS min_beyond,
    max(d) FILTER (WHERE abs(d) > 0.0001) AS max_beyond, {} AS only_left, {} AS only_right FROM ({})"""
STATED = "(SELECT * FROM (SELECT ticker, date, price_a / lag(price_a) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM va) WHERE ret IS NOT NULL)"
oracle("reconcile_returns", "va vb", STATS, STAT.format(
    f"(SELECT count(*) FROM {STATED} ANTI JOIN vb USING (ticker, date))", f"(SELECT count(*) FROM vb ANTI JOIN {STATED} s USING (ticker, date))",
    f"SELECT ret - (price_b / lag(price_b) OVER (PARTITION BY ticker ORDER BY date) - 1) AS d FROM {STATED} JOIN vb USING (ticker, date)"))
oracle("reconcile_prices", "va vb", STATS, STAT.format(
    "(SELECT count(*) FROM va ANTI JOIN vb USING (ticker, date))", "(SELECT count(*) FROM vb ANTI JOIN va USING (ticker, date))", "SELECT price_a - price_b AS d FROM va JOIN vb USING (ticker, date)"))
oracle("crsp_prices", "va vb", STATS, STAT.format(
    "(SELECT count(*) FROM va ANTI JOIN vb USING (ticker, date))", "(SELECT count(*) FROM vb ANTI JOIN va USING (ticker, date))", "SELECT price_a - price_b AS d FROM va JOIN vb USING (ticker, date)"))
oracle("crsp_returns", "va vb", STATS, STAT.format(
    "(SELECT count(*) FROM va ANTI JOIN vb USING (ticker, date))", "(SELECT count(*) FROM vb ANTI JOIN va USING (ticker, date))",
    """SELECT ret - change AS d FROM (SELECT ticker, date, price_a / lag(price_a) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM va)
       JOIN (SELECT ticker, date, price_b / lag(price_b) OVER (PARTITION BY ticker ORDER BY date) - 1 AS change FROM vb SEMI JOIN va USING (ticker, date)) USING (ticker, date)"""))
oracle("vendor_compare", "va vb", "mean_abs_diff:f mean_pct:f max_pct:f pearson:f n_matched", """SELECT avg(abs(price_a - price_b)) AS mean_abs_diff, avg((price_a - price_b) / price_b * 100) AS mean_pct, max((price_a - price_b) / price_b * 100) AS max_pct,
    corr(price_a, price_b) AS pearson, count(*) AS n_matched FROM va JOIN vb USING (ticker, date)""")
TWO_STRATEGIES = """
    WITH RECURSIVE c AS (SELECT DISTINCT date FROM panel), ends AS (SELECT min(date) AS a, max(date) AS z FROM panel), w AS (
        SELECT ticker, 900000 * (weight / (SELECT sum(weight) FROM held)) / adj_close AS q, adj_close AS p0 FROM held JOIN panel USING (ticker) WHERE date = (SELECT a FROM ends)),
    one AS (SELECT 900000 / p.adj_close AS q, p.adj_close AS p0, p.date AS d0, (SELECT max(date) FROM panel WHERE ticker = 'Brand#11') AS d1 FROM panel p WHERE ticker = 'Brand#11' AND date = (SELECT min(date) FROM panel WHERE ticker = 'Brand#11')),
    buys AS (SELECT ticker, CASE WHEN q <= 1 THEN floor(1000000 * q / p0) ELSE q END AS q, p0, row_number() OVER (ORDER BY ticker) AS i FROM w),
    filled(i, ticker, q, cash) AS (
        SELECT 0::BIGINT, NULL::VARCHAR, 0.0::DOUBLE, 1000000.0::DOUBLE UNION ALL
        SELECT b.i, b.ticker, CASE WHEN f.cash >= b.p0 * b.q THEN b.q END, CASE WHEN f.cash >= b.p0 * b.q THEN f.cash - b.p0 * b.q ELSE f.cash END FROM filled f JOIN buys b ON b.i = f.i + 1),
    va AS (SELECT c.date, CASE WHEN count(f.ticker) = count(p.adj_close) THEN (SELECT cash FROM filled ORDER BY i DESC LIMIT 1) + sum(coalesce(f.q, 0) * p.adj_close) END AS v
           FROM c JOIN (SELECT * FROM filled WHERE i > 0) f ON f.q IS NOT NULL OR c.date = (SELECT z FROM ends) LEFT JOIN panel p ON p.ticker = f.ticker AND p.date = c.date GROUP BY 1),
    vb AS (SELECT c.date, 1000000 - o.q * o.p0 + o.q * p.adj_close AS v FROM c CROSS JOIN one o LEFT JOIN panel p ON p.ticker = 'Brand#11' AND p.date = c.date WHERE c.date >= o.d0),
    ra AS (SELECT date, f / lag(f) OVER (ORDER BY date) - 1 AS r FROM (SELECT date, last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS f FROM va)),
    rb AS (SELECT date, f / lag(f) OVER (ORDER BY date) - 1 AS r FROM (SELECT date, last_value(v IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS f FROM vb)),
    b AS (SELECT ra.r AS a, rb.r AS b FROM ra JOIN rb USING (date) WHERE ra.r IS NOT NULL AND rb.r IS NOT NULL)
"""
oracle("strategy_compare", "panel held", "n_days std_a:f std_b:f std_diff:f final_a:f final_b:f spearman:f", TWO_STRATEGIES + f"""
    SELECT count(*) AS n_days, stddev_samp(a) AS std_a, stddev_samp(b) AS std_b, stddev_samp(a - b) AS std_diff, product(1 + a) - 1 AS final_a, product(1 + b) - 1 AS final_b, {RANKS.format("a", "b", "b")} AS spearman FROM b""")
oracle("strategy_curves", "panel held", "date:d growth_a:f growth_b:f diff:f", TWO_STRATEGIES.replace("b AS (SELECT ra.r", "b AS (SELECT date, ra.r") + """
    SELECT date, product(1 + a) OVER w AS growth_a, product(1 + b) OVER w AS growth_b, a - b AS diff FROM b WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
oracle("price_differences", "va vb", "ticker date:d diff:f pct:f", "SELECT ticker, date, price_a - price_b AS diff, (price_a - price_b) / price_b * 100 AS pct FROM va JOIN vb USING (ticker, date)")
oracle("workbook_header_detect", "held", "rid ticker weight:f", """SELECT 3 + row_number() OVER (ORDER BY k) AS rid, ticker, weight / 100 AS weight FROM (
    SELECT ticker AS k, ticker, round(weight, 4) AS weight FROM held UNION ALL SELECT 'Brand#19x', NULL, 1.0)""")
oracle("workbook_plain", "", "tic n:f size:f", "SELECT p_brand AS tic, count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS size FROM part GROUP BY 1")
oracle("vendor_from_file", "", f"{PX} volume:f", f"""SELECT 'ALL' AS ticker, l_shipdate::DATE AS date, max(l_extendedprice)::DOUBLE * max(l_discount)::DOUBLE AS adj_close, sum(l_quantity::{MONEY})::DOUBLE AS volume
    FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 2""")
HALF_OPEN = "date >= DATE '1996-01-01' AND date < DATE '1997-12-31'"
oracle("vendor_connector", "panel", f"{PX} volume:f", f"SELECT * FROM panel WHERE {HALF_OPEN}")
oracle("vendor_by_ticker", "panel", f"{PX} volume:f", f"SELECT * FROM panel WHERE {HALF_OPEN}")
oracle("vendor_pushdown", "daily", "ticker n high:f volume:f", """SELECT ticker, count(*) AS n, max(adj_close) AS high, sum(volume) AS volume FROM daily
    WHERE date BETWEEN DATE '1996-04-01' AND DATE '1997-06-30' AND starts_with(ticker, 'Brand#1') GROUP BY 1""")
oracle("benchmark_backfill", "panel market", PX, """SELECT ticker, date, adj_close FROM panel UNION ALL
    SELECT 'SPY', date, adj_close FROM market WHERE date >= (SELECT min(date) FROM panel) AND date < (SELECT max(date) FROM panel)""")
oracle("universe_by_header", "", "ticker", "SELECT DISTINCT replace(p_brand, '#', ' & ') AS ticker FROM part UNION SELECT 'SPY'")
oracle("html_spans", "", "brand rid cells", """WITH sizes AS (SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT brand, 1 AS rid, 'Brand|Parts|Parts' AS cells FROM sizes GROUP BY 1 UNION ALL SELECT brand, 2, 'Brand|Size|N' FROM sizes GROUP BY 1
    UNION ALL SELECT brand, 2 + row_number() OVER (PARTITION BY brand ORDER BY size), '<' || brand || '>|' || size || '|' || n FROM sizes""")
oracle("ingest_prices", "panel", f"{PX} volume:f vwap:f", f"""SELECT * REPLACE (replace(ticker, '#', ' & ') AS ticker), sum(adj_close * volume) {OVER} UNBOUNDED PRECEDING) / sum(volume) {OVER} UNBOUNDED PRECEDING) AS vwap
    FROM (SELECT * FROM panel WHERE {RANGE})""")
oracle("cache_roundtrip", "panel", PX, "SELECT * FROM panel")
oracle("profile_keys", "panel", "column_name present data_type n_values n_null", """SELECT 'ticker' AS column_name, true AS present, 'string' AS data_type, count(DISTINCT ticker) AS n_values, count(*) - count(ticker) AS n_null FROM panel
    UNION ALL SELECT 'date', true, 'date', count(DISTINCT date), count(*) - count(date) FROM panel UNION ALL SELECT 'volume', true, 'double', count(DISTINCT volume), count(*) - count(volume) FROM panel
    UNION ALL SELECT 'cusip', false, NULL, NULL, NULL""")
oracle("cache_snapshots", "panel", "ticker n_before before:f n_after after:f", """SELECT ticker, count(*) AS n_before, sum(volume) AS before, nullif(count(*) FILTER (WHERE volume > 100), 0) AS n_after,
    sum(2 * volume) FILTER (WHERE volume > 100) AS after FROM panel GROUP BY 1""")
oracle("any_missing", "sparse", "ticker adj_close", "SELECT ticker, bool_or(adj_close IS NULL) AS adj_close FROM sparse GROUP BY 1")
oracle("drop_empty_dates", "panel", PX, """WITH grid AS (
    SELECT t.ticker, c.date, CASE WHEN t.ticker NOT IN ('Brand#3', 'Brand#11') AND month(c.date) % 2 = 0 THEN adj_close END AS adj_close
    FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = c.date)
    SELECT * FROM grid WHERE date IN (SELECT date FROM grid GROUP BY date HAVING count(adj_close) > 0)""")
oracle("template_strategy", "panel ordinals", ORDERS, """SELECT 'template' AS portfolio_id, ordinal * 100000 + (date - DATE '1970-01-01') AS seq, date, 'BUY' AS side, ticker, 10.0::DOUBLE AS quantity, 'shares' AS sizing
    FROM (SELECT ticker, min(date) AS date FROM panel GROUP BY 1) JOIN ordinals USING (ticker)""")
oracle("template_engine", "panel", "portfolio_id date:d portfolio_value:f", """SELECT 'template' AS portfolio_id, date, 1000000 - sum(spent) OVER (ORDER BY date) AS portfolio_value FROM (
    SELECT date, sum(adj_close) AS spent FROM panel p WHERE date = (SELECT min(date) FROM panel q WHERE q.ticker = p.ticker) GROUP BY 1)""")
oracle("template_fills", "panel ordinals", "portfolio_id ticker date:d quantity:f", """WITH RECURSIVE firsts AS (SELECT ticker, min(date) AS date FROM panel GROUP BY 1),
    listed AS (SELECT ticker, date, adj_close AS price, row_number() OVER (ORDER BY date, ordinal) AS i FROM firsts JOIN panel USING (ticker, date) JOIN ordinals USING (ticker)),
    run(i, ticker, date, cash, filled) AS (
        SELECT 0::BIGINT, NULL::VARCHAR, NULL::DATE, 100000.0::DOUBLE, false UNION ALL
        SELECT l.i, l.ticker, l.date, CASE WHEN r.cash >= l.price * 3 THEN r.cash - l.price * 3 ELSE r.cash END, r.cash >= l.price * 3 FROM run r JOIN listed l ON l.i = r.i + 1)
    SELECT 'template' AS portfolio_id, ticker, date, 3.0::DOUBLE AS quantity FROM run WHERE filled""")
oracle("metrics_display", "returns_reversion values_reversion", "portfolio_id cumulative_return volatility", """SELECT portfolio_id, printf('%.4f%%', (product(1 + r) - 1) * 100) AS cumulative_return, printf('%.2f', stddev_samp(r) * sqrt(252.0)) AS volatility
    FROM returns_reversion GROUP BY 1""")
oracle("verify_record", "checked idx market", "max_diff:f mean_diff:f within_threshold pearson:f n_days spearman:f fund_missing index_missing worst_days error", f"""SELECT max(diff) AS max_diff, avg(diff) AS mean_diff,
    coalesce(bool_and(diff <= 0.01), true) AS within_threshold, corr(fr, ir) AS pearson, count(*) AS n_days, {RANKS.format("fr", "ir", "checked")} AS spearman, (SELECT count(*) - count(adj_close) FROM market) AS fund_missing,
    (SELECT count(*) - count(index_value) FROM idx) AS index_missing,
    (SELECT string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY diff DESC, date) FROM (SELECT * FROM checked ORDER BY diff DESC, date LIMIT 5)) AS worst_days, NULL::VARCHAR AS error FROM checked""")
oracle("verify_nothing", "checked", "error within_threshold max_diff mean_diff spearman:f worst_days", f"""SELECT * FROM (VALUES ('empty data', false, 'Infinity', 'Infinity', 0.0::DOUBLE, ''), ('no common dates', false, 'Infinity', 'Infinity', 0.0::DOUBLE, ''))
    v(error, within_threshold, max_diff, mean_diff, spearman, worst_days)
    UNION ALL SELECT NULL, coalesce(bool_and(diff <= 0.0001), true), printf('%.4f', max(diff)), printf('%.4f', avg(diff)), {RANKS.format("fr", "ir", "checked")},
        (SELECT string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY diff DESC, date) FROM (SELECT * FROM checked ORDER BY diff DESC, date LIMIT 5)) FROM checked""")
oracle("backtest_portfolio", "both_r market_r panel", "portfolio_id date:d cash:f", f"""WITH RECURSIVE listed AS (
        SELECT *, row_number() OVER (ORDER BY seq) AS i FROM (SELECT b.*, p.adj_close AS price FROM ({BAB}) b LEFT JOIN panel p USING (ticker, date)) WHERE date IN (SELECT date FROM panel)),
    run(i, date, cash, held) AS (
        SELECT 0::BIGINT, NULL::DATE, 1000000.0::DOUBLE, MAP {{}}::MAP(VARCHAR, DOUBLE) UNION ALL
        SELECT i, date, CASE WHEN side = 'SELL' OR change <> 0 THEN cash - price * change ELSE cash END, map_concat(held, MAP {{ticker: coalesce(held[ticker], 0) + change}}) FROM (
            SELECT l.i, l.date, l.side, l.ticker, l.price, r.cash, r.held,
                   CASE WHEN l.side = 'SELL' THEN -least(l.quantity, coalesce(r.held[l.ticker], 0)) WHEN r.cash >= l.price * l.quantity THEN l.quantity ELSE 0 END AS change
            FROM run r JOIN listed l ON l.i = r.i + 1))
    SELECT 'bab' AS portfolio_id, c.date, (SELECT arg_max_null(cash, i) FROM run WHERE i = 0 OR run.date <= c.date) AS cash FROM (SELECT DISTINCT date FROM panel) c""")
