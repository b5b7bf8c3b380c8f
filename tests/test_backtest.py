"""Strategies, execution and metrics on literal fixtures, and the traps of their semantics."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators.execution import EquityEngine, events, executable, fold
from tickloom.operators.metrics import ExtendedMetrics
from tickloom.operators.strategies import MeanReversion, SingleHold, WeightedHold, latched
from tickloom.operators.templates import TemplateEngine, TemplateStrategy

DAY0 = datetime.date(2023, 1, 1)


def day(n):
    return DAY0 + datetime.timedelta(days=n)


def panel_of(spark, **series):
    rows = [(t, day(i), p) for t, ps in series.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "ticker string, date date, adj_close double")


def orders_of(spark, *rows):
    full = [("p", i, day(d), side, ticker, float(q), sizing) for i, (d, side, ticker, q, sizing) in enumerate(rows)]
    return spark.createDataFrame(full, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")


def values(result):
    return [r.portfolio_value for r in result.values.orderBy("date").collect()]


def test_mean_reversion_on_a_random_walk(spark):
    rng = random.Random(0)
    price, walk = 100.0, []
    for _ in range(150):
        price += rng.gauss(0, 1)
        walk.append(price)
    got = MeanReversion().orders(panel_of(spark, AAPL=walk)).collect()
    assert len(got) == 51 and min(r.date for r in got) == day(99)
    assert {r.ticker for r in got} == {"AAPL"} and {r.side for r in got} == {"BUY", "SELL"}
    for r in got:
        i = (r.date - DAY0).days
        assert r.side == ("BUY" if walk[i] < sum(walk[i - 99 : i + 1]) / 100 else "SELL")


def test_no_orders_from_one_price(spark):
    assert MeanReversion().orders(panel_of(spark, AAPL=[150.0])).isEmpty()


def test_insufficient_cash_and_sell_of_nothing(spark):
    panel = panel_of(spark, AAPL=[150.0])
    assert values(EquityEngine(5_000).run(orders_of(spark, (0, "BUY", "AAPL", 100, "shares")), panel)) == [5_000]
    sold = EquityEngine(10_000).run(orders_of(spark, (0, "SELL", "AAPL", 50, "shares")), panel)
    assert values(sold) == [10_000]
    assert [(r.ticker, r.quantity) for r in sold.holdings.collect()] == [("AAPL", 0.0)]


def test_one_share_and_the_whole_portfolio_differ(spark):
    panel = panel_of(spark, A=[10.0, 20.0])
    share = EquityEngine(100).run(orders_of(spark, (0, "BUY", "A", 1, "shares")), panel)
    whole = EquityEngine(100).run(orders_of(spark, (0, "BUY", "A", 1, "pct")), panel)
    assert values(share) == [100, 110] and values(whole) == [100, 200]


def test_an_order_without_a_trading_day_holds_up_the_rest(spark):
    panel = panel_of(spark, A=[10.0, 10.0, 10.0]).where(F.col("date") != day(1))
    orders = orders_of(spark, (0, "BUY", "A", 1, "shares"), (1, "BUY", "A", 1, "shares"), (2, "BUY", "A", 1, "shares"))
    assert [r.seq for r in executable(orders, panel).collect()] == [0]
    assert sorted(r.seq for r in executable(orders, panel, "sorted").collect()) == [0, 2]
    back = orders_of(spark, (2, "BUY", "A", 1, "shares"), (0, "BUY", "A", 1, "shares"), (2, "BUY", "A", 1, "shares"))
    assert [r.seq for r in executable(back, panel).collect()] == [0]


def test_the_list_stops_at_its_first_bad_order(spark, monkeypatch):
    from tickloom.operators import execution

    rng = random.Random(8)
    panel = panel_of(spark, A=[1.0] * 30)
    rows, expected = [], set()
    for p in range(12):
        days, stopped = sorted(rng.randrange(30) for _ in range(40)), False
        if p % 3:
            days[rng.randrange(40)] = rng.choice([0, 40, None])
        for i, d in enumerate(days):
            seq = 7 * i
            stopped = stopped or d is None or d >= 30 or (i > 0 and days[i - 1] is not None and d < days[i - 1])
            rows.append((f"p{p}", seq, None if d is None else day(d), "BUY", "A", 1.0, "shares"))
            if not stopped:
                expected.add((f"p{p}", seq))
    orders = spark.createDataFrame(rows, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")
    for stretch in (100_000, 20, 3):
        monkeypatch.setattr(execution, "STRETCH", stretch)
        assert {(r.portfolio_id, r.seq) for r in executable(orders, panel).collect()} == expected


def test_the_fold_reads_few_events(spark):
    """200 portfolios, each of one of 200 tickers, over 30 days."""
    panel = panel_of(spark, **{f"T{i}": [float(d + 1) for d in range(30)] for i in range(200)})
    full = [(f"p{i}", d, day(d), "BUY", f"T{i}", 0.5, "pct" if d < 3 else "shares") for i in range(200) for d in range(10)]
    orders = spark.createDataFrame(full, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")
    settled, left = events(orders, panel, 1000)
    assert left.count() == 200 * (10 + 3) and settled.count() == 0


def test_only_orders_from_the_first_refused_one_reach_python(spark):
    """p1 never lacks cash; p2's fourth order is refused; p3 starts with a fraction; p4 sells more than it has."""
    panel = panel_of(spark, A=[10.0] * 9, B=[None, *[7.0] * 8])
    rows = [("p1", i, day(i), "BUY", "A", 1.0, "shares") for i in range(9)]
    rows += [("p2", i, day(i), "BUY", "A", 3.0, "shares") for i in range(6)]
    rows += [("p3", 0, day(0), "BUY", "A", 0.5, "pct"), ("p3", 1, day(1), "SELL", "A", 2.0, "shares")]
    rows += [("p4", 0, day(0), "BUY", "B", 5.0, "shares"), ("p4", 1, day(1), "BUY", "B", 5.0, "shares"), ("p4", 2, day(1), "SELL", "B", 9.0, "shares"), ("p4", 3, day(2), "BUY", "B", 2.0, "shares"), ("p4", 4, day(2), "SELL", "B", 1.0, "shares")]
    orders = spark.createDataFrame(rows, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")
    settled, left = events(orders, panel, 100)
    assert sorted((r.portfolio_id, r.side) for r in left.where("date IS NULL").collect()) == [("p2", "CASH"), ("p2", "HELD")]
    assert [(r.portfolio_id, r.seq) for r in left.where("side IN ('BUY', 'SELL')").orderBy("portfolio_id", "seq").collect()] == [("p2", 3), ("p2", 4), ("p2", 5), ("p3", 0), ("p3", 1)]
    done = {(r.portfolio_id, r.seq): (r.change, r.cash) for r in settled.collect()}
    assert [done["p4", i] for i in (1, 2, 3, 4)] == [(5, 65), (-5, 100), (2, 86), (-1, 93)] and ("p4", 0) not in done
    ledger = {(r.portfolio_id, r.seq): (r.change, r.cash) for r in fold(orders, panel, 100).collect()}
    assert [ledger["p2", i][1] for i in range(3)] == [70, 40, 10] and ("p2", 3) not in ledger
    assert ledger["p3", 0] == (5, 50) and ledger["p3", 1] == (-2, 70) and ledger["p1", 8] == (1, 10)


def test_windows_and_fold_agree_to_the_last_bit(spark, monkeypatch):
    """Random whole-share lists with and without cash to spare, sales beyond holdings and missing prices."""
    from tickloom.operators import execution

    rng = random.Random(11)
    prices = {t: [rng.choice([None, *[round(rng.uniform(1, 50), 2)] * 6]) for _ in range(25)] for t in "ABC"}
    full = []
    for p in range(20):
        for i, d in enumerate(sorted(rng.randrange(25) for _ in range(60))):
            pct = p % 4 == 3 and rng.random() < 0.1
            full.append((f"p{p}", i, day(d), rng.choice(["BUY", "BUY", "SELL"]), rng.choice("ABC"), 0.25 if pct else float(rng.randrange(0, 9) + (0.5 if p % 5 == 4 and i > 30 else 0)), "pct" if pct else "shares"))
    orders = spark.createDataFrame(full, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")
    panel = panel_of(spark, **prices)
    key = lambda frame: sorted((r.portfolio_id, r.seq, r.ticker, r.change + 0.0, str(r.cash)) for r in frame.collect())
    for cash in (60, 2000):
        both = key(fold(orders, panel, cash))
        plain = execution.unbound
        monkeypatch.setattr(execution, "unbound", lambda rows, initial, plain=plain: plain(rows, initial).withColumn("stops", F.lit(True)))
        assert events(orders, panel, cash)[0].count() == 0
        assert key(fold(orders, panel, cash)) == both
        monkeypatch.setattr(execution, "unbound", plain)


def test_the_template_engine_runs_lists_of_many_tickers_in_order(spark):
    """150 tickers at price 1 on one day and cash for 100 of them: the first 100 of the list are filled."""
    names = [f"T{i:03d}" for i in range(150)]
    panel = panel_of(spark, **{t: [1.0, 2.0] for t in names})
    result = TemplateEngine(100).run(TemplateStrategy(1).orders(panel), panel)
    assert sorted(r.ticker for r in result.holdings.collect()) == names[:100]
    assert [r.portfolio_value for r in result.values.collect()] == [0.0]


def test_null_prices(spark):
    panel = panel_of(spark, A=[10.0, None, 12.0], B=[1.0, 1.0, 1.0])
    buy = orders_of(spark, (0, "BUY", "A", 2, "shares"), (1, "BUY", "A", 1, "shares"))
    assert values(EquityEngine(100).run(buy, panel)) == [100, None, 104]
    assert values(EquityEngine(100, null_price="ffill").run(buy, panel)) == [100, 100, 106]
    sell = orders_of(spark, (0, "BUY", "A", 2, "shares"), (1, "SELL", "A", 1, "shares"))
    assert values(EquityEngine(100).run(sell, panel)) == [100, None, None]


def simulate(rows, prices, cash):
    """A plain run of one portfolio."""
    held, out = {}, []
    for d in range(len(next(iter(prices.values())))):
        opening = cash + sum(n * prices[t][d] for t, n in held.items())
        for when, side, ticker, q, sizing in rows:
            if when != d:
                continue
            p = prices[ticker][d]
            if side == "BUY":
                n = opening * q // p if sizing == "pct" else q
                if cash >= p * n:
                    cash, held[ticker] = cash - p * n, held.get(ticker, 0) + n
            else:
                n = min(int(held.get(ticker, 0) * q) if sizing == "pct" else q, held.get(ticker, 0))
                cash, held[ticker] = cash + p * n, held.get(ticker, 0) - n
        out.append(cash + sum(n * prices[t][d] for t, n in held.items()))
    return out


def test_portfolios_of_several_tickers_equal_a_plain_run(spark):
    rng = random.Random(3)
    prices = {t: [rng.uniform(5, 200) for _ in range(60)] for t in "ABCDE"}
    books = {}
    for p in range(4):
        days = sorted(rng.randrange(60) for _ in range(120))
        books[f"p{p}"] = [(d, rng.choice(["BUY", "SELL"]), rng.choice("ABCDE"), *((round(rng.uniform(0.1, 1), 2), "pct") if rng.random() < 0.5 else (rng.randrange(1, 40), "shares"))) for d in days]
    full = [(p, i, day(d), s, t, float(q), z) for p, rows in books.items() for i, (d, s, t, q, z) in enumerate(rows)]
    orders = spark.createDataFrame(full, "portfolio_id string, seq long, date date, side string, ticker string, quantity double, sizing string")
    result = EquityEngine(10_000).run(orders, panel_of(spark, **prices))
    got = {}
    for r in result.values.orderBy("date").collect():
        got.setdefault(r.portfolio_id, []).append(r.portfolio_value)
    for p, rows in books.items():
        assert got[p] == pytest.approx(simulate(rows, prices, 10_000))
    assert result.cash.agg(F.min("cash")).first()[0] >= 0 and result.holdings.agg(F.min("quantity")).first()[0] >= 0


def test_latch(spark):
    signals = [(True, False), (True, True), (True, True), (False, True), (False, False), (True, False)]
    rows = [("A", day(i), b, s) for i, (b, s) in enumerate(signals)]
    got = latched(spark.createDataFrame(rows, "ticker string, date date, b boolean, s boolean"), F.col("b"), F.col("s"))
    assert [r.in_position for r in got.orderBy("date").collect()] == [1, 0, 1, 0, 0, 1]


def test_fractions_of_a_share_read_as_fractions_of_the_portfolio(spark):
    panel = panel_of(spark, A=[200_000.0, 1.0], B=[10.0, 1.0])
    assert {r.sizing for r in SingleHold("A").orders(panel).collect()} == {"pct"}
    assert {r.sizing for r in SingleHold("A", explicit_sizing=True).orders(panel).collect()} == {"shares"}
    twice = spark.createDataFrame([(1, "B", 1.0), (2, "B", 3.0), (3, "C", 4.0)], "rid int, ticker string, weight double")
    got = WeightedHold(twice).orders(panel).where("side = 'BUY'").collect()
    assert [r.quantity for r in got] == [100_000 / 8 / 10] * 2


def test_the_legs_of_long_lists_stay_apart(spark):
    """Over 100,000 holdings: every BUY still stands before every SELL, and no place is taken twice."""
    names = spark.range(100_005).select(F.format_string("T%06d", "id").alias("ticker"))
    panel = names.withColumn("date", F.explode(F.array(F.lit(day(0)), F.lit(day(1))))).withColumn("adj_close", F.lit(0.5))
    orders = WeightedHold(names.withColumn("weight", F.lit(1.0)), cash=1e9).orders(panel)
    got = orders.agg(F.max(F.when(F.col("side") == "BUY", F.col("seq"))).alias("buy"), F.min(F.when(F.col("side") == "SELL", F.col("seq"))).alias("sell"), F.count_distinct("seq").alias("n")).first()
    assert got.buy < got.sell and got.n == 2 * 100_005


def test_orders_snap_to_the_next_day_with_trade(spark):
    panel = panel_of(spark, A=[10.0, 20.0, 30.0, 40.0]).where(F.col("date") != day(1))
    orders = orders_of(spark, (1, "BUY", "A", 1, "shares"), (0, "BUY", "A", 2, "shares"), (9, "BUY", "A", 1, "shares"))
    assert values(EquityEngine(100, "sorted").run(orders, panel)) == [100, 140, 160]
    assert values(EquityEngine(100, "snap").run(orders, panel)) == [100, 140, 170]


def test_metrics(spark):
    panel = panel_of(spark, A=[10.0, 20.0, 10.0, 15.0])
    result = EquityEngine(100).run(orders_of(spark, (0, "BUY", "A", 10, "shares"), (2, "SELL", "A", 5, "shares")), panel)
    assert values(result) == [100, 200, 100, 125]
    got = ExtendedMetrics().compute(result, panel).first()
    assert got.cumulative_return == pytest.approx(0.25) and got.max_drawdown == pytest.approx(-0.5)
    assert got.daily_return == pytest.approx((1 - 0.5 + 0.25) / 3)
    assert got.average_turnover == pytest.approx((0 + 50 / 200 + 0) / 3) and got.daily_turnover == pytest.approx(252 * 50 / 200 / 3)
    assert ExtendedMetrics().compute(result).first().average_turnover is None
