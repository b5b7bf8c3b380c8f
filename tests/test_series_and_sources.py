import datetime
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scans, series, stats
from tickloom.operators import align, quality
from tickloom.sources import files, html, prices, workbooks

DAY0 = datetime.date(2023, 1, 1)


def day(n):
    return DAY0 + datetime.timedelta(days=n)


def panel_of(spark, **values):
    return spark.createDataFrame([(t, day(i), p) for t, ps in values.items() for i, p in enumerate(ps)], "ticker string, date date, adj_close double")


def column(df, name):
    return [r[0] for r in df.orderBy("ticker", "date").select(name).collect()]


def test_gaps(spark):
    panel, w = panel_of(spark, A=[10.0, None, 12.0, None]), series.by_date()
    assert column(series.padded_returns(panel, "adj_close", "r", "ticker"), "r") == pytest.approx([None, 0, 0.2, 0])
    assert column(panel.withColumn("s", series.running(F.sum, F.col("adj_close"), w)), "s") == [10, None, 22, None]
    assert column(panel.withColumn("m", series.rolling(F.avg, F.col("adj_close"), w, 2)), "m") == [None] * 4
    assert column(panel.withColumn("f", F.coalesce(series.ffill(F.col("adj_close"), w), series.bfill(F.col("adj_close"), w))), "f") == [10, 10, 12, 12]


def test_month_ends(spark):
    row = spark.range(1).select(series.month_ends(F.lit("2023-01-31").cast("date"), F.lit("2023-03-30").cast("date")).alias("d")).first()
    assert row.d == [datetime.date(2023, 1, 31), datetime.date(2023, 2, 28)]


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 2.0, 5.0), (3.0, 9.0, 5.0), (None, 1.0, 5.0)], "x double, y double, c double")
    assert df.agg(stats.pearson(F.col("x"), F.col("c"))).first()[0] is None
    assert stats.spearman(df, "x", "y").first().spearman == pytest.approx(0.8660254)
    assert df.limit(0).agg(stats.all_true(F.col("x") > 0), stats.any_true(F.col("x") > 0)).first()[:] == (True, False)
    assert df.agg(stats.mean_or_null(F.col("x")), stats.mean_or_null(F.col("y"))).first()[:] == (None, 3.5)


def test_alignment(spark):
    rows = [("A", day(0), 1.0), ("A", day(1), 2.0), ("B", day(1), 3.0), ("B", day(2), 4.0)]
    panel = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    first = align.align_to_first(panel, ["X", "A", "B"]).orderBy("ticker", "date").collect()
    assert [(r.ticker, r.adj_close) for r in first] == [("A", 1), ("A", 2), ("B", None), ("B", 3)]
    assert align.dense_grid(panel).count() == 6
    with pytest.raises(Exception, match="duplicate"):
        align.pivoted(panel.union(panel), ["A"]).collect()
    asked = spark.createDataFrame([("A", day(5), 1), ("A", day(1), 2), ("B", day(0), 3), ("C", day(9), 4)], "ticker string, date date, k int")
    got = {r.k: (r.as_of_date, r.adj_close) for r in align.as_of(asked, panel, ["ticker"], ["adj_close"]).collect()}
    assert got == {1: (day(1), 2.0), 2: (day(1), 2.0), 3: (None, None), 4: (None, None)}


def test_as_of_both_ways_equals_a_loop(spark):
    rng = random.Random(7)
    hot = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    right = [(hot(), rng.randrange(400), i) for i in range(600)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values()) + [("hot", None, -1)]
    left = [(hot(), rng.choice([None, *[rng.randrange(-20, 420)] * 9]), i) for i in range(500)]
    l_rows, r_rows = spark.createDataFrame(left, "k string, t long, row int").repartition(5), spark.createDataFrame(right, "k string, t long, v int").repartition(3)
    for direction, pick in (("backward", lambda ts, t: max((u for u in ts if u <= t), default=None)), ("forward", lambda ts, t: min((u for u in ts if u >= t), default=None))):
        out = align.as_of(l_rows, r_rows, ["k"], ["v"], "t", direction)
        assert out.columns == ["k", "t", "row", "as_of_t", "v"]
        got = {r.row: (r.as_of_t, r.v) for r in out.collect()}
        of = {}
        for k, t, v in right:
            if t is not None:
                of.setdefault(k, {})[t] = v
        for k, t, row in left:
            at = pick(of.get(k, {}), t) if t is not None else None
            assert got[row] == (at, of[k][at] if at is not None else None), (k, t, row)
    with pytest.raises(ValueError, match="direction"):
        align.as_of(l_rows, r_rows, ["k"], ["v"], "t", "nearest")


def test_a_hot_key_is_spread_over_tasks(spark):
    """One key with all rows: no window or sort of the plan has more than a small part of them in one group."""
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    groups = scans.with_range(rows, "t").groupBy("k", "range").count()
    assert groups.count() == scans.RANGES and groups.agg(F.max("count")).first()[0] < 4000 / scans.RANGES * 1.5


def test_snapped_orders(spark):
    from tickloom.operators.execution import executable

    calendar = spark.createDataFrame([(day(i),) for i in (0, 3, 4)], "date date")
    orders = spark.createDataFrame([("p", i, day(d)) for i, d in enumerate((0, 1, 3, 4, 5))] + [("p", 9, None)], "portfolio_id string, seq long, date date")
    assert sorted((r.seq, r.date) for r in executable(orders, calendar, "snap").collect()) == [(0, day(0)), (1, day(3)), (2, day(3)), (3, day(4))]


def test_weighted_index_edges(spark):
    panel = panel_of(spark, A=[None, 2.0, 3.0], B=[0.0, 5.0, 6.0])
    weights = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 9.0)], "ticker string, weight double")
    index = quality.weighted_index(panel, weights).orderBy("date").collect()
    assert [r.index_value for r in index] == [0.5, 0.5, 0.75]
    assert {r.index_value for r in quality.weighted_index(panel, weights.where("ticker = 'C'")).collect()} == {0.0}


def test_names_and_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["(a) Alpha", "(b) Beta (x) y", "plain"])
    renamed, names = files.short_names(df)
    assert renamed.columns == ["a", "b", "plain"] and names == {"a": "Alpha", "b": "Beta (x"}
    assert files.short_names(renamed)[0].columns == renamed.columns
    sheet = [["Fund", None], ["Ticker", "Weight"], ["A", "5.0"], [None, "1"], [" B ", "x"], [None, None], ["", None]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(sheet)], "rid long, cells array<string>")
    got = files.table_below_header(rows).orderBy("rid").collect()
    assert [(r.ticker, r.weight) for r in got] == [("A", 0.05), (None, 0.01), ("B", None)]


def test_vendor_columns_and_prices(spark):
    rows = spark.createDataFrame([("A", "2023-01-01", 10.0, 0.5, 7.0, 3.0)], "tic string, datadate string, prccd double, ajexdi double, trfd double, cshtrd double")
    assert prices.VendorPrices(rows).read(["A"], "2023-01-01", "2023-01-01").first().adj_close == 5.0
    assert prices.VendorPrices(rows, use_trfd=True).with_volume(["A"], "2023-01-01", "2023-01-02").first().adj_close == 7.0
    with pytest.raises(ValueError, match="trfd"):
        prices.VendorPrices(rows.drop("trfd"), use_trfd=True)
    with pytest.raises(TypeError):
        files.read_by_suffix(spark, "/tmp/x.ods")


def test_workbooks(spark, tmp_path):
    assert [workbooks.column_index(x) for x in ("A1", "Z9", "AB7")] == [0, 25, 27]
    rows = [["Fund", None], [], ["Ticker", "Weight <%>"], ["A", 5.5], [None, 1], ["B & C", "x"]]
    (tmp_path / "a.xlsx").write_bytes(workbooks.sheet_bytes(rows))
    got = workbooks.read_workbooks(spark, str(tmp_path / "a.xlsx")).orderBy("rid").collect()
    assert [(r.rid, r.cells) for r in got] == [(1, ["Fund", None]), (2, []), (3, ["Ticker", "Weight <%>"]), (4, ["A", "5.5"]), (5, [None, "1"]), (6, ["B & C", "x"])]
    held = files.holdings_sheet(spark, str(tmp_path / "a.xlsx"), value="Weight <%>").orderBy("rid").collect()
    assert [(r.ticker, r.weight) for r in held] == [("A", 0.055), (None, 0.01), ("B & C", None)]
    plain = [["tic", "datadate", "prccd", "ajexdi", "cshtrd"], ["A", 44927, 10, 0.5, 3], [" A", "2023-01-02", 8, 0.5, None]]
    (tmp_path / "b.xlsx").write_bytes(workbooks.sheet_bytes(plain))
    panel = prices.VendorPrices.open(spark, str(tmp_path / "b.xlsx")).with_volume(["A"], "2023-01-01", "2023-01-02").orderBy("date").collect()
    assert [(r.date, r.adj_close, r.volume) for r in panel] == [(day(0), 5.0, 3.0), (day(1), 4.0, None)]


def test_shared_strings_and_cell_references(spark):
    import io
    import zipfile

    raw, out = zipfile.ZipFile(io.BytesIO(workbooks.sheet_bytes([]))), io.BytesIO()
    main = workbooks.MAIN[1:-1]
    with zipfile.ZipFile(out, "w") as book:
        for name in raw.namelist():
            if "sheet1" not in name:
                book.writestr(name, raw.read(name))
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c><c r="E3" t="str"><v>f</v></c></row></sheetData></worksheet>')
    assert list(workbooks.parsed(out.getvalue())) == [(3, [None, "two", None, "one", "f"])]


def test_holdings_without_a_header(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbooks.sheet_bytes([["x"]]))
    for path in ("a.xlsx", "absent.xlsx"):
        assert files.holdings_sheet(spark, str(tmp_path / path), on_error="empty").count() == 0
        with pytest.raises(Exception, match="Ticker|absent"):
            files.holdings_sheet(spark, str(tmp_path / path))


def test_vendor_connector_and_backfill(spark, tmp_path):
    rows = [("A", day(i), float(i), 1.0) for i in range(5)] + [("SPY", day(i), 100.0 + i, 2.0) for i in range(9)]
    spark.createDataFrame(rows, "ticker string, date date, adj_close double, volume double").write.parquet(str(tmp_path / "v"))
    source = prices.NetworkPrices(spark, path=str(tmp_path / "v"))
    got = source.read(["A", "A", "B"], "2023-01-02", "2023-01-04").orderBy("date").collect()
    assert [(r.ticker, r.date, r.adj_close) for r in got] == [("A", day(1), 1.0), ("A", day(2), 2.0)]
    panel = prices.with_benchmark(panel_of(spark, A=[1.0, 2.0, 3.0]), source)
    assert panel.where("ticker = 'SPY'").count() == 2 and prices.with_benchmark(panel, source).count() == panel.count()
    with pytest.raises(Exception, match="options are missing"):
        spark.read.format("ticker_prices").load().collect()


def test_table_column(spark):
    page = """<table><tr><td>Symbol x</td></tr></table><TABLE id=1><tr><th>Name</th><th> Symbol
      </th></tr><tr><td>a</td><td><a href="q">BRK.B</a></td></tr><tr><td>only</td></tr></TABLE>"""
    pages = spark.createDataFrame([(page,), ("",), (None,)], "html string")
    assert sorted(r.ticker for r in files.universe(pages, column="Symbol").collect()) == ["BRK-B", "SPY"]


def test_html_grids():
    read = html.parsed_tables
    assert read(None) == read("") == read("<p>Symbol</p>") == []
    assert read("<table><tr><td>a &amp; b&#33;<td>1<tr><th>c\n d") == [[["a & b!", "1"], ["c d"]]]
    nested = "<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>"
    assert read(nested) == [[["xy", "z"]], [["in"]]]
    spans = "<table><tr><td rowspan=2>A<td colspan='2'>B<td rowspan=3>C<tr><td>d<td>e<tr><td>f</table>"
    assert read(spans) == [[["A", "B", "B", "C"], ["A", "d", "e", "C"], ["f", "", "", "C"]]]
    assert read("<table><tr><td colspan=99999999999>a<td colspan=x>b<td colspan=0>c</table>") == [[["a", "b", "c"]]]
    assert len(read("<table><tr><td colspan=5000>a")[0][0]) == 1000
    assert read("<table><tr><td>a<br>b<script>no</script><style>no</style></td></tr></table></table><td>c") == [[["a b"]]]
    assert read("<TABLE><TBODY><td>no row<tr></tr></TBODY></TABLE>") == [[["no row"], []]]


def test_html_tables_keep_their_pages_columns(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a<tr><td>b</table><table><tr><td>c</table>", "u"), (2, None, "v"), (3, "none", None)], "id int, html string, cells2 string")
    got = html.html_tables(pages)
    assert got.columns == ["id", "cells2", "table", "rid", "cells"]
    assert sorted((r.id, r.table, r.rid, r.cells) for r in got.collect()) == [(1, 0, 1, ["a"]), (1, 0, 2, ["b"]), (1, 1, 1, ["c"])]


def test_bucketed_tables_are_joined_and_scanned_without_a_shuffle(spark):
    from uuid import uuid4

    names = [f"t_{uuid4().hex}" for _ in range(2)]
    rows = spark.createDataFrame([(f"T{i % 20}", day(i // 20), float(i)) for i in range(400)], "ticker string, date date, adj_close double")
    for name in names:
        prices.write_bucketed(rows, name, 4, files.shared_folder(spark))
    a, b = (prices.BucketedPrices(spark, n).read([f"T{i}" for i in range(20)], "2023-01-01", "2023-12-31") for n in names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.join(b.withColumnRenamed("adj_close", "other"), ["ticker", "date"]).withColumn("r", series.returns(F.col("adj_close"), series.by_date()))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 400 and both.where("r IS NULL").count() == 20 + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_that_do_not_read_as_their_type(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,DATE,RET\n1,2024-01-02,0.5\n2,2024-01-03,C\n3,,\n4,x,B\n5,2024-01-05\n6,2024-01-06,1e-3,7\n7,2024-01-07, 2 \n")
    path, schema = str(tmp_path), "ID int, DATE date, RET double"
    rows, rejected = files.read_csv_checked(spark, path, schema)
    assert rows.dtypes == [("ID", "int"), ("DATE", "date"), ("RET", "double")]
    assert [(r.ID, r.RET) for r in rows.orderBy("ID").collect()] == [(1, 0.5), (3, None), (7, 2.0)]
    assert [(r.ID, r.RET, r.bad_columns, r.record) for r in rejected.orderBy("ID").collect()] == [
        ("2", "C", ["RET"], None), ("4", "B", ["DATE", "RET"], None), ("5", None, [], "5,2024-01-05"), ("6", "1e-3", [], "6,2024-01-06,1e-3,7"),
    ]
    assert rows.count() + rejected.count() == 7
    assert files.read_csv(spark, path, schema, on_bad="null").where("RET IS NULL").count() == 4
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.read_csv(spark, path, schema).collect()
    with pytest.raises(ValueError, match="on_bad"):
        files.read_csv(spark, path, schema, on_bad="skip")


def test_returns_with_codes(spark):
    rows = spark.createDataFrame([("A", "2024-01-02", 20.0, 4.0, "C"), ("A", "2024-01-03", 30.0, 4.0, " 0.5"), ("A", "2024-01-04", 8.0, 0.0, None)], "TICKER string, DATE string, PRC double, CFACPR double, RET string")
    source, span = prices.CrspPrices(rows), (["A"], "2024-01-01", "2024-12-31")
    assert [r.adj_close for r in source.read(*span).orderBy("date").collect()] == [5.0, 7.5, None]
    assert [(r.ret, r.code) for r in source.returns(*span, lenient=True).orderBy("date").collect()] == [(None, "C"), (0.5, None), (None, None)]
    with pytest.raises(Exception, match="not a number: C"):
        source.returns(*span).collect()
    assert [r.ret for r in source.returns(["A"], "2024-01-03", "2024-12-31").orderBy("date").collect()] == [0.5, None]
    with pytest.raises(ValueError, match="CFACPR"):
        prices.CrspPrices(rows.drop("CFACPR"))


def test_a_cache_keeps_what_readers_began_with(spark):
    cache = prices.TableCache(spark, files.shared_folder(spark))
    cache.set("a", spark.range(3))
    first = cache.get("a")
    cache.set("a", spark.range(3, 10))
    assert first.count() == 3 and cache.get("a").count() == 7
    with pytest.raises(Exception, match="boom"):
        cache.set("a", spark.range(5).select(F.raise_error(F.lit("boom")).cast("int").alias("id")))
    assert cache.get("a").count() == 7 and first.count() == 3
    cache.set("a", cache.get("a").where("id > 5"))  # reads the version that it replaces
    assert cache.get("a").count() == 4
    assert cache.sweep("a", 3600) == 0 and cache.sweep("a") >= 2
    assert cache.get("a").count() == 4
    with pytest.raises(Exception, match="not exist|FileNotFound|FILE_NOT_EXIST|does not exist"):
        first.collect()


def test_table_cache(spark):
    cache = prices.TableCache(spark, files.shared_folder(spark))
    assert cache.get("a") is None
    cache.set("a", spark.range(3))
    assert cache.get("a").count() == 3
    panel = spark.createDataFrame([("A", day(0), float("nan"))], "ticker string, date date, adj_close double")
    path = files.shared_folder(spark)
    prices.write_prices(panel, path)
    assert prices.TablePrices(spark, path).read(["A"], "2023-01-01", "2023-01-01").first().adj_close is None
