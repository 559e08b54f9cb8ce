"""Order-dependent plans against pandas, with many small buckets and skewed groups."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscan.functions import apply_function
from ledgerscan.operators import aggregate, joins, profile
from ledgerscan.plans import keyed, ordered, tables
from ledgerscan.plans.ordered import OrderedRows, quantiles


@pytest.fixture(autouse=True)
def many_buckets(monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 13)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 400
    group = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 30, n).astype(str))
    x = np.round(rng.normal(0, 10, n), 0)
    x[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"g": group, "ord": rng.permutation(n), "x": x})


@pytest.fixture(scope="module")
def df(spark, pdf):
    values = [(r.g, int(r.ord), None if np.isnan(r.x) else float(r.x)) for r in pdf.itertuples()]
    return spark.createDataFrame(values, "g string, ord int, x double")


def by_order(df, column):
    return df.select("ord", column).toPandas().set_index("ord")[column].sort_index().astype(float)


def same(got, expected):
    np.testing.assert_allclose(got.to_numpy(), expected.to_numpy(dtype=float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("partitioned", [False, True])
@pytest.mark.parametrize("fn,args", [
    ("pd_diff", {"periods": 1}), ("pd_diff", {"periods": 7}), ("pd_diff", {"periods": -2}),
    ("pd_rolling_mean", {"window": 6}), ("pd_pct_change", {"periods": 2}), ("cumsum", {}),
    ("pd_rank", {}), ("excel_rank_eq", {}), ("excel_rank_eq", {"ascending": "true"}),
])
def test_ordered_functions(df, pdf, partitioned, fn, args):
    part = ["g"] if partitioned else []
    got = by_order(apply_function(df, fn, "x", "r", order_by=["ord"], partition_by=part, **args), "r")
    p = pdf.sort_values("ord").set_index("ord")
    groups = p.groupby("g")["x"] if partitioned else None

    def each(f):
        return groups.transform(f) if partitioned else f(p["x"])

    if fn == "pd_diff":
        expected = each(lambda s: s.diff(args["periods"]))
    elif fn == "pd_rolling_mean":
        expected = each(lambda s: s.rolling(args["window"], min_periods=1).mean())
    elif fn == "pd_pct_change":
        change = each(lambda s: s.ffill() / s.ffill().shift(args["periods"]) - 1)
        expected = change.replace([np.inf, -np.inf], np.nan)
    elif fn == "cumsum":
        expected = each(lambda s: s.fillna(0).cumsum())
    elif fn == "pd_rank":
        expected = each(lambda s: s.rank(method="dense"))
    else:
        expected = each(lambda s: s.rank(method="min", ascending=args.get("ascending") == "true"))
    same(got, expected.sort_index())


def test_halo_reaches_over_several_buckets(spark):
    """More buckets than rows per group: neighbours lie several buckets away."""
    df = spark.range(40).select(F.col("id").alias("ord"), (F.col("id") * 2.0).alias("x"))
    ordered = OrderedRows(df, ["ord"], buckets=30)
    assert ordered.rows.select("__bucket").distinct().count() > 15
    positions = {r["ord"]: r["__position"] for r in ordered.with_position().collect()}
    assert positions == {i: i + 1 for i in range(40)}
    halo = ordered.with_halo(ordered.rows, 5)
    lagged = halo.withColumn("l", F.lag("x", 5).over(ordered.window())).filter("not __halo")
    assert {r["ord"]: r["l"] for r in lagged.collect()} == {i: (i - 5) * 2.0 if i >= 5 else None for i in range(40)}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_both_ways(df, pdf, keys):
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    built_in = quantiles(df, keys, ["x", "ord"], points).toPandas()
    spread = quantiles(df, keys, ["x", "ord"], points, small_group_rows=0).toPandas()
    for frame in (built_in, spread):
        if keys:
            frame.set_index("g", inplace=True)
            frame.sort_index(inplace=True)
    pd.testing.assert_frame_equal(built_in, spread[built_in.columns], check_exact=True)
    expected = (pdf.groupby("g")["x"] if keys else pdf["x"]).quantile(0.25)
    np.testing.assert_allclose(np.ravel(spread["x__q1"]), np.ravel(expected))


def test_quantiles_of_an_empty_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    out = {r.g: r["x__q0"] for r in quantiles(df, ["g"], ["x"], [0.5], small_group_rows=0).collect()}
    assert out == {"a": 2.0, "b": None}


def test_group_by_matches_pandas(df, pdf):
    specs = [("x", a, a) for a in ("sum", "mean", "median", "min", "max", "std", "var", "p25", "p75", "count")]
    got = aggregate.group_by(df, ["g"], specs).toPandas().set_index("g").sort_index()
    x = pdf.groupby("g")["x"]
    same(got["sum"], x.sum())
    same(got["std"], x.std(ddof=0))
    same(got["p75"], x.quantile(0.75))
    same(got["count"], x.count())


def test_first_and_last_skip_missing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "p"), ("a", 3, "q"), ("a", 4, None)], "g string, ord int, v string")
    out = aggregate.group_by(df, ["g"], [("v", "first", "f"), ("v", "last", "l")], order_by=["ord"]).first()
    assert (out.f, out.l) == ("p", "q")


def test_profile_matches_pandas(df, pdf):
    out = profile.numeric_profile(df, ["x", "ord"]).toPandas().set_index("column")
    x = pdf["x"].dropna()
    row = out.loc["x"]
    assert row["mode"] == x.mode().iloc[0]
    assert row["median"] == x.median() and row["q1"] == x.quantile(0.25)
    z = (x - x.mean()) / x.std(ddof=0)
    assert row["skewness"] == pytest.approx((z**3).mean()) and row["kurtosis"] == pytest.approx((z**4).mean() - 3)
    spread = profile.numeric_profile(df, ["x", "ord"], small_values=0).toPandas().set_index("column")
    pd.testing.assert_frame_equal(out.sort_index(), spread.sort_index(), check_exact=True)
    bins = profile.histogram(df, ["x"]).orderBy("bin").toPandas()["rows"].tolist()
    assert bins == np.histogram(x, bins=min(20, max(5, int(np.sqrt(len(x))))))[0].tolist()


def test_profile_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([("nan", 5.0), ("", 5.0), (None, 5.0)], "t string, x double")
    text = {r.column: r for r in profile.text_profile(df).collect()}
    assert (text["t"].null_count, text["t"]["distinct"], text["t"].entropy) == (3, 0, 0.0)
    assert text["x"].top_values == "5.0=3" and text["x"].missing_pct == 0.0
    number = profile.numeric_profile(df).collect()
    assert [(r.column, r.skewness, r.outlier_count) for r in number] == [("x", 0.0, 0)]
    assert profile.histogram(df, ["x"]).agg(F.sum("rows"), F.count("bin")).first()[:] == (3, 5)


def test_join_null_keys_and_suffix(spark, rows):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("q", 30)], "k string, v int")
    expected = {
        "inner": [("a", 1, 10), (None, 2, 20)],
        "left": [("a", 1, 10), ("z", 3, None), (None, 2, 20)],
        "right": [("a", 1, 10), ("q", None, 30), (None, 2, 20)],
        "outer": [("a", 1, 10), ("q", None, 30), ("z", 3, None), (None, 2, 20)],
    }
    for how, wanted in expected.items():
        for skewed in (False, True):
            out = joins.join(left, right, "k", "k", how, suffix="_x", skewed=skewed)
            assert out.columns == ["k", "v", "v_x"]
            assert rows(out) == wanted
    assert rows(joins.semi(left, right, "k", "k")) == [("a", 1), (None, 2)]
    assert rows(joins.anti(left, right, "k", "k")) == [("z", 3)]


def test_outer_joins_split_hot_keys_unasked(spark, rows):
    """A key with half of the rows on either or both sides, a hot key without partner, null as a hot key."""
    left = [("h", i) for i in range(300)] + [(None, i) for i in range(300, 360)] + [("lonely", i) for i in range(400, 480)] + [(f"k{i}", i) for i in range(40)]
    right = [("h", i) for i in range(70)] + [(None, 900)] + [(f"k{i}", i) for i in range(20, 60)] + [("there", i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, v int")
    hot = joins.hot_keys(a, b, ["k"], ["k"], hot_rows=50)
    assert sorted(r[1:] for r in hot.collect()) == [(1, 2), (2, 1), (2, 1), (6, 2)]
    assert joins.hot_keys(a, b, ["k"], ["k"]) is None
    for how in ("left", "right", "outer"):
        expected = rows(joins.join(a, b, "k", "k", how, skewed=False))
        assert rows(joins.join(a, b, "k", "k", how, hot_rows=50)) == expected
        assert rows(joins.join(a.withColumnRenamed("k", "x"), b, "x", "k", how, hot_rows=50)) == rows(
            joins.join(a.withColumnRenamed("k", "x"), b, "x", "k", how, skewed=False)
        )


def test_broadcasts_are_bounded_by_bytes(spark, rows, monkeypatch):
    df = spark.createDataFrame([("x" * 100, 1), (None, 2), ("y", 3)], "t string, n int")
    assert tables.fits(df, 3, 3 * 32 + 101) and not tables.fits(df, 3, 3 * 32 + 100) and not tables.fits(df, 2)
    assert tables.fits(df.select(F.array("t").alias("a")).limit(0), 0, 0)
    wanted = rows(joins.semi(df, df.filter("n < 3"), "t", "t"))
    kept = rows(keyed.attach(df, {"__k": F.col("t")}, keyed.group_stats(df, {"__k": F.col("t")}, {"s": F.sum("n")})))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    assert rows(joins.semi(df, df.filter("n < 3"), "t", "t")) == wanted
    assert rows(keyed.attach(df, {"__k": F.col("t")}, keyed.group_stats(df, {"__k": F.col("t")}, {"s": F.sum("n")}))) == kept


def test_adaptive_buckets_keep_the_order(spark, monkeypatch):
    """Merged range partitions are still ascending ranges."""
    monkeypatch.setattr(ordered, "BUCKETS", None)
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("ord")).distinct()
    small = {"advisoryPartitionSizeInBytes": "12k", "coalescePartitions.minPartitionSize": "12k"}
    for key, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{key}", value)
    try:
        placed = OrderedRows(df, ["ord"]).with_position().collect()
    finally:
        for key in small:
            spark.conf.unset(f"spark.sql.adaptive.{key}")
    assert 1 < len({r["__bucket"] for r in placed}) < 8
    by_position = sorted(placed, key=lambda r: r["__position"])
    assert [r["__position"] for r in by_position] == list(range(1, len(placed) + 1))
    assert [r["ord"] for r in by_position] == sorted(r["ord"] for r in placed)


@pytest.mark.parametrize("partition_by", [[], ["g"]])
@pytest.mark.parametrize("far", [7, 65, 399])
def test_far_rows_at_any_distance(spark, partition_by, far):
    """Distances and windows below, between and beyond the sizes of buckets, groups and the table; one group holds most rows."""
    pdf = pd.DataFrame({"ord": range(400)})
    pdf["g"] = [["a", None, "c"][i % 3] if i % 5 == 0 else "hot" for i in range(400)]
    pdf["x"] = [None if i % 7 == 3 else float((i * 7919) % 1000) / 8 for i in range(400)]
    pdf["wide name, odd.1"] = pdf["ord"].astype(str)
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).repartition(5)
    out = apply_function(df, "pd_rolling_mean", "x", "mean", order_by=["ord"], partition_by=partition_by, window=far)
    out = apply_function(out, "pd_diff", "x", "diff", order_by=["ord"], partition_by=partition_by, periods=far)
    out = apply_function(out, "pd_diff", "x", "ahead", order_by=["ord"], partition_by=partition_by, periods=-far)
    out = apply_function(out, "pd_pct_change", "x", "pct", order_by=["ord"], partition_by=partition_by, periods=far)
    got = out.toPandas().sort_values("ord", ignore_index=True)
    assert list(got["wide name, odd.1"]) == list(pdf["wide name, odd.1"])
    groups = pdf.groupby("g", dropna=False)["x"] if partition_by else pdf.assign(one=1).groupby("one")["x"]
    expected = {
        "mean": groups.transform(lambda s: s.rolling(far, min_periods=1).mean()),
        "diff": groups.transform(lambda s: s - s.shift(far)),
        "ahead": groups.transform(lambda s: s - s.shift(-far)),
        "pct": groups.transform(lambda s: (s.ffill() / s.ffill().shift(far) - 1).replace([np.inf, -np.inf], np.nan)),
    }
    for name, values in expected.items():
        np.testing.assert_allclose(got[name].astype(float), values, rtol=1e-12, err_msg=name)


@pytest.mark.parametrize("fn, args", [("pd_rolling_mean", {"window": 100}), ("pd_diff", {"periods": 100}), ("cumsum", {})])
def test_wide_rows_are_not_exchanged_again(spark, fn, args, capsys):
    """After the layout is written, only narrow copies and edges move."""
    df = spark.range(500).select(F.col("id").alias("ord"), F.col("id").alias("x"), F.lit("w").alias("wide"))
    out = apply_function(df, fn, "x", "result", order_by=["ord"], partition_by=[], **args)
    out.explain("formatted")
    steps = [s for s in capsys.readouterr().out.split("\n\n") if "Exchange" in s.split("\n")[0]]
    assert steps and not [s for s in steps if re.search(r"\b(wide|c2)#", s)]


def test_layouts_have_ranges_of_bounded_size_one_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", None)
    monkeypatch.setattr(tables, "RANGE_BYTES", 16_000)
    rows = tables.written(spark.range(20_000).selectExpr("id", "uuid() as x"))
    layout = OrderedRows(rows, ["id"])
    sizes = [r["n"] for r in layout.rows.groupBy("__bucket").agg(F.count("*").alias("n")).collect()]
    assert layout.parts > 8 * 3 and len(sizes) == layout.parts  # more than the shuffle partitions
    assert max(sizes) < 3 * 20_000 / layout.parts
    slots = layout.rows.select(F.pmod(F.hash("__bucket"), F.lit(layout.parts))).distinct()
    assert slots.count() == layout.parts  # no hash bucket holds two ranges
    assert [r["p"] for r in layout.with_place("p").orderBy("id").select("p").collect()] == [*range(1, 20_001)]


def test_quantiles_lay_out_only_what_lies_around_a_rank(spark, monkeypatch):
    # 60,000 distinct values of two groups, beside a column of five values
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") / 1e9).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    laid, real = [], ordered.OrderedRows.__init__

    def counted(self, rows, *more):
        laid.append(rows.count())
        real(self, rows, *more)

    monkeypatch.setattr(ordered.OrderedRows, "__init__", counted)
    exact = quantiles(df, ["g"], ["x", "y"], [0.25, 0.5, 1.0]).orderBy("g").collect()
    assert quantiles(df, ["g"], ["x", "y"], [0.25, 0.5, 1.0], small_group_rows=0).orderBy("g").collect() == exact
    assert len(laid) == 1 and laid[0] < 1_000
    # bounds that miss a rank: everything is laid out, the result is the same
    monkeypatch.setattr(ordered, "SKETCH", 20)
    monkeypatch.setattr(ordered, "SLACK", 0)
    assert quantiles(df, ["g"], ["x", "y"], [0.25, 0.5, 1.0], small_group_rows=0).orderBy("g").collect() == exact
    assert len(laid) == 3 and laid[2] > 60_000
