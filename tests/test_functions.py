"""Scalar, array, map and matrix functions on rows chosen for their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.functions import arrays, color, maps, matrices, na, strings, ticker, timeframe
from barloom.functions import math as fmath
from barloom.functions import time as ftime


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def ms(text):
    return F.unix_millis(F.lit(text).cast("timestamp"))


def ts(text):
    return F.lit(text).cast("timestamp")


def test_na(spark):
    inf, nan, none = F.lit(float("inf")), F.lit(float("nan")), F.lit(None).cast("double")
    r = one(spark, a=na.is_na(inf), b=na.is_na(nan), c=na.nz(none), d=na.nz(inf, 3.0), e=na.teq(F.lit(1.0), F.lit(1.0 + 5e-11)), f=na.tlt(F.lit(1.0), none), g=na.safe_div(F.lit(1), F.lit(0)), h=na.truth(none), i=na.cast_int(F.lit(-2.7)), j=na.for_range(F.lit(3), F.lit(1)))
    assert tuple(r) == (True, True, 0.0, 3.0, True, False, None, False, -2, [3, 2, 1])


def test_math(spark):
    none = F.lit(None).cast("double")
    r = one(spark, a=fmath.max(F.lit(1.0), none), b=fmath.min(F.lit(1.0), F.lit(2.0)), c=fmath.sqrt(F.lit(-1.0)), d=fmath.log(F.lit(0.0)), e=fmath.round(F.lit(-2.5)), f=fmath.round(F.lit(1.005), 2), g=fmath.floor(F.lit(-1.5)), h=fmath.round_to_mintick(F.lit(1.13), 0.25))
    assert tuple(r) == (None, 1.0, None, None, -3, 1.01, -2, 1.25)


def test_strings(spark):
    s = F.lit("banana")
    r = one(spark, a=strings.pos(s, F.lit("x")), b=strings.pos(s, F.lit("an")), c=strings.replace(s, "ana", "-", 1), d=strings.split(F.lit("a|b"), "|"), e=strings.split(F.lit("ab"), ""), f=strings.repeat(F.lit("x"), F.lit(0)), g=strings.substring(s, F.lit(2)), h=strings.tonumber(F.lit("1e3x")), i=strings.match(s, "an"), j=strings.replace(s, "", "^", 2))
    assert tuple(r) == (None, 1, "ban-", ["a", "b"], ["a", "b"], None, "nana", None, "", "ba^nana")


@pytest.mark.parametrize(("value", "mask", "text"), [(1234.567, "#.##", "1234.57"), (0.5, "#.##", "0.5"), (2.0, "#.00", "2.00"), (-0.001, "#.##", "0"), (1234567.0, "#,##0", "1,234,567"), (0.256, "0.#%", "25.6%"), (float("nan"), "#", "NaN"), (2.675, "#.##", "2.68")])
def test_masks(value, mask, text):
    assert strings.mask_number(value, mask) == text


def test_message():
    assert strings.message("{0} of {1,number,#.#} '{2}' {9}", ("a", 2.25)) == "a of 2.2 {2} {9}"


def test_format_time(spark):
    r = one(spark, a=strings.format_time(ms("2024-07-01 12:00:00"), timezone="America/New_York"), b=strings.format_time(ms("2024-01-01 00:30:00"), "HH:mm", "Asia/Tokyo"))
    assert tuple(r) == ("2024-07-01T08:00:00-0400", "09:30")


def test_timeframes():
    assert timeframe.in_seconds("1M") == 2_628_003 and timeframe.from_seconds(86_400 * 28) == "1M"
    assert timeframe.parse("D").text == "1D" and timeframe.parse("15").isminutes and timeframe.parse("2W").isdwm
    with pytest.raises(ValueError, match="multiple"):
        timeframe.validate_aggregation("7", "60")
    with pytest.raises(ValueError, match="timeframe"):
        timeframe.parse("5X")


def test_buckets(spark):
    night = [ftime.Interval(d, "17:00", "17:00") for d in (6, 0, 1, 2, 3)]
    ny = "America/New_York"
    day = [ftime.Interval(d, "09:30", "16:00") for d in range(5)]
    r = one(
        spark,
        evening=ftime.bucket(ts("2024-01-09 23:00:00"), "1D", ny, night).cast("string"),
        summer=ftime.bucket(ts("2024-07-10 12:00:00"), "1D", ny).cast("string"),
        anchored=ftime.bucket(ts("2024-01-09 15:45:00"), "60", ny, day, anchor_sessions=True).cast("string"),
        two_weeks=ftime.bucket(ts("2024-01-17 12:00:00"), "2W").cast("string"),
        weekday_grid=ftime.bucket(ts("2024-01-08 12:00:00"), "3D", weekday_grid=True).cast("string"),
        month_end=ftime.bucket_end(ts("2024-02-01 00:00:00"), "1M").cast("string"),
        dst_end=ftime.bucket_end(ts("2024-03-10 05:00:00"), "1D", ny).cast("string"),
    )
    assert r.evening == "2024-01-09 22:00:00" and r.summer == "2024-07-10 04:00:00" and r.anchored == "2024-01-09 15:30:00"
    assert r.two_weeks == "2024-01-15 00:00:00" and r.weekday_grid == "2024-01-04 00:00:00" and r.month_end == "2024-03-01 00:00:00" and r.dst_end == "2024-03-11 04:00:00"


def test_sessions(spark):
    s = ftime.session_intervals("0930-1600:23456")
    over = ftime.session_intervals("1800-0200:1")
    r = one(spark, a=ftime.in_session(ts("2024-01-08 09:30:00"), s), b=ftime.in_session(ts("2024-01-08 16:00:00"), s), c=ftime.in_session(ts("2024-01-08 01:00:00"), over), d=ftime.in_session(ts("2024-01-09 01:00:00"), over), e=ftime.timestamp(F.lit(2023), F.lit(13), F.lit(1)), f=ms("2024-01-01 00:00:00"))
    assert tuple(r)[:4] == (True, False, True, False) and r.e == r.f


def test_colors(spark):
    red = F.lit("#FF0000FF")
    r = one(spark, a=color.rgb(F.lit(300), F.lit(-1), F.lit(16)), b=color.t(color.new(red, 50)), c=color.from_gradient(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), red, red), d=color.from_gradient(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(None).cast("string"), red), e=ticker.new(F.lit("NYSE"), F.lit("IBM")), f=ticker.inherit(F.lit("NYSE:IBM"), F.lit("LSE:VOD")))
    assert tuple(r) == ("#FF0010FF", 50.0, None, None, "NYSE:IBM", "LSE:VOD")


def test_arrays(spark):
    a = F.array(*(F.lit(x).cast("double") for x in (3.0, None, 1.0, 3.0, 2.0)))
    empty = F.array().cast("array<double>")
    r = one(spark, mode=arrays.mode(a), med=arrays.median(a), second=arrays.max(a, 1), none=arrays.sum(empty), every=arrays.every(F.array().cast("array<boolean>")), z=arrays.standardize(F.array(F.lit(2.0), F.lit(2.0))), idx=arrays.sort_indices(a), lastidx=arrays.lastindexof(a, F.lit(3.0)), left=arrays.binary_search_leftmost(F.array(F.lit(1.0), F.lit(3.0)), F.lit(2.0)), neg=arrays.get(a, -1), lone=arrays.stdev(F.array(F.lit(4.0))))
    assert (r.mode, r.med, r.second, r.none, r.every, r.z, r.idx, r.lastidx, r.left, r.neg, r.lone) == (3.0, 2.5, 3.0, None, False, [1.0, 1.0], [2, 4, 0, 3, 1], 3, 0, 2.0, 0.0)


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    r = one(spark, put=maps.put(m, F.lit("a"), F.lit(9)), gone=maps.remove(m, F.lit("z")), both=maps.put_all(m, F.create_map(F.lit("b"), F.lit(5))))
    assert (r.put.map, r.put.value, r.gone.map, r.gone.value, r.both) == ({"a": 9, "b": 2}, 1, {"a": 1, "b": 2}, None, {"a": 1, "b": 5})


def test_matrices(spark):
    m = F.array(F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(3.0)))
    r = one(spark, det=matrices.det(m), eig=matrices.eigenvalues(m), inv=matrices.inv(m), kron=matrices.kron(m, m), tri=matrices.is_triangular(m), sym=matrices.is_symmetric(m), sub=matrices.submatrix(m, 1), cols=matrices.add_col(m, None, F.array(F.lit(7.0), F.lit(8.0))), drop=matrices.remove_col(m, 0).matrix, pow=matrices.pow(m, 2), ident=matrices.is_identity(F.array(F.array(F.lit(1.0)))), stoch=matrices.is_stochastic(F.array(F.array(F.lit(0.25), F.lit(0.75)))))
    assert r.det == pytest.approx(5) and r.eig == pytest.approx([3.618034, 1.381966]) and r.inv[0] == pytest.approx([0.6, -0.2])
    assert r.kron[3] == [1.0, 3.0, 3.0, 9.0] and not r.tri and r.sym and r.sub == [[1.0, 3.0]] and r.cols == [[2.0, 1.0, 7.0], [1.0, 3.0, 8.0]] and r["drop"] == [[1.0], [3.0]] and r["pow"] == [[5.0, 5.0], [5.0, 10.0]] and r.ident and r.stoch


def test_masks_as_expressions(spark):
    import random

    rng = random.Random(1)
    values = [None, float("nan"), 0.0, -0.0, 0.5, 0.005, -0.004, 1234567.891, 1e12, 1e-9, 2.675, -99.995, 1e20, 10.0, *(rng.uniform(-1, 1) * 10 ** rng.randint(-6, 10) for _ in range(100)), *(round(rng.uniform(-100, 100), rng.randint(0, 4)) for _ in range(100))]
    masks = ("#.##########", "#.##", "#.00", "0.00", "#,##0", "#,##0.##", "0.##%", "0%", "#", ".00", "000.0", "00", "#,##0.00")
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", *(strings.tostring(F.col("v"), m) for m in masks)).collect():
        assert list(row)[1:] == [strings.mask_number(row.v, m) for m in masks], row.v


def test_array_more_orders_equal_elements_as_its_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from barloom import queries_values
    from barloom.queries import ORACLES

    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(0, [9, 60, 4000][i % 3], 64).astype(float).tolist()) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, sort_indices, sort_down FROM ({ORACLES['array_more']}) ORDER BY 1").fetchall()
    got = queries_values.array_more(spark, str(tmp_path)).select("vec_id", "sort_indices", "sort_down").orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == want
