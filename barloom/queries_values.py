"""Registered queries of arrays, matrices, maps, identifiers, timeframes, sessions and storage, beside their SQL."""

from __future__ import annotations

import uuid
from enum import Enum

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import engine
from barloom.functions import arrays as A
from barloom.functions import maps, na, pdqsort, ticker, timeframe
from barloom.functions import matrices as M
from barloom.functions import time as ftime
from barloom.inputs import Input, resolved
from barloom.operators import request, resample, ta
from barloom.queries import BARS, OVER, hourly, query, table
from barloom.sources import bars as sources

# -- arrays ----------------------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), s AS (SELECT *, list_sort(a) AS s, len(a) AS n, list_avg(a) AS m FROM e)"


@query(f"""WITH {_E}, q AS (SELECT *, list_distinct(list_transform(a, lambda x: round(x * 4))) AS d FROM s)
SELECT vec_id, list_transform(a, lambda x: abs(x)) AS abs, list_position(s, a[6]) - 1 AS found, -1 AS not_found, greatest(len(list_filter(s, lambda x: x < m)) - 1, 0) AS leftmost, list_position(s, a[6]) - 1 AS leftmost_found, n - list_position(list_reverse(a), a[3]) AS lastindexof,
list_transform(a, lambda x: round((x - m) / list_stddev_pop(a), 8)) AS standardize, round(s[ (0.35 * n + 0.5)::DECIMAL(18,6) // 1 ] * (1 - (0.35 * n + 0.5 - floor(0.35 * n + 0.5))) + s[((0.35 * n + 0.5)::DECIMAL(18,6) // 1)::INT + 1] * (0.35 * n + 0.5 - floor(0.35 * n + 0.5)), 8) AS linear,
[] = a[1:0] AS cleared, a AS copied, [a[1], a[2]] AS items, a[1] AS shifted, a[2:] AS rest, [7.0::DOUBLE, 7.0::DOUBLE] AS floats, [3, 3, 3] AS ints, [true] AS bools, ['x', 'x'] AS strings, ['#FF0000FF'] AS colors, list_transform(list_grade_up(a), lambda i: (i - 1)::INT) AS sort_indices,
list_reverse(list_transform(list_grade_up(a), lambda i: (i - 1)::INT)) AS sort_down, list_reverse(s) AS sorted_down, a[len(a)] AS from_end, list_avg(list_transform(a, lambda x: round(x * 4))) IS NOT NULL AS has_mode FROM q""".replace("(0.35 * n + 0.5)::DECIMAL(18,6) // 1 ", "floor(0.35 * n + 0.5)::INT").replace("((0.35 * n + 0.5)::DECIMAL(18,6) // 1)::INT + 1", "floor(0.35 * n + 0.5)::INT + 1"))
def array_more(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    e = e.withColumn("s", A.sort(F.col("a")))
    a, s = F.col("a"), F.col("s")
    r = lambda x: F.round(x, 8)
    # the order of equal elements, which the SQL leaves open, is that of its sort
    ties = (F.size(a) >= 24) & (F.size(F.array_distinct(a)) < F.size(a)) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))
    indices = F.coalesce(F.udf(pdqsort.order, "array<int>")(F.when(ties, a)), A.sort_indices(a))
    return e.select(
        "vec_id", A.abs(a).alias("abs"), A.binary_search(s, A.get(a, 5)).alias("found"), A.binary_search(s, F.lit(1e9)).alias("not_found"), A.binary_search_leftmost(s, A.avg(a)).alias("leftmost"), A.binary_search_leftmost(s, A.get(a, 5)).alias("leftmost_found"), A.lastindexof(a, A.get(a, 2)).alias("lastindexof"),
        F.transform(A.standardize(a), r).alias("standardize"), r(A.percentile_linear_interpolation(a, 35.0)).alias("linear"), (A.size(A.clear(a)) == 0).alias("cleared"), A.copy(a).alias("copied"), A.from_items(A.get(a, 0), A.get(a, 1)).alias("items"), A.shift(a)["value"].alias("shifted"), A.shift(a)["array"].alias("rest"),
        A.new_float(2, 7.0).alias("floats"), A.new_int(3, 3).cast("array<int>").alias("ints"), A.new_bool(1, True).alias("bools"), A.new_string(2, "x").alias("strings"), A.new_color(1, "#FF0000FF").alias("colors"), indices.alias("sort_indices"), F.reverse(indices).alias("sort_down"), A.sort(a, False).alias("sorted_down"), A.get(a, -1).alias("from_end"),
        A.mode(F.transform(a, lambda x: F.round(x * 4))).isNotNull().alias("has_mode"),
    )


@query("""WITH e AS (SELECT l_orderkey, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, l_quantity::DOUBLE AS v, min(l_linenumber) AS first, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, v AS mode FROM u QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, v) = 1),
p AS (SELECT l_orderkey, list_sort(a) AS s, a, len(a) AS n FROM e) SELECT l_orderkey, mode, s[least(greatest(ceil(0.4 * n), 1), n)::INT] AS nearest, list_max(a) - list_min(a) AS range, round(CASE WHEN n < 2 THEN 0 ELSE list_var_samp(a) END, 6) AS variance, CASE WHEN n > 1 THEN s[n - 1] END AS second_largest, CASE WHEN n > 1 THEN s[2] END AS second_least FROM m JOIN p USING (l_orderkey)""")
def array_groups(spark, sf_dir):
    """Array statistics of groups of different sizes with ties."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("l"))
    e = e.select("l_orderkey", F.transform("l", lambda x: x["q"]).alias("a"))
    a = F.col("a")
    return e.select("l_orderkey", A.mode(a).alias("mode"), A.percentile_nearest_rank(a, 40.0).alias("nearest"), A.range(a).alias("range"), F.round(A.variance(a, False), 6).alias("variance"), A.max(a, 1).alias("second_largest"), A.min(a, 1).alias("second_least"))


# -- matrices --------------------------------------------------------------------------------------------------------

_M = "e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)"


def square(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(at(0), at(1)), F.array(at(2), at(3))).alias("m"))


@query(f"""WITH {_M} SELECT vec_id, [[1.5::DOUBLE, 1.5], [1.5, 1.5]] AS new, [[a, b], [c, d]] AS copy, [[a, b], [9.0, 8.0], [c, d]] AS add_row, [[a, 9.0, b], [c, 8.0, d]] AS add_col, 2 AS rows, 2 AS columns, [[a, b], [c, d], [a, b], [c, d]] AS concat, [[0.0::DOUBLE, b - c], [c - b, 0.0]] AS diff, [[a, 5.0], [c, 5.0]] AS fill,
[[a, b], [7.0, d]] AS set, [[b, a], [d, c]] AS swap_columns, [[b], [d]] AS submatrix, [[c, d]] AS remove_row, [a, b] AS removed_row, [[a], [c]] AS remove_col, [b, d] AS removed_col, least(a, b, c, d) AS min, round((list_sort([a, b, c, d])[2] + list_sort([a, b, c, d])[3]) / 2, 9) AS median, a * d AS kron11, b * b AS kron03, c * a AS kron20, [[a - 1, b - 1], [c - 1, d - 1]] AS less,
[a * 2 + b * 3, c * 2 + d * 3] AS mult_vector, [[a * 2, b * 2], [c * 2, d * 2]] AS doubled FROM e""")
def matrix_more(spark, sf_dir):
    e, m = square(spark, sf_dir), F.col("m")
    two = lambda x, y: F.array(F.lit(x), F.lit(y))
    k = M.kron(m, m)
    return e.select(
        "vec_id", M.new(2, 2, 1.5).alias("new"), M.copy(m).alias("copy"), M.add_row(m, 1, two(9.0, 8.0)).alias("add_row"), M.add_col(m, 1, two(9.0, 8.0)).alias("add_col"), M.rows(m).alias("rows"), M.columns(m).alias("columns"), M.concat(m, m).alias("concat"), M.diff(m, M.transpose(m)).alias("diff"), M.fill(m, F.lit(5.0), 0, None, 1, 2).alias("fill"), M.set(m, 1, 0, F.lit(7.0)).alias("set"),
        M.swap_columns(m, 0, 1).alias("swap_columns"), M.submatrix(m, 0, None, 1, 2).alias("submatrix"), M.remove_row(m, 0)["matrix"].alias("remove_row"), M.remove_row(m, 0)["row"].alias("removed_row"), M.remove_col(m)["matrix"].alias("remove_col"), M.remove_col(m)["column"].alias("removed_col"), M.min(m).alias("min"), F.round(M.median(m), 9).alias("median"), M.get(k, 1, 1).alias("kron11"), M.get(k, 0, 3).alias("kron03"), M.get(k, 2, 0).alias("kron20"), M.diff(m, 1.0).alias("less"),
        M.mult_vector(m, two(2.0, 3.0)).alias("mult_vector"), M.mult(m, 2.0).alias("doubled"),
    )


@query(f"""WITH {_M}, x AS (SELECT *, a * d - b * c AS det, (a + d) / 2 AS h FROM e) SELECT vec_id, round(h + sqrt(greatest(h * h - det, 0)), 6) AS eigen0, round(h - sqrt(greatest(h * h - det, 0)), 6) AS eigen1, [[1.0::DOUBLE, 0.0], [0.0, 1.0]] AS eigenvectors, round((a * b + c * d) / (a * a + c * c), 6) AS slope,
a = 0 AND b = 0 AND c = 0 AND d = 0 AS is_zero, false AS is_binary, b = 0 AND c = 0 AS is_diagonal, a = 0 AND d = 0 AS is_antidiagonal, false AS is_identity, a = 0 AND d = 0 AND b = -c AS is_antisymmetric, true AS triangular, true AS diagonal, true AS identity, true AS antidiagonal, true AS antisymmetric, true AS zero, true AS binary, true AS stochastic, false AS is_stochastic, 3.0::DOUBLE AS mode FROM x""")
def matrix_kinds(spark, sf_dir):
    """Eigenvalues, pseudo-inverse and all tests of a matrix, on data and on matrices made to pass them."""
    e, m = square(spark, sf_dir), F.col("m")
    one = lambda *rows: F.array(*(F.array(*(x if isinstance(x, type(m)) else F.lit(float(x)) for x in r)) for r in rows))
    a, b, c, d = (M.get(m, i, j) for i in (0, 1) for j in (0, 1))
    e = e.withColumns({"values": M.eigenvalues(m), "vectors": M.eigenvectors(m), "left": M.pinv(F.transform(m, lambda r: F.slice(r, 1, 1)))})
    return e.select(
        "vec_id", F.round(F.get("values", F.lit(0)), 6).alias("eigen0"), F.round(F.get("values", F.lit(1)), 6).alias("eigen1"), F.col("vectors").alias("eigenvectors"), F.round(M.get(F.col("left"), 0, 0) * b + M.get(F.col("left"), 0, 1) * d, 6).alias("slope"),
        M.is_zero(m).alias("is_zero"), M.is_binary(m).alias("is_binary"), M.is_diagonal(m).alias("is_diagonal"), M.is_antidiagonal(m).alias("is_antidiagonal"), M.is_identity(m).alias("is_identity"), M.is_antisymmetric(m).alias("is_antisymmetric"), M.is_triangular(one((a, b), (0, d))).alias("triangular"), M.is_diagonal(one((a, 0), (0, d))).alias("diagonal"), M.is_identity(one((1, 0), (0, 1))).alias("identity"),
        M.is_antidiagonal(one((0, b), (c, 0))).alias("antidiagonal"), M.is_antisymmetric(one((0, b), (-b, 0))).alias("antisymmetric"), M.is_zero(one((0, 0), (0, 0))).alias("zero"), M.is_binary(one((0, 1), (1, 0))).alias("binary"), M.is_stochastic(one((0.25, 0.75), (1, 0))).alias("stochastic"), M.is_stochastic(one((0.5, 0.6), (1, 0))).alias("is_stochastic"), M.mode(one((3, 1), (a, 3))).alias("mode"),
    )


# -- maps, na, identifiers, timeframes -----------------------------------------------------------------------------------


@query("SELECT c_custkey, 0 AS empty, 0 AS cleared, ['a', 'b'] AS copied, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS nz, c_custkey % 3 = 0 AS is_na, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_custkey END AS nz_with FROM customer")
def maps_and_na(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = F.create_map(F.lit("a"), F.col("c_acctbal"), F.lit("b"), F.lit(1.0))
    x = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("double"))
    return c.select("c_custkey", maps.size(maps.new()).alias("empty"), maps.size(maps.clear(m)).alias("cleared"), maps.keys(maps.copy(m)).alias("copied"), na.nz(x).cast("long").alias("nz"), na.is_na(x).alias("is_na"), na.nz(x, F.col("c_acctbal")).alias("nz_with"))


@query("""SELECT c_custkey, 'NYSE:' || c_custkey AS new, c_custkey::VARCHAR AS bare, 'NYSE:' || c_custkey AS modify, 'NYSE:' || c_custkey AS standard, 'HA=NYSE:' || c_custkey AS heikinashi, 'ESD_FACTSET:NYSE;' || c_custkey || ';DIVIDENDS' AS dividends, 'ESD_FACTSET:NYSE;' || c_custkey || ';EARNINGS' AS earnings,
'ESD_FACTSET:NYSE;' || c_custkey || ';SPLITS' AS splits, 'renko,pointfigure,kagi,linebreak' AS refused FROM customer""")
def tickers(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    id_ = ticker.new(F.lit("NYSE"), k)
    refused = []
    for name in ("renko", "pointfigure", "kagi", "linebreak"):
        try:
            getattr(ticker, name)(id_)
        except NotImplementedError:
            refused.append(name)
    return table(spark, sf_dir, "customer").select("c_custkey", id_.alias("new"), ticker.new(F.lit(""), k).alias("bare"), ticker.modify(id_).alias("modify"), ticker.standard(id_).alias("standard"), ticker.heikinashi(id_).alias("heikinashi"), ticker.dividends(id_).alias("dividends"), ticker.earnings(id_).alias("earnings"), ticker.splits(id_).alias("splits"), F.lit(",".join(refused)).alias("refused"))


@query("""SELECT text, regexp_extract(text, '[A-Z]$') AS unit, greatest(coalesce(try_cast(regexp_extract(text, '^[0-9]+') AS INT), 1), 1) AS multiplier, text LIKE '%T' AS isticks, text LIKE '%S' AS isseconds, text SIMILAR TO '[0-9]+' AS isminutes, text LIKE '%D' AS isdaily, text LIKE '%W' AS isweekly, text LIKE '%M' AS ismonthly, text SIMILAR TO '.*[DWM]' AS isdwm, NOT text SIMILAR TO '.*[DWM]' AS isintraday,
CASE WHEN text SIMILAR TO '[A-Z]' THEN '1' || text ELSE text END AS period, text IN ('120', '1D', 'W', '3M', '90') AND text <> '90' AS from_hour FROM (VALUES ('1'), ('120'), ('90'), ('30S'), ('100T'), ('1D'), ('W'), ('2W'), ('3M')) t(text)""".replace("text IN ('120', '1D', 'W', '3M', '90') AND text <> '90'", "text IN ('120', '1D', 'W', '2W', '3M')"))
def timeframe_kinds(spark, sf_dir):
    """All properties of timeframes, and whether hours can be made into them."""

    def fits(target: str) -> bool:
        try:
            timeframe.validate_aggregation("60", target)
        except ValueError:
            return False
        return True

    rows = [(t, p.unit, p.multiplier, p.isticks, p.isseconds, p.isminutes, p.isdaily, p.isweekly, p.ismonthly, p.isdwm, p.isintraday, p.period, fits(t)) for t in ("1", "120", "90", "30S", "100T", "1D", "W", "2W", "3M") for p in [timeframe.parse(t)]]
    return spark.createDataFrame(rows, "text string, unit string, multiplier int, isticks boolean, isseconds boolean, isminutes boolean, isdaily boolean, isweekly boolean, ismonthly boolean, isdwm boolean, isintraday boolean, period string, from_hour boolean")


@query(f"""WITH {BARS} SELECT symbol, time, false AS ispremarket, false AS ispostmarket, isodow(time) < 6 AND hour(time) = 9 AS isfirstbar_regular, isodow(time) < 6 AND hour(time) = 15 AS islastbar_regular, coalesce(date_trunc('week', time) <> date_trunc('week', lag(time) OVER ({OVER})), false) AS new_week,
epoch_ms(date_trunc('day', time)::TIMESTAMP) + 86400000 AS day_end, epoch_ms(date_trunc('week', time)::TIMESTAMP) + 7 * 86400000 AS week_end, epoch_ms(date_trunc('month', time)::TIMESTAMP + INTERVAL 1 MONTH) AS month_end, true AS now_is_later, close AS bounded FROM b""")
def sessions_and_ends(spark, sf_dir):
    c = hourly(spark, sf_dir)
    s = ftime.session_intervals("0930-1600:23456")
    t = c.time
    return c.select(
        ispremarket=t.map(lambda t: ftime.ispremarket()), ispostmarket=t.map(lambda t: ftime.ispostmarket()), isfirstbar_regular=t.map(lambda t: ftime.isfirstbar_regular(t, 3600, s)), islastbar_regular=t.map(lambda t: ftime.islastbar_regular(t, 3600, s)), new_week=t.map(lambda t, p: resample.timeframe_change(t, p, "1W"), c.time[1]),
        day_end=t.map(lambda t: ftime.time_close(t, "1D")), week_end=t.map(lambda t: ftime.time_close(t, "1W")), month_end=t.map(lambda t: ftime.time_close(t, "1M")), now_is_later=t.map(lambda t: ftime.timenow() > ftime.epoch_ms(t)), bounded=c.max_bars_back(c.close, 500),
    )


# -- requests ----------------------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT symbol, time, high - low AS spread, {', '.join(f'NULL::DOUBLE AS {n}' for n in ('dividends', 'splits', 'earnings', 'financial', 'economic', 'quandl', 'seed', 'footprint'))}, 8 AS refused FROM b")
def requests_without_source(spark, sf_dir):
    """The request of the chart's own bars, and those that have no source: na when they are to be ignored, errors else."""
    b = sources.from_events(spark, sf_dir, "60")
    names = ("dividends", "splits", "earnings", "financial", "economic", "quandl", "seed", "footprint")
    df = request.security(b.select("symbol", "time"), b.withColumn("spread", F.col("high") - F.col("low")), "60", "60", ["spread"])
    refused = 0
    for n in names:
        try:
            request.unavailable(df, n)
        except ValueError:
            refused += 1
        df = request.unavailable(df, n, ignore_invalid_symbol=True)
    return df.withColumn("refused", F.lit(refused))


ORDER_DAYS = "od AS (SELECT o_orderdate::DATE::TIMESTAMP AS time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, row_number() OVER (ORDER BY o_orderdate::DATE) AS n FROM orders GROUP BY o_orderdate::DATE)"
HA_DAYS = "ha(n, o, c) AS (SELECT n, (open + close) / 2, (open + high + low + close) / 4 FROM od WHERE n = 1 UNION ALL SELECT od.n, (ha.o + ha.c) / 2, (od.open + od.high + od.low + od.close) / 4 FROM ha JOIN od ON od.n = ha.n + 1), hd AS (SELECT od.time, ha.o AS ha_open, ha.c AS ha_close, greatest(od.high, ha.o, ha.c) AS ha_high, least(od.low, ha.o, ha.c) AS ha_low FROM ha JOIN od USING (n))"


@query(f"""WITH RECURSIVE {ORDER_DAYS}, {HA_DAYS}, l AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS time FROM lineitem GROUP BY 1, 2)
SELECT l.symbol, l.time, round(hd.ha_open, 4) AS ha_open, round(hd.ha_high, 4) AS ha_high, round(hd.ha_low, 4) AS ha_low, round(hd.ha_close, 4) AS ha_close, NULL::DOUBLE AS unknown, true AS refused FROM l ASOF LEFT JOIN hd ON l.time >= hd.time""")
def security_heikinashi(spark, sf_dir):
    """A marked ticker gets averaged bars; an unknown one gives na when it is to be ignored, and an error else."""
    chart = sources.from_lineitem(spark, sf_dir, "1D").select("symbol", "time")
    feeds = {"NYSE:ORDERS": sources.from_orders(spark, sf_dir, "1D")}
    wanted = {f"ha_{c}": F.round(c, 4) for c in ("open", "high", "low", "close")}
    df = request.security_of(chart, "HA=NYSE:ORDERS", feeds, "1D", "1D", wanted)
    df = request.security_of(df, "NYSE:NOBODY", feeds, "1D", "1D", {"unknown": F.col("close")}, ignore_invalid_symbol=True)
    try:
        request.security_of(chart, "NYSE:NOBODY", feeds, "1D", "1D", wanted)
        refused = False
    except ValueError:
        refused = True
    return df.withColumn("refused", F.lit(refused))


_CALENDAR = """days AS (SELECT unnest(generate_series(DATE '1991-01-01', DATE '2003-12-31', INTERVAL 1 DAY))::DATE AS d), mon AS (SELECT d, (d - (isodow(d) - 1)::INT)::DATE AS m FROM days),
grid AS (SELECT d, make_date(year(d), 1, 1) + ((dayofyear(d) - 1) // 3 * 3)::INT AS d3, (SELECT min(x.d) FROM days x WHERE isodow(x.d) = 1 AND year(x.d) = year(mon.m)) + ((m - (SELECT min(x.d) FROM days x WHERE isodow(x.d) = 1 AND year(x.d) = year(mon.m))) // 14 * 14)::INT AS w2, make_date(year(d), (month(d) - 1) // 5 * 5 + 1, 1) AS m5 FROM mon),
ends AS (SELECT d, (SELECT min(g.d3) FROM (SELECT DISTINCT d3 FROM grid) g WHERE g.d3 > grid.d3) AS e3, (SELECT min(g.w2) FROM (SELECT DISTINCT w2 FROM grid) g WHERE g.w2 > grid.w2) AS ew, (SELECT min(g.m5) FROM (SELECT DISTINCT m5 FROM grid) g WHERE g.m5 > grid.m5) AS em FROM grid)"""


@query(f"WITH {_CALENDAR} SELECT DISTINCT l_shipdate::DATE::TIMESTAMP AS time, epoch_ms(e3::TIMESTAMP) AS end_3d, epoch_ms(ew::TIMESTAMP) AS end_2w, epoch_ms(em::TIMESTAMP) AS end_5m FROM lineitem JOIN ends ON d = l_shipdate::DATE")
def period_ends(spark, sf_dir):
    """Ends of periods of several days, weeks and months, which are cut at the turn of the year."""
    t = F.col("time")
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("timestamp").alias("time")).distinct()
    return days.select("time", ftime.time_close(t, "3D").alias("end_3d"), ftime.time_close(t, "2W").alias("end_2w"), ftime.time_close(t, "5M").alias("end_5m"))


@query(f"""WITH {BARS}, i AS (SELECT * FROM b WHERE isodow(time) < 6 AND hour(time) BETWEEN 8 AND 14), h AS (SELECT symbol, to_timestamp(floor(epoch(time) / 14400) * 14400)::TIMESTAMP AS time, arg_max(close, time) AS close FROM i GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN hour(time) = 12 THEN time + INTERVAL 3 HOUR ELSE time + INTERVAL 4 HOUR END AS fin FROM h) SELECT b.symbol, b.time, k.close AS session_close FROM b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.time + INTERVAL 1 HOUR >= k.fin""")
def security_session(spark, sf_dir):
    """Four-hour bars of a market that closes at three: the second one is confirmed by the close of the session."""
    b = sources.from_events(spark, sf_dir, "60")
    hours = ftime.session_intervals("0800-1500:23456")
    higher = resample.resample(b.where(ftime.in_session(F.col("time"), hours)), "240", "60").select("symbol", "time", F.col("close").alias("session_close"))
    return request.security(b.select("symbol", "time"), higher, "60", "240", ["session_close"], intervals=hours)


# -- inputs ------------------------------------------------------------------------------------------------------------


class Side(Enum):
    UP = "up"
    DOWN = "down"


TOML = """[inputs.length]
value = 7
[inputs.threshold]
value = 55
"""


@query(f"""WITH {BARS}, x AS (SELECT *, CASE WHEN n >= 7 THEN avg((high + low) / 2) OVER ({OVER} ROWS 6 PRECEDING) END AS m FROM b) SELECT symbol, time, round(m, 6) AS mean, coalesce(m > 55, false) AND hour(time) BETWEEN 9 AND 15 AND isodow(time) < 6 AS above, 'down 240 NYSE:IBM #FF0000 1700000000000 a note' AS words, 4 AS refused FROM x""")
def indicator_inputs(spark, sf_dir):
    """All kinds of inputs, from the caller, from TOML and by default; four values outside their limits are refused."""
    declared = {
        "length": Input("int", 14, 1, 100), "threshold": Input("float", 50.0), "src": Input("source", "close"), "side": Input("enum", Side.UP), "frame": Input("timeframe", "240"), "hours": Input("session", "0930-1600:23456"), "who": Input("symbol", "NYSE:IBM"), "tint": Input("color", "#FF0000"),
        "start": Input("time", 1_700_000_000_000), "note": Input("text_area", "a note"), "kind": Input("string", "sma", options=("sma", "ema")), "show": Input("bool", True), "at": Input("price", 1.5),
    }

    def script(chart, plots, length, threshold, src, side, frame, hours, who, tint, start, note, kind, show, at):
        mean = ta.sma(src, length)
        open_hours = chart.time.map(lambda t: ftime.ismarket(t, 3600, ftime.session_intervals(hours)))
        plots.plot(mean.map(lambda x: F.round(x, 6)), "mean")
        plots.plot(mean.map(lambda m, o: F.coalesce(m > threshold, F.lit(False)) & o, open_hours), "above")
        plots.plot(chart.close.map(lambda _: F.lit(f"{side.value} {frame} {who} {tint} {start} {note}")), "words")

    script.inputs = declared
    df = engine.indicator(sources.from_events(spark, sf_dir, "60"), script, {"src": "hl2", "side": "DOWN"}, toml=TOML)
    refused = 0
    for wrong in ({"length": 101}, {"kind": "wma"}, {"tint": "red"}, {"nobody": 1}):
        try:
            resolved(declared, wrong)
        except ValueError:
            refused += 1
    return df.withColumn("refused", F.lit(refused))


# -- storage -----------------------------------------------------------------------------------------------------------


def shared_folder(spark) -> str:
    """A new folder in the shared folder that the session names for checkpoints, or in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/bars-{uuid.uuid4().hex}"


_ONE = "WITH " + BARS + " SELECT '{symbol}' AS symbol, time, open, high, low, close, volume FROM b WHERE symbol = (SELECT min(event_type) FROM events)"
_ALL = f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume FROM b"
COLUMNS = ("symbol", "time", "open", "high", "low", "close", "volume")


def first_symbol(spark, sf_dir):
    b = sources.from_events(spark, sf_dir, "60")
    return b.join(F.broadcast(b.agg(F.min("symbol").alias("symbol"))), "symbol")


@query(f"{_ALL} AND true".replace(" AND true", "") + " WHERE time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'")
def stored_bars(spark, sf_dir):
    """Written as Parquet and read back in a range of time."""
    path = shared_folder(spark)
    sources.write(resample.valid(sources.from_events(spark, sf_dir, "60")), path)
    return sources.read(spark, path, "2024-01-03", "2024-01-20").select(*COLUMNS)


@query(_ONE.format(symbol="CSV"))
def imported_csv(spark, sf_dir):
    """Exported as CSV with ISO times and read again."""
    path = shared_folder(spark)
    sources.export(first_symbol(spark, sf_dir), path, "csv", as_datetime=True)
    return sources.read_csv(spark, path, "CSV").select(*COLUMNS)


@query(_ONE.format(symbol="TEXT"))
def imported_text(spark, sf_dir):
    """Text with tabs and epoch seconds."""
    path = shared_folder(spark)
    out = first_symbol(spark, sf_dir).select(F.unix_seconds("time").alias("Timestamp"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    out.write.option("header", True).option("sep", "\t").csv(path)
    return sources.read_text(spark, path, "TEXT").select(*COLUMNS)


@query(_ONE.format(symbol="JSON"))
def imported_json(spark, sf_dir):
    """JSON records with short names and epoch milliseconds, in a field of one object."""
    path = shared_folder(spark)
    out = first_symbol(spark, sf_dir).select(F.unix_millis("time").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    out.groupBy().agg(F.collect_list(F.struct("*")).alias("data")).write.json(path)
    return sources.read_json(spark, path, "JSON").select(*COLUMNS)


@query(f"""SELECT * FROM (VALUES ('a.ohlcv', 'records'), ('b.json', 'json'), ('c.csv', 'csv'), ('d.txt', 'text')) t(file, kind)""")
def detected_formats(spark, sf_dir):
    rows = [("a.ohlcv", sources.encode_records([])), ("b.json", b'[{"t": 1}]'), ("c.csv", b"time,open\n1,2\n"), ("d.txt", b"time\topen\n1\t2\n")]
    return spark.createDataFrame([(n, sources.detect(n, head)) for n, head in rows], "file string, kind string")


def recorded(df, encode, **_):
    """Bars of each symbol encoded as one binary file, and decoded again."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for symbol, listed in zip(frame["symbol"], frame["bars"], strict=True):
                c = sources.decode_records(encode([(int(b["t"]), b["open"], b["high"], b["low"], b["close"], b["volume"]) for b in listed]))
                yield pd.DataFrame({"symbol": symbol, "t": c["time"], **{n: c[n] for n in COLUMNS[2:]}})

    files = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(F.unix_millis("time").alias("t"), *COLUMNS[2:]))).alias("bars"))
    back = files.mapInPandas(run, "symbol string, t long, open double, high double, low double, close double, volume double")
    return back.select("symbol", F.timestamp_millis("t").alias("time"), *COLUMNS[2:])


@query(_ALL)
def binary_records(spark, sf_dir):
    """Version 2 files keep all digits."""
    return recorded(sources.from_events(spark, sf_dir, "60"), sources.encode_records)


@query(f"WITH {BARS} SELECT symbol, time, {', '.join(f'{c}::FLOAT::DOUBLE AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM b")
def legacy_records(spark, sf_dir):
    """Version 1 files hold float32."""
    return recorded(sources.from_events(spark, sf_dir, "60"), sources.encode_legacy)


class Ramp(sources.Provider):
    """Prices that rise or fall by one an hour."""

    def symbols(self):
        return ["UP", "DOWN"]

    def bars(self, symbol, timeframe, start_ms, end_ms):
        sign = 1 if symbol == "UP" else -1
        for k in range(start_ms // 3_600_000, end_ms // 3_600_000):
            base = 1000.0 + sign * k
            yield k * 3_600_000, base, base + 1, base - 1, base + 0.5, 10.0 * k


@query("""SELECT symbol, to_timestamp(k * 3600)::TIMESTAMP AS time, 1000.0 + s * k AS open, 1000.0 + s * k + 1 AS high, 1000.0 + s * k - 1 AS low, 1000.0 + s * k + 0.5 AS close, 10.0 * k AS volume FROM (VALUES ('UP', 1), ('DOWN', -1)) v(symbol, s), range(2, 30) r(k)""".replace("1000.0 +", "1000.0::DOUBLE +").replace("10.0 * k", "10.0::DOUBLE * k"))
def provided_bars(spark, sf_dir):
    """Bars of a provider through the data source."""
    spark.dataSource.register(sources.BarsSource)
    return spark.read.format("bars").option("provider", "barloom.queries_values:Ramp").option("start", str(2 * 3_600_000)).option("end", str(30 * 3_600_000)).load()


# -- streams ---------------------------------------------------------------------------------------------------------------


def updates(spark, sf_dir):
    """A stream of bar updates in three files: the first half of the bars, each as it opens and as it closes; late and repeated ones with wrong prices; the other half."""
    from barloom.streaming import live

    b = sources.from_events(spark, sf_dir, "60").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("time")))
    forming = b.select("symbol", "time", F.col("open").alias("close"), F.lit(False).alias("is_closed"), "n")
    all_ = b.select("symbol", "time", "close", F.lit(True).alias("is_closed"), "n").unionByName(forming)
    late = b.where("n <= 50").select("symbol", "time", (F.col("close") * 100).alias("close"), F.lit(True).alias("is_closed"), "n")
    path = shared_folder(spark)
    for part in (all_.where("n <= 100"), late, all_.where("n > 100")):
        part.drop("n").coalesce(1).write.mode("append").parquet(path)
    return live.replay(spark, path, spark.read.parquet(path).schema)


@query(f"""WITH {BARS}, c AS (SELECT *, lag(close) OVER ({OVER}) AS c1, lag(close, 2) OVER ({OVER}) AS c2 FROM b) SELECT symbol, time, true AS is_confirmed, round((close + c1 + c2) / 3, 6) AS mean FROM c UNION ALL SELECT symbol, time, false, round((open + c1 + c2) / 3, 6) FROM c""")
def stream_updates(spark, sf_dir):
    """A mean of three closed bars over a stream: forming bars give provisional rows, late and repeated updates none."""
    from barloom.queries import _drained
    from barloom.streaming import live

    found = _drained(live.rolling(updates(spark, sf_dir), 3, "close", lambda v: sum(v) / len(v), "mean"), "append")
    return found.select("symbol", "time", "is_confirmed", F.round("mean", 6).alias("mean"))


@query("SELECT event_type AS symbol, date_trunc('week', ts)::TIMESTAMP AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def stream_weeks(spark, sf_dir):
    """Bars of calendar weeks of a stream of ticks."""
    from barloom.queries import _drained
    from barloom.streaming import live

    ticks = live.replay(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(live.bucket_bars(ticks, "1W", "event_type", "ts", "value"), "complete")


# -- branches and loops ---------------------------------------------------------------------------------------------------


@query(f"""WITH {BARS}, w AS (SELECT symbol, time, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY time) >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS 4 PRECEDING) END AS v FROM b WHERE close > open)
SELECT b.symbol, b.time, round(last_value(w.v IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.time ROWS UNBOUNDED PRECEDING), 6) AS mean_when_up FROM b LEFT JOIN w USING (symbol, time)""")
def conditional_branch(spark, sf_dir):
    """An indicator that runs only on the bars on which its branch is taken."""
    c = hourly(spark, sf_dir)
    up = c.close > c.open
    return c.select(mean_when_up=ta.when_active(up, c.close, lambda v: ta.sma(v, 5)).map(lambda x: F.round(x, 6)))
