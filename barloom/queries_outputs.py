"""Registered queries of drawings and other outputs: every attribute of every family is set, changed and read.

The SQL states what must be left after creating, changing, copying and deleting objects; it knows nothing of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import plots
from barloom.queries import BARS, OVER, hourly, last, query, table


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per supplier: its nation is the symbol, its key the number."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("k"))


def changing(family: str):
    """All attributes of a family: created for each supplier, changed for the even ones, deleted for multiples of five, copied for multiples of seven."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, names, k = owners(spark, sf_dir), plots.FAMILIES[family], F.col("k")
        id_ = F.concat(F.lit(f"{family} "), k.cast("string"))
        values = lambda word: {a: F.concat(F.lit(f"{word} {a} "), k.cast("string")) for a in names}
        events = plots.create(df, family, id_, k * 10, **values("made"))
        events = events.unionByName(plots.update(df.where("k % 2 = 0"), family, id_, k * 10 + 1, **values("changed")))
        events = events.unionByName(plots.update(df.where("k % 3 = 0"), family, F.lit(None).cast("string"), k * 10 + 2, **values("ignored")))
        copies = plots.copied(events, family, df.where("k % 7 = 0").select(id_.alias("id"), F.concat(F.lit("copy of "), id_).alias("new_id"), (k * 10 + 3).alias("seq")))
        events = events.unionByName(copies).unionByName(plots.delete(df.where("k % 5 = 0"), family, id_, k * 10 + 4))
        left = plots.live(events, family)
        newest = plots.live(events, family, 2).select("symbol", "id", F.lit(True).alias("among_newest"))
        read = left.select("symbol", "id", "seq", *(plots.attribute(left, a).alias(a) for a in names))
        return read.join(newest, ["symbol", "id"], "left").withColumn("among_newest", F.coalesce("among_newest", F.lit(False)))

    value = lambda a: f"CASE WHEN k % 2 = 0 THEN 'changed' ELSE 'made' END || ' {a} ' || k AS \"{a}\""
    shown = ", ".join(value(a) for a in plots.FAMILIES[family])
    sql = f"""WITH o AS (SELECT s_nationkey::VARCHAR AS symbol, s_suppkey AS k FROM supplier), r AS (SELECT symbol, '{family} ' || k AS id, k * 10 AS seq, {shown} FROM o WHERE k % 5 <> 0
UNION ALL SELECT symbol, 'copy of {family} ' || k, k * 10 + 3, {shown} FROM o WHERE k % 7 = 0) SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC, id) <= 2 AS among_newest FROM r"""
    run.__name__ = f"drawing_{family}"
    run.__doc__ = changing.__doc__
    return query(sql)(run)


for _family in plots.FAMILIES:
    if _family != "cell":
        changing(_family)


@query("SELECT s_nationkey::VARCHAR AS symbol, s_suppkey AS k, (s_suppkey * 2)::VARCHAR AS x, (s_suppkey * 3)::VARCHAR AS y, (s_suppkey + 1)::VARCHAR AS moved_x, '0.5' AS moved_y, (s_suppkey + 2)::VARCHAR AS point_x, '7.5' AS point_y FROM supplier")
def drawing_label_places(spark, sf_dir):
    """set_xy, set_point, get_x and get_y of labels."""
    df, k = owners(spark, sf_dir), F.col("k")
    id_, at = k.cast("string"), lambda o, n: (plots.attribute(o, "x").alias(f"{n}x"), plots.attribute(o, "y").alias(f"{n}y"))
    made = plots.create(df, "label", id_, k * 10, x=k * 2, y=k * 3)
    moved = made.unionByName(plots.set_place(df, "label", id_, k * 10 + 1, k + 1, F.lit(0.5)))
    pointed = moved.unionByName(plots.set_place(df, "label", id_, k * 10 + 2, point=plots.chart_point(index=k + 2, price=F.lit(7.5))))
    a, b, c = (plots.live(e, "label") for e in (made, moved, pointed))
    a, b, c = a.select("symbol", F.col("id").cast("int").alias("k"), *at(a, "")), b.select("id", *at(b, "moved_")), c.select("id", *at(c, "point_"))
    return a.join(b.select(F.col("id").cast("int").alias("k"), "moved_x", "moved_y"), "k").join(c.select(F.col("id").cast("int").alias("k"), "point_x", "point_y"), "k")


@query("""SELECT s_nationkey::VARCHAR AS symbol, s_suppkey AS k, s_suppkey::VARCHAR AS x1, '1.5' AS y1, (s_suppkey + 10)::VARCHAR AS x2, '6.5' AS y2, 1.5 + 4 * 0.5 AS price_between, 6.5 + 10 * 0.5 AS price_beyond,
(s_suppkey - 1)::VARCHAR AS first_x, '2.25' AS first_y, (s_suppkey + 5)::VARCHAR AS second_x, '9.0' AS second_y FROM supplier""")
def drawing_line_places(spark, sf_dir):
    """set_xy1, set_xy2, set_first_point, set_second_point, their getters and get_price of lines."""
    df, k = owners(spark, sf_dir), F.col("k")
    id_ = k.cast("string")
    events = plots.create(df, "line", id_, k * 10, x1=F.lit(0), y1=F.lit(0), x2=F.lit(1), y2=F.lit(1))
    events = events.unionByName(plots.set_place(df, "line", id_, k * 10 + 1, k, F.lit(1.5), corner="first")).unionByName(plots.set_place(df, "line", id_, k * 10 + 2, k + 10, F.lit(6.5), corner="second"))
    later = events.unionByName(plots.set_place(df, "line", id_, k * 10 + 3, point=plots.chart_point(index=k - 1, price=F.lit(2.25)), corner="first"))
    later = later.unionByName(plots.set_place(df, "line", id_, k * 10 + 4, point=plots.chart_point(index=k + 5, price=F.lit(9.0)), corner="second"))
    now, then = plots.live(events, "line"), plots.live(later, "line")
    number = lambda a: plots.attribute(now, a).cast("double")
    price = lambda x: plots.line_price(number("x1"), number("y1"), number("x2"), number("y2"), x)
    read = now.select("symbol", F.col("id").cast("int").alias("k"), *(plots.attribute(now, a).alias(a) for a in ("x1", "y1", "x2", "y2")), price(F.col("id").cast("int") + 4).alias("price_between"), price(F.col("id").cast("int") + 20).alias("price_beyond"))
    return read.join(then.select(F.col("id").cast("int").alias("k"), *(plots.attribute(then, a).alias(n) for a, n in (("x1", "first_x"), ("y1", "first_y"), ("x2", "second_x"), ("y2", "second_y")))), "k")


@query("""SELECT s_nationkey::VARCHAR AS symbol, s_suppkey AS k, s_suppkey::VARCHAR AS "left", '8.5' AS top, (s_suppkey + 3)::VARCHAR AS "right", '2.5' AS bottom, (s_suppkey * 1000)::VARCHAR AS point_left, '9.5' AS point_top, (s_suppkey * 1000 + 500)::VARCHAR AS point_right, '1.5' AS point_bottom FROM supplier""")
def drawing_box_places(spark, sf_dir):
    """set_lefttop, set_rightbottom, set_top_left_point, set_bottom_right_point and the getters of boxes."""
    df, k = owners(spark, sf_dir), F.col("k")
    id_ = k.cast("string")
    events = plots.create(df, "box", id_, k * 10, left=F.lit(0)).unionByName(plots.set_place(df, "box", id_, k * 10 + 1, k, F.lit(8.5), corner="first")).unionByName(plots.set_place(df, "box", id_, k * 10 + 2, k + 3, F.lit(2.5), corner="second"))
    later = events.unionByName(plots.set_place(df, "box", id_, k * 10 + 3, point=plots.chart_point(time=k.cast("long") * 1000, price=F.lit(9.5)), corner="first"))
    later = later.unionByName(plots.set_place(df, "box", id_, k * 10 + 4, point=plots.chart_point(time=k.cast("long") * 1000 + 500, price=F.lit(1.5)), corner="second"))
    now, then = plots.live(events, "box"), plots.live(later, "box")
    sides = ("left", "top", "right", "bottom")
    read = now.select("symbol", F.col("id").cast("int").alias("k"), *(plots.attribute(now, a).alias(a) for a in sides))
    return read.join(then.select(F.col("id").cast("int").alias("k"), *(plots.attribute(then, a).alias(f"point_{a}") for a in sides)), "k")


_CELL = [a for a in plots.FAMILIES["cell"] if a != "merged_into"]


@query(f"""WITH o AS (SELECT s_nationkey::VARCHAR AS symbol, s_suppkey AS k FROM supplier), c AS (SELECT symbol, k, x.c AS c, y.r AS r FROM o, (VALUES (0), (1), (2)) x(c), (VALUES (0), (1)) y(r))
SELECT symbol, 'table ' || k || '/' || c || '/' || r AS id, {', '.join(f"CASE WHEN r = 1 THEN 'changed' ELSE 'made' END || ' {a} ' || c AS {a}" for a in _CELL)}, CASE WHEN r = 0 AND c = 1 AND k % 2 = 0 THEN 'table ' || k || '/0/0' END AS merged_into FROM c WHERE NOT (c = 2 AND k % 3 = 0)""")
def drawing_table_cells(spark, sf_dir):
    """cell, all cell_set_ functions, merge_cells and clear of tables."""
    df = owners(spark, sf_dir).select("symbol", "k", F.concat(F.lit("table "), F.col("k").cast("string")).alias("t"))
    cells = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r"))
    values = lambda word: {a: F.concat(F.lit(f"{word} {a} "), F.col("c").cast("string")) for a in _CELL}
    at = (F.col("t"), F.col("c"), F.col("r"))
    events = plots.cell(cells, *at, F.lit(1), **values("made"))
    for n, (a, v) in enumerate(values("changed").items()):
        events = events.unionByName(plots.cell(cells.where("r = 1"), *at, F.lit(2 + n), **{a: v}))
    events = events.unionByName(plots.merge_cells(df.where("k % 2 = 0"), F.col("t"), 0, 0, 1, 0, F.lit(50)))
    events = events.unionByName(plots.clear_cells(cells.where("c = 2 AND k % 3 = 0"), *at, F.lit(60)))
    left = plots.live(events, "cell")
    return left.select("symbol", "id", *(plots.attribute(left, a).alias(a) for a in (*_CELL, "merged_into")))


@query(f"""WITH {BARS}, m AS (SELECT *, CASE WHEN n >= 5 THEN avg(close) {last(5)} END AS f FROM b) SELECT symbol, time, f IS NOT NULL AND close > f AS "Shapes", f IS NOT NULL AND close < f AS "Characters", round(close - f, 6) AS "Arrows", CASE WHEN close > open THEN 'green' ELSE 'red' END AS "Background",
CASE WHEN close > open THEN 'lime' ELSE 'maroon' END AS "Bar colour", open AS "Candles open", high AS "Candles high", low AS "Candles low", close AS "Candles close", open AS "Bars open", high AS "Bars high", low AS "Bars low", close AS "Bars close", round(f, 6) AS "Plot", round(f, 6) AS "Plot 2",
'shape,char,arrow,bgcolor,barcolor,candle,candle,candle,candle,bar,bar,bar,bar,plot,plot,hline,fill' AS kinds FROM m""")
def plot_kinds(spark, sf_dir):
    """Every plotting function once; ``kinds`` lists the style records in order."""
    c = hourly(spark, sf_dir)
    from barloom.operators import ta

    f, p = ta.sma(c.close, 5), plots.Plots()
    r = lambda s: s.map(lambda x: F.round(x, 6))
    above, below = f.map(lambda f, c: F.coalesce(c > f, F.lit(False)), c.close), f.map(lambda f, c: F.coalesce(c < f, F.lit(False)), c.close)
    color = lambda a, b: c.close.map(lambda x, o: F.when(x > o, a).otherwise(b), c.open)
    p.plotshape(above, style="triangle")
    p.plotchar(below, char="x")
    p.plotarrow(r(c.close - f))
    p.bgcolor(color("green", "red"))
    p.barcolor(color("lime", "maroon"))
    p.plotcandle(c.open, c.high, c.low, c.close)
    p.plotbar(c.open, c.high, c.low, c.close)
    first, second = p.plot(r(f)), p.plot(r(f), color="blue")
    p.hline(50.0, "middle")
    p.fill(first, second, color="gray")
    p.alertcondition(above, "title", "message")
    return c.select(**p.columns).withColumn("kinds", F.lit(",".join(m["kind"] for m in p.meta)))


_LOG = " UNION ALL ".join(f"SELECT symbol, time, '{level}' AS level, '[' || strftime(time, '%Y-%m-%dT%H:%M:%S') || 'Z] {level.lower()} ' || volume::BIGINT AS message FROM b WHERE n % {m} = 0" for level, m in (("INFO", 3), ("WARNING", 5), ("ERROR", 7)))


@query(f"WITH {BARS} {_LOG}")
def logs(spark, sf_dir):
    """info, warning and error rows."""
    c = hourly(spark, sf_dir)
    df = c.select(keep=("volume",), n=c.bar_index)
    rows = [plots.log(df.where((F.col("n") + 1) % m == 0), level, F.concat(F.lit(f"{level} "), F.col("volume").cast("long").cast("string"))) for level, m in (("info", 3), ("warning", 5), ("error", 7))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH {BARS}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('day', time) ORDER BY time) AS in_day FROM b WHERE close > 60) SELECT symbol, count(*) AS every_bar, count(*) FILTER (WHERE n2 = 1) AS once FROM (SELECT *, row_number() OVER ({OVER}) AS n2 FROM d) GROUP BY symbol""")
def alert_frequencies(spark, sf_dir):
    c = hourly(spark, sf_dir)
    df = c.select(keep=("close",))
    hit = F.col("close") > 60
    count = lambda f: plots.alerts(df, hit, F.lit("above"), f).groupBy("symbol").agg(F.count(F.lit(1)).alias("every_bar" if f == "all" else f))
    return count("all").join(count("once"), "symbol")
