"""Output columns, markers, alerts, logs, drawings and the NDJSON record stream."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Plots:
    """Collects the output columns of an indicator, with unique titles and their style metadata."""

    def __init__(self) -> None:
        self.columns: dict[str, object] = {}
        self.meta: list[dict] = []

    def _title(self, title: str) -> str:
        name, n = title, 1
        while name in self.columns:
            n += 1
            name = f"{title} {n}"
        return name

    def add(self, kind: str, title: str, series: object, **style: object) -> str:
        name = self._title(title)
        self.columns[name] = series
        self.meta.append({"kind": kind, "title": name} | {k: v for k, v in style.items() if v is not None})
        return name

    def plot(self, series: object, title: str = "Plot", **style: object) -> str: return self.add("plot", title, series, **style)  # noqa: E704
    def plotshape(self, series: object, title: str = "Shapes", **style: object) -> str: return self.add("shape", title, series, **style)  # noqa: E704
    def plotchar(self, series: object, title: str = "Characters", **style: object) -> str: return self.add("char", title, series, **style)  # noqa: E704
    def plotarrow(self, series: object, title: str = "Arrows", **style: object) -> str: return self.add("arrow", title, series, **style)  # noqa: E704
    def bgcolor(self, color: object, title: str = "Background", **style: object) -> str: return self.add("bgcolor", title, color, **style)  # noqa: E704
    def barcolor(self, color: object, title: str = "Bar colour", **style: object) -> str: return self.add("barcolor", title, color, **style)  # noqa: E704

    def _ohlc(self, kind: str, title: str, o: object, h: object, low: object, c: object, style: dict) -> list[str]:
        return [self.add(kind, f"{title} {part}", s, part=part, **style) for part, s in (("open", o), ("high", h), ("low", low), ("close", c))]

    def plotcandle(self, o: object, h: object, low: object, c: object, title: str = "Candles", **style: object) -> list[str]: return self._ohlc("candle", title, o, h, low, c, style)  # noqa: E704
    def plotbar(self, o: object, h: object, low: object, c: object, title: str = "Bars", **style: object) -> list[str]: return self._ohlc("bar", title, o, h, low, c, style)  # noqa: E704

    def hline(self, price: float, title: str = "", **style: object) -> int:
        self.meta.append({"kind": "hline", "price": price, "title": title} | style)
        return len(self.meta) - 1

    def fill(self, first: object, second: object, **style: object) -> None:
        self.meta.append({"kind": "fill", "between": [first, second]} | style)

    def alertcondition(self, *_: object, **__: object) -> None:
        """Accepted without effect."""


def alerts(df: DataFrame, condition: Column, message: Column, freq: str = "once_per_bar", key: str = "symbol", time: str = "time") -> DataFrame:
    """One row per bar on which the condition holds; ``all`` keeps every row, ``once`` the first of a symbol."""
    hit = df.where(F.coalesce(condition, F.lit(False))).select(key, time, message.alias("message"))
    if freq == "all":
        return hit
    by = [key] if freq == "once" else [key, time]
    return hit.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(time, "message"))).where("__n = 1").drop("__n")


def log(df: DataFrame, level: str, message: Column, key: str = "symbol", time: str = "time") -> DataFrame:
    """Log rows: key, time, level (INFO, WARNING, ERROR) and message with the bar's time before it."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return df.select(key, time, F.lit(level.upper()).alias("level"), F.concat(F.lit("["), stamp, F.lit("] "), message).alias("message"))


#: The drawing families and the attributes that can be set and read.
FAMILIES = {
    "label": ("x", "y", "text", "color", "style", "textcolor", "size", "textalign", "text_font_family", "text_formatting", "tooltip", "xloc", "yloc", "point"),
    "line": ("x1", "y1", "x2", "y2", "color", "style", "width", "extend", "xloc"),
    "box": ("left", "top", "right", "bottom", "bgcolor", "border_color", "border_style", "border_width", "extend", "text", "text_color", "text_font_family", "text_formatting", "text_halign", "text_size", "text_valign", "text_wrap", "xloc"),
    "linefill": ("line1", "line2", "color"),
    "polyline": ("points", "curved", "closed", "xloc", "line_color", "fill_color", "line_style", "line_width"),
    "table": ("position", "columns", "rows", "bgcolor", "border_color", "border_width", "frame_color", "frame_width"),
    "cell": ("text", "width", "height", "text_color", "text_halign", "text_valign", "text_size", "bgcolor", "tooltip", "text_font_family", "text_formatting", "merged_into"),
}
EVENT = "family string, symbol string, id string, seq long, op string, attrs map<string,string>"


def create(df: DataFrame, family: str, id_: Column, seq: Column, **attrs: Column) -> DataFrame:
    """Create events of a drawing family, one per row."""
    return _event(df, family, id_, seq, "new", attrs)


def update(df: DataFrame, family: str, id_: Column, seq: Column, **attrs: Column) -> DataFrame:
    """Attribute changes; rows whose id is null are ignored."""
    return _event(df.where(id_.isNotNull()), family, id_, seq, "set", attrs)


def delete(df: DataFrame, family: str, id_: Column, seq: Column) -> DataFrame:
    return _event(df.where(id_.isNotNull()), family, id_, seq, "delete", {})


def copy(events: DataFrame, family: str, id_: str, new_id: str, seq: int) -> DataFrame:
    """A create event with the attributes that an object has at ``seq``."""
    return live(events.where((F.col("id") == id_) & (F.col("seq") <= seq)), family).select("family", "symbol", F.lit(new_id).alias("id"), F.lit(seq).cast("long").alias("seq"), F.lit("new").alias("op"), "attrs")


def copied(events: DataFrame, family: str, wanted: DataFrame) -> DataFrame:
    """Create events of copies: ``wanted`` has id, new_id and seq; a copy has the attributes that the object has at that moment."""
    w = wanted.select("id", "new_id", F.col("seq").cast("long").alias("__at"))
    before = events.where(F.col("family") == family).join(w, "id").where(F.col("seq") <= F.col("__at"))
    objects = live(before.select("family", "symbol", F.col("new_id").alias("id"), "seq", "op", "attrs"), family)
    return objects.drop("seq").join(w.select(F.col("new_id").alias("id"), F.col("__at").alias("seq")), "id").select("family", "symbol", "id", "seq", F.lit("new").alias("op"), "attrs")


#: The attributes that a place sets, by family and corner (the first one: a label's only place, a box's left top).
CORNERS = {("label", "first"): ("x", "y"), ("line", "first"): ("x1", "y1"), ("line", "second"): ("x2", "y2"), ("box", "first"): ("left", "top"), ("box", "second"): ("right", "bottom")}


def set_place(df: DataFrame, family: str, id_: Column, seq: Column, x: Column | None = None, y: Column | None = None, corner: str = "first", point: Column | None = None) -> DataFrame:
    """Both coordinates of a place at once, from two values or from a chart point (its index, or else its time)."""
    across, up = CORNERS[family, corner]
    if point is not None:
        x, y = F.coalesce(point["index"], point["time"]), point["price"]
    return update(df, family, id_, seq, **{across: x, up: y})


def merge_cells(df: DataFrame, table_id: Column, start_column: int, start_row: int, end_column: int, end_row: int, seq: Column) -> DataFrame:
    """Marks all cells of a rectangle but its first as merged into that one."""
    first = F.concat_ws("/", table_id, F.lit(str(start_column)), F.lit(str(start_row)))
    places = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c in range(start_column, end_column + 1) for r in range(start_row, end_row + 1) if (c, r) != (start_column, start_row)))
    inside = df.select("*", first.alias("__first"), F.explode(places).alias("__place"))
    return cell(inside, table_id, F.col("__place.c"), F.col("__place.r"), seq, merged_into=F.col("__first"))


def cell(df: DataFrame, table_id: Column, column: Column, row: Column, seq: Column, **attrs: Column) -> DataFrame:
    """Set a table's cell; its id is that of the table with the place."""
    return _event(df, "cell", F.concat_ws("/", table_id, column.cast("string"), row.cast("string")), seq, "set", attrs)


def clear_cells(df: DataFrame, table_id: Column, column: Column, row: Column, seq: Column) -> DataFrame:
    return _event(df, "cell", F.concat_ws("/", table_id, column.cast("string"), row.cast("string")), seq, "delete", {})


def _event(df: DataFrame, family: str, id_: Column, seq: Column, op: str, attrs: dict[str, Column]) -> DataFrame:
    if bad := set(attrs) - set(FAMILIES[family]):
        raise ValueError(f"{family} has no {', '.join(sorted(bad))}")
    values = F.create_map(*(x for k, v in attrs.items() for x in (F.lit(k), v.cast("string")))) if attrs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(family).alias("family"), F.col("symbol").cast("string").alias("symbol"), id_.cast("string").alias("id"), seq.cast("long").alias("seq"), F.lit(op).alias("op"), values.alias("attrs"))


def live(events: DataFrame, family: str, most: int | None = None) -> DataFrame:
    """The objects of a family that are left: per attribute the latest value, none for deleted ones; the newest ``most`` of a symbol."""
    mine = events.where(F.col("family") == family)
    last = mine.groupBy("symbol", "id").agg(F.min("seq").alias("created"), F.max_by("op", "seq").alias("last_op"))
    values = mine.select("symbol", "id", "seq", F.explode("attrs").alias("k", "v")).groupBy("symbol", "id", "k").agg(F.max_by("v", "seq").alias("v"))
    attrs = values.groupBy("symbol", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    left = last.where("last_op <> 'delete'").join(attrs, ["symbol", "id"], "left").withColumn("family", F.lit(family))
    if most is not None:
        left = left.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("created").desc(), "id"))).where(F.col("__n") <= most).drop("__n")
    return left.select("family", "symbol", "id", F.col("created").alias("seq"), "attrs")


def attribute(objects: DataFrame, name: str) -> Column:
    """Read an attribute of live objects."""
    return F.try_element_at(objects["attrs"], F.lit(name))


def line_price(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """Price of a line at a bar, beyond its ends too."""
    return y1 + F.try_divide((y2 - y1) * (x - x1), x2 - x1)


def chart_point(index: Column | None = None, time: Column | None = None, price: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((index if index is not None else none.cast("long")).alias("index"), (time if time is not None else none.cast("long")).alias("time"), (price if price is not None else none.cast("double")).alias("price"))


def finite_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON object of columns, numbers that are not finite as null."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(f"`{c}`")) == float("inf")), None).otherwise(F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    return F.to_json(F.struct(*(clean(c).alias(c) for c in columns)), {"ignoreNullFields": "false"})


def ndjson(df: DataFrame, plots: Plots, colors: tuple[str, ...] = (), key: str = "symbol", time: str = "time") -> DataFrame:
    """Records hdr, meta, bar and end as lines (columns symbol, seq, value), in order within a symbol; colours only where they change."""
    names = [c for c in df.columns if c not in (key, time)]
    w = Window.partitionBy(key).orderBy(time)
    shown = df.withColumns({c: F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.col(c)) for c in colors}) if colors else df
    bar = shown.select(F.col(key).alias("symbol"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.lit('{"type":"bar","time":'), F.unix_millis(time).cast("string"), F.lit(',"values":'), finite_json(shown, names), F.lit("}")).alias("value"))
    symbols = df.select(F.col(key).alias("symbol")).distinct()
    line = lambda n, v: symbols.select("symbol", F.lit(n).cast("long").alias("seq"), F.lit(json.dumps(v)).alias("value"))
    ends = symbols.select("symbol", F.lit(2**62).cast("long").alias("seq"), F.lit('{"type": "end"}').alias("value"))
    return reduce(DataFrame.unionByName, [line(-1, {"type": "hdr", "version": 1}), line(0, {"type": "meta", "plots": plots.meta}), bar, ends])
