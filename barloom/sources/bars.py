"""Reading and writing bars: Parquet, delimited text, JSON, the driver tables, and the binary record format."""

from __future__ import annotations

import importlib
import re
import struct
from collections.abc import Iterator
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.functions.na import normalise
from barloom.operators.resample import ticks_to_bars

PRICES = ("open", "high", "low", "close")
SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, volume double"
#: Names under which a column is looked for, in lower case.
ALIASES = {
    "time": ("timestamp", "time", "date", "datetime", "t", "ts", "unix", "epoch"),
    "open": ("open", "o", "openprice"),
    "high": ("high", "h", "highprice"),
    "low": ("low", "l", "lowprice"),
    "close": ("close", "c", "closeprice", "last"),
    "volume": ("volume", "v", "vol", "amount", "quantity"),
}
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyyMMdd HHmmss", "yyyyMMdd HH:mm:ss", "yyyyMMdd")


def parsed_time(c: Column, timezone: str = "UTC") -> Column:
    """Timestamp of epoch seconds or milliseconds (by size), or of date text; text without an offset is in ``timezone``."""
    number = c.try_cast("double")
    epoch = F.when(F.abs(number) >= 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull() & (F.length(c.cast("string")) >= 9), F.timestamp_seconds(number))
    zoned = F.when(c.cast("string").rlike("(Z|[+-]\\d\\d:?\\d\\d)$"), F.coalesce(F.try_to_timestamp(c.cast("string")), F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))))
    plain = F.coalesce(*(F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in FORMATS), F.try_to_timestamp(c.cast("string")))
    return F.coalesce(epoch, zoned, plain if timezone == "UTC" else F.to_utc_timestamp(plain, timezone))


def _found(df: DataFrame, name: str) -> str | None:
    by_lower = {re.sub(r"[^a-z]", "", c.lower()): c for c in df.columns}
    return next((by_lower[a] for a in ALIASES[name] if a in by_lower), None)


def shaped(df: DataFrame, symbol: str, timezone: str = "UTC", mapping: dict[str, str] | None = None) -> DataFrame:
    """Raw columns as bars, in whatever case and order they come; other columns go to the map ``extra``."""
    found = {n: (mapping or {}).get(n) or _found(df, n) for n in ALIASES}
    date = next((c for c in df.columns if c.lower() == "date"), None)
    clock = next((c for c in df.columns if c.lower() == "time"), None)
    if lacking := [n for n in PRICES if not found[n]]:
        raise ValueError(f"no column for {', '.join(lacking)}")
    if date and clock and not (mapping or {}).get("time"):
        time = parsed_time(F.concat_ws(" ", F.col(f"`{date}`").cast("string"), F.col(f"`{clock}`").cast("string")), timezone)
    else:
        time = parsed_time(F.col(f"`{found['time']}`"), timezone)
    number = lambda n: F.col(f"`{found[n]}`").try_cast("double").alias(n)
    used = {*found.values(), date, clock}
    extra = [c for c in df.columns if c not in used]
    more = F.create_map(*(x for c in extra for x in (F.lit(c), F.col(f"`{c}`").cast("string")))) if extra else F.create_map().cast("map<string,string>")
    volume = number("volume") if found["volume"] else F.lit(0.0).alias("volume")
    return normalise(df.select(F.lit(symbol).alias("symbol"), time.alias("time"), *map(number, PRICES), volume, more.alias("extra")))


def read_csv(spark: SparkSession, path: str, symbol: str, timezone: str = "UTC", **options: Any) -> DataFrame:
    return shaped(spark.read.csv(path, header=True, inferSchema=False, **options), symbol, timezone)


def read_text(spark: SparkSession, path: str, symbol: str, timezone: str = "UTC") -> DataFrame:
    """Delimited text with a header; the delimiter is the one of tab, semicolon and bar that the first line has most of."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    sep = max("\t;|,", key=line.count)
    return read_csv(spark, path, symbol, timezone, sep=sep)


def read_json(spark: SparkSession, path: str, symbol: str, records: str | None = None, mapping: dict[str, str] | None = None, timezone: str = "UTC") -> DataFrame:
    """A list of records, or one wrapped in a field."""
    df = spark.read.json(path, multiLine=True)
    if records is None and not any(_found(df, n) for n in PRICES):
        records = next((c for c, t in df.dtypes if t.startswith("array<struct")), None)
    if records:
        df = df.select(F.explode(records).alias("r")).select("r.*")
    return shaped(df, symbol, timezone, mapping)


def detect(path: str, head: bytes) -> str:
    """Format of a file by its first bytes: records, legacy, json, csv or text."""
    if head.startswith(MAGIC):
        return "records"
    text = head.decode("utf-8", "replace").lstrip()
    if text[:1] in "[{":
        return "json"
    line = text.splitlines()[0] if text else ""
    if "," in line and re.search("[a-z]", line, re.I):
        return "csv"
    if any(c in line for c in "\t;|"):
        return "text"
    return "legacy"


def guess_symbol(path: str) -> tuple[str, str]:
    """Symbol and kind (crypto, forex, stock) from a file name."""
    stem = re.sub(r"\.[a-z0-9]+$", "", path.rsplit("/", 1)[-1], flags=re.I)
    name = re.split(r"[,_ ]", re.sub(r"^[a-z]+[_:]", "", stem, flags=re.I))[0].upper().replace("-", "").replace("/", "")
    currencies = {"USD", "EUR", "JPY", "GBP", "CHF", "AUD", "CAD", "NZD"}
    if len(name) == 6 and name[:3] in currencies and name[3:] in currencies:
        return name, "forex"
    if re.search("(USDT|USDC|BTC|ETH|BUSD)$", name) or name[:3] in ("BTC", "ETH"):
        return name, "crypto"
    return name, "stock"


def write(bars: DataFrame, path: str) -> None:
    """Parquet, one directory per symbol, sorted by time so that ranges of time prune row groups."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "time").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored bars in an inclusive range of time, pushed down to the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("time") <= F.lit(end).cast("timestamp"))
    return df


def export(bars: DataFrame, path: str, fmt: str = "csv", as_datetime: bool = False) -> None:
    """CSV with a header or JSON lines, time as epoch seconds or ISO text."""
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ssXXX") if as_datetime else F.unix_seconds("time")
    out = bars.select("symbol", time.alias("time"), *PRICES, "volume").sortWithinPartitions("symbol", "time")
    out.write.mode("overwrite").option("header", True).format(fmt).save(path)


def from_events(spark: SparkSession, sf_dir: str, timeframe: str = "60") -> DataFrame:
    """Bars of ``events``: one symbol per event type, prices are values, volume their number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    return ticks_to_bars(e, timeframe, "event_type", "ts", "value", order=F.col("event_id"))


def from_lineitem(spark: SparkSession, sf_dir: str, timeframe: str = "1D") -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_shipdate").cast("timestamp").alias("t"), "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber")
    return ticks_to_bars(li, timeframe, "l_returnflag", "t", "l_extendedprice", "l_quantity", order=F.col("l_orderkey") * 16 + F.col("l_linenumber"))


def from_orders(spark: SparkSession, sf_dir: str, timeframe: str = "1D") -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("ORDERS").alias("s"), F.col("o_orderdate").cast("timestamp").alias("t"), "o_totalprice", "o_orderkey")
    return ticks_to_bars(o, timeframe, "s", "t", "o_totalprice", order=F.col("o_orderkey"))


def map_symbols(bars: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Symbols renamed by a small table given as a dictionary."""
    if not mapping:
        return bars
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return bars.withColumn("symbol", F.coalesce(F.try_element_at(m, F.col("symbol")), F.col("symbol")))


# -- the binary record format --------------------------------------------------------------------------------------------

#: Fixed values of the format: magic, header, column descriptor, record of version 1, roles of columns, types.
MAGIC = b"\x89PYN\r\n\x1a\n"
HEADER = "<8sHHIIHHQqqIB3xII"
DESCRIPTOR = "<BBBxH18s"
LEGACY_RECORD = "<Ifffff"
ROLES = {0: "time", 1: "open", 2: "high", 3: "low", 4: "close", 5: "volume"}
DTYPES = {2: "<i8", 5: "<f4", 6: "<f8"}
ABSOLUTE = 255


def decode_records(data: bytes) -> dict[str, Any]:
    """Arrays of a file's columns: time (epoch ms), prices, volume, and custom columns by name; either version."""
    import numpy as np

    if not data.startswith(MAGIC):
        raw = np.frombuffer(data, np.dtype([("time", "<u4"), *((n, "<f4") for n in (*PRICES, "volume"))]), len(data) // struct.calcsize(LEGACY_RECORD))
        raw = raw[raw["volume"] >= 0]  # a negative volume marks a gap
        out = {n: raw[n].astype(np.float64) for n in (*PRICES, "volume")}
        return {"time": raw["time"].astype(np.int64) * 1000} | out
    _, major, _, header, record, columns, _, total, *_ = struct.unpack_from(HEADER, data)
    if major != 2:
        raise ValueError(f"unknown version {major}")
    fields = []
    for k in range(columns):
        role, dtype, base, offset, name = struct.unpack_from(DESCRIPTOR, data, struct.calcsize(HEADER) + k * struct.calcsize(DESCRIPTOR))
        fields.append((ROLES.get(role) or name.rstrip(b"\0").decode() or f"column{k}", DTYPES[dtype], base, offset))
    kind = np.dtype({"names": [f"c{k}" for k in range(columns)], "formats": [f[1] for f in fields], "offsets": [f[3] for f in fields], "itemsize": record})
    raw = np.frombuffer(data, kind, total, header)
    whole = lambda k: raw[f"c{k}"].astype(np.int64 if fields[k][1] == "<i8" else np.float64)
    out = {}
    for k, (name, _, base, _) in enumerate(fields):
        out[name] = whole(k) if base == ABSOLUTE else whole(base) + whole(k)
    return out


def encode_records(bars: list[tuple[int, float, float, float, float, float]], seconds: int = 60) -> bytes:
    """A version 2 file of (time ms, open, high, low, close, volume) with absolute float64 prices."""
    import numpy as np

    names = [(role, 2 if role == 0 else 6) for role in range(6)]
    record = 8 * len(names)
    header = struct.calcsize(HEADER) + struct.calcsize(DESCRIPTOR) * len(names)
    first, last = (bars[0][0], bars[-1][0]) if bars else (0, 0)
    head = struct.pack(HEADER, MAGIC, 2, 1, header, record, len(names), 0, len(bars), first, last, max(1, seconds // 60), 2, 0, 0)
    described = b"".join(struct.pack(DESCRIPTOR, role, dtype, ABSOLUTE, 8 * role, ROLES[role].encode()) for role, dtype in names)
    kind = np.dtype([("t", "<i8"), *((n, "<f8") for n in (*PRICES, "volume"))])
    return head + described + np.array(bars, kind).tobytes()


def encode_legacy(bars: list[tuple[int, float, float, float, float, float]]) -> bytes:
    """A version 1 file of (time ms, open, high, low, close, volume): whole seconds and float32."""
    return b"".join(struct.pack(LEGACY_RECORD, t // 1000, *values) for t, *values in bars)


def read_records(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars of binary files through Spark's own file access; the symbol is the file's name."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = decode_records(content.as_py())
                keep = np.ones(len(c["time"]), bool)
                if start_ms is not None:
                    keep &= c["time"] >= start_ms
                if end_ms is not None:
                    keep &= c["time"] <= end_ms
                symbol = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                arrays = [pa.array([symbol] * int(keep.sum())), pa.array(c["time"][keep] * 1000, pa.timestamp("us", "UTC"))]
                arrays += [pa.array(x := c[n][keep], mask=np.isnan(x)) for n in (*PRICES, "volume")]
                yield pa.RecordBatch.from_arrays(arrays, names=["symbol", "time", *PRICES, "volume"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


class Provider:
    """Where bars come from: subclasses give the symbols, their metadata and ``bars(symbol, timeframe, start_ms, end_ms)``."""

    def symbols(self) -> list[str]:
        raise NotImplementedError

    def symbol_info(self, symbol: str) -> dict[str, Any]:
        return {"ticker": symbol}

    def bars(self, symbol: str, timeframe: str, start_ms: int, end_ms: int) -> Iterator[tuple]:
        raise NotImplementedError


PROVIDERS: dict[str, type[Provider]] = {}


def register_provider(name: str, kind: type[Provider]) -> None:
    """Make a provider known to this process; workers find those that are named by ``module:class`` or installed as entry points."""
    PROVIDERS[name] = kind


def find_provider(name: str) -> type[Provider]:
    """A registered provider, one named by ``module:class``, or one that an installed package offers under ``barloom.providers``."""
    if name in PROVIDERS:
        return PROVIDERS[name]
    if ":" in name:
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)
    for entry in entry_points(group="barloom.providers"):
        if entry.name == name:
            return entry.load()
    raise ValueError(f"there is no provider {name!r}")


class BarsPartition(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class BarsReader(DataSourceReader):
    def __init__(self, provider: Provider, options: dict[str, str]):
        self.provider, self.options = provider, options

    def partitions(self) -> list[BarsPartition]:
        wanted = self.options.get("symbols")
        return [BarsPartition(s) for s in (wanted.split(",") if wanted else self.provider.symbols())]

    def read(self, partition: BarsPartition) -> Iterator[tuple]:
        import datetime as dt

        o = self.options
        for t, *values in self.provider.bars(partition.symbol, o.get("timeframe", "60"), int(o.get("start", 0)), int(o.get("end", 1 << 62))):
            yield (partition.symbol, dt.datetime.fromtimestamp(t / 1000, dt.UTC), *values)


class BarsSource(DataSource):
    """``spark.read.format("bars").option("provider", name)``: one partition per symbol."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> BarsReader:
        return BarsReader(find_provider(self.options["provider"])(), dict(self.options))
