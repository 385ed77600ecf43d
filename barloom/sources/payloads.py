"""Landed feed payloads to canonical rows. Fetching is not part of this library: files are read
as text or JSON, so the parse runs in parallel next to the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from barloom.functions.dates import epoch_ms_local
from barloom.functions.numeric import lenient_double
from barloom.functions.text import clean_title, pad_code

# Places of the quote fields in a '~'-separated quote line.
QUOTE_FIELDS = {"name": 1, "close": 3, "open": 5, "outer_volume": 7, "inner_volume": 8, "quote_time": 30,
                "pct_change": 32, "high": 33, "low": 34, "volume": 37}
BID_SIZES, ASK_SIZES, MIN_FIELDS = (10, 12, 14, 16, 18), (20, 22, 24, 26, 28), 40

_ROWS = ArrayType(ArrayType(StringType()))
_BAR_PAYLOAD = StructType([StructField("data", MapType(StringType(), StructType([
    StructField("qfqday", _ROWS), StructField("day", _ROWS)])))])
_FILING_PAGE = StructType([StructField("announcements", ArrayType(StructType([
    StructField("secCode", StringType()), StructField("secName", StringType()), StructField("orgId", StringType()),
    StructField("announcementId", StringType()), StructField("announcementTitle", StringType()),
    StructField("announcementTime", StringType())])))])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "payload")


def parse_bar_payloads(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Nested bar payloads: per instrument an adjusted list, else the plain list, of positional
    [date, open, close, high, low, volume]. Short or unreadable rows are skipped."""
    text = F.regexp_extract(F.col(col), r"(?s)(\{.*\})", 1)
    by_id = payloads.select(F.explode(F.from_json(text, _BAR_PAYLOAD)["data"]).alias("id", "lists"))
    rows = F.when(F.size("lists.qfqday") > 0, F.col("lists.qfqday")).otherwise(F.col("lists.day"))
    bars = by_id.select("id", F.explode(rows).alias("r")).where(F.size("r") >= 6)

    def at(i: int) -> Column:
        return F.col("r")[i].try_cast("double")

    return bars.select(
        F.expr("substring(id, 3)").alias("code"), F.to_date(F.try_to_timestamp(F.col("r")[0], F.lit("yyyy-MM-dd"))).alias("trade_date"),
        at(1).alias("open"), at(3).alias("high"), at(4).alias("low"), at(2).alias("close"), at(5).alias("volume"),
        F.lit(0.0).alias("amount")).dropna()


def parse_quote_lines(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Lines ``v_<id>="a~b~..."``; short lines and unreadable prices are skipped."""
    pattern = r'v_(\w+)="([^"]+)"'
    df = payloads.select(F.regexp_extract(col, pattern, 1).alias("id"),
                         F.split(F.regexp_extract(col, pattern, 2), "~").alias("f"))
    df = df.where((F.length("id") >= 4) & (F.size("f") >= MIN_FIELDS))

    def strict(name: str) -> Column:
        raw = F.col("f")[QUOTE_FIELDS[name]]
        return F.when(raw == "", 0.0).otherwise(raw.try_cast("double"))

    def loose(i: int) -> Column:
        return lenient_double(F.col("f")[i])

    out = df.select(
        F.expr("substring(id, 3)").alias("code"), F.trim(F.col("f")[QUOTE_FIELDS["name"]]).alias("name"),
        *[strict(n).alias(n) for n in ("open", "high", "low")], loose(QUOTE_FIELDS["close"]).alias("close"),
        *[strict(n).alias(n) for n in ("volume", "pct_change")],
        F.col("f")[QUOTE_FIELDS["quote_time"]].alias("quote_time"),
        *[loose(QUOTE_FIELDS[n]).alias(n) for n in ("outer_volume", "inner_volume")],
        sum((loose(i) for i in BID_SIZES), F.lit(0.0)).alias("buy_volume_5"),
        sum((loose(i) for i in ASK_SIZES), F.lit(0.0)).alias("sell_volume_5"))
    return out.dropna(subset=["open", "high", "low", "volume", "pct_change"])


def parse_filing_pages(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Announcement pages; rows without code, id or time are dropped, one row per (source, id).
    Times are epoch milliseconds, shown on the exchange's wall clock."""
    items = payloads.select(F.explode(F.from_json(col, _FILING_PAGE)["announcements"]).alias("a")).select("a.*")
    rows = items.select(
        F.lit("exchange").alias("source"), F.col("announcementId").alias("announcement_id"),
        pad_code(F.nullif(F.trim("secCode"), F.lit(""))).alias("code"), F.coalesce("secName", F.lit("")).alias("name"),
        clean_title("announcementTitle").alias("title"),
        epoch_ms_local(F.col("announcementTime").try_cast("bigint")).alias("published_at"),
        F.coalesce("orgId", F.lit("")).alias("org_id"))
    return rows.dropna(subset=["announcement_id", "code", "published_at"]).dropDuplicates(["source", "announcement_id"])


def unify_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename: for each wanted column the first candidate present (null when none is)."""
    out = []
    for name, options in candidates.items():
        found = next((o for o in options if o in df.columns), None)
        out.append(F.col(f"`{found}`").alias(name) if found else F.lit(None).alias(name))
    return df.select(*out)
