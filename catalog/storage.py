"""Bars, scans, merges, payloads, text and function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import dates as dt
from barloom.functions import numeric as num
from barloom.functions import text as tx
from barloom.operators import research as rs
from barloom.operators.asof import fill_missing_keys, latest_per_key
from barloom.operators.calendar import HOLIDAYS, weekday_calendar
from barloom.sources import merge as mg
from barloom.sources import payloads as pl
from barloom.sources import scans as sc
from catalog.registry import query, r, with_ctes

B = ", ".join(r(c, c, 8) for c in ("open", "high", "low", "close")) + ", " + ", ".join(r(c, c, 2) for c in ("volume", "amount"))


def bars2(t):
    """Amounts are sums of cents, so they are rounded to cents before the general rounding."""
    return t.bars().withColumns({c: num.half_up(c, 2) for c in ("volume", "amount")})


@query("bars_a21_rollup", with_ctes("bars") + f"SELECT code, trade_date, {B} FROM bars", 8)
def rollup(t):
    return bars2(t)


@query("bars_s04_market", "WITH m AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) "
       f"SELECT trade_date, {r('amount', 'amount', 2)}, {r('volume', 'volume', 2)}, {r('ln(amount / volume)', 'log_close', 8)} FROM m", 8)
def market(t):
    amount = num.half_up("amount", 2)
    return t.market_bars().select("trade_date", amount.alias("amount"), "volume", F.ln(amount / F.col("volume")).alias("log_close"))


@query("bars_s05_range", with_ctes("bars") + f"SELECT code, trade_date, {r('close', 'close', 8)} FROM bars WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", 8)
def span(t):
    """Scan of a date range: all codes, five years."""
    return sc.bars_between(t.bars(), None, "1996-01-01", "2000-12-31").select("code", "trade_date", "close")


@query("bars_p03_text_dates", with_ctes("bars") + f"SELECT code, trade_date, {r('close', 'close', 8)} FROM bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'", 8)
def text_dates(t):
    df = t.bars().withColumn("d", F.when(F.dayofmonth("trade_date") > 15, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.col("trade_date").cast("string")))
    return sc.by_text_date(df, "d", "1997-01-01", "20001231").select("code", "trade_date", "close")


@query("bars_k02_stale_codes", with_ctes("bars") + "SELECT code, max(trade_date) AS last_date FROM bars GROUP BY 1 HAVING max(trade_date) < DATE '2001-10-20'")
def stale(t):
    return mg.stale_keys(t.bars(), t.sectors(), "2001-10-20")


@query("bars_s26_universe", with_ctes("bars") + "SELECT code, min(trade_date) AS start, max(trade_date) AS \"end\" FROM bars GROUP BY 1")
def universe(t):
    return sc.panel_universe(t.bars())


@query("bars_s16_missing_on_day", with_ctes("bars") + "SELECT DISTINCT code FROM bars WHERE code NOT IN (SELECT code FROM bars WHERE trade_date = DATE '1999-06-01')")
def missing(t):
    return sc.has_bar_on(t.sectors().select("code").join(t.bars().select("code").distinct(), "code", "left_semi"), t.bars(), "1999-06-01", missing=True)


@query("bars_k03_upsert", with_ctes("bars", u="SELECT code, trade_date, close * 2 AS close FROM bars WHERE day(trade_date) = 1 UNION ALL "
       "SELECT code, DATE '2005-01-03', 1 FROM (SELECT DISTINCT code FROM bars)")
       + f"SELECT code, trade_date, {r('close', 'close', 8)} FROM (SELECT code, trade_date, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.code = b.code AND u.trade_date = b.trade_date) UNION ALL SELECT * FROM u)", 8)
def upsert(t):
    base = t.bars().select("code", "trade_date", "close")
    late = base.select("code").distinct().select("code", F.lit("2005-01-03").cast("date").alias("trade_date"), F.lit(1.0).alias("close"))
    updates = base.where(F.dayofmonth("trade_date") == 1).withColumn("close", F.col("close") * 2).unionByName(late)
    return mg.merge_latest(base, updates, ["code", "trade_date"])


@query("bars_k07_fill_update", with_ctes("bars") + f"SELECT code, trade_date, {r('CASE WHEN day(trade_date) = 1 AND volume > 20 THEN -close ELSE close END', 'close', 8)} FROM bars", 8)
def fill_update(t):
    base = t.bars().select("code", "trade_date", "close", "volume")
    updates = base.where(F.dayofmonth("trade_date") == 1).select("code", "trade_date", F.when(F.col("volume") > 20, -F.col("close")).alias("close"))
    return mg.merge_filling(base.drop("volume"), updates, ["code", "trade_date"], ["close"])


@query("bars_s20_fallback", with_ctes("bars") + f"SELECT code, trade_date, {r('CASE WHEN volume >= 20 THEN close ELSE open END', 'price', 8)} FROM bars", 8)
def fallback(t):
    bars = t.bars()
    first = bars.where(F.col("volume") >= 20).select("code", "trade_date", F.col("close").alias("price"))
    return fill_missing_keys(first, bars.select("code", "trade_date", F.col("open").alias("price")), ["code", "trade_date"])


@query("bars_s13_latest_row", with_ctes("bars") + f"SELECT code, trade_date, {r('close', 'close', 8)} FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1", 8)
def latest(t):
    return latest_per_key(t.bars().select("code", "trade_date", "close"), ["code"], ["trade_date"])


@query("source_s17_bar_payload", with_ctes("bars") + "SELECT code, trade_date, " + ", ".join(r(c, c, 8) for c in ("open", "high", "low", "close", "volume"))
       + f", {r('0', 'amount')} FROM bars WHERE code IS NOT NULL", 8)
def bar_payload(t):
    """Bars written as nested feed payloads by Spark, then parsed back."""
    cells = F.array(F.col("trade_date").cast("string"), *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")])
    lists = t.bars().groupBy("code", F.year("trade_date").alias("y")).agg(F.collect_list(cells).alias("rows"))
    text = F.concat(F.lit("kline="), F.to_json(F.struct(F.create_map(F.concat(F.lit("sh"), "code"), F.struct(
        F.when(F.col("y") % 2 == 0, F.col("rows")).alias("qfqday"), F.when(F.col("y") % 2 == 1, F.col("rows")).alias("day"))).alias("data"))))
    return pl.parse_bar_payloads(lists.select(text.alias("payload")))


@query("source_s18_quote_lines", "SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, event_type AS name, CAST(event_id AS VARCHAR) AS quote_time, "
       + ", ".join(r(e, n) for n, e in (("close", "value"), ("open", "value"), ("high", "value + 1"), ("low", "value - 1"), ("volume", "event_id % 100"),
                                        ("pct_change", "event_id % 7"), ("outer_volume", "7"), ("inner_volume", "8"), ("buy_volume_5", "70"), ("sell_volume_5", "120")))
       + " FROM events")
def quote_lines(t):
    v = F.col("value")
    fields = {1: F.col("event_type"), 3: v, 5: v, 7: F.lit(7), 8: F.lit(8), 30: F.col("event_id"), 32: F.col("event_id") % 7, 33: v + 1, 34: v - 1, 37: F.col("event_id") % 100}
    cells = [fields.get(i, F.lit(i)).cast("string") for i in range(45)]
    line = F.concat(F.lit("v_sh"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit('="'), F.concat_ws("~", *cells), F.lit('";'))
    return pl.parse_quote_lines(t.table("events").select(line.alias("payload")))


@query("source_s19_filing_pages", "SELECT 'exchange' AS source, CAST(o_orderkey AS VARCHAR) AS announcement_id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code, '' AS name, "
       "o_orderpriority || ' filing' AS title, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS published_at, 'g' AS org_id FROM orders")
def filing_pages(t):
    item = F.struct(F.col("o_custkey").cast("string").alias("secCode"), F.lit("g").alias("orgId"), F.col("o_orderkey").cast("string").alias("announcementId"),
                    F.concat(F.lit("<em>"), "o_orderpriority", F.lit("</em>  filing ")).alias("announcementTitle"),
                    F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("announcementTime"))
    pages = t.table("orders").groupBy((F.col("o_orderkey") / 30).cast("bigint").alias("page")).agg(F.collect_list(item).alias("announcements"))
    twice = pages.unionByName(pages.where(F.col("page") % 10 == 0))
    out = pl.parse_filing_pages(twice.select(F.to_json(F.struct("announcements")).alias("payload")))
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("source_s21_unify_columns", f"SELECT s_name AS name, {r('s_acctbal', 'balance', 2)}, CAST(NULL AS VARCHAR) AS note FROM supplier", 2)
def unify(t):
    return pl.unify_columns(t.table("supplier"), {"name": ["title", "s_name"], "balance": ["s_acctbal"], "note": ["comment"]}).withColumn("note", F.col("note").cast("string"))


@query("source_s22_weekday_calendar", "SELECT CAST(d AS DATE) AS trade_date, row_number() OVER (ORDER BY d) - 1 AS idx FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6")
def weekdays(t):
    spans = t.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return weekday_calendar(spans, HOLIDAYS)


@query("source_s24_sector_map", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, max(n_name) AS sector FROM supplier, nation WHERE n_nationkey IN (s_nationkey, s_nationkey // 2) GROUP BY 1")
def sector_map(t):
    """Two listings per supplier; the later name wins."""
    s = t.table("supplier").select(F.concat(F.lit("sh"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"),
                                   F.explode(F.array(F.col("s_nationkey"), F.floor(F.col("s_nationkey") / 2).cast("int"))).alias("n_nationkey"))
    return rs.sector_map(s.join(t.table("nation"), "n_nationkey").withColumnRenamed("n_name", "sector"), "sector")


@query("source_a23_index_membership", "SELECT n_name AS index_id, count(*) AS rows, count(DISTINCT s_suppkey) AS unique_codes FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def membership(t):
    return rs.index_membership(t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("index_id"), F.concat(F.lit("sz"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code")))


# ---- news and filings -------------------------------------------------------------------

@query("scan_s06_news_since", with_ctes("news") + "SELECT event_id, code, title FROM news WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def news_since(t):
    return sc.news_since(t.news(), "2024-01-31 00:00:00", 7).select("event_id", "code", "title")


@query("scan_s08_announcements", with_ctes("anns") + "SELECT o_orderkey || '-' || code AS announcement_id, code, title FROM anns WHERE published_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'")
def announcements(t):
    return sc.announcements_between(t.announcements(), start="1997-01-01", end="1999-12-31").select("announcement_id", "code", "title")


@query("scan_s10_latest_signals", with_ctes("signals") + "SELECT id, code, action FROM signals ORDER BY run_ts DESC, id LIMIT 1000")
def latest_signals(t):
    from barloom.operators.signals import latest_signals as ls
    return ls(t.signals(), 1000).select("id", "code", "action")


@query("scan_s11_unresolved", with_ctes("signals") + "SELECT id, code, action FROM signals WHERE action IN ('BUY', 'SELL') ORDER BY run_ts, id LIMIT 500")
def unresolved(t):
    from barloom.operators.signals import unresolved_signals
    return unresolved_signals(t.signals().withColumn("resolved_at", F.lit(None).cast("timestamp"))).select("id", "code", "action")


@query("scan_s14_fresh_sectors", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier WHERE s_nationkey <= 14")
def fresh(t):
    s = t.table("supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"),
                                   (F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(F.col("s_nationkey") * 2 + 1)).alias("updated_at"))
    return sc.fresh_sectors(s, "2024-01-31 00:00:00", 30).select("code")


@query("scan_s15_t03_newest_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")
def newest(t):
    return sc.newest(t.table("orders"), "o_orderdate", 40, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("merge_k05_insert_absent", with_ctes("news") + "SELECT code, title, min(event_id) AS event_id FROM news GROUP BY 1, 2")
def insert_absent(t):
    items = t.news().select("code", "title", "event_id")
    base = items.where(F.col("title") == "view").groupBy("code", "title").agg(F.min("event_id").alias("event_id"))
    return mg.insert_absent(base, items, ["code", "title"], ["event_id"])


COMMANDS = "SELECT user_id, event_type <> 'error' AS is_open, ts, value FROM events"


@query("merge_k06_single_active", f"WITH c AS ({COMMANDS}), s AS (SELECT user_id, arg_max(value, ts) FILTER (WHERE is_open) AS value, max(ts) FILTER (WHERE is_open) AS opened, "
       "max(ts) FILTER (WHERE NOT is_open) AS closed FROM c GROUP BY 1) "
       f"SELECT user_id, {r('value', 'value', 2)}, CASE WHEN closed IS NULL OR closed < opened THEN 'active' ELSE 'closed' END AS status FROM s WHERE opened IS NOT NULL", 2)
def single_active(t):
    e = t.table("events")
    cmd = e.select("user_id", "value", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "close").otherwise("open").alias("command"))
    return mg.fold_commands(cmd, ["user_id"]).select("user_id", "value", "status")


@query("merge_j15_pending_chunks", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CAST(d AS DATE) AS chunk_start, least(CAST(d + INTERVAL 1 MONTH AS DATE) - 1, DATE '2000-11-20') AS chunk_end FROM supplier, "
       "(SELECT unnest(generate_series(TIMESTAMP '2000-01-05', TIMESTAMP '2000-11-20', INTERVAL 1 MONTH)) AS d) WHERE month(d) % 2 = 0")
def pending(t):
    ranges = t.sectors().select("code", F.lit("2000-01-05").cast("date").alias("start"), F.lit("2000-11-20").cast("date").alias("end"))
    tasks = dt.month_chunks(ranges, 1).select("code", "chunk_start", "chunk_end")
    done = tasks.withColumn("status", F.when(F.month("chunk_start") % 2 == 1, "done").otherwise("failed"))
    return mg.pending_chunks(tasks, done)


@query("func_f08_day_chunks", with_ctes("bars", s="SELECT code, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1")
       + "SELECT code, CAST(d AS DATE) AS chunk_start, least(CAST(d AS DATE) + 29, b) AS chunk_end FROM (SELECT code, b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 30 DAY)) AS d FROM s)")
def day_chunks(t):
    return dt.day_chunks(sc.panel_universe(t.bars()), 30).select("code", "chunk_start", "chunk_end")


@query("func_f09_quarter_ends", with_ctes("bars", s="SELECT code, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1",
       q="SELECT code, a, b, last_day(CAST(unnest(generate_series(date_trunc('quarter', CAST(a AS TIMESTAMP)), CAST(b AS TIMESTAMP), INTERVAL 3 MONTH)) + INTERVAL 2 MONTH AS DATE)) AS quarter_end FROM s")
       + "SELECT code, quarter_end FROM q WHERE quarter_end BETWEEN a AND b")
def quarters(t):
    return dt.quarter_ends(sc.panel_universe(t.bars())).select("code", "quarter_end")


# ---- text -------------------------------------------------------------------------------

WORDS = {"earnings": ("report", "profit"), "holding": ("the", "de "), "inquiry": ("qu",), "risk": ("x",)}


def class_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{'|'.join(w)}') THEN '{k}'" for k, w in WORDS.items()) + " ELSE 'other' END"


@query("text_p08_keyword_class", f"SELECT doc_id, {class_sql('text')} AS class FROM documents")
def keyword_class(t):
    return t.table("documents").select("doc_id", tx.keyword_class("text", WORDS).alias("class"))


@query("text_p09_major_news", with_ctes("news") + "SELECT event_id, coalesce(abs(score) >= 0.8, false) OR title = 'purchase' AS major FROM news")
def major(t):
    return t.news().select("event_id", tx.is_major_news("title", "score", words=("purchase",)).alias("major"))


@query("text_f04_plain_text", "SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), 1, 120) AS text FROM pages")
def plain(t):
    return t.table("pages").select("page_id", tx.plain_text("html").alias("text"))


@query("text_f12_item_key", "SELECT doc_id, md5(doc_id || '|' || lang || '|' || text) AS key FROM documents")
def item_key(t):
    return t.table("documents").select("doc_id", tx.item_key("doc_id", "lang", "text").alias("key"))


@query("text_u03_distinct_items", "SELECT md5(text) AS text_key, lang, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def distinct_items(t):
    """Exact duplicates by hash key; a text repeated very often combines map-side."""
    df = t.table("documents").select("doc_id", "lang", F.md5("text").alias("text_key"))
    first = rs.unique_items(df, ["text_key", "lang"], ["doc_id"])
    return first.join(df.groupBy("text_key", "lang").agg(F.count("*").alias("copies")), ["text_key", "lang"])


@query("text_f01_six_digits", "SELECT doc_id, nullif(regexp_extract(text, '(\\d{6})', 1), '') AS code FROM documents")
def six(t):
    return t.table("documents").select("doc_id", tx.six_digits("text").alias("code"))


@query("text_f02_exchange", "SELECT code, CASE WHEN code[1] IN ('6', '5') THEN 'sh' WHEN code[1] IN ('8', '4') THEN 'bj' ELSE 'sz' END AS exchange, "
       "code || '.' || upper(CASE WHEN code[1] IN ('6', '5') THEN 'sh' WHEN code[1] IN ('8', '4') THEN 'bj' ELSE 'sz' END) AS secid FROM (SELECT rpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part)")
def exch(t):
    code = t.table("part").select(F.rpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"))
    return code.select("code", tx.exchange("code").alias("exchange"), tx.exchange_id("code").alias("secid"))


@query("text_f05_comparable_name")
def comparable(t):
    return t.table("documents").select("doc_id", F.md5(tx.comparable_name("text")).alias("key"))


@query("text_f13_last_number", f"SELECT doc_id, {r('greatest(-1, least(1, coalesce(TRY_CAST(trim(text) AS DOUBLE), TRY_CAST(regexp_extract_all(text, chr(45) || chr(63) || $$(?:[0-9]+(?:[.][0-9]+)?|[.][0-9]+)$$)[-1] AS DOUBLE), 0)))', 'score')} FROM documents")
def last_number(t):
    return t.table("documents").select("doc_id", tx.last_number("text").alias("score"))


@query("text_f03_lenient_double", f"SELECT s_suppkey, {r('s_acctbal', 'value', 2)}, {r('0', 'bad')} FROM supplier", 2)
def lenient(t):
    return t.table("supplier").select("s_suppkey", num.lenient_double(F.concat(F.format_number("s_acctbal", 2), F.lit("%"))).alias("value"), num.lenient_double("s_name").alias("bad"))


@query("text_f06_loose_timestamp", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def loose(t):
    k = F.col("o_orderkey") % 3
    txt = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.table("orders").select("o_orderkey", F.to_date(dt.loose_timestamp(txt)).alias("d"))


@query("text_f14_json_items", "SELECT p_partkey, list_slice([p_brand, p_type, p_name], 1, 2) AS items FROM part")
def json_items(t):
    return t.table("part").select("p_partkey", tx.json_items(F.to_json(F.array("p_brand", "p_type", "p_name")), 2).alias("items"))


def _clean_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(upper(replace({c}, 'ß', 'ss')), '<[^>]+>', '', 'g'), '{tx.NAME_NOISE.replace(chr(39), chr(39) * 2)}', '', 'g')"


@query("text_t08_longest_name", f"WITH n AS (SELECT code, {_clean_sql('name')} AS piece FROM (SELECT CAST(item_id AS VARCHAR) AS code, array_to_string(string_split(text, ' ')[1:2], ' ') AS name FROM benchmark)), "
       f"q AS (SELECT conv_id * 1000 + turn AS question_id, regexp_extract('x' || text || 'x', '[^0-9]([0-9]{{6}})[^0-9]', 1) AS direct, {_clean_sql('text')} AS clean FROM conversations) "
       "SELECT question_id, coalesce(nullif(any_value(direct), ''), arg_max(code, printf('%09d', length(piece)) || code)) AS code FROM q LEFT JOIN n ON length(piece) >= 2 AND contains(clean, piece) GROUP BY 1")
def longest_name(t):
    """All turns of the conversations as they are, matched to names (the first two words of each benchmark item)."""
    asked = t.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    names = t.table("benchmark").select(F.col("item_id").cast("string").alias("code"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"))
    return rs.match_names(asked, names)


@query("func_f11_sigmoid", f"SELECT event_id, {r('1 / (1 + exp(-(value - 50) / 10))', 's')} FROM events")
def sigmoid(t):
    return t.table("events").select("event_id", num.sigmoid((F.col("value") - 50) / 10).alias("s"))


@query("func_f16_cashflow_ratio", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('CASE WHEN l_discount <> 0 THEN greatest(-10, least(10, l_tax / l_discount)) END', 'q', 6)} FROM lineitem", 6)
def cashflow(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", num.cashflow_ratio("l_tax", "l_discount").alias("q"))


@query("func_f07_epoch_ms", "SELECT event_id, strftime(date_trunc('millisecond', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM events")
def epoch_ms(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.table("events").select("event_id", F.date_format(dt.epoch_ms_local(ms), "yyyy-MM-dd HH:mm:ss").alias("local_time"))
