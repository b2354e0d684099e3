"""Feeds, conforming, cleaning and quality (raw text feeds are made from the bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.functions import columns as C
from alphaloom.operators.cross_section import fill_median
from alphaloom.operators.factors import OPTIONAL_INPUTS, with_missing_columns
from alphaloom.operators.joins import first_row
from alphaloom.operators.staging import stage
from alphaloom.session import scratch_path
from alphaloom.sources import conform, quality, readers, sinks
from checks import views as v
from checks.fixtures import r, rounded
from checks.registry import query


def raw_code():
    even = F.concat(F.lit("sh."), (F.col("ts_code") + 600000).cast("string"))
    return F.when(F.col("ts_code") % 2 == 0, even).otherwise(F.concat(F.lit("sz."), F.lpad(F.col("ts_code").cast("string"), 6, "0")))


v.V["v_code"] = """SELECT *, CASE WHEN ts_code % 2 = 0 THEN CAST(ts_code + 600000 AS VARCHAR) || '.SH' ELSE LPAD(CAST(ts_code AS VARCHAR), 6, '0') || '.SZ' END AS code,
  CASE WHEN ts_code % 13 <> 5 THEN close END AS price FROM v_bars"""


def raw_bars(d):
    """Kline feed: all text, an exchange prefix on the code, unreadable closes for some codes."""
    return d.bars().select(
        raw_code().alias("code"),
        F.date_format("trade_date", "yyyy-MM-dd").alias("date"),
        F.when(F.col("ts_code") % 13 != 5, F.col("close").cast("string")).otherwise("n/a").alias("close"),
        F.col("vol").cast("string").alias("volume"),
        F.col("amount").cast("string").alias("amount"),
        F.col("turnover_rate").cast("string").alias("turn"),
    )


def raw_financials(d):
    return d.financials().select(
        raw_code().alias("code"),
        F.date_format("ann_date", "yyyyMMdd").alias("pubDate"),
        F.date_format("end_date", "yyyy-MM-dd").alias("statDate"),
        F.col("roe").cast("string").alias("roeAvg"),
        F.col("netprofitmargin").cast("string").alias("npMargin"),
        F.when(F.col("ts_code") % 2 == 0, F.col("roe").cast("string")).alias("AssetTurnRatio"),
        F.col("netprofitmargin").cast("string").alias("dupontAssetTurn"),
    )


def raw_valuation(d):
    return d.bars().join(d.industry().select("ts_code", "pe_ttm"), "ts_code").select(
        raw_code().alias("code"),
        F.date_format("trade_date", "yyyyMMdd").alias("date"),
        F.col("turnover_rate").cast("string").alias("turn"),
        F.col("pe_ttm").cast("string").alias("peTTM"),
        F.lit("").alias("pbMRQ"),
    )


def raw_members(d):
    return d.industry().select(raw_code().alias("code"), F.coalesce("industry_name", F.lit("none")).alias("stock_name"), (F.col("pe_ttm") / 10).cast("string").alias("weight_pct"))


BARS_SQL = f"SELECT code AS ts_code, trade_date, price AS close, LAG(price) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close, vol, amount, {v.rnd('turnover_rate')} FROM v_code"


def show_bars(df):
    return rounded(df.select("ts_code", "trade_date", "close", "pre_close", "vol", "amount", "turnover_rate"), ["turnover_rate"])


@query("src01_csv_round_trip", "SELECT code AS ts_code, trade_date, price AS close, amount FROM v_code")
def src01(d):
    path = sinks.save_table(raw_bars(d), scratch_path(d.spark, "csv"), fmt="csv")
    back = conform.daily_bars(readers.read_csv(d.spark, path))
    return back.select("ts_code", "trade_date", "close", "amount")


@query("src02_pruned_scan", "SELECT l_suppkey AS ts_code, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def src02(d):
    df = readers.read_table(d.spark, f"{d.dir}/lineitem.parquet", ["l_suppkey", "l_shipdate"]).where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return df.groupBy(F.col("l_suppkey").alias("ts_code")).agg(F.count(F.lit(1)).alias("n"))


v.V["v_bundle"] = """SELECT 'bars' AS table_name, COUNT(*) AS n, COUNT(DISTINCT code) AS codes FROM v_code UNION ALL
SELECT 'constituents', COUNT(*), COUNT(*) FROM supplier UNION ALL SELECT 'financials', COUNT(*), COUNT(DISTINCT ts_code) FROM v_fin UNION ALL SELECT 'valuation', COUNT(*), COUNT(DISTINCT ts_code) FROM v_bars"""


@query("src03_bundle_load", "SELECT * FROM v_bundle")
def src03(d):
    base, names = scratch_path(d.spark, "bundle"), {**readers.REQUIRED, **readers.OPTIONAL}
    raw = {"constituents": raw_members(d), "valuation": raw_valuation(d), "financials": raw_financials(d), "bars": raw_bars(d)}
    for k, df in raw.items():
        sinks.save_table(df, f"{base}/{names[k]}", fmt="csv")
    tables = readers.load_bundle(d.spark, base)
    counts = [t.agg(F.lit(k).alias("table_name"), F.count(F.lit(1)).alias("n"), F.countDistinct("ts_code").alias("codes")) for k, t in sorted(tables.items())]
    return readers.concat_tables(counts)


@query("src04_constituents", "SELECT CASE WHEN ts_code % 2 = 0 THEN CAST(ts_code + 600000 AS VARCHAR) || '.SH' ELSE LPAD(CAST(ts_code AS VARCHAR), 6, '0') || '.SZ' END AS ts_code, COALESCE(industry_name, 'none') AS stock_name, ROUND(pe_ttm / 10, 6) AS weight FROM v_industry")
def src04(d):
    return rounded(conform.constituents(raw_members(d)).select("ts_code", "stock_name", "weight"), ["weight"])


WEIGHT_SQL = """SELECT {day} AS trade_date, '000300.SH' AS index_code, CASE WHEN ts_code % 2 = 0 THEN CAST(ts_code + 600000 AS VARCHAR) || '.SH' ELSE LPAD(CAST(ts_code AS VARCHAR), 6, '0') || '.SZ' END AS con_code,
  ROUND(ts_code / 1e3, 6) AS weight FROM v_member WHERE month {cut}"""


def raw_weights(d, months):
    """Monthly members as an index-weight feed with bare codes, days and numbers as text."""
    code = F.when(F.col("ts_code") % 2 == 0, (F.col("ts_code") + 600000).cast("string")).otherwise(F.lpad(F.col("ts_code").cast("string"), 6, "0"))
    rows = d.membership().where(months)
    return rows.select(F.date_format("month", "yyyyMMdd").alias("trade_date"), F.lit("000300").alias("index_code"), code.alias("con_code"), (F.col("ts_code") / F.lit(1e3)).cast("string").alias("weight"))


@query("src04_index_weights", WEIGHT_SQL.format(day="month", cut="BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"))
def src04b(d):
    return rounded(conform.index_weights(raw_weights(d, "month >= DATE '1995-01-01'"), "1996-01-01", "1997-12-31"), ["weight"])


@query("src04_index_weights_of_one_day", WEIGHT_SQL.format(day="DATE '1998-06-30'", cut="= DATE '1996-03-01'"))
def src04c(d):
    return rounded(conform.index_weights(raw_weights(d, "month = DATE '1996-03-01'"), "1998-01-01", "1998-06-30"), ["weight"])


@query("src05_conform_bars", BARS_SQL)
def src05(d):
    return show_bars(conform.daily_bars(raw_bars(d)))


@query("src06_conform_valuation", f"SELECT code AS ts_code, trade_date, {v.rnd('turnover_rate')}, ROUND(pe_ttm, 6) AS pe_ttm, CAST(NULL AS DOUBLE) AS pb FROM v_code JOIN v_industry USING (ts_code)")
def src06(d):
    return rounded(conform.valuation(raw_valuation(d)).select("ts_code", "trade_date", "turnover_rate", "pe_ttm", "pb"), ["turnover_rate", "pe_ttm"])


@query("src07_conform_financials", f"""SELECT CASE WHEN ts_code % 2 = 0 THEN CAST(ts_code + 600000 AS VARCHAR) || '.SH' ELSE LPAD(CAST(ts_code AS VARCHAR), 6, '0') || '.SZ' END AS ts_code, ann_date, end_date,
{v.rnd('roe')}, ROUND(netprofitmargin, 6) AS netprofit_margin, ROUND(CASE WHEN ts_code % 2 = 0 THEN roe ELSE netprofitmargin END, 6) AS asset_turnover FROM v_fin""")
def src07(d):
    twice = raw_financials(d).unionAll(raw_financials(d))
    return rounded(conform.financials(twice).select("ts_code", "ann_date", "end_date", "roe", "netprofit_margin", "asset_turnover"), ["roe", "netprofit_margin", "asset_turnover"])


@query("src08_minute_bars", "SELECT user_id AS ts_code, ts AS trade_datetime, ROUND(value, 4) AS close FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09 15:00:00'")
def src08(d):
    ev = d.table("events").select(F.col("user_id").alias("ts_code"), F.col("ts").alias("trade_datetime"), F.col("value").alias("close"))
    return conform.minute_bars(ev, "2024-01-03", "2024-01-09 15:00:00").withColumn("close", F.round("close", 4))


@query("src09_benchmark_bars", "SELECT trade_date, ROUND(close, 4) AS close, ROUND(LAG(close) OVER (ORDER BY trade_date), 4) AS pre_close FROM v_bench WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def src09(d):
    raw = d.benchmark().select(F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.col("close").cast("string").alias("close"))
    return rounded(conform.benchmark_bars(raw, "1996-01-01", "1999-12-31").select("trade_date", "close", "pre_close"), ["close", "pre_close"], 4)


@query("src10_macro_series", "SELECT trade_date, ROUND(macro_yoy, 6) + 0.0 AS m2_yoy FROM v_macro WHERE macro_yoy IS NOT NULL AND trade_date BETWEEN DATE '1996-06-01' AND DATE '2000-06-30'")
def src10(d):
    raw = d.macro().select(F.date_format("trade_date", "yyyyMMdd").alias("day"), F.col("macro_yoy").cast("string").alias("v"))
    return rounded(conform.macro_series(raw, "day", "v", "m2_yoy", "1996-06-01", "2000-06-30"), ["m2_yoy"])


v.V["v_sh"] = "SELECT trade_date, SUM(cents) / 1e2 AS sh_amount FROM v_daily WHERE ts_code % 7 = 0 GROUP BY 1"
v.V["v_sz"] = "SELECT trade_date, SUM(cents) / 1e2 AS sz_amount FROM v_daily WHERE ts_code % 7 = 1 GROUP BY 1"


@query("src11_two_channel_flow", """SELECT COALESCE(a.trade_date, b.trade_date) AS trade_date, sh_amount, sz_amount, ROUND(COALESCE(sh_amount, 0) + COALESCE(sz_amount, 0), 2) AS north_money
FROM v_sh a FULL JOIN v_sz b ON a.trade_date = b.trade_date WHERE COALESCE(a.trade_date, b.trade_date) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def src11(d):
    side = lambda k, n: d.daily().where(F.col("ts_code") % 7 == k).groupBy("trade_date").agg((F.sum("cents") / F.lit(100.0)).alias(n))
    return rounded(conform.northbound_flow(side(0, "sh_amount"), side(1, "sz_amount"), "1996-01-01", "1999-12-31"), ["north_money"], 2)


@query("src12_concat_entities", "SELECT ts_code % 4 AS part, COUNT(*) AS n, CAST(SUM(vol) AS BIGINT) AS vol FROM v_bars GROUP BY 1")
def src12(d):
    """One file set per entity group, read back as one multi-path scan."""
    base = scratch_path(d.spark, "parts")
    sinks.save_table(d.bars().withColumn("part", F.col("ts_code") % 4), base, ["part"])
    paths = [f"{base}/part={i}" for i in range(4)]
    return readers.read_table(d.spark, paths).groupBy((F.col("ts_code") % 4).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("vol").cast("long").alias("vol"))


@query("src13_code_date_slice", "SELECT ts_code, trade_date, amount FROM v_bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND ts_code IN (SELECT ts_code FROM v_member WHERE month = DATE '1997-06-01')")
def src13(d):
    members = d.membership().where("month = DATE'1997-06-01'")
    return readers.slice_rows(d.bars(), members, "1997-01-01", "1998-12-31").select("ts_code", "trade_date", "amount")


@query("src15_partitioned_sink", "SELECT STRFTIME(trade_date, '%Y-%m') AS month, COUNT(*) AS n FROM v_bars WHERE trade_date >= DATE '1999-01-01' GROUP BY 1")
def src15(d):
    path = sinks.save_panel(d.bars(), scratch_path(d.spark, "panel"))
    return d.spark.read.parquet(path).where("month >= '1999-01'").groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("src16_append_by_variant", "SELECT 'a' AS variant, COUNT(*) AS n FROM v_bars WHERE trade_date < DATE '1998-01-01' UNION ALL SELECT 'b', COUNT(*) FROM v_bars WHERE trade_date >= DATE '1998-01-01'")
def src16(d):
    path = scratch_path(d.spark, "variants")
    sinks.append_variant(d.bars().where("trade_date < DATE'1998-01-01'"), path, "a")
    sinks.append_variant(d.bars().where("trade_date >= DATE'1998-01-01'"), path, "b")
    return d.spark.read.parquet(path).groupBy(F.col("variant").cast("string").alias("variant")).agg(F.count(F.lit(1)).alias("n"))


@query("src17_json_summary", "SELECT COUNT(*) AS n, COUNT(DISTINCT ts_code) AS codes, MAX(amount) AS top FROM v_bars")
def src17(d):
    one = d.bars().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts_code").alias("codes"), F.max("amount").alias("top"))
    path = sinks.save_summary(one, scratch_path(d.spark, "json"))
    return d.spark.read.schema("n long, codes long, top double").json(path)


@query("src18_quality_summary", """SELECT table_name, measure, ROUND(value, 6) AS value FROM (
  SELECT 'bars' AS table_name, UNNEST(['rows', 'codes', 'turnover_rate_non_null']) AS measure, UNNEST([CAST(COUNT(*) AS DOUBLE), COUNT(DISTINCT ts_code), AVG(CAST(turnover_rate IS NOT NULL AS INT))]) AS value FROM v_bars
  UNION ALL SELECT 'financials', UNNEST(['rows', 'codes', 'roe_non_null']), UNNEST([CAST(COUNT(*) AS DOUBLE), COUNT(DISTINCT ts_code), AVG(CAST(roe IS NOT NULL AS INT))]) FROM v_fin)""")
def src18(d):
    s = stage(quality.bundle_summary({"bars": (d.bars(), ["turnover_rate"]), "financials": (d.financials(), ["roe"])}))
    quality.quality_gate(s)
    return rounded(s, ["value"])


# --- cleaning ------------------------------------------------------------------------------------


@query("cln01_numeric_coercion", "SELECT code, trade_date, price AS close FROM v_code")
def cln01(d):
    rows = raw_bars(d).select(C.security_code(F.col("code")).alias("code"), C.to_date(F.col("date")).alias("trade_date"), C.to_double(F.col("close")).alias("close"))
    return rows


@query("cln02_date_parse", "SELECT ts_code, CASE WHEN ts_code % 9 <> 4 THEN trade_date END AS parsed, STRFTIME(trade_date, '%Y%m%d') AS compact, COUNT(*) AS n FROM v_bars GROUP BY ALL")
def cln02(d):
    text = F.when(F.col("ts_code") % 9 == 4, F.lit("31.12.x")).when(F.col("ts_code") % 2 == 0, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.date_format("trade_date", "yyyy-MM-dd"))
    rows = d.bars().select("ts_code", C.to_date(text).alias("parsed"), F.date_format("trade_date", "yyyyMMdd").alias("compact"))
    return rows.groupBy("ts_code", "parsed", "compact").agg(F.count(F.lit(1)).alias("n"))


CODE_SQL = """SELECT ts_code AS id, CASE WHEN ts_code % 4 = 0 THEN CAST(600000 + ts_code AS VARCHAR) || '.SH' WHEN ts_code % 4 = 1 THEN LPAD(CAST(ts_code AS VARCHAR), 6, '0') || '.SZ'
  WHEN ts_code % 4 = 2 THEN CAST(300000 + ts_code AS VARCHAR) || '.SZ' ELSE CAST(900000 + ts_code AS VARCHAR) END AS code, n FROM (SELECT ts_code, COUNT(*) AS n FROM v_bars GROUP BY 1)"""


def mixed_codes(d):
    """Plain, prefixed, suffixed and unknown codes."""
    i = F.col("ts_code")
    six = lambda base: (i + base).cast("string")
    text = (
        F.when(i % 4 == 0, F.when(i % 8 == 0, six(600000)).otherwise(F.concat(F.lit("sh."), six(600000))))
        .when(i % 4 == 1, F.lpad(i.cast("string"), 6, "0"))
        .when(i % 4 == 2, F.concat(six(300000), F.lit(".SZ")))
        .otherwise(six(900000))
    )
    return d.bars().select(i.alias("id"), text.alias("text")).groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))


@query("cln03_security_code", CODE_SQL)
def cln03(d):
    return mixed_codes(d).select("id", C.security_code(F.col("text")).alias("code"), "n")


@query("cln04_reverse_codes", """SELECT id, CASE WHEN code LIKE '%.SH' THEN 'sh.' ELSE 'sz.' END || code[:6] AS dotted, CASE WHEN code LIKE '%.SH' THEN 'sh' ELSE 'sz' END || code[:6] AS joined, code[:6] AS bare FROM (""" + CODE_SQL + ")")
def cln04(d):
    t = F.col("text")
    return mixed_codes(d).select("id", *[C.exchange_code(t, s).alias(s) for s in ("dotted", "joined", "bare")])


@query("cln05_zero_pad", "SELECT ts_code, CASE WHEN ts_code % 2 = 0 THEN LPAD(CAST(ts_code AS VARCHAR), 6, '0') ELSE '1234567' || ts_code END AS padded, COUNT(*) AS n FROM v_bars GROUP BY ALL")
def cln05(d):
    text = F.when(F.col("ts_code") % 2 == 0, F.concat(F.lit("sz."), F.col("ts_code").cast("string"))).otherwise(F.concat(F.lit("1234567"), F.col("ts_code").cast("string")))
    return d.bars().select("ts_code", C.zero_pad_code(text).alias("padded")).groupBy("ts_code", "padded").agg(F.count(F.lit(1)).alias("n"))


@query("cln06_first_alias", f"SELECT ts_code, ann_date, end_date, {v.rnd('roe')} FROM v_fin")
def cln06(d):
    raw = d.financials().withColumn("roeAvg", F.col("roe").cast("string")).withColumn("roe", F.lit("ignored"))
    return raw.select("ts_code", "ann_date", "end_date", r(conform.first_alias(raw, ("roeAvg", "roe"))).alias("roe"))


@query("cln07_first_non_null", "SELECT ts_code, trade_date, ROUND(COALESCE(turnover_rate, vol / 100), 6) AS rate FROM v_bars")
def cln07(d):
    return d.bars().select("ts_code", "trade_date", r(F.coalesce("turnover_rate", F.col("vol") / 100)).alias("rate"))


@query("cln08_absent_columns", "SELECT ts_code, COUNT(*) AS n, 0 AS pb, COUNT(turnover_rate) AS turnover_rate FROM v_bars GROUP BY 1")
def cln08(d):
    full = with_missing_columns(d.bars(), OPTIONAL_INPUTS)
    return full.groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"), F.count("pb").cast("int").alias("pb"), F.count("turnover_rate").alias("turnover_rate"))


@query("cln09_drop_incomplete", "SELECT ts_code, trade_date, ROUND(ret_20, 6) + 0.0 AS ret_20 FROM v_labeled WHERE ret_20 IS NOT NULL AND turnover_20 IS NOT NULL AND roe IS NOT NULL")
def cln09(d):
    return rounded(d.labeled().dropna(subset=["ret_20", "turnover_20", "roe"]).select("ts_code", "trade_date", "ret_20"), ["ret_20"])


@query("cln10_dedupe_first", "SELECT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, MIN(l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY 1, 2")
def cln10(d):
    li = d.table("lineitem").select(F.col("l_suppkey").alias("ts_code"), F.col("l_shipdate").cast("date").alias("trade_date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return first_row(li, ["ts_code", "trade_date"], [F.col("line")])


@query("cln11_lots", "SELECT code AS ts_code, trade_date, vol / 100 AS vol FROM v_code")
def cln11(d):
    return conform.daily_bars(raw_bars(d), lots=True).select("ts_code", "trade_date", "vol")


@query("cln12_derived_pre_close", "SELECT ts_code, trade_date, CASE WHEN ts_code % 2 = 0 THEN close / 2 ELSE LAG(close) OVER (PARTITION BY ts_code ORDER BY trade_date) END AS pre_close FROM v_bars")
def cln12(d):
    given = d.bars().withColumn("pre_close", F.when(F.col("ts_code") % 2 == 0, F.col("close") / 2))
    return conform.derive_pre_close(given).select("ts_code", "trade_date", "pre_close")


@query("cln13_unknown_category", "SELECT COALESCE(industry_name, 'UNKNOWN') AS industry_name, COUNT(*) AS n FROM v_panel GROUP BY 1")
def cln13(d):
    return d.panel().groupBy(F.coalesce("industry_name", F.lit("UNKNOWN")).alias("industry_name")).agg(F.count(F.lit(1)).alias("n"))


@query("cln14_guarded_reciprocal", "SELECT ts_code, ROUND(CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END, 6) AS ep_ttm, COUNT(*) AS n FROM v_panel GROUP BY ALL")
def cln14(d):
    return d.panel().select("ts_code", r(C.reciprocal(F.col("pe_ttm"))).alias("ep_ttm")).groupBy("ts_code", "ep_ttm").agg(F.count(F.lit(1)).alias("n"))


@query("cln15_positive_finite_ratio", "SELECT ts_code, trade_date, CASE WHEN turnover_rate > 0 THEN close * vol / turnover_rate END AS proxy FROM v_bars")
def cln15(d):
    p = C.positive_finite(F.try_divide(F.col("close") * F.col("vol"), F.col("turnover_rate")))
    return d.bars().select("ts_code", "trade_date", p.alias("proxy"))


@query("cln16_clip", "SELECT ts_code, trade_date, CASE WHEN turnover_rate IS NOT NULL THEN ROUND(LEAST(GREATEST(turnover_rate, 0.1), 0.4), 6) END AS flat, CASE WHEN turnover_rate IS NOT NULL THEN ROUND(LEAST(GREATEST(turnover_rate, vol / 1000), vol / 110), 6) END AS rowwise FROM v_bars")
def cln16(d):
    t = F.col("turnover_rate")
    return d.bars().select("ts_code", "trade_date", r(C.clip(t, 0.1, 0.4)).alias("flat"), r(C.clip(t, F.col("vol") / 1000, F.col("vol") / 110)).alias("rowwise"))


@query("cln17_median_imputation", "SELECT ts_code, trade_date, ROUND(COALESCE(turnover_rate, MEDIAN(turnover_rate) OVER (PARTITION BY trade_date)), 6) AS turnover_rate FROM v_bars")
def cln17(d):
    return rounded(fill_median(d.labeled(), ["trade_date"], "turnover_rate", calendar_keyed=True).select("ts_code", "trade_date", "turnover_rate"), ["turnover_rate"])


@query("cln18_rename_drop_reorder", "SELECT 'panel' AS source, trade_date AS day, ts_code AS code, vol AS volume FROM v_bars")
def cln18(d):
    return d.bars().withColumnsRenamed({"ts_code": "code", "trade_date": "day", "vol": "volume"}).drop("close", "turnover_rate").select(F.lit("panel").alias("source"), "day", "code", "volume")


@query("cln19_date_ranges", "SELECT COUNT(*) FILTER (trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') AS closed, COUNT(*) FILTER (trade_date >= DATE '1997-01-01' AND trade_date < DATE '1997-12-31') AS half_open, COUNT(*) FILTER (trade_date < DATE '1997-01-01') AS before FROM v_bars")
def cln19(d):
    t, a, b = F.col("trade_date"), F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    return d.bars().agg(F.count_if(t.between(a, b)).alias("closed"), F.count_if((t >= a) & (t < b)).alias("half_open"), F.count_if(t < a).alias("before"))


@query("cln20_weight_threshold", "SELECT rebalance_date, COUNT(*) AS n FROM v_prep WHERE benchmark_weight > 0.01 GROUP BY 1")
def cln20(d):
    return d.prepared().where(F.col("benchmark_weight") > 0.01).groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("n"))
