"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.signals import signal_positions
from tidemark.plans import inputs, oracle
from tidemark.session import materialize
from tidemark.signals.registry import catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = nudged(sql)
        return fn
    return deco


def _signal_query(name: str):
    def run(spark, sf_dir):
        pos = signal_positions(inputs.study_panel(spark, sf_dir), [name])
        return pos.withColumn("position", F.col("position").cast("long"))
    return run


for _s in catalogue().values():
    _key = "signal_" + _s.name.replace(".", "_")
    QUERIES[_key] = _signal_query(_s.name)
    ORACLES[_key] = oracle.signal_query(_s.name, _s.timeframes, _s.warmup, _s.min_bars)


# ------------------------------------------------------------------ helpers

def rd(x, digits: int = 6):
    """Round away from decimal ties: a constant nudge far above rounding noise and far below the
    last digit, applied on both sides of the comparison."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + 1.7 * 10.0 ** -(digits + 3), digits)


def r6(cols, digits=6):
    return [rd(c, digits).alias(c) for c in cols]


def squash(c: str):
    """Annualised rates of synthetic series span hundreds of decades: keep the exponent then."""
    x = F.col(c)
    return F.when(F.abs(x) < 1e5, rd(x, 6)).otherwise(F.signum(x) * rd(F.log10(F.abs(x)), 6)).alias(c)


def squash_sql(e: str, name: str) -> str:
    return f"CASE WHEN abs({e}) < 1e5 THEN round({e}, 6) ELSE sign({e}) * round(log10(abs({e})), 6) END AS {name}"


def nudged(sql: str) -> str:
    """The SQL side of ``rd``: every round(x, d) with d >= 5 becomes round(x + nudge, d)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return "".join(out) + sql[i:]
        k, depth, comma = j + 6, 1, -1
        while depth:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if ch == "," and depth == 1:
                comma = k
            k += 1
        digits = sql[comma + 1:k - 1].strip() if comma > 0 else ""
        body = sql[j + 6:comma if comma > 0 else k - 1]
        if digits.isdigit() and int(digits) >= 5:
            d = int(digits)
            out += [sql[i:j], f"round(({nudged(body)}) + 1.7e-{d + 3}::DOUBLE, {d})"]
        else:
            out += [sql[i:j], "round(", nudged(body), f", {digits})" if digits else ")"]
        i = k


def longs(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


_KEEP: dict = {}


def kept(spark, sf_dir: str, name: str, make) -> DataFrame:
    """A written intermediate shared by the queries of one session (positions, pivots, plans …)."""
    return inputs.once(spark, (sf_dir, name), make)


OHLCV = ["open", "high", "low", "close", "volume"]


def _bars_sql(ticks: str, tfs, extra: str = "") -> str:
    body = " UNION ALL ".join(oracle.raw_bars(ticks, t) for t in tfs)
    return (f"SELECT symbol, tf, open_time_ms, open_time_ms + tf_ms - 1 AS close_time_ms, open, high, low, close, volume, "
            f"trades, n_source_bars, is_gap{extra} FROM ({body})")


def _bars_out(df: DataFrame) -> DataFrame:
    return longs(df.select("symbol", "tf", "open_time_ms", "close_time_ms", *OHLCV, "trades", "n_source_bars", "is_gap"),
                 "trades", "n_source_bars")


# ------------------------------------------------------------------ flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge of the 21/55 crossover over the drift on daily bars of all line items."""
    from tidemark.operators import evaluate as E
    from tidemark.operators.bars import ticks_to_bars
    from tidemark.operators.panel import build_panel
    ticks = inputs.lineitem_ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    panel = build_panel(ticks_to_bars(ticks, ["1d"]))
    return E.evaluate_signals(signal_positions(panel, ["trend.ema_cross_21_55"]), E.forward_returns(panel), panel)


# ------------------------------------------------------------------ bars

@query("bars_lineitem_1d", _bars_sql(oracle.LINEITEM_TICKS, ["1d"]))
def _q(spark, sf):
    from tidemark.operators.bars import ticks_to_bars
    return _bars_out(ticks_to_bars(inputs.lineitem_ticks(spark, sf), ["1d"]))


@query("bars_events_resampled", _bars_sql(oracle.EVENT_TYPE_TICKS, ["5m", "15m", "1h", "4h", "1d"]))
def _q(spark, sf):
    from tidemark.operators.bars import resample_bars
    return _bars_out(resample_bars(inputs.event_minutes(spark, sf), ["5m", "15m", "1h", "4h", "1d"]))


_ORDER_TICKS = """SELECT o_orderpriority AS symbol, epoch_ms(o_orderdate) AS t, o_orderkey AS seq, o_totalprice AS price,
  CAST(1 AS DOUBLE) AS size FROM orders"""


@query("bars_orders_1d", _bars_sql(_ORDER_TICKS, ["1d"]))
def _q(spark, sf):
    from tidemark.operators.bars import ticks_to_bars
    return _bars_out(ticks_to_bars(inputs.order_ticks(spark, sf, "o_orderpriority"), ["1d"]))


@query("ticks_to_minutes", f"""SELECT symbol, open_time_ms, open, high, low, close, volume, trades FROM ({oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '1m')})""")
def _q(spark, sf):
    return longs(inputs.event_minutes(spark, sf).select("symbol", "open_time_ms", *OHLCV, "trades"), "trades")


@query("bar_coverage", f"""SELECT symbol, tf, open_time_ms, round(n_source_bars / (tf_ms / 60000.0), 6) AS coverage
  FROM ({oracle.STUDY})""")
def _q(spark, sf):
    from tidemark.operators.bars import bar_coverage
    b = inputs.study_bars(spark, sf)
    return b.select("symbol", "tf", "open_time_ms", rd(bar_coverage(F.col("n_source_bars")), 6).alias("coverage"))


@query("dense_bar_index", f"""SELECT symbol, tf, open_time_ms, bar_idx, n_bars FROM ({oracle.indexed(oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '15m'))})""")
def _q(spark, sf):
    from tidemark.operators.bars import dense_bar_index, resample_bars
    return dense_bar_index(resample_bars(inputs.event_minutes(spark, sf), ["15m"])).select("symbol", "tf", "open_time_ms", "bar_idx", "n_bars")


@query("floor_and_close", """SELECT event_id, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 14400000 AS floor_4h, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 14400000 + 14399999 AS close_4h FROM events""")
def _q(spark, sf):
    from tidemark.functions.clock import TF_MS, as_ms, close_time, floor_to
    f = floor_to(as_ms("ts"), TF_MS["4h"])
    return inputs.table(spark, sf, "events").select("event_id", f.alias("floor_4h"), close_time(f, TF_MS["4h"]).alias("close_4h"))


# A copy of the bars with rows broken by a rule, so that the checks have something to find.
_BROKEN = f"""SELECT symbol, tf, open_time_ms + CASE WHEN trades % 7 = 0 THEN 1 ELSE 0 END AS open_time_ms, open,
  CASE WHEN trades % 5 = 0 THEN low ELSE high END AS high, low, close, tf_ms FROM ({oracle.STUDY})"""


@query("validate_bars", f"""SELECT symbol, tf, open_time_ms, CASE WHEN open_time_ms % tf_ms <> 0 THEN 'off_grid'
  WHEN high < greatest(open, close, low) THEN 'high_not_max' WHEN low > least(open, close, high) THEN 'low_not_min' END AS violation FROM ({_BROKEN})""")
def _q(spark, sf):
    from tidemark.operators.bars import validate_bars
    b = inputs.study_bars(spark, sf)
    b = (b.withColumn("open_time_ms", F.col("open_time_ms") + F.when(F.col("trades") % 7 == 0, 1).otherwise(0))
         .withColumn("high", F.when(F.col("trades") % 5 == 0, F.col("low")).otherwise(F.col("high"))))
    return validate_bars(b).select("symbol", "tf", "open_time_ms", "violation")


@query("duplicate_minutes", """SELECT event_type AS symbol, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 60000 AS open_time_ms, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def _q(spark, sf):
    from tidemark.functions.clock import MINUTE_MS, as_ms, floor_to
    from tidemark.operators.bars import duplicate_minutes
    t = inputs.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), floor_to(as_ms("ts"), MINUTE_MS).alias("open_time_ms"))
    return duplicate_minutes(t)


@query("flag_gaps", f"""WITH b AS ({oracle.indexed(oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '15m', 0.1))})
  SELECT symbol, tf, open_time_ms, coalesce(open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) <> tf_ms, false) OR is_gap AS gap FROM b""")
def _q(spark, sf):
    return _gapped(spark, sf).owned().select("symbol", "tf", "open_time_ms", "gap")


def _gapped(spark, sf):
    from tidemark.operators.bars import dense_bar_index, flag_gaps, resample_bars
    from tidemark.operators.panel import build_panel, win
    b = kept(spark, sf, "ev15", lambda: dense_bar_index(resample_bars(inputs.event_minutes(spark, sf), ["15m"], min_coverage=0.1)))
    p = build_panel(b, indexed=True, stored=True)
    return p.with_df(flag_gaps(p.df, win()))


@query("require_complete", f"""WITH b AS ({oracle.indexed(oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '15m', 0.1))}),
  g AS (SELECT *, coalesce(open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) <> tf_ms, false) OR is_gap AS gap FROM b)
  SELECT symbol, tf, bar_idx, count(*) OVER w = 8 AND NOT bool_or(gap) OVER w AS complete, min(CASE WHEN gap THEN open_time_ms END) OVER w AS first_gap
  FROM g WINDOW w AS (PARTITION BY symbol, tf ORDER BY bar_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def _q(spark, sf):
    from tidemark.operators.bars import require_complete
    from tidemark.operators.panel import rows
    p = _gapped(spark, sf)
    ok, first = require_complete(F.col("gap"), F.col("open_time_ms"), rows(8), 8)
    return p.with_df(p.df.withColumn("complete", ok).withColumn("first_gap", first)).owned().select("symbol", "tf", "bar_idx", "complete", "first_gap")


@query("fill_grid", f"""WITH b AS ({oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '15m')}), e AS (SELECT symbol, min(open_time_ms) AS a, max(open_time_ms) AS z FROM b GROUP BY 1),
  g AS (SELECT symbol, unnest(range(a, z + 1, 900000)) AS open_time_ms FROM e)
  SELECT g.symbol, '15m' AS tf, g.open_time_ms, b.close, b.close IS NULL AS is_gap FROM g LEFT JOIN b USING (symbol, open_time_ms)""")
def _q(spark, sf):
    from tidemark.operators.bars import fill_grid, resample_bars
    return fill_grid(resample_bars(inputs.event_minutes(spark, sf), ["15m"])).select("symbol", "tf", "open_time_ms", "close", "is_gap")


@query("coverage", f"""SELECT symbol, tf, count(*) FILTER (i) AS present, CASE WHEN count(*) FILTER (i) > 0 THEN (max(open_time_ms) FILTER (i) - min(open_time_ms) FILTER (i)) // max(tf_ms) + 1 ELSE 2 END AS expected,
  round(count(*) FILTER (i) / CAST(CASE WHEN count(*) FILTER (i) > 0 THEN (max(open_time_ms) FILTER (i) - min(open_time_ms) FILTER (i)) // max(tf_ms) + 1 ELSE 2 END AS DOUBLE), 6) AS fraction
  FROM (SELECT *, open_time_ms BETWEEN 1704153600000 AND 1705363200000 AS i FROM ({' UNION ALL '.join(oracle.raw_bars(oracle.EVENT_TYPE_TICKS, t) for t in ('15m', '1h'))})) GROUP BY 1, 2""")
def _q(spark, sf):
    from tidemark.operators.bars import coverage, resample_bars
    b = resample_bars(inputs.event_minutes(spark, sf), ["15m", "1h"])
    return coverage(b, 1704153600000, 1705363200000).withColumn("fraction", rd("fraction", 6))


@query("latest_bars", f"""SELECT symbol, tf, open_time_ms, close FROM ({oracle.indexed(oracle.STUDY)}) WHERE bar_idx >= n_bars - 50""")
def _q(spark, sf):
    from tidemark.operators.bars import latest_bars
    return latest_bars(inputs.study_bars(spark, sf), 50).select("symbol", "tf", "open_time_ms", "close")


@query("infer_bar_ms", f"WITH {oracle.BARS}, {oracle.BAR_MS} SELECT * FROM bar_ms")
def _q(spark, sf):
    from tidemark.operators.evaluate import infer_bar_ms
    return infer_bar_ms(inputs.study_bars(spark, sf))


# ------------------------------------------------------------------ sources

_WORD = "CASE o_orderstatus WHEN 'O' THEN 'Largo' WHEN 'F' THEN 'corto' ELSE 'fuera' END"
_USER = f"""u AS (SELECT epoch_ms(o_orderdate) AS ts, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS position, o_totalprice AS price, o_orderkey AS k FROM orders),
  s AS (SELECT ts, last(position ORDER BY k) AS position, last(price ORDER BY k) AS price FROM u GROUP BY ts)"""


def _user_table(spark, sf):
    """Orders as somebody's signal sheet: a date text, a word in Spanish, a price."""
    o = inputs.table(spark, sf, "orders")
    return o.select(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("Fecha"),
                    F.expr(_WORD).alias("señal"), F.col("o_totalprice").cast("string").alias("precio"), F.col("o_orderkey").alias("k"))


@query("import_user_signals", f"WITH {_USER} SELECT ts, CAST(position AS BIGINT) AS position, price FROM s")
def _q(spark, sf):
    from tidemark.sources.user_signals import import_signals
    out, _ = import_signals(_user_table(spark, sf), seq="k")
    return longs(out, "position")


@query("align_user_signals", f"""WITH {_USER}, b AS ({oracle.indexed(oracle.raw_bars(oracle.LINEITEM_TICKS, '1d'))}),
  g AS (SELECT ts - ts % 86400000 AS t, last(position ORDER BY ts) AS p FROM s GROUP BY 1)
  SELECT 'user' AS signal_name, symbol, tf, bar_idx, b.open_time_ms, CAST(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY symbol, tf ORDER BY bar_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS position FROM b LEFT JOIN g ON g.t = b.open_time_ms""")
def _q(spark, sf):
    from tidemark.functions.clock import DAY_MS
    from tidemark.sources.user_signals import align_signals, import_signals
    out, _ = import_signals(_user_table(spark, sf), seq="k")
    return longs(align_signals(out, inputs.study_bars(spark, sf).filter("tf = '1d'"), DAY_MS), "position")


@query("pending_months", """WITH p AS (SELECT DISTINCT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
  s AS (SELECT DISTINCT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate < TIMESTAMP '1999-05-10')
  SELECT DISTINCT symbol, month FROM p WHERE (symbol, month) NOT IN (SELECT (symbol, month) FROM s)
    OR (symbol, month) IN (SELECT (symbol, max(month)) FROM s GROUP BY symbol)""")
def _q(spark, sf):
    from tidemark.functions.clock import as_ms
    from tidemark.sources.klines import months_of, pending_months
    o = inputs.order_ticks(spark, sf, "o_orderpriority").withColumn("open_time_ms", as_ms("ts"))
    return pending_months(months_of(o), months_of(o.filter("ts < '1999-05-10'")))


def _kline_folder(spark, sf) -> str:
    """Minutes of all events as headerless CSVs, one archive per event type and month, every row twice and out of order, each 17th
    minute seven seconds off the grid; beside each an archive that is half a minute off, one of mixed units and one of the wrong month."""
    from tidemark.functions.clock import month_key
    root = _root(spark, "klines")
    t, k = F.col("open_time_ms"), F.floor(F.col("open_time_ms") / 60_000)
    m = inputs.event_minutes(spark, sf).withColumn("month", month_key(t))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(c).alias("copy")) for n, c in (("", 0), ("", 1), ("_off", 0), ("_mixed", 0), ("_month", 0))]))
    m = m.withColumn("v", kinds).select("*", "v.*")
    us = t * 1000 + F.when(F.col("kind") == "_off", 31_000_000).when((F.col("kind") == "") & (k % 17 == 0), 7_000_000).otherwise(0)
    epoch = F.when((F.col("kind") == "_mixed") & (k % 2 == 1), t).otherwise(us)
    archive = F.concat("symbol", "kind", F.lit("-1m-"), F.when(F.col("kind") == "_month", F.lit("1999-01")).otherwise(F.col("month")))
    rows = m.select(epoch.alias("a"), *OHLCV, (us + 59_999_999).alias("b"), "quote_volume", "trades", F.lit(0.0).alias("tb"), F.lit(0.0).alias("tq"), F.lit(0).alias("i"), archive.alias("archive"))
    rows.repartition("archive").write.partitionBy("archive").csv(root)
    return root


@query("klines_csv_to_bars", _bars_sql(oracle.EVENT_TYPE_TICKS, ["1h"]))
def _q(spark, sf):
    from tidemark.operators.bars import resample_bars
    from tidemark.sources.klines import load_klines
    bars, _ = load_klines(spark, f"{_kline_folder(spark, sf)}/*", strict=False)
    return _bars_out(resample_bars(bars, ["1h"]))


@query("klines_file_report", """WITH m AS (SELECT DISTINCT event_type AS s, (epoch_us(ts) // 60000000) AS k, strftime(ts, '%Y-%m') AS mo FROM events)
  SELECT s AS symbol, '1m' AS tf, mo AS month, 2 * count(*) AS rows, 2 * count(*) AS rows_us, 2 * count(*) FILTER (k % 17 = 0) AS realigned, CAST(max(CASE WHEN k % 17 = 0 THEN 7000 ELSE 0 END) AS BIGINT) AS max_offset_ms,
    0 AS outside_month, count(*) AS duplicates, CAST(NULL AS VARCHAR) AS rejected FROM m GROUP BY 1, 3
  UNION ALL SELECT s || '_off', '1m', mo, count(*), count(*), count(*), 31000, 0, 0, 'off_grid' FROM m GROUP BY s, mo
  UNION ALL SELECT s || '_mixed', '1m', mo, count(*), count(*) FILTER (k % 2 = 0), 0, 0, 0, 0, CASE WHEN count(*) FILTER (k % 2 = 0) BETWEEN 1 AND count(*) - 1 THEN 'mixed_units' END FROM m GROUP BY s, mo
  UNION ALL SELECT s || '_month', '1m', '1999-01', count(*), count(*), 0, 0, count(*), 0, 'outside_month' FROM m GROUP BY s""")
def _q(spark, sf):
    from tidemark.sources.klines import file_report, read_klines
    return file_report(read_klines(spark, f"{_kline_folder(spark, sf)}/*")).select("symbol", "tf", "month", "rows", "rows_us", "realigned", "max_offset_ms", "outside_month", "duplicates", "rejected")


def _store(spark, sf):
    """The minutes of all events ingested in two overlapping batches."""
    import uuid

    from tidemark.session import checkpoint_root
    from tidemark.sources.store import ingest_bars
    root = f"{checkpoint_root(spark)}/tidemark/store-{uuid.uuid4().hex}"
    m = inputs.event_minutes(spark, sf)
    mid = 1_705_276_800_000
    first = ingest_bars(spark, root, m.filter(F.col("open_time_ms") < mid))
    again = m.withColumn("close", F.when(F.col("open_time_ms") < mid, -1.0).otherwise(F.col("close")))
    second = ingest_bars(spark, root, again)
    return root, first, second


@query("ingest_bars_report", """WITH m AS (SELECT DISTINCT event_type AS symbol, strftime(ts, '%Y-%m') AS month, (epoch_us(ts) // 1000) // 60000 * 60000 AS t FROM events)
  SELECT symbol, month, count(*) FILTER (t >= 1705276800000) AS written, count(*) FILTER (t < 1705276800000) AS duplicates FROM m GROUP BY 1, 2""")
def _q(spark, sf):
    return _store(spark, sf)[2]


@query("read_bars_range", f"""SELECT symbol, open_time_ms, close, false AS is_gap FROM ({oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '1m')}) WHERE open_time_ms BETWEEN 1705190400000 AND 1705449600000""")
def _q(spark, sf):
    from tidemark.sources.store import read_bars
    root, _, _ = _store(spark, sf)
    return read_bars(spark, root, start_ms=1705190400000, end_ms=1705449600000).filter("NOT is_gap").select("symbol", "open_time_ms", "close", "is_gap")


@query("derivative_metrics", """SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS symbol, (epoch_us(ts) // 1000) // 300000 * 300000 AS ts, min(event_id) AS _ts_ingest_ms, first(value ORDER BY event_id) AS value FROM events GROUP BY 1, 2, 3""")
def _q(spark, sf):
    from tidemark.functions.clock import as_ms, floor_to
    from tidemark.sources.events import derivative_metrics
    e = inputs.table(spark, sf, "events")
    poll = e.select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("symbol"), floor_to(as_ms("ts"), 300_000).alias("ts"),
                    F.col("event_id").alias("_ts_ingest_ms"), "value")
    return derivative_metrics(poll.unionByName(poll.withColumn("_ts_ingest_ms", F.col("_ts_ingest_ms") + 1_000_000_000)))


@query("json_events_stream", """SELECT event_type AS _source, strftime(make_timestamp(((epoch_us(ts) // 1000) + event_id % 500) * 1000), '%Y-%m-%d') AS day, count(*) AS n, sum(event_id % 500) AS latency_ms FROM events GROUP BY 1, 2""")
def _q(spark, sf):
    import uuid

    from tidemark.functions.clock import as_ms
    from tidemark.session import checkpoint_root
    from tidemark.sources.events import json_events, sink_events
    root = f"{checkpoint_root(spark)}/tidemark/json-{uuid.uuid4().hex}"
    e = inputs.table(spark, sf, "events")
    e.select(F.col("event_type").alias("_source"), (as_ms("ts") + F.col("event_id") % 500).alias("_ts_ingest_ms"), as_ms("ts").alias("ts"),
             F.lit("ALL").alias("symbol"), F.col("value").alias("price")).write.json(f"{root}/in")
    sink_events(json_events(spark, f"{root}/in", stream=True), f"{root}/out", f"{root}/ck").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("_source", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency_ms"))


# ------------------------------------------------------------------ indicators

def _ind(name: str, make, build, panel=inputs.study_panel):
    """``make()`` -> {column: feature}; ``build(g)`` -> {column: sql}. Values are rounded alike:
    six decimals, three for large ones."""
    g = oracle.Graph()
    cols = build(g)
    sel = ", ".join(f"CASE WHEN abs({v}) < 100 THEN round({v}, 6) ELSE round({v} + 1.7e-7::DOUBLE, 3) END AS {k}" for k, v in cols.items())

    def run(spark, sf):
        from tidemark.operators.indicators import indicators
        d = indicators(panel(spark, sf), make())
        x = {k: F.col(k).cast("double") for k in cols}
        return d.select("symbol", "tf", "bar_idx", *[
            F.when(F.abs(v) < 100, rd(v, 6)).otherwise(F.round(v + 1.7e-7, 3)).alias(k) for k, v in x.items()])
    QUERIES[name] = run
    ORACLES[name] = nudged(g.render(f"SELECT symbol, tf, bar_idx, {sel} FROM f"))


def _register_indicators():
    from tidemark.functions import features as X
    o = oracle

    def d(x):
        return f"CAST({x} AS DOUBLE)"
    _ind("ind_averages", lambda: {"sma20": X.sma(X.CLOSE, 20), "sma200": X.sma(X.CLOSE, 200), "ema21": X.ema(X.CLOSE, 21), "ema200": X.ema(X.CLOSE, 200),
                                  "std20": X.std(X.CLOSE, 20), "bb_up": X.bbands()[0], "bb_lo": X.bbands()[2], "sum20": X.rsum(X.VOLUME, 20)},
         lambda g: {"sma20": g.sma("close", 20), "sma200": g.sma("close", 200), "ema21": g.ema("close", 21), "ema200": g.ema("close", 200),
                    "std20": g.std("close", 20), "bb_up": o.bbands(g)[0], "bb_lo": "bb_lo", "sum20": g.sum("volume", 20)})
    _ind("ind_wilder", lambda: {"tr": X.TRUE_RANGE, "atr14": X.atr(14), "natr14": X.natr(14), "rsi14": X.rsi(14), "pdi": X.dmi()[0], "mdi": X.dmi()[1], "adx": X.dmi()[2]},
         lambda g: {"atr14": o.atr(g, 14), "tr": "tr", "natr14": g.add("natr", "100 * tr_wil14 / close", ["tr_wil14"]), "rsi14": o.rsi(g), "adx": o.dmi(g)[2], "pdi": "pdi", "mdi": "mdi"})

    def macd(g):
        a, b = g.ema("close", 12), g.ema("close", 26)
        g.add("macd", f"{a} - {b}", [a, b])
        return {"macd": "macd", "macd_signal": g.ema("macd", 9, 25)}
    _ind("ind_macd", lambda: dict(zip(("macd", "macd_signal"), X.macd())), macd)
    _ind("sma_long_windows", lambda: {"sma600": X.sma(X.CLOSE, 600), "sma1500": X.sma(X.CLOSE, 1_500), "sum700": X.rsum(X.VOLUME, 700), "max900": X.rmax(X.HIGH, 900),
                                      "min333": X.rmin(X.LOW, 333, 1), "std520": X.std(X.CLOSE, 520), "roc1100": X.roc(X.CLOSE, 1_100)},
         lambda g: {"sma600": g.sma("close", 600), "sma1500": g.sma("close", 1_500), "sum700": g.sum("volume", 700), "max900": g.max("high", 900),
                    "min333": g.min("low", 333, 1), "std520": g.std("close", 520), "roc1100": g.roc("close", 1_100)}, inputs.cut_study_panel)

    def nested(g):
        s, e = g.sma("close", 300), g.ema("close", 600)
        return {"ema_of_sma": g.ema(s, 700, 299), "ema_of_ema": g.ema(e, 50, 599), "sma_of_ema": g.sma(e, 700), "top_of_ema": g.max(e, 400)}
    _ind("rule_nested_averages", lambda: {"ema_of_sma": X.ema(X.sma(X.CLOSE, 300), 700, 299), "ema_of_ema": X.ema(X.ema(X.CLOSE, 600), 50, 599),
                                          "sma_of_ema": X.sma(X.ema(X.CLOSE, 600), 700), "top_of_ema": X.rmax(X.ema(X.CLOSE, 600), 400)}, nested, inputs.cut_study_panel)
    _ind("ind_channels", lambda: {"max20": X.rmax(X.HIGH, 20), "min20": X.rmin(X.LOW, 20), "pmax55": X.rmax(X.HIGH, 55, 1), "pmin55": X.rmin(X.LOW, 55, 1),
                                  "willr": X.willr(), "aroon_up": X.aroon()[0], "aroon_dn": X.aroon()[1]},
         lambda g: {"max20": g.max("high", 20), "min20": g.min("low", 20), "pmax55": g.max("high", 55, 1), "pmin55": g.min("low", 55, 1),
                    "willr": o.willr(g), "aroon_up": o.aroon(g)[0], "aroon_dn": "aroon_dn"})

    def mom(g):
        o.prior(g)
        return {"lag3": g.lag("close", 3), "roc10": g.roc("close", 10), "slope20": g.slope("close", 20), "cci": o.cci(g), "er": o.er(g), "kama": o.kama_out(g), "ao": "ao",
                "prior_high": "CASE WHEN bar_idx >= 100 THEN hi_at.c END", "prior_low": "CASE WHEN bar_idx >= 100 THEN lo_at.c END"}
    _ind("ind_momentum", lambda: {"lag3": X.lag(X.CLOSE, 3), "roc10": X.roc(X.CLOSE, 10), "slope20": X.slope(X.CLOSE, 20), "cci": X.cci(), "er": X.efficiency(), "kama": X.kama(), "ao": X.AO,
                                  "prior_high": X.row("prior_hi_c", [X.prior_extreme(True)], lambda: F.col("prior_hi.c")),
                                  "prior_low": X.row("prior_lo_c", [X.prior_extreme(False)], lambda: F.col("prior_lo.c"))}, mom)

    def flow(g):
        v, s, k = o.vwap(g)
        return {"clv": "clv", "typical": "typical", "mfi": o.mfi(g), "adosc": o.adosc(g), "vwap": v, "sess_bar": d(k)}
    _ind("ind_flow", lambda: {"clv": X.CLV, "typical": X.TYPICAL, "mfi": X.mfi(), "adosc": X.adosc(), "vwap": X.session_vwap()[0], "sess_bar": X.session_vwap()[2]}, flow)

    def vol(g):
        r = o.rs_vol(g)
        a = o.atr(g, 14)
        return {"rs_vol": r, "rs_rank": g.rank(r, 252), "atr_rank": g.rank(a, 100)}
    _ind("ind_volatility", lambda: {"rs_vol": X.rs_vol(24), "rs_rank": X.rank_pct(X.rs_vol(24), 252), "atr_rank": X.rank_pct(X.atr(14), 100)}, vol)

    def swing(g):
        h, l = o.swings(g)
        return {"fractal_hi": "fh", "fractal_lo": "fl", "swing_hi": h, "swing_lo": l, "swing_hi2": "fh_prev_ff", "swing_lo2": "fl_prev_ff", "state": d("state")}
    _ind("ind_swings", lambda: {"fractal_hi": X.FR_HI, "fractal_lo": X.FR_LO, "swing_hi": X.SWING_HI, "swing_lo": X.SWING_LO, "swing_hi2": X.SWING_HI2, "swing_lo2": X.SWING_LO2,
                                "state": X.STRUCT_STATE}, swing)

    def cal(g):
        o.held_clock(g)
        g.add("lf", f"CAST({o.LAST_FRI.format(d='hd')} - DATE '1970-01-01' AS BIGINT)", ["hd"])
        return {"held_hour": d("hh"), "held_weekday": d("wd"), "last_friday": d("lf"), "month_day": d("day(hd)")}

    def cal_features():
        from tidemark.functions.clock import last_friday
        from tidemark.signals import seasonality as S
        return {"held_hour": S._hour, "held_weekday": S._wd,
                "last_friday": X.row("lf", [S._date], lambda: F.datediff(last_friday(S._date.c), F.to_date(F.lit("1970-01-01")))),
                "month_day": X.row("md", [S._date], lambda: F.dayofmonth(S._date.c))}
    _ind("ind_calendar", cal_features, cal)


_register_indicators()


def _totals_sql() -> str:
    g = oracle.Graph()
    oracle.obv(g), oracle.ad(g), oracle.nvi(g)
    return g.render("SELECT symbol, tf, bar_idx, round(obv, 5) AS obv, round(ad, 5) AS ad, round(ln(nvi), 6) AS ln_nvi FROM f")


@query("running_totals", _totals_sql())
def _q(spark, sf):
    from tidemark.operators.indicators import running_totals
    t = running_totals(inputs.study_panel(spark, sf))
    return t.select("symbol", "tf", "bar_idx", *r6(["obv", "ad"], 5), rd(F.ln("nvi"), 6).alias("ln_nvi"))


# ------------------------------------------------------------------ rules

def _rule_sql() -> str:
    g = oracle.Graph()
    e, s, a = g.ema("close", 12), g.sma("close", 30), oracle.atr(g, 14)
    pe, ps = g.lag(e), g.lag(s)
    r, hi = oracle.rsi(g), g.max("high", 20, 1)
    g.add("xu", f"coalesce({e} > {s} AND {pe} <= {ps}, false) OR (coalesce({r} < 35, false) AND NOT coalesce(range > {a}, false))", [pe, ps, r, a])
    g.add("xd", f"coalesce({e} < {s} AND {pe} >= {ps}, false) OR coalesce(close > {hi}, false)", [pe, ps, hi])
    return g.render(f"SELECT 'rule' AS signal_name, symbol, tf, bar_idx, open_time_ms, CAST({oracle.events('xu', 'xd')} AS BIGINT) AS position FROM f")


def _rule(spark, sf):
    from tidemark.functions import features as X
    from tidemark.functions import rules as R
    e, s = R.ema(X.CLOSE, 12), R.sma(X.CLOSE, 30)
    uses = {"up": R.crosses_above(e, s), "dn": R.crosses_below(e, s), "rsi": R.rsi(X.CLOSE), "range": R.RULE_SERIES["range"],
            "atr": R.RULE_SERIES["atr"], "close": X.CLOSE, "top": R.shift(R.highest(X.HIGH, 20), 1)}
    return R.evaluate_rule(inputs.study_panel(spark, sf), uses,
                           long=lambda c: c["up"] | (R.where(c["rsi"] < 35) & ~R.where(c["range"] > c["atr"])),
                           short=lambda c: c["dn"] | R.where(c["close"] > c["top"]))


@query("rule_positions", _rule_sql())
def _q(spark, sf):
    return longs(_rule(spark, sf), "position")


@query("rule_gate", f"""SELECT signal_name, symbol, tf, count(*) AS n_bars, count(*) FILTER (position = 1) AS n_long, count(*) FILTER (position = -1) AS n_short,
  CASE WHEN count(*) < 400 THEN 'too_few_bars' WHEN count(*) FILTER (position <> 0) < 30 THEN 'too_few_active_bars' END AS refused FROM ({_rule_sql()}) GROUP BY 1, 2, 3""")
def _q(spark, sf):
    from tidemark.functions.rules import rule_counts
    return rule_counts(_rule(spark, sf))


# ------------------------------------------------------------------ pivots, candidates, plans

def _states(spark, sf):
    from tidemark.operators.pivots import zigzag_states
    return kept(spark, sf, "zigzag", lambda: zigzag_states(inputs.study_panel(spark, sf)))


def _pivots(spark, sf):
    from tidemark.operators.pivots import confirmed_pivots, pivot_events
    return kept(spark, sf, "pivots", lambda: confirmed_pivots(pivot_events(inputs.study_panel(spark, sf))[0]))


def _cands(spark, sf):
    from tidemark.operators.candidates import wave_candidates
    return kept(spark, sf, "candidates", lambda: wave_candidates(_pivots(spark, sf)))


def _plans(spark, sf):
    from tidemark.operators.plans import decision_plans
    return kept(spark, sf, "plans", lambda: decision_plans(_states(spark, sf), _cands(spark, sf), inputs.study_panel(spark, sf)))


_PV = "SELECT symbol, tf, variant, idx, ts_ms, round(price, 6) AS price, kind, round(thr_at_extreme, 6) AS thr_at_extreme, confirmed_idx, confirmed_ts_ms, pivot_no FROM ({})"


def _pv_out(p):
    return longs(p.withColumn("price", rd("price", 6)).withColumn("thr_at_extreme", rd("thr_at_extreme", 6)), "kind")


@query("zigzag_pivots", _PV.format(oracle.pivots_sql()))
def _q(spark, sf):
    return _pv_out(_pivots(spark, sf))


@query("zigzag_variants", " UNION ALL ".join(_PV.format(oracle.pivots_sql(n, k=k, pct=p, on_close=c)) for n, k, p, c in (("k3", 3.0, 0.0, False), ("k2_close", 2.0, 0.005, True))))
def _q(spark, sf):
    from tidemark.operators.pivots import Variant, confirmed_pivots, pivot_events
    from tidemark.session import materialize
    return _pv_out(confirmed_pivots(pivot_events(inputs.study_panel(spark, sf), [Variant("k3", 3.0, 0.0), Variant("k2_close", 2.0, 0.005, True)])[0]))


@query("provisional_pivot", f"WITH {oracle.STA} SELECT symbol, tf, variant, CAST(zat AS BIGINT) AS idx, round(zpx, 6) AS price, CAST(zup AS BIGINT) AS kind, round(zpx - zup * zthr, 6) AS confirm_price FROM sta WHERE bar_idx = n_bars - 1")
def _q(spark, sf):
    from tidemark.operators.pivots import provisional_pivots
    return longs(provisional_pivots(_states(spark, sf)).select("symbol", "tf", "variant", "idx", *r6(["price"]), "kind", *r6(["confirm_price"])), "kind")


@query("validate_pivots", f"WITH {oracle.PIV} SELECT symbol, tf, variant, pivot_no FROM piv WHERE confirmed_ts_ms < ts_ms")
def _q(spark, sf):
    from tidemark.operators.pivots import pivot_violations
    return pivot_violations(_pivots(spark, sf)).select("symbol", "tf", "variant", "pivot_no")


_PROBES = "SELECT 'ALL' AS symbol, tf, 'k1.5' AS variant, event_id, (epoch_us(ts) // 1000) AS t FROM events, (VALUES ('1h'), ('15m')) v(tf)"


@query("pivots_as_of", f"""WITH {oracle.PIV}, q AS ({_PROBES})
  SELECT q.symbol, q.tf, q.variant, q.event_id, q.t, p.idx, round(p.price, 6) AS price, p.kind, coalesce(p.pivot_no + 1, 0) AS n_known
  FROM q ASOF LEFT JOIN piv p ON q.symbol = p.symbol AND q.tf = p.tf AND q.variant = p.variant AND q.t >= p.confirmed_ts_ms""")
def _q(spark, sf):
    from tidemark.functions.clock import as_ms
    from tidemark.operators.pivots import pivots_as_of
    q = inputs.table(spark, sf, "events").select(F.lit("ALL").alias("symbol"), F.explode(F.array(F.lit("1h"), F.lit("15m"))).alias("tf"), F.lit("k1.5").alias("variant"),
                                                 "event_id", as_ms("ts").alias("t"))
    return longs(pivots_as_of(_pivots(spark, sf), q, span=4 * 86_400_000).drop("ts_ms").withColumn("price", rd("price", 6)), "kind", "n_known")


@query("legs_as_of", f"""WITH {oracle.PIV}, {oracle.STA}, k AS (SELECT * FROM piv WHERE confirmed_ts_ms <= 1705881600000),
  f AS (SELECT symbol, tf, min(CASE WHEN ts_ms >= 1705276800000 THEN pivot_no END) AS a, count(*) AS n, max(ts_ms) AS z FROM k GROUP BY 1, 2)
  SELECT k.symbol, k.tf, ts_ms, round(price, 6) AS price, kind, confirmed_ts_ms, false AS tentative FROM k JOIN f USING (symbol, tf) WHERE pivot_no >= coalesce(a, n) - 1
  UNION ALL SELECT s.symbol, s.tf, CAST(zts AS BIGINT), round(zpx, 6), CAST(zup AS BIGINT), NULL, true FROM sta s LEFT JOIN f USING (symbol, tf)
  WHERE bar_idx = n_bars - 1 AND zts <= 1705881600000 AND (f.z IS NULL OR zts > f.z)""")
def _q(spark, sf):
    from tidemark.operators.pivots import legs_as_of, provisional_pivots
    legs = legs_as_of(_pivots(spark, sf), provisional_pivots(_states(spark, sf)), 1705881600000, 1705276800000)
    return longs(legs.drop("variant").withColumn("price", rd("price", 6)), "kind")


@query("pivot_stats", f"""WITH {oracle.PIV}, {oracle.STA}, l AS (SELECT tf, variant, confirmed_idx - idx AS lag, abs(price / lag(price) OVER (PARTITION BY symbol, tf ORDER BY pivot_no) - 1) * 100 AS leg FROM piv)
  SELECT tf, variant, count(*) AS pivots, any_value(n) AS bars, round(median(leg), 6) AS median_leg_pct, round(median(lag), 6) AS median_lag, round(any_value(n) / count(*), 6) AS bars_per_pivot
  FROM l JOIN (SELECT tf, count(*) AS n FROM sta GROUP BY 1) USING (tf) GROUP BY 1, 2""")
def _q(spark, sf):
    from tidemark.operators.pivots import pivot_stats
    s = pivot_stats(_pivots(spark, sf), _states(spark, sf))
    return s.select("tf", "variant", "pivots", "bars", *r6(["median_leg_pct", "median_lag", "bars_per_pivot"]))


_CAND_CTES = f"{oracle.PIV}, {oracle.candidates_ctes()}"


@query("wave_candidates", f"""WITH RECURSIVE {_CAND_CTES} SELECT symbol, tf, variant, edge_no, rank, available_at_ms, n_points, back, state, CAST(direction AS BIGINT) AS direction, round(score, 6) AS score,
  round(retr_w2, 6) AS retr_w2, round(ext_w3, 6) AS ext_w3, round(retr_w4, 6) AS retr_w4, round(invalidation_price, 6) AS invalidation_price, invalidation_rule, archetype, truncated, pivot_ts[1] AS first_ts FROM cand""")
def _q(spark, sf):
    c = _cands(spark, sf).select(
        "symbol", "tf", "variant", "edge_no", "rank", "available_at_ms", "n_points", "back", "state", "direction", *r6(["score"]),
        *[rd(f"fit.{k}", 6).alias(k) for k in ("retr_w2", "ext_w3", "retr_w4")], *r6(["invalidation_price"]), "invalidation_rule", "archetype", "truncated",
        F.col("pivot_ts")[0].alias("first_ts"))
    return longs(c, "rank", "n_points", "back", "direction")


@query("fib_levels", f"""WITH {oracle.PIV}, l AS (SELECT symbol, tf, pivot_no, price AS b, lag(price) OVER (PARTITION BY symbol, tf ORDER BY pivot_no) AS a FROM piv)
  SELECT symbol, tf, pivot_no, round(b - (b - a) * 0.5, 6) AS r50, round(b - (b - a) * 0.786::DOUBLE, 6) AS r786, round(b + (b - a) * 1.618::DOUBLE, 6) AS x1618 FROM l WHERE a IS NOT NULL""")
def _q(spark, sf):
    from tidemark.operators.candidates import fib_projection, fib_retracement
    from tidemark.operators.pivots import own_pivots, pivot_windows
    p, w = pivot_windows(_pivots(spark, sf), 1)
    p = own_pivots(p.withColumn("a", F.lag("price").over(w))).filter("a IS NOT NULL")
    r, x = fib_retracement(F.col("a"), F.col("price"), (0.5, 0.786)), fib_projection(F.col("price"), F.col("a"), F.col("price"))
    return p.select("symbol", "tf", "pivot_no", rd(r[0], 6).alias("r50"), rd(r[1], 6).alias("r786"), rd(x[2], 6).alias("x1618"))


_PLAN_CTES = f"{oracle.PIV}, {oracle.STA}, {oracle.candidates_ctes()}, {oracle.plans_ctes()}"


@query("build_plans", f"""WITH RECURSIVE {_PLAN_CTES} SELECT symbol, tf, variant, bar_idx, rank, archetype, round(zone_lo, 5) AS zone_lo, round(zone_hi, 5) AS zone_hi, round(stop, 5) AS stop, round(t2, 5) AS target2,
  round(stop_atr, 5) AS stop_atr, round(cost_r, 5) AS cost_r, round(rr_t2, 5) AS rr_t2, round(rr_in_zone, 5) AS rr_in_zone, round(p_required, 5) AS p_required, round(size_factor, 5) AS size_factor, viable, in_zone, refusal FROM plan WHERE archetype IN ('w2', 'w4')""")
def _q(spark, sf):
    p = _plans(spark, sf).filter("archetype IN ('w2', 'w4')").withColumn("target2", F.col("targets")[1]).withColumn("refusal", F.when(~F.col("viable"), F.col("reasons")[0]))
    return longs(p.select("symbol", "tf", "variant", "bar_idx", "rank", "archetype", *r6(["zone_lo", "zone_hi", "stop", "target2", "stop_atr", "cost_r", "rr_t2", "rr_in_zone", "p_required", "size_factor"], 5),
                          "viable", "in_zone", "refusal"), "rank")


@query("decisions", f"""WITH RECURSIVE {_PLAN_CTES}, a AS (SELECT symbol, tf, bar_idx, count(*) AS n, bool_or(in_zone) AS z FROM plan GROUP BY 1, 2, 3)
  SELECT s.symbol, s.tf, s.bar_idx, s.close AS price, CASE WHEN n > 0 THEN 'WATCH' ELSE 'NO_TRADE' END AS verdict, coalesce(n, 0) AS n_candidates,
  CASE WHEN s.atr IS NULL THEN 'not enough structure yet' WHEN n IS NULL THEN 'no structure satisfies the rules' WHEN NOT z THEN 'no price inside an entry zone' ELSE 'inside an entry zone' END AS reason
  FROM sta s LEFT JOIN a USING (symbol, tf, bar_idx)""")
def _q(spark, sf):
    from tidemark.operators.plans import decisions
    d = decisions(_states(spark, sf), _plans(spark, sf))
    return d.select("symbol", "tf", "bar_idx", "price", "verdict", "n_candidates", "reason")


@query("decision_checks", f"WITH RECURSIVE {_PLAN_CTES} SELECT symbol, tf, bar_idx, CASE WHEN bool_or(viable) THEN 'prior_only' ELSE 'no_plan' END AS violation FROM plan GROUP BY 1, 2, 3")
def _q(spark, sf):
    from tidemark.operators.plans import decision_violations, decisions
    d = decisions(_states(spark, sf), _plans(spark, sf)).filter("verdict = 'WATCH'").withColumn("verdict", F.lit("ACTIONABLE"))
    return decision_violations(d).select("symbol", "tf", "bar_idx", "violation")


@query("rejection_counts", f"WITH RECURSIVE {_PLAN_CTES} SELECT refusal AS reason, count(*) AS n FROM plan WHERE NOT viable GROUP BY 1")
def _q(spark, sf):
    from tidemark.operators.outcomes import rejection_counts
    return rejection_counts(_plans(spark, sf))


# ------------------------------------------------------------------ outcomes

_ENTRY_CTES = f"""{_PLAN_CTES}, {oracle.BARS},
  okp AS MATERIALIZED (SELECT *, CAST(6 AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf, variant, archetype, bar_idx ORDER BY rank) AS rk FROM plan WHERE viable AND in_zone) WHERE rk = 1),
  {oracle.spaced('okp', 'keptp', 'symbol, tf, variant, archetype', 'bar_idx', 'gap')},
  entries0 AS (SELECT concat_ws(':', o.symbol, o.tf, o.variant, o.archetype, o.bar_idx) AS entry_id, o.symbol, o.tf, o.bar_idx, o.direction, o.archetype, o.price AS entry, round(o.stop, 2) AS stop, round(o.t2, 2) AS target,
    round(o.score, 3) AS score, round(o.cost_r, 4) AS cost_r FROM okp o JOIN keptp k ON o.symbol = k.symbol AND o.tf = k.tf AND o.variant = k.variant AND o.archetype = k.archetype AND o.bar_idx = k.kept),
  entries AS MATERIALIZED (SELECT e.* FROM entries0 e JOIN (SELECT symbol, tf, max(bar_idx) AS z FROM bars GROUP BY 1, 2) m USING (symbol, tf) WHERE e.bar_idx < m.z)"""
_OUT_CTES = (f"{_ENTRY_CTES}, {oracle.barrier_ctes('entries', 'own')}, {oracle.twin_ctes('entries', 'twins')}, {oracle.barrier_ctes('twins', 'ctl')}, "
             "res AS MATERIALIZED (SELECT o.*, c.r AS null_r, c.barrier AS null_barrier, c.bar_idx AS null_bar_idx FROM own o JOIN ctl c USING (entry_id))")


def _entries(spark, sf):
    from tidemark.operators.outcomes import trade_signals
    return kept(spark, sf, "entries", lambda: trade_signals(_plans(spark, sf), inputs.study_panel(spark, sf)).withColumn(
        "entry_id", F.concat_ws(":", "symbol", "tf", "variant", "archetype", "bar_idx")))


def _outcomes(spark, sf):
    from tidemark.operators.outcomes import resolve_with_control
    return kept(spark, sf, "outcomes", lambda: resolve_with_control(_entries(spark, sf), inputs.study_bars(spark, sf)))


@query("trade_signals", f"WITH RECURSIVE {_ENTRY_CTES} SELECT entry_id, symbol, tf, bar_idx, CAST(direction AS BIGINT) AS direction, archetype, entry, stop, target, score, cost_r FROM entries0")
def _q(spark, sf):
    return longs(_entries(spark, sf).select("entry_id", "symbol", "tf", "bar_idx", "direction", "archetype", "entry", "stop", "target", "score", "cost_r"), "direction")


@query("triple_barrier", f"WITH RECURSIVE {_OUT_CTES} SELECT entry_id, barrier, round(r, 6) AS r, round(mae_r, 6) AS mae_r, round(mfe_r, 6) AS mfe_r, bars, ambiguous, round(null_r, 6) AS null_r, null_barrier, null_bar_idx FROM res")
def _q(spark, sf):
    o = _outcomes(spark, sf)
    return longs(o.select("entry_id", "barrier", *r6(["r", "mae_r", "mfe_r"]), "bars", "ambiguous", *r6(["null_r"]), "null_barrier", "null_bar_idx"), "bars")


_STATS = """SELECT {k} cost_mult, count(*) AS n, round(avg(x), 6) AS expectancy_r, round(avg((x > 0)::INT), 6) AS hit_rate,
  round(sum(CASE WHEN x > 0 THEN x ELSE 0 END) / nullif(sum(CASE WHEN x > 0 THEN 0 ELSE -x END), 0), 6) AS profit_factor, round(sum(x), 5) AS r_total, round(stddev_pop(x), 6) AS r_std,
  round(max(x), 6) AS best, round(min(x), 6) AS worst, round(avg(y), 6) AS null_expectancy_r, round(avg(x) - avg(y), 6) AS edge_vs_null,
  count(*) FILTER (barrier = 'tp') AS n_tp, count(*) FILTER (barrier = 'sl') AS n_sl, count(*) FILTER (barrier = 'vertical') AS n_vertical, round(avg(ambiguous::INT), 6) AS ambiguity_rate
  FROM (SELECT *, r - cost_r * cost_mult AS x, null_r - cost_r * cost_mult AS y FROM res, (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) v(cost_mult)) GROUP BY ALL"""


@query("backtest_stats", f"WITH RECURSIVE {_OUT_CTES} {_STATS.format(k='tf,')}")
def _q(spark, sf):
    from tidemark.operators.outcomes import backtest_stats
    s = backtest_stats(_outcomes(spark, sf), keys=["tf"])
    return s.select("tf", "cost_mult", "n", *r6(["expectancy_r", "hit_rate", "profit_factor"]), *r6(["r_total"], 5),
                    *r6(["r_std", "best", "worst", "null_expectancy_r", "edge_vs_null"]), "n_tp", "n_sl", "n_vertical", *r6(["ambiguity_rate"]))


@query("score_rank_corr", f"""WITH RECURSIVE {_OUT_CTES}, k AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS b FROM res)
  SELECT count(*) AS n, round(corr(a, b), 6) AS rank_corr FROM k""")
def _q(spark, sf):
    from tidemark.operators.outcomes import score_rank_corr
    return score_rank_corr(_outcomes(spark, sf)).select("n", *r6(["rank_corr"]))


@query("edge_ci", f"""WITH RECURSIVE {_OUT_CTES}, o AS (SELECT side, entry_id, r - cost_r AS x, r - null_r AS d,
    row_number() OVER (PARTITION BY side ORDER BY {oracle.hash32(23, 'entry_id')} % 256, entry_id) - 1 AS k, count(*) OVER (PARTITION BY side) AS n
    FROM (SELECT *, unnest(['all', CASE WHEN direction > 0 THEN 'long' ELSE 'short' END]) AS side FROM res)),
  pk AS (SELECT side, draw, {oracle.hash32(23, 'side', 'draw', 'k')} % n AS k FROM o, range(0, 1000) g(draw)),
  dr AS (SELECT side, draw, avg(x) AS x, avg(d) AS d FROM pk JOIN o USING (side, k) GROUP BY 1, 2)
  SELECT m.side, n, round(ex, 6) AS expectancy_r, round(ed, 6) AS edge_vs_null, round(quantile_cont(x, 0.025), 6) AS expectancy_lo, round(quantile_cont(x, 0.975), 6) AS expectancy_hi,
    round(quantile_cont(d, 0.025), 6) AS edge_lo, round(quantile_cont(d, 0.975), 6) AS edge_hi FROM dr JOIN (SELECT side, count(*) AS n, avg(x) AS ex, avg(d) AS ed FROM o GROUP BY 1) m USING (side) GROUP BY ALL""")
def _q(spark, sf):
    from tidemark.operators.outcomes import edge_ci
    return edge_ci(_outcomes(spark, sf), draws=1000).select("side", "n", *r6(["expectancy_r", "edge_vs_null", "expectancy_lo", "expectancy_hi", "edge_lo", "edge_hi"]))


# Entries from a catalogue signal, so that stops and targets are hit on both sides of the book.
_STREAK = f"""{oracle.BARS}, pos AS ({oracle.positions(['mean_reversion.streak3_fade'])}),
  entries AS MATERIALIZED (SELECT concat_ws(':', p.symbol, p.tf, p.bar_idx) AS entry_id, p.symbol, p.tf, p.bar_idx, p.position AS direction, b.close AS entry,
    b.close - p.position * 0.02::DOUBLE * b.close AS stop, b.close + p.position * 0.03::DOUBLE * b.close AS target FROM pos p JOIN bars b USING (symbol, tf, bar_idx) WHERE p.position <> 0)"""


def _streak_entries(spark, sf):
    p = signal_positions(inputs.study_panel(spark, sf), ["mean_reversion.streak3_fade"]).filter("position <> 0").drop("open_time_ms")
    b = inputs.study_bars(spark, sf).select("symbol", "tf", "bar_idx", "close")
    d, c = F.col("position").cast("int"), F.col("close")
    return p.join(b, ["symbol", "tf", "bar_idx"]).select(
        F.concat_ws(":", "symbol", "tf", "bar_idx").alias("entry_id"), "symbol", "tf", "bar_idx", d.alias("direction"), c.alias("entry"),
        (c - d * F.lit(0.02) * c).alias("stop"), (c + d * F.lit(0.03) * c).alias("target"))


@query("triple_barrier_signals", f"WITH RECURSIVE {_STREAK}, {oracle.barrier_ctes('entries', 'own')} SELECT entry_id, barrier, round(r, 6) AS r, round(mae_r, 6) AS mae_r, round(mfe_r, 6) AS mfe_r, bars, ambiguous FROM own")
def _q(spark, sf):
    from tidemark.operators.outcomes import triple_barrier
    o = triple_barrier(_streak_entries(spark, sf), inputs.study_bars(spark, sf))
    return longs(o.select("entry_id", "barrier", *r6(["r", "mae_r", "mfe_r"]), "bars", "ambiguous"), "bars")


@query("fine_tie_break", f"""WITH RECURSIVE {_STREAK}, {oracle.barrier_ctes('entries', 'own')},
  m AS MATERIALIZED ({oracle.raw_bars(oracle.EVENT_TICKS, '1m')} UNION ALL {oracle.raw_bars(oracle.LINEITEM_TICKS, '1m')}),
  amb AS (SELECT o.*, b.open_time_ms AS t0, b.tf_ms FROM own o JOIN bars b ON b.symbol = o.symbol AND b.tf = o.tf AND b.bar_idx = o.bar_idx + o.bars WHERE o.ambiguous),
  tch AS (SELECT a.entry_id, m.open_time_ms AS t, CASE WHEN a.direction > 0 THEN m.high >= a.target ELSE m.low <= a.target END AS tp, CASE WHEN a.direction > 0 THEN m.low <= a.stop ELSE m.high >= a.stop END AS sl
    FROM amb a JOIN m ON m.symbol = a.symbol AND m.open_time_ms >= a.t0 AND m.open_time_ms < a.t0 + a.tf_ms),
  fst AS (SELECT entry_id, first(CASE WHEN tp AND sl THEN 'tie' WHEN tp THEN 'tp' ELSE 'sl' END ORDER BY t) AS f FROM tch WHERE tp OR sl GROUP BY 1)
  SELECT o.entry_id, CASE WHEN f = 'tp' THEN 'tp' ELSE o.barrier END AS barrier, round(CASE WHEN f = 'tp' THEN abs(target - entry) / abs(entry - stop) ELSE o.r END, 6) AS r,
    o.ambiguous AND coalesce(f, 'tie') = 'tie' AS ambiguous FROM own o LEFT JOIN fst USING (entry_id)""")
def _q(spark, sf):
    from tidemark.operators.bars import ticks_to_minutes
    from tidemark.operators.outcomes import triple_barrier
    mins = ticks_to_minutes(inputs.event_ticks(spark, sf).unionByName(inputs.lineitem_ticks(spark, sf)))
    o = triple_barrier(_streak_entries(spark, sf), inputs.study_bars(spark, sf), fine=mins)
    return o.select("entry_id", "barrier", *r6(["r"]), "ambiguous")


# ------------------------------------------------------------------ evaluation

SAMPLE = oracle.SAMPLE_SIGNALS


def _sample_positions(spark, sf):
    return kept(spark, sf, "sample", lambda: signal_positions(inputs.study_panel(spark, sf), SAMPLE))


def _forward(spark, sf):
    from tidemark.operators.evaluate import forward_returns
    return kept(spark, sf, "forward", lambda: forward_returns(inputs.study_panel(spark, sf)))


@query("forward_returns", f"WITH {oracle.BARS}, {oracle.FWD} SELECT symbol, tf, bar_idx, open_time_ms, CAST(horizon AS BIGINT) AS horizon, round(fwd, 8) AS fwd FROM fwd")
def _q(spark, sf):
    return longs(_forward(spark, sf).select("symbol", "tf", "bar_idx", "open_time_ms", "horizon", *r6(["fwd"], 8)), "horizon")


@query("walk_forward_mask", f"WITH {oracle.BARS} SELECT symbol, tf, bar_idx, {oracle.oos('bar_idx', 'n_bars', '(' + oracle.HORIZON + ')')} AS oos FROM bars")
def _q(spark, sf):
    from tidemark.operators.evaluate import horizon_of, out_of_sample
    return inputs.study_bars(spark, sf).select("symbol", "tf", "bar_idx", out_of_sample(F.col("bar_idx"), F.col("n_bars"), horizon_of()).alias("oos"))


_EV_CTES = f"""{oracle.BARS}, {oracle.FWD}, {oracle.all_positions()}, {oracle.BAR_MS},
  act AS MATERIALIZED (SELECT p.signal_name, p.symbol, p.tf, p.bar_idx, p.position * f.fwd AS r, f.fwd, f.n_bars, f.open_time_ms, f.horizon * m.bar_ms AS w, {oracle.oos('p.bar_idx', 'f.n_bars', 'f.horizon')} AS oos, p.position
    FROM pos p JOIN fwd f USING (symbol, tf, bar_idx) JOIN bar_ms m USING (symbol, tf) WHERE p.position <> 0),
  {oracle.spaced('act', 'ne', 'signal_name, symbol, tf', 'open_time_ms', 'w')},
  nec AS (SELECT signal_name, symbol, tf, count(*) AS n_effective FROM ne GROUP BY 1, 2, 3),
  bas AS (SELECT symbol, tf, max(n_bars) AS n_bars, count(*) AS n_valid, avg(fwd) AS base_ret, avg((fwd > 0)::INT) AS base_rate, avg(fwd) FILTER ({oracle.oos('bar_idx', 'n_bars', 'horizon')}) AS base_oos FROM fwd GROUP BY 1, 2),
  ev AS MATERIALIZED (SELECT a.signal_name, a.symbol, a.tf, split_part(a.signal_name, '.', 1) AS family, count(*) AS n_signals, any_value(n_effective) AS n_effective, avg((r > 0)::INT) AS hit_rate, any_value(base_rate) AS base_rate,
    avg(r) AS mean_ret, any_value(base_ret) AS base_ret, avg(r) - any_value(base_ret) AS edge, CASE WHEN count(*) FILTER (oos) >= 20 THEN avg(r) FILTER (oos) - any_value(base_oos) END AS oos_edge,
    count(*) / any_value(n_valid) AS exposure FROM act a JOIN bas USING (symbol, tf) JOIN nec USING (signal_name, symbol, tf) WHERE bas.n_bars >= 500 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 60)"""
_EV_NUM = ["hit_rate", "base_rate", "mean_ret", "base_ret", "edge", "oos_edge", "exposure"]


def _all_positions(spark, sf):
    return kept(spark, sf, "positions", lambda: signal_positions(inputs.study_panel(spark, sf)))


def _evaluation(spark, sf):
    from tidemark.operators.evaluate import evaluate_signals
    return kept(spark, sf, "evaluation", lambda: evaluate_signals(_all_positions(spark, sf), _forward(spark, sf), inputs.study_panel(spark, sf)))


@query("evaluate_signals", f"WITH RECURSIVE {_EV_CTES} SELECT signal_name, symbol, tf, family, n_signals, n_effective, {', '.join(f'round({c}, 7) AS {c}' for c in _EV_NUM)} FROM ev")
def _q(spark, sf):
    return _evaluation(spark, sf).select("signal_name", "symbol", "tf", "family", "n_signals", "n_effective", *r6(_EV_NUM, 7))


@query("effective_n", f"WITH RECURSIVE {_EV_CTES} SELECT * FROM nec")
def _q(spark, sf):
    from tidemark.operators.evaluate import active_returns, effective_n, infer_bar_ms
    p = inputs.study_panel(spark, sf)
    a = active_returns(_all_positions(spark, sf), _forward(spark, sf)).join(infer_bar_ms(inputs.study_bars(spark, sf)), ["symbol", "tf"]).withColumn("w", F.col("horizon") * F.col("bar_ms"))
    return effective_n(a, ["signal_name", "symbol", "tf"], "w", chunk=p.chunk)


def _excess(spark, sf):
    from tidemark.operators.evaluate import excess_returns
    return kept(spark, sf, "excess", lambda: excess_returns(_sample_positions(spark, sf), _forward(spark, sf)))


_EX_CTES = f"{oracle.BARS}, {oracle.FWD}, {oracle.POS}, exc AS MATERIALIZED (SELECT p.signal_name, symbol, tf, bar_idx, f.n_bars, p.position * (f.fwd - avg_fwd) AS excess FROM pos p JOIN (SELECT *, avg(fwd) OVER (PARTITION BY symbol, tf) AS avg_fwd FROM fwd) f USING (symbol, tf, bar_idx) WHERE position <> 0)"


@query("excess_returns", f"WITH {_EX_CTES} SELECT signal_name, symbol, tf, bar_idx, round(excess, 8) AS excess FROM exc")
def _q(spark, sf):
    return _excess(spark, sf).select("signal_name", "symbol", "tf", "bar_idx", *r6(["excess"], 8))


@query("oos_degradation", f"WITH RECURSIVE {_EV_CTES} SELECT tf, count(*) AS n, round(avg((edge > 1e-12::DOUBLE)::INT), 6) AS positive_in, round(avg((oos_edge > 1e-12::DOUBLE)::INT), 6) AS positive_out, round(avg((edge > 1e-12::DOUBLE AND oos_edge > 1e-12::DOUBLE)::INT), 6) AS positive_both FROM ev WHERE oos_edge IS NOT NULL GROUP BY 1")
def _q(spark, sf):
    from tidemark.operators.evaluate import oos_degradation
    return oos_degradation(_evaluation(spark, sf)).select("tf", "n", *r6(["positive_in", "positive_out", "positive_both"]))


@query("family_rollup", f"WITH RECURSIVE {_EV_CTES} SELECT family, tf, count(*) AS n, round(avg(edge), 7) AS mean_edge, round(max(edge), 7) AS best_edge, round(avg(oos_edge), 7) AS mean_oos_edge, sum(n_effective)::BIGINT AS n_effective FROM ev GROUP BY ROLLUP (family, tf)")
def _q(spark, sf):
    from tidemark.operators.evaluate import family_rollup
    return family_rollup(_evaluation(spark, sf)).select("family", "tf", "n", *r6(["mean_edge", "best_edge", "mean_oos_edge"], 7), "n_effective")


@query("sidak", f"WITH RECURSIVE {_EV_CTES} SELECT signal_name, symbol, tf, round(1 - power(1 - hit_rate, 4), 6) AS p_adjusted FROM ev")
def _q(spark, sf):
    from tidemark.operators.evaluate import sidak
    return _evaluation(spark, sf).select("signal_name", "symbol", "tf", rd(sidak(F.col("hit_rate"), 4), 6).alias("p_adjusted"))


# ------------------------------------------------------------------ battery

_BT_CTES = f"""{oracle.BARS}, {oracle.POS}, {oracle.BAR_MS},
  ret AS MATERIALIZED (SELECT * FROM (SELECT symbol, tf, bar_idx, n_bars - 1 AS n, open_time_ms, ln(lead(close) OVER w / close) AS r, CASE WHEN bar_idx < n_bars - 2 THEN ln(lead(close, 2) OVER w / lead(close) OVER w) END AS fwd
    FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY bar_idx)) WHERE r IS NOT NULL),
  rw AS MATERIALIZED (SELECT p.signal_name, symbol, tf, bar_idx, ret.n, ret.r, ret.fwd, ret.open_time_ms, bar_ms, 31557600000.0 / bar_ms AS py, p.position AS w0, coalesce(lag(p.position) OVER w, 0) AS w1, coalesce(lag(p.position, 2) OVER w, 0) AS w2, coalesce(lag(p.position, 3) OVER w, 0) AS w3, coalesce(lag(p.position, 4) OVER w, 0) AS w4
    FROM pos p JOIN ret USING (symbol, tf, bar_idx) JOIN bar_ms USING (symbol, tf) WINDOW w AS (PARTITION BY p.signal_name, symbol, tf ORDER BY bar_idx)),
  cur AS MATERIALIZED (SELECT *, r * w0 - abs(w0 - w1) * 0.0015::DOUBLE AS x, sum(r * w0 - abs(w0 - w1) * 0.0015::DOUBLE) OVER w AS le, sum(r) OVER w AS lb FROM rw WINDOW w AS (PARTITION BY signal_name, symbol, tf ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
  dd AS MATERIALIZED (SELECT *, exp(le - max(le) OVER w) - 1 AS d, exp(lb - max(lb) OVER w) - 1 AS db FROM cur WINDOW w AS (PARTITION BY signal_name, symbol, tf ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
  oo AS (SELECT *, coalesce(lag(w0) OVER (PARTITION BY signal_name, symbol, tf ORDER BY bar_idx), 0) AS wo FROM rw WHERE {oracle.oos('bar_idx', 'n', '1')}),
  oa AS (SELECT signal_name, symbol, tf, count(*) AS n_oos, exp(sum(r * w0 - abs(w0 - wo) * 0.0015::DOUBLE) * any_value(py) / count(*)) - 1 AS cagr_oos, exp(sum(r) * any_value(py) / count(*)) - 1 AS cagr_bh_oos FROM oo GROUP BY 1, 2, 3),
  su AS MATERIALIZED (SELECT a.*, n_oos, cagr_oos, cagr_bh_oos, greatest(1, CAST(round_even(n_active / runs, 0) AS BIGINT)) AS mean_duration FROM (SELECT signal_name, symbol, tf, any_value(n) AS n, any_value(py) AS py, any_value(bar_ms) AS bar_ms, count(*) FILTER (w0 <> 0) AS n_active, avg(abs(w0)) AS exposure,
    exp(sum(x) * any_value(py) / any_value(n)) - 1 AS cagr, exp(sum(r * w1 - abs(w1 - w2) * 0.0015::DOUBLE) * any_value(py) / any_value(n)) - 1 AS cagr_late, exp(sum(r) * any_value(py) / any_value(n)) - 1 AS cagr_bh,
    CASE WHEN count(*) FILTER (w0 <> 0 AND fwd IS NOT NULL) >= 20 THEN avg(w0 * fwd) FILTER (w0 <> 0 AND fwd IS NOT NULL) END AS prop, coalesce(avg(fwd), 0) AS base, sum(abs(w0 - w1)) AS flips, greatest(1, count(*) FILTER (sign(w0) <> sign(w1))) AS runs
    FROM cur GROUP BY 1, 2, 3) a JOIN oa USING (signal_name, symbol, tf))"""
_SU_NUM = ["exposure", "cagr", "cagr_late", "cagr_bh", "cagr_oos", "cagr_bh_oos", "prop", "base"]


def _returns(spark, sf):
    from tidemark.operators.battery import bar_returns
    return kept(spark, sf, "returns", lambda: bar_returns(inputs.study_panel(spark, sf)))


def _battery_rows(spark, sf):
    from tidemark.operators.battery import battery_rows
    return kept(spark, sf, "battery", lambda: battery_rows(_sample_positions(spark, sf), _returns(spark, sf), inputs.study_panel(spark, sf)))


def _bar_ms(spark, sf):
    from tidemark.operators.evaluate import infer_bar_ms
    return kept(spark, sf, "barms", lambda: infer_bar_ms(inputs.study_bars(spark, sf)))


def _summary(spark, sf):
    from tidemark.operators.battery import battery_summary
    return kept(spark, sf, "summary", lambda: battery_summary(_battery_rows(spark, sf), _bar_ms(spark, sf)))


@query("equity_curve", f"WITH {_BT_CTES} SELECT signal_name, symbol, tf, bar_idx, round(le, 6) AS log_eq, round(d, 6) AS drawdown, round(db, 6) AS drawdown_bh FROM dd")
def _q(spark, sf):
    from tidemark.operators.battery import equity_curves
    c = equity_curves(_battery_rows(spark, sf), inputs.study_panel(spark, sf))
    return c.select("signal_name", "symbol", "tf", "bar_idx", *r6(["log_eq", "drawdown", "drawdown_bh"], 6))


@query("downsample_curve", f"WITH {_BT_CTES} SELECT signal_name, symbol, tf, bar_idx, round(le, 6) AS log_eq FROM dd WHERE bar_idx % greatest(1, n // 600) = 0")
def _q(spark, sf):
    from tidemark.operators.battery import downsample_curve, equity_curves
    return downsample_curve(equity_curves(_battery_rows(spark, sf), inputs.study_panel(spark, sf))).select("signal_name", "symbol", "tf", "bar_idx", *r6(["log_eq"], 6))


@query("curve_stats", f"""WITH {_BT_CTES} SELECT signal_name, symbol, tf, any_value(n) AS n, {squash_sql('(exp(sum(x) * any_value(py) / any_value(n)) - 1)', 'cagr')}, round(coalesce(avg(x) FILTER (bar_idx > 0) / nullif(stddev_pop(x) FILTER (bar_idx > 0), 0) * sqrt(any_value(py)), 0), 5) AS sharpe,
  round(min(d), 7) AS max_dd, {squash_sql('(exp(sum(r) * any_value(py) / any_value(n)) - 1)', 'cagr_bh')}, round(avg(r) FILTER (bar_idx > 0) / stddev_pop(r) FILTER (bar_idx > 0) * sqrt(any_value(py)), 5) AS sharpe_bh, round(min(db), 7) AS max_dd_bh FROM dd GROUP BY 1, 2, 3""")
def _q(spark, sf):
    from tidemark.operators.battery import curve_stats, equity_curves
    s = curve_stats(equity_curves(_battery_rows(spark, sf), inputs.study_panel(spark, sf)), _bar_ms(spark, sf))
    return s.select("signal_name", "symbol", "tf", "n", squash("cagr"), squash("cagr_bh"), *r6(["sharpe", "sharpe_bh"], 5), *r6(["max_dd", "max_dd_bh"], 7))


@query("battery_summary", f"WITH {_BT_CTES} SELECT signal_name, symbol, tf, n, n_active, n_oos, runs, mean_duration, {', '.join(squash_sql(c, c) for c in _SU_NUM)} FROM su")
def _q(spark, sf):
    return _summary(spark, sf).select("signal_name", "symbol", "tf", "n", "n_active", "n_oos", "runs", "mean_duration", *[squash(c) for c in _SU_NUM])


@query("delay_sweep", f"""WITH {_BT_CTES} SELECT signal_name, symbol, tf, CAST(delay AS BIGINT) AS delay, {squash_sql('(exp(sum(r * p - abs(p - q) * 0.0015::DOUBLE) * any_value(py) / any_value(n)) - 1)', 'cagr')}
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS delay, unnest([w0, w1, w2, w3]) AS p, unnest([w1, w2, w3, w4]) AS q FROM rw) GROUP BY 1, 2, 3, 4""")
def _q(spark, sf):
    from tidemark.operators.battery import delay_sweep
    return longs(delay_sweep(_battery_rows(spark, sf), _bar_ms(spark, sf), panel=inputs.study_panel(spark, sf)).withColumn("cagr", squash("cagr")), "delay")


_RC_CTES = f"""{_BT_CTES},
  ps AS (SELECT symbol, tf, bar_idx + 1 AS upto, sum(r) OVER (PARTITION BY symbol, tf ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS cum FROM ret UNION ALL SELECT DISTINCT symbol, tf, 0, 0.0 FROM ret),
  sg0 AS (SELECT signal_name, symbol, tf, n, py, exposure, draw, seg, lo + ({oracle.hash32(11, 'signal_name', 'symbol', 'tf', 'draw', 'seg', "'len'")} % (hi - lo)) AS len,
      ({oracle.hash32(11, 'signal_name', 'symbol', 'tf', 'draw', 'seg', "'on'")} / 4294967296.0::DOUBLE < exposure)::INT AS sw
    FROM (SELECT *, greatest(2, dur // 2) AS lo, greatest(3, dur * 2) AS hi FROM (SELECT *, greatest(2, CAST(floor(n / greatest(flips, 1)) AS BIGINT)) AS dur FROM su)), range(0, 250) d(draw), range(0, 2000) g(seg) WHERE seg <= ceil(n / lo)),
  sg1 AS (SELECT *, sum(len) OVER (PARTITION BY signal_name, symbol, tf, draw ORDER BY seg) AS e FROM sg0),
  sg AS MATERIALIZED (SELECT *, e - len AS b, abs(sw - coalesce(lag(sw) OVER (PARTITION BY signal_name, symbol, tf, draw ORDER BY seg), 0)) AS flip FROM sg1 WHERE e - len < n),
  rc AS MATERIALIZED (SELECT s.signal_name, s.symbol, s.tf, s.draw, exp((sum(CASE WHEN sw = 1 THEN p1.cum - p0.cum ELSE 0 END) - sum(flip) * 0.0015::DOUBLE) * any_value(py) / any_value(n)) - 1 AS cagr
    FROM sg s JOIN ps p0 ON p0.symbol = s.symbol AND p0.tf = s.tf AND p0.upto = s.b JOIN ps p1 ON p1.symbol = s.symbol AND p1.tf = s.tf AND p1.upto = least(s.e, s.n) GROUP BY 1, 2, 3, 4)"""


@query("random_control", f"WITH {_RC_CTES} SELECT signal_name, symbol, tf, CAST(draw AS BIGINT) AS draw, {squash_sql('cagr', 'cagr')} FROM rc")
def _q(spark, sf):
    from tidemark.operators.battery import random_control
    rc = random_control(_summary(spark, sf), _returns(spark, sf), draws=250, exact_hash=True)
    return longs(rc.withColumn("cagr", squash("cagr")), "draw")


_TEST_CTES = f"""{_RC_CTES},
  actb AS MATERIALIZED (SELECT rw.signal_name, symbol, tf, rw.open_time_ms, su.mean_duration * su.bar_ms AS w FROM rw JOIN su USING (signal_name, symbol, tf) WHERE w0 <> 0),
  {oracle.spaced('actb', 'neb', 'signal_name, symbol, tf', 'open_time_ms', 'w')},
  tt AS MATERIALIZED (SELECT su.*, cagr - cagr_bh AS exc, coalesce(c.k, 0) AS n_effective, p.pct FROM su LEFT JOIN (SELECT signal_name, symbol, tf, count(*) AS k FROM neb GROUP BY 1, 2, 3) c USING (signal_name, symbol, tf)
    JOIN (SELECT signal_name, symbol, tf, avg((rc.cagr < su.cagr)::INT) AS pct FROM rc JOIN su USING (signal_name, symbol, tf) GROUP BY 1, 2, 3) p USING (signal_name, symbol, tf)),
  te AS MATERIALIZED (SELECT signal_name, symbol, tf, unnest(['delay', 'base_rate', 'random_control', 'out_of_sample', 'effective_n']) AS test,
    unnest([CASE WHEN abs(exc) > 1e-9 THEN (cagr_late - cagr_bh) / exc >= 0.5 ELSE true END, prop > base, pct >= 0.95::DOUBLE, CASE WHEN n_oos > 100 AND exc > 0 THEN CASE WHEN abs(exc) > 1e-9 THEN (cagr_oos - cagr_bh_oos) / exc >= 0.5 ELSE true END END, n_effective >= 30]) AS passed,
    unnest([cagr_late, coalesce(prop, 0) * 100, pct * 100, CASE WHEN n_oos > 100 THEN cagr_oos ELSE 0 END, n_effective::DOUBLE]) AS value FROM tt)"""


def _tests(spark, sf):
    from tidemark.operators.battery import battery_tests
    return battery_tests(_battery_rows(spark, sf), _returns(spark, sf), inputs.study_panel(spark, sf), _bar_ms(spark, sf), draws=250, exact_hash=True)


@query("battery_tests", f"WITH RECURSIVE {_TEST_CTES} SELECT signal_name, symbol, tf, test, passed, {squash_sql('value', 'value')} FROM te")
def _q(spark, sf):
    return _tests(spark, sf)[1].select("signal_name", "symbol", "tf", "test", "passed", squash("value"))


@query("battery_verdict", f"""WITH RECURSIVE {_TEST_CTES} SELECT signal_name, symbol, tf, CASE WHEN bool_or(test = 'delay' AND passed = false) THEN 'lookahead' WHEN count(*) FILTER (passed = false) >= 2 THEN 'fails' WHEN count(*) FILTER (passed = false) = 1 THEN 'doubtful' ELSE 'survives' END AS verdict FROM te GROUP BY 1, 2, 3""")
def _q(spark, sf):
    return _tests(spark, sf)[0].select("signal_name", "symbol", "tf", "verdict")


@query("battery_gate", f"""WITH {oracle.POS} SELECT signal_name, symbol, tf, count(*) AS n_bars, count(*) FILTER (position <> 0) AS n_active, CASE WHEN count(*) < 1000 THEN 'too_few_bars' WHEN count(*) FILTER (position <> 0) < 500 THEN 'too_few_active_bars' END AS refused FROM pos GROUP BY 1, 2, 3""")
def _q(spark, sf):
    from tidemark.operators.battery import battery_gate
    return battery_gate(_sample_positions(spark, sf), inputs.study_panel(spark, sf), min_bars=1000, min_active=500)


# ------------------------------------------------------------------ multiple testing

_ME = "mns AS MATERIALIZED (SELECT symbol, tf, signal_name, max(n_bars) AS n, sum(excess) / max(n_bars) AS mean FROM exc GROUP BY 1, 2, 3)"
_BL_CTES = f"""{_EX_CTES}, {_ME},
  bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY mean DESC, signal_name) AS k FROM mns) WHERE k = 1),
  ser AS (SELECT b.symbol, b.tf, s.signal_name, b.bar_idx, coalesce(e.excess, 0) - s.mean AS x FROM bars b JOIN bst s USING (symbol, tf) LEFT JOIN exc e ON e.symbol = b.symbol AND e.tf = b.tf AND e.bar_idx = b.bar_idx AND e.signal_name = s.signal_name),
  rho AS (SELECT symbol, tf, greatest(-0.9, least(0.9, sum(x * nx) / sum(x * x))) AS rho FROM (SELECT *, lead(x) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) AS nx FROM ser) GROUP BY 1, 2),
  bl AS MATERIALIZED (SELECT b.symbol, b.tf, b.signal_name AS best_name, b.mean AS best_mean, b.n, greatest(2.0, least(b.n / 4.0, power(b.n, 1 / 3.0::DOUBLE) * (1 + 2 * abs(rho)))) AS block FROM bst b JOIN rho USING (symbol, tf)),
  ln AS MATERIALIZED (SELECT *, coalesce((SELECT c FROM range(greatest(2, t - greatest(2, t // 5)), t + greatest(2, t // 5) + 1) r(c) WHERE n % c = 0 AND n // c >= 30 ORDER BY abs(c - t), c DESC LIMIT 1), t) AS len FROM (SELECT *, greatest(2, CAST(round_even(block, 0) AS BIGINT)) AS t FROM bl))"""


@query("block_length", f"WITH {_BL_CTES} SELECT symbol, tf, best_name, n, round(block, 6) AS block, len FROM ln")
def _q(spark, sf):
    from tidemark.operators.multiple import block_length, divisible_length, strategy_means
    ex = _excess(spark, sf)
    b = block_length(ex, strategy_means(ex))
    t = F.greatest(F.lit(2), F.bround("block")).cast("long")
    return b.select("symbol", "tf", "best_name", "n", rd("block", 6).alias("block"), divisible_length(t, F.col("n")).alias("len"))


_BM_CTES = f"""{_BL_CTES}, bm AS MATERIALIZED (SELECT symbol, tf, signal_name, bar_idx // len AS blk, avg(x) AS bm, any_value(nb) AS nb FROM (
    SELECT b.symbol, b.tf, m.signal_name, b.bar_idx, l.len, l.n // l.len AS nb, coalesce(e.excess, 0) - m.mean AS x FROM bars b JOIN mns m USING (symbol, tf) JOIN ln l USING (symbol, tf)
    LEFT JOIN exc e ON e.symbol = b.symbol AND e.tf = b.tf AND e.bar_idx = b.bar_idx AND e.signal_name = m.signal_name) WHERE bar_idx < len * nb GROUP BY 1, 2, 3, 4)"""


@query("block_means", f"WITH {_BM_CTES} SELECT symbol, tf, signal_name, blk, round(bm, 9) AS bm FROM bm")
def _q(spark, sf):
    from tidemark.operators import multiple as M
    ex = _excess(spark, sf)
    m = M.strategy_means(ex)
    plan = M.block_length(ex, m)
    plan = plan.withColumn("len", M.divisible_length(F.greatest(F.lit(2), F.bround("block")).cast("long"), F.col("n"))).withColumn("nb", F.floor(F.col("n") / F.col("len")))
    return M.block_means(ex, plan, m).select("symbol", "tf", "signal_name", "blk", *r6(["bm"], 9))


def _draw_sql(seed: int, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT k.symbol, k.tf, k.draw, b.signal_name, avg(b.bm) AS m FROM (SELECT symbol, tf, draw, {oracle.hash32(seed, 'symbol', 'tf', 'draw', 'slot')} % nb AS blk
      FROM (SELECT symbol, tf, n // len AS nb FROM ln), range(0, 2000) d(draw), range(0, 3000) s(slot) WHERE slot < nb) k JOIN bm b ON b.symbol = k.symbol AND b.tf = k.tf AND b.blk = k.blk GROUP BY 1, 2, 3, 4)"""


_RCK = f"{_BM_CTES}, {_draw_sql(7, 'd1')}, {_draw_sql(8, 'd2')}"


@query("reality_check", f"""WITH {_RCK} SELECT l.symbol, l.tf, best_name, round(sqrt(n) * best_mean, 7) AS best_stat, round(p, 6) AS p_value, k AS n_strategies, n AS n_obs, round(block, 6) AS block_length FROM ln l
  JOIN (SELECT symbol, tf, avg((mx >= v)::INT) AS p FROM (SELECT symbol, tf, draw, max(m) AS mx FROM d1 GROUP BY 1, 2, 3) JOIN (SELECT symbol, tf, max(mean) AS v FROM mns GROUP BY 1, 2) USING (symbol, tf) GROUP BY 1, 2) USING (symbol, tf)
  JOIN (SELECT symbol, tf, count(*) AS k FROM mns GROUP BY 1, 2) USING (symbol, tf)""")
def _q(spark, sf):
    from tidemark.operators.multiple import reality_check
    top, _ = reality_check(_excess(spark, sf), draws=2000, exact_hash=True)
    return top.select("symbol", "tf", "best_name", *r6(["best_stat"], 7), *r6(["p_value"]), "n_strategies", "n_obs", *r6(["block_length"]))


@query("reality_check_strategies", f"WITH {_RCK} SELECT symbol, tf, signal_name, round(avg((m >= mean)::INT), 6) AS p_value FROM d2 JOIN mns USING (symbol, tf, signal_name) GROUP BY 1, 2, 3")
def _q(spark, sf):
    from tidemark.operators.multiple import reality_check
    _, each = reality_check(_excess(spark, sf), draws=2000, exact_hash=True)
    return each.select("symbol", "tf", "signal_name", *r6(["p_value"]))


_SHORT_BARS = oracle.indexed(oracle.raw_bars(oracle.EVENT_TYPE_TICKS, "1d"))
_SHORT_CTES = _BL_CTES[_BL_CTES.index("mns AS MATERIALIZED"):]
_SHORT = f"""bars AS MATERIALIZED ({_SHORT_BARS}),
  fw AS (SELECT *, ln(lead(close) OVER w / close) AS fwd, lag(close, 1) OVER w AS l1, lag(close, 2) OVER w AS l2, lag(close, 3) OVER w AS l3, lag(close, 5) OVER w AS l5 FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY bar_idx)),
  base AS (SELECT symbol, tf, avg(fwd) AS b FROM fw GROUP BY 1, 2),
  exc AS MATERIALIZED (SELECT 'change' || k AS signal_name, symbol, tf, bar_idx, n_bars, sign(close - l) * (fwd - b) AS excess FROM (
    SELECT *, unnest([1, 2, 3, 5]) AS k, unnest([l1, l2, l3, l5]) AS l FROM fw) JOIN base USING (symbol, tf) WHERE l IS NOT NULL AND close <> l AND fwd IS NOT NULL), {_SHORT_CTES},
  cuts AS (SELECT symbol, tf, n, block, draw, t FROM (SELECT symbol, tf, n, block FROM ln), range(0, 2000) d(draw), range(0, 800) b(t) WHERE t < n AND (t = 0 OR {oracle.hash32(7, 'symbol', 'tf', 'draw', 't', "'p'")} / 4294967296.0::DOUBLE < 1.0 / greatest(block, 1.0))),
  blks AS (SELECT *, {oracle.hash32(7, 'symbol', 'tf', 'draw', 't', "'i'")} % n AS i, coalesce(lead(t) OVER (PARTITION BY symbol, tf, draw ORDER BY t), n) - t AS len FROM cuts),
  drawn AS (SELECT symbol, tf, draw, n, (i + unnest(range(0, len))) % n AS bar_idx FROM blks),
  dm AS MATERIALIZED (SELECT m.symbol, m.tf, d.draw, m.signal_name, sum(coalesce(e.excess, 0)) / any_value(d.n) - any_value(m.mean) AS m FROM drawn d JOIN mns m USING (symbol, tf)
    LEFT JOIN exc e ON e.symbol = d.symbol AND e.tf = d.tf AND e.bar_idx = d.bar_idx AND e.signal_name = m.signal_name GROUP BY 1, 2, 3, 4)"""


def _short_excess(spark, sf):
    """Thirty daily bars per event type; the sign of the change over 1, 2, 3 and 5 days as four strategies."""
    from pyspark.sql import Window as W

    from tidemark.operators.bars import dense_bar_index, ticks_to_bars
    b = dense_bar_index(ticks_to_bars(inputs.event_ticks(spark, sf, "event_type"), ["1d"]))
    w = W.partitionBy("symbol", "tf").orderBy("bar_idx")
    b = b.select("symbol", "tf", "bar_idx", "n_bars", "close", F.ln(F.lead("close").over(w) / F.col("close")).alias("fwd"), *[F.lag("close", k).over(w).alias(f"l{k}") for k in (1, 2, 3, 5)])
    b = b.withColumn("s", F.explode(F.array(*[F.struct(F.lit(f"change{k}").alias("signal_name"), F.col(f"l{k}").alias("l")) for k in (1, 2, 3, 5)])))
    base = b.filter("s.signal_name = 'change1'").groupBy("symbol", "tf").agg(F.avg("fwd").alias("b"))
    return b.join(base, ["symbol", "tf"]).filter("s.l IS NOT NULL AND close <> s.l AND fwd IS NOT NULL").select(
        "s.signal_name", "symbol", "tf", "bar_idx", "n_bars", (F.signum(F.col("close") - F.col("s.l")) * (F.col("fwd") - F.col("b"))).alias("excess"))


@query("stationary_bootstrap", f"""WITH {_SHORT} SELECT l.symbol, l.tf, best_name, round(sqrt(n) * best_mean, 7) AS best_stat, round(p, 6) AS p_value, 4 AS n_strategies, n AS n_obs, round(block, 6) AS block_length FROM ln l
  JOIN (SELECT symbol, tf, avg((mx >= v)::INT) AS p FROM (SELECT symbol, tf, draw, max(m) AS mx FROM dm GROUP BY 1, 2, 3) JOIN (SELECT symbol, tf, max(mean) AS v FROM mns GROUP BY 1, 2) USING (symbol, tf) GROUP BY 1, 2) USING (symbol, tf)""")
def _q(spark, sf):
    """All 2,000 draws."""
    from tidemark.operators.multiple import reality_check
    top, _ = reality_check(materialize(_short_excess(spark, sf), "short"), draws=2000)
    return top.select("symbol", "tf", "best_name", *r6(["best_stat"], 7), *r6(["p_value"]), F.col("n_strategies").cast("int").alias("n_strategies"), "n_obs", *r6(["block_length"]))


@query("stationary_bootstrap_strategies", f"WITH {_SHORT} SELECT symbol, tf, signal_name, round(avg((m >= mean)::INT), 6) AS p_value FROM dm JOIN mns USING (symbol, tf, signal_name) GROUP BY 1, 2, 3")
def _q(spark, sf):
    from tidemark.operators.multiple import reality_check
    _, each = reality_check(materialize(_short_excess(spark, sf), "short"), draws=2000)
    return each.select("symbol", "tf", "signal_name", *r6(["p_value"]))


@query("rc_alignment_gate", f"""WITH {_SHORT}, g AS (SELECT symbol, tf, signal_name, CASE WHEN symbol = (SELECT max(symbol) FROM mns) AND signal_name = 'change2' THEN n - 1 ELSE n END AS n FROM mns WHERE symbol <> (SELECT min(symbol) FROM mns) OR signal_name = 'change3')
  SELECT symbol, tf, count(*) AS k, CASE WHEN count(DISTINCT n) > 1 THEN 'different_lengths' WHEN count(*) < 2 THEN 'one_strategy' ELSE 'corrected' END AS gate FROM g GROUP BY 1, 2""")
def _q(spark, sf):
    """One symbol with a single strategy, one with a strategy that is a bar short; the others pass."""
    from tidemark.operators.multiple import aligned, alignment_refusals, strategy_means
    m = strategy_means(materialize(_short_excess(spark, sf), "short"))
    end = m.agg(F.min("symbol").alias("a"), F.max("symbol").alias("z")).first()
    m = m.filter((F.col("symbol") != end["a"]) | (F.col("signal_name") == "change3")).withColumn("n", F.when((F.col("symbol") == end["z"]) & (F.col("signal_name") == "change2"), F.col("n") - 1).otherwise(F.col("n")))
    return aligned(m).withColumn("gate", F.lit("corrected")).unionByName(alignment_refusals(m).withColumnRenamed("refused", "gate"))


_TRIAL_SQL = """t AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS ts_ms, md5(CAST(o_custkey % 50 AS VARCHAR)) AS config_hash, CASE o_orderstatus WHEN 'F' THEN 'manual' WHEN 'O' THEN 'walkforward' ELSE 'startup' END AS kind, o_orderpriority AS fixture_set, o_totalprice AS value FROM orders)"""


def _trials(spark, sf):
    """Orders read as evaluations of fifty configurations."""
    from tidemark.functions.clock import as_ms
    return inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), as_ms("o_orderdate").alias("ts_ms"), F.md5((F.col("o_custkey") % 50).cast("string").cast("binary")).alias("config_hash"),
        F.when(F.col("o_orderstatus") == "F", "manual").when(F.col("o_orderstatus") == "O", "walkforward").otherwise("startup").alias("kind"),
        F.col("o_orderpriority").alias("fixture_set"), F.col("o_totalprice").alias("value"))


@query("trial_log", f"WITH {_TRIAL_SQL} SELECT config_hash, kind, fixture_set, id, ts_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY config_hash, kind, fixture_set ORDER BY ts_ms DESC, id DESC) AS k FROM t) WHERE k = 1")
def _q(spark, sf):
    from tidemark.operators.multiple import trial_log
    return trial_log(_trials(spark, sf))


@query("effective_trials", f"WITH {_TRIAL_SQL} SELECT count(DISTINCT config_hash) AS n FROM t")
def _q(spark, sf):
    from tidemark.operators.multiple import effective_trials
    return effective_trials(_trials(spark, sf))


@query("trial_summary", f"WITH {_TRIAL_SQL} SELECT kind, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(DISTINCT config_hash) AS n_configs FROM t GROUP BY 1")
def _q(spark, sf):
    from tidemark.operators.multiple import trial_summary
    return trial_summary(_trials(spark, sf))


# ------------------------------------------------------------------ audits

AUDIT = SAMPLE
_CUTS = (("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("last", None))


def _audit_sql(names, cuts) -> str:
    from tidemark.signals.registry import catalogue
    cat = catalogue()
    pairs = ", ".join(f"('{n}', '{t}')" for n in names for t in cat[n].timeframes)
    at = " UNION ALL ".join(f"SELECT *, '{c}' AS cut, {'n - 1' if f is None else f'CAST(floor(n * {f}::DOUBLE) AS BIGINT)'} AS compared FROM s" for c, f in cuts)
    return f"""WITH {oracle.BARS}, s AS (SELECT symbol, tf, max(n_bars) AS n FROM bars GROUP BY 1, 2), c AS ({at})
      SELECT signal_name, symbol, c.tf, cut, compared, 0 AS mismatches, CAST(NULL AS BIGINT) AS first_bar FROM c JOIN (VALUES {pairs}) v(signal_name, tf) ON v.tf = c.tf WHERE compared > 0"""


@query("audit_prefix", _audit_sql(AUDIT, _CUTS))
def _q(spark, sf):
    from tidemark.operators.audit import audit_prefix
    return audit_prefix(inputs.study_bars(spark, sf), inputs.study_panel(spark, sf), AUDIT, cuts=_CUTS)


_AUDIT_MACHINES = ("structure.retest_hold", "trend.psar_002_020", "trend.supertrend_atr14_x3", "volatility.keltner_breakout")


@query("audit_prefix_machines", _audit_sql(_AUDIT_MACHINES, _CUTS))
def _q(spark, sf):
    from tidemark.operators.audit import audit_prefix
    return audit_prefix(inputs.study_bars(spark, sf), inputs.study_panel(spark, sf), _AUDIT_MACHINES, cuts=_CUTS)


@query("audit_rewrite_future", _audit_sql(AUDIT, (("q2", 0.5),)))
def _q(spark, sf):
    from tidemark.operators.audit import audit_rewrite_future
    return audit_rewrite_future(inputs.study_bars(spark, sf), inputs.study_panel(spark, sf), AUDIT)


@query("audit_planted_lookahead", f"""WITH p AS (SELECT *, '{'planted'}' AS signal_name FROM ({oracle.indexed(oracle.STUDY)})),
  c AS (SELECT symbol, tf, max(n_bars) // 2 AS compared FROM p GROUP BY 1, 2), x AS (SELECT p.*, lead(close) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) AS nx FROM p)
  SELECT 'planted' AS signal_name, x.symbol, x.tf, 'q2' AS cut, any_value(compared) AS compared, count(*) FILTER (bar_idx = compared - 1 AND sign(nx * 1.6::DOUBLE - close) <> sign(nx - close)) AS mismatches,
    min(CASE WHEN bar_idx = compared - 1 AND sign(nx * 1.6::DOUBLE - close) <> sign(nx - close) THEN bar_idx END) AS first_bar FROM x JOIN c USING (symbol, tf) WHERE bar_idx < compared GROUP BY ALL""")
def _q(spark, sf):
    """A signal that reads the next bar must be caught by the rewrite of the future."""
    from tidemark.operators.audit import audit_rewrite_future
    from tidemark.operators.panel import win

    def planted(panel, _names):
        nxt = F.lead("close").over(win())
        d = panel.with_df(panel.df.withColumn("position", F.signum(nxt - F.col("close")))).owned()
        return d.select(F.lit("planted").alias("signal_name"), "symbol", "tf", "bar_idx", "open_time_ms", "position")
    return audit_rewrite_future(inputs.study_bars(spark, sf), inputs.study_panel(spark, sf), run=planted)


@query("audit_determinism", f"""SELECT unnest(['open_time_ms', 'position']) AS "column", (SELECT count(*) FROM ({oracle.positions(['momentum.roc10'])})) AS rows, 0 AS mismatches""")
def _q(spark, sf):
    from tidemark.operators.audit import audit_determinism
    p = inputs.study_panel(spark, sf)
    return audit_determinism(signal_positions(p, ["momentum.roc10"]), signal_positions(p, ["momentum.roc10"]), ["signal_name", "symbol", "tf", "bar_idx"])


@query("audit_available_at", f"""WITH {oracle.PIV} SELECT symbol, tf, variant, pivot_no, 'from_the_future' AS violation FROM piv WHERE confirmed_ts_ms > ts_ms""")
def _q(spark, sf):
    """Using a pivot at the time of its extreme is the classic leak: every such use is reported."""
    from tidemark.operators.audit import audit_available_at
    return audit_available_at(_pivots(spark, sf), "confirmed_ts_ms", "ts_ms").select("symbol", "tf", "variant", "pivot_no", "violation")


@query("audit_signal_properties", f"""SELECT signal_name, count(*) AS rows, 0 AS bad_values, 0 AS warmup_positions, 0 AS scale_mismatches FROM ({oracle.positions()}) GROUP BY 1""")
def _q(spark, sf):
    from tidemark.operators.audit import audit_signal_properties
    return audit_signal_properties(inputs.study_bars(spark, sf), inputs.study_panel(spark, sf), AUDIT)


# ------------------------------------------------------------------ streaming

def _event_stream(spark, sf, per_file: int | None = None):
    schema = inputs.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df, label: str, spark, mode: str = "append", query_start=None):
    """Run a stream to the end of its input and read what it wrote."""
    import uuid

    from tidemark.session import checkpoint_root
    root = f"{checkpoint_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    (df.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query("stream_bars_from_ticks", f"""WITH b AS ({oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '15m')}), m AS (SELECT max(epoch_us(ts)) // 1000 - 120000 AS wm FROM events)
  SELECT symbol, tf, open_time_ms, open, high, low, close, volume, trades FROM b, m WHERE open_time_ms + tf_ms <= wm""")
def _q(spark, sf):
    from tidemark.streaming.live import stream_ticks
    t = _event_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    return _drain(stream_ticks(t, "15m", "2 minutes"), "stream-ticks", spark).select("symbol", "tf", "open_time_ms", *OHLCV, "trades")


def _minute_feed(spark, sf):
    """Event minutes as a feed that sends every minute in flight, closed, and once more after a gap."""
    import uuid

    from tidemark.session import checkpoint_root
    root = f"{checkpoint_root(spark)}/tidemark/feed-{uuid.uuid4().hex}"
    m = inputs.event_minutes(spark, sf).select("symbol", "open_time_ms", *OHLCV)
    m.withColumn("is_closed", F.explode(F.array(F.lit(False), F.lit(True), F.lit(True)))).write.parquet(root)
    return spark.readStream.schema("symbol string, open_time_ms long, open double, high double, low double, close double, volume double, is_closed boolean").parquet(root)


@query("stream_closed_minutes", "SELECT DISTINCT event_type AS symbol, (epoch_us(ts) // 60000000) * 60000 AS open_time_ms FROM events")
def _q(spark, sf):
    from tidemark.streaming.live import closed_minutes
    return _drain(closed_minutes(_minute_feed(spark, sf)), "stream-min", spark).select("symbol", "open_time_ms")


@query("stream_resample", f"""WITH b AS ({oracle.raw_bars(oracle.EVENT_TYPE_TICKS, '1h')}), m AS (SELECT max((epoch_us(ts) // 60000000) * 60000) - 120000 AS wm FROM events)
  SELECT symbol, tf, open_time_ms, open, high, low, close, volume, n_source_bars FROM b, m WHERE open_time_ms + tf_ms <= wm""")
def _q(spark, sf):
    from tidemark.streaming.live import closed_minutes, stream_resample
    return longs(_drain(stream_resample(closed_minutes(_minute_feed(spark, sf)), "1h"), "stream-1h", spark).select(
        "symbol", "tf", "open_time_ms", *OHLCV, "n_source_bars"), "n_source_bars")


_MINUTES = "SELECT symbol, t - t % 60000 AS open_time_ms, first(price ORDER BY t, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY t, seq) AS close, sum(size) AS volume FROM ({}) GROUP BY 1, 2"


def _root(spark, label: str) -> str:
    import uuid

    from tidemark.session import checkpoint_root
    return f"{checkpoint_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def _restarted(spark, writers, start):
    """Feed files one per micro-batch: the query runs over the first half of them, ends, and a new one goes on from its checkpoint."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")          # state is partitioned by a dozen series here
    try:
        half = len(writers) // 2
        for part in (writers[:half], writers[half:]):
            for write in part:
                write()
            start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _files_of(spark, schema: str, root: str):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def _append(df, out: str, ck: str):
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()


@query("stream_provisional", f"""WITH m AS ({_MINUTES.format(oracle.EVENT_TYPE_TICKS)}), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS k FROM m)
  SELECT symbol, open_time_ms, open, high, low, close, volume FROM r WHERE k = 1 AND symbol <> (SELECT min(symbol) FROM m)""")
def _q(spark, sf):
    """Every minute is sent in flight, half done first, and then closed; the last minute stays in flight except for one symbol."""
    from tidemark.streaming.live import read_provisional, sink_provisional
    root = _root(spark, "prov")
    m = inputs.event_minutes(spark, sf).select("symbol", "open_time_ms", *OHLCV)
    last = m.groupBy("symbol").agg(F.max("open_time_ms").alias("last"))
    end = last.agg(F.min("symbol").alias("s"), F.min("last").alias("a")).first()
    states = F.explode(F.when((F.col("open_time_ms") < F.col("last")) | (F.col("symbol") == end["s"]), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))))
    feed = m.join(last, "symbol").withColumn("state", states).select("symbol", "open_time_ms", "open", "high", "low", "close", F.when(F.col("state") == 0, F.col("volume") / 2).otherwise(F.col("volume")).alias("volume"), (F.col("state") == 2).alias("is_closed"))
    first = m.agg(F.min("open_time_ms")).first()[0]
    piece = F.least(F.floor((F.col("open_time_ms") - first) * 6 / (end["a"] - first + 1)), F.lit(5))
    writers = inputs.in_files(feed, piece, 6, f"{root}/feed")
    _restarted(spark, writers, lambda: sink_provisional(_files_of(spark, "symbol string, open_time_ms long, open double, high double, low double, close double, volume double, is_closed boolean", f"{root}/feed"), f"{root}/out", f"{root}/ck"))
    return read_provisional(spark, f"{root}/out")


_LATE = f"""m AS ({_MINUTES.format(oracle.EVENT_TYPE_TICKS)}),
  f AS (SELECT *, open_time_ms + 60000 * (1 + CASE WHEN open_time_ms // 60000 % 13 = 0 THEN 300 WHEN open_time_ms // 60000 % 11 = 0 THEN 30 ELSE 0 END + 20 * copy) AS arrival_ms
    FROM m, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR open_time_ms // 60000 % 7 = 0),
  g AS (SELECT *, max(open_time_ms) OVER (PARTITION BY symbol ORDER BY arrival_ms, open_time_ms, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest,
    row_number() OVER (PARTITION BY symbol, open_time_ms ORDER BY arrival_ms, copy) AS nth FROM f),
  j AS (SELECT *, greatest(coalesce(newest - open_time_ms, 0), 0) AS behind_ms,
    CASE WHEN open_time_ms < newest - 3600000 THEN 'late' WHEN nth > 1 THEN 'repeated' WHEN open_time_ms < newest THEN 'out_of_order' ELSE 'in_order' END AS fate FROM g)"""


def _late_side(spark, sf) -> str:
    """Six files of arrivals, a restart after three; the folder of the side output."""
    from tidemark.streaming.stateful import sink_arrivals

    def make():
        root = _root(spark, "late")
        feed = inputs.arrival_feed(spark, sf)
        lo, hi = feed.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
        writers = inputs.in_files(feed, F.floor((F.col("arrival_ms") - lo) * 6 / (hi - lo + 1)), 6, f"{root}/feed")
        schema = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double, copy int, arrival_ms long, is_closed boolean"
        _restarted(spark, writers, lambda: sink_arrivals(_files_of(spark, schema, f"{root}/feed"), f"{root}/store", f"{root}/side", f"{root}/ck", 3_600_000, ["arrival_ms", "open_time_ms", "copy"]))
        return root
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LATE_ROOTS:
        _LATE_ROOTS[key] = make()
    return _LATE_ROOTS[key]


_LATE_ROOTS: dict = {}


@query("stream_late_bars", f"WITH {_LATE} SELECT symbol, fate, count(*) AS n, max(behind_ms) AS most_behind_ms FROM j GROUP BY 1, 2")
def _q(spark, sf):
    from tidemark.streaming.stateful import arrival_counts
    return arrival_counts(spark, f"{_late_side(spark, sf)}/side")


@query("stream_late_kept", f"WITH {_LATE} SELECT symbol, open_time_ms, arrival_ms, copy, close, fate, behind_ms FROM j WHERE fate IN ('late', 'repeated')")
def _q(spark, sf):
    return spark.read.parquet(f"{_late_side(spark, sf)}/side/arrivals").filter("fate IN ('late', 'repeated')").select("symbol", "open_time_ms", "arrival_ms", "copy", "close", "fate", "behind_ms")


@query("stream_late_store", f"WITH {_LATE} SELECT symbol, open_time_ms, open, high, low, close, volume FROM j WHERE fate IN ('in_order', 'out_of_order')")
def _q(spark, sf):
    from tidemark.sources.store import read_bars
    return read_bars(spark, f"{_late_side(spark, sf)}/store", grid=False).select("symbol", "open_time_ms", *OHLCV)


_BAR = "symbol string, tf string, open_time_ms long, open double, high double, low double, close double, volume double"
_PIECES = 8


def _bar_feed(spark, sf, root: str, first: int = 0):
    """Writers of the study bars in eight files, each with an eighth of every series, from file ``first`` on."""
    b = inputs.study_bars(spark, sf).select("symbol", "tf", "open_time_ms", *OHLCV, F.floor(F.col("bar_idx") * _PIECES / F.col("n_bars")).alias("p"))
    return inputs.in_files(b, F.col("p"), _PIECES, root)[first:]


@query("stream_pivots", f"SELECT symbol, tf, idx, ts_ms, round(price, 6) AS price, kind, confirmed_idx, confirmed_ts_ms FROM ({oracle.pivots_sql()})")
def _q(spark, sf):
    """Eight micro-batches with a restart after four."""
    from tidemark.streaming.stateful import stream_pivots
    root = _root(spark, "stream-piv")
    _restarted(spark, _bar_feed(spark, sf, f"{root}/feed"), lambda: _append(stream_pivots(_files_of(spark, _BAR, f"{root}/feed")), f"{root}/out", f"{root}/ck"))
    p = spark.read.parquet(f"{root}/out")
    return longs(p.select("symbol", "tf", "idx", "ts_ms", *r6(["price"]), "kind", "confirmed_idx", "confirmed_ts_ms"), "kind")


@query("stream_seeded_states", f"""WITH RECURSIVE {oracle.STA} SELECT symbol, tf, open_time_ms, bar_idx, round(atr, 6) AS atr, n_pivots FROM (
  SELECT *, count(ck) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) AS n_pivots FROM sta) WHERE bar_idx * 8 // n_bars >= 2""")
def _q(spark, sf):
    """A quarter of every series is history; a batch over it seeds the stream of the rest: six micro-batches, a restart after three."""
    from tidemark.streaming.stateful import stream_states, warm_state
    root = _root(spark, "stream-seed")
    seed = warm_state(inputs.study_bars(spark, sf).filter(F.floor(F.col("bar_idx") * _PIECES / F.col("n_bars")) < 2).select("symbol", "tf", "open_time_ms", *OHLCV))
    _restarted(spark, _bar_feed(spark, sf, f"{root}/feed", 2), lambda: _append(stream_states(_files_of(spark, _BAR, f"{root}/feed"), seed), f"{root}/out", f"{root}/ck"))
    return spark.read.parquet(f"{root}/out").select("symbol", "tf", "open_time_ms", "bar_idx", *r6(["atr"]), "n_pivots")


@query("stream_sink_bars", "SELECT event_type AS symbol, count(DISTINCT epoch_us(ts) // 60000000) AS n FROM events GROUP BY 1")
def _q(spark, sf):
    import uuid

    from tidemark.session import checkpoint_root
    from tidemark.sources.store import read_bars
    from tidemark.streaming.live import closed_minutes, sink_bars
    root = f"{checkpoint_root(spark)}/tidemark/sink-{uuid.uuid4().hex}"
    sink_bars(closed_minutes(_minute_feed(spark, sf)), f"{root}/store", f"{root}/ck").awaitTermination()
    return read_bars(spark, f"{root}/store", grid=False).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("stream_decisions", f"""WITH RECURSIVE {_PLAN_CTES}, a AS (SELECT symbol, tf, bar_idx, count(*) AS n, bool_or(in_zone) AS z FROM plan GROUP BY 1, 2, 3)
  SELECT s.symbol, s.tf, s.open_time_ms, s.bar_idx, round(s.close, 6) AS price, round(s.atr, 6) AS atr, CASE WHEN n > 0 THEN 'WATCH' ELSE 'NO_TRADE' END AS verdict, coalesce(n, 0) AS n_candidates,
    CASE WHEN s.atr IS NULL THEN 'not enough structure yet' WHEN n IS NULL THEN 'no structure satisfies the rules' WHEN NOT z THEN 'no price inside an entry zone' ELSE 'inside an entry zone' END AS reason
  FROM sta s LEFT JOIN a USING (symbol, tf, bar_idx) WHERE s.bar_idx * 8 // s.n_bars >= 2""")
def _q(spark, sf):
    """Seeded by a quarter of every series; six micro-batches, a restart after three."""
    from tidemark.streaming.stateful import stream_decisions, warm_state
    root = _root(spark, "dec")
    seed = warm_state(inputs.study_bars(spark, sf).filter(F.floor(F.col("bar_idx") * _PIECES / F.col("n_bars")) < 2).select("symbol", "tf", "open_time_ms", *OHLCV))
    _restarted(spark, _bar_feed(spark, sf, f"{root}/feed", 2), lambda: stream_decisions(_files_of(spark, _BAR, f"{root}/feed"), f"{root}/out", f"{root}/ck", seed))
    return spark.read.parquet(f"{root}/out/decisions").select("symbol", "tf", "open_time_ms", "bar_idx", *r6(["price", "atr"]), "verdict", "n_candidates", "reason")


@query("stream_emission", f"""WITH {oracle.BARS}, f AS (SELECT symbol, tf, tf_ms, CAST(open_time_ms + tf_ms + (bar_idx * 7919 % 11 * tf_ms / 4.0 + turn * tf_ms / 2.0) AS BIGINT) AS now_ms,
    CASE WHEN bar_idx > 0 OR turn > 0 THEN open_time_ms + tf_ms - 1 END AS c FROM bars, (VALUES (0), (1)) t(turn)),
  g AS (SELECT *, row_number() OVER w AS k, max(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_close_ms, now_ms - lag(now_ms) OVER w > 2 * tf_ms AS jumped FROM f WINDOW w AS (PARTITION BY symbol, tf ORDER BY now_ms, c)),
  h AS (SELECT *, (now_ms - last_close_ms) / CAST(tf_ms AS DOUBLE) AS lag_bars, lag(last_close_ms) OVER (PARTITION BY symbol, tf ORDER BY k) IS NULL AS first FROM g),
  e AS (SELECT *, CASE WHEN last_close_ms IS NULL THEN 'WARMUP' WHEN lag_bars <= 1 THEN 'LIVE' WHEN jumped OR first THEN 'CATCH_UP' END AS m FROM h)
  SELECT symbol, tf, now_ms, last_close_ms, round(lag_bars, 6) AS lag_bars, last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, tf ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mode FROM e""")
def _q(spark, sf):
    """Six files in order of the wall clock of each timeframe, a restart after three; one stream per timeframe, since their times are years apart."""
    from functools import reduce

    from tidemark.streaming.stateful import stream_emission
    feed = materialize(inputs.emission_feed(spark, sf), "emission")
    outs = []
    for tf in sorted(r["tf"] for r in feed.select("tf").distinct().collect()):
        root = _root(spark, f"emit-{tf}")
        one = feed.filter(F.col("tf") == tf)
        lo, hi = one.agg(F.min("now_ms"), F.max("now_ms")).first()
        writers = inputs.in_files(one, F.floor((F.col("now_ms") - lo) * 6 / (hi - lo + 1)), 6, f"{root}/feed")
        _restarted(spark, writers, lambda root=root: _append(stream_emission(_files_of(spark, "symbol string, tf string, now_ms long, last_close_ms long", f"{root}/feed")), f"{root}/out", f"{root}/ck"))
        outs.append(spark.read.parquet(f"{root}/out"))
    return reduce(DataFrame.unionByName, outs).filter("cause = 'row'").select("symbol", "tf", "now_ms", "last_close_ms", *r6(["lag_bars"]), "mode")


@query("emission_gate", f"""WITH {oracle.BARS} SELECT symbol, tf, open_time_ms, CASE WHEN (1706659200000 - (open_time_ms + tf_ms - 1)) / tf_ms > 1 THEN 'CATCH_UP' ELSE 'LIVE' END AS mode FROM bars""")
def _q(spark, sf):
    from tidemark.streaming.live import emission_gate
    return emission_gate(inputs.study_bars(spark, sf), F.lit(1706659200000)).select("symbol", "tf", "open_time_ms", "mode")


@query("event_latency", "SELECT event_type AS kind, count(*) AS n, round(avg(event_id % 500), 6) AS mean_ms, max(event_id % 500) AS max_ms FROM events GROUP BY 1")
def _q(spark, sf):
    from tidemark.functions.clock import as_ms
    from tidemark.streaming.live import event_latency
    e = inputs.table(spark, sf, "events").select(F.col("event_type").alias("kind"), as_ms("ts").alias("a"), (as_ms("ts") + F.col("event_id") % 500).alias("b"))
    return event_latency(e, "a", "b", "kind").select("kind", "n", *r6(["mean_ms"]), "max_ms")


@query("feed_health", f"""WITH {oracle.BARS}, r AS (SELECT *, coalesce(open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol, tf ORDER BY bar_idx) <> tf_ms, false) OR is_gap AS g FROM bars WHERE bar_idx >= n_bars - 500)
  SELECT symbol, tf, max(open_time_ms) AS last_open_ms, round((1706745600000 - max(open_time_ms + tf_ms)) / 1000.0, 6) AS silent_seconds, round((1706745600000 - max(open_time_ms + tf_ms)) / CAST(max(tf_ms) AS DOUBLE), 6) AS lag_bars, count(*) FILTER (g) AS gaps_in_window FROM r GROUP BY 1, 2""")
def _q(spark, sf):
    from tidemark.streaming.live import feed_health
    return feed_health(inputs.study_bars(spark, sf), F.lit(1706745600000)).select("symbol", "tf", "last_open_ms", *r6(["silent_seconds", "lag_bars"]), "gaps_in_window")


# ------------------------------------------------------------------ the whole catalogue

def _catalog_values() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({text(s.family)}, {text(s.name)}, {text(s.title)}, {text(s.prior)}, CAST({s.warmup} AS INTEGER))" for s in catalogue().values())


@query("signal_catalog_counts", f"""WITH {oracle.all_positions()} SELECT family, signal_name, title, prior, min_warmup, count(*) AS bars, count(*) FILTER (position = 1) AS n_long, count(*) FILTER (position = -1) AS n_short
  FROM (VALUES {_catalog_values()}) c(family, signal_name, title, prior, min_warmup) JOIN pos USING (signal_name) GROUP BY ALL""")
def _q(spark, sf):
    """The catalogue table beside what every signal does on the study panel."""
    from tidemark.signals.registry import signal_catalog
    pos = _all_positions(spark, sf)
    n = pos.groupBy("signal_name").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("position") == 1).alias("n_long"), F.count_if(F.col("position") == -1).alias("n_short"))
    return signal_catalog(spark).join(n, "signal_name").select("family", "signal_name", "title", "prior", "min_warmup", "bars", "n_long", "n_short")


@query("signals_over_chunks", f"""WITH {oracle.all_positions()} SELECT signal_name, symbol, tf, count(*) AS bars, count(*) FILTER (position = 1) AS n_long,
  count(*) FILTER (position = -1) AS n_short, CAST(sum(position * bar_idx) AS BIGINT) AS places FROM pos GROUP BY 1, 2, 3""")
def _q(spark, sf):
    """All signals over series cut into short chunks, against whole series in SQL: how many bars each side holds, and where."""
    pos = signal_positions(inputs.cut_study_panel(spark, sf))
    return pos.groupBy("signal_name", "symbol", "tf").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if(F.col("position") == 1).alias("n_long"), F.count_if(F.col("position") == -1).alias("n_short"),
        F.sum(F.col("position").cast("long") * F.col("bar_idx")).cast("long").alias("places"))


@query("study_all_signals", f"""WITH RECURSIVE {_EV_CTES}, g AS (SELECT symbol, tf, count(*) AS k, max(edge) AS best_edge, arg_max(signal_name, (round(edge, 9), signal_name)) AS best_name, sum(n_effective) AS n_effective, count(*) FILTER (oos_edge > 1e-12::DOUBLE) AS positive_out FROM ev GROUP BY 1, 2)
  SELECT symbol, tf, k, best_name, round(best_edge, 7) AS best_edge, CAST(n_effective AS BIGINT) AS n_effective, positive_out FROM g""")
def _q(spark, sf):
    """The study as a report: per series how many of the 100 signals could be judged, the best of them, and how many hold out of sample."""
    from tidemark.operators.evaluate import ROUNDING
    best = F.max_by("signal_name", F.struct(rd("edge", 9), "signal_name"))
    g = _evaluation(spark, sf).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("k"), best.alias("best_name"), F.max("edge").alias("best_edge"), F.sum("n_effective").alias("n_effective"), F.count_if(F.col("oos_edge") > ROUNDING).alias("positive_out"))
    return g.select("symbol", "tf", "k", "best_name", *r6(["best_edge"], 7), "n_effective", "positive_out")
