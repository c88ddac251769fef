"""ANSI-SQL twins of the registered queries, for a side-by-side check in DuckDB.

Everything here is the textbook definition: plain windows over whole series and one recursive
step per bar. None of the Spark side's blocks, chunks or carries appear.
"""

from __future__ import annotations

P = "PARTITION BY symbol, tf ORDER BY bar_idx"

LINEITEM_TICKS = """SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS t,
  (l_orderkey * 8 + l_linenumber) * 16 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 16) AS seq,
  l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem"""
EVENT_TICKS = """SELECT 'ALL' AS symbol, epoch_us(ts) // 1000 AS t, event_id AS seq, value AS price,
  CAST(1 AS DOUBLE) AS size FROM events"""
EVENT_TYPE_TICKS = EVENT_TICKS.replace("'ALL'", "event_type")

_TF = {"1m": 60000, "5m": 300000, "15m": 900000, "1h": 3600000, "4h": 14400000, "1d": 86400000}


def raw_bars(ticks: str, tf: str, min_coverage: float = 0.9) -> str:
    ms = _TF[tf]
    return f"""SELECT symbol, '{tf}' AS tf, CAST({ms} AS BIGINT) AS tf_ms, t - t % {ms} AS open_time_ms,
  first(price ORDER BY t, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY t, seq) AS close, sum(size) AS volume, count(*) AS trades,
  count(DISTINCT t - t % 60000) AS n_source_bars,
  count(DISTINCT t - t % 60000) < floor({min_coverage} * {ms // 60000}) AS is_gap
 FROM ({ticks}) GROUP BY symbol, t - t % {ms}"""


STUDY = " UNION ALL ".join([raw_bars(LINEITEM_TICKS, "1d"), raw_bars(EVENT_TICKS, "1h"),
                            raw_bars(EVENT_TICKS, "15m")])


def indexed(bars: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY open_time_ms) - 1 AS bar_idx, "
            f"count(*) OVER (PARTITION BY symbol, tf) AS n_bars FROM ({bars})")


class Graph:
    """Named SQL expressions in layers; ``rec`` ones are stepped bar by bar."""

    def __init__(self, bars: str = STUDY):
        self.bars = bars
        self.level: dict[str, int] = {}
        self.expr: dict[str, object] = {}

    def add(self, name: str, sql, deps=()) -> str:
        if name not in self.expr:
            self.expr[name] = sql
            self.level[name] = 1 + max((self.level.get(d, 0) for d in deps), default=0)
        return name

    # -- windows
    def w(self, n: int, skip: int = 0) -> str:
        return f"OVER ({P} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)"

    def full(self, agg: str, x: str, n: int, tag: str, skip: int = 0) -> str:
        w = self.w(n, skip)
        return self.add(f"{x}_{tag}{n}" + (f"_p{skip}" if skip else ""),
                        f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END", [x])

    def sma(self, x, n): return self.full("avg", x, n, "sma")
    def std(self, x, n): return self.full("stddev_pop", x, n, "std")
    def sum(self, x, n): return self.full("sum", x, n, "sum")
    def max(self, x, n, skip=0): return self.full("max", x, n, "max", skip)
    def min(self, x, n, skip=0): return self.full("min", x, n, "min", skip)
    def avgb(self, x, n, skip): return self.full("avg", x, n, "avg", skip)

    def lag(self, x, k=1):
        return self.add(f"{x}_l{k}", f"lag({x}, {k}) OVER ({P})", [x])

    def roc(self, x, n):
        p = self.lag(x, n)
        return self.add(f"{x}_roc{n}", f"CASE WHEN {p} <> 0 THEN ({x} / {p} - 1) * 100 WHEN {p} = 0 THEN 0 END", [p])

    def slope(self, x, n):
        w = self.w(n)
        return self.add(f"{x}_slope{n}", f"CASE WHEN count({x}) {w} = {n} THEN regr_slope({x}, bar_idx) {w} END", [x])

    def rank(self, x, n):
        a = self.add(f"{x}_win{n}", f"list({x}) FILTER ({x} IS NOT NULL) {self.w(n)}", [x])
        return self.add(f"{x}_rank{n}", f"CASE WHEN {x} IS NOT NULL AND len({a}) = {n} THEN "
                        f"len(list_filter({a}, lambda v: v < {x})) / {float(n - 1)} END", [a])

    def hold(self, ev, n):
        w = self.w(n)
        return self.add(f"{ev}_hold{n}", f"coalesce(last_value(nullif({ev}, 0) IGNORE NULLS) {w}, 0)", [ev])

    def ffill(self, x):
        return self.add(f"{x}_ff", f"last_value({x} IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", [x])

    def held(self, ev):
        z = self.add(f"{ev}_nz", f"nullif({ev}, 0)", [ev])
        return self.ffill(z)

    # -- recursions: (state columns) name -> (initial, step); s. = this bar, r. = the bar before
    def rec(self, name, init, step, deps):
        return self.add(name, (init, step), deps)

    def ema(self, x, n, start=0, alpha=None, tag="ema"):
        a = 2.0 / (n + 1) if alpha is None else alpha
        at, s = start + n - 1, self.sma(x, n)
        name = f"{x}_{tag}{n}"
        return self.rec(name, "NULL", f"CASE WHEN s.bar_idx = {at} THEN s.{s} WHEN s.bar_idx > {at} "
                        f"THEN r.{name} + {a!r} * (s.{x} - r.{name}) END", [s, x])

    def wilder(self, x, n, start=1):
        at, s = start + n - 1, self.sma(x, n)
        name = f"{x}_wil{n}"
        return self.rec(name, "NULL", f"CASE WHEN s.bar_idx = {at} THEN s.{s} WHEN s.bar_idx > {at} "
                        f"THEN (r.{name} * {n - 1} + s.{x}) / {n} END", [s, x])

    def wsum(self, x, n, start=1):
        name, at = f"{x}_wsum{n}", start + n - 2
        return self.rec(name, "0.0", f"CASE WHEN s.bar_idx <= {at} THEN r.{name} + s.{x} ELSE "
                        f"r.{name} - r.{name} / {n} + s.{x} END", [x])

    def render(self, select: str) -> str:
        """The final query: layers as CTEs, then ``SELECT ... FROM f``."""
        ctes = [f"l0 AS MATERIALIZED ({indexed(self.bars)})"]
        prev = "l0"
        top = max(self.level.values(), default=0)
        for lv in range(1, top + 1):
            names = [n for n, k in self.level.items() if k == lv]
            plain = [n for n in names if isinstance(self.expr[n], str)]
            rec = [n for n in names if isinstance(self.expr[n], tuple)]
            cur = f"l{lv}"
            cols = ", ".join(f"{self.expr[n]} AS {n}" for n in plain)
            ctes.append(f"{cur}p AS MATERIALIZED (SELECT *{', ' + cols if cols else ''} FROM {prev})")
            prev = f"{cur}p"
            if rec:
                ini = ", ".join(f"CAST({self.expr[n][0]} AS DOUBLE) AS {n}" for n in rec)
                stp = ", ".join(f"CAST({self.expr[n][1]} AS DOUBLE) AS {n}" for n in rec)
                ctes.append(
                    f"{cur}r AS (SELECT s.symbol, s.tf, s.bar_idx, {ini} FROM {prev} s WHERE s.bar_idx = 0 "
                    f"UNION ALL SELECT s.symbol, s.tf, s.bar_idx, {stp} FROM {cur}r r JOIN {prev} s "
                    f"ON s.symbol = r.symbol AND s.tf = r.tf AND s.bar_idx = r.bar_idx + 1)")
                ctes.append(f"{cur} AS MATERIALIZED (SELECT p.*, {', '.join('r.' + n for n in rec)} "
                            f"FROM {prev} p JOIN {cur}r r USING (symbol, tf, bar_idx))")
                prev = cur
        ctes.append(f"f AS (SELECT * FROM {prev})")
        return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def side(up: str, dn: str) -> str:
    return f"CASE WHEN {dn} THEN -1 WHEN {up} THEN 1 ELSE 0 END"


def events(up: str, dn: str) -> str:
    return (f"CASE WHEN coalesce({up}, false) AND NOT coalesce({dn}, false) THEN 1 "
            f"WHEN coalesce({dn}, false) AND NOT coalesce({up}, false) THEN -1 ELSE 0 END")


# ------------------------------------------------------------------ indicators

def prices(g: Graph) -> None:
    g.lag("close")
    g.add("range", "high - low"), g.add("body", "close - open")
    g.add("typical", "(high + low + close) / 3"), g.add("median_price", "(high + low) / 2")
    g.add("abs_body", "abs(close - open)")
    g.add("upper_wick", "high - greatest(open, close)"), g.add("lower_wick", "least(open, close) - low")
    g.add("tr", "CASE WHEN close_l1 IS NOT NULL THEN greatest(high - low, abs(high - close_l1), abs(low - close_l1)) END", ["close_l1"])
    g.add("gain", "CASE WHEN close_l1 IS NOT NULL THEN greatest(close - close_l1, 0) END", ["close_l1"])
    g.add("loss", "CASE WHEN close_l1 IS NOT NULL THEN greatest(close_l1 - close, 0) END", ["close_l1"])
    g.add("clv", "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END")


def atr(g, n):
    prices(g)
    return g.wilder("tr", n)


def rsi(g, n=14):
    prices(g)
    a, b = g.wilder("gain", n), g.wilder("loss", n)
    return g.add(f"rsi{n}", f"CASE WHEN {a} + {b} > 0 THEN 100 * {a} / ({a} + {b}) WHEN {a} IS NOT NULL THEN 0 END", [a, b])


def bbands(g):
    m, s = g.sma("close", 20), g.std("close", 20)
    g.add("bb_up", f"{m} + 2 * {s}", [m, s]), g.add("bb_lo", f"{m} - 2 * {s}", [m, s])
    return "bb_up", m, "bb_lo"


def dmi(g, n=14):
    prices(g)
    h, l = g.lag("high"), g.lag("low")
    up, dn = f"(high - {h})", f"({l} - low)"
    g.add("pdm", f"CASE WHEN {up} > 0 AND {up} > {dn} THEN {up} WHEN {h} IS NOT NULL THEN 0 END", [h, l])
    g.add("mdm", f"CASE WHEN {dn} > 0 AND {dn} > {up} THEN {dn} WHEN {h} IS NOT NULL THEN 0 END", [h, l])
    p, m, t = g.wsum("pdm", n), g.wsum("mdm", n), g.wsum("tr", n)
    for x, y in (("pdi", p), ("mdi", m)):
        g.add(x, f"CASE WHEN bar_idx >= {n} THEN CASE WHEN {t} > 0 THEN 100 * {y} / {t} ELSE 0 END END", [t, y])
    g.add("dx", "CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi IS NOT NULL THEN 0 END", ["pdi", "mdi"])
    return "pdi", "mdi", g.wilder("dx", n, n)


def ao(g):
    prices(g)
    a, b = g.sma("median_price", 5), g.sma("median_price", 34)
    return g.add("ao", f"{a} - {b}", [a, b])


def prior(g):
    ao(g)
    w = f"OVER ({P} ROWS BETWEEN 100 PRECEDING AND 10 PRECEDING)"
    g.add("hi_at", f"max({{'c': close, 'i': -bar_idx, 'ao': coalesce(ao, 0)}}) {w}", ["ao"])
    g.add("lo_at", f"min({{'c': close, 'i': bar_idx, 'ao': coalesce(ao, 0)}}) {w}", ["ao"])


def obv(g):
    prices(g)
    g.add("obv_step", "CASE WHEN bar_idx = 0 THEN volume WHEN close > close_l1 THEN volume WHEN close < close_l1 THEN -volume ELSE 0 END", ["close_l1"])
    return g.add("obv", f"sum(obv_step) OVER ({P} ROWS UNBOUNDED PRECEDING)", ["obv_step"])


def ad(g):
    prices(g)
    g.add("ad_step", "clv * volume", ["clv"])
    return g.add("ad", f"sum(ad_step) OVER ({P} ROWS UNBOUNDED PRECEDING)", ["ad_step"])


def adosc(g):
    ad(g)
    for n in (3, 10):
        a = 2.0 / (n + 1)
        g.rec(f"ad_e{n}", "s.ad", f"r.ad_e{n} + {a!r} * (s.ad - r.ad_e{n})", ["ad"])
    return g.add("adosc", "CASE WHEN bar_idx >= 9 THEN ad_e3 - ad_e10 END", ["ad_e3", "ad_e10"])


def nvi(g):
    prices(g)
    v = g.lag("volume")
    g.add("nvi_factor", f"greatest(CASE WHEN volume < {v} AND close_l1 > 0 THEN 1 + (close - close_l1) / close_l1 ELSE 1 END, 0.01)", [v, "close_l1"])
    return g.rec("nvi", "1000.0 * s.nvi_factor", "r.nvi * s.nvi_factor", ["nvi_factor"])


def mfi(g, n=14):
    prices(g)
    p = g.lag("typical")
    g.add("mf_pos", f"CASE WHEN typical > {p} THEN typical * volume WHEN {p} IS NOT NULL THEN 0 END", [p])
    g.add("mf_neg", f"CASE WHEN typical < {p} THEN typical * volume WHEN {p} IS NOT NULL THEN 0 END", [p])
    a, b = g.sum("mf_pos", n), g.sum("mf_neg", n)
    return g.add("mfi", f"CASE WHEN {a} + {b} > 0 THEN 100 * {a} / ({a} + {b}) WHEN {a} IS NOT NULL THEN 0 END", [a, b])


def er(g, n=10):
    g.lag("close")
    g.add("abs_step", "abs(close - close_l1)", ["close_l1"])
    s, b = g.sum("abs_step", n), g.lag("close", n)
    return g.add("er", f"CASE WHEN {s} > 0 THEN abs(close - {b}) / {s} END", [s, b])


def kama(g, n=10):
    er(g, n)
    f, s = 2.0 / 3.0, 2.0 / 31.0
    g.add("kama_a", f"power(coalesce(er, 0) * {f - s!r} + {s!r}, 2)", ["er"])
    return g.rec("kama", "NULL", f"CASE WHEN s.bar_idx = {n - 1} THEN s.close WHEN s.bar_idx >= {n} THEN r.kama + s.kama_a * (s.close - r.kama) END", ["kama_a"])


def kama_out(g):
    kama(g)
    return g.add("kama_o", "CASE WHEN bar_idx >= 10 THEN kama END", ["kama"])


def willr(g, n=14):
    h, l = g.max("high", n), g.min("low", n)
    return g.add("willr", f"CASE WHEN {h} > {l} THEN -100 * ({h} - close) / ({h} - {l}) WHEN {h} IS NOT NULL THEN 0 END", [h, l])


def cci(g, n=20):
    prices(g)
    m = g.sma("typical", n)
    a = g.add("tp_win", f"list(typical) {g.w(n)}", ["typical"])
    g.add("mad", f"list_sum(list_transform({a}, lambda v: abs(v - {m}))) / {n}", [a, m])
    return g.add("cci", f"CASE WHEN {m} IS NULL THEN NULL WHEN mad > 0 THEN (typical - {m}) / (0.015 * mad) ELSE 0 END", ["mad"])


def aroon(g, n=25):
    w = g.w(n + 1)
    g.add("ar_hi", f"max({{'x': high, 'i': bar_idx}}) {w}"), g.add("ar_lo", f"min({{'x': low, 'i': -bar_idx}}) {w}")
    g.add("aroon_up", f"CASE WHEN bar_idx >= {n} THEN 100.0 * ({n} - (bar_idx - ar_hi.i)) / {n} END", ["ar_hi"])
    g.add("aroon_dn", f"CASE WHEN bar_idx >= {n} THEN 100.0 * ({n} - (bar_idx + ar_lo.i)) / {n} END", ["ar_lo"])
    return "aroon_up", "aroon_dn"


def rs_vol(g, n=24):
    g.add("rs_term", "CASE WHEN open > 0 AND high > 0 AND low > 0 AND close > 0 THEN greatest(0, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)) END")
    a = g.add("rs_win", f"list(rs_term) FILTER (rs_term IS NOT NULL) {g.w(n)}", ["rs_term"])      # summed in bar order
    return g.add("rs_vol", f"CASE WHEN len({a}) = {n} THEN sqrt(list_sum({a}) / {n}) END", [a])


def vwap(g):
    prices(g)
    g.add("day", "open_time_ms // 86400000")
    w = "OVER (PARTITION BY symbol, tf, day ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"
    g.add("sv", f"sum(volume) {w}", ["day"]), g.add("sk", f"count(*) {w}", ["day"])
    g.add("spv", f"sum(typical * volume) {w}", ["day", "typical"])
    g.add("spv2", f"sum(typical * typical * volume) {w}", ["day", "typical"])
    g.add("vwap", "CASE WHEN sv > 0 THEN spv / sv END", ["sv", "spv"])
    g.add("vwap_sd", "CASE WHEN sv > 0 THEN sqrt(greatest(spv2 / sv - vwap * vwap, 0)) END", ["vwap", "spv2"])
    return "vwap", "vwap_sd", "sk"


def swings(g):
    h, l = g.lag("high", 2), g.lag("low", 2)
    H, L = g.max("high", 5), g.min("low", 5)
    g.add("fh", f"CASE WHEN {h} = {H} THEN {h} END", [h, H]), g.add("fl", f"CASE WHEN {l} = {L} THEN {l} END", [l, L])
    out = []
    for x in ("fh", "fl"):
        a = g.ffill(x)
        b = g.lag(a)
        e = g.add(f"{x}_prev", f"CASE WHEN {x} IS NOT NULL THEN {b} END", [b, x])
        out += [a, g.ffill(e)]
    hi, hi2, lo, lo2 = out
    g.add("st_up_seq", f"coalesce({hi} > {hi2} AND {lo} > {lo2}, false)", out)
    g.add("st_dn_seq", f"coalesce({hi} < {hi2} AND {lo} < {lo2}, false)", out)
    g.add("state", "CASE WHEN st_up_seq THEN 1 WHEN st_dn_seq THEN -1 ELSE 0 END", ["st_up_seq", "st_dn_seq"])
    return hi, lo


def candle_marks(g):
    prices(g)
    return [g.avgb("abs_body", 10, 1), g.avgb("range", 10, 1)]


def held_clock(g):
    g.add("held", "open_time_ms + tf_ms")
    g.add("hh", "(held // 3600000) % 24", ["held"]), g.add("wd", "(held // 86400000 + 3) % 7", ["held"])
    g.add("hd", "CAST(make_timestamp(held * 1000) AS DATE)", ["held"])


LAST_FRI = ("(last_day({d}) - CAST((isodow(last_day({d})) + 2) % 7 AS INTEGER))")


# ------------------------------------------------------------------ the catalogue

def _signal_sql(name: str, g: Graph) -> str:
    """Position expression, after adding what it reads to the graph."""
    fam, key = name.split(".")
    c = "close"
    if fam == "trend":
        if key == "ema_cross_21_55":
            a, b = g.ema(c, 21), g.ema(c, 55)
            return side(f"{a} > {b}", f"{a} < {b}")
        if key == "ema_stack_21_55_200":
            a, b, d = g.ema(c, 21), g.ema(c, 55), g.ema(c, 200)
            return side(f"{a} > {b} AND {b} > {d}", f"{a} < {b} AND {b} < {d}")
        if key == "ema200_filter":
            a = g.ema(c, 200)
            return side(f"close > {a}", f"close < {a}")
        if key == "macd_12_26_9":
            a, b = g.ema(c, 12), g.ema(c, 26)
            g.add("macd", f"{a} - {b}", [a, b])
            s = g.ema("macd", 9, 25)
            return side(f"macd > {s}", f"macd < {s}")
        if key == "adx_dmi_14":
            p, m, x = dmi(g)
            return side(f"{x} >= 25 AND {p} > {m}", f"{x} >= 25 AND {m} > {p}")
        if key == "donchian_turtle_55_20":
            h5, l5, h2, l2 = g.max("high", 55, 1), g.min("low", 55, 1), g.max("high", 20, 1), g.min("low", 20, 1)
            return g.rec("turtle", "0", f"""CASE WHEN s.{h5} IS NULL THEN 0
              WHEN r.turtle = 0 THEN CASE WHEN s.close > s.{h5} THEN 1 WHEN s.close < s.{l5} THEN -1 ELSE 0 END
              WHEN r.turtle = 1 THEN CASE WHEN s.close < s.{l2} THEN CASE WHEN s.close < s.{l5} THEN -1 ELSE 0 END ELSE 1 END
              ELSE CASE WHEN s.close > s.{h2} THEN CASE WHEN s.close > s.{h5} THEN 1 ELSE 0 END ELSE -1 END END""", [h5, l5, h2, l2])
        if key == "supertrend_atr14_x3":
            a, p = atr(g, 14), g.lag("close")
            g.add("ub", f"median_price + 3 * {a}", [a, "median_price"]), g.add("lb", f"median_price - 3 * {a}", [a, "median_price"])
            nu = f"CASE WHEN s.ub IS NULL THEN r.su WHEN r.su IS NULL OR s.ub < r.su OR s.{p} > r.su THEN s.ub ELSE r.su END"
            nl = f"CASE WHEN s.lb IS NULL THEN r.sl WHEN r.sl IS NULL OR s.lb > r.sl OR s.{p} < r.sl THEN s.lb ELSE r.sl END"
            g.rec("su", "NULL", nu, ["ub", "lb", p]), g.rec("sl", "NULL", nl, ["ub", "lb", p])
            return g.rec("supert", "0", f"CASE WHEN s.ub IS NULL OR r.su IS NULL THEN r.supert WHEN s.close > ({nu}) THEN 1 WHEN s.close < ({nl}) THEN -1 ELSE r.supert END", ["ub", "lb", p])
        if key == "psar_002_020":
            h1, l1 = g.lag("high"), g.lag("low")
            lg0 = f"CASE WHEN (s.{l1} - s.low) > 0 AND (s.{l1} - s.low) > (s.high - s.{h1}) THEN 0.0 ELSE 1.0 END"
            first = "s.bar_idx = 1"
            L = f"(CASE WHEN {first} THEN {lg0} ELSE r.sr_long END)"
            E = f"(CASE WHEN {first} THEN CASE WHEN {lg0} = 1 THEN s.high ELSE s.low END ELSE r.sr_ep END)"
            S = f"(CASE WHEN {first} THEN CASE WHEN {lg0} = 1 THEN s.{l1} ELSE s.{h1} END ELSE r.sr_next END)"
            A = f"(CASE WHEN {first} THEN 0.02 ELSE r.sr_af END)"
            ph, pl = f"(CASE WHEN {first} THEN s.high ELSE s.{h1} END)", f"(CASE WHEN {first} THEN s.low ELSE s.{l1} END)"
            flip = f"(({L} = 1 AND s.low <= {S}) OR ({L} = 0 AND s.high >= {S}))"
            out = f"(CASE WHEN NOT {flip} THEN {S} WHEN {L} = 1 THEN greatest({E}, {ph}, s.high) ELSE least({E}, {pl}, s.low) END)"
            nl = f"(CASE WHEN {flip} THEN 1 - {L} ELSE {L} END)"
            ne = f"(CASE WHEN {flip} THEN CASE WHEN {L} = 1 THEN s.low ELSE s.high END WHEN {L} = 1 THEN greatest({E}, s.high) ELSE least({E}, s.low) END)"
            na = f"(CASE WHEN {flip} THEN 0.02 WHEN ({L} = 1 AND s.high > {E}) OR ({L} = 0 AND s.low < {E}) THEN least({A} + 0.02, 0.2) ELSE {A} END)"
            step = f"({out} + {na} * ({ne} - {out}))"
            d = [h1, l1]
            g.rec("sr_long", "NULL", nl, d), g.rec("sr_ep", "NULL", ne, d), g.rec("sr_af", "NULL", na, d)
            g.rec("sar", "NULL", out, d)
            g.rec("sr_next", "NULL", f"CASE WHEN {nl} = 1 THEN least({step}, {pl}, s.low) ELSE greatest({step}, {ph}, s.high) END", d)
            return side("close > sar", "close < sar")
        if key == "linreg_slope_55_atr14":
            s, a = g.slope(c, 55), atr(g, 14)
            return side(f"{a} > 0 AND {s} * 55 / {a} > 1", f"{a} > 0 AND {s} * 55 / {a} < -1")
        if key == "ichimoku_kumo":
            mid = {n: g.add(f"mid{n}", f"({g.max('high', n)} + {g.min('low', n)}) / 2", [g.max("high", n), g.min("low", n)]) for n in (9, 26, 52)}
            g.add("sa0", "(mid9 + mid26) / 2", ["mid9", "mid26"])
            a, b = g.lag("sa0", 26), g.lag("mid52", 26)
            return side(f"close > {a} AND close > {b} AND mid9 > mid26", f"close < {a} AND close < {b} AND mid9 < mid26")
        if key == "aroon_25":
            u, d = aroon(g)
            return side(f"{u} > 70 AND {d} < 30", f"{d} > 70 AND {u} < 30")
        if key == "tsmom_365d":
            y = g.lag(c, 365)
            return side(f"{y} > 0 AND close > {y}", f"{y} > 0 AND close < {y}")
    if fam == "momentum":
        if key == "tsmom_12_1":
            a, b = g.lag(c, 30), g.lag(c, 360)
            return side(f"{b} > 0 AND {a} / {b} - 1 > 0", f"{b} > 0 AND {a} / {b} - 1 < 0")
        if key == "tsmom_consensus":
            r = [g.roc(c, n) for n in (30, 90, 180)]
            return side(" AND ".join(f"{x} > 0" for x in r), " AND ".join(f"{x} < 0" for x in r))
        if key == "roc10":
            r = g.roc(c, 10)
            return side(f"{r} > 0", f"{r} < 0")
        if key == "roc_term_structure":
            a, b = g.roc(c, 10), g.roc(c, 20)
            return side(f"{b} / 20 > 0 AND {a} / 10 > {b} / 20", f"{b} / 20 < 0 AND {a} / 10 < {b} / 20")
        if key == "ao_sign":
            ao(g)
            return side("ao > 0", "ao < 0")
        if key in ("ao_confirms_extreme", "ao_divergence_extreme"):
            prior(g)
            if key == "ao_confirms_extreme":
                return side("bar_idx >= 100 AND close > hi_at.c AND ao > hi_at.ao AND ao > 0", "bar_idx >= 100 AND close < lo_at.c AND ao < lo_at.ao AND ao < 0")
            return ("CASE WHEN bar_idx >= 100 AND close < lo_at.c AND ao > lo_at.ao AND ao < 0 AND lo_at.ao < 0 THEN 1 "
                    "WHEN bar_idx >= 100 AND close > hi_at.c AND ao < hi_at.ao AND ao > 0 AND hi_at.ao > 0 THEN -1 ELSE 0 END")
        if key == "linreg_acceleration":
            g.add("lnc", "CASE WHEN close > 0 THEN ln(close) END")
            s = g.slope("lnc", 20)
            p = g.lag(s, 20)
            return side(f"{s} > 0 AND {s} - {p} > 0", f"{s} < 0 AND {s} - {p} < 0")
        if key == "sign_persistence":
            g.lag(c)
            g.add("isup", "CASE WHEN close > close_l1 THEN 1.0 ELSE 0.0 END", ["close_l1"]), g.add("isdn", "CASE WHEN close < close_l1 THEN 1.0 ELSE 0.0 END", ["close_l1"])
            return side(f"{g.sum('isup', 20)} >= 14", f"{g.sum('isdn', 20)} >= 14")
        if key == "er_kaufman_filtered":
            er(g)
            b = g.lag(c, 10)
            return side(f"er >= 0.30 AND close > {b}", f"er >= 0.30 AND close < {b}")
        if key == "kama_cross":
            kama(g)
            return side("bar_idx >= 10 AND close > kama", "bar_idx >= 10 AND close < kama")
        if key == "momentum_with_volume":
            r, a, b = g.roc(c, 20), g.sma("volume", 5), g.sma("volume", 20)
            return side(f"{b} > 0 AND {a} > {b} AND {r} > 0", f"{b} > 0 AND {a} > {b} AND {r} < 0")
    if fam == "mean_reversion":
        if key.startswith("bb20"):
            u, m, l = bbands(g)
            if key == "bb20_2_fade":
                return side(f"close < {l}", f"close > {u}")
            if key == "bb20_2_reentry":
                u1, l1, c1 = g.lag(u), g.lag(l), g.lag(c)
                out = f"CASE WHEN (r.reent = 1 AND s.close >= s.{m}) OR (r.reent = -1 AND s.close <= s.{m}) THEN 0 ELSE r.reent END"
                return g.rec("reent", "0", f"""CASE WHEN s.{u} IS NULL OR s.{u1} IS NULL THEN 0
                  WHEN ({out}) = 0 THEN CASE WHEN s.{c1} < s.{l1} AND s.close >= s.{l} THEN 1
                    WHEN s.{c1} > s.{u1} AND s.close <= s.{u} THEN -1 ELSE 0 END ELSE ({out}) END""", [u1, l1, c1, m])
            if key == "bb20_2_range_adx14":
                x = dmi(g)[2]
                return side(f"{x} < 20 AND close < {l}", f"{x} < 20 AND close > {u}")
            v = g.sma("volume", 20)
            return side(f"volume > 2 * {v} AND close < {l}", f"volume > 2 * {v} AND close > {u}")
        if key == "keltner20_atr14_fade":
            e, a = g.ema(c, 20), atr(g, 14)
            return side(f"close < {e} - 2 * {a}", f"close > {e} + 2 * {a}")
        if key == "rsi14_fixed_3070":
            r = rsi(g)
            return side(f"{r} < 30", f"{r} > 70")
        if key == "rsi14_cardwell_sma200":
            r, s = rsi(g), g.sma(c, 200)
            return side(f"(close > {s} AND {r} < 40) OR (close <= {s} AND {r} < 20)", f"(close > {s} AND {r} > 80) OR (close <= {s} AND {r} > 60)")
        if key == "willr14_fade":
            willr(g)
            return side("willr < -80", "willr > -20")
        if key == "cci20_fade":
            cci(g)
            return side("cci < -100", "cci > 100")
        if key == "stretch_ema200_atr14":
            e, a = g.ema(c, 200), atr(g, 14)
            return side(f"close < {e} - 3 * {a}", f"close > {e} + 3 * {a}")
        if key == "sweep_rejection_20":
            lo, hi = g.min("low", 20, 1), g.max("high", 20, 1)
            return side(f"high > low AND low < {lo} AND (close - low) / (high - low) > 2.0::DOUBLE / 3.0", f"high > low AND high > {hi} AND (high - close) / (high - low) > 2.0::DOUBLE / 3.0")
        if key == "streak3_fade":
            a, b, d = g.lag(c, 1), g.lag(c, 2), g.lag(c, 3)
            return side(f"close < {a} AND {a} < {b} AND {b} < {d}", f"close > {a} AND {a} > {b} AND {b} > {d}")
    if fam == "volatility":
        if key == "squeeze_bb_kc_release":
            (u, m, l), e, a = bbands(g), g.ema(c, 20), atr(g, 20)
            g.add("sqok", f"{u} IS NOT NULL AND {e} IS NOT NULL AND {a} IS NOT NULL", [u, e, a])
            g.add("sq", f"coalesce({u} < {e} + 1.5 * {a} AND {l} > {e} - 1.5 * {a}, false)", [u, l, e, a])
            p = g.lag("sq")
            g.add("sqe", f"CASE WHEN {p} AND NOT sq AND sqok THEN CASE WHEN close > {m} THEN 1 WHEN close < {m} THEN -1 ELSE 0 END ELSE 0 END", [p, "sqok", m])
            return g.rec("squeeze", "0", f"CASE WHEN s.sqe <> 0 THEN s.sqe WHEN r.squeeze = 1 AND (s.sq OR (s.sqok AND s.close < s.{m})) THEN 0 WHEN r.squeeze = -1 AND (s.sq OR (s.sqok AND s.close > s.{m})) THEN 0 ELSE r.squeeze END", ["sqe"])
        if key in ("rs_vol_pct_low_carry", "bbw_pct_low_carry"):
            e = g.ema(c, 55)
            if key == "rs_vol_pct_low_carry":
                r = g.rank(rs_vol(g), 252)
            else:
                u, m, l = bbands(g)
                g.add("bw", f"CASE WHEN {m} <> 0 THEN ({u} - {l}) / {m} END", [u, l, m])
                r = g.rank("bw", 252)
            return side(f"{r} < 0.2 AND close > {e}", f"{r} < 0.2 AND close < {e}")
        if key in ("rs_vol_pct_high_fade", "rs_vol_pct_high_carry"):
            r, p = g.rank(rs_vol(g), 252), g.lag(c, 3)
            up, dn = f"{r} > 0.9 AND close > {p}", f"{r} > 0.9 AND close < {p}"
            return side(dn, up) if key.endswith("fade") else side(up, dn)
        if key == "nr7_breakout":
            prices(g)
            m = g.min("tr", 7)
            g.add("nr7", f"tr <= {m}", [m])
            p, h, l = g.lag("nr7"), g.lag("high"), g.lag("low")
            return side(f"{p} AND close > {h}", f"{p} AND close < {l}")
        if key == "inside_bar_breakout":
            h1, l1, h2, l2 = g.lag("high"), g.lag("low"), g.lag("high", 2), g.lag("low", 2)
            return side(f"{h1} < {h2} AND {l1} > {l2} AND close > {h1}", f"{h1} < {h2} AND {l1} > {l2} AND close < {l1}")
        if key == "wide_range_thrust":
            a = atr(g, 14)
            r = g.lag(g.rank(a, 100))
            p = g.lag(a)
            return side(f"{r} < 0.5 AND tr > 2 * {p} AND close > open", f"{r} < 0.5 AND tr > 2 * {p} AND close < open")
        if key == "keltner_breakout":
            e, a = g.ema(c, 20), atr(g, 10)
            g.add("kok", f"{e} IS NOT NULL AND {a} IS NOT NULL", [e, a])
            g.add("ke", side(f"close > {e} + 2 * {a}", f"close < {e} - 2 * {a}"), [e, a])
            return g.rec("keltner", "0", f"CASE WHEN s.ke <> 0 THEN s.ke WHEN s.kok AND ((r.keltner = 1 AND s.close < s.{e}) OR (r.keltner = -1 AND s.close > s.{e})) THEN 0 ELSE r.keltner END", ["ke", "kok"])
        if key in ("chandelier_atr_trail", "chandelier_fixed_pct"):
            h, l = g.max("high", 22), g.min("low", 22)
            if key == "chandelier_atr_trail":
                a = atr(g, 22)
                up, dn, d = f"close > {l} + 3 * {a}", f"close < {h} - 3 * {a}", [a, h, l]
            else:
                up, dn, d = f"close > {l} * 1.06::DOUBLE", f"close < {h} * 0.94::DOUBLE", [h, l]
            return f"coalesce({g.held(g.add('ch_ev', events(up, dn), d))}, 0)"
        if key.startswith("natr"):
            a = atr(g, 14)
            g.add("natr", f"100 * {a} / close", [a])
            r, x, y = g.rank("natr", 252), g.ema(c, 21), g.ema(c, 55)
            gate = f"{r} < 0.5" if "low" in key else f"{r} >= 0.5"
            return side(f"{gate} AND {x} > {y}", f"{gate} AND {x} < {y}")
        if key == "ema55_side_unfiltered":
            e = g.ema(c, 55)
            return side(f"close > {e}", f"close < {e}")
    if fam == "flow":
        if key == "obv_ema21":
            obv(g)
            e = g.ema("obv", 21)
            return side(f"obv > {e}", f"obv < {e}")
        if key in ("obv_divergence20", "obv_leads20"):
            obv(g)
            cx, cn, ox, on = g.max(c, 20), g.min(c, 20), g.max("obv", 20), g.min("obv", 20)
            if key == "obv_divergence20":
                e = f"CASE WHEN close <= {cn} AND obv > {on} THEN 1 WHEN close >= {cx} AND obv < {ox} THEN -1 ELSE 0 END"
            else:
                e = f"CASE WHEN obv <= {on} AND close > {cn} THEN -1 WHEN obv >= {ox} AND close < {cx} THEN 1 ELSE 0 END"
            return g.hold(g.add("ev", e, [cx, cn, ox, on]), 5)
        if key == "mfi14_extremes":
            mfi(g)
            return side("mfi < 20", "mfi > 80")
        if key == "vwap_session_side":
            vwap(g)
            return side("close > vwap", "close < vwap")
        if key == "vwap_band2sigma":
            vwap(g)
            return "CASE WHEN vwap_sd > 0 AND sk >= 12 AND close < vwap - 2 * vwap_sd THEN 1 WHEN vwap_sd > 0 AND sk >= 12 AND close > vwap + 2 * vwap_sd THEN -1 ELSE 0 END"
        if key in ("volume_thrust", "absorption_narrow_range"):
            v, a = g.sma("volume", 20), atr(g, 14)
            busy = f"{v} > 0 AND volume / {v} > 2 AND {a} > 0 AND "
            e = (side(busy + f"tr > {a} AND clv > 0.5", busy + f"tr > {a} AND clv < -0.5") if key == "volume_thrust"
                 else side(busy + f"tr < {a} AND clv > 0", busy + f"tr < {a} AND clv < 0"))
            return g.hold(g.add("ev", e, [v, a, "clv", "tr"]), 5)
        if key == "volume_climax":
            g.add("lv", "ln(1 + volume)")
            m, s, cx, cn = g.sma("lv", 100), g.std("lv", 100), g.max(c, 20), g.min(c, 20)
            z = f"{s} > 0 AND (lv - {m}) / {s} > 3 AND "
            return g.hold(g.add("ev", f"CASE WHEN {z} close <= {cn} THEN 1 WHEN {z} close >= {cx} THEN -1 ELSE 0 END", [m, s, cx, cn]), 5)
        if key == "chaikin_osc_3_10":
            adosc(g)
            return side("adosc > 0", "adosc < 0")
        if key == "trend_with_participation":
            r, a, b = g.roc(c, 20), g.sma("volume", 20), g.sma("volume", 100)
            return side(f"{a} > {b} AND {r} > 0", f"{a} > {b} AND {r} < 0")
        if key == "move_without_volume":
            r, a, b = g.roc(c, 5), g.sma("volume", 5), g.sma("volume", 20)
            return side(f"{b} > 0 AND {a} < {b} AND {r} < 0", f"{b} > 0 AND {a} < {b} AND {r} > 0")
        if key == "nvi_fosback":
            nvi(g)
            return f"CASE WHEN nvi > {g.ema('nvi', 255)} THEN 1 ELSE 0 END"
        if key == "roc20_unfiltered":
            r = g.roc(c, 20)
            return side(f"{r} > 0", f"{r} < 0")
    if fam == "structure":
        h, l = g.max("high", 20, 1), g.min("low", 20, 1)
        d = [h, l]
        ev = lambda up, dn, dd: g.add("ev", events(up, dn), dd)
        H = lambda up, dn, dd: f"coalesce({g.held(ev(up, dn, dd))}, 0)"
        if key == "donchian_break_20":
            return H(f"close > {h}", f"close < {l}", d)
        if key == "donchian_55_exit_20":
            h5, l5 = g.max("high", 55, 1), g.min("low", 55, 1)
            return g.rec("dflat", "0", f"""CASE WHEN r.dflat = 0 THEN CASE WHEN s.close > s.{h5} THEN 1 WHEN s.close < s.{l5} THEN -1 ELSE 0 END
              WHEN r.dflat = 1 THEN CASE WHEN s.close < s.{l} THEN 0 ELSE 1 END ELSE CASE WHEN s.close > s.{h} THEN 0 ELSE -1 END END""", [h5, l5, h, l])
        if key == "sweep_reversal_20":
            return g.hold(ev(f"low < {l} AND close > {l}", f"high > {h} AND close < {h}", d), 10)
        if key == "retest_hold":
            def leg(p, brk, lvl, touch, beyond):
                t, v, q = f"r.{p}t", f"r.{p}v", f"r.{p}q"
                live = f"({t} > 0)"
                touched = f"({q} = 1 OR {touch.format(v=v)})"
                fire = f"(NOT ({brk}) AND {live} AND {touched} AND {beyond.format(v=v)})"
                g.rec(f"{p}t", "0", f"CASE WHEN {brk} THEN 10 WHEN {fire} THEN 0 WHEN {live} THEN {t} - 1 ELSE 0 END", d)
                g.rec(f"{p}v", "NULL", f"CASE WHEN {brk} THEN {lvl} ELSE {v} END", d)
                g.rec(f"{p}q", "0", f"CASE WHEN {brk} THEN 0 WHEN {live} AND {touched} THEN 1 ELSE {q} END", d)
                return g.rec(f"{p}f", "0", f"CASE WHEN {fire} THEN 1 ELSE 0 END", d)
            u = leg("u", f"coalesce(s.close > s.{h}, false)", f"s.{h}", "s.low <= {v}", "s.close > {v}")
            w = leg("d", f"coalesce(s.close < s.{l}, false)", f"s.{l}", "s.high >= {v}", "s.close < {v}")
            return g.hold(g.add("ev", events(f"{u} = 1", f"{w} = 1"), [u, w]), 10)
        if key == "compression_break":
            g.add("cw", f"{h} - {l}", d)
            m = g.min("cw", 60)
            return H(f"cw <= {m} AND close > {h}", f"cw <= {m} AND close < {l}", [m])
        if key == "volume_confirmed_break":
            v = g.sma("volume", 20)
            return H(f"close > {h} AND volume > {v}", f"close < {l} AND volume > {v}", [v, h, l])
        if key == "atr_buffered_break":
            a = atr(g, 14)
            return H(f"close > {h} + 0.5 * {a}", f"close < {l} - 0.5 * {a}", [a, h, l])
        hi, lo = swings(g)
        if key == "bos_swing":
            return H(f"close > {hi}", f"close < {lo}", [hi, lo])
        if key == "choch":
            return H(f"st_dn_seq AND close > {hi}", f"st_up_seq AND close < {lo}", ["st_dn_seq", "st_up_seq"])
        if key == "swing_trend_state":
            return "state"
        g.add("ab", f"coalesce(close > {hi}, false)", [hi]), g.add("be", f"coalesce(close < {lo}, false)", [lo])
        pa, pb = g.lag("ab"), g.lag("be")
        fa, fb = f"(ab AND NOT coalesce({pa}, false))", f"(be AND NOT coalesce({pb}, false))"
        if key == "range_fade_swing":
            return g.hold(ev(f"state = 0 AND {fb}", f"state = 0 AND {fa}", [pa, pb, "state"]), 10)
        return g.hold(ev(fb, fa, [pa, pb]), 10)
    if fam == "candles":
        ab, ar = candle_marks(g)
        o1, c1 = g.lag("open"), g.lag(c)
        if key.startswith("engulfing"):
            e = (f"CASE WHEN close >= open AND {c1} < {o1} AND ((close >= {o1} AND open < {c1}) OR (close > {o1} AND open <= {c1})) THEN 1 "
                 f"WHEN close < open AND {c1} >= {o1} AND ((open >= {c1} AND close < {o1}) OR (open > {c1} AND close <= {o1})) THEN -1 ELSE 0 END")
            if key == "engulfing_raw":
                return e
            m = g.ema(c, 200)
            g.add("eng", e, [o1, c1])
            return side(f"eng > 0 AND close > {m}", f"eng < 0 AND close < {m}")
        if key == "hammer_oversold":
            near, pl, r = g.avgb("range", 5, 2), g.lag("low"), rsi(g)
            return side(f"abs_body < {ab} AND lower_wick > abs_body AND upper_wick < 0.1::DOUBLE * {ar} AND least(open, close) <= {pl} + 0.2::DOUBLE * {near} AND {r} < 30", "false")
        if key == "shooting_star_overbought":
            r = rsi(g)
            return side("false", f"abs_body < {ab} AND upper_wick > abs_body AND lower_wick < 0.1::DOUBLE * {ar} AND least(open, close) > greatest({o1}, {c1}) AND {r} > 70")
        if key == "close_in_range":
            return side("high > low AND (close - low) / (high - low) >= 0.8::DOUBLE", "high > low AND (close - low) / (high - low) <= 0.2::DOUBLE")
        if key == "marubozu_continuation":
            return side(f"abs_body > {ab} AND close >= open AND upper_wick < 0.1::DOUBLE * {ar}", f"abs_body > {ab} AND close < open AND lower_wick < 0.1::DOUBLE * {ar}")
        if key == "doji_after_thrust":
            p, m, x = dmi(g)
            k = f"abs_body <= 0.1::DOUBLE * {ar} AND {x} > 25 AND "
            return side(k + f"{m} > {p}", k + f"{p} > {m}")
        if key == "outsized_wick":
            k = "high > low AND {w} >= 2 * abs_body AND {w} >= 0.6::DOUBLE * (high - low)"
            return side(k.format(w="lower_wick"), k.format(w="upper_wick"))
        if key == "range_expansion":
            p = g.lag(atr(g, 14))
            k = f"{p} > 0 AND tr >= 2 * {p} AND "
            return g.hold(g.add("ev", side(k + "close > open", k + "close < open"), [p]), 3)
        h1, l1, h2, l2 = g.lag("high"), g.lag("low"), g.lag("high", 2), g.lag("low", 2)
        if key == "inside_bar_break":
            return side(f"{h1} <= {h2} AND {l1} >= {l2} AND close > {h2}", f"{h1} <= {h2} AND {l1} >= {l2} AND close < {l2}")
        if key == "range_gap":
            return side(f"high < {l1}", f"low > {h1}")
        if key == "three_directional_bars":
            o2, c2, o3, c3, h3 = g.lag("open", 2), g.lag(c, 2), g.lag("open", 3), g.lag(c, 3), g.lag("high", 3)
            u1, u2, w1, w2 = g.lag("upper_wick"), g.lag("upper_wick", 2), g.lag("lower_wick"), g.lag("lower_wick", 2)
            r2, r3, n1, n2 = g.avgb("range", 10, 2), g.avgb("range", 10, 3), g.avgb("range", 5, 2), g.avgb("range", 5, 3)
            b0, b1, b2 = "(close - open)", f"({c1} - {o1})", f"({c2} - {o2})"
            up = (f"{b0} >= 0 AND {b1} >= 0 AND {b2} >= 0 AND {u2} < 0.1::DOUBLE * {r3} AND {u1} < 0.1::DOUBLE * {r2} AND upper_wick < 0.1::DOUBLE * {ar} "
                  f"AND close > {c1} AND {c1} > {c2} AND {o1} > {o2} AND {o1} <= {c2} + 0.2::DOUBLE * {n2} AND open > {o1} AND open <= {c1} + 0.2::DOUBLE * {n1} "
                  f"AND {b1} > {b2} - 0.6::DOUBLE * {n2} AND {b0} > {b1} - 0.6::DOUBLE * {n1} AND {b0} > {ab}")
            dn = (f"{c3} >= {o3} AND {c2} < {o2} AND {c1} < {o1} AND close < open AND {w2} < 0.1::DOUBLE * {r3} AND {w1} < 0.1::DOUBLE * {r2} AND lower_wick < 0.1::DOUBLE * {ar} "
                  f"AND {o1} < {o2} AND {o1} > {c2} AND open < {o1} AND open > {c1} AND {h3} > {c2} AND {c2} > {c1} AND {c1} > close")
            return g.hold(g.add("ev", side(up, dn), [o1, c1, o2, c2, o3, c3, h3, u1, u2, w1, w2, r2, r3, n1, n2, ab, ar]), 3)
        b, r = g.sum("body", 20), g.sum("range", 20)
        return side(f"{r} > 0 AND {b} / {r} >= 0.3::DOUBLE", f"{r} > 0 AND {b} / {r} <= -0.3::DOUBLE")
    held_clock(g)
    if key == "us_cash_hours_long":
        return side("hh BETWEEN 13 AND 20", "false")
    if key == "asia_hours_short":
        return side("false", "hh BETWEEN 0 AND 7")
    if key == "overlap_day_trend":
        g.add("day", "open_time_ms // 86400000")
        g.add("day_open", "first_value(open) OVER (PARTITION BY symbol, tf, day ORDER BY bar_idx)", ["day"])
        return side("hh BETWEEN 13 AND 16 AND close > day_open", "hh BETWEEN 13 AND 16 AND close < day_open")
    if key == "weekend_short":
        return side("false", "wd >= 5")
    if key == "friday_derisk_short":
        return side("false", "wd = 4 AND hh >= 18")
    if key == "cme_gap_monday":
        a = atr(g, 14)
        g.add("fri", "CASE WHEN (open_time_ms // 86400000 + 3) % 7 = 4 AND (open_time_ms // 3600000) % 24 = 21 THEN close END")
        g.add("fref", f"last_value(fri IGNORE NULLS) {g.w(97)}", ["fri"])
        k = f"((wd = 6 AND hh >= 22) OR (wd = 0 AND hh <= 11)) AND abs(close - fref) > {a} AND "
        g.add("zz", "1", [a, "fref"])
        return side(k + "close < fref", k + "close > fref")
    if key == "pre_funding_fade":
        r = g.roc(c, 8)
        return side(f"hh IN (7, 15, 23) AND {r} < 0", f"hh IN (7, 15, 23) AND {r} > 0")
    if key == "turn_of_month_long":
        return side("day(hd) <= 3 OR hd = last_day(hd)", "false")
    if key == "pre_quarterly_expiry_short":
        return side("false", f"month(hd) IN (3, 6, 9, 12) AND {LAST_FRI.format(d='hd')} - hd BETWEEN 1 AND 7")
    if key == "post_monthly_expiry_long":
        this = LAST_FRI.format(d="hd")
        prev = LAST_FRI.format(d="CAST(date_trunc('month', hd) - INTERVAL 1 DAY AS DATE)")
        return side(f"hd - CASE WHEN hd >= {this} THEN {this} ELSE {prev} END BETWEEN 1 AND 3", "false")
    days = ("(held - (SELECT max(h) FROM (VALUES (1354116240000), (1468082760000), (1589225040000), (1713571740000)) v(h) "
            "WHERE h <= held)) // 86400000")
    g.add("hdays", days, ["held"])
    return side("hdays BETWEEN 180 AND 540", "hdays > 540 AND hdays <= 900")


def signal_query(name: str, timeframes, warmup: int, min_bars: int, select: str | None = None) -> str:
    g = Graph()
    pos = _signal_sql(name, g)
    tfs = ", ".join(f"'{t}'" for t in timeframes)
    sel = (f"SELECT '{name}' AS signal_name, symbol, tf, bar_idx, open_time_ms, "
           f"CAST(CASE WHEN bar_idx >= {warmup} AND n_bars >= {min_bars} THEN {pos} ELSE 0 END AS BIGINT) AS position "
           f"FROM f WHERE tf IN ({tfs})")
    return g.render(sel)


# ------------------------------------------------------------------ shared pieces of the other twins

SAMPLE_SIGNALS = ("candles.close_in_range", "mean_reversion.streak3_fade", "momentum.roc10",
                  "seasonality.turn_of_month_long", "structure.donchian_break_20", "trend.ema_cross_21_55")


def positions(names=SAMPLE_SIGNALS) -> str:
    from tidemark.signals.registry import catalogue
    cat = catalogue()
    return " UNION ALL ".join(
        f"SELECT * FROM ({signal_query(n, cat[n].timeframes, cat[n].warmup, cat[n].min_bars)})" for n in names)


BARS = f"bars AS MATERIALIZED ({indexed(STUDY)})"
HORIZON = "CASE tf WHEN '15m' THEN 32 WHEN '1h' THEN 24 WHEN '4h' THEN 12 WHEN '1d' THEN 5 ELSE 12 END"
FWD = f"""fwd AS MATERIALIZED (SELECT a.symbol, a.tf, a.bar_idx, a.n_bars, a.open_time_ms, a.h AS horizon, ln(b.close / a.close) AS fwd
  FROM (SELECT *, {HORIZON} AS h FROM bars) a JOIN bars b ON a.symbol = b.symbol AND a.tf = b.tf AND b.bar_idx = a.bar_idx + a.h)"""
POS = f"pos AS MATERIALIZED ({positions()})"


def all_positions() -> str:
    """The whole catalogue."""
    from tidemark.signals.registry import catalogue
    return f"pos AS MATERIALIZED ({positions(list(catalogue()))})"


BAR_MS = """bar_ms AS MATERIALIZED (SELECT symbol, tf, CAST(median(d) AS BIGINT) AS bar_ms FROM (SELECT symbol, tf, open_time_ms - lag(open_time_ms)
  OVER (PARTITION BY symbol, tf ORDER BY bar_idx) AS d FROM bars) WHERE d IS NOT NULL GROUP BY 1, 2)"""


def oos(i: str, n: str, h: str) -> str:
    return (f"({i} // ({n} // 5) BETWEEN 1 AND 4 AND {i} >= ({i} // ({n} // 5)) * ({n} // 5) + {h})")


def zigzag_graph(k: float = 1.5, pct: float = 0.005, on_close: bool = False) -> Graph:
    g = Graph()
    a = atr(g, 14)
    hi, lo = ("close", "close") if on_close else ("high", "low")
    g.add("thr", f"CASE WHEN {a} IS NOT NULL THEN greatest({k!r}::DOUBLE * {a}, {pct!r}::DOUBLE * close) END", [a])
    ahead = f"(CASE WHEN r.zup = 1 THEN s.{hi} ELSE s.{lo} END)"
    back = f"(CASE WHEN r.zup = 1 THEN s.{lo} ELSE s.{hi} END)"
    new = f"(({ahead} - r.zpx) * r.zup > 0)"
    conf = f"(NOT {new} AND (r.zpx - {back}) * r.zup >= r.zthr)"
    def st(keep, first, ext, flip):
        return f"CASE WHEN s.thr IS NULL THEN {keep} WHEN r.zup IS NULL THEN {first} WHEN {new} THEN {ext} WHEN {conf} THEN {flip} ELSE {keep} END"
    d = ["thr"]
    g.rec("zup", "NULL", st("r.zup", "1", "r.zup", "-r.zup"), d)
    g.rec("zat", "NULL", st("r.zat", "s.bar_idx", "s.bar_idx", "s.bar_idx"), d)
    g.rec("zts", "NULL", st("r.zts", "s.open_time_ms", "s.open_time_ms", "s.open_time_ms"), d)
    g.rec("zpx", "NULL", st("r.zpx", f"s.{hi}", ahead, back), d)
    g.rec("zthr", "NULL", st("r.zthr", "s.thr", "s.thr", "s.thr"), d)
    on = f"s.thr IS NOT NULL AND r.zup IS NOT NULL AND {conf}"
    for n, v in (("ck", "r.zup"), ("ci", "r.zat"), ("ct", "r.zts"), ("cp", "r.zpx"), ("ch", "r.zthr")):
        g.rec(n, "NULL", f"CASE WHEN {on} THEN {v} END", d)
    g.add("atr", a, [a])
    return g


def pivots_sql(variant: str = "k1.5", **kw) -> str:
    return zigzag_graph(**kw).render(f"""SELECT symbol, tf, '{variant}' AS variant, CAST(ci AS BIGINT) AS idx, CAST(ct AS BIGINT) AS ts_ms,
      cp AS price, CAST(ck AS BIGINT) AS kind, ch AS thr_at_extreme, bar_idx AS confirmed_idx, open_time_ms AS confirmed_ts_ms,
      row_number() OVER (PARTITION BY symbol, tf ORDER BY bar_idx) - 1 AS pivot_no FROM f WHERE ck IS NOT NULL""")


def states_sql() -> str:
    return zigzag_graph().render("SELECT symbol, tf, 'k1.5' AS variant, bar_idx, n_bars, open_time_ms, close, atr, ck, zup, zat, zts, zpx, zthr FROM f")


PIV = f"piv AS MATERIALIZED ({pivots_sql()})"
STA = f"sta AS MATERIALIZED ({states_sql()})"


def _gauss(x, mu, s):
    return f"power(2.718281828459045::DOUBLE, -0.5 * power(({x} - {mu}) / {s}::DOUBLE, 2.0))"


def candidates_ctes() -> str:
    """cand: ranked candidates per pivot confirmation, from a self-contained pivot list."""
    parts = []
    for n, state, arch in ((3, "impulse@2", "'w2'"), (4, "impulse@3", "NULL"), (5, "impulse@4", "'w4'"), (6, "impulse", "'abc'")):
        p = [f"p[{i + 1}]" for i in range(n)]
        s = "s"
        ok = [f"{s} * {p[2]} > {s} * {p[0]}"]
        if n >= 4:
            ok.append(f"{s} * {p[3]} > {s} * {p[1]}")
        if n >= 5:
            ok.append(f"{s} * {p[4]} > {s} * {p[1]}")
        if n == 6:
            ok.append(f"NOT (abs({p[3]} - {p[2]}) < abs({p[1]} - {p[0]}) AND abs({p[3]} - {p[2]}) < abs({p[5]} - {p[4]}))")
        r2 = f"(CASE WHEN {p[1]} <> {p[0]} THEN abs({p[2]} - {p[1]}) / abs({p[1]} - {p[0]}) END)"
        e3 = f"(CASE WHEN {p[1]} <> {p[0]} THEN abs({p[3]} - {p[2]}) / abs({p[1]} - {p[0]}) END)" if n >= 4 else "CAST(NULL AS DOUBLE)"
        r4 = f"(CASE WHEN {p[3]} <> {p[2]} THEN abs({p[4]} - {p[3]}) / abs({p[3]} - {p[2]}) END)" if n >= 5 else "CAST(NULL AS DOUBLE)"
        sc, w = f"0.3 * coalesce({_gauss(r2, 0.618, 0.18)}, 0)", 0.30
        if n >= 4:
            sc, w = sc + f" + 0.3 * coalesce(greatest({_gauss(e3, 1.618, 0.45)}, {_gauss(e3, 2.618, 0.55)}), 0)", w + 0.30
        if n >= 5:
            sc, w = sc + f" + 0.2 * coalesce({_gauss(r4, 0.382, 0.15)}, 0) + 0.2 * coalesce(least(1.0, abs({r2} - {r4}) / 0.3::DOUBLE), 0)", w + 0.40
        inv = p[0] if n == 3 else p[1]
        rule = "R1 (wave 2 past the start of wave 1)" if n == 3 else "R3 (wave 4 inside wave 1)"
        trunc = f"{s} * {p[5]} <= {s} * {p[3]}" if n == 6 else "false"
        parts.append(f"""SELECT symbol, tf, variant, edge_no, confirmed_idx, confirmed_ts_ms AS available_at_ms, back, {n} AS n_points, '{state}' AS state, s AS direction,
          p AS points, pt AS pivot_ts, ({sc}) / {w!r}::DOUBLE AS score, {r2} AS retr_w2, {e3} AS ext_w3, {r4} AS retr_w4, {inv} AS invalidation_price, '{rule}' AS invalidation_rule,
          CAST({arch} AS VARCHAR) AS archetype, {trunc} AS truncated
          FROM (SELECT *, -lk[len(lk) - back - {n - 1}] AS s, lp[len(lp) - back - {n - 1}:len(lp) - back] AS p, lt[len(lt) - back - {n - 1}:len(lt) - back] AS pt
                FROM nine, range(0, 4) b(back) WHERE len(lp) >= back + {n}) WHERE {' AND '.join(ok)}""")
    return f"""nine AS MATERIALIZED (SELECT symbol, tf, variant, pivot_no AS edge_no, confirmed_idx, confirmed_ts_ms,
        list(price) OVER w AS lp, list(kind) OVER w AS lk, list(ts_ms) OVER w AS lt FROM piv
        WINDOW w AS (PARTITION BY symbol, tf, variant ORDER BY pivot_no ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
      pool AS ({' UNION ALL '.join(parts)}),
      cand AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf, variant, edge_no ORDER BY score DESC, n_points DESC, back) AS rank FROM pool) WHERE rank <= 4)"""


def plans_ctes() -> str:
    """plan: a plan or refusal per (trigger bar, candidate)."""
    return """dec_in AS (SELECT s.symbol, s.tf, s.variant, s.bar_idx, s.n_bars, s.open_time_ms, s.close AS price, s.atr,
        count(s.ck) OVER (PARTITION BY s.symbol, s.tf ORDER BY s.bar_idx) - 1 AS edge_no FROM sta s),
      p0 AS (SELECT d.*, c.rank, c.score, c.state, c.direction, c.points AS p, c.invalidation_price, c.archetype
        FROM dec_in d JOIN cand c USING (symbol, tf, variant, edge_no)),
      p1 AS (SELECT *, CASE WHEN archetype = 'w4' THEN p[3] ELSE p[1] END AS a, CASE WHEN archetype = 'w4' THEN p[4] ELSE p[2] END AS b,
        CASE WHEN archetype = 'w4' THEN 0.382::DOUBLE ELSE 0.5::DOUBLE END AS q1, CASE WHEN archetype = 'w4' THEN 0.5::DOUBLE ELSE 0.786::DOUBLE END AS q2,
        CASE WHEN archetype = 'w4' THEN p[5] ELSE p[3] END AS base, p[2] - p[1] AS leg FROM p0),
      p2 AS (SELECT *, least(b - (b - a) * q1, b - (b - a) * q2) AS lo0, greatest(b - (b - a) * q1, b - (b - a) * q2) AS hi0,
        base + CASE WHEN archetype = 'w4' THEN (p[4] - p[1]) * 0.618::DOUBLE ELSE leg * 1.618::DOUBLE END AS t2,
        invalidation_price - direction * greatest(0.25 * atr, 0.02::DOUBLE, 0.001::DOUBLE * price) AS stop FROM p1),
      p3 AS (SELECT *, CASE WHEN archetype = 'w4' AND direction > 0 THEN greatest(lo0, p[2] * 1.0005::DOUBLE) ELSE lo0 END AS zone_lo,
        CASE WHEN archetype = 'w4' AND direction < 0 THEN least(hi0, p[2] * 0.9995::DOUBLE) ELSE hi0 END AS zone_hi, abs(price - stop) AS risk FROM p2),
      p4 AS (SELECT *, CASE WHEN archetype IS NULL OR archetype NOT IN ('w2', 'w4') THEN 'state offers no entry' WHEN zone_lo >= zone_hi THEN 'entry zone is empty'
        WHEN risk <= 0 THEN 'entry is the stop' WHEN direction * (price - stop) <= 0 THEN 'price past the stop' WHEN atr <= 0 THEN 'no range' END AS early FROM p3),
      p5 AS (SELECT *, CASE WHEN early IS NULL THEN risk / atr ELSE 0 END AS stop_atr, CASE WHEN early IS NULL THEN 0.0015::DOUBLE * price / risk ELSE 0 END AS cost_r,
        CASE WHEN early IS NULL THEN abs(t2 - price) / risk ELSE 0 END AS rr_t2,
        CASE WHEN early IS NULL AND direction * (CASE WHEN direction > 0 THEN zone_lo ELSE zone_hi END - stop) > 0
          THEN abs(t2 - (zone_lo + zone_hi) / 2) / (direction * ((zone_lo + zone_hi) / 2 - stop)) ELSE 0 END AS rr_in_zone FROM p4),
      plan AS MATERIALIZED (SELECT *, CASE WHEN early IS NULL THEN (1.1::DOUBLE + cost_r + 0.15::DOUBLE) / (rr_t2 + 1.1::DOUBLE) ELSE 0 END AS p_required,
        early IS NULL AND NOT (stop_atr < 0.75) AND NOT (cost_r > 0.2::DOUBLE) AS viable,
        early IS NULL AND NOT (stop_atr < 0.75) AND NOT (cost_r > 0.2::DOUBLE) AND price BETWEEN zone_lo AND zone_hi AS in_zone,
        CASE WHEN early IS NULL AND stop_atr > 3 THEN 3.0::DOUBLE / stop_atr ELSE 1.0 END AS size_factor,
        CASE WHEN early IS NOT NULL THEN early WHEN stop_atr < 0.75 THEN 'stop inside noise floor' WHEN cost_r > 0.2::DOUBLE THEN 'fees take too much of R' END AS refusal FROM p5)"""


def barrier_ctes(entries: str, out: str, bars: str = "bars", max_bars: int = 48) -> str:
    """Triple-barrier outcome of every row of ``entries``."""
    tp = "CASE WHEN e.direction > 0 THEN b.high >= e.target ELSE b.low <= e.target END"
    sl = "CASE WHEN e.direction > 0 THEN b.low <= e.stop ELSE b.high >= e.stop END"
    return f"""{out}_w AS MATERIALIZED (SELECT e.entry_id, b.bar_idx AS j, b.close AS c, {tp} AS tp, {sl} AS sl, abs(e.entry - e.stop) AS risk,
        (CASE WHEN e.direction > 0 THEN b.high - e.entry ELSE e.entry - b.low END) / abs(e.entry - e.stop) AS fav,
        (CASE WHEN e.direction > 0 THEN e.entry - b.low ELSE b.high - e.entry END) / abs(e.entry - e.stop) AS adv
        FROM {entries} e JOIN {bars} b ON b.symbol = e.symbol AND b.tf = e.tf AND b.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + {max_bars}),
      {out}_h AS (SELECT entry_id, min(j) AS hit FROM {out}_w WHERE tp OR sl GROUP BY 1),
      {out}_x AS (SELECT w.entry_id, greatest(0, max(fav)) AS mfe_r, greatest(0, max(adv)) AS mae_r, count(*) AS bars, last(c ORDER BY j) AS lc,
        bool_or(w.j = h.hit AND tp) AS tp, bool_or(w.j = h.hit AND sl) AS sl
        FROM {out}_w w LEFT JOIN {out}_h h USING (entry_id) WHERE h.hit IS NULL OR w.j <= h.hit GROUP BY 1),
      {out} AS MATERIALIZED (SELECT e.*, CASE WHEN x.sl THEN 'sl' WHEN x.tp THEN 'tp' ELSE 'vertical' END AS barrier,
        CASE WHEN x.sl THEN -1.0 WHEN x.tp THEN abs(e.target - e.entry) / abs(e.entry - e.stop) WHEN x.lc IS NULL THEN 0
          ELSE e.direction * (x.lc - e.entry) / abs(e.entry - e.stop) END AS r,
        coalesce(x.mae_r, 0) AS mae_r, coalesce(x.mfe_r, 0) AS mfe_r, coalesce(x.bars, 0) AS bars, coalesce(x.tp AND x.sl, false) AS ambiguous
        FROM {entries} e LEFT JOIN {out}_x x USING (entry_id))"""


def hash32(seed: int, *parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def twin_ctes(entries: str, out: str, seed: int = 17) -> str:
    j = f"least(e.n_total - 2, e.bar_idx + {hash32(seed, 'e.entry_id')} % 20 + 1)"
    return f"""{out} AS MATERIALIZED (SELECT e.* REPLACE (b.bar_idx AS bar_idx, b.close AS entry, b.close - e.direction * abs(e.entry - e.stop) AS stop,
        b.close + e.direction * abs(e.entry - e.stop) * (abs(e.target - e.entry) / abs(e.entry - e.stop)) AS target)
        FROM (SELECT x.*, n.n_bars AS n_total FROM {entries} x JOIN (SELECT symbol, tf, max(n_bars) AS n_bars FROM bars GROUP BY 1, 2) n USING (symbol, tf)) e
        JOIN bars b ON b.symbol = e.symbol AND b.tf = e.tf AND b.bar_idx = {j})"""


def spaced(rows: str, out: str, keys: str, t: str, span: str) -> str:
    """Greedy spacing by stepping from kept row to kept row."""
    on = " AND ".join(f"a.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return (f"{out} AS (SELECT {keys}, min({t}) AS kept FROM {rows} GROUP BY {keys} UNION ALL "
            f"SELECT {ak}, min(a.{t}) FROM {out} r JOIN {rows} a ON {on} AND a.{t} >= r.kept + a.{span} GROUP BY {ak})")
