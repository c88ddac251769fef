"""A user's own signal file: columns found by name, times and positions read by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Vocabulary of column names and position words (English, Spanish, Catalan).
TIME_NAMES = ("time", "timestamp", "date", "datetime", "fecha", "ts", "open_time", "día", "dia", "data")
SIGNAL_NAMES = ("signal", "señal", "senal", "senyal", "position", "posicion", "posición", "posicio", "posició",
                "side", "lado", "direction", "direccion", "dirección", "direccio", "direcció", "pos")
PRICE_NAMES = ("close", "cierre", "tancament", "price", "precio", "preu", "adj close", "adj_close", "last",
               "último", "ultimo", "c")
LONG_WORDS = ("long", "largo", "llarg", "buy", "compra", "comprar", "l", "b", "1", "alcista", "up")
SHORT_WORDS = ("short", "corto", "curt", "sell", "venta", "venda", "vender", "vendre", "s", "-1", "bajista",
               "baixista", "down")
FLAT_WORDS = ("flat", "fuera", "fora", "none", "cash", "0", "neutral", "", "nan", "hold")
TIME_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS",
                "yyyy-MM-dd HH:mm:ssXXX", "MM/dd/yyyy", "dd/MM/yyyy", "MMM d yyyy")


def find_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """Exact name first, then the first column whose name contains a vocabulary word."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    for n in names:
        if n in low:
            return low[n]
    return next((c for c in columns if any(n in c.strip().lower() for n in names)), None)


def to_ms(df: DataFrame, col: str) -> Column:
    """Epoch ms of a time column. Numeric: the median magnitude picks the unit. Text: a list of
    readable formats, UTC; with slashes the month comes first where both readings fit. A missing time is an error."""
    raw = F.trim(F.col(col).cast("string"))
    num = F.expr(f"try_cast(trim(cast(`{col}` AS STRING)) AS DOUBLE)")
    bad, med = df.agg(F.count_if(raw.isNotNull() & num.isNull()), F.expr("percentile_approx(abs("
                      f"try_cast(trim(cast(`{col}` AS STRING)) AS DOUBLE)), 0.5)")).first()
    if bad == 0 and med is not None:
        # DECIMAL reads "1710374400.0" and "1.7103744E9" and keeps all digits of nanoseconds; a fraction of the unit is cut
        v = F.expr(f"try_cast(try_cast(trim(cast(`{col}` AS STRING)) AS DECIMAL(38, 9)) AS BIGINT)")
        v = F.coalesce(v, F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce(raw, F.lit("NULL")))).cast("long"))
        if med > 1e17:
            return F.floor(v / 1_000_000)
        if med > 1e14:
            return F.floor(v / 1000)
        if med > 1e11:
            return v
        if med > 1e8:
            return v * 1000
        raise ValueError(f"values around {med:.0f} are neither a timestamp nor a date: is '{col}' the time column?")
    ts = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in TIME_FORMATS])
    return F.when(ts.isNull(), F.raise_error(F.concat(F.lit("unreadable date: "), F.coalesce(raw, F.lit("NULL")))).cast("long")
                  ).otherwise(F.unix_millis(ts))


def to_position(df: DataFrame, col: str) -> Column:
    """Sign of a numeric column, or the direction a word means; unknown words are an error."""
    raw = F.lower(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))))
    num = F.expr(f"try_cast(trim(cast(`{col}` AS STRING)) AS DOUBLE)")
    words = F.when(raw.isin(*LONG_WORDS), 1).when(raw.isin(*SHORT_WORDS), -1).when(raw.isin(*FLAT_WORDS), 0)
    not_num = F.count_if(num.isNull() & (raw != ""))
    n_text = df.agg(not_num).first()[0]
    if n_text == 0:
        return F.signum(F.when(F.isnan(num), 0.0).otherwise(F.coalesce(num, F.lit(0.0)))).cast("byte")
    odd = [r[0] for r in df.select(F.when(words.isNull(), raw).alias("w")).filter("w IS NOT NULL").distinct()
           .orderBy("w").limit(8).collect()]
    if odd:
        raise ValueError(f"unknown signal values {odd}: use -1/0/1 or words such as long, short, flat")
    return words.cast("byte")


def import_signals(df: DataFrame, *, time_col: str | None = None, signal_col: str | None = None,
                   price_col: str | None = None, seq: str | None = None) -> tuple[DataFrame, dict]:
    """(``ts, position, price``) of any table with a time and a signal column, and what was
    understood. Of rows with the same time the last stays; prices count only when at least 90% are
    numbers and all are positive."""
    ct, cs = time_col or find_column(df.columns, TIME_NAMES), signal_col or find_column(df.columns, SIGNAL_NAMES)
    if ct is None or cs is None:
        raise ValueError(f"no {'time' if ct is None else 'signal'} column among {df.columns}")
    cp = price_col or find_column(df.columns, PRICE_NAMES)
    cp = cp if cp not in (ct, cs) else None
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    price = F.expr(f"try_cast(`{cp}` AS DOUBLE)") if cp else F.lit(None).cast("double")
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) != float("inf"))
    rows = df.select(to_ms(df, ct).alias("ts"), to_position(df, cs).alias("position"),
                     F.when(finite, price).alias("price"), order.alias("_seq"))
    if cp:
        n, ok, low = rows.agg(F.count(F.lit(1)), F.count("price"), F.min("price")).first()
        if not (n and ok >= 0.9 * n and low > 0):
            cp, rows = None, rows.withColumn("price", F.lit(None).cast("double"))
    out = rows.groupBy("ts").agg(F.max_by(F.struct("position", "price"), "_seq").alias("v")).select("ts", "v.*")
    return out, {"time": ct, "signal": cs, "price": cp}


def read_signals_csv(spark: SparkSession, path: str, **kw) -> tuple[DataFrame, dict]:
    """A CSV whose separator is whichever of ``, ; tab`` splits its header line most."""
    header = spark.read.text(path).limit(1).first()
    if header is None:
        raise ValueError("the file has no rows")
    sep = max(",;\t", key=header[0].count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return import_signals(df, **kw)


def align_signals(signals: DataFrame, bars: DataFrame, step: int, name: str = "user") -> DataFrame:
    """Positions on the bar grid: last one per bucket, only buckets that are bars, then held until
    changed; 0 before the first."""
    grid = signals.groupBy((F.col("ts") - F.pmod(F.col("ts"), F.lit(step))).alias("open_time_ms")).agg(
        F.max_by("position", "ts").alias("_p"))
    b = bars.select("symbol", "tf", "bar_idx", "open_time_ms").join(grid, "open_time_ms", "left").withColumn(
        "_b", F.floor(F.col("bar_idx") / 4096))
    keys = ["symbol", "tf"]
    last = b.groupBy(*keys, "_b").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("bar_idx"))).alias("_l"))
    last = last.select(*keys, "_b", F.last("_l", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_b").rowsBetween(
        W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy(*keys, "_b").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    pos = F.coalesce(F.last("_p", ignorenulls=True).over(w), F.col("_before"), F.lit(0))
    return b.join(last, [*keys, "_b"]).select(F.lit(name).alias("signal_name"), *keys, "bar_idx", "open_time_ms",
                                              pos.cast("byte").alias("position"))
