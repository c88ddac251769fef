"""A panel: bar series cut into bounded chunks, and the windows that run inside them.

Every window of the library is partitioned by ``(symbol, tf, ck)``. A chunk owns ``chunk`` bars
and also carries copies of the ``halo`` bars before it, so a bounded lookback is answered inside
the chunk and no task ever holds a whole series. All layers share one partitioning and one sort
order, hence one exchange for an arbitrarily deep stack of indicators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.bars import dense_bar_index
from tidemark.session import lean_columns, materialize

BLOCK = 512                 # closed-form block of the affine scan
CHUNK = 65_536
HALO = 8_192                # to begin with; ``compute`` widens it to what the wanted features read
MAX_HALO = 1_048_576        # two years of minutes: a longer lookback is refused
ROWS_PER_TASK = 40_000
SERIES = ("symbol", "tf")
KEYS = (*SERIES, "ck")


@dataclass
class Panel:
    """Chunked bars plus the one piece of metadata plans depend on: is anything split at all."""

    df: DataFrame
    chunk: int
    halo: int
    split: bool
    n_rows: int = 0

    def with_df(self, df: DataFrame) -> Panel:
        return Panel(df, self.chunk, self.halo, self.split, self.n_rows)

    def reach(self, depth: int) -> int:
        """How far before its chunk a value carried ``depth`` times is trusted."""
        return min(self.halo, self.chunk) >> depth

    def widened(self, halo: int) -> Panel:
        """The same rows with more of them copied before each chunk. Owned rows are right whatever the halo was,
        so columns added so far come along."""
        if not self.split or halo <= self.halo:
            return self
        if halo > MAX_HALO:
            raise ValueError(f"a lookback of more than {MAX_HALO} bars is not served")
        rows_ = self.owned()
        # chunks grow with very long lookbacks, so copies stay at most as many as the rows themselves
        return _cut(rows_, max(self.chunk, halo) if halo > CHUNK else self.chunk, halo, self.n_rows)

    def owned(self) -> DataFrame:
        """Drop the halo copies."""
        if not self.split:
            return self.df
        return self.df.filter(F.floor(F.col("bar_idx") / self.chunk) == F.col("ck"))


def build_panel(bars: DataFrame, *, chunk: int = CHUNK, halo: int = HALO,
                indexed: bool = False, stored: bool = False) -> Panel:
    """Index, store and chunk a bar table.

    ``indexed``: bar_idx/n_bars are already there. ``stored``: the table is already a written
    one, so reading it twice is cheap.
    """
    if chunk % BLOCK or halo % BLOCK or chunk % halo:
        raise ValueError("chunk must be a multiple of halo, both multiples of the block size")
    lean_columns()
    if not indexed:
        bars = dense_bar_index(bars)
    if not stored:
        bars = materialize(bars, "bars")
    total, longest = bars.agg(F.count(F.lit(1)), F.max("n_bars")).first()
    if (longest or 0) > chunk:
        return _cut(bars, chunk, halo, total)
    df = bars.withColumn("ck", F.floor(F.col("bar_idx") / chunk))
    return Panel(_spread(df, total), chunk, halo, False, total)


def _cut(bars: DataFrame, chunk: int, halo: int, total: int) -> Panel:
    """Every bar goes to its own chunk and to each later one whose halo holds it."""
    i = F.col("bar_idx")
    last = F.least(F.floor((F.col("n_bars") - 1) / chunk), F.floor((i + halo) / chunk))
    df = bars.withColumn("ck", F.explode(F.sequence(F.floor(i / chunk), last)))
    return Panel(_spread(df, int(total * (1 + halo / chunk))), chunk, halo, True, total)


def _spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Window stages are CPU-bound on narrow rows: partitions are sized by rows, not by bytes, so coalescing by
    shuffle bytes does not serialise them."""
    parallel = max(df.sparkSession.sparkContext.defaultParallelism, n_rows // ROWS_PER_TASK + 1)
    return df.withColumn("blk", F.floor(F.col("bar_idx") / BLOCK)).repartition(parallel, *KEYS)


# ------------------------------------------------------------------ windows

_SPECS: dict = {}


def _spec(name: str, make, *args):
    """Window specs are JVM objects: build each once per application."""
    key = (SparkContext._active_spark_context.applicationId, name, *args)
    if key not in _SPECS:
        _SPECS[key] = make()
    return _SPECS[key]


def win():
    """Series order inside a chunk. (blk, bar_idx) so block windows reuse the same sort."""
    return _spec("win", lambda: W.partitionBy(*KEYS).orderBy("blk", "bar_idx"))


def rows(n: int, skip: int = 0):
    """The last n bars, ending ``skip`` bars ago."""
    return _spec("rows", lambda: win().rowsBetween(-(n - 1) - skip, -skip), n, skip)


def running():
    return _spec("run", lambda: win().rowsBetween(W.unboundedPreceding, 0))


def block_running():
    return _spec("block", lambda: W.partitionBy(*KEYS, "blk").orderBy("bar_idx")
                 .rowsBetween(W.unboundedPreceding, 0))


def blocks_before(j: int):
    return _spec("before", lambda: W.partitionBy(*KEYS).orderBy("blk").rangeBetween(-j, -1), j)


# ------------------------------------------------------------------ unbounded carry

def carry_last(panel: Panel, cols: dict[str, str], depth: int) -> Panel:
    """``out = last non-null value of in`` since the start of the series, exactly.

    Inside a chunk it is a running ``last``. Where series are split, the part before the chunk
    comes from a summary table (one row per sub-chunk), scanned and joined back on the chunk key.
    Events in the first part of the halo are not trusted (their own lookback is cut off), so each
    carry at ``depth`` d only uses events from ``panel.reach(d)`` bars before the chunk on.
    """
    if not panel.split:
        return panel.with_df(panel.df.select("*", *[
            F.last(c, ignorenulls=True).over(running()).alias(o) for o, c in cols.items()]))
    stored = panel.with_df(materialize(panel.df, "carry"))
    sub = panel.reach(depth)
    if sub < 1 or panel.chunk % sub:
        raise ValueError("halo too small for this many chained carries")
    per = panel.chunk // sub
    summary = (stored.owned()
               .withColumn("g", F.floor(F.col("bar_idx") / sub))
               .groupBy(*SERIES, "g")
               .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_idx"))).alias(c)
                      for c in cols.values()]))
    before = W.partitionBy(*SERIES).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    carry = (summary.select(*SERIES, "g", *[
                 F.last(c, ignorenulls=True).over(before).alias(f"_cy_{o}")
                 for o, c in cols.items()])
             .filter(F.pmod(F.col("g") + 1, F.lit(per)) == 0)
             .withColumn("ck", ((F.col("g") + 1) / per).cast("long")).drop("g"))
    trusted = F.col("bar_idx") >= F.col("ck") * panel.chunk - sub
    local = stored.df.select("*", *[
        F.last(F.when(trusted, F.col(c)), ignorenulls=True).over(running()).alias(f"_in_{o}")
        for o, c in cols.items()])
    joined = local.join(carry, list(KEYS), "left")
    out = joined.select(*stored.df.columns, *[
        F.when(trusted, F.coalesce(f"_in_{o}", f"_cy_{o}")).alias(o) for o in cols])
    return panel.with_df(out)


def carry_sum(panel: Panel, cols: dict[str, str]) -> DataFrame:
    """Exact running sum since the start of each series over the owned rows (two-level)."""
    own = panel.owned()
    if not panel.split:
        return own.select("*", *[F.sum(c).over(running()).alias(o) for o, c in cols.items()])
    own = materialize(own, "carry")
    sums = own.groupBy(*KEYS).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in cols.items()])
    before = W.partitionBy(*SERIES).orderBy("ck").rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select(*KEYS, *[
        F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0.0)).alias(f"_o_{o}") for o in cols])
    j = own.join(offs, list(KEYS))
    return j.select(*own.columns, *[
        (F.sum(c).over(running()) + F.col(f"_o_{o}")).alias(o) for o, c in cols.items()])
