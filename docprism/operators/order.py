"""Order statistics and resampling of whole tables, by counts of sorted ranges and of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprism.operators.prep import positions, ranged
from docprism.sources.tables import cut


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, n, quantiles``: exact quantiles with linear interpolation, as an array in the order of ``shares``; nulls don't count.

    Values are counted first and dealt out in sorted ranges.  The ranges' sums say
    which ranges hold the wanted ranks; only those are read again and counted up,
    so no buffer holds the values of a group.
    """
    counted = rows.where(F.col(value).isNotNull()).select(F.struct(*keys, F.lit(0).alias("_")).alias("_g"), F.col(value).cast("double").alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    spread = cut(counted.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()))
    per = spread.groupBy("_g", "_part").agg(F.sum("_c").alias("_n"))  # about a row a range
    by = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.coalesce(F.sum("_n").over(by), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy("_g"))})
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)]))
    wanted = per.withColumn("_s", asked).withColumn("_at", F.col("_s.q") * (F.col("_total") - 1))
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_rank >= _before and _rank < _before + _n")
    wanted = wanted.select("_g", "_part", "_before", "_total", F.col("_s.i").alias("_i"), "_at", "_rank")
    within = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = spread.join(F.broadcast(wanted.select("_g", "_part").distinct()), ["_g", "_part"], "left_semi").withColumn("_upto", F.sum("_c").over(within))
    found = held.join(F.broadcast(wanted), ["_g", "_part"]).where("_rank - _before < _upto and _rank - _before >= _upto - _c")
    weight = F.when(F.floor("_at") == F.ceil("_at"), 1.0).when(F.col("_rank") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    each = found.groupBy("_g", "_i").agg(F.sum(F.col("_v") * weight).alias("_q"), F.max("_total").alias("n"))
    out = each.groupBy("_g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("quantiles"))
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "n", "quantiles")


def replaced_ranks(members: DataFrame, targets: DataFrame, pool: str, key: str, score: str, replaced: str) -> DataFrame:
    """``targets`` with ``clean_rank`` and ``attacked_rank``: places by score, then key, in the pool as it is and where only the target's score is ``replaced``.

    Members and replaced scores are sorted together once, in ranges; the members
    counted up to a replaced score give its place, so each of a pool's targets is
    ranked without a pool of its own.
    """
    name = [F.col(pool).alias("_pool"), F.col(key).alias("_key")]
    both = members.select(*name, F.col(score).cast("double").alias("_s"), F.lit(1).alias("_m")).unionByName(targets.select(*name, F.col(replaced).cast("double").alias("_s"), F.lit(0).alias("_m")))
    counted = cut(ranged(both.withColumn("_k", F.struct("_pool", (-F.col("_s")).alias("s"), "_key", (1 - F.col("_m")).alias("m"))), "_k", {"_upto": F.col("_m").cast("long")}))
    start = counted.where("_m = 1").groupBy("_pool").agg((F.min("_upto") - 1).alias("_start"))
    clean = counted.where("_m = 1").select("_pool", "_key", F.col("_s").alias("_clean"), F.col("_upto").alias("_at"))
    asked = counted.where("_m = 0").select("_pool", "_key", F.col("_s").alias("_new"), F.col("_upto").alias("_before"))
    placed = asked.join(clean, ["_pool", "_key"]).join(start, "_pool")
    own = (F.col("_clean") >= F.col("_new")).cast("long")  # its clean place lies before: the pool loses that score
    placed = placed.select("_pool", "_key", (F.col("_at") - F.col("_start")).alias("clean_rank"), (F.col("_before") - F.col("_start") - own + 1).alias("attacked_rank"))
    return targets.join(placed, (targets[pool] == placed["_pool"]) & (targets[key] == placed["_key"])).drop("_pool", "_key")


#: Groups whose multiplicities are drawn together.
BLOCK = 1024


def _node_seed(seed: int, draw: int, low: int, high: int) -> list[int]:
    return [seed, draw, low, high]


def block_total(seed: int, draw: int, n: int, block: int) -> int:
    """How many of ``n`` draws of ``n`` groups fall on a block: binomial splits from the root of a tree of blocks down to it, each by its own seed."""
    low, high, left = 0, -(-n // BLOCK), n
    while high - low > 1:
        middle = (low + high) // 2
        first = min(middle * BLOCK, n) - low * BLOCK
        share = first / (min(high * BLOCK, n) - low * BLOCK)
        taken = int(np.random.Generator(np.random.PCG64(_node_seed(seed, draw, low, high))).binomial(left, share))
        low, high, left = (low, middle, taken) if block < middle else (middle, high, left - taken)
    return left


def block_multiplicities(seed: int, draws: int, n: int, block: int) -> np.ndarray:
    """Multiplicity of each of the block's groups (columns) in each draw (rows)."""
    size = min(BLOCK, n - block * BLOCK)
    out = np.zeros((draws, size), np.int64)
    for b in range(draws):
        total = block_total(seed, b, n, block)
        out[b] = np.random.Generator(np.random.PCG64(_node_seed(seed, b, block, block))).multinomial(total, np.full(size, 1 / size))
    return out


def resampled_sums(groups: DataFrame, order: str, sums: list[str], draws: int, seed: int = 42) -> DataFrame:
    """``b`` and the ``sums`` of each bootstrap draw: exactly as many groups as there are, with replacement.

    A group's multiplicity follows from its place in the order and the seeds alone, so
    each task draws for the blocks that it holds and passes on one row a draw.
    """
    placed = positions(groups.select(order, *sums), order)
    n = placed.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, times = np.zeros((len(sums), draws)), None, None
        for batch in batches:
            place = batch.column(0).to_numpy()
            values = [batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(sums))]
            for block in np.unique(place // BLOCK):
                if block != held:
                    held, times = block, block_multiplicities(seed, draws, n, int(block))
                at = np.flatnonzero(place // BLOCK == block)
                for k, v in enumerate(values):
                    total[k] += times[:, place[at] - block * BLOCK] @ v[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(t) for t in total)], names=["b", *sums])

    columns = ", ".join(f"{c} double" for c in sums)
    parts = placed.select("position", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums]).mapInArrow(run, f"b long, {columns}")
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in sums])
