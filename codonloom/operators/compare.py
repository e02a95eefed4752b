"""Results of methods compared: ablation layers, paired bootstrap, long and wide tables, frozen against fresh."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATES = ("biological_pass", "assembly_pass", "gc_pass", "multi_pass")
#: Upper bounds of the Poisson(1) distribution function, in draws of 2**32, for 0, 1, 2, ... events.
POISSON = [round(2**32 * p) for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080, 0.99999887480, 0.99999988857, 0.99999998995)]


def layer_summary(results: DataFrame, layers: dict[str, str], replicated: str = "L0") -> DataFrame:
    """layer, method, n_sequences, n_errors, the four pass rates and mean CAI, to 4 places; replicates of the replicated layer are averaged by sequence first. Error rows are counted and left out."""
    name = F.create_map(*[x for layer, method in layers.items() for x in (F.lit(method), F.lit(layer))])
    rows = results.withColumn("layer", name[F.col("method")]).filter("layer is not null")
    values = [F.avg(F.col(c).cast("double")).alias(c) for c in (*RATES, "cai")]
    per_row = rows.filter("status = 'ok'").select("layer", "method", "seq_id", *[F.col(c).cast("double").alias(c) for c in (*RATES, "cai")])
    each = per_row.filter(F.col("layer") == replicated).groupBy("layer", "method", "seq_id").agg(*values).unionByName(per_row.filter(F.col("layer") != replicated))
    means = each.groupBy("layer", "method").agg(F.countDistinct("seq_id").alias("n_sequences"), *[F.round(F.avg(c), 4).alias(c.replace("pass", "rate").replace("cai", "mean_cai")) for c in (*RATES, "cai")])
    errors = rows.groupBy("layer").agg(F.count(F.when(F.col("status") == "error", 1)).alias("n_errors"))
    return means.join(F.broadcast(errors), "layer")


def resampled(each: DataFrame, resamples: int, seed: int) -> DataFrame:
    """method, r, s, k of each(method, seq_id, v): the sum of v and the number of sequences in each resample; r is -1 for all sequences.

    A resample draws a sequence Poisson(1) times, by 32 bits of md5 over (seed, sequence, resample): the same for all
    methods, which keeps pairs together. What leaves a task is one row a method and resample.
    """
    bounds, numbers, most = np.array(POISSON), [b"|%d" % r for r in range(resamples)], max(1, (1 << 20) // max(resamples, 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in parts:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most).to_pydict()
                ids, at = np.unique(part["key"], return_inverse=True)
                raw = b"".join([md5(k + r).digest()[:4] for k in (f"boot|{seed}|{x}".encode() for x in ids.tolist()) for r in numbers])
                times = np.searchsorted(bounds, np.frombuffer(raw, ">u4").astype(np.int64), "right").reshape(len(ids), resamples)
                method, value = np.array(part["method"]), np.array(part["v"], float)
                for m in set(part["method"]):
                    own = method == m
                    k, v = times[at[own]], value[own]
                    sums = np.array([np.append(v @ k, v.sum()), np.append(k.sum(0), len(v))])
                    total[m] = total[m] + sums if m in total else sums
        for m, (s, k) in total.items():
            r = np.append(np.arange(resamples), -1)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(r)), pa.array(r, pa.int32()), pa.array(s), pa.array(k.astype(np.int64))], ["method", "r", "s", "k"])

    rows = each.select(F.col("seq_id").cast("string").alias("key"), "method", "v").mapInArrow(run, "method string, r int, s double, k long")
    return rows.groupBy("method", "r").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))


def bootstrap(results: DataFrame, resamples: int = 1000, seed: int = 320, value: str = "multi_pass", against: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """what (a method, or 'method - reference'), observed, lower, upper: paired percentile intervals of 95 % over sequences.

    Replicates are averaged by sequence. A sequence becomes `resamples` weights within its task, summed there before the
    shuffle, so what is exchanged is one row a task, method and resample, however many sequences there are.
    """
    spark = results.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # named, so that few narrow rows are not drawn in one task
    narrow = results.select("method", "seq_id", F.coalesce(F.col(value), F.lit(False)).cast("double").alias("v")).repartition(tasks, "seq_id")
    sums = staged(resampled(narrow.groupBy("method", "seq_id").agg(F.avg("v").alias("v")), resamples, seed), "resamples")  # a row a method and resample, read several times
    observed = sums.filter("r < 0").select("method", (F.col("s") / F.col("k")).alias("observed"))
    rates = sums.filter("r >= 0 and k > 0").select("method", "r", (F.col("s") / F.col("k")).alias("rate"))
    limits = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    own = rates.groupBy("method").agg(limits("rate").alias("q")).join(observed, "method").select(F.col("method").alias("what"), "observed", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    pairs = [(m, ref) for m, refs in (against or {}).items() for ref in refs]
    if not pairs:
        return own
    names = results.sparkSession.createDataFrame(pairs, "method string, reference string")
    other = rates.select(F.col("method").alias("reference"), "r", F.col("rate").alias("other"))
    gaps = rates.join(F.broadcast(names), "method").join(other, ["reference", "r"]).groupBy("method", "reference").agg(limits(F.col("rate") - F.col("other")).alias("q"))
    seen = observed.select(F.col("method").alias("reference"), F.col("observed").alias("other"))
    gaps = gaps.join(observed, "method").join(seen, "reference")
    return own.unionByName(gaps.select(F.concat_ws(" - ", "method", "reference").alias("what"), (F.col("observed") - F.col("other")).alias("observed"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper")))


def long_metrics(summary: DataFrame, keys: tuple[str, ...] = ("profile_id", "method")) -> DataFrame:
    """keys, metric, value: the numeric columns of a summary as rows; nulls are left out."""
    numeric = [c for c, t in summary.dtypes if c not in keys and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    rows = summary.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(list(keys), numeric, "metric", "value")
    return rows.filter("value is not null")


def wide(metrics: DataFrame, metric: str, profiles: Sequence[str]) -> DataFrame:
    """method and a column a profile, null where a profile lacks the method."""
    return metrics.filter(F.col("metric") == metric).groupBy("method").pivot("profile_id", list(profiles)).agg(F.first("value"))


def shifts(metrics: DataFrame, profiles: Sequence[str], metric: str = "mean_cai", places: int = 4) -> DataFrame:
    """method, the metric under each profile and its shift against the first profile; null where either is."""
    table = wide(metrics, metric, profiles)
    first = profiles[0]
    return table.select("method", *[F.col(p).alias(f"{metric}_{p}") for p in profiles], *[F.round(F.col(p) - F.col(first), places).alias(f"shift_{p}_vs_{first}") for p in profiles[1:]])


def differences(frozen: DataFrame, fresh: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """method, metric, frozen, fresh, diff (to 6 places) and match (null where either is missing): a full join, so what only one side has is there."""
    a, b = frozen.select("method", "metric", F.col("value").alias("frozen")), fresh.select("method", "metric", F.col("value").alias("fresh"))
    diff = F.round(F.col("fresh") - F.col("frozen"), 6)
    return a.join(b, ["method", "metric"], "full").withColumn("diff", diff).withColumn("match", F.abs("diff") <= tolerance)


def verdict(compared: DataFrame) -> DataFrame:
    """verdict (PASS or DIVERGED), compared, diverged, missing: rows without one side do not decide."""
    return compared.agg(
        F.when(F.coalesce(F.bool_and("match"), F.lit(True)), "PASS").otherwise("DIVERGED").alias("verdict"),
        F.count("match").alias("compared"), F.count(F.when(~F.col("match"), 1)).alias("diverged"), F.count(F.when(F.col("match").isNull(), 1)).alias("missing"),
    )


def correlations(weights: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """profile and a column a profile: Pearson's r of the weights of common codons, to 6 places. weights: profile_id, codon, w."""
    table = weights.groupBy("codon").pivot("profile_id", list(profiles)).agg(F.first("w"))
    rows = table.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a in profiles for b in profiles])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(a).alias("profile"), *[F.col(f"`{a}|{b}`").alias(b) for b in profiles]) for a in profiles])))


def rank_shifts(weights: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """aa, codon, the codon's rank by weight under each profile and the shift of each against the first; residues of one codon are left out."""
    by = Window.partitionBy("profile_id", "aa")
    rows = weights.filter("w is not null").withColumn("k", F.count(F.lit(1)).over(by)).filter("k >= 2").withColumn("rank", F.row_number().over(by.orderBy(F.desc("w"), "codon")))
    table = rows.groupBy("aa", "codon").pivot("profile_id", list(profiles)).agg(F.first("rank"))
    return table.select("aa", "codon", *[F.col(p).alias(f"rank_{p}") for p in profiles], *[(F.col(p) - F.col(profiles[0])).alias(f"rank_shift_{p}_vs_{profiles[0]}") for p in profiles[1:]])
