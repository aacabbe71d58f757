"""How grid posteriors hold up when calibrations are off and truths lie between the nodes, as one distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids

#: Name, factor on the ratio and shift of the normalised green by which a calibration is off.
SCENARIOS = (("matched", 1.0, 0.0), ("ratio_high", 1.1, 0.0), ("ratio_low", 0.9, 0.0), ("green_high", 1.0, 0.1), ("green_low", 1.0, -0.1), ("both_high", 1.1, 0.1), ("both_low", 0.9, -0.1))


def trials(truths: DataFrame, replicates: int, sd_log_ratio: float, sd_green: float, seed: int = 0) -> DataFrame:
    """Observations of truths (truth_id, artifact_id, dose_uM, time_h, ratio, green_norm) under each scenario with seeded noise.

    Noise comes from a hash of seed, truth, scenario and replicate, so partitions do not matter.
    """
    spark = truths.sparkSession
    scenarios = F.broadcast(spark.createDataFrame(list(SCENARIOS), "scenario string, factor double, shift double"))  # a stated list
    t = truths.join(scenarios).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))

    def unit(salt: int):
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "truth_id", "scenario", "replicate"), F.lit(1 << 40))
        return (h + 0.5) / float(1 << 40)

    size = F.sqrt(-2 * F.log(unit(1)))
    a, b = size * F.cos(2 * F.pi() * unit(2)), size * F.sin(2 * F.pi() * unit(2))
    return t.select(
        F.xxhash64("truth_id", "scenario", "replicate").alias("obs_id"), "scenario", "artifact_id", F.col("dose_uM").alias("true_dose"), F.col("time_h").alias("true_time"),
        (F.col("ratio") * F.col("factor") * F.exp(a * sd_log_ratio)).alias("ratio_obs"), (F.col("green_norm") + F.col("shift") + b * sd_green).alias("green_obs"),
        F.lit(0.0).alias("model_low"), F.lit(1.0).alias("model_high"), F.lit(False).alias("low"),
    )


def evaluate(grid_with_prior: DataFrame, observations: DataFrame, covariance: tuple[float, float, float], max_distance: float = 9.21, credible_mass: float = 0.95) -> DataFrame:
    """(scenario, n, dose_error, time_error, inclusion, entropy_bits, poor_fit) over trials; the nearest node stands for a truth between nodes."""
    m, s = grids.grid_posterior(grid_with_prior, observations, covariance, max_distance=max_distance, credible_mass=credible_mass)
    o = observations.select("obs_id", "scenario", "true_dose", "true_time")
    j = m.join(o, "obs_id")
    per = j.groupBy("obs_id", "scenario", "true_dose", "true_time").agg(
        F.sum(F.col("mass") * F.col("dose_uM")).alias("d"), F.sum(F.col("mass") * F.col("time_h")).alias("t"), F.sum(F.when(F.col("mass") > 0, -F.col("mass") * F.log2("mass"))).alias("h"),
        F.min_by("in_region", F.struct(F.abs(F.col("dose_uM") - F.col("true_dose")), F.abs(F.col("time_h") - F.col("true_time")))).alias("inside"),
    )
    per = per.join(s.select("obs_id", (F.col("status") == "poor_model_fit").alias("poor")), "obs_id")
    part = lambda c: F.avg(F.col(c).cast("double"))
    return per.groupBy("scenario").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("d") - F.col("true_dose"))).alias("dose_error"), F.avg(F.abs(F.col("t") - F.col("true_time"))).alias("time_error"), part("inside").alias("inclusion"), F.avg("h").alias("entropy_bits"), part("poor").alias("poor_fit"))
