"""Clock graph: edges between devices that observed the same events, and reconciliation to a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, stored
from .fit import fit, ransac
from .transforms import compose, invert


def pair_observations(observations: DataFrame, keys: list[str], event: str = "event_id", device: str = "device_id", t: str = "t_local_us", weight: str | None = None) -> DataFrame:
    """``keys, a, b, t_a, t_b``: device pairs a < b of each event; an event has a device once, so pairs are bounded by devices.

    With ``weight`` (the event's quality), the lesser device's row says what its pairs weigh.
    """
    one = observations.select(*keys, event, F.col(device).alias("a"), F.col(t).alias("t_a"), *([F.col(weight).alias("weight")] if weight else []))
    two = observations.select(*keys, event, F.col(device).alias("b"), F.col(t).alias("t_b"))
    return one.join(two, [*keys, event]).where("a < b").drop(event)


def build_edges(observations: DataFrame, keys: list[str], min_events: int = 2, method: str = "tls", ransac_threshold_us: float = 1000.0, weight: str | None = None, **names) -> DataFrame:
    """``keys, a, b, alpha, beta_us, residual_us, n_events, confidence``: t_a = alpha * t_b + beta, where a < b share enough events.

    ``n_events`` counts the pairs, or with RANSAC the inliers. ``weight`` names a column of the
    observations, such as the event's quality, that the fits are weighted by.
    """
    if method not in ("tls", "ransac"):
        raise ValueError(f"unknown method {method!r}")
    group = [*keys, "a", "b"]
    pairs = stored(pair_observations(observations, keys, weight=weight, **names))  # read by each pass of the fit
    w = "weight" if weight else None
    if method == "tls":
        return fit(pairs, group, "t_b", "t_a", "tls", robust=True, weight=w).where(F.col("n_events") >= min_events)
    enough = pairs.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") >= min_events).drop("n")
    return ransac(pairs.join(enough, group), group, ransac_threshold_us, x="t_b", y="t_a", weight=w)


def reconcile(edges: DataFrame, devices: DataFrame, keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """``keys, device_id, alpha, beta_us, cost, clock_confidence, hops, path, reachable`` for every device.

    ``devices(keys, device_id, is_reference)``. A path costs the sum of -log(confidence) of its edges;
    every device takes its cheapest path to the session's reference, ties going to the neighbour that
    is cheaper itself and then to the lesser id. Maps are composed and confidences multiplied along
    the path. A device without a path keeps the identity with confidence 0. Rounds of relaxation run
    until nothing changes, at most one per device of the largest session; each is one join with the
    edges and one pre-aggregated minimum.
    """
    a_inv, b_inv = invert("alpha", "beta_us")
    cost = -F.log(F.greatest(F.col("confidence"), F.lit(1e-9)))
    arcs = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"), F.col("alpha").alias("ea"), F.col("beta_us").alias("eb"), cost.alias("ec"), F.col("confidence").alias("ek"))
    back = edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"), a_inv.alias("ea"), b_inv.alias("eb"), cost.alias("ec"), F.col("confidence").alias("ek"))
    arcs = arcs.unionByName(back)
    state = devices.where("is_reference").select(
        *keys,
        F.col("device_id").alias("u"),
        F.lit(1.0).alias("alpha"),
        F.lit(0.0).alias("beta_us"),
        F.lit(0.0).alias("cost"),
        F.lit(1.0).alias("conf"),
        F.lit(0).alias("hops"),
        F.array("device_id").alias("path"),
    )
    return _relax(state, arcs, devices, keys, max_rounds)


def _relax(state: DataFrame, arcs: DataFrame, devices: DataFrame, keys: list[str], max_rounds: int | None) -> DataFrame:
    base, before = state, None
    arcs = checkpointed(arcs)
    rounds = max_rounds or (devices.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1)
    for _ in range(rounds):
        alpha, beta = compose("alpha", "beta_us", "ea", "eb")
        steps = state.join(arcs, [*keys, "u"]).where(~F.array_contains("path", F.col("v"))).select(
            *keys,
            "v",
            F.struct((F.col("cost") + F.col("ec")).alias("cost"), F.col("cost").alias("from_cost"), F.col("u").alias("from")).alias("__rank"),
            F.struct(alpha.alias("alpha"), beta.alias("beta_us"), (F.col("cost") + F.col("ec")).alias("cost"), (F.col("conf") * F.col("ek")).alias("conf"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("v")).alias("path")).alias("__step"),
        )
        best = steps.groupBy(*keys, "v").agg(F.min_by("__step", "__rank").alias("__step")).select(*keys, F.col("v").alias("u"), "__step.*")
        best = best.join(base.select(*keys, "u"), [*keys, "u"], "left_anti")
        state = checkpointed(base.unionByName(best))
        if before is not None and state.join(before, [*keys, "u", "path"], "left_anti").isEmpty():
            break  # every device has the path it had: nothing will change
        before = state.select(*keys, "u", "path")
    found = devices.select(*keys, "device_id").join(state.withColumnRenamed("u", "device_id"), [*keys, "device_id"], "left")
    reached = F.col("path").isNotNull()
    return found.select(
        *keys,
        "device_id",
        F.coalesce("alpha", F.lit(1.0)).alias("alpha"),
        F.coalesce("beta_us", F.lit(0.0)).alias("beta_us"),
        F.when(reached, F.col("cost")).otherwise(0.0).alias("cost"),
        F.when(reached, F.col("conf")).otherwise(0.0).alias("clock_confidence"),
        "hops",
        "path",
        reached.alias("reachable"),
    )
