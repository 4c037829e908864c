"""Mixing sources to target shares of the tokens by entropy balancing.

Every document of a listed source gets a rate between 0 and its source's repeat cap. The rates are those
nearest in relative entropy, weighted by tokens, to a common base rate that give each source its target
tokens and keep its token-weighted document length; their dual is convex and solved by Newton iterations,
each of which sums gradient and curvature per source in one distributed aggregation. The tilted rates are
then rounded into whole copies: the whole part of a rate stays, and a threshold on a hash, found from
per-source bins of tokens, decides which documents get one copy more, so that a source misses its target
by less than one document.

Defined results: sizes are token counts of the public vocabulary; null, empty and token-less documents and
those of unlisted or null sources are never chosen; a source whose cap cannot reach its target uses every
document as often as the cap allows and falls short; a listed source without documents gives a row with no
tokens; repeated rows are documents of their own; targets listed twice count once with their largest share
and cap; null shares and caps count as 0; an empty table chooses nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import BROADCAST_BYTES, cut, ship

from . import tokens

#: Share of the listed sources' tokens that the mixture holds in all.
TOTAL_SHARE = 0.5
ITERATIONS = 30
TOLERANCE = 1e-9
BINS = 4096


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
            F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"),
        )
    )


def _lookup(values: dict[str, float], default: float = 0.0):
    if not values:
        return F.lit(default)
    pairs = F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(pairs[F.col("source")], F.lit(default))


def _solve(sized: DataFrame, goals: dict[str, float], caps: dict[str, int], base: float) -> dict[str, tuple[float, float]]:
    """Dual variables (level, tilt by relative length) of each source that can reach its goal."""
    means = {r["source"]: r["mean"] for r in sized.groupBy("source").agg((F.sum(F.col("tokens").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("mean")).collect()}
    active = [s for s in goals if s in means and goals[s] > 0]
    dual = {s: np.zeros(2) for s in active}
    start = {s: np.log(min(base, 0.9 * caps[s]) / (caps[s] - min(base, 0.9 * caps[s]))) for s in active}
    x = F.col("tokens") / _lookup(means, 1.0) - 1
    rows = sized.where(F.col("source").isin(active))
    for _ in range(ITERATIONS if active else 0):
        odds = _lookup({s: start[s] + dual[s][0] for s in active}) + _lookup({s: dual[s][1] for s in active}) * x
        share = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(40.0)), F.lit(-40.0))))
        weight = F.col("tokens") * _lookup({s: caps[s] for s in active})
        bend = weight * share * (1 - share)
        sums = rows.groupBy("source").agg(
            F.sum(weight * share).alias("g0"), F.sum(weight * share * x).alias("g1"),
            F.sum(bend).alias("h00"), F.sum(bend * x).alias("h01"), F.sum(bend * x * x).alias("h11"),
        )
        worst = 0.0
        for r in sums.collect():
            s = r["source"]
            gap = np.array([r["g0"] - goals[s], r["g1"]]) / goals[s]
            curve = np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"]]]) / goals[s] + 1e-9 * np.eye(2)
            step = np.clip(np.linalg.solve(curve, gap), -2.0, 2.0)
            dual[s] = dual[s] - step
            worst = max(worst, float(np.abs(gap).max()))
        if worst < TOLERANCE:
            break
    return {s: (start[s] + dual[s][0], dual[s][1], means[s]) for s in active}


def _rated(sized: DataFrame, solved: dict, goals: dict[str, float], caps: dict[str, int], full: set[str]) -> DataFrame:
    odds = _lookup({s: v[0] for s, v in solved.items()}) + _lookup({s: v[1] for s, v in solved.items()}) * (
        F.col("tokens") / _lookup({s: v[2] for s, v in solved.items()}, 1.0) - 1
    )
    cap = _lookup({s: c for s, c in caps.items()})
    rate = F.when(F.col("source").isin(sorted(full)), cap) if full else F.when(F.lit(False), cap)
    rate = rate.when(F.col("source").isin(sorted(solved)), cap / (1 + F.exp(-odds))).otherwise(F.lit(0.0))
    uniform = (F.xxhash64("id") / F.lit(float(1 << 63)) + 1) / 2
    return sized.withColumn("rate", F.least(rate, cap)).withColumn("whole", F.floor("rate").cast("int")).withColumn("key", uniform - (F.col("rate") - F.floor("rate")))


def mixture(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, source, tokens, copies) of the chosen documents, (source, target_share, actual_share, goal_share, tokens, documents, copies, falls_short)).

    ``actual_share`` is a source's share of the mixture's tokens, ``goal_share`` its tokens over the size aimed at; the latter
    stays below the target where a source falls short.
    """
    ship(documents.sparkSession)
    listed = cut(_targets(targets))
    side = F.broadcast(listed.select("source")) if listed.count() * 64 <= BROADCAST_BYTES else listed.select("source")
    own = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text")).join(side, "source", "left_semi")
    entries = tokens.map_entries(own, "id", "text", path)
    sized = own.select("id", "source", F.size(tokens.encoded(F.col("text"), entries)).cast("long").alias("tokens"))
    sized = cut(sized).where("tokens > 0")
    held = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    wanted = {r["source"]: r for r in listed.collect()}
    total = TOTAL_SHARE * sum(held.values())
    caps = {s: r["max_repeats"] for s, r in wanted.items()}
    goals = {s: r["target_share"] * total for s, r in wanted.items() if s in held and caps[s] > 0}
    full = {s for s in goals if goals[s] >= caps[s] * held[s]}
    solved = _solve(sized, {s: g for s, g in goals.items() if s not in full}, caps, TOTAL_SHARE)
    rated = cut(_rated(sized, solved, goals, caps, full))
    binned = rated.withColumn("bin", F.floor((F.col("key") + 1) / 2 * BINS).cast("int"))
    parts = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("whole")).alias("kept")).collect()
    edge: dict[str, int] = {}
    spare: dict[str, float] = {}
    own: dict[str, list] = {s: [] for s in solved}
    for r in sorted(parts, key=lambda r: r["bin"]):
        if r["source"] in own:
            own[r["source"]].append(r)
    for s, bins in own.items():
        rest = goals[s] - sum(r["kept"] for r in bins)
        edge[s], spare[s] = -1, 0.0
        for r in bins:
            if rest < r["n"]:
                edge[s], spare[s] = r["bin"], rest
                break
            rest -= r["n"]
            edge[s] = r["bin"] + 1
    cutoff = _lookup(edge, -1.0)
    sure = binned.withColumn("extra", (F.col("bin") < cutoff).cast("int"))
    at_edge = F.col("bin") == cutoff
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    near = sure.where(at_edge).withColumn("extra", (running - F.col("tokens") / 2 <= _lookup(spare)).cast("int"))
    chosen = sure.where(~at_edge).unionByName(near)
    cap = _lookup({s: c for s, c in caps.items()})
    copies = F.least(F.col("whole") + F.col("extra"), cap).cast("int")
    chosen = cut(chosen.select("id", "source", "tokens", copies.alias("copies")).where("copies > 0"))
    used = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies")
    )
    held_tokens = F.coalesce("tokens", F.lit(0))
    mixed = F.sum(held_tokens).over(Window.partitionBy(F.lit(0)))  # one row a listed source
    shares = listed.join(used, "source", "left").select(
        "source",
        "target_share",
        F.when(mixed > 0, held_tokens / mixed).otherwise(0.0).alias("actual_share"),
        (held_tokens / F.lit(total) if total else F.lit(0.0)).alias("goal_share"),
        held_tokens.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        ((F.col("target_share") > 0) & (F.col("source").isin(sorted(full)) | ~F.col("source").isin(sorted(goals)))).alias("falls_short"),
    )
    return chosen.withColumnRenamed("id", id_col), shares
