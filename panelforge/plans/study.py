"""Simulation studies: grid, run, resume, aggregate, tables.

A study is a table of runs. Running it is one grouped pass whose tasks simulate, filter and measure; what is done already
is taken away by an anti-join beforehand, so a study that broke off goes on. Failures are rows with an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expand_list, filter_config, list_mean, seed_of
from ..kernels import diagnostics, filters, likelihoods, optimize, particle, simulate
from ..kernels.params import Params, random_study, stable, uninformed
from ..operators.aggregate import group_stats, list_stats, paired_effect
from ..operators.models import spread
from ..operators.reshape import consolidate, stack, without_done


def grid(spark: SparkSession, N: Sequence[int], K: Sequence[int], T: Sequence[int], filter_types: Sequence[str], particles: Sequence[int], replicates: int) -> DataFrame:
    """(run_id, N, K, T, filter_type, num_particles, rep, seed): all combinations with K <= N; particles only for the
    particle filter. A run's seed depends on its data's dimensions, so that filters meet the same data."""
    def axis(name: str, values: Sequence, kind: str) -> DataFrame:
        return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name))

    base = axis("N", N, "int").crossJoin(axis("K", K, "int")).filter("K <= N").crossJoin(axis("T", T, "int")).crossJoin(spark.range(replicates).select(F.col("id").cast("int").alias("rep")))
    arms = [base.select("*", F.lit(f).alias("filter_type"), F.lit(None).cast("int").alias("num_particles")) for f in filter_types if f != "PF"]
    if "PF" in filter_types:
        arms.append(base.select("*", F.lit("PF").alias("filter_type")).crossJoin(axis("num_particles", particles, "int")))
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    label = F.concat(F.lit("N"), "N", F.lit("-K"), "K", F.lit("-T"), "T", F.lit("-"), filter_config(), F.lit("-r"), "rep")
    return out.withColumns({"run_id": label, "seed": seed_of("N", "K", "T", "rep")}).select("run_id", "N", "K", "T", "filter_type", "num_particles", "rep", "seed")


def _replicate(r: dict) -> dict:
    out = {k: r[k] for k in ("run_id", "N", "K", "T", "filter_type", "num_particles", "seed", "rep")}
    try:
        at = [time.perf_counter()]
        p = random_study(r["N"], r["K"], int(r["seed"]) % 2**32)
        at.append(time.perf_counter())
        y, f, h = simulate.simulate(p, r["T"], int(r["seed"] + 1) % 2**32)
        at.append(time.perf_counter())
        if r["filter_type"] == "PF":
            x = particle.particle_filter(p, y, int(r["num_particles"]), seed=int(r["seed"]) % 2**32)
            states, ll = x.means, float(x.loglik.sum())
        else:
            got = filters.run_filter(filters.Batch.of([p]), y[None], r["filter_type"])
            states, ll = got.alpha[0], float(filters.total(got.loglik)[0])
        at.append(time.perf_counter())
        rmse, corr = diagnostics.accuracy(np.hstack([f, h]), states)
        k, steps = r["K"], np.diff(at)
        nulled = lambda v: [None if not np.isfinite(x) else float(x) for x in v]
        out |= {
            "param_gen_time": steps[0], "data_sim_time": steps[1], "filter_time": steps[2], "rmse_f": nulled(rmse[:k]), "corr_f": nulled(corr[:k]),
            "rmse_h": nulled(rmse[k:]), "corr_h": nulled(corr[k:]), "loglik": ll if np.isfinite(ll) else None, "error": None
        }
    except Exception as e:  # a replicate's failure is a result
        out |= {c: None for c in ("param_gen_time", "data_sim_time", "filter_time", "rmse_f", "corr_f", "rmse_h", "corr_h", "loglik")} | {"error": f"{type(e).__name__}: {e}"}
    return out


def run(runs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One metrics row for each run that isn't done."""
    todo = runs if done is None else without_done(runs, done, ["run_id"])
    names = [c.strip().split()[0] for c in schemas.METRICS.split(",")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pd.DataFrame([_replicate(r) for r in rows], columns=names)

    return spread(todo, "run_id").mapInPandas(go, schemas.METRICS)


METRIC_LISTS = ("rmse_f", "corr_f", "rmse_h", "corr_h")


def summarised(metrics: DataFrame) -> DataFrame:
    """Per configuration: failures apart, list metrics averaged over components, then mean, deviation, median, count, error."""
    flat = metrics.filter("error is null").select("N", "K", "T", filter_config().alias("filter_config"), "filter_time", "loglik", *[list_mean(c).alias(c) for c in METRIC_LISTS])
    return group_stats(flat, ["N", "K", "T", "filter_config"], [*METRIC_LISTS, "filter_time", "loglik"])


def table(metrics: DataFrame, value: str, configs: Sequence[str]) -> DataFrame:
    """Rows N, K, T; columns filter configurations; cells 'mean ± deviation'."""
    s = summarised(metrics)
    cell = F.when(F.col(f"{value}_count") > 1, F.format_string("%.3f ± %.3f", f"{value}_mean", f"{value}_std")).otherwise(F.format_string("%.3f", f"{value}_mean"))
    return s.groupBy("N", "K", "T").pivot("filter_config", list(configs)).agg(F.first(cell)).orderBy("N", "K", "T")


# --- studies of fits ---


def _states(p: Params, y: np.ndarray, kind: str, particles: int | None, seed: int) -> np.ndarray:
    if kind == "PF":
        return particle.particle_filter(p, y, int(particles), seed=seed).means
    return filters.run_filter(filters.Batch.of([p]), y[None], kind).alpha[0]


def _fit_replicate(r: dict, max_steps: int, stability_weight: float) -> dict:
    """One record: true parameters and data from the run's seed, a fit from an uninformed start, the objective at the truth,
    how well states are known at the estimate, and errors of the parameters."""
    names = [c.strip().split()[0] for c in schemas.FIT_METRICS.replace("map<string,double>", "map").split(",")]
    out = dict.fromkeys(names) | {k: r[k] for k in ("run_id", "N", "K", "T", "filter_type", "num_particles", "seed", "rep", "fix_mu")}
    began = time.perf_counter()
    number = lambda v: float(v) if np.isfinite(v) else None
    try:
        kind, fixed, seed = r["filter_type"], bool(r["fix_mu"]), int(r["seed"]) % 2**32
        options = {"particles": int(r["num_particles"]), "seed": seed} if kind == "PF" else {}
        truth = stable(r["N"], r["K"], seed)
        y, f, h = simulate.simulate(truth, r["T"], (seed + 1) % 2**32)
        start = uninformed(r["N"], r["K"])
        got = optimize.fit(y, start, kind, fix_mu=fixed, true_mu=truth.mu if fixed else None, stability_weight=stability_weight, max_steps=max_steps, **options)
        at_truth = likelihoods.objectives([truth], y, kind, None, stability_weight, False, None, **options)[0]
        out |= {"optimizer_name": got.optimizer_name, "success": bool(got.success), "result_code": got.result_code, "steps": got.steps, "fit_time": got.time_taken}
        out |= {"final_loss": number(got.final_loss), "loss_at_truth": number(at_truth), "error": got.error_message or None}
        k = r["K"]
        rmse, corr = diagnostics.accuracy(np.hstack([f, h]), _states(got.final_params, y, kind, r["num_particles"], seed))
        means = [number(v[part].mean()) for part in (slice(0, k), slice(k, 2 * k)) for v in (rmse, corr)]
        out |= dict(zip(("factor_rmse_mean", "factor_correlation_mean", "volatility_rmse_mean", "volatility_correlation_mean"), means))
        rows = diagnostics.param_errors(truth, got.final_params)
        out["errors"] = {f"{e['param']}_{m}": float(e[m]) for e in rows for m in ("bias", "mae", "rmse", "frob_diff") if e[m] is not None}
    except Exception as e:  # a replicate's failure is a result
        out["error"] = f"{type(e).__name__}: {e}"
    return out | {"total_time": time.perf_counter() - began}


def run_fits(runs: DataFrame, done: DataFrame | None = None, max_steps: int = 500, stability_weight: float = 1000.0) -> DataFrame:
    """One record for each run that isn't done; runs: grid() with fix_mu. Every fit is a task's own; a failure is a row."""
    todo = runs if done is None else without_done(runs, done, ["run_id"])
    names = [c.strip().split()[0] for c in schemas.FIT_METRICS.replace("map<string,double>", "map").split(",")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                yield pd.DataFrame([_fit_replicate(r, max_steps, stability_weight)], columns=names)

    return spread(todo, "run_id").mapInPandas(go, schemas.FIT_METRICS)


FIT_SCALARS = (
    "final_loss", "steps", "fit_time", "total_time", "factor_rmse_mean", "factor_correlation_mean", "volatility_rmse_mean", "volatility_correlation_mean",
)


def analysed_fits(metrics: DataFrame) -> dict[str, DataFrame]:
    """The analysis of a study of fits, as tables of one lineage: `prepared` (successes, with their configuration), `errors`
    (mean, deviation, median of each parameter error), `scalars` (statistics per configuration), `fix_mu` (the effect of a
    known mu on each scalar) and `report`, a tidy table (part, label, metric, value) of all of it. metrics: run_fits()."""
    prepared = metrics.filter(F.coalesce("success", F.lit(False))).withColumns(
        {"filter_config": filter_config(), "fix_mu": F.coalesce(F.col("fix_mu").cast("int"), F.lit(-1)), "num_particles": F.coalesce("num_particles", F.lit(0))}
    )
    errors = group_stats(prepared.select(F.explode("errors").alias("metric", "value")), ["metric"], ["value"], ("mean", "std", "median", "count"))
    by = ["N", "K", "T", "filter_config", "fix_mu"]
    scalars = group_stats(prepared, by, FIT_SCALARS, ("mean", "std", "median", "count"))
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in FIT_SCALARS])
    long = prepared.select("filter_config", "fix_mu", F.inline(each))
    flags = long.withColumn("known", F.when(F.col("fix_mu") >= 0, F.col("fix_mu") == 1))
    effect = paired_effect(flags, ["filter_config", "metric"], "known", "value")
    label = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    cells = F.inline(F.array(*[F.struct(F.lit(f"{c}_{m}").alias("metric"), F.col(f"{c}_{m}").alias("value")) for c in FIT_SCALARS for m in ("mean", "median")]))
    parts = (
        errors.select(F.lit("errors").alias("part"), F.lit("all").alias("label"), "metric", F.col("value_mean").alias("value")),
        scalars.select(F.lit("scalars").alias("part"), label.alias("label"), cells),
        effect.select(F.lit("fix_mu").alias("part"), F.col("filter_config").alias("label"), "metric", F.col("effect_pct").alias("value")),
    )
    return {"prepared": prepared, "errors": errors, "scalars": scalars, "fix_mu": effect, "report": stack(*parts)}


def finished_metrics(studies: Sequence[DataFrame], by: Sequence[str], kind: str, kinds: Sequence[str], lists: Sequence[str], sizes: int) -> DataFrame:
    """Records of several studies to one table, in five steps of one lineage: merged by name; lists averaged element by
    element within a configuration; each list expanded into `sizes` columns; columns <kind>_<name>_<i> consolidated by the
    row's kind; and each name's mean over its elements beside them."""
    merged = stack(*studies)
    aggregated = merged.select(*by).distinct()
    for column in lists:
        keyed = merged.select(*[F.col(k).alias(f"__{k}") for k in by], column)
        means = list_stats(keyed, [f"__{k}" for k in by], column).withColumnRenamed("mean", column).drop("se", "n")
        same = None
        for k in by:
            one = F.col(k).eqNullSafe(F.col(f"__{k}"))
            same = one if same is None else same & one
        aggregated = aggregated.join(means, same, "left").drop(*[f"__{k}" for k in by])
    expanded = aggregated
    for column in lists:
        expanded = expand_list(expanded, column, sizes, keep=False)
    tidy = consolidate(expanded, kind, kinds)
    names = sorted({c.rsplit("_", 1)[0] for c in tidy.columns if c not in by})
    return tidy.withColumns({f"{n}_mean": list_mean(F.array(*[F.col(f"{n}_{i}") for i in range(sizes)])) for n in names})
