"""Segments, leaderboards and paired tests over per-event results of several models and seeds.

``results`` has a row for each (model, seed, event_idx): customer_id, category, is_repeat, nll, top1, status.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.artefacts import Artefacts
from ..sources.shared import stored
from .prefix import running


def trajectory(n: Column) -> Column:
    return F.when(n <= 2, "short").when(n <= 6, "medium").otherwise("long")


def concentration(n: Column) -> Column:
    return F.when(n <= 1, "single").when(n == 2, "dual").otherwise("multi")


def novelty(share: Column) -> Column:
    return F.when(share < 0.3, "low").when(share <= 0.7, "mid").otherwise("high")


def segments(events: DataFrame) -> DataFrame:
    """Each customer's three segments over all seeds; a missing category is a category."""
    return (
        events.groupBy("customer_id")
        .agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("category", F.lit("\0"))).alias("c"), F.avg((~F.coalesce("is_repeat", F.lit(False))).cast("double")).alias("v"))
        .select("customer_id", trajectory(F.col("n")).alias("trajectory"), concentration(F.col("c")).alias("categories"), novelty(F.col("v")).alias("novelty"))
    )


def customer_metrics(results: DataFrame) -> DataFrame:
    """Means over seeds of each (model, customer), of models and seeds that ran."""
    per_seed = results.filter("status = 'ok'").groupBy("model", "seed", "customer_id").agg(F.avg("nll").alias("nll"), F.avg(F.col("top1").cast("double")).alias("top1"))
    return per_seed.groupBy("model", "customer_id").agg(F.avg("nll").alias("nll"), F.avg("top1").alias("top1"), F.count("*").alias("n_seeds"))


def by_segment(metrics: DataFrame, customers: DataFrame, scheme: str) -> DataFrame:
    """Mean, sample deviation (0 for one customer) and top-1 of each (segment, model)."""
    return (
        metrics.join(customers.select("customer_id", F.col(scheme).alias("segment")), "customer_id")
        .groupBy("segment", "model")
        .agg(F.avg("nll").alias("nll_mean"), F.coalesce(F.stddev_samp("nll"), F.lit(0.0)).alias("nll_std"), F.avg("top1").alias("top1"), F.count("*").alias("n_customers"))
    )


def wins(segmented: DataFrame, model: str, most: int = 5) -> DataFrame:
    """The segments where a model's likelihood beats the best other by most."""
    mine = segmented.filter(F.col("model") == model).select("segment", F.col("nll_mean").alias("own"))
    rest = segmented.filter(F.col("model") != model).groupBy("segment").agg(F.min("nll_mean").alias("best_other"))
    return mine.join(rest, "segment").withColumn("gain", F.col("best_other") - F.col("own")).orderBy(F.desc("gain"), "segment").limit(most)


def uplift(leaderboard: DataFrame, reference: str = "popularity") -> DataFrame:
    """Likelihood gained over the reference row; without that row nothing is known."""
    base = leaderboard.filter(F.col("model") == reference).agg(F.first("nll").alias("base"))
    return leaderboard.crossJoin(F.broadcast(base)).withColumn("uplift", F.col("base") - F.col("nll")).drop("base")


def paired(results: DataFrame, a: str) -> DataFrame:
    """Rows (model, seed, event_idx) with the values of model ``a`` beside. Seeds where a didn't run go; then models
    that lack a kept seed."""
    ok = results.filter("status = 'ok'")
    own = ok.filter(F.col("model") == a).select("seed", "event_idx", F.col("nll").alias("nll_a"), F.col("top1").alias("top1_a"))
    seeds = own.agg(F.countDistinct("seed").alias("kept"))
    rows = ok.filter(F.col("model") != a).join(own, ["seed", "event_idx"])
    full = rows.groupBy("model").agg(F.countDistinct("seed").alias("n")).crossJoin(F.broadcast(seeds)).filter("n = kept").select("model")
    return rows.join(full, "model", "left_semi")


def mcnemar(pairs: DataFrame) -> DataFrame:
    """The 2x2 table of each model and the statistic with continuity correction, none without disagreement."""
    both = lambda x, y: F.count_if((F.col("top1_a") == x) & (F.col("top1") == y))
    t = pairs.groupBy("model").agg(both(False, False).alias("b00"), both(False, True).alias("b01"), both(True, False).alias("b10"), both(True, True).alias("b11"))
    off = F.col("b01") + F.col("b10")
    x = F.when(off > 0, F.pow(F.abs(F.col("b01") - F.col("b10")) - 1, F.lit(2)) / off)
    return t.withColumn("statistic", x)


def chi2_p(statistic: float) -> float:
    return math.erfc(math.sqrt(statistic / 2))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """The signed-rank statistic of each model: the lesser sum of the ranks of nonzero differences, ties averaged.

    Sizes are ranked by running counts along ranges of sizes, so neither a model's rows nor its sizes meet in one task.
    """
    d = pairs.select("model", (F.col("nll") - F.col("nll_a")).alias("d")).filter("d <> 0")
    sizes = d.groupBy("model", F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    r = running(sizes, ["size"], "n", "model").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    plus = F.sum(F.col("plus") * F.col("rank"))
    every = F.sum(F.col("n") * F.col("rank"))
    ties = F.sum(F.pow("n", F.lit(3)) - F.col("n"))
    return r.groupBy("model").agg(F.least(plus, every - plus).alias("statistic"), F.sum("n").alias("n"), ties.alias("tie_term"))


def wilcoxon_p(statistic: float, n: int, tie_term: float = 0.0) -> float:
    """Two-sided normal approximation with the tie correction."""
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
    return 1.0 if spread == 0 else math.erfc(abs(statistic - n * (n + 1) / 4) / spread / math.sqrt(2))


#: P(at most i) of a Poisson variable of mean 1; what lies beyond the last has no double of its own.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def multiplicities(keys: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """(iterations, rows): Poisson(1) numbers fixed by seed, row key and iteration."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[None, :] + (np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None] * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def bootstrap(pairs: DataFrame, iterations: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Paired bootstrap of the mean difference of each model.

    Every row has its own Poisson(1) multiplicities for all iterations, which needs no row to know the others: the
    iterations' sums are aggregates over rows, however many there are. Rows of one difference draw together: the sum of n
    such numbers is a Poisson(n). Draws of a batch of lone rows are made at once.
    """

    def sums(batches):
        import pandas as pd

        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                got = total.setdefault(model, np.zeros((2, iterations)))
                lone = part[part["n"] == 1]
                d, keys = lone["d"].to_numpy(), lone["key"].to_numpy()
                for a in range(0, len(d), 2048):
                    times = multiplicities(keys[a : a + 2048], iterations, seed)
                    got += times @ d[a : a + 2048], times.sum(1)
                for d, n, key in part.loc[part["n"] > 1, ["d", "n", "key"]].itertuples(index=False):
                    times = np.random.default_rng([seed, int(key) % (1 << 64)]).poisson(n, iterations)
                    got += times * d, times
        yield pd.DataFrame([(m, i, t[0, i], t[1, i]) for m, t in total.items() for i in range(iterations)], columns=["model", "i", "s", "n"])

    rows = pairs.groupBy("model", (F.col("nll") - F.col("nll_a")).alias("d")).agg(F.count("*").alias("n"), F.min(F.xxhash64("seed", "event_idx")).alias("key"))
    drawn = rows.mapInPandas(sums, "model string, i int, s double, n double").groupBy("model", "i").agg((F.sum("s") / F.sum("n")).alias("delta"))
    tail = (1 - level) / 2
    q = F.percentile("delta", F.array(F.lit(tail), F.lit(1 - tail)))  # over one row an iteration
    return drawn.groupBy("model").agg(F.avg("delta").alias("delta_mean"), q[0].alias("delta_lo"), q[1].alias("delta_hi"), F.avg((F.col("delta") > 0).cast("double")).alias("p_above_zero"))


def shown_p(p: float | None) -> str:
    """A p-value for a report: those below a millionth as such, small ones in scientific form."""
    return "n/a" if p is None else "<1e-6" if p < 1e-6 else f"{p:.2e}" if p < 1e-2 else f"{p:.3f}"


def shown(x: float | None, signed: bool = False) -> str:
    return "n/a" if x is None else f"{x:+.3f}" if signed else f"{x:.3f}"


ASO_NOTE = "ASO skipped: it needs a package that this engine doesn't use"


def aso() -> dict:
    """Almost stochastic order isn't computed; reports say so."""
    return {"aso_epsilon_min": None, "aso_note": ASO_NOTE}


def pair_tests(pairs: DataFrame) -> DataFrame:
    """(model, n, wilcoxon_p, mcnemar_p); the sums are Spark's, the last step takes one row a model."""
    ranks = {r["model"]: r for r in wilcoxon(pairs).collect()}
    rows = []
    for r in mcnemar(pairs).collect():
        w = ranks.get(r["model"])
        rows.append((r["model"], r["b00"] + r["b01"] + r["b10"] + r["b11"], wilcoxon_p(w["statistic"], w["n"], w["tie_term"]) if w else 1.0, 1.0 if r["statistic"] is None else chi2_p(r["statistic"])))
    return pairs.sparkSession.createDataFrame(rows, "model string, n long, wilcoxon_p double, mcnemar_p double")


def significance(results: DataFrame, a: str, iterations: int = 1000, level: float = 0.95, seed: int = 0) -> dict:
    """What a report says about every model against ``a``, the greatest difference first."""
    pairs = stored(paired(results, a).select("model", "seed", "event_idx", "nll", "top1", "nll_a", "top1_a"), "pairs")
    tests = {r["model"]: r for r in pair_tests(pairs).collect()}
    made = {
        r["model"]: {
            "delta_mean": r["delta_mean"], "delta_ci_lo": r["delta_lo"], "delta_ci_hi": r["delta_hi"], "p_delta_gt_zero": r["p_above_zero"],
            "wilcoxon_p_value": tests[r["model"]]["wilcoxon_p"], "mcnemar_p_value": tests[r["model"]]["mcnemar_p"], **aso(),
        }
        for r in bootstrap(pairs, iterations, level, seed).collect()
    }
    own = results.filter((F.col("status") == "ok") & (F.col("model") == a)).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("seed")).alias("seeds")).first()
    order = sorted(made, key=lambda m: (-made[m]["delta_mean"], m))
    return {"baseline_of_interest": a, "n_events": own["n"], "n_seeds": len(own["seeds"]), "seeds_used": own["seeds"], "bootstrap_iterations": iterations, "confidence_level": level, "pairs": {m: made[m] for m in order}}


def significance_text(report: dict) -> str:
    """The report as a Markdown table."""
    a = report["baseline_of_interest"]
    lines = [f"# Paired comparison with {a}", "", *(f"{k} = {report[k]}" for k in ("n_events", "n_seeds", "bootstrap_iterations")), "", ASO_NOTE, ""]
    lines += [f"| Model | NLL less {a}'s | {report['confidence_level']:.0%} interval | P(above 0) | Wilcoxon p | McNemar p |", "|---|---|---|---|---|---|"]
    for m, x in report["pairs"].items():
        interval = f"[{shown(x['delta_ci_lo'], True)}, {shown(x['delta_ci_hi'], True)}]"
        lines.append(f"| {m} | {shown(x['delta_mean'], True)} | {interval} | {shown(x['p_delta_gt_zero'])} | {shown_p(x['wilcoxon_p_value'])} | {shown_p(x['mcnemar_p_value'])} |")
    return "\n".join(lines) + "\n"


SCHEMES = ("trajectory", "categories", "novelty")


def segmentation(results: DataFrame, a: str, least: int = 10) -> dict:
    """Per scheme each segment's models, best likelihood first, with ``small`` where fewer than ``least`` customers are in
    it, and the segments that ``a`` wins."""
    customers = segments(results.filter(F.col("model") == a))
    per = customer_metrics(results)
    out: dict = {"baseline_of_interest": a, "schemes": {}}
    for scheme in SCHEMES:
        rows = by_segment(per, customers, scheme)
        groups: dict[str, dict] = {}
        for r in rows.orderBy("segment", "nll_mean", "model").collect():
            g = groups.setdefault(r["segment"], {"n_customers": 0, "models": []})
            g["models"].append({k: r[k] for k in ("model", "nll_mean", "nll_std", "top1", "n_customers")})
            g["n_customers"] = max(g["n_customers"], r["n_customers"])
        for g in groups.values():
            g["small"] = g["n_customers"] < least
        out["schemes"][scheme] = {"segments": groups, "wins": [{k: r[k] for k in ("segment", "own", "best_other", "gain")} for r in wins(rows, a).collect() if r["gain"] > 0]}
    return out


def segmentation_text(report: dict, scheme: str) -> str:
    """One scheme as a Markdown table; small segments are marked."""
    lines = [f"# Customers by {scheme}", "", "| Segment | Customers | Model | NLL | Deviation | Top-1 |", "|---|---|---|---|---|---|"]
    for name, g in report["schemes"][scheme]["segments"].items():
        mark = " (small)" if g["small"] else ""
        lines += [f"| {name}{mark} | {g['n_customers']} | {m['model']} | {shown(m['nll_mean'])} | {shown(m['nll_std'])} | {shown(m['top1'])} |" for m in g["models"]]
    return "\n".join(lines) + "\n"


def save_segmentation(report: dict, folder: str) -> None:
    """A JSON and a Markdown file for each scheme, and a summary of the segments won."""
    at = Artefacts(SparkSession.getActiveSession(), folder)
    for scheme, part in report["schemes"].items():
        at.json(f"by_{scheme}.json", part)
        at.text(f"by_{scheme}.md", segmentation_text(report, scheme))
    at.json("summary.json", {s: part["wins"] for s, part in report["schemes"].items()})


def save_significance(report: dict, folder: str) -> None:
    at, name = Artefacts(SparkSession.getActiveSession(), folder), f"pairwise_vs_{report['baseline_of_interest']}"
    at.json(f"{name}.json", report)
    at.text(f"{name}.md", significance_text(report))
