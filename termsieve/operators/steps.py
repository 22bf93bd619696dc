"""One synchronous update of a population per search method.

A step reads (population, fitness arrays) and adds the trial genes `ys`; some keep a state
column. All candidates of a dimension lie in one row, so a step is a projection over the
population joined with one fitness row per run and fold. Random numbers are keyed by
(seed of the run, generation, candidate[, dimension], purpose).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import bounded, normal, uniform
from .population import run_seed


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def candidates(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size - 1))


def by_fitness() -> Column:
    """Candidates from best to worst; the smaller id first on ties."""
    pairs = F.transform("fits", lambda f, i: F.struct(F.round(f, 9).alias("f"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def _leaders(fitness: DataFrame) -> DataFrame:
    return fitness.withColumn("order", by_fitness())


def _join(pop: DataFrame, info: DataFrame) -> DataFrame:
    return pop.join(bounded(info), ["run", "fold"])


def _finish(moved: DataFrame, pop: DataFrame, *state: str) -> DataFrame:
    return moved.select(*[c for c in pop.columns if c not in (*state, "ys")], *state, "ys")


def _draw(seed: int, gen: int, cid, *what) -> Column:
    return uniform(run_seed(seed), gen, cid, *what)


def _pick(u: Column, n: int) -> Column:
    return F.floor(u * n).cast("int")


DIM = "dim"


def step_ga(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int,
            tournament: int = 4, crossover: float = 0.25, mutation: float = 0.25) -> DataFrame:
    """Tournament parents, uniform crossover, uniform mutation; the best candidate stays."""
    place = F.transform(candidates(size), lambda c: F.array_position("order", c))

    def parent(tag: str) -> Column:
        return F.transform(candidates(size), lambda c: F.array_min(F.array(*[
            F.struct(F.col("_place")[_pick(_draw(seed, gen, c, f"{tag}{t}"), size)].alias("p"),
                     _pick(_draw(seed, gen, c, f"{tag}{t}"), size).alias("i"))
            for t in range(tournament)]))["i"])

    info = _leaders(fitness).withColumn("_place", place).select(
        "run", "fold", F.col("order")[0].alias("_best"), parent("a").alias("_a"), parent("b").alias("_b"))

    def gene(x: Column, c: Column) -> Column:
        d = F.col(DIM)
        mixed = F.when(_draw(seed, gen, c, d, "c") < crossover, F.col("xs")[F.col("_b")[c]]) \
            .otherwise(F.col("xs")[F.col("_a")[c]])
        child = F.when(_draw(seed, gen, c, d, "m") < mutation, _draw(seed, gen, c, d, "v")).otherwise(mixed)
        return F.when(c == F.col("_best"), x).otherwise(child)

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


def step_gwo(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, n_gens: int = 40) -> DataFrame:
    """Mean pull of the three best: L - A * |C * L - x|."""
    a = 2.0 - 2.0 * gen / n_gens
    info = _leaders(fitness).select("run", "fold", F.slice("order", 1, 3).alias("_lead"))

    def gene(x: Column, c: Column) -> Column:
        pulls = []
        for k in range(min(3, size)):
            lead = F.col("xs")[F.col("_lead")[k]]
            big_a = 2.0 * a * _draw(seed, gen, c, F.col(DIM), f"a{k}") - a
            big_c = 2.0 * _draw(seed, gen, c, F.col(DIM), f"c{k}")
            pulls.append(lead - big_a * F.abs(big_c * lead - x))
        return clip(sum(pulls[1:], pulls[0]) / float(len(pulls)))

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


def step_sca(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, n_gens: int = 40,
             a: float = 3.0) -> DataFrame:
    """x + r1 * (sin or cos)(r2) * |r3 * best - x|."""
    r1 = a - gen * a / n_gens
    info = _leaders(fitness).select("run", "fold", F.col("order")[0].alias("_best"))

    def gene(x: Column, c: Column) -> Column:
        d = F.col(DIM)
        r2 = 2.0 * F.pi() * _draw(seed, gen, c, d, "r2")
        wave = F.when(_draw(seed, gen, c, d, "r4") < 0.5, F.sin(r2)).otherwise(F.cos(r2))
        return clip(x + r1 * wave * F.abs(2.0 * _draw(seed, gen, c, d, "r3") * F.col("xs")[F.col("_best")] - x))

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


def _neighbour(source: Column, seed: int, gen: int, c: Column, size: int, tag: str) -> Column:
    """Another candidate than `source`."""
    return ((source + 1 + _pick(_draw(seed, gen, c, tag), size - 1)) % size).cast("int")


def step_abc(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, n_genes: int,
             phase: str = "employed") -> DataFrame:
    """Bee colony: each candidate changes one gene against a neighbour.

    employed: from its own position. onlooker: from a source drawn by quality 1 / (1 + fitness);
    `source` then tells whose position a trial replaces.
    """
    t = phase[0]
    own = candidates(size)
    if phase == "employed":
        source = own
        info = _leaders(fitness)
    else:
        # An empty feature set (infinite fitness) has quality 0.
        quality = F.transform("fits", lambda f: F.lit(1.0) / (F.lit(1.0) + f))
        cumulative = F.transform("_q", lambda q, i: F.aggregate(F.slice("_q", F.lit(1), i + 1), F.lit(0.0), lambda s, v: s + v))
        info = _leaders(fitness).withColumn("_q", quality).withColumn("_cum", cumulative)
        source = F.transform(own, lambda c: F.size(F.filter(
            "_cum", lambda q: q < _draw(seed, gen, c, t + "s") * F.col("_cum")[size - 1])))
    info = info.withColumn("source", source).select(
        "run", "fold", "source",
        F.transform("source", lambda s, c: _neighbour(s, seed, gen, c, size, t + "k")).alias("_k"),
        F.transform(own, lambda c: _pick(_draw(seed, gen, c, t + "j"), n_genes)).alias("_j"),
        F.transform(own, lambda c: 2.0 * _draw(seed, gen, c, t + "phi") - 1.0).alias("_phi"))

    def gene(s: Column, c: Column) -> Column:
        x = F.col("xs")[s]
        moved = clip(x + F.col("_phi")[c] * (x - F.col("xs")[F.col("_k")[c]]))
        return F.when(F.col("_j")[c] == F.col(DIM), moved).otherwise(x)

    moved = _join(pop, info).withColumn("ys", F.transform("source", gene))
    return _finish(moved, pop, "source") if phase == "onlooker" else _finish(moved, pop)


def scouts(pop: DataFrame, tired: DataFrame, gen: int, seed: int) -> DataFrame:
    """Fresh genes for candidates marked in `tired` (run, fold, lost: array of booleans)."""
    fresh = F.transform("xs", lambda x, c: F.when(
        F.col("lost")[c], _draw(seed, gen, c, F.col(DIM), "new")).otherwise(x))
    return _join(pop, tired).withColumn("xs", fresh).select(*pop.columns)


def step_bat(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int,
             f_min: float = 0.0, f_max: float = 2.0, pulse: float = 0.5, walk: float = 0.001) -> DataFrame:
    """Frequency-scaled velocity `vs` relative to the best; some bats walk around the best."""
    pop = pop if "vs" in pop.columns else pop.withColumn("vs", F.transform("xs", lambda x: x * 0.0))
    info = _leaders(fitness).select(
        "run", "fold", F.col("order")[0].alias("_best"),
        F.transform(candidates(size), lambda c: f_min + (f_max - f_min) * _draw(seed, gen, c, "q")).alias("_f"),
        F.transform(candidates(size), lambda c: _draw(seed, gen, c, "r") > pulse).alias("_walk"))
    best = F.col("xs")[F.col("_best")]
    moved = _join(pop, info).withColumn(
        "vs", F.transform("xs", lambda x, c: F.col("vs")[c] + (x - best) * F.col("_f")[c]))
    trial = F.transform("xs", lambda x, c: F.when(
        F.col("_walk")[c], clip(best + walk * normal(run_seed(seed), gen, c, F.col(DIM))))
        .otherwise(clip(x + F.col("vs")[c])))
    return _finish(moved.withColumn("ys", trial), pop, "vs")


def levy_scale(beta: float = 1.5) -> float:
    """Scale of the numerator of a Levy step (Mantegna)."""
    top = math.gamma(1 + beta) * math.sin(math.pi * beta / 2)
    return (top / (math.gamma((1 + beta) / 2) * beta * 2 ** ((beta - 1) / 2))) ** (1 / beta)


def step_cuckoo(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int,
                alpha: float = 0.01, beta: float = 1.5, abandon: float = 0.2) -> DataFrame:
    """Levy flights relative to the best; the worst nests are built anew."""
    worst = int(abandon * size)
    info = _leaders(fitness).select(
        "run", "fold", F.col("order")[0].alias("_best"),
        F.slice("order", F.lit(size - worst + 1), F.lit(worst)).alias("_worst"))
    best = F.col("xs")[F.col("_best")]

    def gene(x: Column, c: Column) -> Column:
        d = F.col(DIM)
        top = levy_scale(beta) * normal(run_seed(seed), gen, c, d, "u")
        step = top / F.pow(F.abs(normal(run_seed(seed), gen, c, d, "v")), F.lit(1.0 / beta))
        return F.when(F.array_contains("_worst", c), _draw(seed, gen, c, d, "new")) \
            .otherwise(clip(x + alpha * step * (x - best)))

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


def step_de(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, n_genes: int,
            scale: float = 0.5, crossover: float = 0.8) -> DataFrame:
    """rand/1/bin: a + F * (b - c) under the crossover mask; a, b, c and x differ."""
    # Three distinct offsets 1..size-1: each draw skips the ones taken before.
    def offsets(c: Column) -> Column:
        one = _pick(_draw(seed, gen, c, "a"), size - 1) + 1
        two = _pick(_draw(seed, gen, c, "b"), size - 2) + 1
        two = two + F.when(two >= one, 1).otherwise(0)
        low, high = F.least(one, two), F.greatest(one, two)
        three = _pick(_draw(seed, gen, c, "c"), size - 3) + 1
        three = three + F.when(three >= low, 1).otherwise(0)
        three = three + F.when(three >= high, 1).otherwise(0)
        return F.array(*[((c + o) % size).cast("int") for o in (one, two, three)])

    info = fitness.select(
        "run", "fold", F.transform(candidates(size), offsets).alias("_o"),
        F.transform(candidates(size), lambda c: _pick(_draw(seed, gen, c, "j"), n_genes)).alias("_j"))

    def gene(x: Column, c: Column) -> Column:
        a, b, k = (F.col("xs")[F.col("_o")[c][i]] for i in range(3))
        cross = (_draw(seed, gen, c, F.col(DIM), "cr") < crossover) | (F.col("_j")[c] == F.col(DIM))
        return F.when(cross, clip(a + scale * (b - k))).otherwise(x)

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


def step_harmony(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int,
                 memory: float = 0.7, pitch: float = 0.35, width: float = 0.1) -> DataFrame:
    """New harmonies: each gene from memory (sometimes adjusted) or fresh."""
    def gene(x: Column, c: Column) -> Column:
        d = F.col(DIM)
        drawn = F.col("xs")[_pick(_draw(seed, gen, c, d, "i"), size)]
        tuned = F.when(_draw(seed, gen, c, d, "p") < pitch,
                       clip(drawn + width * (2.0 * _draw(seed, gen, c, d, "w") - 1.0))).otherwise(drawn)
        return F.when(_draw(seed, gen, c, d, "h") < memory, tuned).otherwise(_draw(seed, gen, c, d, "new"))

    return _finish(pop.withColumn("ys", F.transform("xs", gene)), pop)


def step_pso(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, inertia: float = 0.7,
             own: float = 2.0, swarm: float = 2.0, v_max: float = 1.5) -> DataFrame:
    """w * v + c1 * r1 * (pbest - x) + c2 * r2 * (gbest - x); state `vs`, personal bests `ps`.

    `fitness` is that of the personal bests.
    """
    pop = pop if "vs" in pop.columns else pop.withColumn("vs", F.transform("xs", lambda x: x * 0.0)).withColumn("ps", F.col("xs"))
    info = _leaders(fitness).select("run", "fold", F.col("order")[0].alias("_best"))
    best = F.col("ps")[F.col("_best")]

    def velocity(x: Column, c: Column) -> Column:
        d = F.col(DIM)
        v = inertia * F.col("vs")[c] + own * _draw(seed, gen, c, d, "r1") * (F.col("ps")[c] - x) \
            + swarm * _draw(seed, gen, c, d, "r2") * (best - x)
        return F.least(F.greatest(v, F.lit(-v_max)), F.lit(v_max))

    moved = _join(pop, info).withColumn("vs", F.transform("xs", velocity)) \
        .withColumn("ys", F.transform("xs", lambda x, c: clip(x + F.col("vs")[c])))
    return _finish(moved, pop, "vs", "ps")


def distances(pop: DataFrame) -> DataFrame:
    """(run, fold, r2): matrix of squared candidate distances, one row per run and fold.

    Each task multiplies the gene blocks it holds and returns one candidate-by-candidate
    matrix per run and fold, however many dimensions it has read.
    """
    def products(batches):
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["run", "fold"])["xs"]:
                x = np.stack(part.to_numpy())
                sums[key] = sums.get(key, 0.0) + x.T @ x
        for (run, fold), gram in sums.items():
            yield pd.DataFrame({"run": run, "fold": fold, "i": np.arange(len(gram)), "g": list(gram)})

    blocks = pop.select("run", "fold", "xs").mapInPandas(products, "run int, fold int, i int, g array<double>")
    cells = blocks.select("run", "fold", "i", F.posexplode("g").alias("j", "g")) \
        .groupBy("run", "fold", "i", "j").agg(F.sum("g").alias("g"))
    rows = cells.groupBy("run", "fold", "i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "g"))), lambda s: s["g"]).alias("g"))
    gram = rows.groupBy("run", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("_g"))
    square = F.transform("_g", lambda row, i: F.transform(
        row, lambda g, j: F.greatest(F.col("_g")[i][i] + F.col("_g")[j][j] - 2.0 * g, F.lit(0.0))))
    return gram.select("run", "fold", square.alias("r2"))


def step_firefly(pop: DataFrame, fitness: DataFrame, size: int, gen: int, seed: int, alpha: float = 0.5,
                 beta_min: float = 0.2, beta_0: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """Move toward every brighter candidate by attraction that fades with distance, plus noise."""
    place = F.transform(candidates(size), lambda c: F.array_position("order", c))
    pull = F.transform(candidates(size), lambda i: F.transform(candidates(size), lambda j: F.when(
        F.col("_place")[j] < F.col("_place")[i],
        beta_min + (beta_0 - beta_min) * F.exp(-gamma * F.col("r2")[i][j])).otherwise(0.0)))
    info = _leaders(fitness).withColumn("_place", place).join(bounded(distances(pop)), ["run", "fold"]) \
        .select("run", "fold", pull.alias("_b"))

    def gene(x: Column, c: Column) -> Column:
        toward = F.aggregate(F.zip_with(F.col("_b")[c], F.col("xs"), lambda b, y: b * (y - x)),
                             F.lit(0.0), lambda s, v: s + v)
        return clip(x + toward + alpha * (_draw(seed, gen, c, F.col(DIM), "e") - 0.5))

    return _finish(_join(pop, info).withColumn("ys", F.transform("xs", gene)), pop)


# ---------------------------------------------------------------- acceptance

def accept_better(pop: DataFrame, fitness: DataFrame, trial_fitness: DataFrame,
                  allowed: Column | None = None, forced: Column | None = None,
                  ties: bool = True) -> tuple[DataFrame, DataFrame]:
    """Keep each candidate's trial if it is no worse (strictly better with ties=False).

    `allowed` and `forced` are boolean arrays over (run, fold) rows: trials that may win,
    and trials that win whatever their fitness.
    """
    both = fitness.join(trial_fitness.withColumnRenamed("fits", "_t"), ["run", "fold"])
    won = F.zip_with("_t", "fits", lambda t, f: (F.round(t, 9) <= F.round(f, 9)) if ties else (F.round(t, 9) < F.round(f, 9)))
    both = both.withColumn("_won", won)
    if allowed is not None:
        both = both.withColumn("_won", F.zip_with("_won", allowed, lambda w, a: w & a))
    if forced is not None:
        both = both.withColumn("_won", F.zip_with("_won", forced, lambda w, a: w | a))
    taken = F.transform("xs", lambda x, c: F.when(F.col("_won")[c], F.col("ys")[c]).otherwise(x))
    kept = _join(pop, both.select("run", "fold", "_won")).withColumn("xs", taken)
    fits = both.select("run", "fold", F.transform("fits", lambda f, c: F.when(
        F.col("_won")[c], F.col("_t")[c]).otherwise(f)).alias("fits"))
    return kept.select(*[c for c in pop.columns if c != "ys"]), fits


def loud_bats(seed: int, gen: int, size: int, loudness: float = 0.5) -> Column:
    """Bats loud enough to take a better place."""
    return F.transform(candidates(size), lambda c: _draw(seed, gen, c, "A") < loudness)


def abandoned_nests(size: int, abandon: float = 0.2) -> Column:
    """The worst nests, which take their new place whatever it is worth."""
    worst = int(abandon * size)
    return F.transform(candidates(size), lambda c: F.array_contains(
        F.slice(by_fitness(), size - worst + 1, worst), c))


def accept_onlookers(pop: DataFrame, fitness: DataFrame, trial_fitness: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Each food source takes the best trial of its onlookers if that is no worse."""
    sources = pop.where(F.col("term").isNull()).select("run", "fold", "source")
    both = fitness.join(trial_fitness.withColumnRenamed("fits", "_t"), ["run", "fold"]).join(bounded(sources), ["run", "fold"])
    trials = F.transform("_t", lambda t, c: F.struct(F.round(t, 9).alias("f"), c.alias("c"), F.col("source")[c].alias("s")))
    best = F.transform("fits", lambda f, s: F.array_min(F.filter(
        "_x", lambda x: (x["s"] == s) & (x["f"] <= F.round(f, 9))))["c"])
    both = both.withColumn("_x", trials).withColumn("_win", best)
    taken = F.transform("xs", lambda x, s: F.coalesce(F.col("ys")[F.col("_win")[s]], x))
    kept = _join(pop, both.select("run", "fold", "_win")).withColumn("xs", taken)
    fits = both.select("run", "fold", F.transform("fits", lambda f, s: F.coalesce(
        F.col("_t")[F.col("_win")[s]], f)).alias("fits"))
    return kept.select(*[c for c in pop.columns if c not in ("ys", "source")]), fits


def accept_all(pop: DataFrame) -> DataFrame:
    return pop.withColumn("xs", F.col("ys")).drop("ys")


def replace_worst(pop: DataFrame, fitness: DataFrame, trial_fitness: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The best `size` of memory and trials together."""
    both = fitness.join(trial_fitness.withColumnRenamed("fits", "_t"), ["run", "fold"]) \
        .select("run", "fold", F.concat("fits", "_t").alias("fits"))
    both = both.withColumn("_keep", F.slice(by_fitness(), 1, size))
    joined = _join(pop, both.select("run", "fold", "_keep"))
    kept = joined.withColumn("_all", F.concat("xs", "ys")) \
        .withColumn("xs", F.transform("_keep", lambda i: F.col("_all")[i]))
    fits = both.select("run", "fold", F.transform("_keep", lambda i: F.col("fits")[i]).alias("fits"))
    return kept.select(*[c for c in pop.columns if c != "ys"]), fits
