"""Bayesian knowledge tracing: expectation-maximisation for each skill and forward prediction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.operators import ranks
from mentora.sources.files import stored

DEFAULTS = {"prior": 0.5, "learns": 0.1, "guesses": 0.2, "slips": 0.1}
#: Expected counts of a sequence: first step known, transitions from unknown, steps by state, and the log-likelihood.
SUMS = ("n", "first", "stayed", "learned", "known", "slipped", "unknown", "guessed", "ll")
CELLS = 100_000
#: Labels of all distinct sequences of a skill that one task fits.
TASK_CELLS = 2_000_000


def forward(labels: Column, prior: Column, learn: Column, guess: Column, slip: Column, margin: float = 0.0) -> Column:
    """Probability of a correct answer before each label of an ordered array, from the labels before it.

    A label that has no probability under the parameters leaves the state as it is. After each label the state is kept
    ``margin`` away from 0 and 1."""

    def step(state: Column, y: Column) -> Column:
        p = state["p"]
        expected = p * (1 - slip) + (1 - p) * guess
        share = lambda known, other: F.when(known + other > 1e-12, F.try_divide(known, known + other)).otherwise(p)
        after = F.when(y == 1, share(p * (1 - slip), (1 - p) * guess)).otherwise(share(p * slip, (1 - p) * (1 - guess)))
        moved = after + (1 - after) * learn
        if margin:
            moved = F.least(F.greatest(moved, F.lit(margin)), F.lit(1 - margin))
        return F.struct(moved.alias("p"), F.concat(state["out"], F.array(expected)).alias("out"))

    start = F.struct(prior.cast("double").alias("p"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(labels, start, step, lambda s: s["out"])


def predict(obs: DataFrame, parameters: DataFrame | None = None, fallback: DataFrame | None = None, by: tuple[str, ...] = (), margin: float = 0.0) -> DataFrame:
    """(*by, d, turn, pos, kc, correct, p). A skill without parameters, or with some missing, takes the one row of
    ``fallback`` (of its ``by``) for these, else the defaults.

    Sequences are short arrays per dialogue and skill, so no group grows beyond one dialogue.
    """
    return _predicted(_sequences(obs, by), parameters, fallback, by, margin)


def _sequences(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, d, kc, seq): the rows of every skill of a dialogue in order."""
    return obs.groupBy(*by, "d", "kc").agg(F.array_sort(F.collect_list(F.struct("turn", "pos", "correct"))).alias("seq"))


def _predicted(rows: DataFrame, parameters: DataFrame | None, fallback: DataFrame | None, by: tuple[str, ...], margin: float) -> DataFrame:
    """``predict`` of rows of ``_sequences``."""
    if parameters is not None:
        rows = rows.join(parameters, [*by, "kc"], "left")
    if fallback is not None:
        # One row, or one for each value of ``by``.
        other = fallback.select(*by, *[F.col(x).alias(f"other_{x}") for x in DEFAULTS])
        rows = rows.join(other, [*by], "left") if by else rows.crossJoin(F.broadcast(other))
    known = lambda name: F.nanvl(F.col(name), F.lit(None).cast("double"))
    value = lambda name: F.coalesce(*[known(name)] * (parameters is not None), *[known(f"other_{name}")] * (fallback is not None), F.lit(DEFAULTS[name]))
    p = forward(F.col("seq.correct"), *(value(x) for x in DEFAULTS), margin=margin)
    return rows.withColumn("p", p).select(*by, "d", "kc", F.explode(F.arrays_zip("seq", "p")).alias("x")).select(*by, "d", "x.seq.turn", "x.seq.pos", "kc", "x.seq.correct", "x.p")


def label_sequences(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, kc, d, seq, first): the labels of every skill of a dialogue in order, and where its first one stands."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", "correct"))), lambda x: x["correct"].cast("int"))
    return obs.where("kc is not null and correct is not null").groupBy(*by, "kc", "d").agg(ordered.alias("seq"), F.min(F.struct("turn", "pos")).alias("first"))


def _sequence_sums(y: np.ndarray, prior: np.ndarray, learn: np.ndarray, guess: np.ndarray, slip: np.ndarray) -> np.ndarray:
    """SUMS of each row of labels of one length, by the parameters of that row. Elementwise, so that no row depends on others."""
    n, length = y.shape
    unknown_emit = np.where(y == 1, guess[:, None], 1 - guess[:, None])
    known_emit = np.where(y == 1, 1 - slip[:, None], slip[:, None])
    alpha, scale = np.empty((2, n, length)), np.empty((n, length))
    unknown, known = (1 - prior) * unknown_emit[:, 0], prior * known_emit[:, 0]
    for t in range(length):
        if t:
            a, b = alpha[:, :, t - 1]
            unknown, known = a * (1 - learn) * unknown_emit[:, t], (a * learn + b) * known_emit[:, t]
        scale[:, t] = np.maximum(unknown + known, 1e-300)
        alpha[:, :, t] = unknown / scale[:, t], known / scale[:, t]
    out = np.zeros((n, len(SUMS)))
    out[:, SUMS.index("n")], out[:, SUMS.index("ll")] = 1, np.log(scale).sum(1)
    beta_unknown = beta_known = np.ones(n)
    for t in range(length - 1, -1, -1):
        if t < length - 1:
            to_unknown, to_known = unknown_emit[:, t + 1] * beta_unknown / scale[:, t + 1], known_emit[:, t + 1] * beta_known / scale[:, t + 1]
            out[:, SUMS.index("stayed")] += alpha[0, :, t] * (1 - learn) * to_unknown
            out[:, SUMS.index("learned")] += alpha[0, :, t] * learn * to_known
            beta_unknown, beta_known = (1 - learn) * to_unknown + learn * to_known, to_known
        unknown, known = alpha[0, :, t] * beta_unknown, alpha[1, :, t] * beta_known
        total = np.maximum(unknown + known, 1e-300)
        unknown, known, right = unknown / total, known / total, y[:, t] == 1
        out[:, SUMS.index("known")] += known
        out[:, SUMS.index("slipped")] += known * ~right
        out[:, SUMS.index("unknown")] += unknown
        out[:, SUMS.index("guessed")] += unknown * right
    out[:, SUMS.index("first")] = known
    return out


def _better(sums: dict[str, np.ndarray]) -> np.ndarray:
    """New parameters, one row for each row of ``sums``."""
    ratio = lambda a, b, top: np.clip(a / np.maximum(b, 1e-300), 0.001, top)
    return np.stack([ratio(sums["first"], sums["n"], 0.999), ratio(sums["learned"], sums["stayed"] + sums["learned"], 0.999), ratio(sums["guessed"], sums["unknown"], 0.49), ratio(sums["slipped"], sums["known"], 0.49)], -1)


def _starts(seed: int, restarts: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([(rng.uniform(0.05, 0.5), *rng.uniform(0.05, 0.4, 3)) for _ in range(restarts)])


def _fit_group(seqs: list, times: list, seed: int, restarts: int, iterations: int, tolerance: float) -> np.ndarray:
    """The parameters with the best likelihood over all starts, which go on together; sequences of one length are one matrix."""
    lengths = np.array([len(x) for x in seqs])
    order = sorted(range(len(seqs)), key=lambda i: (lengths[i], tuple(seqs[i])))
    blocks = []
    for length in np.unique(lengths).tolist():
        rows = [i for i in order if lengths[i] == length]
        for k in range(0, len(rows), max(1, CELLS // length)):
            part = rows[k : k + max(1, CELLS // length)]
            blocks.append((np.array([seqs[i] for i in part]), np.array([times[i] for i in part], float)))
    now, before = _starts(seed, restarts), np.full(restarts, -np.inf)
    running, best = np.arange(restarts), (-np.inf, 0, None)
    for k in range(iterations):
        sums = np.zeros((len(running), len(SUMS)))
        for y, n in blocks:
            each = _sequence_sums(np.tile(y, (len(running), 1)), *np.repeat(now[running], len(y), axis=0).T)
            sums += (each.reshape(len(running), len(y), -1) * n[:, None]).sum(1)
        new, ll = _better(dict(zip(SUMS, sums.T, strict=True))), sums[:, SUMS.index("ll")]
        done = (ll - before[running] < tolerance) | (k == iterations - 1)
        for i in np.flatnonzero(done).tolist():
            if (ll[i], -running[i]) > best[:2]:
                best = ll[i], -running[i], new[i]
        now[running], before[running] = new, ll
        running = running[~done]
        if not len(running):
            break
    return best[2]


def _partial_sums(batches: Iterator[pa.RecordBatch], state: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """(key, restart, SUMS) of the label sequences (key, seq, times) for the running restarts of ``state``."""
    for batch in batches:
        keys, seqs, times, out = batch.column("key").to_pylist(), batch.column("seq").to_pylist(), batch.column("times").to_pylist(), {}
        rows = sorted((len(seqs[i]), i, r, p) for i, key in enumerate(keys) for r, p in state.get(key, ()))
        while rows:
            length = rows[0][0]
            most = max(1, CELLS // length)
            part = rows[: next((k for k, x in enumerate(rows[:most]) if x[0] != length), most)]
            rows = rows[len(part) :]
            sums = _sequence_sums(np.array([seqs[i] for _, i, *_ in part]), *np.array([p for *_, p in part]).T)
            for (_, i, r, _), x in zip(part, sums * np.array([times[i] for _, i, *_ in part])[:, None], strict=True):
                out[keys[i], r] = out.get((keys[i], r), 0) + x
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([r for _, r in out], pa.int32()), *(pa.array([float(x[j]) for x in out.values()]) for j in range(len(SUMS)))], ["key", "restart", *SUMS])


def _fit_large(counted: DataFrame, seeds: dict[str, int], restarts: int, iterations: int, tolerance: float) -> dict[str, np.ndarray]:
    """Parameters of the keys of ``counted`` (key, seq, times), whose sequences are dealt out to many tasks; each iteration is
    one job over all of them. Sums are added as decimals, so their order doesn't matter."""
    spark = counted.sparkSession
    total = counted.agg(F.sum(F.size("seq"))).head()[0] or 0
    dealt = counted.repartition(1 + total // CELLS, "key", "seq").sortWithinPartitions("key", "seq").persist()
    running = {(key, r): (start, -np.inf) for key, seed in seeds.items() for r, start in enumerate(_starts(seed, restarts))}
    best: dict[str, tuple] = {}
    for k in range(iterations):
        if not running:
            break
        state: dict[str, list[tuple]] = {}
        for (key, r), (parameters, _) in running.items():
            state.setdefault(key, []).append((r, tuple(parameters)))
        held = spark.sparkContext.broadcast(state)
        parts = dealt.mapInArrow(lambda batches, held=held: _partial_sums(batches, held.value), f"key string, restart int, {', '.join(f'{x} double' for x in SUMS)}")
        for row in parts.groupBy("key", "restart").agg(*[F.sum(F.col(x).cast("decimal(28,12)")).cast("double").alias(x) for x in SUMS]).collect():
            own, new = (row["key"], row["restart"]), _better({x: np.float64(row[x]) for x in SUMS})
            if row["ll"] - running[own][1] < tolerance or k == iterations - 1:
                del running[own]
                best[own[0]] = max(best.get(own[0], (-np.inf, 0, ())), (row["ll"], -own[1], tuple(new)))
            else:
                running[own] = (new, row["ll"])
        held.destroy()
    dealt.unpersist()
    return {key: parameters for key, (_, _, parameters) in best.items()}


def _counted(seqs: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(*by, kc, seq, times) of distinct sequences, written once, and (*by, kc, cells, least, most) of every skill."""
    counted = stored(seqs.groupBy(*by, "kc", "seq").agg(F.count("*").alias("times")), "sequences")
    return counted, _sizes(counted, by)


def _sizes(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return counted.groupBy(*by, "kc").agg(F.sum(F.size("seq")).alias("cells"), F.min(F.array_min("seq")).alias("least"), F.max(F.array_max("seq")).alias("most"))


def fit(seqs: DataFrame, by: tuple[str, ...] = (), seed: int = 221, restarts: int = 5, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(*by, kc, prior, learns, guesses, slips) of every skill with both labels in ``seqs``, as of ``label_sequences``.

    ``by`` are further keys, such as a fold; all keys are fitted in the same jobs. Equal sequences are counted first. A
    skill's distinct sequences are short; up to TASK_CELLS labels of them are fitted in one task, all iterations at once,
    and the sequences of larger ones are dealt out, one job an iteration. A skill's starts come from ``seed`` and its place
    in order of first appearance among all skills of its ``by``. Null labels and skills are left out.
    """
    counted, _ = _counted(seqs, by)
    return _fit_counted(counted, ranks.order_of_groups(seqs, by, "kc", "d", "first"), by, seed, restarts, iterations, tolerance)


def _fit_counted(counted: DataFrame, places: DataFrame, by: tuple[str, ...], seed: int = 221, restarts: int = 5, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """``fit`` of distinct sequences (*by, kc, seq, times); ``places`` (*by, kc, place) is the order of first appearance."""
    spark, keys = counted.sparkSession, [*by, "kc"]
    mixed = stored(_sizes(counted, by).where("least < most").join(places, keys), "skills")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema if f.name in keys)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = _fit_group(frame["seq"].tolist(), frame["times"].tolist(), seed + int(frame["place"].iloc[0]), restarts, iterations, tolerance)
        return pd.DataFrame([[*key, *found]], columns=[*keys, *DEFAULTS])

    schema = f"{types}, {', '.join(f'{x} double' for x in DEFAULTS)}"
    small = counted.join(mixed.where(F.col("cells") <= TASK_CELLS).select(*keys, "place"), keys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(tasks, *keys).groupBy(*keys).applyInPandas(one, schema).select(*keys, *DEFAULTS)
    # Each of these has more than TASK_CELLS labels, so they are few.
    large = mixed.where(F.col("cells") > TASK_CELLS).withColumn("key", F.to_json(F.struct(*keys)))
    wide = large.select("key", "place", *keys).collect()
    if wide:
        rows = counted.join(large.select(*keys, "key"), keys).select("key", "seq", "times")
        found = _fit_large(rows, {r["key"]: seed + r["place"] for r in wide}, restarts, iterations, tolerance)
        out = out.unionByName(spark.createDataFrame([(*(r[k] for k in keys), *map(float, found[r["key"]])) for r in wide], out.schema))
    return stored(out, "parameters")


def _filtered_sums(labels: Column, p: Column) -> Column:
    """Forward-only sums of a label sequence under parameters ``p``: whether all labels had a probability, the state after
    the first and last label, and known and unknown steps with a right and a wrong answer."""
    prior, guess, slip = p["prior"], p["guesses"], p["slips"]

    def step(s: Column, y: Column) -> Column:
        right = y == 1
        known, unknown = s["p"] * F.when(right, 1 - slip).otherwise(slip), (1 - s["p"]) * F.when(right, guess).otherwise(1 - guess)
        g = F.try_divide(known, known + unknown)
        ok = s["ok"] & (known + unknown > 0)
        add = lambda name, value: (s[name] + F.coalesce(value, F.lit(0.0))).alias(name)
        none = F.lit(0.0)
        return F.struct((g + (1 - g) * p["learns"]).alias("p"), ok.alias("ok"), F.coalesce(s["first"], g).alias("first"), g.alias("last"), add("known1", F.when(right, g).otherwise(none)), add("known0", F.when(right, none).otherwise(g)), add("unknown1", F.when(right, 1 - g).otherwise(none)), add("unknown0", F.when(right, none).otherwise(1 - g)))

    null = F.lit(None).cast("double")
    start = F.struct(prior.alias("p"), F.lit(True).alias("ok"), null.alias("first"), null.alias("last"), *[F.lit(0.0).alias(x) for x in ("known1", "known0", "unknown1", "unknown0")])
    return F.aggregate(labels, start, step)


#: Sums of ``_filtered_sums`` over sequences, each times how often the sequence occurs.
FILTERED_SUMS = {
    "n": lambda s: F.lit(1.0), "first": lambda s: s["first"], "before_last": lambda s: s["unknown1"] + s["unknown0"] - (1 - s["last"]),
    "known1": lambda s: s["known1"], "known0": lambda s: s["known0"], "unknown1": lambda s: s["unknown1"], "unknown0": lambda s: s["unknown0"],
}


def _filtered_step(sums: Callable[[str], Column], p: Column, cap: Column) -> Column:
    """The next parameters; a share of nothing leaves its parameter as it is."""
    share = lambda a, b, old: F.when(b > 1e-12, F.try_divide(a, b)).otherwise(old)
    moved = sums("before_last") * p["learns"]
    learn = share(moved, moved + (sums("before_last") - moved), p["learns"])
    guess = F.least(share(sums("unknown1"), sums("unknown1") + sums("unknown0"), p["guesses"]), cap)
    slip = F.least(share(sums("known0"), sums("known1") + sums("known0"), p["slips"]), cap)
    return F.struct(share(sums("first"), sums("n"), p["prior"]).alias("prior"), learn.alias("learns"), guess.alias("guesses"), slip.alias("slips"))


def filtered_start(seed: int) -> dict[str, float]:
    """The one start of the filtered fit, the same for every skill."""
    rng = np.random.default_rng(seed)
    return {"prior": float(rng.uniform(0.1, 0.9)), "learns": float(rng.uniform(0.05, 0.4)), "guesses": min(float(rng.uniform(0.1, 0.4)), 0.5), "slips": min(float(rng.uniform(0.05, 0.3)), 0.5)}


def fit_filtered(seqs: DataFrame, by: tuple[str, ...] = (), grid: DataFrame | None = None, seed: int = 221, iterations: int = 30, cap: float = 0.5) -> DataFrame:
    """(*by, kc, prior, learns, guesses, slips) of every skill in ``seqs`` by expectations from the filtered state alone.

    No backward pass, one start, guesses and slips of at most ``cap``, a fixed number of iterations; at the end all are kept
    1e-6 from 0, and priors and learns from 1. A sequence with an impossible label counts for nothing in an iteration.
    ``grid`` (setting, iterations, cap) fits all its settings at once and adds ``setting`` to the keys. Null labels are left out.

    All of it are JVM expressions. The distinct sequences of a skill of up to TASK_CELLS labels are one array, on which all
    iterations run; larger skills take one job an iteration over all sequences.
    """
    return _filtered_counted(_counted(seqs, by)[0], by, grid, seed, iterations, cap)


def _filtered_counted(counted: DataFrame, by: tuple[str, ...], grid: DataFrame | None = None, seed: int = 221, iterations: int = 30, cap: float = 0.5) -> DataFrame:
    """``fit_filtered`` of distinct sequences (*by, kc, seq, times)."""
    spark, keys, skills = counted.sparkSession, [*by, "kc"], _sizes(counted, by)
    if grid is None:
        settings = spark.range(1).select(F.lit(iterations).alias("_iterations"), F.lit(float(cap)).alias("_cap"))
    else:
        settings, keys = grid.select("setting", F.col("iterations").alias("_iterations"), F.col("cap").cast("double").alias("_cap")), [*keys, "setting"]
    start = F.struct(*[F.lit(v).alias(k) for k, v in filtered_start(seed).items()])
    sized = counted.join(skills.select(*by, "kc", "cells"), [*by, "kc"])
    arrays = sized.where(F.col("cells") <= TASK_CELLS).groupBy(*by, "kc").agg(F.array_sort(F.collect_list(F.struct("seq", "times"))).alias("seqs"))
    # A grid is a list of settings, a few rows.
    small = arrays.crossJoin(F.broadcast(settings))

    def iterate(p: Column, _: Column) -> Column:
        each = F.transform("seqs", lambda x: F.struct(x["times"].alias("times"), _filtered_sums(x["seq"], p).alias("s")))
        zero = F.struct(*[F.lit(0.0).alias(x) for x in FILTERED_SUMS])
        total = F.aggregate(F.filter(each, lambda x: x["s"]["ok"]), zero, lambda a, x: F.struct(*[(a[k] + x["times"] * f(x["s"])).alias(k) for k, f in FILTERED_SUMS.items()]))
        # Bound once as the only element of an array, so that the sums aren't computed for every use.
        return F.get(F.transform(F.array(total), lambda t: _filtered_step(lambda k: t[k], p, F.col("_cap"))), F.lit(0))

    now = small.select(*keys, F.aggregate(F.sequence(F.lit(1), F.col("_iterations")), start, iterate).alias("p"))
    if skills.where(F.col("cells") > TASK_CELLS).head(1):
        wide = sized.where(F.col("cells") > TASK_CELLS).drop("cells")
        state = stored(wide.select(*by, "kc").distinct().crossJoin(F.broadcast(settings)).withColumn("p", start), "filtered")
        for k in range(state.agg(F.max("_iterations")).head()[0] or 0):
            each = wide.join(state.where(F.col("_iterations") > k), [*by, "kc"]).withColumn("s", _filtered_sums(F.col("seq"), F.col("p")))
            good = F.when(F.col("s")["ok"], F.col("times"))
            sums = each.groupBy(*keys).agg(*[F.coalesce(F.sum(good * f(F.col("s"))), F.lit(0.0)).alias(f"_{x}") for x, f in FILTERED_SUMS.items()])
            joined = state.join(sums, keys, "left")
            state = stored(joined.withColumn("p", F.when(F.col("_n").isNull(), F.col("p")).otherwise(_filtered_step(lambda x: F.col(f"_{x}"), F.col("p"), F.col("_cap")))).select(state.columns), "filtered")
        now = now.unionByName(state.select(*keys, "p"))
    inside = lambda x, top: F.least(F.greatest(F.col("p")[x], F.lit(1e-6)), F.lit(top))
    return stored(now.select(*keys, *[inside(x, 1 - 1e-6 if x in ("prior", "learns") else 0.5).alias(x) for x in DEFAULTS]), "parameters")


def weighted_fallback(parameters: DataFrame, counts: DataFrame, by: tuple[str, ...] = (), shared: tuple[str, ...] = ()) -> DataFrame:
    """Observation-weighted mean of each parameter, else the plain mean, else the default; NaN drops out.

    One row for each value of ``by``; ``counts`` has the columns ``shared`` of these, kc and n."""
    rows = parameters.join(counts, [*shared, "kc"], "left").withColumn("w", F.coalesce("n", F.lit(0)))
    out = []
    for name, default in DEFAULTS.items():
        value = F.nanvl(F.col(name), F.lit(None).cast("double"))
        weight = F.sum(F.when(value.isNotNull(), F.col("w")))
        out.append(F.coalesce(F.when(weight > 0, F.sum(value * F.col("w")) / weight), F.avg(value), F.lit(default)).alias(name))
    return rows.groupBy(*by).agg(*out)


def observation_counts(seqs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, kc, n) of ``label_sequences``."""
    return seqs.groupBy(*by, "kc").agg(F.sum(F.size("seq")).cast("long").alias("n"))


def fit_predict(train: DataFrame, test: DataFrame) -> DataFrame:
    """Predictions of ``test`` by parameters fitted on ``train``.

    Skills that are all right or all wrong in ``train``, or not in it, take the observation-weighted mean of the others.
    """
    seqs = label_sequences(train)
    parameters = fit(seqs)
    return predict(test, parameters, weighted_fallback(parameters, observation_counts(seqs)))


def cross_predictions(obs: DataFrame, slices: DataFrame, scored: str = "test", fitter: str = "filtered", grid: DataFrame | None = None, **options) -> DataFrame:
    """(fold, [setting,] d, turn, pos, kc, correct, p): for every fold of ``slices`` (d, fold, slice) the slice ``scored``, by
    parameters fitted on the fold's slice train. All folds, and all settings of a ``grid``, are fitted in the same jobs.

    ``fitter``: filtered (``fit_filtered``, its state kept 1e-6 from 0 and 1) or em (``fit``, no grid). Dialogues without
    slices take no part.
    """
    if fitter not in ("filtered", "em") or (fitter == "em" and grid is not None):
        raise ValueError(f"no fitter {fitter} with a grid" if grid is not None else f"unknown fitter {fitter}")
    by = ("fold", "setting") if grid is not None else ("fold",)
    # Observations are read once; every dialogue has the folds in which it is trained on, and in which it is scored.
    folds = lambda name: F.array_sort(F.collect_list(F.when(F.col("slice") == name, F.col("fold"))))
    rows = stored(_sequences(obs).join(slices.groupBy("d").agg(folds("train").alias("train"), folds(scored).alias("held")), "d"), "fold-sequences")
    known = F.filter("seq", lambda x: x["correct"].isNotNull())
    seqs = rows.where("kc is not null").select("kc", "d", "train", F.transform(known, lambda x: x["correct"].cast("int")).alias("seq"), F.transform(known, lambda x: F.struct(x["turn"].alias("turn"), x["pos"].alias("pos"))).alias("at")).where("size(seq) > 0")
    # Few rows: dialogues with the same labels of a skill and the same folds are one.
    alike = stored(seqs.groupBy("kc", "seq", "train").agg(F.count("*").alias("times"), F.min("d").alias("d")), "alike").withColumn("fold", F.explode("train"))
    counted = stored(alike.groupBy("fold", "kc", "seq").agg(F.sum("times").alias("times")), "sequences")
    if fitter == "em":
        first = seqs.select("kc", "d", F.get("at", F.lit(0)).alias("first")).join(alike.groupBy("fold", "kc").agg(F.min("d").alias("d")), ["kc", "d"])
        parameters = _fit_counted(counted, ranks.order_of_groups(first, ("fold",), "kc", "d", "first"), ("fold",), **options)
    else:
        parameters = _filtered_counted(counted, ("fold",), grid, **options)
    counts = counted.groupBy("fold", "kc").agg(F.sum(F.size("seq") * F.col("times")).cast("long").alias("n"))
    fallback = weighted_fallback(parameters, counts, by, ("fold",))
    # Dealt out by dialogue before predictions make many rows of one.
    held = rows.where("size(held) > 0").select("d", "kc", "seq", "held").repartition("d").select("d", "kc", "seq", F.explode("held").alias("fold"))
    if grid is not None:
        held = held.crossJoin(F.broadcast(grid.select("setting")))
    return _predicted(held, parameters, fallback, by, 0.0 if fitter == "em" else 1e-6)


def over_folds(scores: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, metric, mean, std, folds) of one row of metrics for each fold; the deviation is that of the folds themselves."""
    rows = scores.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select(*by, "x.*")
    return rows.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("folds"))


def estimable(train: DataFrame) -> DataFrame:
    """Skills of ``train`` (kc, correct) that have both right and wrong answers."""
    return train.groupBy("kc").agg(F.min("correct").alias("lo"), F.max("correct").alias("hi")).where("lo < hi").select("kc")


def rescued(train: DataFrame, test: DataFrame, predict_known: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions of ``test``: those of ``predict_known`` (which adds p) for estimable skills, the base rate of ``train``
    for the others, and wherever p is null or not a number. ``fitted`` marks rows of estimable skills, ``rescued`` rows
    with the base rate."""
    skills = estimable(train).withColumn("fitted", F.lit(True))
    rows = test.join(skills, "kc", "left")
    known = predict_known(rows.where("fitted").drop("fitted")).withColumn("fitted", F.lit(True))
    columns = [c for c in known.columns if c not in ("p", "fitted")]
    rest = rows.where("fitted is null").select(*columns, F.lit(None).cast("double").alias("p"), F.lit(False).alias("fitted"))
    base = train.agg(F.avg("correct").alias("_base"))
    p = F.nanvl(F.col("p"), F.lit(None).cast("double"))
    out = known.select(rest.columns).union(rest).crossJoin(F.broadcast(base))
    return out.withColumn("rescued", p.isNull()).withColumn("p", F.coalesce(p, "_base")).drop("_base")


def summary(parameters: DataFrame, bound: float) -> DataFrame:
    """Count, mean, deviation and quartiles of each parameter, and how many values lie at ``bound`` as isclose has it."""
    rows = parameters.select(F.explode(F.array(*[F.struct(F.lit(x).alias("parameter"), F.col(x).alias("v")) for x in DEFAULTS])).alias("x")).select("x.*")
    at = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy("parameter").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), at.alias("q"), F.max("v").alias("most"), F.sum((F.abs(F.col("v") - bound) <= 1e-8 + 1e-5 * abs(bound)).cast("long")).alias("at_bound"))
    return out.select("parameter", "n", "mean", "std", "least", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"), "most", "at_bound")
