"""Fitted knowledge tracing over whole tables: the second fitter, cross-validation, settings and base-rate rescue, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.operators import bkt, metrics, ranks
from mentora.operators import turns as U
from mentora.plans.sql import TURNS
from mentora.sources import adapters as A
from mentora.sources.files import stored

TRACING: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TRACING_SQL: dict[str, str] = {}
#: Settings of the sweep: number, iterations and cap of guesses and slips.
GRID = ((0, 1, 0.5), (1, 5, 0.3), (2, 30, 0.3), (3, 30, 0.5))
#: Parts of which each skill is made in the rescue query, so that many skills are seen too little.
SPARSE = 401


def tracing(sql: str | None):
    def add(f):
        TRACING[f.__name__] = f
        if sql is not None:
            TRACING_SQL[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.observations(A.annotated_turns(spark, sf_dir))


def _fit_sql(obs: str, keys: tuple[str, ...], grid: tuple = ((0, 30, 0.5),), seed: int = 221) -> str:
    """Tables c (distinct sequences of ``obs``: keys, kc, d, turn, pos, correct) to par, every iteration a table."""
    names = ", ".join([*keys, "kc", "setting"])
    start = bkt.filtered_start(seed)
    values = ", ".join(f"({i}, {n}, CAST({cap} AS DOUBLE))" for i, n, cap in grid)
    steps = [f"""q AS (SELECT {', '.join([*keys, 'kc', 'd'])}, list(correct ORDER BY turn, pos) AS y FROM {obs} GROUP BY ALL),
c AS MATERIALIZED (SELECT {', '.join([*keys, 'kc'])}, y, len(y) AS size, count(*) AS times FROM q GROUP BY ALL),
grid(setting, iterations, cap) AS (VALUES {values}),
p0 AS MATERIALIZED (SELECT DISTINCT {', '.join([*keys, 'kc'])}, setting, iterations, cap, {', '.join(f'CAST({v!r} AS DOUBLE) AS {k}' for k, v in start.items())} FROM c, grid)"""]
    joined = " AND ".join(f"c.{k} = p.{k}" for k in (*keys, "kc"))
    prefixed = ", ".join(f"p.{x}" for x in [*keys, "kc", "setting", "iterations", "cap", "prior", "learns", "guesses", "slips"])
    for i in range(max(n for _, n, _ in grid)):
        known, unknown = "acc.b * CASE WHEN x.y = 1 THEN 1 - slips ELSE slips END", "(1 - acc.b) * CASE WHEN x.y = 1 THEN guesses ELSE 1 - guesses END"
        state = f"({known}) / nullif({known} + {unknown}, 0)"
        # The states after each label, as a fold over the sequence.
        walked = f"""SELECT {prefixed}, times, size, y, list_reduce(list_prepend(struct_pack(y := 0, b := p.prior, g := CAST([] AS DOUBLE[])), list_transform(y, lambda v: struct_pack(y := v, b := CAST(0 AS DOUBLE), g := CAST([] AS DOUBLE[])))),
      lambda acc, x: struct_pack(y := x.y, b := {state} + (1 - {state}) * learns, g := list_append(acc.g, {state}))).g AS g FROM c JOIN p{i} p ON {joined}"""
        over = lambda f: f"list_sum(list_transform(range(1, size + 1), lambda k: {f}))"
        sums = {
            "first": "g[1]", "before_last": over("CASE WHEN k < size THEN 1 - g[k] ELSE 0 END"), "k1": over("CASE WHEN y[k] = 1 THEN g[k] ELSE 0 END"), "k0": over("CASE WHEN y[k] = 0 THEN g[k] ELSE 0 END"),
            "u1": over("CASE WHEN y[k] = 1 THEN 1 - g[k] ELSE 0 END"), "u0": over("CASE WHEN y[k] = 0 THEN 1 - g[k] ELSE 0 END"),
        }
        ok = "len(list_filter(g, lambda v: v IS NOT NULL)) = size"
        share = lambda a, b, old: f"CASE WHEN {b} > 1e-12 THEN {a} / {b} ELSE {old} END"
        new = {"prior": share("first", "n", "prior"), "learns": share("before_last * learns", "(before_last * learns + (before_last - before_last * learns))", "learns"), "guesses": f"least({share('u1', '(u1 + u0)', 'guesses')}, cap)", "slips": f"least({share('k0', '(k1 + k0)', 'slips')}, cap)"}
        steps.append(f"""s{i} AS MATERIALIZED (SELECT {names}, any_value(iterations) AS iterations, any_value(cap) AS cap, any_value(prior) AS prior, any_value(learns) AS learns, any_value(guesses) AS guesses, any_value(slips) AS slips,
  coalesce(sum(times) FILTER ({ok}), 0) AS n, {', '.join(f'coalesce(sum(times * ({v})) FILTER ({ok}), 0) AS {k}' for k, v in sums.items())}
  FROM ({walked}) AS w GROUP BY {names}),
p{i + 1} AS MATERIALIZED (SELECT {names}, iterations, cap, {', '.join(f'CASE WHEN iterations > {i} THEN {v} ELSE {k} END AS {k}' for k, v in new.items())} FROM s{i})""")
    clamped = ", ".join(f"least(greatest({x}, 1e-6), {'1 - 1e-6' if x in ('prior', 'learns') else '0.5'}) AS {x}" for x in bkt.DEFAULTS)
    steps.append(f"par AS MATERIALIZED (SELECT {names}, {clamped} FROM p{max(n for _, n, _ in grid)})")
    return ", ".join(steps)


def _predict_sql(test: str, keys: tuple[str, ...], grid: bool = False) -> str:
    """Tables fb (fallbacks) to tp (turn probabilities, first turns left out) of the rows ``test`` (keys, d, turn, pos, kc, correct)."""
    own = [*keys, *(["setting"] if grid else [])]
    both = ", ".join([*own, "d"])
    match = lambda a, b, names: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names) or "true"
    value = lambda x: f"coalesce(par.{x}, fb.{x}) AS {x}"
    after = "CASE WHEN w.correct = 1 THEN CASE WHEN w.b * (1 - w.slips) + (1 - w.b) * w.guesses > 1e-12 THEN w.b * (1 - w.slips) / (w.b * (1 - w.slips) + (1 - w.b) * w.guesses) ELSE w.b END ELSE CASE WHEN w.b * w.slips + (1 - w.b) * (1 - w.guesses) > 1e-12 THEN w.b * w.slips / (w.b * w.slips + (1 - w.b) * (1 - w.guesses)) ELSE w.b END END"
    return f"""
fb AS (SELECT {', '.join([*(f'par.{k}' for k in own), ''])} {', '.join(f'sum({x} * n) / sum(n) AS {x}' for x in bkt.DEFAULTS)} FROM par JOIN (SELECT {', '.join([*keys, 'kc'])}, sum(size * times) AS n FROM c GROUP BY ALL) AS m ON {match('par', 'm', [*keys, 'kc'])} {'GROUP BY ALL' if own else ''}),
seq AS (SELECT x.*, {'grid.setting,' if grid else ''} row_number() OVER (PARTITION BY {both}, kc ORDER BY turn, pos) AS k FROM {test} x {', grid' if grid else ''}),
walk AS (
  SELECT seq.*, {', '.join(map(value, bkt.DEFAULTS))}, coalesce(par.prior, fb.prior) AS b FROM seq LEFT JOIN par ON {match('seq', 'par', [*own, 'kc'])} JOIN fb ON {match('seq', 'fb', own)} WHERE k = 1
  UNION ALL SELECT s.*, w.prior, w.learns, w.guesses, w.slips, least(greatest(({after}) + (1 - ({after})) * w.learns, 1e-6), 1 - 1e-6)
  FROM walk w JOIN seq s ON {match('s', 'w', [*own, 'd', 'kc'])} AND s.k = w.k + 1),
tp AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {both} ORDER BY turn) AS r FROM (
  SELECT {both}, turn, max(correct) AS correct, round(avg(b * (1 - slips) + (1 - b) * guesses), 9) AS p FROM walk GROUP BY ALL)) WHERE r > 1)"""


def _scores_sql(own: tuple[str, ...]) -> str:
    part = f"PARTITION BY {', '.join(own)}" if own else ""
    key = ", ".join([*own, ""])
    return f"""
h AS (SELECT *, CAST(round_even(p, 0) AS INT) AS hard, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {', '.join([*own, 'p'])}) - 1) / 2.0 AS r, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM tp),
t AS (SELECT {key} count(*) AS n, sum(correct) AS pos, sum(CASE WHEN hard = correct THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN hard = 1 AND correct = 1 THEN 1 ELSE 0 END) AS tp, sum(hard) AS said,
  sum(CASE WHEN correct = 1 THEN CAST(r AS DOUBLE) ELSE 0 END) AS rs, sum(correct * ln(q) + (1 - correct) * ln(1 - q)) AS ll, sum((p - correct) * (p - correct)) AS sq FROM h {f"GROUP BY {', '.join(own)}" if own else ''}),
m AS (SELECT {key} CAST(n AS BIGINT) AS n, round(CAST(hits AS DOUBLE) / n, 8) AS accuracy, round((rs - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * (n - pos)), 8) AS auc, round(CASE WHEN said > 0 THEN CAST(tp AS DOUBLE) / said ELSE 0 END, 8) AS "precision",
  round(CAST(tp AS DOUBLE) / pos, 8) AS recall, round(CAST(2 * tp AS DOUBLE) / (said + pos), 8) AS f1, round(ll / n, 8) AS log_likelihood, round(sq / n, 8) AS brier FROM t)"""


_FOLDS_SQL = """
place AS (SELECT o_orderkey AS d, row_number() OVER (ORDER BY md5('221-' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
turned AS (SELECT d, n, f AS fold, (k + n - CAST(floor(n * (CAST(f - 1 AS DOUBLE) / 5)) AS BIGINT)) % n AS k FROM place, range(1, 6) AS t(f)),
sl AS MATERIALIZED (SELECT d, fold, CASE WHEN k < floor(n * CAST(0.65 AS DOUBLE)) THEN 'train' WHEN k < floor(n * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS slice FROM turned),
own AS MATERIALIZED (SELECT obs.* EXCLUDE (split), fold, slice FROM obs JOIN sl ON obs.d = sl.d),
train AS (SELECT * FROM own WHERE slice = 'train')"""
_ROUNDED = ", ".join(f"round({x}, 8) AS {x}" for x in bkt.DEFAULTS)


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d"), F.md5(F.concat(F.lit("221-"), F.col("o_orderkey").cast("string"))).alias("h"))
    return ranks.fold_slices(ranks.with_position(rows, "h", "d")).select("d", "fold", "slice")


def _scored(predictions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Metrics of turns, first ones left out, of each ``by``; probabilities to nine places, equal in every engine."""
    turns = metrics.drop_first_turns(metrics.turn_probabilities(predictions, by=by), by)
    return metrics.scores(turns.withColumn("p", F.round("p", 9)), by)


@tracing(f"WITH {TURNS}, train AS (SELECT * FROM obs WHERE split = 'train'), {_fit_sql('train', ())} SELECT kc, {_ROUNDED} FROM par")
def bkt_filtered_params(spark, sf_dir):
    """Parameters of the filtered fit on the train split."""
    parameters = bkt.fit_filtered(bkt.label_sequences(_obs(spark, sf_dir).where("split = 'train'")))
    return parameters.select("kc", *[F.round(x, 8).alias(x) for x in bkt.DEFAULTS])


@tracing(f"WITH RECURSIVE {TURNS}, {_FOLDS_SQL}, {_fit_sql('train', ('fold',))}, held AS (SELECT * FROM own WHERE slice = 'test'), {_predict_sql('held', ('fold',))}, {_scores_sql(('fold',))} SELECT CAST(fold AS BIGINT) AS fold, * EXCLUDE (fold) FROM m")
def crossval_folds(spark, sf_dir):
    """Metrics of each of five rotated folds, all fitted at once."""
    return _scored(bkt.cross_predictions(_obs(spark, sf_dir), _slices(spark, sf_dir)), ("fold",))


_UNPIVOTED = f"UNPIVOT m ON {', '.join(metrics.METRICS)} INTO NAME metric VALUE v".replace(" precision,", ' "precision",')


@tracing(f"WITH RECURSIVE {TURNS}, {_FOLDS_SQL}, {_fit_sql('train', ('fold',))}, held AS (SELECT * FROM own WHERE slice = 'test'), {_predict_sql('held', ('fold',))}, {_scores_sql(('fold',))}, u AS ({_UNPIVOTED}) SELECT metric, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, count(*) AS folds FROM u GROUP BY metric")
def crossval_metrics(spark, sf_dir):
    """Mean and deviation of each metric over the folds."""
    out = bkt.over_folds(crossval_folds(spark, sf_dir), metrics.METRICS)
    return out.select("metric", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), "folds")


@tracing(None)
def crossval_em_metrics(spark, sf_dir):
    """The same over fits with forward and backward pass and restarts."""
    scores = _scored(bkt.cross_predictions(_obs(spark, sf_dir), _slices(spark, sf_dir), fitter="em"), ("fold",))
    out = bkt.over_folds(scores, metrics.METRICS)
    return out.select("metric", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), "folds")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(setting, mean AUC over the folds' validation slices) of every setting of GRID, all fitted at once."""
    grid = spark.createDataFrame(GRID, "setting int, iterations int, cap double")
    predictions = bkt.cross_predictions(_obs(spark, sf_dir), _slices(spark, sf_dir), "validation", grid=grid)
    out = bkt.over_folds(_scored(predictions, ("fold", "setting")), ("auc",), ("setting",))
    return out.select("setting", F.round("mean", 7).alias("auc")).join(F.broadcast(grid), "setting")


_SWEEP_SQL = f"WITH RECURSIVE {TURNS}, {_FOLDS_SQL}, {_fit_sql('train', ('fold',), GRID)}, held AS (SELECT * FROM own WHERE slice = 'validation'), {_predict_sql('held', ('fold',), True)}, {_scores_sql(('fold', 'setting'))}, runs AS (SELECT CAST(m.setting AS INT) AS setting, round(avg(auc), 7) AS auc, any_value(iterations) AS iterations, any_value(cap) AS cap FROM m JOIN grid ON m.setting = grid.setting GROUP BY m.setting)"


@tracing(f"{_SWEEP_SQL} SELECT * FROM runs")
def sweep_runs(spark, sf_dir):
    return _sweep(spark, sf_dir)


@tracing(f"{_SWEEP_SQL} SELECT * FROM runs ORDER BY auc DESC, setting LIMIT 1")
def sweep_best(spark, sf_dir):
    """The setting with the greatest mean AUC, the first of equal ones."""
    return ranks.best_setting(_sweep(spark, sf_dir), "auc", "setting")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with each skill told apart by dialogue number, written once, as counts, fit, base rate and test rows use them."""
    obs = _obs(spark, sf_dir).withColumn("kc", F.concat("kc", F.lit("-"), (F.col("d") % SPARSE).cast("string")))
    return stored(obs, "observations")


@tracing(f"""WITH RECURSIVE {TURNS}, sparse AS (SELECT d, turn, pos, kc || '-' || d % {SPARSE} AS kc, correct, split FROM obs), st AS (SELECT kc FROM sparse WHERE split = 'train' GROUP BY kc HAVING min(correct) < max(correct)),
train AS (SELECT * FROM sparse WHERE split = 'train' AND kc IN (SELECT kc FROM st)), base AS (SELECT avg(correct) AS b FROM sparse WHERE split = 'train'), {_fit_sql('train', ())}, held AS (SELECT * FROM sparse WHERE split = 'test' AND kc IN (SELECT kc FROM st)), {_predict_sql('held', ())},
x AS (SELECT b * (1 - slips) + (1 - b) * guesses AS p FROM walk UNION ALL SELECT b FROM base, sparse WHERE split = 'test' AND kc NOT IN (SELECT kc FROM st))
SELECT count(*) AS n, (SELECT count(*) FROM walk) AS estimable, count(*) - (SELECT count(*) FROM walk) AS rescued, CAST(0 AS BIGINT) AS not_numbers, (SELECT count(DISTINCT kc) FROM sparse WHERE split = 'train' AND kc NOT IN (SELECT kc FROM st)) AS degenerate_kcs, round(avg(p), 8) AS mean_p FROM x""")
def estimable_split(spark, sf_dir):
    """Test rows predicted by skills fitted on the whole train split; those of skills without both labels there, and those
    without a number as prediction, get the base rate. Each skill is told apart by dialogue number, so that many are sparse."""
    obs = _sparse(spark, sf_dir)
    train, test = obs.where("split = 'train'"), obs.where("split = 'test'")
    seqs = bkt.label_sequences(train.join(bkt.estimable(train), "kc", "left_semi"))
    rows = bkt.rescued(train, test, lambda known: bkt.predict(known, bkt.fit_filtered(seqs), margin=1e-6))
    counts = rows.agg(F.count("*").alias("n"), F.sum((~F.col("rescued")).cast("long")).alias("estimable"), F.sum(F.col("rescued").cast("long")).alias("rescued"), F.sum((F.col("rescued") & F.col("fitted")).cast("long")).alias("not_numbers"), F.round(F.avg("p"), 8).alias("mean_p"))
    degenerate = train.groupBy("kc").agg(F.min("correct").alias("lo"), F.max("correct").alias("hi")).where("lo = hi").agg(F.count("*").alias("degenerate_kcs"))
    return counts.crossJoin(degenerate)


@tracing(None)
def estimable_em_split(spark, sf_dir):
    """The same by fits with forward and backward pass and restarts: rows by source of their prediction."""
    obs = _sparse(spark, sf_dir)
    train, test = obs.where("split = 'train'"), obs.where("split = 'test'")
    rows = bkt.rescued(train, test, lambda known: bkt.predict(known, bkt.fit(bkt.label_sequences(train))))
    return rows.groupBy("fitted", "rescued").agg(F.count("*").alias("n"), F.round(F.avg("p"), 7).alias("mean_p"))
