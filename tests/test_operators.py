import numpy as np
import pytest
from plain_tracing import fit_filtered_skill, fit_skill
from pyspark.sql import functions as F

from mentora.functions import text as T
from mentora.operators import bkt, metrics, ranks
from mentora.operators.turns import apply_override, coalesce_turns, histories


def test_turns_student_first_repeats_and_missing_answer(spark):
    said = [(1, 0, "student", "Hi"), (1, 1, "teacher", "Go on"), (1, 2, "teacher", "Go on"), (1, 3, "student", "ok"), (1, 4, "teacher", "Bye"), (2, 0, "teacher", "A."), (2, 1, "teacher", "B"), (2, 2, "student", "c")]
    got = {(r.d, r.turn): (r.teacher, r.student) for r in coalesce_turns(spark.createDataFrame(said, "d long, pos long, role string, content string")).collect()}
    assert got == {(1, 0): ("", "Hi"), (1, 1): ("Go on", "ok"), (2, 1): ("A. B", "c")}


def test_histories_are_whole_and_end_with_the_teacher_line(spark):
    long = "word " * 40 + "end"
    turns = spark.createDataFrame([(1, 0, "", "Hi", None, []), (1, 1, long, long, True, ["a", "b"]), (1, 2, long + " 2", "", False, ["a"]), (1, 3, "Last", "no", None, [])], "d long, turn int, teacher string, student string, correct boolean, kcs array<string>")
    plain = {r.turn: r.history.split("\n") for r in histories(turns).collect()}
    lines = ["Student Turn 0: Hi", f"Teacher Turn 1: {long}", f"Student Turn 1: {long}", f"Teacher Turn 2: {long} 2", "Teacher Turn 3: Last"]
    assert plain == {t: ["[BEGIN DIALOGUE]", *(lines[:n] or [""]), "[END DIALOGUE]"] for t, n in ((0, 0), (1, 2), (2, 4), (3, 5))}
    labelled = {r.turn: r.history for r in histories(turns, include_labels=True, tag_wrapper=False).collect()}
    after = ["Student Turn 0 Correct: na", "Turn 0 Knowledge Components: None"], ["Student Turn 1 Correct: true", "Turn 1 Knowledge Components: 1) a 2) b"]
    assert labelled[2] == "\n".join([lines[0], *after[0], *lines[1:3], *after[1], lines[3]])


def test_override_table(spark):
    rows = [(i, 1, og, ["k"], s, True) for i, (og, s) in enumerate((og, s) for og in (True, False, None) for s in "FOPX")]
    got = [r.correct for r in apply_override(spark.createDataFrame(rows, "d long, turn int, og boolean, kcs array<string>, status string, is_last boolean")).orderBy("d").collect()]
    assert got == [True, False, None, True, True, False, None, False, None, None, None, None]


def test_forward_looks_back_only_and_fit_learns(spark):
    obs = spark.createDataFrame([(d, t, 0, "k", y) for d, ys in enumerate([[0, 1, 1], [0, 1, 0]]) for t, y in enumerate(ys)], "d long, turn int, pos int, kc string, correct int")
    p = {(r.d, r.turn): r.p for r in bkt.predict(obs).collect()}
    assert all(abs(p[0, t] - p[1, t]) < 1e-12 for t in range(3))
    rng = np.random.default_rng(1)
    seqs = [(rng.random(8) < np.linspace(0.2, 0.95, 8)).astype(int) for _ in range(60)]
    got = fit_skill(seqs, 1)
    assert all(0 < v < 1 for v in got.values()) and got["guesses"] <= 0.49


def test_unfitted_skills_take_the_weighted_mean(spark):
    rng, rows = np.random.default_rng(3), []
    for kc, n in (("a", 40), ("b", 10)):
        rows += [(d, t, 0, kc, int(y)) for d in range(n) for t, y in enumerate(rng.random(6) < np.linspace(0.2, 0.9, 6))]
    train = spark.createDataFrame([*rows, *[(d, 9, 0, "right", 1) for d in range(30)]], "d long, turn int, pos int, kc string, correct int")
    test = spark.createDataFrame([(d, 0, 0, kc, 1) for d, kc in enumerate(("a", "right", "unseen"))], train.schema)
    fitted = {r.kc: r for r in bkt.fit(bkt.label_sequences(train)).collect()}
    start = lambda r: r["prior"] * (1 - r["slips"]) + (1 - r["prior"]) * r["guesses"]
    mean = {x: (240 * fitted["a"][x] + 60 * fitted["b"][x]) / 300 for x in bkt.DEFAULTS}
    got = {r.kc: r.p for r in bkt.fit_predict(train, test).collect()}
    assert set(fitted) == {"a", "b"} and np.allclose([got["a"], got["right"], got["unseen"]], [start(fitted["a"]), start(mean), start(mean)], atol=1e-9, rtol=0)
    assert abs(start(mean) - start(bkt.DEFAULTS)) > 0.01


@pytest.mark.parametrize("in_tasks", [True, False])
def test_fits_equal_plain_ones_in_and_beyond_a_task(spark, monkeypatch, in_tasks):
    """Several folds at once, one of them without a skill; skills in order of first appearance, not of name."""
    rng, rows, own = np.random.default_rng(8), [], {}
    for fold in (1, 2):
        for place, (kc, n) in enumerate((("c", 120), ("a", 60), ("all right", 5), ("ba", 3), ("ab", 40))[: 5 - 2 * (fold == 2)]):
            seqs = [(rng.random(k) < np.linspace(0.3, 0.9, k)).astype(int) for k in rng.integers(1, 9, n)] if kc != "all right" else [np.ones(2, int)] * n
            own[fold, kc] = place, seqs
            rows += [(fold, 1000 * place + d, t, 0, kc, int(y)) for d, seq in enumerate(seqs) for t, y in enumerate(seq)]
    rows += [(1, 1, 0, 5, None, 1), (1, 1, 0, 6, "c", None)]
    obs = spark.createDataFrame(rows, "fold int, d long, turn int, pos int, kc string, correct int").repartition(3)
    monkeypatch.setattr(bkt, "CELLS", 400)  # several partitions and chunks
    if not in_tasks:
        monkeypatch.setattr(bkt, "TASK_CELLS", 30)  # all but the smallest skills
    seqs = bkt.label_sequences(obs, ("fold",))
    got = {(r.fold, r.kc): r for r in bkt.fit(seqs, ("fold",)).collect()}
    assert set(got) == {k for k, (_, s) in own.items() if len({int(y) for x in s for y in x}) == 2}
    for (fold, kc), r in got.items():
        place, mine = own[fold, kc]
        want = fit_skill(mine, 221 + place)
        assert np.allclose([r[x] for x in want], list(want.values()), atol=1e-6, rtol=0)
    grid = spark.createDataFrame([(7, 3, 0.2), (8, 30, 0.5)], "setting int, iterations int, cap double")
    filtered = {(r.fold, r.kc, r.setting): r for r in bkt.fit_filtered(seqs, ("fold",), grid).collect()}
    assert len(filtered) == 2 * len(own)
    for (fold, kc, setting), r in filtered.items():
        want = fit_filtered_skill([x.tolist() for x in own[fold, kc][1]], iterations={7: 3, 8: 30}[setting], cap={7: 0.2, 8: 0.5}[setting])
        assert np.allclose([r[x] for x in want], list(want.values()), atol=1e-9, rtol=0)
    nothing = bkt.label_sequences(obs.where("false"), ("fold",))
    assert bkt.fit(nothing, ("fold",)).count() == bkt.fit_filtered(nothing, ("fold",)).count() == 0


def test_cross_validation_by_plain_loops(spark):
    """Each fold on its own, the same fitter and predictor called once a fold, and the metrics by hand."""
    rng = np.random.default_rng(2)
    rows = [(d, t, 0, str(rng.choice(["x", "y", "z"])), int(rng.random() < 0.3 + 0.1 * t)) for d in range(60) for t in range(5)]
    rows += [(d, 9, 0, "only in one", 1) for d in (3, 4)]
    obs = spark.createDataFrame(rows, "d long, turn int, pos int, kc string, correct int")
    slices = [(d, f, ("train", "train", "validation", "test")[(d + f) % 4]) for d in range(60) for f in (1, 2)]
    table = spark.createDataFrame(slices, "d long, fold long, slice string")
    for fitter, options in (("filtered", {}), ("em", {"restarts": 2, "iterations": 20})):
        found = {(r.fold, r.d, r.turn): r.p for r in bkt.cross_predictions(obs, table, fitter=fitter, **options).collect()}
        want = {}
        for fold in (1, 2):
            side = {d: s for d, f, s in slices if f == fold}
            train = obs.where(F.col("d").isin([d for d, s in side.items() if s == "train"]))
            test = obs.where(F.col("d").isin([d for d, s in side.items() if s == "test"]))
            seqs = bkt.label_sequences(train)
            parameters = bkt.fit(seqs, **options) if fitter == "em" else bkt.fit_filtered(seqs)
            rows_of = bkt.predict(test, parameters, bkt.weighted_fallback(parameters, bkt.observation_counts(seqs)), margin=0.0 if fitter == "em" else 1e-6)
            want |= {(fold, r.d, r.turn): r.p for r in rows_of.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError, match="unknown fitter"):
        bkt.cross_predictions(obs, table, fitter="neural")
    scores = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.0, 0.75)], "fold int, auc double, f1 double")
    assert {(r.metric, r["mean"], r["std"], r.folds) for r in bkt.over_folds(scores, ("auc", "f1")).collect()} == {("auc", 0.75, 0.25, 2), ("f1", 0.5, 0.25, 2)}


def test_metrics_by_group_and_over_score_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, d, 1, int(rng.integers(2)), float(rng.choice([0.0, 1.0, 0.5, rng.random(), round(rng.random(), 1)]))) for g in ("a", "b") for d in range(150)] + [("none", 1, 1, 1, 0.5)]
    table = spark.createDataFrame(rows, "g string, d long, turn int, correct int, p double")
    monkeypatch.setattr(metrics, "SCORE_BUCKETS", 7)
    got = {r.g: r for r in metrics.scores(table, ("g",)).collect()}
    for g in ("a", "b"):
        pos, neg = ([p for x, _, _, y, p in rows if x == g and y == k] for k in (1, 0))
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert got[g].n == 150 and abs(got[g].auc - auc) < 1e-8
    assert got["none"].auc is None and got["none"].n == 1 and metrics.scores(table.limit(0), ("g",)).count() == 0


def test_positions_by_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(40)), str(rng.integers(5))) for _ in range(500)]
    table = spark.createDataFrame(rows, "a int, b string").repartition(4)
    got = sorted((r.position, r.a, r.b, r.total) for r in ranks.with_position(table, "a", "b").collect())
    assert [x[0] for x in got] == list(range(500)) and [x[1:3] for x in got] == sorted(rows) and {x[3] for x in got} == {500}
    first = {(r.b, r.a): r.place for r in ranks.order_of_groups(table.withColumn("k", F.hash("a", "b")), ("b",), "a", "k").collect()}
    for b in {b for _, b in rows}:
        keyed = [r.a for r in table.where(F.col("b") == b).groupBy("a").agg(F.min(F.hash("a", "b")).alias("k")).orderBy("k").collect()]
        assert [first[b, a] for a in keyed] == list(range(len(keyed)))
    assert ranks.with_position(table.limit(0), "a").count() == 0


def test_positions_folds_and_shortfall(spark):
    keys = [f"{k * 7919 % 1000:03}" for k in range(23)]
    placed = ranks.with_position(spark.createDataFrame([(k,) for k in keys], "h string"), "h")
    got = {(r.fold, r.h): r.slice for r in ranks.fold_slices(placed).collect()}
    for fold in range(1, 6):
        cut = int(23 * ((fold - 1) / 5))
        turned = sorted(keys)[cut:] + sorted(keys)[:cut]
        want = dict.fromkeys(turned[: int(23 * 0.65)], "train") | dict.fromkeys(turned[int(23 * 0.65) : int(23 * 0.8)], "validation") | dict.fromkeys(turned[int(23 * 0.8) :], "test")
        assert {h: s for (f, h), s in got.items() if f == fold} == want
    pool = spark.createDataFrame([(f, d) for f, ds in (("a", range(10)), ("b", range(10, 12)), ("c", range(20, 30))) for d in ds], "family string, d long")
    used = pool.where("d in (0, 1, 20, 21, 22, 23)")
    assert {(r.family, r.d) for r in ranks.draw_shortfall(pool, used, 4, "d").collect()} == {("a", 2), ("a", 3), ("b", 10), ("b", 11)}


def test_auc_with_ties(spark):
    turns = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 0, 0.5), (1, 3, 1, 0.9), (1, 4, 0, 0.1), (1, 5, 1, float("nan"))], "d long, turn int, correct int, p double")
    r = metrics.scores(turns).head()
    assert (r.n, r.auc, r.accuracy) == (4, 0.875, 0.75)  # bround(0.5) is 0


def test_success_cases(spark):
    text = F.col("t")
    rows = spark.createDataFrame([("So 1,079 it is", "1079"), ("$20", "20"), ("it is 20.5", "20"), ("x", "none")], "t string, a string")
    assert [r[0] for r in rows.select(T.names_answer(text, F.col("a"))).collect()] == [True, True, False, False]


def test_lm_result_takes_the_last_block(spark):
    rows = spark.createDataFrame([("```json{1}``` x ```json{2}```",), ("result = [\\(\\pi\\)]",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(T.lm_result(F.col("t"))).collect()] == ["{2}", "[pi]", None]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
