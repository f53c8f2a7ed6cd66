"""Cached calls, annotation by levels, arrays, examples and invariants on hard rows."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from mentora.functions.prompts import IGNORED
from mentora.operators import annotations as N
from mentora.operators import arrays, calls, checks, examples, tagging
from mentora.sources.files import annotated_file, dictionary_file, new_path, read_csv_strings, read_ids


def provider():
    """A function that travels to the workers with its code, as they don't import tests."""

    def flaky(prompt, system):
        if prompt.startswith("bad"):
            raise OSError(prompt)
        return f"{system}:{prompt[::-1]}"

    return flaky


flaky = provider()


def test_calls_ask_once_and_keep_what_is_finished(spark):
    cache = new_path(spark, "cache")
    rows = spark.createDataFrame([(i, f"p{i % 7}") for i in range(30)] + [(40, "bad 1"), (41, "bad 1"), (42, "bad 2"), (43, None), (44, "")], "d int, prompt string")
    with pytest.raises(calls.CallsFailed, match="2 of 10") as failed:
        calls.cached_calls(rows, flaky, cache, "m", "s", batch=2, wave=3)  # several waves; those without failures and the rest of the others stay
    first = failed.value.calls
    assert (first.asked, first.answered) == (10, 8) and {tuple(r) for r in first.failures.collect()} == {("bad 1", "OSError: bad 1"), ("bad 2", "OSError: bad 2")}
    assert calls.read_cache(spark, cache).count() == 8
    sent = new_path(spark, "sent")
    again = calls.cached_calls(rows, lambda p, s: f"{s}:{p[::-1]}", cache, "m", "s", wave=1)
    assert (again.asked, again.answered, again.failures.count()) == (2, 2, 0) and sent
    got = {r.d: r.response for r in again.rows.collect()}
    assert len(got) == 35 and got[3] == "s:3p" and got[40] == got[41] == "s:1 dab" and got[43] is None and got[44] == "s:"
    # Another system message or model is another prompt; a failing model isn't asked for what is known.
    assert calls.cached_calls(rows, flaky, cache, "m", "s").asked == 0
    assert calls.cached_calls(rows, flaky, cache, "m", None, strict=False).asked == 10
    assert calls.cached_calls(rows, flaky, cache, "other", "s", strict=False).asked == 10
    assert calls.cached_calls(rows.limit(0), flaky, new_path(spark, "cache"), "m").rows.count() == 0


def test_calls_take_no_more_jobs_for_more_waves(spark):
    rows = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    spark.sparkContext.setJobGroup("many-waves", "")
    done = calls.cached_calls(rows, flaky, new_path(spark, "cache"), "m", "s", wave=1)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-waves"))
    spark.sparkContext.setJobGroup("", "")
    assert (done.asked, done.answered) == (40, 40) and jobs < 15  # 80 and more with jobs for each wave


def test_answers_of_finished_tasks_outlive_the_job(spark):
    def dies(prompt, system):
        if prompt == "p7":
            time.sleep(8)
            os._exit(1)
        return prompt

    cache, rows = new_path(spark, "cache"), spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    with pytest.raises(Exception, match="(?i)worker"):
        calls.cached_calls(rows, dies, cache, "m")
    kept = calls.read_cache(spark, cache).count()
    again = calls.cached_calls(rows, flaky, cache, "m")
    assert 0 < kept < 40 and again.asked == 40 - kept and again.rows.where("response is null").count() == 0


def test_a_limit_of_tasks_asks_all_in_waves(spark):
    rows = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    done = calls.cached_calls(rows, flaky, new_path(spark, "cache"), "m", "s", wave=20, tasks=2)
    assert (done.asked, done.answered, done.failures.count(), done.rows.where("response is null").count()) == (40, 40, 0, 0)


def test_long_prompts_are_asked_without_being_written(spark, monkeypatch):
    written, stored = [], calls.stored
    monkeypatch.setattr(calls, "stored", lambda df, name: written.extend(df.columns) or stored(df, name))
    text = F.when(F.col("d") == 43, None).when(F.col("d") >= 40, F.concat(F.lit("bad "), (F.col("d") / 42).cast("int").cast("string"))).otherwise(F.concat(F.lit("p"), (F.col("d") % 7).cast("string")))
    rows, cache, prompts = spark.range(45).select(F.col("id").alias("d"), F.lit(1).alias("x")), new_path(spark, "cache"), lambda some: some.withColumn("prompt", text)
    first = calls.cached_calls(rows, flaky, cache, "m", "s", batch=2, strict=False, by="d", prompts=prompts)
    assert (first.asked, first.answered) == (9, 7) and {tuple(r) for r in first.failures.collect()} == {("bad 0", "OSError: bad 0"), ("bad 1", "OSError: bad 1")}
    assert not [c for c in written if "prompt" in c] and {(r.prompt, r.system) for r in calls.read_cache(spark, cache).collect()} == {(None, "s")}
    with pytest.raises(calls.CallsFailed, match="2 of 2"):
        calls.cached_calls(rows, flaky, cache, "m", "s", by="d", prompts=prompts)
    # Keys are those of prompts that are written, too; in waves of few tasks as well.
    again = calls.cached_calls(rows, lambda p, s: f"{s}:{p[::-1]}", cache, "m", "s", wave=1, tasks=2, by="d", prompts=prompts)
    assert (again.asked, again.answered, again.failures.count(), again.rows.columns) == (2, 2, 0, ["d", "x", "response"])
    assert calls.cached_calls(prompts(rows), flaky, cache, "m", "s").asked == 0
    got = {r.d: r.response for r in again.rows.collect()}
    assert len(got) == 45 and got[3] == "s:3p" and got[40] == got[41] == "s:0 dab" and got[42] == "s:1 dab" and got[43] is None


def test_uncached_calls_ask_for_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad")], "d int, prompt string")
    got = {r.d: (r.response, r.error) for r in calls.uncached_calls(rows, flaky, "s").collect()}
    assert got == {1: ("s:a", None), 2: ("s:a", None), 3: (None, "OSError: bad")}


DIALOGUES = [(i, [1, 2], f"[BEGIN DIALOGUE]\n{'x' * i}\n[END DIALOGUE]", 2) for i in range(5)]
GROUPS = [(0, "Number", "n", ["NBT", "HS"]), (1, "Shape", "s", ["G"])]
TREE = [("K.NBT", "tens", "Domain", "K"), ("X.1", "high", "Domain", "HS"), ("K.G", "shapes", "Domain", "K"), ("K.NBT.A", "place value", "Cluster", "K.NBT"), ("X.1.A", "number", "Cluster", "X.1"), ("K.NBT.A.1", "compose", "Standard", "K.NBT.A"), ("K.NBT.A.2", "decompose", "Standard", "K.NBT.A")]


def test_levels_fail_one_after_the_other(spark):
    dialogues = spark.createDataFrame(DIALOGUES, "d int, turns array<int>, text string, last_turn int")
    groups = spark.createDataFrame(GROUPS, "place int, name string, description string, categories array<string>")
    tree = spark.createDataFrame(TREE, "id string, description string, level string, parent string")
    replies = {
        "domain": {0: '["Number"]', 1: "none", 2: '["Number", "Unheard of"]', 3: '["Number"]', 4: '["Shape"]'},
        "cluster": {0: '["K.NBT.A"]', 2: "{broken", 3: '["K.NBT.A", "K.NBT.A"]'},
        "standard": {0: '{"turn 1": ["K.NBT.A.2", "K.NBT.A.1", "gone"], "turn 2": []}', 3: '{"turn 1": ["K.NBT.A.1"]}'},
        "correctness": {i: '{"turn 1": "true", "turn 2": "na"}' for i in range(5)},
    }
    seen = {}

    def ask(rows, step):
        found = rows.collect()
        seen[step] = {r.d: r.prompt for r in found}
        answer = [(r.d, r.prompt, f'```json{{"result": {replies[step][r.d]}}}```' if replies[step][r.d] != "none" else "none") for r in found]
        return spark.createDataFrame(answer, "d int, prompt string, response string")

    got = {r.d: r for r in tagging.annotate(dialogues, "atc", ask, groups, tree).collect()}
    assert set(seen["domain"]) == set(seen["correctness"]) == set(range(5)) and set(seen["cluster"]) == {0, 2, 3} and set(seen["standard"]) == {0, 3}
    assert "[BEGIN DOMAINS]\n- Name: Number, Description: n\n- Name: Shape, Description: s\n[END DOMAINS]" in seen["domain"][0]
    assert "- ID: K.NBT.A, Description: place value\n- ID: X.1.A, Description: number\n" in seen["cluster"][0]
    assert got[0].annotation["turn 1"].kcs == ["decompose", "compose"] and got[0].annotation["turn 1"].correct and got[0].annotation["turn 2"].kcs == [] and got[0].annotation["turn 2"].correct is None
    assert {i: r.error for i, r in got.items()} == {0: None, 1: N.ERRORS[0], 2: N.ERRORS[0], 3: N.ERRORS[1], 4: N.ERRORS[0]}
    assert got[1].cluster_prompt is None and got[2].cluster is None and got[2].domain == ["Number", "Unheard of"] and got[4].cluster_prompt is None
    with pytest.raises(ValueError, match="unknown source"):
        tagging.annotate(dialogues, "other", ask)


def test_prompts_are_not_written_with_replies(spark, monkeypatch):
    written, stored = [], tagging.stored
    monkeypatch.setattr(tagging, "stored", lambda df, name: written.extend(df.columns) or stored(df, name))
    dialogues = spark.createDataFrame(DIALOGUES, "d int, turns array<int>, text string, last_turn int")
    got = tagging.annotate(dialogues, "base", lambda rows, step: rows.withColumn("response", F.lit('result = {"turn 1": "true"}'))).collect()
    assert not [c for c in written if "prompt" in c] and len(got) == 5 and all(r.correctness_prompt.startswith(r.text) for r in got)
    parents = spark.createDataFrame([(1, "K.NBT"), (1, "K.G"), (1, "K.G"), (2, "K.G"), (2, "K.NBT"), (3, "none"), (4, None)], "d int, id string")
    tree = spark.createDataFrame(TREE, "id string, description string, level string, parent string")
    options = {r.d: r.options for r in N.options_of(parents, tree).collect()}
    assert set(options) == {1, 2} and options[1] == options[2] == sorted(f"ID: {t[0]}, Description: {t[1]}" for t in TREE if t[3] in ("K.NBT", "K.G"))


def test_lists_of_options_are_not_shuffled_by_dialogue(spark):
    dialogues = spark.createDataFrame([(i, [1], f"[BEGIN DIALOGUE]\n{i}\n[END DIALOGUE]", 1) for i in range(300)], "d int, turns array<int>, text string, last_turn int").repartition(3)
    groups, tree = spark.createDataFrame(GROUPS, "place int, name string, description string, categories array<string>"), spark.createDataFrame(TREE, "id string, description string, level string, parent string")
    replies = {"domain": '["Number"]', "cluster": '["K.NBT.A"]', "standard": '{"turn 1": ["K.NBT.A.1"]}', "correctness": '{"turn 1": "true"}'}
    seen, widths, threshold = {}, {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def ask(rows, step, prompts=lambda some: some):
        wanted = spark.range(200).select(F.col("id").cast("int").alias("d")).repartition(2)
        for df in (prompts(rows), prompts(rows.join(wanted, "d"))):
            plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            seen.setdefault(step, []).extend(re.findall(r"Exchange\n(?:Input|Output) \[\d+\]: \[(.*)\]", plan))
        widths[step] = prompts(rows).groupBy(F.spark_partition_id()).count().count()
        return rows.withColumn("response", F.lit(f"result = {replies[step]}"))

    ask.late = lambda rows, prompts, step: ask(rows, step, prompts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tagging.annotate(dialogues, "atc", ask, groups, tree).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 300 and all(r.error is None and r.annotation["turn 1"].kcs == ["compose"] for r in got)
    assert seen["standard"] and not [x for step in ("cluster", "standard") for x in seen[step] if "d#" in re.split("[ ,]", x)[0] and re.search(r"\b(options|prompt)#", x)]
    assert widths["standard"] > 1  # All have the same list.


def test_free_tags_dictionary_and_files(spark):
    dialogues = spark.createDataFrame(DIALOGUES[:3], "d int, turns array<int>, text string, last_turn int")
    kcs = {0: '{"turn 1": ["é", "b"], "turn 2": ["a"]}', 1: '{"turn 1": [], "turn 2": ["c", "b"]}', 2: "?"}

    def ask(rows, step):
        reply = F.element_at(F.create_map(*[F.lit(x) for i, v in kcs.items() for x in (i, v)]), F.col("d")) if step == "kcs" else F.lit('{"turn 1": "false", "turn 2": "true"}')
        return rows.withColumn("response", F.concat(F.lit("result = "), reply))

    annotated = tagging.annotate(dialogues, "base", ask)
    assert {tuple(r) for r in tagging.skill_dictionary(annotated).collect()} == {("é", 0), ("b", 1), ("a", 2), ("c", 3)}
    folder = new_path(spark, "annotated")
    tagging.save_annotations(annotated, "set", "base", "train", folder)
    back = {r.d: r for r in read_csv_strings(spark, annotated_file("set", "base", "train", folder)).collect()}
    assert back["2"].error == N.ERRORS[0] and '"kcs":["é","b"]' in back["0"].annotation and back["1"].kcs_prompt == DIALOGUES[1][2] + "\n\nYour final response should have an entry for exactly 2 turn's (1-2)."
    assert read_ids(spark, dictionary_file("set", "base", folder)).count() == 4


def test_dialogue_arrays(spark):
    turns = [(1, 1, True, ["a", "b"]), (1, 2, None, []), (1, 3, False, ["b"]), (1, 4, True, []), (2, 1, True, ["a"]), (3, 1, None, ["a"])]
    table = spark.createDataFrame(turns, "d int, turn int, correct boolean, kcs array<string>")
    ids = spark.createDataFrame([("b", 0), ("a", 1)], "kc string, kc_id int")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 6.0])], "kc_id int, vector array<float>")
    (r,) = arrays.dialogue_arrays(table, ids, vectors).collect()
    assert (r.d, r.turns, r.labels, r.kc_ids, r.labels_flat, r.kc_ids_flat, r.turn_ends) == (1, [1, 3, 4], [1, 0, 1], [[1, 0], [0], []], [1, 1, 0], [1, 0, 0], [1, 2, 2])
    assert r.kc_means == [[2.0, 4.0], [1.0, 2.0], None]
    assert {x.d for x in arrays.dialogue_arrays(table, ids, at_least=1).collect()} == {1, 2}
    with pytest.raises(Exception, match="no number of the skill a"):
        arrays.dialogue_arrays(table, ids.where("kc = 'b'")).collect()
    gathered = spark.range(1).select(*[arrays.at_turn_ends(F.array(*map(F.lit, (10, 11, 12, 13, 14))), F.array(*map(F.lit, (1, 2, 4))), s).alias(f"s{int(s)}") for s in (False, True)]).head()
    assert gathered.s0 == [11, 12, 14] and gathered.s1 == [12, 13, 14]
    pairs = spark.range(1).select(arrays.next_labels(F.array(*map(F.lit, (0.1, 0.2, 0.3))), F.array(*map(F.lit, (1, 0, 1)))).alias("x"), arrays.next_labels(F.array(F.lit(0.5)), F.array(F.lit(1))).alias("y")).head()
    assert [(x.p, x.label) for x in pairs.x] == [(0.1, 0), (0.2, 1)] and pairs.y == []


def test_vectors_stay_out_of_the_shuffles(spark):
    turns = spark.range(4000).select((F.col("id") % 500).alias("d"), F.floor(F.col("id") / 500).cast("int").alias("turn"), F.lit(True).alias("correct"), F.array(F.lit("a"), F.lit("b")).alias("kcs"))
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "kc string, kc_id int")
    vectors = spark.range(300).select(F.col("id").cast("int").alias("kc_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("vector"))
    # No table is small enough to be sent to all tasks by itself, as with many vectors.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = arrays.dialogue_arrays(turns, ids, vectors)
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 500 and {tuple(v[:2]) for r in got for v in r.kc_means} == {(0.5, 0.5)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_population_invariants_fail_the_job(spark):
    schema = "d int, turn int, pos int, kc string, correct int, split string"
    sound = [(1, 1, 0, "a", 1, "train"), (1, 1, 1, "b", 1, "train"), (1, 2, 0, "a", 0, "train"), (2, 1, 0, "a", 1, "test"), (2, 2, 0, "a", 1, "test")]
    facts = checks.sound_population(spark.createDataFrame(sound, schema), {"dialogues": 2, "observations": 5}).head()
    assert (facts.dialogues, facts.turns, facts.observations, facts.n_correct, facts.least_turns) == (2, 4, 5, 4, 2)
    for broken, message in (((1, 1, 2, "c", 0, "train"), "no mixed turns"), ((1, 3, 0, "c", 2, "train"), "no bad labels"), ((1, 3, 0, "c", None, "train"), "no bad labels"), ((1, 3, 0, "c", 1, "test"), "no shared dialogues"), ((3, 1, 0, "c", 1, "test"), "two turns a dialogue")):
        with pytest.raises(Exception, match=message):
            checks.sound_population(spark.createDataFrame([*sound, broken], schema)).select("turns").collect()
    with pytest.raises(Exception, match="dialogues = 3"):
        checks.sound_population(spark.createDataFrame(sound, schema), {"dialogues": 3}).count()
    assert checks.sound_population(spark.createDataFrame([], schema)).head().dialogues == 0


def test_training_examples(spark):
    said = [(1, 0, "assistant", "no context"), (1, 1, "user", "hi"), (1, 2, "assistant", "é!"), (1, 3, "assistant", None), (2, 0, "assistant", "alone"), (2, 1, "user", "x"), (3, 0, "assistant", "one"), (4, 0, "user", "y" * 50), (4, 1, "assistant", "ok")]
    table = spark.createDataFrame(said, "d int, pos int, role string, content string")
    got = {(r.d, r.pos): r for r in examples.training_examples(table, size=60).collect()}
    assert set(got) == {(1, 2), (1, 3)}  # no assistant after the first, or too long
    context = "assistant: no context\nuser: hi\n"
    assert "".join(map(chr, got[1, 2].ids)) == f"{context}assistant: é!" and got[1, 2].labels == [IGNORED] * len(context + "assistant: ") + [ord("é"), ord("!")] + [IGNORED] * (60 - len(got[1, 2].ids))
    assert "".join(map(chr, got[1, 3].ids)) == f"{context}assistant: é!\nassistant: " and set(got[1, 3].labels) == {IGNORED}
    assert {r.d for r in examples.eligible(table).collect()} == {1, 4}
