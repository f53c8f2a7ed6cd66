"""Annotations, prompts, ratings, guards and files on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from mentora.functions import prompts as P
from mentora.functions import text as T
from mentora.operators import annotations as N
from mentora.operators import bkt, metrics
from mentora.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_failures_in_order(spark):
    rows = [([1], None, {"turn 1": "true"}), ([1], {"turn 1": ["a"]}, {}), ([0, 1, 2], {"turn 1": ["a"]}, {"turn 1": "na"}), ([0, 1], {"turn 1": ["a"]}, {"turn 1": "true"}), ([], {}, {})]
    got = N.merge_replies(spark.createDataFrame(rows, "turns array<int>, kcs map<string,array<string>>, correctness map<string,string>")).collect()
    assert [r.error for r in got] == [*N.ERRORS, None, None]
    assert got[3].annotation["turn 1"].correct is True and got[4].annotation == {}


def test_labels_need_skills_and_the_other_way_round(spark):
    schema = "d int, turns array<int>, annotation map<string,struct<correct:boolean,kcs:array<string>>>, error string, self_correctness string, expected_result string"
    rows = [(1, [0, 1, 2], {"turn 1": (True, []), "turn 2": (False, ["a"])}, None, "Yes", "no"), (2, [1], {"turn 1": (None, ["a"])}, None, "Yes", "Answer Accepted"), (3, [1], None, "failed", None, None)]
    table = spark.createDataFrame(rows, schema)
    of = lambda **k: [(r.d, r.turn, r.og, r.correct, r.kcs) for r in N.label_turns(table, **k).orderBy("d", "turn").collect()]
    assert of() == [(1, 0, None, None, []), (1, 1, None, None, []), (1, 2, False, True, ["a"]), (2, 1, None, None, [])]
    assert of(outcome="expected_result", apply_na=False) == [(1, 0, None, None, []), (1, 1, True, True, []), (1, 2, False, False, ["a"]), (2, 1, None, True, ["a"])]
    missing = spark.createDataFrame([(1, [1], {}, None, "Yes", "")], schema)
    assert N.label_turns(missing, strict=False).head().og is None
    with pytest.raises(Exception, match="no annotation of turn 1"):
        N.label_turns(missing).collect()


def test_texts(spark):
    assert one(spark, T.fold_content(F.array(F.lit("Go on"), F.lit("\tGo on\n")))) == "Go on"
    assert one(spark, T.lm_json(F.lit("```json{bad}```"))) is None
    assert one(spark, T.lm_json(F.lit('```json{"result": {"a": 1}}```'))) == '{"a":1}'
    assert one(spark, P.last_answer(F.lit("x = 1\n so\\n 42 "))) == "42"
    assert [one(spark, P.first_name(F.lit(x))) for x in (" Ana is", "", None)] == ["Ana", "Student", "Student"]
    assert one(spark, P.masked_labels(F.array(*map(F.lit, (5, 6, 7))), F.lit(2), F.lit(5))) == [-100, -100, 7, -100, -100]
    with pytest.raises(ValueError):
        P.described("where {desc}", "other")


def test_messages_follow_once(spark):
    m = lambda *rows: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in rows])
    made = lambda x: one(spark, P.prepared_messages(x, F.lit("Bo is"), F.lit("4"), F.lit("5")))
    rows = made(m(("system", P.PROBLEM_LINE), ("user", "5"), ("assistant", "no")))
    assert [r.role for r in rows] == ["system", "user", "assistant"] and "name Bo," in rows[0].content and rows[0].content.endswith("follows:\n4\n")
    assert [r.content for r in made(m(("user", "a"), ("assistant", "b")))] == ["a", "5", "b"]
    assert made(m(("user", "a"))) is None


def test_guards(spark):
    assert one(spark, bkt.forward(F.array(F.lit(0), F.lit(1)), F.lit(1.0), F.lit(0.1), F.lit(0.2), F.lit(0.0))) == [1.0, 1.0]
    same = spark.createDataFrame([(2, 2), (2, 2)], "a int, b int")
    assert metrics.pair_agreement(same, (("a", "b"),)).head().qwk is None and metrics.krippendorff_interval(same, ("a", "b")).head().alpha is None


def test_file_round_trips(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "all.json").write_text(json.dumps([{"level": "a", "n": 1}, {"level": "Calculus", "n": 2}, {"level": "b", "n": 3}]))
    assert [tuple(r) for r in S.read_json_array(spark, at("all.json"), "level string, n int", {"level": "Calculus"}).collect()] == [(0, "a", 1), (2, "b", 3)]
    S.write_ids(spark.createDataFrame([("é", 1), ("a", 0)], "name string, id int"), at("ids"))
    assert {tuple(r) for r in S.read_ids(spark, at("ids")).collect()} == {("a", 0), ("é", 1)}
    literal = S.parse_literals(spark.createDataFrame([("{'a': None, 'b': [1, 2]}",), ("{broken",), (None,)], "x string"), {"x": "struct<a:string,b:array<int>>"})
    assert [r.x and r.x.b for r in literal.collect()] == [[1, 2], None, None]
    S.write_csv(spark.createDataFrame([("q \"x\"\nline", [1]), ("", [])], "t string, l array<int>").coalesce(1), at("csv"))
    assert {tuple(r) for r in S.read_csv_strings(spark, at("csv")).collect()} == {("q \"x\"\nline", "[1]"), ("", "[]")}
    assert {tuple(r) for r in S.later_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, fold int, v string"), "k", "fold").collect()} == {(1, 2, "b")}
    assert [tuple(r) for r in S.separated(spark.createDataFrame([(1, 1), (2, 1)], "d int, turn int"), "d", "turn").collect()] == [("1", "1"), ("", ""), ("2", "1"), ("", "")]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "dialogue_7.json").write_text('{"turn 2": {"label": "present", "reason": "r"}}')
    assert [tuple(r) for r in S.read_label_cache(spark, at("cache")).collect()] == [(7, 2, "present", "r")]
    assert S.annotated_file("x", "base", "train") == "data/annotated/x_train_base.csv"
