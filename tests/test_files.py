import pytest

from mentora.sources import datasets, reports
from mentora.sources.files import annotated_file, new_path, read_jsonl, split_conversation, typical, write_csv, write_jsonl


def test_jsonl_round_trip_and_typicality(spark, tmp_path):
    rows = [("a", 1, 2), ("é\n", None, 3), ("c", 0, 1)]
    write_jsonl(spark.createDataFrame(rows, "q string, x int, y int"), f"{tmp_path}/out")
    got = read_jsonl(spark, f"{tmp_path}/out", "q string, x int, y int")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert [r.q for r in typical(got, "x", "y").collect()] == ["a"]


def test_split_conversation(spark):
    text = "Teacher: (focus)What is it?|EOM|Bo: It: is 3|EOM|Teacher: (Big) ok"
    got = split_conversation(spark.createDataFrame([(1, text), (2, None)], "d long, c string"), "d", "c").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "teacher", "What is it?"), (1, 1, "student", "It: is 3"), (1, 2, "teacher", "(Big) ok")]


def test_unknown_data_sets_and_folds_raise(spark):
    with pytest.raises(ValueError, match="no loader of the data set other"):
        datasets.load_dialogues(spark, "other")
    with pytest.raises(ValueError, match="no annotated files of the data set other"):
        datasets.load_annotated(spark, "other", "base")


def test_line_index_counts_all_lines_of_a_file_in_order(spark):
    path = new_path(spark, "lines")
    spark.range(1000).selectExpr("concat('line ', id) AS value").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of one file
    try:
        got = {r["index"]: r["value"] for r in datasets.with_line_index(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"line {i}" for i in range(1000)}


def test_line_data_set_with_hard_rows(spark):
    said = "Teacher: (focus)What?|EOM|Sam: I see|EOM|Teacher: Good"
    rows = [(said, 2, 1), (said, 0, 1), (said, None, 1), ("", 1, 1), (None, 1, 1)]
    folder = new_path(spark, "src")
    table = spark.createDataFrame(rows, "conversation string, `self-typical-confusion` int, `self-typical-interactions` int").coalesce(1)
    table.write.json(f"{folder}/mathdial/data/test.jsonl")
    got = {r["index"]: r for r in datasets.load_dialogues(spark, "mathdial", folder, "test").collect()}
    assert set(got) == {0, 3} and [tuple(t) for t in got[0].dialogue] == [(1, "What?", "I see")] and got[0].meta_data.self_typical_confusion == 2
    assert got[3].dialogue == []


def test_annotated_slices_by_fold_and_subject(spark):
    folder = new_path(spark, "annotated")
    rows = spark.createDataFrame([(str(i), f'{{"math_level": "{("Algebra", "Geometry")[i % 4 == 0]}"}}') for i in range(20)], "index string, meta_data string")
    write_csv(rows, annotated_file("comta", "base", folder=folder))
    for fold, sizes in ((1, {"train": 13, "validation": 3, "test": 4}), (4, {"train": 13, "validation": 3, "test": 4}), ("Geometry", {"train": 12, "validation": 3, "test": 5})):
        back = datasets.load_annotated(spark, "comta", "base", folder, fold).collect()
        assert {s: sum(r.slice == s for r in back) for s in sizes} == sizes and len({r["index"] for r in back}) == 20
    with pytest.raises(ValueError, match="no fold 6"):
        datasets.load_annotated(spark, "comta", "base", folder, 6)


def test_guarded_files_and_the_chain_of_ids(spark):
    ids = spark.createDataFrame([(3,), (1,), (3,)], "d long")
    path = new_path(spark, "ids")
    assert not reports.write_once(ids, path, write=False)
    with pytest.raises(ValueError, match="none in memory"):
        reports.pinned_ids(spark, path, None)
    rows, source = reports.pinned_ids(spark, path, None, ids)
    assert source == "1" and sorted(r.d for r in rows.collect()) == [1, 3]
    reports.write_pinned_ids(ids, path, seed=23, target=13)
    rows, source = reports.pinned_ids(spark, path, ids.where("d = 1"))
    assert source == "file" and [r.d for r in rows.collect()] == [1, 3] and spark.read.text(path).head().value == '{"seed":23,"target":13,"dialogue_ids":[1,3]}'
    assert reports.write_once(ids, f"{path}-csv")
    for again in (lambda: reports.write_once(ids, f"{path}-csv"), lambda: reports.write_pinned_ids(ids, path)):
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            again()
