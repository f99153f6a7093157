import gzip
import json
import os

import pytest

from hintloom.sources import jsonl as J


def lines(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_jsonl(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    lines(p, [{"id": "x", "n": 1}, "", {"n": 2, "extra": 3}, "{bad"])
    with pytest.raises(Exception):  # noqa: B017, PT011
        J.read_jsonl(spark, p, "id string, n int").collect()
    assert [(r.id, r.n) for r in J.read_jsonl(spark, p, "id string, n int", strict=False).collect()] == [("x", 1), (None, 2)]
    assert J.read_jsonl(spark, str(tmp_path / "none.jsonl"), "n int").collect() == []
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"n": 5}\n')
    assert [r.n for r in J.read_jsonl(spark, str(tmp_path / "b.jsonl.gz"), "n int").collect()] == [5]


def test_numbered(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    lines(p, [{"question_id": "k", "n": 1}, "", {"id": "other", "n": 2}, {"n": 3}])
    got = J.read_numbered(spark, p, "question_id string, id string, n int").orderBy("n").collect()
    assert [(r.line_no, r.question_id) for r in got] == [(0, "k"), (2, "other"), (3, "q_3")]


def test_arrays_keys_and_names(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": 2}]')
    assert sorted(r.n for r in J.read_json_array(spark, str(tmp_path / "a.json"), "n int").collect()) == [1, 2]
    for name, text in (("l.jsonl", '{"key": "b"}\n{"key": "a"}\n{"key": "b"}'), ("l.json", '["b", "a", "b"]'), ("d.json", '{"keys": [{"id": "b"}, {"id": "a"}]}')):
        (tmp_path / name).write_text(text)
        assert [(r.key, r.pos) for r in J.read_keys(spark, str(tmp_path / name)).orderBy("pos").collect()] == [("b", 0), ("a", 1)]
    lines(str(tmp_path / "gen_tale_oss_120b.jsonl"), [{"n": 1}])
    r = J.with_file_parts(spark.read.schema("n int").json(str(tmp_path / "gen_*.jsonl")), ["kind", "prompt", "model"]).first()
    assert (r.kind, r.prompt, r.model) == ("gen", "tale", "oss_120b")


def test_first_row_key(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 0, "b"), ("g", 5, "c")], "file string, line int, mode string")
    assert {(r.file, r.line): r.file_mode for r in J.first_row_key(df, "file", "line", ["mode"]).collect()} == {("f", 1): "b", ("f", 0): "b", ("g", 5): "c"}


def test_logs_and_trees(spark, tmp_path):
    (tmp_path / "run.log").write_text("start\n1/10 done\n7/10 done\nnoise\n")
    assert [tuple(r) for r in J.log_progress(spark, str(tmp_path / "run.log")).collect()] == [("run.log", 7, 10)]
    os.makedirs(tmp_path / "t" / ".git")
    (tmp_path / "t" / "a.py").write_text("x\nkey = 'fk1.abc'\n")
    (tmp_path / "t" / ".git" / "b.py").write_text("fk1.abc\n")
    assert [(os.path.basename(r.path), r.line) for r in J.scan_tree(spark, str(tmp_path / "t"), r"fk\d+\.", (".py", ".sh")).collect()] == [("a.py", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "n int, t string")
    assert J.append_filled(df, str(tmp_path / "out"), "t") == 2
    assert [r.n for r in spark.read.json(str(tmp_path / "out")).collect()] == [1]
    J.replace_table(df, str(tmp_path / "t"))
    J.replace_table(spark.read.parquet(str(tmp_path / "t")).where("n > 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert not J.write_csv(df.limit(0), str(tmp_path / "e.csv"))
    assert J.write_csv(df.limit(1), str(tmp_path / "d.csv")) and (tmp_path / "d.csv").read_text().splitlines() == ["n,t", "1,a"]
    J.write_report(str(tmp_path / "r.md"), {"One": df})
    J.write_report(str(tmp_path / "r.md"), {"Two": df.limit(1)})
    assert "## One" in (tmp_path / "r.md.bak").read_text() and "| 1 | a |" in (tmp_path / "r.md").read_text()
    J.write_json_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0] == {"n": 1, "t": "a"}
    J.write_partitions(df, str(tmp_path / "p"), "n")
    assert os.path.isdir(tmp_path / "p" / "n=1")
    J.write_jsonl(df, str(tmp_path / "z"), gzip=True)
    assert spark.read.json(str(tmp_path / "z")).count() == 3
