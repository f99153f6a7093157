import hashlib

from oracle import SF_DIR

from hintloom.operators.judging import pick_code
from hintloom.plans import registry, text_queries

assert text_queries


def test_every_response_gets_an_answer(spark, tmp_path):
    rows = [(1, "\u00a0"), (2, "Answer:\u00a05\u00a0\nbye"), (3, "\u00a0Final\u00a0answer: 7\nbye"), (4, "so\u00a0the answer is\u00a08\nbye"), (5, "a\u00a0b\n\u00a0last line\u00a0"), (6, None), (7, "\\\\boxed{ 9\u00a0}\nbye".replace("\\\\", "\\")), (8, "plain")]
    spark.createDataFrame(rows, "line_no bigint, model_response string").write.parquet(f"{tmp_path}/sample_source_cot.parquet")
    got = {r.line_no: r.final_answer for r in registry.QUERIES["answer_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "5", 3: "7", 4: "8", 5: "last line", 6: "", 7: "9", 8: "plain"}


def test_no_row_is_left_out(spark):
    assert registry.QUERIES["answer_extract"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/sample_source_cot.parquet").count()


def md5(code):
    return hashlib.md5(code.encode()).hexdigest()


def extracted(spark, sf_dir):
    return {r.line_no: (r.lang, r.code) for r in registry.QUERIES["code_extract"](spark, sf_dir).collect()}


def test_code_of_all_kinds_of_outputs(spark, tmp_path):
    rows = [
        (1, " print(1) \n"), (2, "see\n```\nx = 1\n```"), (3, "```C++\nint a;\n```"), (4, "```Python\na\n```\nor\n```py\nlonger = 2\n```"),
        (5, "```cpp\nint main() {"), (6, "```rust\nfn main() {}\n```\n```\ny\n```"), (7, "```python\na\n```\n```\nmuch longer text\n```"), (8, ""), (9, None),
    ]
    spark.createDataFrame(rows, "line_no bigint, flash_output string").write.parquet(f"{tmp_path}/joined_sample.parquet")
    want = {1: (None, "print(1)"), 2: (None, "x = 1"), 3: ("cpp", "int a;"), 4: ("python", "longer = 2"), 5: (None, "```cpp\nint main() {"), 6: (None, "y"), 7: ("python", "a"), 8: (None, "")}
    assert extracted(spark, str(tmp_path)) == {k: (lang, md5(code)) for k, (lang, code) in want.items()} | {9: (None, None)}


def test_code_of_all_rows_equals_the_judge(spark):
    rows = spark.read.parquet(f"{SF_DIR}/joined_sample.parquet").select("line_no", "flash_output").collect()
    want = {r.line_no: (lang, md5(code)) if r.flash_output is not None else (None, None) for r in rows for lang, code in [pick_code(r.flash_output)]}
    assert extracted(spark, SF_DIR) == want and len(want) == len(rows)
