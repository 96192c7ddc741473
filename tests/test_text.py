"""Hand-derived cases for reading answers, tags and prompts."""

import pytest
from pyspark.sql import functions as F

from promptmill.functions import names, text as tx
from promptmill.functions import templates as tp
from promptmill.functions.grading import came_back, grade

STRICT = [
    (r"\boxed{c} but answer is A", "C"), ("The answer is (B). (C) is wrong", "B"), ("(A) no. Finally (D)", "D"),
    ("A is wrong so D", "D"), ("this is a test", "A"), ("Answer: (C) then the answer is D", "D"),
    ("The answer is Answer: B", "B"), ("xyz", None), ("Bx", "B"), ("", None), ("answer is", "A"),
    ("The answer is unknown.", None), ("éa bébé ècolé", None), ("(E) only", "E"), ("OPTION: c", "C"),
    ("\\BOXED{\u2003d\u00a0}", "D"), ("choice: x (b) (c)", "B"), ("Option: a. Choice: (b)", "B"), ("Option: a. Choice: b", "A"),
    ("answer is b. option: (c)", "C"), ("so_a and b_", None), ("\u3000 b \u3000", "B"), ("F and 7", "A"), ("F plus 7", None),
    ("x" * 50_000 + " (A) " + "y" * 50_000, "A"), (" " * 50_000 + "zz", None), (None, None),
]
LOOSE = [
    ("The answer is (B). (C) is wrong", "C"), ("this is a test", "A"), ("The answer is unknown.", "A"),
    ("(E) only", None), ("Answer: (C) then the answer is D", "D"), ("", None), ("Option xyz", None), ("Choice", "C"),
]
NUMBERS = [
    ("Total is 1,234.50 dollars", 1234.5), ("3-4", -4.0), ("42.", 42.0), ("#### 72", 72.0), ("1.2.3", 3.0),
    ("no number", None), ("", None), ("9" * 400, float("inf")), ("5 and -0.25!", -0.25), ("-", None),
]


def _check(spark, cases, expr, schema="string"):
    df = spark.createDataFrame(cases, f"t string, want {schema}").withColumn("got", expr)
    assert df.where("not (want <=> got)").collect() == []


def test_strict_choice(spark):
    df = spark.createDataFrame(STRICT, "t string, want string")
    assert tx.with_strict_choice(df, "t", "got").where("not (want <=> got)").collect() == []


def test_loose_choice(spark):
    _check(spark, LOOSE, tx.loose_choice(F.col("t")))


def test_last_number(spark):
    _check(spark, NUMBERS, tx.last_number(F.col("t")), "double")


def test_strip_removes_what_python_does(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    assert set(tx.WHITESPACE) == set(blanks)
    _check(spark, [(b + "x y" + b, "x y") for b in blanks] + [("\u200bx", "\u200bx")], tx.strip(F.col("t")))


def test_grade_by_type(spark):
    rows = [
        ("math", "so 1,000.0000001", "1000", "correct"), ("math", "so 1001", "1000", "wrong"),
        ("math", "none", "1000", "wrong"), ("math", "9" * 400, "9" * 400, "wrong"),
        ("multiple_choice", "(b)", " b ", "correct"), ("multiple_choice", "(E)", "D", "wrong"),
        ("multiple_choice", "???", "A", "wrong"), ("general", " yes\n", "yes ", "correct"),
        ("other", "Yes", "yes", "wrong"), ("math", None, "1", "failed"), ("multiple_choice", "", "A", "wrong"),
    ]
    df = spark.createDataFrame(rows, "type string, raw_output string, answer string, want string")
    assert grade(df).where("outcome <> want").collect() == []
    assert grade(came_back(df)).count() == len(rows) - 1
    with pytest.raises(ValueError):
        grade(df, "other")


def test_grading_is_one_generated_stage(spark):
    df = spark.createDataFrame([("math", "1", "1")], "type string, raw_output string, answer string")
    for grader in ("strict", "loose"):
        plan = grade(df, grader)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert plan.startswith("Found 1 WholeStageCodegen subtrees")


def test_tag_blocks(spark):
    rows = [
        ("<REWRITE_BEGIN> a\nb </REWRITE_END>x<rewrite_begin>c</rewrite_end>", ["a\nb", "c"]),
        ("<REWRITE BEGIN>a</REWRITE END>", ["a"]), ("<REWRITE_BEGIN>a</REWRITE_END><REWRITE BEGIN>b</REWRITE END>", ["a"]),
        ("<REWRITE BEGIN>a</REWRITE_END>", ["a"]), ("<REWRITE_BEGIN>open", []), ("", []), (None, []),
    ]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert tx.with_tag_blocks(df, "t", "REWRITE", "got").where("not (want <=> got)").collect() == []


def test_generated_prompts(spark):
    response = "\n".join([
        "Here are some:", "1. Think about x (a) first", "short", "2) Check each step. Twice", '"Quoted line here"',
        "'\"Mixed quotes here\"'", "''''''''''''", "123456789012.", "  plain and long enough  "])
    want = ["Think about x (a) first".split(")", 1)[-1].strip(), "Twice", "Quoted line here", '"Mixed quotes here"', "",
            "plain and long enough"]
    df = spark.createDataFrame([(response,)], "t string")
    assert df.select(tx.generated_prompts(F.col("t"))).first()[0] == want
    assert df.select(tx.generated_prompts(F.col("t"), 2)).first()[0] == want[:2]


def test_prompt_lines_keep_order_and_drop_escapes(spark):
    df = spark.createDataFrame([("b\r\n\n \\sss a\rc\\s ",)], "t string")
    assert df.select(tx.prompt_lines(F.col("t"))).first()[0] == ["b", " a", "c\\s"]


def test_cuts_and_listing(spark):
    rows = [("x" * 300,), ("x" * 301,), ("it's",), ('say "it\'s"',), ("tab\t\\",)]
    got = spark.createDataFrame(rows, "t string").select(
        tx.snippet(F.col("t")), tx.label(F.col("t")), tx.python_repr(F.col("t"))).collect()
    for (value,), (cut, label, shown) in zip(rows, got):
        assert cut == (value[:300] + "..." if len(value) > 300 else value)
        assert label == value[:100] + "..."
        assert shown == repr(value)


def test_choice_question_and_letter(spark):
    rows = [(["w", "x"], 1, "q\n(A) w\n(B) x\nAnswer:", "B"), ([], -1, "q\nAnswer:", None),
            (["1", "2", "3", "4", "5"], 4, "q\n(A) 1\n(B) 2\n(C) 3\n(D) 4\nAnswer:", None)]
    df = spark.createDataFrame(rows, "c array<string>, a int, q string, l string")
    assert df.where((tx.choice_question(F.lit("q"), F.col("c")) != F.col("q"))
                    | ~tx.choice_letter(F.col("a")).eqNullSafe(F.col("l"))).collect() == []


def test_percent_has_two_decimals(spark):
    rows = [(c, n) for n in (1, 3, 7, 253) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "c long, n long")
    for (c, n), got in zip(rows, df.select(tx.percent(F.col("c"), F.col("n"))).collect()):
        assert got[0] == f"{c / n * 100:.2f}"


def test_fill_is_literal(spark):
    df = spark.createDataFrame([("has {num} and {", )], "r string")
    got = df.select(tp.fill(F.lit("{num}: {rules_block} {x}"), {tp.COUNT: F.lit("3"), tp.RULES: F.col("r")})).first()[0]
    assert got == "3: has {num} and { {x}"
    assert df.select(tp.outcome_block(F.lit(""), F.lit("a\nb"))).first()[0] == "Correct:\nNone\n---\nWrong:\na\nb"


def test_run_names_both_ways(spark):
    paths = [
        ("runs/small-7b_large-32b_MMLU_5Sub_Lim100_Iter_5_20251213-112715/status.csv",
         ("small-7b", "large-32b", "MMLU", "5Sub", 100, "Iter", 5, "20251213-112715")),
        ("X_small-7b_large-32b_MMLU_All_Lim-1_Base_0_20251225-151857",
         ("small-7b", "large-32b", "MMLU", "All", -1, "Base", 0, "20251225-151857")),
        ("small-7b_large-32b_MMLU_5Sub_Lim100_Base_20251213-161414",
         ("small-7b", "large-32b", "MMLU", "5Sub", 100, "Base", None, "20251213-161414")),
        ("out/small-7b_large-32b_Limit100_IterOn_5_20251213-112715_validation_eval.txt",
         ("small-7b", "large-32b", None, None, 100, "Iter", 5, "20251213-112715")),
        ("small-7b_large-32b_Limit100_IterOff_20251213-161414_validation_eval.txt",
         ("small-7b", "large-32b", None, None, 100, "Base", None, "20251213-161414")),
    ]
    df = spark.createDataFrame([(p,) for p, _ in paths], "path string").select(*names.run_parts(F.col("path")))
    assert [tuple(r) for r in df.collect()] == [want for _, want in paths]
    built = spark.range(1).select(names.run_name(
        F.lit("s:7b"), F.lit("l:32b"), F.lit("gsm8k"), F.lit(""), F.lit(10), F.lit(False), F.lit(5),
        F.to_timestamp_ntz(F.lit("2025-12-13 16:14:14")), "P")).first()[0]
    assert built == "P_s-7b_l-32b_GSM8K_NA_Lim10_Base_0_20251213-161414"
