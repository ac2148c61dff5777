import posixpath

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "yes_no", "letters", "expected"),
    [
        ("<answer> b </answer>", False, "ABCD", "B"),
        ("The answer is A. final answer: d", False, "ABCD", "D"),
        ("prose about a vehicle, options A to D", False, "ABCD", ""),
        ("<answer>Yes.</answer>", True, "ABCD", "Yes"),
        ("<answer>J</answer>", False, "ABCDEFGHIJ", "J"),
        ("<answer>J</answer>", False, "ABCD", "J"),
        ("<answer></answer> so the answer would be (C)", False, "ABCD", "C"),
        ("answer: no, then the answer is yes", True, "ABCD", "Yes"),
        ("<answer>maybe</answer>", True, "ABCD", "maybe"),
        ("", False, "ABCD", ""),
    ],
)
def test_parse_choice(spark, text, yes_no, letters, expected):
    assert one(spark, X.parse_choice(F.lit(text), F.lit(yes_no), F.lit(letters))) == expected


@pytest.mark.parametrize(("text", "yes_no", "expected"), [("Bad", False, "B"), ("Cannot", False, "C"), (" yes", True, "Yes"), ("xyz", False, "XYZ")])
def test_gold(spark, text, yes_no, expected):
    assert one(spark, X.gt_choice(F.lit(text), F.lit(yes_no), F.lit("ABCD"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("<think> a\nb </think>c", "a\nb"), ("trace</think><answer>A</answer>", "trace"), ("none", ""), ("<think>open", "")])
def test_think(spark, text, expected):
    assert one(spark, X.extract_think(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [("<score>1.7</score>", 1.0), ("first 0.2 then 0.85", 0.85), ("none", None), ("<score> .5 </score>", 0.5)])
def test_judge_score(spark, text, expected):
    assert one(spark, X.judge_score(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [("NO, well YES", "YES"), ("<verdict>partial</verdict> NO", "PARTIAL"), ("unclear", "NO"), ("No. Partially PARTIAL", "PARTIAL")])
def test_verdict(spark, text, expected):
    assert one(spark, X.verdict(F.lit(text))) == expected


@pytest.mark.parametrize(
    ("text", "top1", "ids", "tag"),
    [
        ("SELECTED: 1, 2, and 4", False, [1, 2, 4], None),
        ("SELECTED: 1-3", False, [1, 2, 3], None),
        ("SELECTED: 3–2", False, [2, 3], None),
        ("SELECTED: all", False, [1, 2, 3, 4], None),
        ("garbage", False, [1, 2, 3, 4], "fallback:all"),
        ("garbage", True, [1], "fallback:first"),
        ("I like video 9, Video 3 and Video 2", True, [3], "fallback:video_mentions"),
        ("BEST: 4, 2", True, [2], None),
        ("<think>SELECTED: 2</think> SELECTED: 3\nSELECTED: 4\n1", False, [4], None),
        ("<think>SELECTED: 2", False, [2], None),
    ],
)
def test_selection(spark, text, top1, ids, tag):
    got = one(spark, X.selection(F.lit(text), F.lit(4), top1))
    assert (got["ids"], got["tag"]) == (ids, tag)


def test_options(spark):
    array = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, X.option_count(array("A. x, B. y, C. z, D. w"))) == 4
    assert one(spark, X.option_count(array("only A. one"))) == 1
    assert one(spark, X.is_yesno(array())) is True
    assert one(spark, X.is_yesno(array("Yes.", "No."))) is True
    assert one(spark, X.is_yesno(array("A. Yes"))) is False


def test_letters_and_numbers(spark):
    options = F.array(*map(F.lit, ["A. x", "B. y"]))
    assert one(spark, X.extract_letter(F.lit("I think z, or b"), options)) == "b"
    assert one(spark, X.extract_letter(F.lit("ANSWER: (C)"), options)) == "c"
    assert one(spark, X.extract_letter(F.lit(" 12"), options)) == "1"
    assert one(spark, X.extract_number(F.lit("Answer: -3.5 of 9"))) == "-3.5"
    assert one(spark, X.extract_number(F.lit("none "))) == "none"
    assert one(spark, X.claims(F.lit("1. one\n\n - two\n* three"))) == ["one", "two", "three"]
    assert one(spark, X.letters_phrase(F.lit("ABCDEFGHIJ"))) == "A, B, ..., or J"
    assert one(spark, X.letters_phrase(F.lit("ABC"))) == "A, B, or C"
    assert one(spark, X.pycap(F.lit("yES no"))) == "Yes no"
    assert [one(spark, X.clean_null(F.lit(x))) for x in (" None ", "", "null", " a ")] == [None, None, None, "a"]


def test_fixed_is_printf(spark):
    values = [34.55, 154.45, 0.25, 0.35, 2.5, 3.5, 0.05, 99.95, -1.25, 0.0, 1e-9, 12345.675, 0.125, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2):
        got = [r[0] for r in df.select(X.fixed(F.col("x"), places)).collect()]
        assert got == [f"{v:.{places}f}" for v in values]


def test_normpath(spark):
    paths = ["a//b/./c", "a/../b", "../a/..", "/../a", "", "./", "a/b/../../..", "/"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(X.normpath(F.col("p"))).collect()]
    assert got == [posixpath.normpath(p) for p in paths]


def test_normalized(spark):
    broken = '{"question": "Is "it" so?",\n "options": {"A": "x",\n "B": "y"\n },\n "correct_option": "C"}'
    rows = [(broken, "null"), (broken, '"A"'), ("{broken", '""'), ("plain", '{"correct_option": "", "answer": "D"}'), ("plain", "{}"), ("plain", None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "q string, a string").select(X.normalized(F.col("q"), F.col("a")).alias("n")).select("n.*").collect()]
    assert got == [
        ('Is "it" so?', "C", ["double_encoded_question"]), ('Is "it" so?', "A", ["double_encoded_question"]), ("{broken", None, ["unparseable_question_json", "missing_answer"]),
        ("plain", "D", ["dict_answer"]), ("plain", None, ["dict_answer", "missing_answer"]), ("plain", None, ["missing_answer"]),
    ]


def test_current_summary(spark):
    lines = ['{"summary": "s"}', '{"summary": "s", "prompt_ver": null}', '{"summary": "s", "prompt_ver": "v1", "error": null}', '{"summary": "s", "prompt_ver": "v2"}', '{"summary": ""}', '{"summary": "s", "error": "x"}', "no json"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(F.coalesce(X.current_summary(F.col("x"), "v1"), F.lit(False))).collect()]
    assert got == [True, False, True, False, False, False, False]
