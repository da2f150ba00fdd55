"""Template tokens/faults and path functions on the reference's cases."""

import pytest
from pyspark.sql import functions as F

from provenant.functions import paths as P
from provenant.operators import steps as S


def kinds(spark, text, step="s"):
    df = spark.createDataFrame([(step, 0, text)], "step string, arg_pos int, arg string")
    t = S.classify_tokens(S.template_tokens(df)).orderBy("tok_pos").collect()
    return [(r.kind, r.name, r.loc, r.token if r.kind == "literal" else None) for r in t]


def faults(spark, text):
    df = spark.createDataFrame([("s", 0, text)], "step string, arg_pos int, arg string")
    return sorted((r.fault, r.detail) for r in S.template_faults(df).collect())


def test_token_kinds(spark):
    assert kinds(spark, "foo") == [("literal", None, None, "foo")]
    assert kinds(spark, "{shared}") == [("shared", None, None, None)]
    assert kinds(spark, "{inputs}") == [("step", "s", "inputs", None)]
    assert kinds(spark, "{outputs}") == [("step", "s", "outputs", None)]
    assert kinds(spark, "{variables.foo}") == [("variable", "foo", None, None)]
    assert kinds(spark, "{steps.foo.inputs}") == [("step", "foo", "inputs", None)]
    assert kinds(spark, "{steps.foo.outputs}") == [("step", "foo", "outputs", None)]
    # the literal before the first '{' keeps its first character
    assert kinds(spark, "ab{shared}/x") == [("literal", None, None, "ab"), ("shared", None, None, None),
                                              ("literal", None, None, "/x")]


@pytest.mark.parametrize("text,expected", [
    ("{step}", [("unknown_word", "step")]),
    ("{fo{}", [("nested_open", None), ("unknown_word", "")]),
    ("foo{bar", [("unclosed_open", None)]),
    ("foo}bar", [("unopened_close", None)]),
    ("{shared}/ok", []),
])
def test_template_faults(spark, text, expected):
    assert faults(spark, text) == expected


def test_closure_includes_itself_and_detects_cycles(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "step string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "step string, depends_on string")
    clo = {(r.step, r.upstream): r.depth for r in S.step_closure(names, edges).collect()}
    assert clo == {("a", "a"): 0, ("b", "b"): 0, ("c", "c"): 0, ("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 2}
    cyc = spark.createDataFrame([("a", "b"), ("b", "a")], "step string, depends_on string")
    with pytest.raises(ValueError):
        S.step_closure(names, cyc)


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([vals], schema)
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize("path,name", [
    ("a/b/c.txt", "c.txt"), ("/a/b/", "b"), ("/", None), ("..", None), ("a/..", None), (".", None),
    ("a/./", "a"), ("", None),
])
def test_file_name(spark, path, name):
    assert one(spark, P.file_name("a"), path) == name


@pytest.mark.parametrize("path,dir_,rel", [
    ("data/foo.bar", "data/expected", "../foo.bar"),
    ("/a/b/c", "/a/b", "c"),
    ("/a/b/c", "/a/x/y", "../../b/c"),
    ("a/b", "./", "a/b"),
    ("/abs", "rel", "/abs"),
    ("rel", "/abs", None),
    ("a/b", "a/b", ""),
])
def test_relativize(spark, path, dir_, rel):
    assert one(spark, P.path_relativize("a", "b"), path, dir_, schema="a string, b string") == rel


def test_path_struct(spark):
    df = spark.createDataFrame([("x/y.txt", "/base"), ("/abs/y.txt", None), ("x/y.txt", None)], "p string, b string")
    r = df.select(P.make_path("p", "b").alias("s")).select(
        P.path_full("s").alias("full"), P.path_compact("s").alias("compact"),
        P.path_base_dir("s").alias("base"), F.col("s.kind").alias("kind")).collect()
    assert [tuple(x) for x in r] == [
        ("/base/x/y.txt", "x/y.txt", "/base", "relative"),
        ("/abs/y.txt", "/abs/y.txt", "/abs", "absolute"),
        (None, None, None, "relative_incomplete"),
    ]
    assert one(spark, P.path_normalize("a"), "//a//./b/") == "/a/b"
    assert one(spark, P.path_normalize("a"), "./x/./y") == "./x/y"
