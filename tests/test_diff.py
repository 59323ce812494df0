import datetime as dt
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import framekit as fk
from framekit import methods


@pytest.fixture(scope="module")
def pair(spark):
    left = spark.createDataFrame([(10, "oak"), (20, "elm"), (35, "yew"), (70, "fir")], "id int, value string")
    right = spark.createDataFrame([(20, "ash"), (70, "fir"), (10, "oak"), (90, "bay")], "id int, value string")
    return left, right


@pytest.fixture(scope="module")
def labelled(spark):
    s = "id int, value string, label string"
    left = spark.createDataFrame([(1, "red", "warm"), (2, None, "cold"), (3, "teal", None), (4, None, None), (5, "blue", "cold")], s)
    right = spark.createDataFrame([(1, "red", None), (2, "grey", "cold"), (3, "teal", None), (4, None, None), (6, None, None)], s)
    return left, right


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_basic_actions_and_self_lineage(pair, spark):
    got = rows(fk.diff(*pair, "id"))
    assert got == sorted([("N", 10, "oak", "oak"), ("C", 20, "elm", "ash"), ("D", 35, "yew", None), ("N", 70, "fir", "fir"), ("I", 90, None, "bay")], key=repr)
    assert {r[0] for r in fk.diff(pair[0], pair[0], "id").collect()} == {"N"}
    assert {r[0] for r in fk.diff(pair[0], pair[0].where("id > 10"), "id").collect()} == {"N", "D"}


def test_result_schema(pair):
    schema = fk.diff(*pair, "id", options=fk.DiffOptions(change_column="ch")).schema
    assert schema.names == ["diff", "ch", "id", "left_value", "right_value"]
    assert not schema["diff"].nullable


@pytest.mark.parametrize("mode", list(fk.DiffMode))
@pytest.mark.parametrize("sparse", [False, True])
def test_modes(labelled, mode, sparse):
    left, right = labelled
    got = fk.diff(left, right, "id", options=fk.DiffOptions(mode=mode, sparse=sparse, change_column="ch"))
    names = {
        fk.DiffMode.COLUMN_BY_COLUMN: ["left_value", "right_value", "left_label", "right_label"],
        fk.DiffMode.SIDE_BY_SIDE: ["left_value", "left_label", "right_value", "right_label"],
        fk.DiffMode.LEFT_SIDE: ["value", "label"],
        fk.DiffMode.RIGHT_SIDE: ["value", "label"],
    }[mode]
    assert got.columns == ["diff", "ch", "id", *names]
    by_id = {r["id"]: r for r in got.collect()}
    assert {k: (r["diff"], r["ch"]) for k, r in by_id.items()} == {
        1: ("C", ["label"]), 2: ("C", ["value"]), 3: ("N", []), 4: ("N", []), 5: ("D", None), 6: ("I", None)
    }
    if mode is fk.DiffMode.COLUMN_BY_COLUMN:
        assert tuple(by_id[1])[3:] == ((None, None, "warm", None) if sparse else ("red", "red", "warm", None))


def test_no_ids_has_no_changes(labelled):
    assert sorted(r["diff"] for r in fk.diff(*labelled).collect()) == ["D", "D", "D", "I", "I", "I", "N", "N"]


def test_null_ids_match_and_ignored_columns(spark):
    left = spark.createDataFrame([(1, None, "a", 1.5), (2, 1, "b", 2.0)], "id int, seq int, value string, meta double")
    right = spark.createDataFrame([(1, None, "a", "x"), (2, 1, "c", "y")], "id int, seq int, value string, info string")
    got = fk.diff(left, right, "id", "seq", ignore=["meta", "info"])
    assert got.columns == ["diff", "id", "seq", "left_value", "right_value", "left_meta", "right_info"]
    assert rows(got) == [("C", 2, 1, "b", "c", 2.0, "y"), ("N", 1, None, "a", "a", 1.5, "x")]


def test_ignored_with_other_type_and_sparse(spark):
    left = spark.createDataFrame([(1, "a", 7)], "id int, value string, meta int")
    right = spark.createDataFrame([(1, "b", "z")], "id int, value string, meta string")
    assert rows(fk.diff(left, right, "id", ignore=["meta"], options=fk.DiffOptions(sparse=True))) == [("C", 1, "a", "b", 7, "z")]


def test_case_rule(spark, pair):
    left, right = pair[0], pair[1].toDF("ID", "VALUE")
    assert fk.diff(left, right, "id").columns == ["diff", "id", "left_value", "right_VALUE"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="different columns"):
            fk.diff(left, right, "id")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_dotted_and_quoted_names(spark):
    left = spark.createDataFrame([(1, "a")], ["i.d", "va`lue"])
    right = spark.createDataFrame([(1, "b")], ["i.d", "va`lue"])
    got = fk.diff(left, right, "i.d", options=fk.DiffOptions(change_column="ch"))
    assert got.columns == ["diff", "ch", "i.d", "left_va`lue", "right_va`lue"]
    assert got.first()["ch"] == ["va`lue"]


def test_duplicate_ids_fan_out_or_are_rejected(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, value string")
    assert fk.diff(df, df, "id").count() == 4
    with pytest.raises(ValueError, match="equal ids"):
        fk.Differ(require_unique_ids=True).diff(df, df, "id")


def test_change_column_without_values(pair):
    got = fk.diff(pair[0].select("id"), pair[1].select("id"), "id", options=fk.DiffOptions(change_column="ch"))
    assert got.schema["ch"].dataType.simpleString() == "array<string>"
    assert {r["diff"]: r["ch"] for r in got.collect()} == {"N": [], "D": None, "I": None}


@pytest.mark.parametrize(
    ("left", "right", "ids", "ignore", "options", "match"),
    [
        ("id int, id int", "id int, v int", ["id"], [], {}, "duplicate"),
        ("id int, v int", "id int", ["id"], [], {}, "different numbers"),
        ("id int", "id int", ["id"], ["id"], {}, "no columns"),
        ("id int, v int", "id int, v string", ["id"], [], {}, "different columns"),
        ("id int, v int", "id int, v int", ["x"], [], {}, "id columns do not exist"),
        ("id int, v int", "id int, v int", ["id"], ["x"], {}, "neither side"),
        ("diff int, v int", "diff int, v int", ["diff"], [], {}, "diff column"),
        ("ch int, v int", "ch int, v int", ["ch"], [], {"change_column": "ch"}, "change column"),
        ("id int, diff int", "id int, diff int", ["id"], [], {"mode": fk.DiffMode.LEFT_SIDE}, "must not contain"),
        ("left_v int, v int", "left_v int, v int", ["left_v"], [], {}, "collide"),
        ("id int, v int", "id int, v int", ["id"], [], {"diff_column": "right_v"}, "collide"),
    ],
)
def test_rejects(spark, left, right, ids, ignore, options, match):
    def frame(ddl):
        names = [p.strip().split() for p in ddl.split(",")]
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names])

    with pytest.raises(ValueError, match=match):
        fk.diff(frame(left), frame(right), *ids, ignore=ignore, options=fk.DiffOptions(**options))


def test_option_invariants():
    for bad in ({"left_prefix": ""}, {"left_prefix": "right"}, {"insert_value": "C"}, {"change_column": "diff"}):
        with pytest.raises(ValueError):
            fk.DiffOptions(**bad)
    assert fk.DiffOptions(diff_column="").diff_column == ""
    assert fk.DiffMode.by_name("SideBySide") is fk.DiffMode.SIDE_BY_SIDE
    assert fk.DiffMode.by_name("default") is fk.DiffMode.COLUMN_BY_COLUMN
    o = fk.DiffOptions().with_column_name_comparator(fk.Comparators.default(), "v")
    with pytest.raises(ValueError):
        o.with_column_name_comparator(fk.Comparators.default(), "v")
    o = fk.DiffOptions().with_data_type_comparator(fk.Comparators.string())
    with pytest.raises(ValueError):
        o.with_data_type_comparator(fk.Comparators.string(), T.StringType())
    with pytest.raises(ValueError):
        fk.DiffOptions().with_data_type_comparator(fk.Comparators.string(), T.IntegerType())


def test_diff_with_prefixed_ids(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "left_id int, value string")
    right = spark.createDataFrame([(2, "c"), (3, "d")], "left_id int, value string")
    got = {r["diff"]: (r["left"], r["right"]) for r in fk.diff_with(left, right, "left_id").collect()}
    assert got["D"][0].left_id == 1 and got["D"][1] is None and got["I"][0] is None and tuple(got["C"][1]) == (2, "c")


def test_diff_as(pair):
    schema = T.StructType.fromDDL("id long, diff string")
    got = fk.diff_as(schema, *pair, "id")
    assert got.schema.simpleString() == "struct<id:bigint,diff:string>" and got.count() == 5
    with pytest.raises(ValueError, match="does not return"):
        fk.diff_as(T.StructType.fromDDL("nope string"), *pair, "id")


def compare_values(spark, comparator, ddl, values):
    left = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(values)], f"id int, v {ddl}")
    right = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(values)], f"id int, v {ddl}")
    got = fk.diff(left, right, "id", options=fk.DiffOptions(change_column="ch").with_default_comparator(comparator))
    out = {r["id"]: r for r in got.collect()}
    assert all((r["diff"] == "C") == (r["ch"] == ["v"]) for r in out.values())
    return "".join(out[i]["diff"] for i in range(len(values)))


def test_epsilon(spark):
    pairs = [(100.0, 101.0), (100.0, 102.0), (None, None), (None, 1.0), (-100.0, -101.0)]
    e = fk.Comparators.epsilon
    assert compare_values(spark, e(1.0).as_absolute(), "double", pairs) == "NCNCN"
    assert compare_values(spark, e(1.0).as_absolute().as_exclusive(), "double", pairs) == "CCNCC"
    assert compare_values(spark, e(0.01), "double", pairs) == "NCNCN"
    assert compare_values(spark, e(10.0).as_absolute(), "decimal(38,18)", [(Decimal(1), Decimal(11)), (Decimal(1), Decimal(12))]) == "NC"


def test_whitespace(spark):
    pairs = [("north  wind\v", "\tnorth\r\n wind"), ("north wind", "northwind"), (None, None), (None, ""), ("\x7f\x01gale\x1b ", "gale"), ("a\x01b", "ab"), ("\xa0gale", "gale")]
    assert compare_values(spark, fk.Comparators.string(), "string", pairs) == "NCNCNCC"
    assert compare_values(spark, fk.Comparators.string(False), "string", pairs) == "CCNCCCC"


def test_whitespace_takes_linear_time(spark):
    blanks = " \t" * 500_000
    began = time.time()
    assert compare_values(spark, fk.Comparators.string(), "string", [(f"a{blanks}b", "a b"), (f"a{blanks}", f"{blanks}a"), (f"a{blanks}b", "ab")]) == "NNC"
    assert time.time() - began < 30


@pytest.mark.parametrize(
    ("actions", "joins"),
    [("D", ["LeftAnti"]), ("I", ["LeftAnti"]), ("N", ["Inner"]), ("C", ["Inner"]), ("CN", ["Inner"]), ("DC", ["LeftOuter"]), ("IN", ["RightOuter"]), ("DI", ["FullOuter"]), ("DCNI", ["FullOuter"])],
)
def test_only_some_actions(labelled, actions, joins):
    """The same rows as a filter keeps, and no more joined than they need."""
    for options in (fk.DiffOptions(change_column="ch"), fk.DiffOptions(sparse=True, mode=fk.DiffMode.SIDE_BY_SIDE), fk.DiffOptions(mode=fk.DiffMode.RIGHT_SIDE)):
        got = fk.Differ(options).diff(*labelled, "id", actions=list(actions))
        every = fk.diff(*labelled, "id", options=options)
        assert got.schema == every.schema or {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in every.schema}
        assert rows(got) == rows(every.where(F.col("diff").isin(list(actions))))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"Join (\w+)", plan) == joins, plan
    with pytest.raises(ValueError, match="unknown actions"):
        fk.Differ().diff(*labelled, "id", actions=["X"])


def test_no_actions_at_all_and_method_form(labelled):
    left, right = labelled
    assert fk.Differ().diff(left, right, "id", actions=[]).count() == 0
    assert rows(left.transform(fk.against(right, "id", ignore=["label"]))) == rows(fk.diff(left, right, "id", ignore=["label"]))


def test_option_setters(labelled):
    """Names and labels that are set one by one show in the result."""
    o = fk.DiffOptions().with_diff_column("was").with_left_prefix("old").with_right_prefix("new").with_insert_value("+").with_delete_value("-").with_change_value("~").with_nochange_value("=")
    got = fk.diff(*labelled, "id", options=o.with_change_column("what"))
    assert got.columns == ["was", "what", "id", "old_value", "new_value", "old_label", "new_label"]
    assert sorted(r["was"] for r in got.collect()) == sorted("+-~~==")
    assert {r["was"] for r in fk.Differ(o).changes_only(*labelled, "id").collect()} == {"+", "-", "~"}


def test_methods_on_request(labelled, spark, tmp_path):
    """Nothing is attached unless asked for; older names warn."""
    left, right = labelled
    assert not hasattr(left, "diff")
    methods.enable()
    try:
        assert rows(left.diff(right, "id")) == rows(fk.diff(left, right, "id"))
        o = fk.DiffOptions(sparse=True)
        with pytest.warns(DeprecationWarning):
            assert rows(left.diff_with_options(right, o, ["id"], ["label"])) == rows(fk.diff(left, right, "id", options=o, ignore=["label"]))
        with pytest.warns(DeprecationWarning):
            assert left.diffwith_with_options(right, o, "id").columns == ["diff", "left", "right"]
        assert left.session() is left.session_or_ctx() is left.sparkSession
        assert sorted(r.row_number for r in left.with_row_numbers().collect()) == [1, 2, 3, 4, 5]
        left.write.parquet(str(tmp_path / "l"))
        assert spark.read.parquet_metadata(str(tmp_path / "l")).agg(F.sum("rows")).first()[0] == 5
        with pytest.raises(ValueError, match="one list"), pytest.warns(DeprecationWarning):
            left.diff_with_options(right, o, ["id"], [], [])
    finally:
        methods.disable()
    assert not hasattr(left, "diff") and hasattr(left, "groupBy")


def test_duration(spark):
    day, t = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    dates = [(day, dt.date(2024, 1, 2)), (None, None), (None, day)]
    for hours, want in ((23, "CNC"), (24, "NNC"), (25, "NNC")):
        assert compare_values(spark, fk.Comparators.duration(dt.timedelta(hours=hours)), "date", dates) == want
    assert compare_values(spark, fk.Comparators.duration(dt.timedelta(hours=24)).as_exclusive(), "date", dates) == "CNC"
    times = [(t, t + dt.timedelta(minutes=1))]
    for kind in ("timestamp", "timestamp_ntz"):
        for seconds, want in ((59, "C"), (60, "N"), (61, "N")):
            assert compare_values(spark, fk.Comparators.duration(dt.timedelta(seconds=seconds)), kind, times) == want


def test_maps(spark):
    pairs = [({1: 1, 2: 2}, {2: 2, 1: 1}), ({1: 1}, {1: 2}), ({1: 1}, {2: 1}), ({1: None}, {1: None}), (None, None), (None, {}), ({1: None}, {2: None})]
    assert compare_values(spark, fk.Comparators.map(), "map<int,long>", pairs) == "NCCNNCC"
    # Python dicts reach Spark in hash order, so the ordered case is built in Spark.
    one = spark.range(1)
    left, right = one.withColumn("v", F.expr("map(1, 1, 2, 2)")), one.withColumn("v", F.expr("map(2, 2, 1, 1)"))
    for ordered, want in ((False, "N"), (True, "C")):
        options = fk.DiffOptions().with_default_comparator(fk.Comparators.map(key_order_sensitive=ordered))
        assert fk.diff(left, right, "id", options=options).first()["diff"] == want
    assert compare_values(spark, fk.Comparators.map(key_order_sensitive=True), "map<int,long>", pairs[1:]) == "CCNNCC"
    with pytest.raises(ValueError):
        compare_values(spark, fk.Comparators.map(), "string", [("a", "a")])


def test_custom(spark):
    assert compare_values(spark, fk.Comparators.custom(lambda a, b: F.abs(a - b) < 2), "int", [(1, 2), (1, 3), (None, None)]) == "NCC"
    assert compare_values(spark, fk.Comparators.python(lambda a, b: a.lower() == b.lower()), "string", [("A", "a"), ("A", "b"), (None, None), (None, "a")]) == "NCNC"
    with pytest.raises(ValueError):
        compare_values(spark, fk.Comparators.custom(lambda a, b: a == b, T.LongType()), "int", [(1, 1)])
