from pyspark.sql import functions as F

from mnemospark import schema
from mnemospark.functions import text
from mnemospark.sources import tables


def test_validation_reports_the_first_broken_rule(spark):
    rows = [
        ("a", "general", 0.0, None), ("a", "pattern", 1.0, None), ("", "general", 0.5, "content"),
        (None, "general", 0.5, "content"), ("a", "other", 0.5, "memory_type"),
        ("a", None, 0.5, "memory_type"), ("a", "decision", 1.01, "importance_score"),
        ("a", "decision", -0.01, "importance_score"), ("a", "decision", float("nan"), "importance_score"),
        ("a", "decision", None, "importance_score"),
    ]
    df = spark.createDataFrame(
        rows, "content string, memory_type string, importance_score double, want string"
    )
    for row in schema.validate_records(df).collect():
        assert row.rejected_because == row.want
    valid, rejected = schema.split_valid(df)
    assert valid.count() == 2 and rejected.count() == 8


def test_scope_key_skips_missing_and_empty_parts(spark):
    df = spark.createDataFrame(
        [("u", None, None, "u"), ("u", "w", "", "w:u"), ("u", "", "p", "u:p"), ("u", "w", "p", "w:u:p")],
        "u string, w string, p string, want string",
    )
    got = df.select("want", schema.scope_key(F.col("u"), F.col("w"), F.col("p")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_project_rule(spark):
    df = spark.createDataFrame(
        [(None, "p", True), ("", None, True), ("p", "p", True), ("p", "q", False), ("p", None, False)],
        "asked string, stored string, want boolean",
    )
    got = df.select("want", schema.in_project(F.col("asked"), F.col("stored")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_session_id_is_stable_for_a_request(spark):
    df = spark.createDataFrame([("s",), ("",), (None,)], "sid string")
    ids = [
        r[0]
        for r in df.select(
            schema.session_id_or_derived(F.col("sid"), F.lit("u"), F.lit(7))
        ).collect()
    ]
    assert ids[0] == "s" and ids[1] == ids[2] and len(ids[1]) == 64


def test_short_text_expressions(spark):
    long = "x" * 29
    df = spark.createDataFrame([("abc",), ("x" * 28,), (long,)], "c string")
    labels = [r[0] for r in df.select(text.chart_label(F.col("c"))).collect()]
    assert labels == ["abc", "x" * 28, "x" * 28 + "…"]
    costs = [r[0] for r in df.select(text.token_cost(F.col("c"))).collect()]
    assert costs == [0, 7, 7]
    df = spark.createDataFrame([(0.005,), (None,), (0.625,)], "x double")
    assert [r[0] for r in df.select(text.average_text(F.col("x"))).collect()][1] == "—"
    assert [r[0] for r in df.select(text.percent(F.col("x"))).collect()] == [1, None, 63]


def test_zero_rerank_differs_between_search_and_packing(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.8), (None, 0.5, 0.8), (0.4, 0.5, 0.8)], "r double, s double, i double")
    args = (F.col("r"), F.col("s"), F.col("i"))
    got = df.select(text.search_score(*args), text.pack_score(*args)).collect()
    assert [tuple(round(v, 9) for v in r) for r in got] == [(0.4, 0.0), (0.4, 0.4), (0.32, 0.32)]


def test_table_round_trip_and_vector_text(spark, as_of, tmp_path):
    rows = spark.createDataFrame([("a", "u", "one", "[1,2.5]")], "id string, user_id string, content string, embedding string")
    full = schema.with_defaults(tables.import_vector_text(rows), as_of)
    shaped = full.select(
        *(
            F.col(f.name).cast(f.dataType) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.MEMORY_SCHEMA
        )
    )
    path = str(tmp_path / "memories")
    tables.write_memories(shaped, path)
    tables.append_memories(shaped, path)
    back = tables.read_memories(spark, path)
    assert back.count() == 2
    row = back.first()
    assert row.embedding == [1.0, 2.5] and row.memory_type == "general" and row.metadata == "{}"
    public = tables.scan_public(spark, path)
    assert public.columns == list(schema.PUBLIC_COLUMNS)
    plan = public._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]
    assert tables.export_vector_text(back.select("embedding")).first()[0] == "[1.0,2.5]"
