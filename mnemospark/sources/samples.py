"""Memory-shaped tables derived from general parquet tables.

Each function reads whole tables and only renames, combines and scores columns,
so the derived data grow with the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.decay import decay_rate_for_type


def as_of() -> Column:
    """Reference time of all sample queries."""
    return F.lit("2024-02-15 00:00:00").cast("timestamp")


#: Time of memories without an event.
FIRST_DAY = "2024-01-01 00:00:00"

SCHEMAS = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table under its declared schema, so no job runs to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _project(number: Column) -> Column:
    return F.when(number % 4 != 0, F.concat(F.lit("p"), (number % 3).cast("string")))


def _type_of_label(label: Column) -> Column:
    kind = label % 5
    return (
        F.when(kind == 0, "general")
        .when(kind == 1, "preference")
        .when(kind == 2, "decision")
        .when(kind == 3, "bug_fix")
        .otherwise("pattern")
    )


def vector_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Memories with texts and vectors: one for each document and each embedding.

    Documents without an embedding have no vector, embeddings without a document
    a short text. The event of the same number gives the time.
    """
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    d = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content")
    )
    v = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")
    )
    kind = _type_of_label(F.coalesce("label", F.col("id") % 10))
    at = F.coalesce("ts", F.lit(FIRST_DAY).cast("timestamp"))
    return (
        d.join(e, "id", "full")
        .join(v, "id", "left")
        .select(
            "id",
            (F.col("id") % 10).alias("user_id"),
            _project(F.col("id")).alias("project_id"),
            F.coalesce("content", F.concat(F.lit("note "), F.col("id").cast("string"))).alias("content"),
            F.lit(None).cast("string").alias("summary"),
            kind.alias("memory_type"),
            (F.col("id") * 37 % 101 / 100.0).alias("importance_score"),
            decay_rate_for_type(kind).alias("decay_rate"),
            (F.col("id") % 4).cast("int").alias("access_count"),
            at.alias("created_at"),
            at.alias("last_accessed"),
            "embedding",
        )
    )


def event_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Memories without vectors: one per event."""
    return as_event_memories(table(spark, folder, "events"))


def as_event_memories(events: DataFrame) -> DataFrame:
    """Events (a batch or a stream) as memories without vectors."""
    kind = (
        F.when(F.col("event_type") == "view", "general")
        .when(F.col("event_type") == "click", "preference")
        .when(F.col("event_type") == "purchase", "decision")
        .when(F.col("event_type") == "error", "bug_fix")
        .otherwise("pattern")
    )
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        _project(F.col("event_id")).alias("project_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("summary"),
        kind.alias("memory_type"),
        F.least(F.lit(1.0), F.col("value") / 200.0).alias("importance_score"),
        decay_rate_for_type(kind).alias("decay_rate"),
        (F.col("event_id") % 4).cast("int").alias("access_count"),
        ts.alias("created_at"),
        ts.alias("last_accessed"),
    )


def search_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per embedding; every second one names a project."""
    qid = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        qid.alias("qid"),
        (qid % 10).alias("user_id"),
        F.when(qid % 2 == 1, F.concat(F.lit("p"), (qid % 3).cast("string"))).alias("project_id"),
        "embedding",
    )


def rerank(candidates: DataFrame) -> DataFrame:
    """Stand-in rerank scores: some candidates and some whole requests have none."""
    score = (F.col("qid") * 31 + F.col("id") * 17) % 101 / 100.0
    missing = (F.col("qid") % 3 == 0) | (F.col("memory_type") == "bug_fix")
    return candidates.withColumn("relevance", F.when(~missing, score))


def next_of_user(vectors: DataFrame) -> DataFrame:
    """vec_id, label, a (its vector) and b: the next vector of the same user, after the last the first."""
    a = vectors.select("vec_id", "label", F.col("embedding").alias("a"))
    b = vectors.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    ends = vectors.groupBy((F.col("vec_id") % 10).alias("user_id")).agg(
        F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")
    )
    following = F.when(F.col("vec_id") == F.col("last_id"), F.col("first_id")).otherwise(F.col("vec_id") + 10)
    numbered = a.join(F.broadcast(ends), F.col("vec_id") % 10 == F.col("user_id"))  # ten users
    return numbered.withColumn("next_id", following).join(b, "next_id").drop("user_id", "first_id", "last_id", "next_id")


def _mixed(base: Column) -> Column:
    """Two vectors a and b mixed, so that results lie on both sides of the duplicate threshold."""
    weight = F.lit(0.60) + F.lit(0.05) * (F.floor(base / 5) % 8)
    return F.zip_with("a", "b", lambda x, y: weight * x + (F.lit(1.0) - weight) * y)


def incoming_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Saves on both sides of the duplicate threshold, each repeated once later."""
    base = F.col("vec_id")
    return (
        next_of_user(table(spark, folder, "embeddings"))
        .withColumn("embedding", _mixed(base))
        .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            (base * 2 + F.col("copy")).alias("seq"),
            (base % 10).alias("user_id"),
            _project(base).alias("project_id"),
            F.concat(F.lit("note "), base.cast("string")).alias("content"),
            _type_of_label(F.col("label")).alias("memory_type"),
            (base * 53 % 101 / 100.0).alias("importance_score"),
            "embedding",
        )
    )


def as_access_log(events: DataFrame) -> DataFrame:
    """Accesses (a batch or a stream): several for most memories, and some of unknown ones."""
    return events.filter(F.col("event_type").isin("click", "view")).select(
        "event_id",
        F.floor(F.col("event_id") / 8).alias("memory_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return as_access_log(table(spark, folder, "events"))


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """One raw completion per conversation turn."""
    return as_completions(table(spark, folder, "conversations"))


def as_completions(turns: DataFrame) -> DataFrame:
    """Turns (a batch or a stream) as raw completions in ten good and bad shapes."""
    shape = (F.col("conv_id") + F.col("turn")) % 10
    # to_json quotes and escapes the text as a one-element array.
    quoted = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")

    def item(*fields: str) -> Column:
        parts = [F.concat(F.lit('"content":'), quoted) if f == "content" else F.lit(f) for f in fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    def array(*items: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))

    decision = item("content", '"memory_type":"decision"', '"importance_score":0.9')
    plain = item("content")
    raw = (
        F.when(shape == 0, array(decision))
        .when(shape == 1, F.concat(F.lit("```json\n"), array(decision), F.lit("\n```")))
        .when(shape == 2, F.lit("[]"))
        .when(shape == 3, F.col("text"))
        .when(shape == 4, plain)
        .when(
            shape == 5,
            array(plain, plain, item("content", '"memory_type":"other"'), *[plain] * 4),
        )
        .when(shape == 6, array(item("content", '"importance_score":1.7'), decision))
        .when(shape == 7, array(item('"memory_type":"pattern"'), item('"content":""'), decision))
        .when(shape == 8, array(decision, F.lit("17")))
        .otherwise(array(item("content", '"importance_score":"0.4"'), decision))
    )
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("completion_id"),
        (F.col("conv_id") % 10).alias("user_id"),
        _project(F.col("conv_id")).alias("project_id"),
        raw.alias("raw"),
    )


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """One tool call per embedding; label and number pick tool and arguments."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("request_id"), "label")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"), "text")
    label, number = F.col("label"), F.col("request_id")
    text = F.coalesce("text", F.concat(F.lit("call "), number.cast("string")))

    def args(**fields: Column) -> Column:
        return F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())))

    name = (
        F.when(label.isin(0, 6), "recall_project_context")
        .when(label.isin(1, 7, 9), "save_developer_insight")
        .when(label.isin(2, 8), "find_similar_problems")
        .when(label.isin(3, 5), "get_memory_health")
        .otherwise("drop_everything")
    )
    shape = number % 6
    top_k = (
        F.when(shape == 0, "5").when(shape == 1, "null").when(shape == 2, "-17")
        .when(shape == 3, '"many"').when(shape == 4, "2.5").otherwise("true")
    )
    body = (
        F.when(label == 0, args(current_task=text))
        .when(label == 6, args(project_id=F.lit("p1"), current_task=text))
        .when((label == 1) & (number % 7 == 3), args(insight=number, memory_type=F.lit("decision")))
        .when(label == 1, args(insight=text, memory_type=F.lit("decision")))
        .when(
            label == 7,
            args(insight=text, memory_type=F.lit("pattern"), importance=F.lit(0.9)),
        )
        .when(label == 9, args(insight=text, memory_type=F.lit("rumour")))
        .when(label == 2, args(problem_description=text))
        .when(
            label == 8,
            F.concat(F.lit('{"top_k":'), top_k, F.lit(',"problem_description":'), F.substr(args(t=text), F.lit(6))),
        )
        .when(label == 3, args(user_id=F.lit("anyone")))
        .when(label == 5, F.lit('{"user_id": '))
        .otherwise(args(target=text))
    )
    return e.join(d, "request_id", "left").select(
        "request_id",
        (number % 10).alias("user_id"),
        _project(number).alias("project_id"),
        name.alias("name"),
        body.alias("args"),
    )


def call_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the tool calls' texts: two calls of a user in a row share one, some have none."""
    base = F.col("vec_id")
    pairs = F.array(base, base + 10)
    mixed = next_of_user(table(spark, folder, "embeddings")).withColumn("embedding", _mixed(base))
    return (
        mixed.filter(F.floor(base / 10) % 2 == 0)
        .select(F.explode(pairs).alias("request_id"), "embedding")
        .filter(F.col("request_id") % 23 != 0)
    )
