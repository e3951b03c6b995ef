"""Table schemas, fixed values, column defaults and record validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
MEMORY_TYPES = ("general", "preference", "decision", "bug_fix", "pattern")
DECAY_RATES = {
    "preference": 0.02,
    "pattern": 0.03,
    "decision": 0.05,
    "bug_fix": 0.08,
    "general": 0.10,
}
RETENTION_WEIGHT = 0.1
FORGET_THRESHOLD = 0.05
RECALL_BOOST = 0.2
AT_RISK_THRESHOLD = 0.2
WRITE_BACK_EPSILON = 0.001
DUPLICATE_SIMILARITY = 0.93
CANDIDATE_POOL = 20
DEFAULT_TOP_K = 10
CONTEXT_TOKENS = 8000
CHARS_PER_TOKEN = 4
EXTRACTION_CAP = 5
REINFORCED_PER_REQUEST = 5
LIST_LIMIT = 50
CHART_BARS = 8
CHART_LABEL_CHARS = 28
DEFAULT_TYPE = "general"
DEFAULT_IMPORTANCE = 0.5
DEFAULT_DECAY_RATE = 0.1
# ----------------------------------------------------------------------------

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("project_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("importance_score", T.DoubleType(), False),
        T.StructField("decay_rate", T.DoubleType(), False),
        T.StructField("access_count", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_accessed", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

#: The eleven columns a caller sees.
PUBLIC_COLUMNS = (
    "id",
    "user_id",
    "project_id",
    "content",
    "summary",
    "memory_type",
    "importance_score",
    "decay_rate",
    "access_count",
    "created_at",
    "last_accessed",
)


def public_view(memories: DataFrame) -> DataFrame:
    """Keep the public columns; absent optional ones are added as NULL."""
    present = set(memories.columns)
    types = {f.name: f.dataType for f in MEMORY_SCHEMA}
    return memories.select(
        *(
            F.col(name) if name in present else F.lit(None).cast(types[name]).alias(name)
            for name in PUBLIC_COLUMNS
        )
    )


def column_defaults(as_of: Column) -> dict[str, Column]:
    """Values the table takes for columns that an insert leaves out."""
    return {
        "memory_type": F.lit(DEFAULT_TYPE),
        "importance_score": F.lit(DEFAULT_IMPORTANCE),
        "decay_rate": F.lit(DEFAULT_DECAY_RATE),
        "access_count": F.lit(0),
        "metadata": F.lit("{}"),
        "created_at": as_of,
        "last_accessed": as_of,
    }


def with_defaults(rows: DataFrame, as_of: Column) -> DataFrame:
    """Fill missing columns and NULLs with the table's defaults."""
    present = set(rows.columns)
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), value) if name in present else value
            for name, value in column_defaults(as_of).items()
        }
    )


def rejection_reason(
    content: Column, memory_type: Column, importance_score: Column
) -> Column:
    """NULL for a valid record, else the first rule it breaks."""
    return (
        F.when(content.isNull() | (F.length(content) < 1), F.lit("content"))
        .when(memory_type.isNull() | ~memory_type.isin(*MEMORY_TYPES), F.lit("memory_type"))
        .when(
            importance_score.isNull()
            | F.isnan(importance_score)
            | ~importance_score.between(0.0, 1.0),
            F.lit("importance_score"),
        )
    )


def validate_records(rows: DataFrame) -> DataFrame:
    """Add ``rejected_because``: NULL marks the rows that may be inserted."""
    return rows.withColumn(
        "rejected_because",
        rejection_reason(
            F.col("content"), F.col("memory_type"), F.col("importance_score").cast("double")
        ),
    )


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (valid rows, rejected rows with the reason)."""
    checked = validate_records(rows)
    valid = checked.filter(F.col("rejected_because").isNull()).drop("rejected_because")
    return valid, checked.filter(F.col("rejected_because").isNotNull())


def in_project(requested: Column, stored: Column) -> Column:
    """A missing or empty requested project means all; else it must match."""
    return (F.coalesce(requested, F.lit("")) == "") | F.coalesce(stored == requested, F.lit(False))


def scope_key(user_id: Column, workspace_id: Column, project_id: Column) -> Column:
    """``workspace:user:project`` without the parts that are missing or empty."""
    return F.concat_ws(
        ":",
        F.nullif(workspace_id.cast("string"), F.lit("")),
        user_id.cast("string"),
        F.nullif(project_id.cast("string"), F.lit("")),
    )


def session_id_or_derived(session_id: Column, user_id: Column, request_id: Column) -> Column:
    """The given session id, else one derived from the request so reruns agree."""
    return F.coalesce(
        F.nullif(session_id, F.lit("")),
        F.sha2(F.concat_ws(":", user_id.cast("string"), request_id.cast("string")), 256),
    )
