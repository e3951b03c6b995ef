"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by how often they occur. Sample k draws for
each word two gamma values r and c and a uniform value beta, all from hashes of
the word and k, so that every text draws the same. With a word's weight w,
t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r; the word of the
least ``a`` and its t are the sample. Two texts have the same sample with a
probability that equals the generalised Jaccard similarity of their weights.

DataFrame functions throughout; texts are shuffled once, by range of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a fingerprint; the error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32

#: The sample of a text without words.
NOTHING = (1 << 63) - 1

#: Ranges of doc_id, and tasks over them, for each shuffle partition.
RANGES = 8

_LOW = (1 << 32) - 1


def terms(text: Column) -> Column:
    """Words between white space, lower-cased; a text without any has none."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x20]+"), "")


def _sample(k: int) -> Column:
    """ln a of a term, scaled, above 32 bits that name the term and its t."""
    uniform = lambda x, shift: f"((shiftrightunsigned({x}, {shift}) & 67108863) + 0.5D) * 1.4901161193847656e-08D"
    x, y = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"
    r = f"(-ln({uniform(x, 0)} * {uniform(x, 26)}))"
    c = f"ln(-ln({uniform(y, 0)} * {uniform(y, 26)}))"
    beta = f"((shiftrightunsigned({x}, 52) * 4096 + shiftrightunsigned({y}, 52) + 0.5D) * 5.9604644775390625e-08D)"
    t = f"floor(lw / {r} + {beta})"
    ln_a = f"({c} - {r} * ({t} - {beta} + 1))"
    return F.expr(
        f"if(h is null, {NOTHING}L, shiftleft(cast(({ln_a} + 128) * 8388608D as bigint), 32) "
        f"| ((h ^ shiftleft({t}, 7)) & {_LOW}L))"
    )


def _ranges(docs: DataFrame, count: int) -> tuple[Column, list[int]]:
    """Range of a doc_id (null: the first), and the bounds between ranges."""
    points = [k / count for k in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", points, 10_000).alias("p")).first()["p"] or []
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0), []
    held = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(held, lambda b: b < F.col("doc_id"))), F.lit(0)), bounds


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Of every whole text and its edited form: its last half (n_chars // 2 code
    points) gives way to the beginning of the next text in order of doc_id, after
    the last the first. Null texts are empty; two texts without words are alike
    (1), one without and one with words are not (0). Rows of one doc_id go in order
    of a hash of their text, null doc_ids come first. One row for each row in.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width, _ = _ranges(docs, count)
    keyed = rows.withColumn("b", width).withColumn("text_key", F.xxhash64("text"))
    # The first text of each range also ends the range before it; of the last, the first.
    firsts = keyed.groupBy("b").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    heads = sorted((r["b"], r["first"]["doc_id"], r["first"]["text_key"]) for r in firsts.collect())
    ends = [(head[0], heads[k - 1][0], *head[1:]) for k, head in enumerate(heads)]
    guests = spark.createDataFrame(ends, "b int, to int, doc_id long, text_key long")
    guest = (
        keyed.alias("d")
        .join(
            F.broadcast(guests).alias("g"),
            (F.col("d.b") == F.col("g.b")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key")),
        )
        .select(F.col("d.doc_id"), "d.text", F.col("g.to").alias("b"), "d.text_key", F.lit(1).alias("guest"))
        .dropDuplicates(["b"])
    )
    both = keyed.withColumn("guest", F.lit(0)).select("doc_id", "text", "b", "text_key", "guest").unionByName(guest)
    # About a range a task, so that counting its words stays in memory.
    both = both.repartition(count, "b")
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text_key")
    n = F.char_length("text")
    laid = both.select(
        "b", "doc_id", "guest", "text", n.alias("n"), F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next")
    )
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - _half("n")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), _half("n")))
    texts = laid.select("b", "row", "doc_id", "guest", "n", "text", edited.alias("edited"))

    variants = texts.select("b", "row", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    variants = variants.where("x.v = 0 or x.t is not null").select("b", "row", F.col("x.v").alias("v"), terms(F.col("x.t")).alias("words"))
    words = variants.select("b", "row", "v", F.explode_outer("words").alias("word"))
    hashed = words.select("b", "row", "v", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("h"))
    weighted = hashed.groupBy("b", "row", "v", "h").count().select("b", "row", "v", "h", F.log(F.col("count").cast("double")).alias("lw"))
    least = weighted.groupBy("b", "row", "v").agg(*[F.min(_sample(k)).alias(f"m{k}") for k in range(samples)])
    signed = least.select("b", "row", "v", F.array(*[F.col(f"m{k}").bitwiseAND(F.lit(_LOW)) for k in range(samples)]).alias("s"))
    pair = signed.groupBy("b", "row").agg(
        F.max(F.when(F.col("v") == 0, F.col("s"))).alias("own"), F.max(F.when(F.col("v") == 1, F.col("s"))).alias("edited")
    )
    meta = texts.select("b", "row", "doc_id", "guest", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    by_row = Window.partitionBy("b").orderBy("row")
    joined = meta.join(pair, ["b", "row"]).withColumn("following", F.lead("own").over(by_row))
    return joined.where("guest = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text("own").alias("fingerprint"),
        _text("edited").alias("edited_fingerprint"),
        likeness("own", "edited", samples).alias("near_edited"),
        likeness("own", "following", samples).alias("near_next"),
    )


def _half(column: str) -> Column:
    return F.floor(F.col(column) / 2).cast("int")


def _text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, samples: int) -> Column:
    """Share of equal samples of two fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / samples
