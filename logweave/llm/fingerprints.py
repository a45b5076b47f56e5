"""Document fingerprints: bottom-k sketches of shingle hashes.

Main path: built-in functions only.  A sketch is a sorted array of the k
smallest distinct 64-bit hashes of a text's five-word shingles.  Sketches of
parts merge into the sketch of the whole, and pairs of them estimate
resemblance, containment and the number of distinct shingles.

Defined results: a null text counts as empty; an empty text has an empty
sketch; a text of fewer than five words is one shingle; two empty sketches
have likeness 1 and an empty one has likeness 0 to any other; rows with equal
texts have equal sketches; repeated ids are ordered by text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, read_table, shuffle_parts

WIDTH = 5
SIZE = 128
LOWEST, SPAN = -(2.0**63), 2.0**64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def sketch(words: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """Bottom-k sketch of an array of words.

    The array is bound as a lambda variable, so the optimiser can't copy its
    expression into the inner loop.  Single elements are read by index, since
    slice copies the whole array.
    """

    def of(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]),
        )
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    return likeness(a, b, merged(a, b, size))


def likeness(a: Column, b: Column, union: Column) -> Column:
    """Resemblance, given the merged sketch; with a materialised union nothing is computed twice."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / (k-th smallest hash as a share of the hash space)."""
    share = (F.element_at(a, size).cast("double") - LOWEST + 1.0) / SPAN
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    n_a = distinct_shingles(a, size)
    shared = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / n_a))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_sketches(df: DataFrame, key: str, column: str, size: int = SIZE) -> DataFrame:
    """One sketch for each key from the sketches of its parts.

    The rank filter runs before and after the shuffle (window group limit), so
    a key with a third of all rows sends at most k hashes from each task.
    """
    rows = df.select(key, F.explode(column).alias("h"))
    first = Window.partitionBy(key).orderBy("h")
    kept = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= size)
    return kept.groupBy(key).agg(F.sort_array(F.collect_set("h")).alias(column))


def with_next(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows with bucket, copy marker and everything a window needs to see each row's successor by id.

    Ids are cut into ranges at their quantiles; the first rows of a range also
    go, as marked copies, to the end of the range before it, so each range
    finds its successors alone and no task sees more than one range.  The very
    first rows also follow the last.  What the driver keeps is one id a range.
    """
    points = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(id_col, F.array(*map(F.lit, points)), 10 * buckets).alias("q")).first() if points else None
    cuts = sorted(set(got["q"])) if got and got["q"] else []
    if cuts:
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(id_col)))
    else:
        bucket = F.lit(0)
    dealt = df.withColumn("bucket", bucket)
    firsts = {r["bucket"]: r["s"][0] for r in dealt.groupBy("bucket").agg(F.min(F.struct(id_col)).alias("s")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    n = (order[-1] if order else 0) + 1
    kind = df.schema[id_col].dataType
    first_of = F.array(*[F.lit(firsts.get(b)).cast(kind) for b in range(n)])
    before_of = F.array(*[F.lit(before.get(b, 0)) for b in range(n)])
    at = F.col("bucket") + 1
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("copy"))
    extra = F.struct(F.element_at(before_of, at).cast("int").alias("bucket"), F.lit(1).alias("copy"))
    places = F.when(F.element_at(first_of, at).eqNullSafe(F.col(id_col)), F.array(own, extra)).otherwise(F.array(own))
    return dealt.withColumn("place", F.explode(places)).drop("bucket").select("*", "place.bucket", "place.copy").drop("place")


def fingerprint_documents(docs: DataFrame, buckets: int, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of texts and of texts whose second half is replaced from the next document."""
    rows = docs.select("doc_id", or_empty("text").alias("text"))
    dealt = with_next(rows, "doc_id", "text", buckets).repartition("bucket")
    sketched = dealt.withColumn("fp", sketch(words_of(F.col("text")), size, width))
    after = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    follow = sketched.withColumn("next_text", F.lead("text").over(after)).withColumn("next_fp", F.lead("fp").over(after)).where("copy = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = follow.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.col("text").substr(F.lit(1), (n - half).cast("int")), F.col("next_text").substr(F.lit(1), half)).alias("edited"),
        "fp",
        "next_fp",
    )
    edited = edited.withColumn("edited_fp", sketch(words_of(F.col("edited")), size, width))
    both = edited.withColumn("with_edited", merged(F.col("fp"), F.col("edited_fp"), size)).withColumn("with_next", merged(F.col("fp"), F.col("next_fp"), size))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("with_edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), F.col("with_next")).alias("near_next"),
        distinct_shingles(F.col("fp"), size).alias("n_distinct"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return fingerprint_documents(docs, buckets=4 * shuffle_parts(spark))
