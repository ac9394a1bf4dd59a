"""Document fingerprints: a canonical exact digest, in DataFrame and SQL functions only.

Canonical form: compatibility composition, full case folding, composition again, runs of white space to one
blank, no blank at either end. The fingerprint is 128 bits of xxhash64 over it. Texts whose fingerprints are
equal are compared byte by byte; should two canonical forms share a hash, all but the first (by SHA-256) get a suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, wide_hash

SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
FAN = 64
MOST_BUCKETS = FAN * FAN


def canonical(text: Column) -> Column:
    def compose(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), SPACE, " "))


def _bucket(bounds: list[int]):
    """Position of an id among sorted bounds, in two short array searches."""
    if not bounds:
        return lambda c: F.lit(0)
    parts = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    tops = F.array(*[F.lit(p[0]).cast("long") for p in parts[1:]]) if len(parts) > 1 else None
    lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])

    def of(c: Column) -> Column:
        top = F.size(F.filter(tops, lambda b: b <= c)) if tops is not None else F.lit(0)
        return top * FAN + F.size(F.filter(F.get(lists, top), lambda b: b <= c))

    return of


def with_next(docs: DataFrame, id_col: str, cols: list[str], text_col: str) -> DataFrame:
    """Adds next_<c> for each column: the row that follows by (id, text), after the last the first.

    Rows go to ranges of ids, bounded by approximate quantiles, each sorted alone; the first row of a range is also
    sent to the range before. The first ids of the ranges, at most MOST_BUCKETS, are all that reaches the driver.
    """
    spark = docs.sparkSession
    n = min(MOST_BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = docs.select(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).first()["q"] if n > 1 else []
    bucket = _bucket(sorted(set(cuts or [])))
    rows = docs.withColumns({"_b": bucket(F.col(id_col)), "_ghost": F.lit(0)})
    heads = [(r["_b"], r["head"][0]) for r in rows.groupBy("_b").agg(F.min(F.struct(id_col)).alias("head")).orderBy("_b").collect()]
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in cols])
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = spark.createDataFrame([(heads[i - 1][0], h) for i, (_, h) in enumerate(heads)], f"_to int, _head {kind}")
    ghosts = docs.join(F.broadcast(pairs), F.col(id_col).eqNullSafe(F.col("_head")))
    first = ghosts.groupBy("_to", id_col).agg(F.min_by(F.struct(*docs.columns), F.col(text_col)).alias("_r"))
    first = first.select("_r.*", F.col("_to").alias("_b"), F.lit(1).alias("_ghost"))
    order = Window.partitionBy("_b").orderBy("_ghost", F.asc_nulls_first(id_col), text_col)
    both = rows.unionByName(first)
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in cols}).filter("_ghost = 0").drop("_b", "_ghost")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hash, suffix, canon_sha, group_id (smallest id), group_size: one row per canonical text, equal hashes compared by bytes."""
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("canon")).withColumn("hash", wide_hash(F.col("canon")))
    texts = rows.groupBy("hash", "canon").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    texts = texts.select("hash", F.sha2("canon", 256).alias("canon_sha"), "group_id", "group_size")
    place = F.row_number().over(Window.partitionBy("hash").orderBy("canon_sha")) - 1
    return texts.withColumn("place", place).withColumn("suffix", F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise(""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness (1 if canonically equal, else 0).

    Null text is empty. A repeated id is followed by its own next row in text order; a null id comes first. A single
    row is followed by itself. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("t"))
    # A canonical form is a column of its own before anything reads it: the planner can't share a call of reflect.
    hashed = base.withColumn("canon", canonical(F.col("t"))).select(id_col, "t", wide_hash(F.col("canon")).alias("hash"), F.sha2("canon", 256).alias("canon_sha"))
    rows = with_next(hashed, id_col, ["t", "hash", "canon_sha"], "t")
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half)))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "hash", "canon_sha", wide_hash(F.col("edited_canon")).alias("edited_hash"),
        ((F.col("hash") == F.col("next_hash")) & (F.col("canon_sha") == F.col("next_canon_sha"))).alias("same_next"),
        (F.col("canon_sha") == F.sha2("edited_canon", 256)).alias("same_edited"),
    )
    found = cut(groups(docs, id_col, text_col), "fingerprints")
    rows = rows.join(found.select("hash", "canon_sha", "suffix", "group_id", "group_size"), ["hash", "canon_sha"])
    own = F.concat("hash", "suffix")
    return rows.select(
        id_col, "n_chars", "edited_sha256", own.alias("fingerprint"), F.when(F.col("same_edited"), own).otherwise(F.col("edited_hash")).alias("edited_fingerprint"),
        F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"), "group_id", "group_size",
    )

