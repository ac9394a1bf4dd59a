"""URL filters: association rules mined from labelled pages by FP-growth, matched through an inverted index.

A page's items are its url's tokens; a labelled page has its verdict as one more item. FP-growth finds the frequent
sets; those that hold a verdict become rules tokens -> verdict, kept by support and confidence. A rule is indexed under
its rarest token, so that a page meets only the rules whose rarest token it has, and is then held against the whole set.

Tokens that the same labelled urls hold are one item: sets that differ only in which of them they name have one support
and one confidence, and a page that fits any of these sets has one token at least of each item. So urls that share a long
path make as many rules as its tokens have different holders, not one for every subset of the path.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
VERDICT = "verdict="


def host_path(url: Column) -> dict[str, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits host or a parent domain and starts the path, else nulls.

    rules is a short list that the caller writes; it becomes one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path with digits folded to 0, keys of the query."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(F.lower(x), "=", 1)))
    return F.array_distinct(F.concat(labels, parts, keys))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: tokens array, verdict -> ante array, verdict, confidence, support, key (its rarest token).

    All frequent sets are mined; see items_of for what keeps tokens that always come together from multiplying them.
    """
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "ante array<string>, verdict string, confidence double, support double, key string")
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), "freq")
    ante = F.filter("items", lambda x: ~x.startswith(VERDICT))
    verdict = F.element_at(F.filter("items", lambda x: x.startswith(VERDICT)), 1)
    with_verdict = sets.filter(F.exists("items", lambda x: x.startswith(VERDICT)) & (F.size("items") > 1)).select(ante.alias("ante"), verdict.alias("v"), F.col("freq").alias("both"))
    rules = with_verdict.join(sets.select(F.col("items").alias("ante"), F.col("freq").alias("n_ante")), "ante")
    rules = rules.select("ante", F.substring("v", len(VERDICT) + 1, 1 << 20).alias("verdict"), (F.col("both") / F.col("n_ante")).alias("confidence"), (F.col("both") / n).alias("support"))
    rules = rules.filter(F.col("confidence") >= min_confidence)
    single = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_n"))
    rare = rules.select("ante", "verdict", F.explode("ante").alias("token")).join(single, "token").groupBy("ante", "verdict").agg(F.min_by("token", F.struct("token_n", "token")).alias("key"))
    return rules.join(rare, ["ante", "verdict"])


def items_of(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """labelled: tokens array -> token, item for the tokens that enough rows hold; item is the first by name of the tokens
    that the same rows hold, told by their number and 128 bits of hash. At most mean tokens a row / min_support rows."""
    n = labelled.count()
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("c"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "tokens")).alias(f"m{seed}") for seed in (1, 2)]
    held = sets.select("tokens", "c", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("c").alias("c"), *marks)
    same = Window.partitionBy("c", "m1", "m2")
    return held.filter(F.col("c") >= min_support * n).select("token", F.min("token").over(same).alias("item"))


def _as_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """tokens (each array once) -> tokens, items; arrays without an item are left out."""
    named = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    return named.groupBy("tokens").agg(F.collect_set("item").alias("items"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", label_id: str = "doc_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict, confidence for every row of pages.

    A stated rule decides where one fits; else the mined rule of highest confidence (then support, then its tokens) that
    the url's tokens hold, by items (see above); else default. A labelled page (by id) counts as block if toxic or of no quality; null labels
    are left out. Null urls have neither host nor path. A repeated id is judged for each of its rows; equal urls get
    equal verdicts. Empty pages give no rows, empty labels leave the stated rules and the default.
    """
    url = F.col(url_col)
    parts = host_path(url)
    urls = pages.select(F.col(id_col), url.alias("url"), parts["host"].alias("host"), parts["path"].alias("path"))
    urls = urls.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    known = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(label_id).alias("_label")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    labelled = urls.join(known, F.col(id_col) == F.col("_label")).select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
    labelled = cut(labelled, "labelled")
    items = sized(cut(items_of(labelled), "items"))
    held = F.size("tokens") > 0
    baskets = labelled.filter(held).join(_as_items(labelled.filter(held).select("tokens").distinct(), items), "tokens", "left")
    baskets = baskets.select(F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "verdict").unionByName(labelled.filter(~held))
    mined = mine_rules(baskets).withColumnRenamed("verdict", "said")
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "stated": verdict})

    # Distinct token sets meet the index, each once, however many pages have them.
    sets = urls.filter(F.col("stated").isNull() & (F.size("tokens") > 0)).select("tokens").distinct()
    hits = _as_items(sets, items).withColumn("key", F.explode("items")).join(mined, "key").filter(F.size(F.array_except("ante", "items")) == 0)
    best = hits.groupBy("tokens").agg(F.max_by(F.struct("said", "confidence"), F.struct("confidence", "support", "ante", "said")).alias("b"))
    best = best.select("tokens", "b.said", "b.confidence")
    # Only urls that the index can decide meet it; the others, null urls among them, would all stand under one key.
    asks = F.col("stated").isNull() & (F.size("tokens") > 0)
    out = urls.filter(asks).join(best, "tokens", "left")
    out = out.unionByName(urls.filter(~asks).withColumns({"said": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}))
    return out.select(id_col, "host", "path", "rule", F.coalesce("stated", "said", F.lit(default)).alias("verdict"), F.when(F.col("stated").isNull(), F.col("confidence")).alias("confidence"))
