"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Features of an address: lengths of the whole, host and path, depth, labels of the host, digit ratio, entropy of
its characters, counts of parameters, hyphens and escapes, and statistics of the suffix (smoothed share of
blocked addresses and its frequency among the labelled ones). The trees are Spark's, fitted on at most
``most_rows`` labelled addresses (the least by a hash), a documented bound; the suffix statistics are a
grouped aggregation over all labelled addresses.

A rule is (host, path, verdict): it fits its host and all subdomains if the path starts with the rule's; the
longest rule wins. Addresses that are null or lack ``://`` have empty host and path, which no rule fits. If
labels hold one class only, the rest gets that verdict; without labels, ``allow``. Repeated rows are judged
alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm.shared import written

MOST_ROWS, TREES, DEPTH, SEED, SMOOTH = 20_000, 20, 4, 11, 5.0
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens",
            "f_escapes", "f_suffix_rate", "f_suffix_share"]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """(..., __host, __path, __rule, __ruled): the longest fitting rule of each row's ``__url`` and its verdict."""
    host, path = host_and_path(F.col("__url"))
    rows = rows.withColumn("__host", host).withColumn("__path", path)
    hit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("__host") == h) | F.col("__host").endswith("." + h)) & F.col("__path").startswith(p)
        hit, verdict = F.when(fits, h + p).otherwise(hit), F.when(fits, v).otherwise(verdict)
    return rows.withColumn("__rule", hit).withColumn("__ruled", verdict)


def features(rows: DataFrame, stats: DataFrame, total: float, own: str | None = None) -> DataFrame:
    """The feature columns of ``__url``, ``__host`` and ``__path``; suffix statistics joined from ``stats``. ``own``: the
    label column of training rows, whose own share is taken out of the statistics they see."""
    mine = F.col(own) if own else F.lit(0.0)
    seen = F.col("__seen") - (1.0 if own else 0.0)
    u = F.coalesce(F.col("__url"), F.lit(""))
    n = F.length(u)
    times = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what)))).cast("double")
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda s, c: s + F.when(
        c == "", 0.0).otherwise((lambda k: -k * F.log(k))((n - F.length(F.replace(u, c))) / n)))
    out = (rows.withColumn("__suffix", F.substring_index("__host", ".", -1))
           .join(stats, "__suffix", "left")
           .withColumns({
               "f_length": n.cast("double"), "f_host": F.length("__host").cast("double"),
               "f_path": F.length("__path").cast("double"), "f_depth": times(F.col("__path"), "/"),
               "f_labels": times(F.col("__host"), "."),
               "f_digits": F.when(n > 0, F.length(F.regexp_replace(u, "[^0-9]", "")) / n).otherwise(0.0),
               "f_entropy": F.when(n > 0, entropy).otherwise(0.0), "f_params": times(u, "=") + times(u, "&"),
               "f_hyphens": times(u, "-") + times(u, "_"), "f_escapes": times(u, "%"),
               "f_suffix_rate": F.coalesce((F.col("__b") - mine + SMOOTH * F.col("__all")) / (seen + SMOOTH), F.lit(0.5)),
               "f_suffix_share": F.coalesce(seen / max(total, 1.0), F.lit(0.0))}))
    return out.drop("__suffix", "__b", "__seen", "__all")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most_rows: int = MOST_ROWS,
        trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """Fit on rows with label 1 (block) or 0 (allow); returns what ``verdicts`` needs."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("__url"), F.col(label_col).cast("double").alias("label"))
    host, path = host_and_path(F.col("__url"))
    rows = written(rows.withColumn("__host", host).withColumn("__path", path), "urls")
    share = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = float(sum(share.values()))
    rate = share.get(1.0, 0) / total if total else 0.0
    stats = (rows.groupBy(F.substring_index("__host", ".", -1).alias("__suffix"))
             .agg(F.count("*").cast("double").alias("__seen"), F.sum("label").alias("__b")).withColumn("__all", F.lit(rate)))
    if len(share) < 2:
        return None, stats, total, "block" if rate > 0 else "allow"
    sample = rows.withColumn("__h", F.xxhash64("__url", "label")).orderBy("__h").limit(most_rows).drop("__h")
    train = written(features(sample, stats, total, own="label").select("label", *FEATURES), "urlfeatures")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed).fit(
        VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train))
    return model, stats, total, "allow"


def verdicts(rows: DataFrame, fitted, url_col: str = "url", id_col: str = "page_id", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, p_block): the rule's verdict where one fits, else the trees'."""
    model, stats, total, default = fitted
    src = ruled(rows.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), rules)
    if model is None:
        out = src.withColumn("__p", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array
        full = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(src, stats, total))
        out = model.transform(full).withColumn("__p", vector_to_array("probability")[1])
    judged = F.when(F.col("__p") >= 0.5, "block").when(F.col("__p") < 0.5, "allow").otherwise(default)
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
                      F.col("__rule").alias("rule"), F.coalesce("__ruled", judged).alias("verdict"), F.col("__p").alias("p_block"))


def rule_labels(rows: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """(url, label): the addresses that a rule decides, as labelled ones."""
    return (ruled(rows.select(F.col(url_col).alias("__url")), rules).where("__ruled is not null")
            .select(F.col("__url").alias("url"), (F.col("__ruled") == "block").cast("int").alias("label")))
