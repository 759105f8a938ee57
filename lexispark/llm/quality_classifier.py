"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression over style features gives each document's evidence. Its probabilities are summed by host and by path
(grouped aggregation over all documents); host means are shrunk toward the global mean and path means toward their host's
posterior, as strongly as the variance between sites, estimated by moments, asks for. A document's log odds are its own
evidence plus what its site's posterior, without the document itself, adds over the global odds.

Defined results: null and empty texts have no words, and all their shares are 0; null hosts and paths are sites of their own;
a label counts only if it is 0 or 1, and the lowest label wins where a document has several; without labels of both kinds
every document has even odds and stays; rows that repeat a doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import without, words, written

#: Labelled documents that the regression is fitted on: all, or where there are more, about this many by a hash of their ids.
FIT_ROWS = 20_000
FEATURES = ("symbols", "upper", "marks", "digits", "same", "fresh", "lines", "length", "few")


def features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Style features of text, a column each: shares of symbols, upper-case letters, exclamation marks and digits; of words equal to the one before, of distinct
    words, of repeated lines; the logarithm of the word count."""
    rows = rows.select(*keys, F.coalesce("text", F.lit("")).alias("_t"), words(F.col("text")).alias("_w"))
    t, found = F.col("_t"), F.col("_w")
    n, chars = F.size(found), F.greatest(F.length(t), F.lit(1))
    share = lambda drop: (chars - F.length(F.translate(t, drop, ""))) / chars
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / chars
    same = F.size(F.filter(found, lambda w, i: (i > 0) & (w == F.get(found, i - 1)))) / F.greatest(n, F.lit(1))
    fresh = F.size(F.array_distinct(found)) / F.greatest(n, F.lit(1))
    lines = F.split(t, "\n")
    again = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    values = [root(share("#*$%&|<>")), root(upper), root(share("!")), root(share("0123456789")), root(same), fresh, again, F.log1p(n), (n < 8).cast("double")]
    return rows.select(*keys, *[v.alias(name) for v, name in zip(values, FEATURES, strict=True)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def evidence_weights(rows: DataFrame, labels: DataFrame, bound: int) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept. Only rows of the sample reach the driver, however many partitions there are; a
    doc_id with several rows is one of them (the least by its features), so repeated rows don't fill the sample."""
    one = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    labelled = rows.join(one.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    columns = ["_y", *FEATURES]
    labelled = labelled.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row"))
    share = bound / max(labelled.count(), 1)
    if share < 1:
        labelled = labelled.where(F.xxhash64("doc_id") < int((2 * share - 1) * 2**63))
    sample = labelled.select("_row.*").toPandas().sort_values(columns)
    y = sample["_y"].to_numpy(float)
    if len(set(y)) < 2:
        return np.zeros(len(FEATURES)), 0.0
    return fit_logistic(sample[list(FEATURES)].to_numpy(float), y)


def strength(groups: DataFrame, n: str, total: str, squares: str, within: DataFrame | None = None) -> tuple[float, float]:
    """(mean, prior strength) of group means around their common mean, by moments over grouped sums."""
    row = groups.agg(F.sum(n), F.sum(total), F.sum(squares), F.sum(F.col(total) * F.col(total) / F.col(n)), F.sum(F.col(n) * F.col(n)), F.count(F.lit(1))).first()
    count, s, ss, between, n2, g = (float(x or 0) for x in row)
    if count == 0:
        return 0.5, 1.0
    mean = min(max(s / count, 1e-6), 1 - 1e-6)
    noise = max(ss - between, 0.0) / max(count - g, 1.0)
    spread = (between - s * s / count - (g - 1) * noise) / max(count - n2 / count, 1e-9)
    return mean, min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6)


def logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, bound: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) and labels (doc_id, quality) -> doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept.

    host and path say which site a row is from: its source, and its language within the source, unless given."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    rows = written(features(rows, ["doc_id", "host", "path"]), "style")
    weights, intercept = evidence_weights(rows, labels, bound)
    evidence = F.lit(intercept)
    for name, w in zip(FEATURES, weights, strict=True):
        evidence = evidence + F.col(name) * float(w)
    evidence = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), evidence))
    rows = rows.select("doc_id", "host", "path", evidence.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))

    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    mean, host_strength = strength(hosts, "hn", "hs", "hss")
    _, path_strength = strength(paths, "n", "s", "ss")
    sites = paths.alias("p").join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "hn", "hs")

    scored = rows.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    host_posterior = (host_strength * mean + F.col("hs") - F.col("p")) / (host_strength + F.col("hn") - 1)
    path_posterior = (path_strength * F.col("host_posterior") + F.col("s") - F.col("p")) / (path_strength + F.col("n") - 1)
    scored = scored.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior)
    odds = F.col("evidence") + logit(F.col("path_posterior")) - logit(F.lit(mean))
    scored = scored.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents that the classifier rejects; a doc_id goes if one of its rows is rejected."""
    return without(docs, quality_scores(docs, labels, **options).where("NOT kept").select("doc_id").distinct())
