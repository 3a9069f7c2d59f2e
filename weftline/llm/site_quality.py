"""Document quality by hierarchical empirical Bayes: the text's own evidence and that of its path and host.

A logistic model on measures of the whole text gives each document odds of being good. Grouped sums of these over all
documents tell how good a path and a host are. Sparse paths are shrunk toward their host and sparse hosts toward the whole
corpus, with prior strengths estimated from the spread between groups by the method of moments. A document's posterior odds
are its own odds with the corpus's prior replaced by that of its path, in which the other documents of path and host count
and the document itself does not, so that its evidence enters once.

Host and path are two columns. Tables with a url give its host and its first path segment; the test tables have none, and
there the source stands for the host and the language of the text within that source for the path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, small, table
from .quality_rules import CLASSES, measure

#: At most so many labelled documents of each label are learned from, drawn by a hash of the id.
SAMPLE = 3000
THRESHOLD = 0.5
#: A prior counts for at least and at most so many documents; and how much of a path's evidence moves its documents.
LEAST, MOST, TRUST = 2.0, 1e4, 0.5
NAMES = ("words", "length", "symbols", "repeats", "lines", "common", *CLASSES)


def features(rows: DataFrame) -> DataFrame:
    """One double column ``f_<name>`` for each measure; all are finite for empty texts too."""
    chars = F.greatest(F.lit(1), F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)).cast("double")
    words = F.greatest(F.lit(1), F.col("n_words")).cast("double")
    share = lambda x, n: F.log(x / n + 1e-3)
    values = [
        F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / words, share(F.col("n_symbols"), chars), share(F.col("n_repeat_words"), words), F.log1p(F.col("n_dup_lines").cast("double")),
        share(F.col("n_words") - F.coalesce(F.get("words", F.lit(0)), F.lit(0)), words), *[share(F.coalesce(F.get("classes", F.lit(k)), F.lit(0)), chars) for k in range(len(CLASSES))],
    ]
    return rows.select("id", "site", *[v.cast("double").alias(f"f_{n}") for n, v in zip(NAMES, values, strict=True)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias on raw features, by Newton steps on standardised ones. One label only: a constant."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else len(NAMES)), 2.0 if not len(y) or y.max() else -2.0
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def _prior_strength(groups: DataFrame, n: Column, s: Column, centre: Column) -> float:
    """How many documents the prior of a group counts for: beta-binomial moments of groups around their centres."""
    rate = s / n
    row = groups.select(n.alias("n"), (rate - centre).alias("d"), (centre * (1 - centre)).alias("v")).agg(
        F.sum(F.col("n") * F.col("d") * F.col("d")).alias("between"), F.sum("v").alias("v"), F.sum(F.col("n") * F.col("v")).alias("nv"), F.count("*").alias("g"), F.sum("n").alias("n"),
    ).first()
    if not row.g or row.g < 2 or not row.nv:
        return MOST
    spread = (row.between - row.v) / row.n  # beyond what chance alone gives
    return float(np.clip(row.nv / row.n / spread - 1, LEAST, MOST)) if spread > 0 else MOST


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(id, score, own_score, path_score, host_score) for each row of ``docs``.

    Defined results: null and empty texts are judged by their zero counts; null hosts and paths are groups of their own;
    without labels of both kinds every text has the same own score; repeated rows and null ids are judged each for itself
    and labels of a null id are ignored; ids with contradicting labels are not learned from; an empty table gives an empty
    table; texts of any length are measured whole; other columns are not read, whatever their names.
    """
    site = F.to_json(F.struct(F.col(host_col).cast("string").alias("h"), F.col(path_col).cast("string").alias("p")))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), site.alias("site"))
    rows = saved(features(measure(plain, "id", "text", "site").withColumnRenamed("lang", "site")))
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2 AND y IN (0, 1)")
    drawn = [known.where(F.col("y") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample).select("__id", "y") for k in (0, 1)]
    seen = rows.join(F.broadcast(drawn[0].union(drawn[1])), F.col("id") == F.col("__id")).orderBy("__id").select("y", *[f"f_{n}" for n in NAMES]).collect()
    weights, bias = fit_logistic(np.array([r[1:] for r in seen], float).reshape(len(seen), len(NAMES)), np.array([r[0] for r in seen], float))
    logit = F.lit(bias)
    for n, w in zip(NAMES, weights.tolist(), strict=True):
        logit = logit + F.col(f"f_{n}") * w
    own = rows.select("id", "site", (1 / (1 + F.exp(-logit))).alias("own"))
    paths = own.groupBy("site").agg(F.count("*").alias("n"), F.sum("own").alias("s"))
    paths = saved(paths.withColumn("host", F.get_json_object("site", "$.h")))
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")))
    everything = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = float(everything.s / everything.n) if everything.n else 0.5
    of_host = _prior_strength(hosts, F.col("hn"), F.col("hs"), F.lit(mean))
    paths = paths.join(small(saved(hosts.select(F.col("host").alias("h_"), "hn", "hs"))), F.col("host").eqNullSafe(F.col("h_"))).drop("h_")
    of_path = _prior_strength(paths, F.col("n"), F.col("s"), (of_host * mean + F.col("hs")) / (of_host + F.col("hn")))
    paths = saved(paths.select(F.col("site").alias("s_"), "n", "s", "hn", "hs"))
    both = own.join(small(paths), F.col("site") == F.col("s_"))
    # Without the document itself; counts stay above 0, as prior strengths do.
    host_score = (of_host * mean + F.col("hs") - F.col("own")) / (of_host + F.col("hn") - 1)
    both = both.withColumn("host_score", F.greatest(F.lit(0.0), host_score))
    path_score = (of_path * F.col("host_score") + F.col("s") - F.col("own")) / (of_path + F.col("n") - 1)
    both = both.withColumn("path_score", F.greatest(F.lit(0.0), path_score))
    score = _logit(F.col("own")) + TRUST * (_logit(F.col("path_score")) - _logit(F.lit(mean)))
    return both.select("id", (1 / (1 + F.exp(-score))).alias("score"), F.col("own").alias("own_score"), "path_score", "host_score")


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "own_score", "path_score", "host_score")
