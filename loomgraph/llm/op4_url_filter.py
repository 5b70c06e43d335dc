"""URL filter: domain and path rules first, gradient-boosted trees for the rest.

The urls that a rule judges are the labelled ones. Trees of depth DEPTH on
lexical features (lengths, depth, digit ratio, entropy, parameters, statistics of
host suffixes and of the first folder) are fitted to a sample of at most TRAIN_ROWS of them, half of each
verdict, those of the smallest hashes; every url without a rule is then scored. In
training a row has the suffix statistics of the other FOLDS - 1 folds, without its own
label. Urls are whole,
whatever their length.

Null url or no ``://``: host and path are empty, the features are those of empty
strings and the trees judge it. With labels of one verdict only, that verdict is
the method's; without any, ``allow``. Rows are judged one by one, so repeats and
ties agree; of two rules of one length the first in order counts. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, smallest

#: verdict, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRAIN_ROWS, ROUNDS, DEPTH, BINS, RATE, LEAST, FOLDS = 20_000, 30, 3, 32, 0.2, 20, 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host in lower-case ASCII, the path up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


# --- features ---------------------------------------------------------------

FEATURES = ("url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "fragment", "longest_label", "extension", "tld_rate", "tld_rows", "domain_rate", "domain_rows", "folder_rate", "folder_rows")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """What statistics are kept of: the last label, the last two, the first folder."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), "/" + path[1:].partition("/")[0]


def lexical(url: str | None, host: str, path: str, stats: dict[str, tuple[float, float]]) -> list[float]:
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), host.count(".") + 1 if host else 0, sum(1 for x in path.split("/") if x), digits / max(1, len(url)),
        sum(c.isdigit() for c in host), host.count("-"), entropy(url), entropy(host), sum(1 for x in query.split("&") if x), len(query), float("#" in url),
        max(map(len, host.split("."))), float("." in path.rpartition("/")[2]), *[x for s in suffixes(host, path) for x in stats.get(s, (0.5, 0.0))]]


def suffix_counts(urls: list[tuple[str, str]], y: np.ndarray) -> dict[str, tuple[int, int]]:
    """(rows, blocked rows) of each suffix and first folder of (host, path)."""
    seen, bad = Counter(), Counter()
    for url, label in zip(urls, y):
        for s in set(suffixes(*url)):
            seen[s] += 1
            bad[s] += int(label)
    return {s: (n, bad[s]) for s, n in seen.items()}


def suffix_statistics(counts: dict[str, tuple[int, int]], but: dict[str, tuple[int, int]] | None = None, scale: float = 1.0) -> dict[str, tuple[float, float]]:
    """Smoothed share of block and log count of each suffix.

    The counts ``but`` are left out; ``scale`` makes up for the rows that this takes away.
    """
    less = but or {}
    rest = {s: (scale * (n - less.get(s, (0, 0))[0]), scale * (bad - less.get(s, (0, 0))[1])) for s, (n, bad) in counts.items()}
    return {s: ((bad + 1) / (n + 2), math.log1p(n)) for s, (n, bad) in rest.items() if n}


# --- trees ------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST):
    """(prior, trees): logistic boosting on histograms; a tree is a list of
    (feature, cut, left, right) and leaves (-1, value, 0, 0)."""
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    f, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        tree: list[tuple] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree)
            tree.append(())
            value = float(g[rows].sum() / (h[rows].sum() + 1.0))
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = codes[rows, j]
                    gs, hs, n = (np.bincount(k, w, len(c) + 1).cumsum() for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - total
                    gain[(n < least) | (n[-1] - n < least)] = -1
                    i = int(gain[:-1].argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            if best[1] < 0:
                tree[at] = (-1, rate * value, 0, 0)
                f[rows] += rate * value
                return at
            _, j, i = best
            left = codes[rows, j] <= i
            tree[at] = (j, float(cuts[j][i]), grow(rows[left], level + 1), grow(rows[~left], level + 1))
            return at

        grow(np.arange(len(y)), 0)
        trees.append(tree)
    return prior, trees


def tree_scores(x: np.ndarray, model) -> np.ndarray:
    """Probability of block of each row."""
    prior, trees = model
    f = np.full(len(x), prior)
    for tree in trees:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(c) for c in zip(*tree))
        while (inner := feature[at] >= 0).any():
            j = np.where(inner, feature[at], 0)
            go = np.where(x[np.arange(len(x)), j] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        f += cut[at]
    return 1 / (1 + np.exp(-f))


def fit_urls(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """(suffix statistics, model) or a verdict, from rows (url, host, path, verdict)."""
    rows, count = [], {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    for v in ("allow", "block"):
        one = labelled.filter(F.col("verdict") == v)
        rows += smallest(one, F.xxhash64("url"), train_rows // 2, count.get(v, 0), ["url", "host", "path", "verdict"]).collect()
    y = np.array([r["verdict"] == "block" for r in rows], float)
    if not len(y) or y.all() or not y.any():
        return "block" if len(y) and y.all() else "allow"
    urls = [(r["host"], r["path"]) for r in rows]
    counts = suffix_counts(urls, y)
    # a row's statistics in training are those of the other folds, so its label doesn't show in them
    fold = np.arange(len(rows)) % FOLDS
    other = [suffix_statistics(counts, suffix_counts([urls[i] for i in np.flatnonzero(fold == k)], y[fold == k]), len(rows) / max(1, (fold != k).sum())) for k in range(FOLDS)]
    x = np.array([lexical(r["url"], r["host"], r["path"], other[k]) for r, k in zip(rows, fold)])
    return suffix_statistics(counts), fit_trees(x, y)


def _score(model):
    def run(batches):
        for batch in batches:
            url, host, path = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
            if isinstance(model, str):
                score = np.full(len(url), float(model == "block"))
            else:
                x = np.array([lexical(*row, model[0]) for row in zip(url, host, path)]).reshape(-1, len(FEATURES))
                score = tree_scores(x, model[1])
            yield pa.record_batch([batch.column("id"), batch.column("host"), batch.column("path"), batch.column("rule"), batch.column("verdict"), pa.array(score)], ["id", "host", "path", "rule", "verdict", "score"])

    return run


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, score): score is the trees' probability of block."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    model = fit_urls(rows.filter(F.col("rule").isNotNull()).select("url", "host", "path", "verdict"), train_rows)
    out = rows.mapInArrow(_score(model), "id long, host string, path string, rule string, verdict string, score double")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: a verdict for every page's url."""
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumnRenamed("id", "page_id")
