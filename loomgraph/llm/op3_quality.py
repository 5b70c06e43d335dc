"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

The score of a document is w . x over features of its whole text. Pairs of a good
and a bad labelled document say that the good one ranks higher; w minimizes the
logistic loss of the feature differences (Newton steps, a small ridge). The
threshold is the quantile of the labelled scores at the share of bad labels; the
score is mapped to 0..1 so that the threshold is at CUT.

Every different label row that is not held out teaches; of documents that repeat an id
the one of the least features does. Up to GROUP_ROWS of them are paired at once. More
are dealt by a hash of the id to groups of about so many, the rarer label repeated where
a group would have too few of it; pairs are made in each group, and the loss and the
threshold are those of all groups, summed by tasks. Null text is an empty one; an empty text gets
features of zeros and a score like any other; texts are whole, whatever their length;
an empty table gives no rows. Null labels and
labels without a document are skipped; with labels of one kind only, every score
is 1 or 0 accordingly, without any it is 1. Rows are scored one by one; repeats
agree; rows with a null id are never held out; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_worker, materialize, runs, sized_join

GROUP_ROWS, PAIRS, RIDGE, CUT, FOLDS = 20_000, 200_000, 1e-3, 0.3, 5
#: Rows of the rarer label that a group has, as expected, at least; all where there are fewer.
GROUP_LEAST = 64

_CLASSES = np.full(256, 7, np.uint8)  # other bytes of UTF-8
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:'\"?-()", 4), (b"!", 5), (b"|", 6), (b"#$%&*@^~_+=<>/\\{}[]`", 8)):
    _CLASSES[list(_chars)] = _k
_TABLE = _CLASSES.tobytes()
N_FEATURES = 18


def text_features(text: str | None) -> list[float]:
    """Shares and logs that say how text-like a whole text is."""
    if not text:
        return [0.0] * N_FEATURES
    b = text.encode("utf-8", "surrogatepass")
    n = len(b)
    c = np.bincount(np.frombuffer(b.translate(_TABLE), np.uint8), minlength=9) / n
    words = b.split()
    if not words:
        return [0.0] * N_FEATURES
    k = len(words)
    distinct = len(set(words)) / k
    again = sum(map(bytes.__eq__, words, words[1:])) / k
    lines = b.split(b"\n")
    sentences = b.count(b". ") + b.count(b".\n") + b.endswith(b".")
    lg = lambda x: math.log1p(200 * x)
    # expected distinct share falls with length: compare within it
    return [
        lg(c[1]), lg(c[2]), lg(c[4]), lg(c[5]), lg(c[6]), lg(c[8]), c[0] + c[7], math.log(k), distinct, distinct * math.log(k), lg(again), n / k / 10,
        1 - len(set(lines)) / len(lines), lg(sentences / k), float(c[1] > 0.3), float(c[8] > 0.05), float(c[6] > 0.01), float(again > 0.1)]


def preference_pairs(y: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (good, bad): every document is in pairs, at most max(pairs, rows) of them."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(7)
    n = max(min(pairs, len(good) * len(bad)), len(good), len(bad))
    g = np.resize(rng.permutation(good), n)
    b = rng.choice(bad, n)
    b[: len(bad)] = rng.permutation(bad)
    return g, b


def slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over pair differences d of the loss's slope and curvature at w."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return -(d * p[:, None]).sum(0), (d * (p * (1 - p))[:, None]).T @ d


def newton(sums, k: int, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """The k weights at which the mean loss is least; sums(w) gives (slope, curvature, pairs)."""
    w = np.zeros(k)
    for _ in range(steps):
        grad, hess, n = sums(w)
        step = np.linalg.solve(hess / n + ridge * np.eye(k), grad / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_bradley_terry(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(w, threshold): the weights of the raw features and the score quantile."""
    scale = x.std(0)
    scale[scale == 0] = 1.0
    g, b = preference_pairs(y)
    d = (x[g] - x[b]) / scale
    w = newton(lambda w: (*slopes(d, w), len(d)), x.shape[1]) / scale
    return w, float(np.quantile(x @ w, float((y == 0).mean())))


def _pack(batches):
    """A row (group, x, y, own) with the bytes of each group's arrays, its rows in order."""
    fresh_worker()
    for (group,), rows in runs(batches, ["group"]):
        x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
        y, own = rows.column("y").to_numpy(), rows.column("own").to_numpy()
        order = np.lexsort((y, *x.T[::-1]))
        yield pa.record_batch([pa.array([group]), *(pa.array([a[order].tobytes()], pa.binary()) for a in (x, y.astype(np.int64), own.astype(np.int64)))], ["group", "x", "y", "own"])


def _each(packed: DataFrame, f) -> list[np.ndarray]:
    """f(x, y, own) of every group, in the order of groups."""
    def run(batches):
        fresh_worker()
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, own = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, np.float64), (2, np.int64), (3, np.int64)))
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([f(x.reshape(-1, N_FEATURES), y, own == 1)], pa.list_(pa.float64()))], ["group", "out"])

    return [np.array(r["out"]) for r in sorted(packed.mapInArrow(run, "group long, out array<double>").collect(), key=lambda r: r["group"])]


def _kth(packed: DataFrame, w: np.ndarray, k: int) -> float:
    """The k-th smallest score (from 0): its interval is narrowed by counts until few scores are inside."""
    ends = np.array(_each(packed, lambda x, y, own: [(s := x[own] @ w).min(), s.max()] if own.any() else [np.inf, -np.inf]))
    lo, hi = np.nextafter(ends[:, 0].min(), -np.inf), ends[:, 1].max()
    while True:
        edges = np.linspace(lo, hi, 1025)
        upto = sum(_each(packed, lambda x, y, own: np.searchsorted(np.sort(x[own] @ w), edges, "right").astype(float)))
        i = int(np.searchsorted(upto, k + 1))
        now = edges[i - 1], edges[i]
        if upto[i] - upto[i - 1] <= GROUP_ROWS:
            near = np.sort(np.concatenate(_each(packed, lambda x, y, own: (s := x[own] @ w)[(s > now[0]) & (s <= now[1])])))
            return float(near[k - int(upto[i - 1])])
        if now == (lo, hi):  # more equal scores than a group's rows
            return float(hi)
        lo, hi = now


def fit_groups(packed: DataFrame, n: int, bad: int) -> tuple[np.ndarray, float]:
    """(w, threshold) of ``n`` label rows, ``bad`` of them bad, in groups: as fit_bradley_terry over the pairs of all groups."""
    mean = sum(_each(packed, lambda x, y, own: x[own].sum(0))) / n
    scale = np.sqrt(sum(_each(packed, lambda x, y, own: ((x[own] - mean) ** 2).sum(0))) / n)
    scale[scale == 0] = 1.0

    def sums(w):
        def one(x, y, own):
            if y.all() or not y.any():
                return np.zeros(1 + N_FEATURES + N_FEATURES**2)
            g, b = preference_pairs(y)
            d = (x[g] - x[b]) / scale
            grad, hess = slopes(d, w)
            return np.concatenate([[len(d)], grad, hess.ravel()])

        out = sum(_each(packed, one))
        return out[1 : 1 + N_FEATURES], out[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES), out[0]

    w = newton(sums, N_FEATURES) / scale
    at = (n - 1) * (bad / n)
    k = int(at)
    return w, float(np.quantile([_kth(packed, w, k), _kth(packed, w, min(k + 1, n - 1))], at - k))


def unit_score(raw: np.ndarray, threshold: float, cut: float = CUT) -> np.ndarray:
    """0..1, rising with raw, ``cut`` at the threshold."""
    return 1 / (1 + np.exp(-np.clip(raw - threshold + math.log(cut / (1 - cut)), -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality"):
    """(w, threshold), or the score of all documents where the labels are of one kind."""
    told = labels.select(F.col(id_col).cast("long").alias("__label_id"), F.col(label_col).cast("int").alias("__y")).filter("__label_id is not null and __y in (0, 1)")
    told = told.filter(~held_out(F.col("__label_id"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__label_id"), F.col(text_col).cast("string").alias("text"))
    both = sized_join(texts, told, "__label_id").select("text", F.col("__label_id").alias("id"), F.col("__y").alias("y"))

    def run(batches):
        fresh_worker()
        for batch in batches:
            x = [text_features(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "id", "y"])

    # one row for each label row, however often the document's id repeats
    rows = materialize(both.mapInArrow(run, "x array<double>, id long, y int").groupBy("id", "y").agg(F.min("x").alias("x")), "quality-rows")
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    good, bad = count.get(1, 0), count.get(0, 0)
    if not bad:
        return 1.0
    if not good:
        return 0.0
    if good + bad <= GROUP_ROWS:
        taught = sorted(rows.select("x", "y").collect())
        return fit_bradley_terry(np.array([r["x"] for r in taught]), np.array([r["y"] for r in taught]))
    groups = -(-(good + bad) // GROUP_ROWS)
    copies = lambda n: F.lit(min(groups, -(-GROUP_LEAST * groups // n)))
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies(good)).otherwise(copies(bad)) - 1))
    dealt = rows.select("id", "y", "x", again.alias("j"))
    dealt = dealt.select(F.pmod(F.xxhash64("id") + F.col("j"), F.lit(groups).cast("long")).alias("group"), "x", "y", (F.col("j") == 0).cast("int").alias("own"))
    packed = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_pack, "group long, x binary, y binary, own binary")
    return fit_groups(materialize(packed, "quality-groups"), good + bad, bad)


def scores_of(texts, model) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    x = np.array([text_features(t) for t in texts]).reshape(-1, N_FEATURES)
    return unit_score((x * model[0]).sum(1), model[1])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """(id, held_out, score) for each row."""
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        fresh_worker()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores_of([t.as_py() for t in batch.column(1)], model), pa.float64())], ["id", "score"])

    out = rows.mapInArrow(run, "id long, score double")
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least ``cut``, all columns as they are."""
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    place = docs.columns.index(text_col)

    def run(batches):
        fresh_worker()
        for batch in batches:
            score = scores_of([t.as_py() for t in batch.column(place)], model)
            yield batch.filter(pa.array(score >= cut))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: a quality score for every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels)
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
