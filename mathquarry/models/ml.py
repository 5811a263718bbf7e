"""Models over matrices in long format: clustering, reduction, classification.

Input vectors are (row_id, features); ``coo.to_vectors`` makes them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import LDA, GaussianMixture, KMeans, LocalLDAModel
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.session import discard, materialize


def kmeans(vectors: DataFrame, k: int = 63, iterations: int = 100, runs: int = 10, seed: int = 0):
    """The best of ``runs`` seeds by training cost."""
    best = None
    for i in range(runs):
        model = KMeans(k=k, maxIter=iterations, seed=seed + i, initMode="k-means||").fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def gaussian_mixture(vectors: DataFrame, k: int = 64, iterations: int = 100, runs: int = 1, seed: int = 0):
    """The best of ``runs`` seeds by likelihood.

    Covariances are full; ``diagonal_mixture`` has diagonal ones. A variational mixture, which isn't available, is this one too.
    """
    best = None
    for i in range(runs):
        model = GaussianMixture(k=k, maxIter=iterations, seed=seed + i).fit(vectors)
        if best is None or model.summary.logLikelihood > best.summary.logLikelihood:
            best = model
    return best


@dataclass
class DiagonalMixture:
    """Weights, means and variances (k and k x dimensions), and the mean log-likelihood they reached."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    likelihood: float

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Rows x components: log of weight times density."""
        fixed = np.log(np.maximum(self.weights, 1e-300)) - 0.5 * np.log(2 * np.pi * self.variances).sum(axis=1)
        inverse = 1 / self.variances
        return fixed - 0.5 * (x**2 @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1))


def _dense_rows(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def diagonal_mixture(vectors: DataFrame, k: int = 64, iterations: int = 100, runs: int = 1, seed: int = 0) -> DiagonalMixture:
    """The best of ``runs`` seeds by likelihood."""
    return max((_diagonal_run(vectors, k, iterations, seed + i) for i in range(runs)), key=lambda m: m.likelihood)


def _diagonal_run(vectors: DataFrame, k: int, iterations: int, seed: int, tolerance: float = 1e-4, floor: float = 1e-6) -> DiagonalMixture:
    """Expectation and maximisation with diagonal covariances, from the centres of a k-means run.

    Each round is one pass: sums of each component per task, added up by component; k rows of them reach the driver.
    Variances are not below ``floor`` times the mean variance of all rows.  Stops when the mean log-likelihood gains less than ``tolerance``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vector_to_array("features").alias("x"))
    centres = np.array(KMeans(k=k, maxIter=5, seed=seed).fit(vectors).clusterCenters())
    size = centres.shape[1]

    def one_pass(model: DiagonalMixture):
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            m = shared.value
            n, first, second, total = np.zeros(len(m.weights)), np.zeros_like(m.means), np.zeros_like(m.means), 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                x = _dense_rows(b.column("x"))
                joint = m.log_joint(x)
                top = joint.max(axis=1, keepdims=True)
                norm = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
                share = np.exp(joint - norm[:, None])
                n, first, second, total = n + share.sum(axis=0), first + share.T @ x, second + share.T @ x**2, total + norm.sum()
            flat = [np.concatenate([[n[i], total if i == 0 else 0.0], first[i], second[i]]) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["i", "s"])

        places = rows.mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s").alias("at", "v"))
        sums = np.zeros((len(model.weights), 2 + 2 * size))
        for r in places.groupBy("i", "at").agg(F.sum("v").alias("v")).collect():  # k times twice the dimensions
            sums[r["i"], r["at"]] = r["v"]
        shared.unpersist()
        return sums

    start = one_pass(DiagonalMixture(np.ones(1), centres.mean(axis=0, keepdims=True), np.ones((1, size)), 0.0))[0]
    count = max(start[0], 1.0)
    spread = np.maximum(start[2 + size :] / count - (start[2 : 2 + size] / count) ** 2, 0)
    least = max(floor * spread.mean(), 1e-12)
    model = DiagonalMixture(np.full(len(centres), 1 / len(centres)), centres, np.tile(np.maximum(spread, least), (len(centres), 1)), -math.inf)
    for _ in range(iterations):
        sums = one_pass(model)
        n, likelihood = np.maximum(sums[:, 0], 1e-12), float(sums[:, 1].sum() / count)
        means = sums[:, 2 : 2 + size] / n[:, None]
        variances = np.maximum(sums[:, 2 + size :] / n[:, None] - means**2, least)
        done = likelihood - model.likelihood < tolerance
        model = DiagonalMixture(n / n.sum(), means, variances, likelihood)
        if done:
            break
    return model


def diagonal_labels(model: DiagonalMixture, vectors: DataFrame) -> DataFrame:
    """(row_id, cluster): the likeliest component of each row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            best = shared.value.log_joint(_dense_rows(b.column("x"))).argmax(axis=1) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(best.astype(np.int32))], names=["row_id", "cluster"])

    kind = vectors.schema["row_id"].dataType.simpleString()
    return vectors.select("row_id", vector_to_array("features").alias("x")).mapInArrow(run, f"row_id {kind}, cluster int")


def labels(model, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).select("row_id", F.col("prediction").alias("cluster"))


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(row_id, features) with values rounded; sparse vectors stay sparse, dense ones dense."""

    @F.pandas_udf(VectorUDT())
    def make(kind: pd.Series, size: pd.Series, indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"type": kind, "size": size.astype("Int32"), "indices": indices, "values": values})  # how a vector is stored

    stored = vectors.select("row_id", F.unwrap_udt("features").alias("v"))
    return stored.select("row_id", make("v.type", "v.size", "v.indices", F.transform("v.values", lambda x: F.round(x))).alias("features"))


def lda(vectors: DataFrame, topics: int = 250, iterations: int = 20, seed: int = 0) -> LocalLDAModel:
    """A topic model by variational inference (not sampling). Weights are rounded to counts.

    Every iteration takes every row once and, as nothing is drawn, goes the whole step (an exponent of 0). Spark's estimator would
    draw rows with replacement, a twentieth of them by default; that can be turned off in the optimizer below it only.
    """
    counts = materialize(whole_numbers(vectors), "counts")  # read in every iteration
    spark = vectors.sparkSession
    old, new = spark._jvm.org.apache.spark.mllib.clustering, spark._jvm.org.apache.spark.ml.clustering
    rows = getattr(getattr(new, "LDA$"), "MODULE$").getOldDataset(counts._jdf, "features")
    optimizer = old.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setKappa(0.0).setOptimizeDocConcentration(True)
    fitted = old.LDA().setK(topics).setMaxIterations(iterations).setSeed(seed).setOptimizer(optimizer).run(rows)
    discard(counts)
    model = new.LocalLDAModel(LDA().uid, fitted.vocabSize(), fitted, spark._jsparkSession)
    return LocalLDAModel(model)


def topic_words(model, vocab: DataFrame, n: int = 10) -> DataFrame:
    """(topic, place, token, weight): the ``n`` heaviest words of each topic, ascending."""
    t = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip(F.reverse("termIndices").alias("i"), F.reverse("termWeights").alias("w"))).alias("place", "x"))
    return t.join(vocab.select(F.col("idx"), "token"), F.col("x.i") == F.col("idx")).select("topic", "place", "token", F.col("x.w").alias("weight"))


def document_topics(model, vectors: DataFrame) -> DataFrame:
    """(row_id, topic, weight)."""
    return model.transform(vectors).select("row_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))


def svd(vectors: DataFrame, rank: int) -> tuple[DataFrame, list[float]]:
    """(row_id, features) in the space of the ``rank`` largest singular values, and the values.

    Columns aren't centred.  The sign of a dimension is arbitrary.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    rows = MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features").cache()
    width = vectors.first()["features"].size
    if width * rank * 4 > MOST_BYTES:
        raise ValueError(f"a projection of {width} columns to {rank} dimensions is larger than {MOST_BYTES} bytes")
    result = RowMatrix(rows).computeSVD(rank, computeU=False)
    rows.unpersist()
    return project(vectors, result.V.toArray()), [float(s) for s in result.s]


#: Most bytes of a projection that are sent to the executors.
MOST_BYTES = 1 << 29


def project(vectors: DataFrame, v: np.ndarray) -> DataFrame:
    """(row_id, features): rows times the matrix ``v``, in Arrow batches; fails if ``v`` is larger than MOST_BYTES (single precision)."""
    v = np.ascontiguousarray(v, dtype=np.float32)
    if v.nbytes > MOST_BYTES:
        raise ValueError(f"a projection of {v.shape[0]} columns to {v.shape[1]} dimensions takes {v.nbytes} bytes; select columns or dimensions first")
    shared = vectors.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        table = shared.value
        for b in batches:
            x = b.column("x").combine_chunks() if hasattr(b.column("x"), "combine_chunks") else b.column("x")
            indices, values = x.field("indices").to_pylist(), x.field("values").to_pylist()
            rows = [np.asarray(w) @ table[: len(w)] if i is None else np.asarray(w) @ table[np.asarray(i, dtype=np.int64)] for i, w in zip(indices, values)]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * table.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))], names=["row_id", "y"])

    kind = vectors.schema["row_id"].dataType.simpleString()
    dense = vectors.select("row_id", F.unwrap_udt("features").alias("x")).mapInArrow(run, f"row_id {kind}, y array<double>")
    return dense.select("row_id", array_to_vector("y").alias("features"))


@dataclass
class TextClusters:
    """Token lists to clusters: counts, TF-IDF with unit rows, reduction, mixture; the same steps for new documents."""

    weigh: PipelineModel
    v: np.ndarray
    mixture: object

    @classmethod
    def fit(cls, lists: DataFrame, k: int = 64, rank: int = 250, least: int = 1, iterations: int = 100) -> TextClusters:
        """From (row_id, tokens)."""
        steps = [CountVectorizer(inputCol="tokens", outputCol="counts", minDF=float(least)), IDF(inputCol="counts", outputCol="weighted"), Normalizer(p=2.0, inputCol="weighted", outputCol="features")]
        weigh = Pipeline(stages=steps).fit(lists)
        rows = weigh.transform(lists).select("row_id", "features")
        from pyspark.mllib.linalg.distributed import RowMatrix
        from pyspark.mllib.util import MLUtils

        v = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("features"), "features")).computeSVD(rank).V.toArray()
        reduced = project(rows, v).cache()
        mixture = gaussian_mixture(reduced, k, iterations)
        reduced.unpersist()
        return cls(weigh, v, mixture)

    def predict(self, lists: DataFrame) -> DataFrame:
        """(row_id, cluster)."""
        return labels(self.mixture, project(self.weigh.transform(lists).select("row_id", "features"), self.v))


def hash_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key, the same for any partitioning."""
    part = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(train * 10_000)
    return df.filter(part), df.filter(~part)


def linear_svc(train: DataFrame, iterations: int = 100, regularization: float = 0.01):
    """A linear classifier of (features, label) with labels 0 and 1."""
    return LinearSVC(maxIter=iterations, regParam=regularization).fit(train.filter("label is not null").withColumn("label", F.col("label").cast("double")))


def predicted(model, test: DataFrame) -> DataFrame:
    return model.transform(test.filter("label is not null").withColumn("label", F.col("label").cast("double"))).select("row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def word_vectors(lists: DataFrame, size: int = 300, window: int = 10, min_count: int = 1, seed: int = 0):
    """Word vectors of token lists (tokens), by skip-gram in place of a factorisation of co-occurrences."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="tokens", outputCol="vector").fit(lists)


def neighbours(model, word: str, n: int = 20) -> DataFrame:
    return model.findSynonyms(word, n).select("word", "similarity")


# ---------------------------------------------------------------- iterative models for few items


def _small(vectors: DataFrame, most: int) -> DataFrame:
    n = vectors.count()
    if n > most:
        raise ValueError(f"{n} items; this model compares all pairs and takes {most} at most: sample first")
    return vectors.select("row_id", vector_to_array("features").alias("x"))


def affinity_propagation(vectors: DataFrame, damping: float = 0.85, iterations: int = 200, patience: int = 15, most: int = 2000) -> DataFrame:
    """(row_id, exemplar): messages between all pairs of few items, by negative squared distance, until the exemplars stay the same.

    Each round is two aggregates over the pairs, stored; preferences are the median similarity.
    """
    items = _small(vectors, most)
    a, b = items.select(F.col("row_id").alias("i"), F.col("x").alias("xi")), items.select(F.col("row_id").alias("k"), F.col("x").alias("xk"))
    distance = F.aggregate(F.zip_with("xi", "xk", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(F.broadcast(b), how="cross").select("i", "k", (-distance).alias("s"))  # items are few: checked above
    preference = pairs.filter("i <> k").agg(F.expr("percentile(s, 0.5)")).first()[0] or 0.0
    jitter = (F.pmod(F.xxhash64("i", "k"), F.lit(1000)) - 500) * 1e-12
    now = materialize(pairs.withColumn("s", F.when(F.col("i") == F.col("k"), F.lit(float(preference))).otherwise(F.col("s")) + jitter).withColumns({"r": F.lit(0.0), "a": F.lit(0.0)}), "messages")
    last, same = None, 0
    for _ in range(iterations):
        total = F.col("a") + F.col("s")
        best = now.groupBy("i").agg(F.max(total).alias("m1"), F.max_by("k", total).alias("k1"))
        second = now.join(best, "i").filter("k <> k1").groupBy("i").agg(F.max(F.col("a") + F.col("s")).alias("m2"))
        joined = now.join(best, "i").join(second, "i", "left")
        r = F.col("s") - F.when(F.col("k") == F.col("k1"), F.coalesce("m2", F.lit(0.0))).otherwise(F.col("m1"))
        step = joined.withColumn("r", damping * F.col("r") + (1 - damping) * r).select("i", "k", "s", "r", "a")
        positive = F.greatest(F.col("r"), F.lit(0.0))
        sums = step.groupBy("k").agg(F.sum(F.when(F.col("i") != F.col("k"), positive).otherwise(0.0)).alias("others"), F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).alias("own"))
        both = step.join(sums, "k")
        new = F.when(F.col("i") == F.col("k"), F.col("others")).otherwise(F.least(F.lit(0.0), F.col("own") + F.col("others") - positive))
        now = materialize(both.select("i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * new).alias("a")), "messages")
        chosen = tuple(sorted(x[0] for x in now.filter("i = k and a + r > 0").select("i").collect()))
        same = same + 1 if chosen == last else 0
        last = chosen
        if chosen and same >= patience:
            break
    exemplars = now.filter("i = k and a + r > 0").select(F.col("i").alias("k"))
    near = now.join(exemplars, "k").withColumn("score", F.when(F.col("i") == F.col("k"), F.lit(math.inf)).otherwise(F.col("s")))
    return near.groupBy(F.col("i").alias("row_id")).agg(F.max_by("k", "score").alias("exemplar"))


def mean_shift(vectors: DataFrame, bandwidth: float | None = None, iterations: int = 50, most: int = 2000) -> DataFrame:
    """(row_id, cluster): few items moved to the mean of their neighbourhood until they rest; near resting places are one cluster.

    Without a bandwidth it is the mean distance of an item to the nearest third of the others.
    """
    rows = _small(vectors, most).orderBy("row_id").collect()
    if not rows:
        return vectors.select("row_id", F.lit(0).alias("cluster")).limit(0)
    ids, x = [r["row_id"] for r in rows], np.array([r["x"] for r in rows])
    spread = lambda p: np.sqrt(np.maximum(((p[:, None] - x[None]) ** 2).sum(-1), 0))
    if bandwidth is None:
        bandwidth = float(np.sort(spread(x), axis=1)[:, : max(2, len(x) // 3)].max(axis=1).mean()) or 1.0
    moved = x.copy()
    for _ in range(iterations):
        near = (spread(moved) <= bandwidth).astype(float)
        new = near @ x / np.maximum(near.sum(1, keepdims=True), 1)
        rest = np.abs(new - moved).max()
        moved = new
        if rest < 1e-3 * bandwidth:
            break
    centres: list[np.ndarray] = []
    out = []
    for i, p in zip(ids, moved):
        c = next((j for j, q in enumerate(centres) if np.linalg.norm(p - q) <= bandwidth), None)
        if c is None:
            centres.append(p)
            c = len(centres) - 1
        out.append((i, c))
    return vectors.sparkSession.createDataFrame(out, "row_id long, cluster int")
