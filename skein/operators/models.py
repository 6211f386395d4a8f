"""Classifiers and the isolation forest over feature tables, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skein.functions.columns import vector
from skein.operators.prep import apply_scaler, class_weights, fit_scaler
from skein.operators.ranks import exact_quantiles
from skein.schema import SEED
from skein.session import lookup_join, settle

N_TREES = 200
MAX_DEPTH = 20
DEPTH_CAP = 30
FOURIER_TERMS = 256
FOREST_TREES = 100
FOREST_SAMPLE = 256
CONTAMINATION = 0.2
#: Bytes of rows in one packed record, and records of a batch that are worked on together (they fit a core's cache).
PACK_BYTES = 4096
PACKS_AT_ONCE = 64
#: Rows of a batch that are worked on together where they are not packed.
ROWS_AT_ONCE = 4096


def scale_on_train(table: DataFrame, features: list[str]) -> DataFrame:
    """Standardise with the mean and population std of the training rows only."""
    return apply_scaler(table, fit_scaler(table.where("split = 'train'"), features))


def _labelled(train: DataFrame, label: str, balanced: bool) -> DataFrame:
    if not balanced:
        return train.withColumn("weight", F.lit(1.0))
    return lookup_join(train, class_weights(train, label).select(label, "weight"), [label])


def _stages(features: list[str], label: str) -> list:
    return [
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
    ]


def fit_logistic(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    balanced: bool = True,
    c: float = 1.0,
    max_iter: int = 1000,
) -> PipelineModel:
    """Multinomial logistic regression with an L2 penalty of strength 1/c on the summed loss."""
    rows = _labelled(train, label, balanced)
    n = rows.count()
    model = LogisticRegression(
        labelCol="label_index",
        weightCol="weight",
        family="multinomial",
        maxIter=max_iter,
        regParam=1.0 / (c * n),
        standardization=False,
    )
    return Pipeline(stages=[*_stages(features, label), model]).fit(rows)


def fit_forest(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    balanced: bool = True,
    n_trees: int = N_TREES,
    max_depth: int = MAX_DEPTH,
    min_leaf: int = 2,
    seed: int = SEED,
) -> PipelineModel:
    """Random forest; Spark has no deeper trees than 30, so a greater depth raises an error."""
    if max_depth > DEPTH_CAP:
        raise ValueError(f"max_depth {max_depth} is over {DEPTH_CAP}")
    model = RandomForestClassifier(
        labelCol="label_index",
        weightCol="weight",
        numTrees=n_trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[*_stages(features, label), model]).fit(_labelled(train, label, balanced))


def _fourier_basis(n: int, gamma: float, terms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (n, terms)), rng.uniform(0.0, 2.0 * np.pi, terms)


def _fourier(x: np.ndarray, basis: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Random cosine features, whose inner products approach an RBF kernel, and a constant 1."""
    weights, phases = basis
    out = np.ones((len(x), len(phases) + 1))
    waves = x @ weights
    waves += phases
    np.multiply(np.cos(waves, out=waves), np.sqrt(2.0 / len(phases)), out=out[:, :-1])
    return out


def couple(pairwise: np.ndarray, pairs: list[tuple[int, int]], k: int) -> np.ndarray:
    """(n, k) class probabilities from (n, pairs) probabilities of the first class of each pair:
    those that disagree least with all pairs, by one linear system a row."""
    n = len(pairwise)
    if k == 1:
        return np.ones((n, 1))
    r = np.zeros((n, k, k))
    for p, (a, b) in enumerate(pairs):
        r[:, a, b] = np.clip(pairwise[:, p], 1e-7, 1 - 1e-7)
        r[:, b, a] = 1.0 - r[:, a, b]
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = -r * r.transpose(0, 2, 1)
    diagonal = np.arange(k)
    system[:, diagonal, diagonal] = (r * r).sum(axis=1)
    system[:, :k, k] = system[:, k, :k] = 1.0
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1.0
    found = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0.0, None)
    return found / found.sum(axis=1, keepdims=True)


class KernelSvm:
    """RBF SVM: random Fourier features, one linear machine per pair of classes, a curve from each
    pair's margins to its probability, and class probabilities by pairwise coupling."""

    def __init__(
        self,
        features: list[str],
        gamma: float,
        seed: int,
        index: PipelineModel,
        slopes: np.ndarray,
        curves: np.ndarray,
        settings: dict[str, str],
    ):
        self.features, self.gamma, self.seed, self.index = list(features), gamma, seed, index
        #: (terms + 1, pairs) with the offsets last; (pairs, 2) slope and offset of the curves
        self.slopes, self.curves, self.settings = slopes, curves, settings

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return _class_pairs(len(model_classes(self)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``label_index``, ``probability`` and ``prediction`` in one pass over the raw columns."""
        basis = _fourier_basis(len(self.features), self.gamma, len(self.slopes) - 1, self.seed)
        slopes, curves, pairs, k = self.slopes, self.curves, self.pairs, len(model_classes(self))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def probabilities(rows: pd.Series) -> pd.Series:
            margins = _fourier(np.stack(rows.to_numpy()).astype(float), basis) @ slopes
            return pd.Series(list(couple(_sigmoid(margins * curves[:, 0] + curves[:, 1]), pairs, k)))

        scored = self.index.transform(df).withColumn("_p", probabilities(vector(self.features)))
        best = F.array_position(F.col("_p"), F.array_max("_p")) - 1
        return scored.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("_p")).drop("_p")

    @property
    def stages(self) -> list:
        return list(self.index.stages)

    def save(self, path: str) -> None:
        self.index.write().overwrite().save(f"{path}/index")
        row = (self.features, self.gamma, self.seed, self.slopes.tolist(), self.curves.tolist(), self.settings)
        schema = (
            "features array<string>, gamma double, seed long, slopes array<array<double>>, "
            "curves array<array<double>>, settings map<string,string>"
        )
        SparkSession.active().createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/margins")

    @classmethod
    def load(cls, path: str) -> KernelSvm:
        r = SparkSession.active().read.parquet(f"{path}/margins").first()
        index = PipelineModel.load(f"{path}/index")
        curves = np.array(r["curves"]).reshape(-1, 2)
        return cls(r["features"], r["gamma"], r["seed"], index, np.array(r["slopes"]), curves, dict(r["settings"]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _class_pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a + 1, k)]


def _task_sums(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``part``, a flat array, over all batches of rows. A task sends one array, and the arrays
    are added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(batch)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    found = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one row a parameter
    return np.array([r["v"] for r in found])


def _matrix(arrays: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix; a missing number is NaN."""
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


def _whole(arrays: pa.Array) -> np.ndarray:
    """Whether no number of an array is missing."""
    return arrays.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(len(arrays), -1).all(axis=1)


def _packed(flat: np.ndarray) -> pa.RecordBatch:
    """Rows of a matrix, some in each byte string, for tables that are read in many passes: a pass has
    nothing to parse. A string has about ``PACK_BYTES``, so that a batch of the session's usual 10,000
    stays in some tens of MB."""
    step = max(1, PACK_BYTES // flat[0].nbytes)
    packs = [flat[i : i + step].tobytes() for i in range(0, len(flat), step)]
    return pa.RecordBatch.from_arrays([pa.array(packs, pa.binary())], names=["pack"])


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The packed rows again, as matrices that fit a core's cache."""
    for start in range(0, batch.num_rows, PACKS_AT_ONCE):
        yield np.frombuffer(b"".join(batch.column(0).slice(start, PACKS_AT_ONCE).to_pylist())).reshape(-1, width)


def _pack_rows(rows: DataFrame) -> DataFrame:
    """Packed (weight, label_index, x..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("weight", "label_index")]
                yield _packed(np.column_stack([*numbers, _matrix(batch.column("x"))]))

    return rows.select("weight", "label_index", "x").mapInArrow(run, "pack binary")


def _pair_sums(packs: DataFrame, basis, pairs: list[tuple[int, int]], work: Callable) -> np.ndarray:
    """Sums over all packed rows of ``work(z, sign, weight)``, a flat array: z the Fourier features,
    sign (rows, pairs) +1 and -1 for the two classes of a pair and 0 for others. One pass for all pairs."""
    first, second = np.array(pairs).T

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = 0.0
        for flat in _unpacked(batch, len(basis[0]) + 2):
            label = flat[:, 1:2]
            sign = (label == first).astype(float) - (label == second)
            total = total + work(_fourier(flat[:, 2:], basis), sign, flat[:, 0])
        return total

    return _task_sums(packs, part)


def _own_pairs(pairs: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, k - 1) numbers of the pairs that each class belongs to, and whether it is their first class."""
    own = np.array([[p for p, pair in enumerate(pairs) if c in pair] for c in range(k)])
    return own, np.array([[pairs[p][0] == c for p in line] for c, line in enumerate(own)])


def _pack_margins(packs: DataFrame, basis, slopes: np.ndarray, own: np.ndarray) -> DataFrame:
    """Packed (label_index, margins..) of packed rows, in the pairs of a row's own class alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for flat in _unpacked(batch, len(basis[0]) + 2):
                margins = _fourier(flat[:, 2:], basis) @ slopes
                found.append(np.column_stack([flat[:, 1], np.take_along_axis(margins, own[flat[:, 1].astype(int)], axis=1)]))
            if found:
                yield _packed(np.concatenate(found))

    return packs.mapInArrow(run, "pack binary")


def _curve_sums(margins: DataFrame, curves: np.ndarray, own: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """For each pair the sums of error times margin and of errors, then the loss of all pairs."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = 0.0
        for flat in _unpacked(batch, own.shape[1] + 1):
            label, margin = flat[:, 0].astype(int), flat[:, 1:]
            pair, lead = own[label], leads[label]
            p = np.clip(_sigmoid(margin * curves[pair, 0] + curves[pair, 1]), 1e-12, 1 - 1e-12)
            off = p - lead
            sums = [np.bincount(pair.ravel(), v.ravel(), len(curves)) for v in (off * margin, off)]
            total = total + np.append(np.concatenate(sums), -np.log(np.where(lead, p, 1 - p)).sum())
        return total

    return _task_sums(margins, part)


def _minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``value`` gives the loss and its slope."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < 1e-6:
            break
        d, kept = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + s * (a - (y @ d) / (s @ y))
        size, slope = (1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())), g @ d
        for _ in range(20):
            nf, ng = value(x + size * d)
            if nf <= f + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * d, ng - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        small = abs(f - nf) <= 1e-9 * max(1.0, abs(f))
        x, f, g = x + s, nf, ng
        if small:
            break
    return x


def kernel_width(df: DataFrame, features: list[str]) -> float:
    """1 / (features * variance of all cells), from per-column moments in one pass."""
    stats = fit_scaler(df, features).collect()
    means = np.array([r["mean"] for r in stats])
    spread = np.array([r["std"] for r in stats])
    variance = float((spread**2 + means**2).mean() - means.mean() ** 2)
    return 1.0 / (len(features) * variance) if variance > 0 else 1.0


def fit_svm(
    train: DataFrame,
    features: list[str],
    label: str = "label",
    balanced: bool = True,
    c: float = 1.0,
    max_iter: int = 100,
    seed: int = SEED,
    terms: int = FOURIER_TERMS,
) -> KernelSvm:
    """One machine per pair of classes, all fitted in the same passes over the rows: squared hinge
    loss with a penalty of strength 1/c on its sum, then a logistic curve over each pair's margins.
    Raw vectors are packed and settled once, their Fourier features formed inside the tasks of a pass;
    the curves' passes read margins, which are settled as well."""
    gamma = kernel_width(train, features)
    labelled = _labelled(train, label, balanced)
    index = Pipeline(stages=_stages(features, label)[:1]).fit(labelled)
    k = len(index.stages[0].labels)
    pairs, basis = _class_pairs(k), _fourier_basis(len(features), gamma, terms, seed)
    settings = {"c": str(c), "maxIter": str(max_iter), "terms": str(terms), "gamma": repr(gamma)}
    if not pairs:
        return KernelSvm(features, gamma, seed, index, np.zeros((terms + 1, 0)), np.zeros((0, 2)), settings)
    packs = settle(_pack_rows(index.transform(labelled).select("weight", "label_index", vector(features).alias("x"))))
    n, shape = labelled.count(), (terms + 1, len(pairs))

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        slopes = flat.reshape(shape)

        def work(z: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
            slack = np.where(sign != 0, np.maximum(0.0, 1.0 - sign * (z @ slopes)), 0.0)
            pull = weight[:, None] * sign * slack
            return np.append((-2.0 * z.T @ pull).ravel(), (weight[:, None] * slack * slack).sum())

        sums = _pair_sums(packs, basis, pairs, work)
        free = slopes.copy()
        free[-1] = 0.0  # offsets are not penalised
        return (sums[-1] * c + 0.5 * (free * free).sum()) / n, ((sums[:-1] * c).reshape(shape) + free).ravel() / n

    slopes = _minimise(loss, np.zeros(shape).ravel(), max_iter).reshape(shape)

    own, leads = _own_pairs(pairs, k)
    margins = settle(_pack_margins(packs, basis, slopes, own))

    def curve(flat: np.ndarray) -> tuple[float, np.ndarray]:
        sums = _curve_sums(margins, flat.reshape(-1, 2), own, leads)
        return sums[-1] / n, (sums[:-1].reshape(2, -1).T / n).ravel()

    curves = _minimise(curve, np.tile([1.0, 0.0], len(pairs)), 50).reshape(-1, 2)
    return KernelSvm(features, gamma, seed, index, slopes, curves, settings)


def model_classes(model) -> list[str]:
    """Class names in the order of the model's probability vector."""
    return list(model.stages[0].labels)


def check_class_order(model, classes: list[str]) -> None:
    """Raise unless probabilities come in exactly this class order."""
    if model_classes(model) != list(classes):
        raise ValueError(f"class order {model_classes(model)} differs from {list(classes)}")


def score_rows(model: Transformer | KernelSvm, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., predicted, probabilities) with class names and a plain array."""
    names = F.array(*[F.lit(c) for c in model_classes(model)])
    scored = model.transform(df)
    return scored.select(
        *keep,
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
        vector_to_array("probability").alias("probabilities"),
    )


def coefficient_table(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(class, feature, coefficient) of a logistic regression; the intercept is feature null."""
    fitted = model.stages[-1]
    matrix, offset = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    rows = [(c, f, float(v)) for c, line in zip(model_classes(model), matrix) for f, v in zip(features, line)]
    rows += [(c, None, float(v)) for c, v in zip(model_classes(model), offset)]
    return spark.createDataFrame(rows, "class string, feature string, coefficient double")


def _linear_terms(coefficients: DataFrame) -> dict[str, Column]:
    """The linear term of each class as a column; the table has one row a class and feature."""
    terms: dict[str, Column] = {}
    for r in coefficients.orderBy("class", F.col("feature").asc_nulls_first()).collect():
        part = F.lit(r["coefficient"]) if r["feature"] is None else F.lit(r["coefficient"]) * F.col(r["feature"])
        terms[r["class"]] = terms[r["class"]] + part if r["class"] in terms else part
    return terms


def score_columns(df: DataFrame, coefficients: DataFrame, keep: list[str]) -> DataFrame:
    """As ``score_rows`` for a logistic regression, from its coefficient table alone and in column
    expressions: (keep.., predicted, probabilities) in the order of the sorted classes."""
    terms = _linear_terms(coefficients)
    names = list(terms)
    rows = df.select(*keep, F.array(*terms.values()).alias("_terms"))
    # the largest term is taken off, so that no exponential overflows
    powers = F.transform("_terms", lambda t: F.exp(t - F.array_max("_terms")))
    rows = rows.withColumn("_powers", powers)
    rows = rows.withColumn("_total", F.aggregate("_powers", F.lit(0.0), lambda s, x: s + x))
    best = F.array_position(F.col("_terms"), F.array_max("_terms")).cast("int")
    return rows.select(
        *keep,
        F.element_at(F.array(*[F.lit(c) for c in names]), best).alias("predicted"),
        F.transform("_powers", lambda x: x / F.col("_total")).alias("probabilities"),
    )


def penalty_gradient(
    train: DataFrame, model: PipelineModel, features: list[str], label: str = "label", balanced: bool = True, c: float = 1.0
) -> DataFrame:
    """(class, feature, gradient): slope of the penalised mean loss at the fitted coefficients, near
    0 at the optimum; feature null is the intercept. One pass of sums over the training rows; a row
    with a missing feature takes no part in them."""
    rows = _labelled(train, label, balanced)
    found = rows.agg(F.count(F.lit(1)), F.sum("weight")).first()
    strength, weight = 1.0 / (c * found[0]), found[1]
    table = coefficient_table(model, features, train.sparkSession)
    held = {(r["class"], r["feature"]): r["coefficient"] for r in table.collect()}
    classes = model_classes(model)
    slopes = np.array([[held[name, f] for f in features] for name in classes])
    offsets = np.array([held[name, None] for name in classes])

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = 0.0
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(start, ROWS_AT_ONCE)
            whole = _whole(some.column("x"))
            x = _matrix(some.column("x"))[whole]
            terms = x @ slopes.T + offsets
            # the largest term is taken off, so that no exponential overflows
            powers = np.exp(terms - terms.max(axis=1, keepdims=True))
            place, weight = (some.column(c).to_numpy(zero_copy_only=False)[whole, None] for c in ("place", "weight"))
            off = weight * (powers / powers.sum(axis=1, keepdims=True) - (place == np.arange(len(classes))))
            total = total + np.column_stack([off.sum(axis=0), off.T @ x]).ravel()
        return total

    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    vectors = rows.where(F.col(label).isNotNull()).select(place.alias("place"), "weight", vector(features).alias("x"))
    total = _task_sums(vectors, part).reshape(len(classes), -1)
    out = []
    for k, name in enumerate(classes):
        out.append((name, None, float(total[k, 0] / weight)))
        out += [(name, f, float(total[k, j] / weight + strength * held[name, f])) for j, f in enumerate(features, 1)]
    return train.sparkSession.createDataFrame(out, "class string, feature string, gradient double")


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a forest; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def cross_validate(
    folded: DataFrame, fit: Callable[[DataFrame], object], label: str = "label", fold: str = "fold"
) -> DataFrame:
    """(fold, accuracy) over the folds; the caller's ``fit`` takes training rows."""
    parts = None
    for f in [r[0] for r in folded.select(fold).distinct().orderBy(fold).collect()]:
        model = fit(folded.where(F.col(fold) != f))
        hit = (F.col(label) == F.col("predicted")).cast("int")
        row = (
            score_rows(model, folded.where(F.col(fold) == f), [label])
            .agg(F.avg(hit).alias("accuracy"))
            .select(F.lit(f).alias("fold"), "accuracy")
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of the fold accuracies."""
    return scores.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def model_catalogue(models: dict[str, object], features: list[str], spark: SparkSession) -> DataFrame:
    """(model, n_features, n_classes, params, untuned): settings of fitted models.

    ``untuned`` marks a model whose estimator parameters were all left at their defaults.
    """
    rows = []
    for name, model in models.items():
        if isinstance(model, KernelSvm):
            rows.append((name, len(features), len(model_classes(model)), model.settings, False))
            continue
        last = model.stages[-1]
        chosen = {p.name: str(v) for p, v in last.extractParamMap().items()}
        tuned = [
            p.name
            for p in last.params
            if last.isSet(p) and p.name not in {"labelCol", "featuresCol", "weightCol", "predictionCol", "seed"}
        ]
        rows.append((name, len(features), len(model_classes(model)), chosen, not tuned))
    return spark.createDataFrame(
        rows, "model string, n_features int, n_classes int, params map<string,string>, untuned boolean"
    )


# --- isolation forest ---------------------------------------------------------

TREE_SCHEMA = "tree int, axis array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int) -> dict[str, list]:
    nodes: dict[str, list] = {k: [] for k in ("axis", "cut", "left", "right", "size")}
    todo = [(points, 0, -1, "left")]
    while todo:
        part, level, parent, side = todo.pop()
        here = len(nodes["axis"])
        if parent >= 0:
            nodes[side][parent] = here
        low, high = part.min(axis=0), part.max(axis=0)
        open_axes = np.flatnonzero(high > low)
        inner = level < depth and len(part) > 1 and len(open_axes) > 0
        axis = int(rng.choice(open_axes)) if inner else -1
        cut = float(rng.uniform(low[axis], high[axis])) if inner else 0.0
        for key, value in (("axis", axis), ("cut", cut), ("left", -1), ("right", -1), ("size", len(part))):
            nodes[key].append(value)
        if inner:
            below = part[:, axis] <= cut
            todo.append((part[below], level + 1, here, "left"))
            todo.append((part[~below], level + 1, here, "right"))
    return nodes


def draw_samples(
    df: DataFrame, features: list[str], unique: str, n_trees: int, sample: int, seed: int = SEED
) -> DataFrame:
    """(tree, id, x, draw): for each tree an own uniform sample of exactly ``sample`` rows of the
    table (all of them if it has fewer), without repeats.

    Every row is a candidate of every tree. A task jumps from one candidate of a tree to the next
    by a geometric step, so its work is one pass and the rows it draws; each candidate has a random
    key, and the ``sample`` smallest keys of a tree stay. Should a tree come out short, all are
    drawn again at twice the rate. The draw is seeded by partition: it repeats on a table that is
    read in the same partitions, and is settled before use.
    """
    rows = df.select(unique, vector(features).alias("x"))
    n_rows = df.count()
    wanted = min(sample, n_rows)
    schema = T.StructType(
        [
            T.StructField("tree", T.IntegerType()),
            rows.schema[unique],
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("draw", T.DoubleType()),
        ]
    )

    def candidates(rate: float) -> DataFrame:
        def jump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            coming = rng.geometric(rate, n_trees) - 1  # the next candidate of each tree
            start = 0
            for batch in batches:
                end = start + batch.num_rows
                trees, places = [], []
                while len(due := np.flatnonzero(coming < end)):
                    trees.append(due)
                    places.append(coming[due] - start)
                    coming[due] += rng.geometric(rate, len(due))
                start = end
                if trees:
                    tree, place = np.concatenate(trees), np.concatenate(places)
                    drawn = batch.take(pa.array(place))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree.astype(np.int32)), *drawn.columns, pa.array(rng.random(len(tree)))],
                        names=["tree", unique, "x", "draw"],
                    )

        return settle(rows.mapInArrow(jump, schema))

    # eight deviations above the sample: a short tree is rare
    rate = (wanted + 8 * np.sqrt(wanted) + 8) / max(n_rows, 1)
    while True:
        drawn = candidates(min(rate, 1.0))
        full = drawn.groupBy("tree").count().where(F.col("count") >= wanted).count()
        if full == n_trees or not n_rows:
            break
        rate *= 2
    order = W.partitionBy("tree").orderBy("draw", unique)
    return drawn.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= wanted).drop("_rn")


def fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    unique: str = "flow_id",
    n_trees: int = FOREST_TREES,
    sample: int = FOREST_SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """One row of node arrays per tree, each grown on its own sample of all rows, in parallel
    tasks. A table without rows gives no trees."""
    chosen = draw_samples(df, features, unique, n_trees, sample, seed)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values(["draw", unique])["x"].to_numpy()).astype(float)
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), depth)
        return pd.DataFrame([{"tree": int(key[0]), **nodes}])

    return chosen.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def score_isolation_forest(
    df: DataFrame, forest: DataFrame, features: list[str], keep: list[str] = ("flow_id", "label")
) -> DataFrame:
    """(keep.., score): 2^(-mean path / expected path); larger is more anomalous."""
    trees = [
        {k: np.array(r[k]) for k in ("axis", "cut", "left", "right", "size")} for r in forest.collect()
    ]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.pop("_x").to_numpy()).astype(float)
            total = np.zeros(len(x))
            expected = 1.0
            for t in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                live = np.flatnonzero(t["axis"][at] >= 0)
                while len(live):
                    here = at[live]
                    below = x[live, t["axis"][here]] <= t["cut"][here]
                    at[live] = np.where(below, t["left"][here], t["right"][here])
                    depth[live] += 1
                    live = live[t["axis"][at[live]] >= 0]
                total += depth + _average_path(t["size"][at])
                expected = float(_average_path(t["size"][:1])[0]) or 1.0
            batch["score"] = 2.0 ** (-total / len(shared.value) / expected)
            yield batch

    rows = df.select(*keep, vector(features).alias("_x"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    return rows.mapInPandas(run, schema)


def isolation_flags(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Flag the share of rows with the highest scores."""
    limit = exact_quantiles(scored, ["score"], [1.0 - contamination]).first()["q0"]
    return scored.withColumn("anomaly", F.col("score") > F.lit(limit))
