"""Boosted trees on tables and panels, a seasonal forecaster, and recursive forecasts of many entities in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import holidays
from tessera.operators import panel as panels
from tessera.operators import trend as trends
from tessera.sources.files import roundtrip, workspace

#: (rows below, trees, depth, step): larger tables get more and deeper trees.
TIERS = ((500, 10, 3, 0.2), (5_000, 20, 4, 0.15), (50_000, 20, 5, 0.1), (None, 30, 5, 0.1))


def tier(n_rows: int) -> dict[str, float]:
    for below, trees, depth, step in TIERS:
        if below is None or n_rows < below:
            return {"maxIter": trees, "maxDepth": depth, "stepSize": step}
    raise AssertionError


#: Text features of more values than this are coded by the mean of the label instead of as categories of their own.
MOST_CATEGORIES = 200


def coded(df: DataFrame, text: Sequence[str], target: Column, most: int = MOST_CATEGORIES, weight: Column | None = None) -> list:
    """Stages that give each text feature c a number, __c.

    Up to `most` values are categories. Of more, each value's number is its place by its mean of the target, and trees
    split on that as on any number: the order in which the best split into two sets of values lies for one feature. Null texts and
    texts not seen in training get the number after the last. weight: how many rows each row stands for.
    """
    wide = [c for c in text if df.select(c).distinct().limit(most + 1).count() > most]
    stages = [StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in text if c not in wide]
    mean = F.avg(target) if weight is None else F.sum(target * weight) / F.sum(F.when(target.isNotNull(), weight))
    for c in wide:
        means = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(mean.alias("m"))
        labels = [r.v for r in means.orderBy("m", "v").select("v").toLocalIterator()]  # a fitted indexer holds its values in any case
        stages.append(StringIndexerModel.from_labels(labels, inputCol=c, outputCol=f"__place_{c}", handleInvalid="keep"))
        stages.append(SQLTransformer(statement=f"SELECT *, `__place_{c}` + 0D AS `__{c}` FROM __THIS__"))  # a number, no longer a category
    return stages


#: Rows with equal features are fitted and scored once where each such set of features stands for so many rows or more on the mean.
EACH = 2


def repeats(df: DataFrame, features: Sequence[str], more: Sequence[str] = ()) -> tuple[int, bool]:
    """The number of rows, and whether they are few enough sets of features (and more), by a sketch."""
    n, sets = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*features, *more))).first()
    return n, n >= EACH * sets > 0


def weighted(df: DataFrame, label: str, features: Sequence[str], kind: str) -> DataFrame:
    """(features, label, __weight): one row for all rows with equal features (and class), with their number as its weight and their mean label.

    Squared error and logistic loss of such rows differ from those of the row by nothing a tree can change, so the trees are the same.
    """
    n = F.count(F.lit(1)).cast("double").alias("__weight")
    if kind == "regression":
        return roundtrip(df.groupBy(*features).agg(F.avg(label).alias(label), n))
    return roundtrip(df.groupBy(*features, label).agg(n))


def boosted(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (), kind: str = "regression", seed: int = 42, **params) -> PipelineModel:
    """A pipeline of codes for texts, a vector and boosted trees; more than two classes are taken one against the rest.

    Text features may have any number of values. Null texts and texts not seen in training get a code of their own; null numbers should be
    filled before. Where rows repeat (see EACH), those with equal features and class are fitted as one row with a weight.
    """
    features, cast = [*numeric, *text], "double" if kind == "regression" else "string"
    df = df.withColumn(label, F.col(label).cast(cast))
    n, again = repeats(df, features, [] if kind == "regression" else [label])
    weight = None
    if again and not df.where(F.col(label).isNull()).limit(1).count():  # what a null label does is up to the stages
        df, weight = weighted(df.select(*features, label), label, features, kind), F.col("__weight")
        params = params | {"weightCol": "__weight"}
    options = tier(n) | {"seed": seed, "labelCol": "__label", "featuresCol": "__features", "maxBins": 256} | params
    vector = VectorAssembler(inputCols=[*numeric, *[f"__{c}" for c in text]], outputCol="__features", handleInvalid="keep")
    if kind == "regression":
        df = df.withColumn("__label", F.col(label))
        return Pipeline(stages=[*coded(df, text, F.col("__label"), weight=weight), vector, GBTRegressor(**options)]).fit(df)
    target = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    model: GBTClassifier | OneVsRest = GBTClassifier(**options)
    if df.select(label).distinct().limit(3).count() > 2:
        model = OneVsRest(classifier=model, labelCol="__label", featuresCol="__features", **({"weightCol": "__weight"} if weight is not None else {}))
    codes = coded(target.transform(df), text, F.col("__label"), weight=weight)
    return Pipeline(stages=[target, *codes, vector, model]).fit(df)


def contributions(met: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """The Shapley values of a leaf's m features for each row of met (k x m: which conditions hold): k x m.

    The leaf adds to a set of known features its value, if their conditions hold, times the shares of training rows that the others let
    through. Its sums over all sets of one size are the coefficients of a polynomial with one factor for each other feature.
    """
    k, m = met.shape
    out = np.zeros((k, m))
    weights = [1.0 / (m * comb(m - 1, j)) for j in range(m)]
    for f in range(m):
        sums = np.zeros((k, m))
        sums[:, 0] = 1.0
        for g in range(m):
            if g != f:
                sums[:, 1:] = sums[:, 1:] * shares[g] + sums[:, :-1] * met[:, g, None]
                sums[:, 0] *= shares[g]
        out[:, f] = value * (sums @ weights) * (met[:, f] - shares[f])
    return out


class Trees:
    """An ensemble as arrays: small enough (trees times 2 to the depth) to be sent to every task."""

    def __init__(self, nodes: pd.DataFrame, weights: Sequence[float]):
        self.weights = list(weights)
        self.trees = []
        self._leaves: list[list[dict]] | None = None
        for _, t in nodes.groupby("tree", sort=True):
            t = t.sort_values("id").set_index("id")
            self.trees.append({c: t[c].to_numpy() for c in ("left", "right", "feature", "prediction", "gain", "cover")} | {"threshold": t.threshold.to_numpy(float), "inside": t.inside.tolist()})

    def _goes_left(self, t: dict, k: int, x: np.ndarray) -> np.ndarray:
        v = x[:, int(t["feature"][k])]
        return np.isin(v, t["inside"][k]) if t["inside"][k] is not None else v <= t["threshold"][k]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for w, t in zip(self.weights, self.trees, strict=True):
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, rows = stack.pop()
                if t["left"][k] < 0:
                    out[rows] += w * t["prediction"][k]
                elif len(rows):
                    left = self._goes_left(t, k, x[rows])
                    stack += [(int(t["left"][k]), rows[left]), (int(t["right"][k]), rows[~left])]
        return out

    #: Leaves of more features than this have no table of all masks; only the masks that rows show are worked out.
    WIDE = 10

    def leaves(self) -> list[list[dict]]:
        """Of each tree its leaves: value, features, shares and the conditions on each feature (node, went left), with a table from masks to Shapley values."""
        if self._leaves is None:
            self._leaves = []
            for w, t in zip(self.weights, self.trees, strict=True):
                found, stack = [], [(0, {}, {})]
                while stack:
                    k, shares, conditions = stack.pop()
                    if t["left"][k] >= 0:
                        f = int(t["feature"][k])
                        for child, left in ((int(t["left"][k]), True), (int(t["right"][k]), False)):
                            share = t["cover"][child] / max(t["cover"][k], 1e-12)
                            stack.append((child, shares | {f: shares.get(f, 1.0) * share}, conditions | {f: [*conditions.get(f, []), (k, left)]}))
                        continue
                    leaf = {"value": w * t["prediction"][k], "features": list(shares), "shares": np.array(list(shares.values())), "conditions": list(conditions.values())}
                    m = len(shares)
                    if m <= self.WIDE:
                        leaf["table"] = contributions((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float), leaf["shares"], leaf["value"])
                    found.append(leaf)
                self._leaves.append(found)
        return self._leaves

    def goes_left(self, x: np.ndarray) -> list[dict[int, np.ndarray]]:
        """Of each tree, for each split, which rows go left."""
        return [{int(k): self._goes_left(t, k, x) for k in np.flatnonzero(t["left"] >= 0)} for t in self.trees]

    def shap(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Path-dependent Shapley values of each row and feature, and the expected value: a leaf looks its part up by the mask of conditions that a row meets."""
        out, base = np.zeros((x.shape[1], len(x))), 0.0
        for leaves, left in zip(self.leaves(), self.goes_left(x), strict=True):
            sides = {(k, True): v for k, v in left.items()} | {(k, False): ~v for k, v in left.items()}
            for leaf in leaves:
                base += leaf["value"] * float(np.prod(leaf["shares"]))
                mask = np.zeros(len(x), np.int64)
                for j, conditions in enumerate(leaf["conditions"]):
                    met = sides[conditions[0]]
                    for c in conditions[1:]:
                        met = met & sides[c]
                    mask |= met.astype(np.int64) << j
                table = leaf.get("table")
                if table is None:
                    seen, mask = np.unique(mask, return_inverse=True)
                    table = contributions((seen[:, None] >> np.arange(len(leaf["features"])) & 1).astype(float), leaf["shares"], leaf["value"])
                for j, f in enumerate(leaf["features"]):
                    out[f] += table[mask, j]
        return out.T, base

    def steps(self, x: np.ndarray, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """The prediction of each row as its feature moves: ascending thresholds t, and for each row the values at or below t[0], above it up to t[1], ..., above the last.

        A leaf that a row reaches but for this feature adds its value over an interval of thresholds: at one end it comes in, at the other it
        goes, and the running sum of these changes is the prediction.
        """
        own = [sorted({float(t["threshold"][k]) for k in np.flatnonzero((t["left"] >= 0) & (t["feature"] == feature))}) for t in self.trees]
        thresholds = np.array(sorted(set().union(*map(set, own))))
        changes = np.zeros((len(thresholds) + 2, len(x)))
        for leaves, left, t in zip(self.leaves(), self.goes_left(x), self.trees, strict=True):
            for leaf in leaves:
                met, first, last = np.ones(len(x), bool), 0, len(thresholds)  # segments that the leaf covers
                for f, conditions in zip(leaf["features"], leaf["conditions"], strict=True):
                    for k, went_left in conditions:
                        if f != feature:
                            met = met & (left[k] if went_left else ~left[k])
                            continue
                        at = int(np.searchsorted(thresholds, t["threshold"][k]))
                        first, last = (first, min(last, at)) if went_left else (max(first, at + 1), last)
                if first <= last:
                    changes[first] += leaf["value"] * met
                    changes[last + 1] -= leaf["value"] * met
        return thresholds, np.cumsum(changes, axis=0)[:-1].T

    def gains(self, n: int) -> np.ndarray:
        """Mean gain of the splits on each feature, 0 for unused ones."""
        total, count = np.zeros(n), np.zeros(n)
        for t in self.trees:
            for k in np.flatnonzero(t["left"] >= 0):
                total[int(t["feature"][k])] += t["gain"][k]
                count[int(t["feature"][k])] += 1
        return np.divide(total, count, out=np.zeros(n), where=count > 0)


def trees_of(model: PipelineModel, of_class: int = 0) -> Trees:
    """The trees of the last stage, or of its model of one class against the rest."""
    last = model.stages[-1]
    last = last.models[of_class] if isinstance(last, OneVsRestModel) else last
    nodes = []

    def walk(tree: int, node, ids: list[int]) -> int:
        me = len(ids)
        ids.append(me)
        inner = node.numDescendants() > 0
        row = {"tree": tree, "id": me, "left": -1, "right": -1, "feature": -1, "threshold": np.nan, "inside": None, "prediction": node.prediction(), "gain": 0.0, "cover": float(node.impurityStats().count())}
        nodes.append(row)
        if inner:
            split = node.split()
            row |= {"feature": split.featureIndex(), "gain": node.gain()}
            if split.getClass().getSimpleName() == "CategoricalSplit":
                row["inside"] = [float(v) for v in split.leftCategories()]
            else:
                row["threshold"] = split.threshold()
            row["left"] = walk(tree, node.leftChild(), ids)
            row["right"] = walk(tree, node.rightChild(), ids)
        return me

    for i, t in enumerate(last.trees):
        walk(i, t._call_java("rootNode"), [])
    return Trees(pd.DataFrame(nodes), [float(w) for w in last.treeWeights])


def save_and_load(model: PipelineModel) -> PipelineModel:
    path = workspace(_session())
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def _session():
    return SparkSession.getActiveSession()


def gain_importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    gains = trees_of(model).gains(len(names))
    return _session().createDataFrame([(n, float(g)) for n, g in zip(names, gains, strict=True)], "feature string, gain double").orderBy(F.desc("gain"), "feature")


def with_probabilities(df: DataFrame, model: PipelineModel, to: str = "probabilities") -> DataFrame:
    """df with the prediction and an array of the probability of each class, in the order of the label's codes.

    Of models of one class against the rest, each gives its own class's probability, and they are divided by their sum.
    """
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    if not isinstance(model.stages[-1], OneVsRestModel):
        return scored.withColumn(to, vector_to_array("probability"))
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    return scored.withColumn(to, F.transform(each, lambda p: p / F.aggregate(each, F.lit(0.0), lambda a, q: a + q)))


def shap_values(df: DataFrame, model: PipelineModel, key: str, names: Sequence[str]) -> DataFrame:
    """(key, class, feature, value, base, prediction) of each row and feature; base + the sum of a row's values is its prediction (of a class: its margin).

    class is 0 but for models of one class against the rest, which have values for each. Where rows repeat (see EACH), each set of features
    is worked out once and joined to its rows.
    """
    last = model.stages[-1]
    n_classes = len(last.models) if isinstance(last, OneVsRestModel) else 1
    known = [trees_of(model, c) for c in range(n_classes)]
    trees, bases = _session().sparkContext.broadcast(known), [t.shap(np.zeros((0, len(names))))[1] for t in known]
    inputs = [s for s in model.stages[:-1] if not (isinstance(s, StringIndexerModel) and s.getOutputCol() == "__label")]
    features = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"__x{i}") for i, c in enumerate(inputs[-1].getInputCols())]
    x = [f"__x{i}" for i in range(len(features))]

    def run(batches):
        for b in batches:
            own = np.stack([b.column(c).to_numpy() for c in x], axis=1)
            values = np.concatenate([t.shap(own)[0] for t in trees.value], axis=1)
            predictions = np.stack([t.predict(own) for t in trees.value], axis=1)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) for v in (values, predictions)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "__values", "__predictions"])

    rows = PipelineModel(inputs[:-1]).transform(df).select(F.col(key).alias("__key"), *features)
    found = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__values", "__predictions")]
    scored = lambda t: t.mapInArrow(run, T.StructType([*t.schema.fields, *found]))
    if repeats(rows, x)[1]:
        rows = rows.join(roundtrip(scored(rows.select(*x).distinct())), x)
    else:
        rows = scored(rows)
    each = [
        F.struct(F.lit(c).cast("int").alias("class"), F.lit(n).alias("feature"), F.get("__values", F.lit(c * len(names) + i)).alias("value"), F.lit(float(bases[c])).alias("base"), F.get("__predictions", F.lit(c)).alias("prediction"))
        for c in range(n_classes)
        for i, n in enumerate(names)
    ]
    return rows.select(F.col("__key").alias(key), F.inline(F.array(*each)))


def shap_importance(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature")


def importance(df: DataFrame, model: PipelineModel, key: str, names: Sequence[str]) -> DataFrame:
    """shap_importance of shap_values. Where rows repeat (see EACH), each set of features counts as often as it has rows, and no row is joined to its values."""
    if not repeats(df, names)[1]:
        return shap_importance(shap_values(df, model, key, names))
    values = shap_values(roundtrip(df.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"))), model, "__rows", names)
    mean = F.sum(F.abs("value") * F.col("__rows")) / F.sum("__rows")
    return values.groupBy("feature").agg(mean.alias("importance")).orderBy(F.desc("importance"), "feature")


def lever_search(df: DataFrame, model: PipelineModel, names: Sequence[str], lever: str, lo: Column, hi: Column, goal: Column) -> DataFrame:
    """df with best, the value of the lever within lo and hi whose prediction comes nearest to the goal, and reached, that prediction.

    The prediction is a step function of the lever, so all its values within the bounds are looked at, not only those that bisection meets. Of
    equally near values the nearest to the row's own counts, then the smaller. names are the model's features in their order. Of a
    classifier of two classes, goal and reached are probabilities of the second. Rows with missing or inverted bounds, or a missing
    goal, get nulls. Raises if the lever is no numeric column and feature of its own, or the model has more than two classes.
    """
    from pyspark.ml.functions import vector_to_array

    if lever not in df.columns or lever not in names:
        raise ValueError(f"no such lever: {lever}")
    if not isinstance(df.schema[lever].dataType, T.NumericType):
        raise TypeError(f"the lever {lever} is no number")
    last = model.stages[-1]
    if isinstance(last, OneVsRestModel):
        raise ValueError("a model of more than two classes has no single prediction")
    classes, at = isinstance(last, GBTClassificationModel), list(names).index(lever)
    trees = df.sparkSession.sparkContext.broadcast(trees_of(model))
    columns, row = df.columns, F.struct(*[df[c] for c in df.columns])
    asked = df.select(*columns, row.alias("__row"), lo.cast("double").alias("__lo"), hi.cast("double").alias("__hi"), goal.cast("double").alias("__goal"))
    inputs = [s for s in model.stages[:-1] if not (isinstance(s, StringIndexerModel) and s.getOutputCol() == "__label")]
    asked = PipelineModel(inputs).transform(asked).select("__row", vector_to_array("__features").alias("__x"), "__lo", "__hi", "__goal")

    def run(batches):
        steps = remembered_steps(trees.value, at)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
            lo, hi, goal = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))  # null: NaN
            thresholds, values = steps(x)
            parts = [slice(i, i + 1024) for i in range(0, b.num_rows, 1024)]  # small enough for a processor's cache
            found = [nearest_step(thresholds, values[p], x[p, at], lo[p], hi[p], goal[p], classes) for p in parts]
            best, reached = (np.concatenate([f[k] for f in found] or [np.empty(0)]) for k in range(2))
            both = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (best, reached)]
            yield pa.RecordBatch.from_arrays([b.column(0), *both], names=["row", "best", "reached"])

    found = asked.mapInArrow(run, T.StructType([T.StructField("row", asked.schema["__row"].dataType), T.StructField("best", T.DoubleType()), T.StructField("reached", T.DoubleType())]))
    return found.select("row.*", "best", "reached")


#: How many sets of features a task remembers the steps of (8 bytes for each and threshold).
REMEMBERED = 20_000


def remembered_steps(trees: Trees, feature: int, most: int = REMEMBERED):
    """A function that gives Trees.steps of rows; rows that are equal but for the feature are worked out once, while they are remembered."""
    thresholds = kept = None
    known: dict[bytes, int] = {}

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal thresholds, kept
        keys = [v.tobytes() for v in np.delete(x, feature, axis=1)]
        fresh = {k: i for i, k in enumerate(keys) if k not in known}
        if known and len(known) + len(fresh) > most:
            known.clear()
            kept = None
            fresh = {k: i for i, k in enumerate(keys)}
        if fresh or kept is None:
            thresholds, more = trees.steps(x[list(fresh.values())], feature)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            kept = more if kept is None else np.concatenate([kept, more])
        return thresholds, kept[[known[k] for k in keys]]

    return of


def nearest_step(thresholds: np.ndarray, values: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray, margins: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(best, reached) of each row from what Trees.steps gives; margins of classes are turned into probabilities first."""
    values = 1 / (1 + np.exp(-2 * values)) if margins else values
    above = np.nextafter(thresholds, np.inf)
    left = np.maximum(np.concatenate([[-np.inf], above]), lo[:, None])  # the ends of each segment within the bounds
    right = np.minimum(np.concatenate([thresholds, [np.inf]]), hi[:, None])
    with np.errstate(invalid="ignore"):
        inside = left <= right
        at = np.clip(own[:, None], left, right)
        off = np.where(inside, np.abs(values - goal[:, None]), np.inf)
        ok = inside.any(axis=1) & ~np.isnan(goal) & ~np.isnan(own)
        far = np.where(off == off.min(axis=1, keepdims=True), np.abs(at - own[:, None]), np.inf)
    pick = np.argmin(np.where(np.isnan(far), np.inf, far), axis=1)
    rows = np.arange(len(own))
    return np.where(ok, at[rows, pick], np.nan), np.where(ok, values[rows, pick], np.nan)


#: What tells entities apart: the mean, spread and number of an entity's own rows before each time.
PAST = ["past_mean", "past_spread", "past_rows"]
FRAME = [*[f"y_scaled_lag_{k}" for k in panels.LAGS], *[f"y_scaled_roll_{k}" for k in panels.WINDOWS], "cal_year", "cal_month", "cal_day", "cal_weekday", "cal_day_of_year", *PAST]


def panel_frame(panel: DataFrame) -> DataFrame:
    """The supervised frame of a panel on scaled values, with PAST: an ordered encoding of the entity, which needs no category for each and no row's own future."""
    before = Window.partitionBy("entity").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    past = {"past_mean": F.avg("y_scaled"), "past_spread": F.stddev_pop("y_scaled"), "past_rows": F.count("y_scaled")}
    return panels.supervised(panels.scaled(panel).withColumns({c: v.over(before) for c, v in past.items()}), y="y_scaled")


def fit_panel(panel: DataFrame, **params) -> PipelineModel:
    """A forecaster of all entities together, of any number, on values scaled by each entity's mean. Refuses null entities and repeated keys.

    The model's attribute entities is the table of those it has seen; save_panel keeps it. The frame is written first, so that the trees'
    tasks take parts of files, whose size is bounded, and not the few and growing parts that a shuffle of the narrower panel leaves.
    """
    panels.guard(panel)
    model = boosted(roundtrip(panel_frame(panel).select("y_scaled", *FRAME)), "y_scaled", FRAME, **params)
    model.entities = roundtrip(panel.select("entity").distinct(), "parquet")
    return model


def recent(panel: DataFrame) -> DataFrame:
    """(entity, ts, y, scale, y_scaled, past_n, past_sum, past_squares): the tail of each entity that a forecast needs, with the scale and the sums of its whole history."""
    whole = Window.partitionBy("entity")
    sums = {"past_n": F.count("y_scaled"), "past_sum": F.sum("y_scaled"), "past_squares": F.sum(F.col("y_scaled") * F.col("y_scaled"))}
    own = panels.scaled(panel).withColumns({c: v.over(whole) for c, v in sums.items()})
    return panels.tail(own, max(panels.LAGS) + max(panels.WINDOWS) + 2).select("entity", "ts", "y", "scale", "y_scaled", *sums)


def save_panel(model: PipelineModel, panel: DataFrame) -> str:
    """Stores a panel's model with its entities and the scales and tails that forecasts start from, and returns the folder."""
    path = workspace(panel.sparkSession)
    model.write().save(f"{path}/model")
    model.entities.write.parquet(f"{path}/entities")
    recent(panel).write.parquet(f"{path}/recent")
    return path


def load_panel(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """The model and the tails, as forecast_panel takes them."""
    model = PipelineModel.load(f"{path}/model")
    model.entities = spark.read.parquet(f"{path}/entities")
    return model, spark.read.parquet(f"{path}/recent")


def forecast_panel(model: PipelineModel, panel: DataFrame, horizon: int, step_days: int = 1) -> DataFrame:
    """(entity, ts, step, yhat): recursive forecasts, each step fed by the ones before, all entities in one job.

    panel is a panel or what load_panel gives. Of each entity only the tail that the lags need is gathered. Raises if the model doesn't
    know an entity, or one has fewer rows than the lags and means need.
    """
    tails = panel if "y_scaled" in panel.columns else recent(panel)
    check_tails(tails, model.entities)
    return recursive(tails, {None: (0.0, trees_of(model))}, horizon, step_days)


def check_tails(tails: DataFrame, entities: DataFrame) -> None:
    needed, known = max(panels.LAGS + panels.WINDOWS), entities.select("entity", F.lit(True).alias("known"))
    wrong = tails.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).join(known, "entity", "left").where(F.col("known").isNull() | (F.col("n") < needed)).limit(5).collect()
    if wrong:
        raise ValueError("can't forecast " + ", ".join(f"{r.entity} ({'unknown to the model' if not r.known else f'{r.n} rows, {needed} needed'})" for r in wrong))


#: Entities that a group of recursive forecasts takes together, on the mean.
TOGETHER = 500


def recursive(tails: DataFrame, known: dict, horizon: int, step_days: int) -> DataFrame:
    """forecast_panel's rows. known: (base, trees) for each value of the column fold of tails, or for None where it has none; their number and size are bounded.

    Some hundred entities are forecast together, each step by one pass over the trees. Each needs as many rows as the lags and means do.
    """
    of_fold = "fold" in tails.columns
    trees = tails.sparkSession.sparkContext.broadcast(known)
    keys = ["fold", "entity"] if of_fold else ["entity"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["entity", "ts"])
        ends = np.flatnonzero((rows.entity != rows.entity.shift(-1)).to_numpy())
        last = rows.iloc[ends]
        base, own = trees.value[int(last.fold.iloc[0]) if of_fold else None]
        scale, n, total, squares = (last[c].to_numpy(float) for c in ("scale", "past_n", "past_sum", "past_squares"))
        y = rows.y_scaled.to_numpy(float)[ends[:, None] + np.arange(1 - max(panels.LAGS + panels.WINDOWS), 1)]
        day, out = pd.DatetimeIndex(pd.to_datetime(last.ts)), []
        for step in range(1, horizon + 1):
            day = day + pd.Timedelta(days=step_days)
            past = [total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0.0)), n]
            x = [*[y[:, -k] for k in panels.LAGS], *[y[:, -w:].mean(axis=1) for w in panels.WINDOWS], day.year, day.month, day.day, day.weekday + 1, day.dayofyear, *past]
            ahead = base + own.predict(np.stack([np.asarray(v, float) for v in x], axis=1))
            y = np.concatenate([y[:, 1:], ahead[:, None]], axis=1)
            n, total, squares = n + 1, total + ahead, squares + ahead**2
            out.append(pd.DataFrame({**{k: last[k].to_numpy() for k in keys}, "ts": day.date, "step": step, "yhat": ahead * scale}))
        return pd.concat(out)

    parts = -(-tails.select(*keys).distinct().count() // TOGETHER) or 1
    dealt = tails.withColumn("__part", F.pmod(F.xxhash64("entity"), F.lit(parts)))
    return dealt.groupBy(*keys[:-1], "__part").applyInPandas(run, ("fold int, " if of_fold else "") + "entity string, ts date, step int, yhat double")


def trend_design(days: np.ndarray, origin: float, span: float) -> np.ndarray:
    """Columns: 1 and the trend, with bends at the quarters of the training span."""
    t = (days - origin) / max(span, 1e-9)
    return np.stack([np.ones_like(t), t, *[np.maximum(0, t - q) for q in (0.25, 0.5, 0.75)]], axis=1)


def season_design(days: np.ndarray, span: float, daily: bool, regressors: np.ndarray | None) -> np.ndarray:
    """Columns: yearly, weekly and daily Fourier terms, as far as the training span holds them, and regressors."""
    periods = [(365.25, 365, 3), (7.0, 14, 3), *([(1.0, 2, 4)] if daily else [])]
    cols = [f(2 * np.pi * k * days / period) for period, least, terms in periods if span >= least for k in range(1, terms + 1) for f in (np.sin, np.cos)]
    cols += [] if regressors is None else list(regressors.T)
    return np.stack(cols, axis=1) if cols else np.zeros((len(days), 0))


def seasonal_design(days: np.ndarray, origin: float, span: float, regressors: np.ndarray | None) -> np.ndarray:
    return np.hstack([trend_design(days, origin, span), season_design(days, span, False, regressors)])


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x.T @ x + np.diag(penalty) + 1e-9 * np.eye(x.shape[1]), x.T @ y, rcond=None)[0]


def fit_and_forecast(t: np.ndarray, y: np.ndarray, season: np.ndarray, t_ahead: np.ndarray, season_ahead: np.ndarray, multiplicative: bool, ridge: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and standard deviations at t and t_ahead, of y = trend + season or of y = trend * (1 + season), where each is fitted in turn with the other held."""
    both_t, both_s = np.concatenate([t, t_ahead]), np.concatenate([season, season_ahead])
    if not multiplicative:
        fit = trends.Fit(t, y, season, ridge, prior)
        return fit.trend(both_t) + fit.waves(both_s), fit.deviation(both_t, both_s, t[-1])
    b, none, weights = np.zeros(season.shape[1]), np.zeros((len(t), 0)), None
    for _ in range(30):
        fit = trends.Fit(t, y, none, ridge, prior, 1 + season @ b, weights)
        level, weights = fit.trend(t), fit.weights
        new = _ridge(season * level[:, None], y - level, np.full(season.shape[1], ridge * max(np.mean(level**2), 1e-9)))
        done, b = np.allclose(new, b, atol=1e-6), new
        if done:
            break
    return fit.trend(both_t) * (1 + both_s @ b), fit.deviation(both_t, np.zeros((len(both_t), 0)), t[-1]) * np.abs(1 + both_s @ b)


SEASONAL = "entity string, ts {kind}, yhat double, lower double, upper double"


def seasonal_forecast(
    panel: DataFrame, horizon: int, multiplicative: bool = False, width: float = 0.95, ridge: float = 1.0, step_days: float = 1, history: bool = False, regressors: Sequence[str] = (), ahead: DataFrame | None = None, strict: bool = True,
    prior: float = trends.PRIOR, rules: Mapping[str, holidays.Rule] | None = None, around: tuple[int, int] = (0, 0),
) -> DataFrame:
    """(entity, ts, yhat, lower, upper): trend with few bends, seasons, regressors and holidays for each entity, with bounds that widen with the distance.

    Of 25 candidate bends a sparse prior keeps those that the series needs: the larger `prior`, the more. Times are dates, or timestamps, which
    get a daily season too. ahead (entity, ts, regressors) gives the times to forecast; without it they are `horizon` steps of
    step_days. rules name holidays (see holidays.COUNTRIES), each an effect of its own on its day and the days `around` it, before and after.
    Rows with a null go. Raises if regressors are null or not given ahead, and (strict) if an entity has fewer than two rows;
    otherwise such entities have no forecast.
    """
    if rules:
        kind = panel.schema["ts"].dataType.simpleString()
        if ahead is None and horizon:
            if regressors:
                raise ValueError("regressors need their values ahead")
            steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k")
            ahead = panel.dropna().groupBy("entity").agg(F.max("ts").alias("ts")).select("entity", "ts", steps)
            ahead = ahead.select("entity", (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("k") * F.lit(round(step_days * 86_400)))).cast(kind).alias("ts"))
        panel = holidays.flagged(panel, rules, "ts", *around)
        ahead = holidays.flagged(ahead, rules, "ts", *around) if ahead is not None else None
        regressors = [*regressors, *map(holidays.column, rules)]
    names = list(regressors)
    if names and ahead is None and horizon:
        raise ValueError("regressors need their values ahead")
    kind = panel.schema["ts"].dataType.simpleString()
    own = panel.select("entity", "ts", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names], F.lit(False).alias("__ahead")).dropna()
    if strict:
        short = panel.select("entity").distinct().join(own.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", "left").where(F.coalesce("n", F.lit(0)) < 2).limit(5).collect()
        if short:
            raise ValueError("fewer than two rows: " + ", ".join(str(r.entity) for r in short))
    if ahead is not None:
        missing = {"entity", "ts", *names} - set(ahead.columns)
        if missing:
            raise ValueError(f"no such columns ahead: {sorted(missing)}")
        if names and ahead.where(" OR ".join(f"`{c}` IS NULL" for c in names)).limit(1).count():
            raise ValueError("regressors ahead have nulls")
        own = own.unionByName(ahead.select("entity", F.col("ts").cast(kind).alias("ts"), F.lit(None).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names], F.lit(True).alias("__ahead")))
    given = ahead is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__ahead", "ts"])
        days = pd.to_datetime(rows.ts).to_numpy("datetime64[ns]").astype(np.int64) / 86_400e9
        past = ~rows["__ahead"].to_numpy(bool)
        if past.sum() < 2:
            return pd.DataFrame({"entity": [], "ts": [], "yhat": [], "lower": [], "upper": []})
        known, y = days[past], rows.y.to_numpy(float)[past]
        later = days[~past] if given else known[-1] + step_days * np.arange(1, horizon + 1)
        origin, span, daily = known[0], known[-1] - known[0], bool(np.any(known % 1))
        extra = rows[names].to_numpy(float) if names else None
        mean, sd = (extra[past].mean(axis=0), extra[past].std(axis=0)) if names else (0.0, 1.0)
        sd = np.where(sd > 1e-9, sd, 1.0)  # what never changed, so far, has no effect
        part = lambda mask: (extra[mask] - mean) / sd if names else None
        t, season = (known - origin) / max(span, 1e-9), season_design(known, span, daily, part(past))
        f, spread = fit_and_forecast(t, y, season, (later - origin) / max(span, 1e-9), season_design(later, span, daily, part(~past) if given else None) if len(later) else season[:0], multiplicative, ridge, prior)
        n = len(known)
        lo, hi = np.quantile(y - f[:n], [(1 - width) / 2, (1 + width) / 2])
        scale = spread / max(float(np.std(y - f[:n])), 1e-12)
        out = slice(0 if history else n, None)
        times = pd.to_datetime(np.round(np.concatenate([known, later])[out] * 86_400e3).astype("int64"), unit="ms")
        f, scale = f[out], scale[out]
        return pd.DataFrame({"entity": rows.entity.iloc[0], "ts": times.date if kind == "date" else times, "yhat": f, "lower": f + np.minimum(lo, 0) * scale, "upper": f + np.maximum(hi, 0) * scale})

    return own.groupBy("entity").applyInPandas(run, SEASONAL.format(kind=kind))


def rolling_origin(panel: DataFrame, horizon: int, period: int, initial: int, **params) -> DataFrame:
    """(cutoff, n, mae, rmse, mape) of seasonal forecasts made at cutoffs `period` days apart."""
    from tessera.operators import metrics

    ends = panel.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    cuts = pd.date_range(pd.Timestamp(ends.lo) + pd.Timedelta(days=initial), pd.Timestamp(ends.hi) - pd.Timedelta(days=horizon), freq=f"{period}D")
    if not len(cuts):
        raise ValueError("the series is too short")
    table = panel.sparkSession.createDataFrame([(c.date(),) for c in cuts], "cutoff date")
    # An entity and cutoff are one group: all fits are one job.
    past = panel.join(F.broadcast(table), F.col("ts") <= F.col("cutoff")).select(F.concat_ws("|", "entity", "cutoff").alias("entity"), "ts", "y")
    f = seasonal_forecast(past, horizon, **({"strict": False} | params)).withColumns({"cutoff": F.substring_index("entity", "|", -1), "entity": F.expr("regexp_replace(entity, '[|][^|]*$', '')")})
    return metrics.forecast(f.join(panel, ["entity", "ts"]), ["cutoff"]).select("cutoff", "n", "mae", "rmse", "mape")
