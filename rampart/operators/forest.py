"""Distributed isolation forest with percentile explanations.

Each tree grows from its own sample of ``max_samples`` rows in one task; scoring is vectorised over
Arrow batches with the whole model (bounded by trees x sample size) broadcast.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rampart.operators.features import MODEL_COLUMNS
from rampart.operators.ordering import exact_quantile, middle_values, order_statistics
from rampart.session import checkpoint

# Points kept of a feature's distribution; percentiles of ``explain`` are read off this grid, all other statistics are exact.
GRID = 20_000
_NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def _average_path(n: int) -> float:
    """Expected path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(node, feature, threshold, left, right, path)`` of one tree; a leaf has feature -1."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []
    stack = [(np.arange(len(points)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        here = len(nodes)
        nodes.append([here, -1, 0.0, -1, -1, depth + _average_path(len(rows))])
        if parent is not None:
            nodes[parent][side] = here
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= threshold
        nodes[here][1:3] = [feature, threshold]
        stack.append((rows[goes_left], depth + 1, here, 3))
        stack.append((rows[~goes_left], depth + 1, here, 4))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    """``fit`` on a feature frame, ``score`` any frame with the same columns.

    ``max_samples`` rows make a tree (the published algorithm's sub-sample, 256 there); ``grid`` points of each
    feature's distribution are kept for the percentiles of ``explain``.
    """

    contamination: float | str = "auto"
    n_estimators: int = 100
    seed: int = 42
    feature_names: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    distributions: dict[str, np.ndarray] = field(default_factory=dict)
    trees: pd.DataFrame | None = None
    sample_size: int = 0
    threshold: float = 0.5
    trained_at: str | None = None
    n_samples: int = 0
    max_samples: int = 256
    grid: int = GRID

    # -- training ---------------------------------------------------------------------

    def fit(self, features: DataFrame, columns: list[str] | None = None, id_col: str = "event_uid") -> IsolationForest:
        self.feature_names = columns or [c for c in MODEL_COLUMNS if c in features.columns]
        if not self.feature_names:
            raise ValueError("the frame has none of the feature columns")
        base = checkpoint(features.select(F.col(id_col).cast("string").alias("_id"), *[_finite(F.col(f"`{c}`")).alias(c) for c in self.feature_names]))
        self.n_samples = base.count()
        if not self.n_samples:
            raise ValueError("no rows to train on")
        self.medians = feature_medians(base, self.feature_names)
        filled = base.select("_id", *[F.coalesce(c, F.lit(self.medians[c])).alias(c) for c in self.feature_names])
        self.distributions = {f: np.zeros(1) for f in self.feature_names} | distributions(filled, self.feature_names, self.grid)
        self.sample_size = min(self.max_samples, self.n_samples)
        self.trees = self._trees(filled)
        self.trained_at = dt.datetime.now(dt.UTC).isoformat()
        if self.contamination != "auto":
            scores = checkpoint(self._scored(filled).select("anomaly_score"))  # read by several passes
            self.threshold = exact_quantile(scores, "anomaly_score", 1.0 - float(self.contamination))
        return self

    def _trees(self, filled: DataFrame) -> pd.DataFrame:
        """Draw each tree's sample by the smallest row hashes, then grow all trees in parallel.

        A row offers itself to a tree only when its hash is below a cut that keeps a few times the
        sample size, so candidates stay few however many rows there are.
        """
        names, seed, size = self.feature_names, self.seed, self.sample_size
        cut = min(1.0, 4.0 * size / self.n_samples + 64.0 / self.n_samples)
        place = lambda t: (F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed), t), 11).cast("double") / float(2**53))
        picks = F.transform(F.sequence(F.lit(0), F.lit(self.n_estimators - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("h")))
        offered = filled.withColumn("_pick", F.explode(F.filter(picks, lambda p: p["h"] <= cut)))
        rank = Window.partitionBy("tree").orderBy("h", "_id")
        chosen = offered.select(F.col("_pick.tree").alias("tree"), F.col("_pick.h").alias("h"), "_id", *names)
        chosen = chosen.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= size)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "_id"])
            tree = int(pdf["tree"].iloc[0])
            nodes = _grow(pdf[names].to_numpy(dtype=np.float64), np.random.default_rng([seed, tree]))
            return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

        grown = chosen.groupBy("tree").applyInPandas(grow, _NODE_SCHEMA)
        return grown.toPandas().sort_values(["tree", "node"], ignore_index=True)  # <= trees * 2 * 256 nodes

    # -- scoring ------------------------------------------------------------------------

    def _require(self) -> pd.DataFrame:
        if self.trees is None:
            raise RuntimeError("fit() must be called before this")
        return self.trees

    def _prepared(self, df: DataFrame) -> list[Column]:
        known = set(df.columns)
        fill = lambda c: F.coalesce(_finite(F.col(f"`{c}`")), F.lit(self.medians[c])) if c in known else F.lit(self.medians[c])
        return [fill(c).alias(f"_f{i}") for i, c in enumerate(self.feature_names)]

    def _scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``anomaly_score`` (higher is more anomalous)."""
        trees = self._require()
        packed = [tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")) for _, part in trees.groupby("tree", sort=True)]
        model = df.sparkSession.sparkContext.broadcast((packed, _average_path(self.sample_size)))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            trees, scale = model.value
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            total = np.zeros(len(x))
            for feature, threshold, left, right, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                live = np.flatnonzero(feature[at] >= 0)
                while len(live):
                    node = at[live]
                    at[live] = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
                    live = live[feature[at[live]] >= 0]
                total += path[at]
            return pd.Series(2.0 ** (-(total / len(trees)) / scale) if scale > 0 else np.full(len(x), 0.5))

        return df.withColumn("anomaly_score", score(*[c for c in self._prepared(df)]))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` and ``is_anomaly``."""
        return self._scored(df).withColumn("is_anomaly", F.col("anomaly_score") > self.threshold)

    def explain(self, df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
        """Add ``explanation_json``: the three features furthest in a tail of the training data, for
        flagged rows; empty text for others."""
        names = self.feature_names
        context = {f: (float(np.median(d)), *(float(v) for v in np.percentile(d, [5, 95]))) for f, d in self.distributions.items()}
        model = df.sparkSession.sparkContext.broadcast((self.distributions, context))

        @F.pandas_udf("string")
        def text(flagged: pd.Series, *columns: pd.Series) -> pd.Series:
            dist, typical = model.value
            out = np.full(len(flagged), "", dtype=object)
            rows = np.flatnonzero(flagged.fillna(False).to_numpy(dtype=bool))
            if not len(rows):
                return pd.Series(out)
            x = np.column_stack([c.to_numpy(dtype=np.float64)[rows] for c in columns])
            pct = np.column_stack([
                (np.searchsorted(dist[f], x[:, i], "left") + np.searchsorted(dist[f], x[:, i], "right")) * 50.0 / len(dist[f])
                for i, f in enumerate(names)
            ])
            extreme = np.maximum(pct, 100.0 - pct)
            top = np.argsort(-extreme, axis=1, kind="stable")[:, :3]
            for r, row in enumerate(rows):
                out[row] = json.dumps([_reason(names[i], x[r, i], pct[r, i], extreme[r, i], typical[names[i]]) for i in top[r]])
            return pd.Series(out)

        return df.withColumn("explanation_json", text(F.col(flag), *self._prepared(df)))

    # -- persistence -----------------------------------------------------------------------

    @property
    def metadata(self) -> dict:
        return {"trained_at": self.trained_at, "n_samples": self.n_samples, "feature_names": list(self.feature_names),
                "n_features": len(self.feature_names), "contamination": self.contamination, "n_estimators": self.n_estimators, "random_state": self.seed}

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees, medians, distributions and metadata as Parquet under ``path``."""
        self._require()
        spark.createDataFrame(self.trees, _NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        rows = [(f, i, self.medians[f], [float(v) for v in self.distributions[f]]) for i, f in enumerate(self.feature_names)]
        spark.createDataFrame(rows, "feature string, position int, median double, distribution array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        meta = json.dumps({**self.metadata, "threshold": self.threshold, "sample_size": self.sample_size})
        spark.createDataFrame([(meta,)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
        rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        model = cls(contamination=meta["contamination"], n_estimators=meta["n_estimators"], seed=meta["random_state"])
        model.feature_names = [r["feature"] for r in rows]
        model.medians = {r["feature"]: r["median"] for r in rows}
        model.distributions = {r["feature"]: np.array(r["distribution"]) for r in rows}
        model.trees = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"], ignore_index=True)
        model.threshold, model.sample_size = meta["threshold"], meta["sample_size"]
        model.trained_at, model.n_samples = meta["trained_at"], meta["n_samples"]
        return model


def _reason(feature: str, value: float, pct: float, extreme: float, typical: tuple[float, float, float]) -> dict:
    median, p5, p95 = typical
    side = "high" if pct >= 50.0 else "low"
    return {
        "feature": feature, "value": float(value), "percentile": round(float(pct), 2), "extremeness": round(float(extreme), 2),
        "direction": side, "training_median": round(median, 4), "training_p5": round(p5, 4), "training_p95": round(p95, 4),
        "note": f"{feature} = {value:g} is at percentile {pct:.1f} of training (median {median:g}, p5-p95 {p5:g} to {p95:g}), unusually {side}",
    }


def _finite(c: Column) -> Column:
    """The value as a double; NaN and infinities are missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Missing or non-finite values become the training median; missing columns too."""
    known = set(df.columns)
    return df.withColumns({c: F.coalesce(_finite(F.col(f"`{c}`")), F.lit(m)) if c in known else F.lit(m) for c, m in medians.items()})


def distributions(df: DataFrame, columns: list[str], grid: int = GRID) -> dict[str, np.ndarray]:
    """Sorted values per column, thinned to at most ``grid`` order statistics (bounded driver read)."""
    rows = order_statistics(df, columns, grid).toPandas().sort_values(["feature", "k"])
    return {f: part["value"].to_numpy() for f, part in rows.groupby("feature")}


def feature_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the present values; 0 for a column without any."""
    found = middle_values(df, columns)
    out = {}
    for c in columns:
        n, low, high = found.get(c, (0, 0.0, 0.0))
        out[c] = float(np.median([low, high])) if n < GRID else low + (high - low) * 0.5
    return out
