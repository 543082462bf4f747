"""Feature pipelines: type-driven columns, imputation, indexing, encoding, hashing, scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.fixed_values import (
    ADDRESS_COLUMNS,
    COMMUNITY_COLUMN,
    HASH_BUCKETS,
    LABEL_COLUMNS,
)
from flowmark.functions.durable import durable
from flowmark.functions.scalars import number_value, observed, text_value, vector_width
from flowmark.operators.profile import Lookup, category_index, index_column, lookup

PREFIX = "__value_"
#: Distinct values up to which a column is indexed by ``StringIndexer`` (labels on the driver).
INDEXER_VALUES = 10_000
#: Widest vector that is centred row by row, which makes it dense. Wider ones stay sparse and carry
#: their mean as an offset.
DENSE_WIDTH = 512

METADATA_SCHEMA = (
    "numeric_features array<string>, categorical_features array<string>,"
    " skipped_columns array<string>, empty_columns array<string>,"
    " hashed_features array<string>, hash_buckets int, feature_policy string,"
    " feature_dimension int, scaling string, fit_scope string"
)


@dataclass(frozen=True)
class FeaturePolicy:
    """Which columns take part and how text is encoded."""

    name: str
    dropped: tuple[str, ...] = LABEL_COLUMNS
    hashed: tuple[str, ...] = ()
    corrected: bool = True  # blank text is marked missing and indices are one-hot encoded
    buckets: int = HASH_BUCKETS


def policy(
    name: str,
    *,
    labels: Sequence[str] = LABEL_COLUMNS,
    community: Sequence[str] = (COMMUNITY_COLUMN,),
    addresses: Sequence[str] = ADDRESS_COLUMNS,
) -> FeaturePolicy:
    """Policy by name, for tables whose label and identifier columns may be called differently."""
    if name == "legacy-ordinal":
        return FeaturePolicy(name, tuple(labels), corrected=False)
    if name == "corrected":
        return FeaturePolicy(name, (*labels, *community, *addresses))
    if name == "hashed-ips":
        return FeaturePolicy(name, (*labels, *community), hashed=tuple(addresses))
    raise ValueError(f"unknown feature policy {name!r}")


@dataclass(frozen=True)
class FeatureColumns:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]  # hashed ones included
    hashed: tuple[str, ...]
    skipped: tuple[str, ...]

    @property
    def indexed(self) -> tuple[str, ...]:
        return tuple(c for c in self.categorical if c not in self.hashed)


def feature_columns(schema: T.StructType, how: FeaturePolicy) -> FeatureColumns:
    """Sort the columns of a schema into numbers, text and types no feature is made of."""
    numeric, categorical, skipped = [], [], []
    for item in schema.fields:
        if item.name in how.dropped:
            continue
        if isinstance(item.dataType, T.StringType):
            categorical.append(item.name)
        elif number_value(F.lit(None), item.dataType) is not None:
            numeric.append(item.name)
        else:
            skipped.append(item.name)
    hashed = tuple(c for c in categorical if c in how.hashed)
    return FeatureColumns(tuple(numeric), tuple(categorical), hashed, tuple(skipped))


def feature_frame(
    df: DataFrame, how: FeaturePolicy, keep: Sequence[str] = ("label", "label_tactic")
) -> DataFrame:
    """The kept columns and one ``__value_*`` column per feature, in a single projection."""
    columns = feature_columns(df.schema, how)
    numbers = [
        number_value(F.col(c), df.schema[c].dataType).alias(PREFIX + c) for c in columns.numeric
    ]
    texts = [text_value(F.col(c), how.corrected).alias(PREFIX + c) for c in columns.categorical]
    return df.select(*[c for c in keep if c in df.columns], *numbers, *texts)


@dataclass
class FeatureModel:
    """Fitted feature pipeline; ``transform`` gives the kept columns and ``features``."""

    how: FeaturePolicy
    columns: FeatureColumns
    means: dict[str, float]
    empty: tuple[str, ...]  # numeric columns without any value: left out
    wide: dict[str, Lookup]  # indices of columns with many values
    pipeline: PipelineModel
    scaled: bool
    dimension: int
    fit_scope: str
    mappings: dict[str, list[str]] = field(default_factory=dict)
    #: what has to be taken off wide scaled features to centre them (see :data:`DENSE_WIDTH`)
    offset: DenseVector | None = None

    def values(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Feature columns with means filled in and wide columns indexed."""
        return _fill(feature_frame(df, self.how, keep), self.means, self.wide)

    def transform(
        self, df: DataFrame, keep: Sequence[str] = ("label", "label_tactic")
    ) -> DataFrame:
        kept = [c for c in keep if c in df.columns]
        return self.pipeline.transform(self.values(df, keep)).select(*kept, "features")

    def mapping_table(self, spark: SparkSession) -> DataFrame:
        """Index of every known value per column."""
        rows = [
            (column, value, index)
            for column, values in self.mappings.items()
            for index, value in enumerate(values)
        ]
        table = spark.createDataFrame(rows, "column string, value string, index bigint")
        for column, index in self.wide.items():
            table = table.unionByName(
                index.table.select(F.lit(column).alias("column"), "value", "index")
            )
        return table

    def metadata_row(self) -> tuple:
        """How the features were made, in the order of :data:`METADATA_SCHEMA`."""
        return (
            [c for c in self.columns.numeric if c not in self.empty],
            list(self.columns.categorical),
            list(self.columns.skipped),
            list(self.empty),
            list(self.columns.hashed),
            self.how.buckets if self.columns.hashed else None,
            self.how.name,
            self.dimension,
            "none"
            if not self.scaled
            else f"z-score (withMean={self.offset is None}, withStd=True)"
            + (" and offset" if self.offset is not None else ""),
            self.fit_scope,
        )

    def metadata(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.metadata_row()], METADATA_SCHEMA)


def _fill(values: DataFrame, means: dict[str, float], wide: dict[str, Lookup]) -> DataFrame:
    filled = values.select(
        *[
            F.coalesce(observed(F.col(c)), F.lit(means[c])).alias(c) if c in means else F.col(c)
            for c in values.columns
        ]
    )
    for column, index in wide.items():
        name = PREFIX + column
        filled = index_column(filled, name, index, f"{name}__indexed").drop(name)
        nominal = {"ml_attr": {"type": "nominal", "num_vals": index.known + 1}}
        filled = filled.withMetadata(f"{name}__indexed", nominal)
    return filled


def fit_features(
    fit: DataFrame,
    how: FeaturePolicy,
    scale: bool = True,
    fit_scope: str = "train-only",
    *,
    indexer_values: int = INDEXER_VALUES,
    dense_width: int = DENSE_WIDTH,
) -> FeatureModel:
    """Fit imputation, indexing, encoding and scaling on ``fit``.

    Features wider than ``dense_width`` are scaled but not centred, so that vectors stay sparse; the
    model keeps the offset. Linear models with an intercept, covariances and scatter matrices do
    not depend on it.

    Means, value counts and distinct estimates come from one aggregate. Text columns with few
    values go through one ``StringIndexer``; the others get an index table made by a
    distributed sort, since their values must not be pulled to the driver.
    """
    columns = feature_columns(fit.schema, how)
    values = feature_frame(fit, how, keep=())
    numeric = [PREFIX + c for c in columns.numeric]
    indexed = [PREFIX + c for c in columns.indexed]

    means, empty, wide_names = {}, [], []
    if numeric or indexed:
        stats = values.agg(
            *[F.avg(observed(F.col(c))).alias(c) for c in numeric],
            *[F.approx_count_distinct(c).alias(c) for c in indexed],
        ).first()
        means = {c: stats[c] for c in numeric if stats[c] is not None}
        empty = [c for c in numeric if stats[c] is None]
        # the estimate may be off by some per cent, so the limit is taken with a margin
        wide_names = [c for c in indexed if stats[c] > 0.8 * indexer_values]

    wide = {}
    if wide_names:
        table = durable(category_index(values, wide_names))
        for name in wide_names:
            wide[name.removeprefix(PREFIX)] = lookup(table, name)
    fit_values = _fill(values.drop(*empty), means, wide)

    stages, offset = [], None
    narrow = [c for c in indexed if c not in wide_names]
    if narrow:
        stages.append(
            StringIndexer(
                inputCols=narrow,
                outputCols=[f"{c}__indexed" for c in narrow],
                handleInvalid="keep",
                stringOrderType="frequencyDesc",
            )
        )
    encoded = [f"{c}__indexed" for c in indexed]
    if how.corrected and indexed:
        encoded = [f"{c}__onehot" for c in indexed]
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}__indexed" for c in indexed],
                outputCols=encoded,
                handleInvalid="keep",
            )
        )
    if columns.hashed:
        names = [PREFIX + c for c in columns.hashed]
        stages.append(
            FeatureHasher(
                inputCols=names,
                outputCol="__hashed",
                numFeatures=how.buckets,
                categoricalCols=names,
            )
        )
        encoded = [*encoded, "__hashed"]
    inputs = [c for c in numeric if c not in empty] + encoded
    if not inputs:
        raise ValueError("no feature columns left")
    stages.append(
        VectorAssembler(
            inputCols=inputs,
            outputCol="unscaled_features" if scale else "features",
            handleInvalid="keep",
        )
    )

    if scale:
        # the width is known from the indices, before vectors are made dense
        assembled = Pipeline(stages=stages).fit(fit_values)
        width = vector_width(assembled.transform(fit_values.limit(1)), "unscaled_features")
        scaler = StandardScaler(
            inputCol="unscaled_features",
            outputCol="features",
            withMean=width <= dense_width,
            withStd=True,
        ).fit(assembled.transform(fit_values))
        if width > dense_width:
            mean, std = scaler.mean.toArray(), scaler.std.toArray()
            offset = DenseVector(np.divide(mean, std, out=np.zeros_like(mean), where=std > 0))
        pipeline = PipelineModel([*assembled.stages, scaler])
    else:
        pipeline = Pipeline(stages=stages).fit(fit_values)
        width = vector_width(pipeline.transform(fit_values.limit(1)), "features")

    mappings = {}
    if narrow:
        fitted = pipeline.stages[0]
        mappings = {
            c.removeprefix(PREFIX): list(labels) for c, labels in zip(narrow, fitted.labelsArray)
        }
    return FeatureModel(
        how,
        columns,
        means,
        tuple(c.removeprefix(PREFIX) for c in empty),
        wide,
        pipeline,
        scale,
        width,
        fit_scope,
        mappings,
        offset,
    )


def fit_scope_frame(train: DataFrame, test: DataFrame, fit_on_all: bool) -> DataFrame:
    """The rows a fit may see: the train side, or both."""
    return train.unionByName(test) if fit_on_all else train
