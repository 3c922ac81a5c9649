"""Feature preparation as ``pyspark.ml`` stages fitted on training rows only.

Spark ML's own Imputer (approximate median), StandardScaler (sample std) and OneHotEncoder (drops the
last level) differ from the reference's definitions, so these stages implement the exact ones:

- ``InteractionFeature``: out = a * b (inputs unchanged);
- ``ExactMedianImputer``: per-column exact median of the training rows (distributed exact quantile),
  applied with ``coalesce``; NaN counts as missing;
- ``PopulationScaler``: (x - mean) / population std of the training rows; std 0 divides by 1;
- ``DropFirstOneHot``: levels sorted from the training rows, first level dropped, unknown -> all 0.

Dummy columns get reserved names (``__dummy_<stage id>_<n>``) and carry the display name ``Col_level`` in their metadata,
so the assembler finds them by metadata alone: a raw column that merely looks like a dummy is never a feature,
and levels may hold any character.

Fitted statistics are a few numbers per column; they are stored as params (saved with the pipeline) and
applied as column expressions (no join, no UDF).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabreg.operators.quantile import exact_quantiles

MAX_LEVELS = 500  # under the planner's limit for map-side group limits
DUMMY = "tabreg_dummy"


class InteractionFeature(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """outputCol = product of the input columns; a no-op when outputCol already exists (no double add)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        if out in df.columns:
            return df
        expr = None
        for c in self.getInputCols():
            expr = F.col(c) if expr is None else expr * F.col(c)
        return df.withColumn(out, expr)


class _HasStats(Params):
    statistics = Param(Params._dummy(), "statistics", "fitted per-column statistics", TypeConverters.toListFloat)
    statistics2 = Param(Params._dummy(), "statistics2", "second fitted per-column statistics",
                        TypeConverters.toListFloat)


def _missing_to_null(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        return F.when(~F.isnan(c), F.col(c))
    return F.col(c)


class ExactMedianImputerModel(Model, HasInputCols, _HasStats, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        meds = self.getOrDefault(self.statistics)
        return df.withColumns({c: F.coalesce(_missing_to_null(df, c).cast("double"), F.lit(m))
                               for c, m in zip(self.getInputCols(), meds)})

    def medians(self) -> dict[str, float]:
        return dict(zip(self.getInputCols(), self.getOrDefault(self.statistics)))


class ExactMedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Median of each column over the fitting rows, exact (linear interpolation between middle values)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactMedianImputerModel:
        cols = self.getInputCols()
        q = {r["column"]: r["value"] for r in exact_quantiles(df, cols, [0.5]).collect()}  # one row per column
        empty = [c for c in cols if q.get(c) is None]
        if empty:
            warnings.warn(f"no values to impute from, using 0: {', '.join(empty)}", stacklevel=2)
        meds = [float(q[c]) if q.get(c) is not None else 0.0 for c in cols]
        return ExactMedianImputerModel()._set(inputCols=cols, statistics=meds)


class PopulationScalerModel(Model, HasInputCols, _HasStats, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        means, stds = self.getOrDefault(self.statistics), self.getOrDefault(self.statistics2)
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, m, s in zip(self.getInputCols(), means, stds)})


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Standardise with the population std of the fitting rows (one aggregation); std 0 -> divide by 1."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return PopulationScalerModel()._set(inputCols=cols, statistics=means, statistics2=stds)


class DropFirstOneHotModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    levels = Param(Params._dummy(), "levels", "kept levels per column (first sorted level dropped)",
                   TypeConverters.toListString)
    owners = Param(Params._dummy(), "owners", "input column of each kept level", TypeConverters.toListString)

    def outputNames(self) -> list[str]:
        """Display names, in output order."""
        return [f"{o}_{lv}" for o, lv in zip(self.getOrDefault(self.owners), self.getOrDefault(self.levels))]

    def outputColumns(self) -> list[str]:
        """Reserved names that carry the stage's id, so two encoders never meet."""
        return [f"__dummy_{self.uid}_{i}" for i in range(len(self.getOrDefault(self.levels)))]

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [F.when(F.col(f"`{o}`").cast("string") == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
                .alias(name, metadata={DUMMY: shown})
                for o, lv, name, shown in zip(self.getOrDefault(self.owners), self.getOrDefault(self.levels),
                                              self.outputColumns(), self.outputNames())]
        return df.select("*", *cols)


class DropFirstOneHot(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Levels of each column from the fitting rows (distributed distinct), sorted, first one dropped.

    A column with more than ``maxLevels`` levels is an error that names it (the encoder would add that many
    columns); the caller sets the bound."""

    maxLevels = Param(Params._dummy(), "maxLevels", "most levels of one column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, maxLevels=MAX_LEVELS):
        super().__init__()
        self._setDefault(maxLevels=MAX_LEVELS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> DropFirstOneHotModel:
        cols, most = self.getInputCols(), self.getOrDefault(self.maxLevels)
        levels = sorted_levels(df, cols, most)
        kept = [(c, v) for c in cols for v in levels[c][1:]]
        return DropFirstOneHotModel()._set(inputCols=cols, owners=[c for c, _ in kept], levels=[v for _, v in kept])


def sorted_levels(df: DataFrame, cols: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Levels of each column (as numbers if all are), ``most`` at most; more are an error that names the column."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("kv"))
    distinct = stacked.where(F.col("kv.v").isNotNull()).groupBy("kv.c", "kv.v").count()
    # at most ``most`` + 1 levels of each column reach the driver (map-side window group limit)
    first = Window.partitionBy("c").orderBy("v")
    rows = distinct.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most + 1).collect()
    out = {}
    for c in cols:
        vals = [r["v"] for r in rows if r["c"] == c]
        if len(vals) > most:
            raise ValueError(f"column {c} has more than {most} levels")
        out[c] = sorted(vals, key=float if all(map(_is_number, vals)) else None)
    return out


def _is_number(v: str) -> bool:
    try:
        float(v)
        return True
    except ValueError:
        return False


def preparation_pipeline(numeric: Sequence[str], categorical: Sequence[str], scale: bool,
                         interaction: tuple[str, str, str] | None = None,
                         output_col: str = "features") -> Pipeline:
    """Interaction (optional) -> exact median impute -> [population scale] -> drop-first one-hot -> assemble.

    Feature order: numeric columns (incl. the interaction), then ``Col_level`` dummies.
    """
    stages = []
    nums = list(numeric)
    if interaction:
        name, a, b = interaction
        stages.append(InteractionFeature(inputCols=[a, b], outputCol=name))
        nums.append(name)
    stages.append(ExactMedianImputer(inputCols=nums))
    if scale:
        stages.append(PopulationScaler(inputCols=nums))
    if categorical:
        stages.append(DropFirstOneHot(inputCols=list(categorical)))
    stages.append(_Assemble(numeric=nums, categorical=list(categorical), outputCol=output_col))
    return Pipeline(stages=stages)


class _Assemble(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Assembles numeric + dummy columns; the dummy names are only known after the encoder is fitted."""

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, numeric=None, categorical=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> VectorAssembler:
        cats = self.getOrDefault(self.categorical)
        dummies = [f.name for f in df.schema.fields if cats and DUMMY in (f.metadata or {})]
        names = list(self.getOrDefault(self.numeric)) + dummies
        return VectorAssembler(inputCols=names, outputCol=self.getOutputCol(), handleInvalid="error")


def feature_columns(model) -> list[str]:
    """Physical columns of the assembled features, in vector order."""
    for st in reversed(model.stages):
        if isinstance(st, VectorAssembler):
            return list(st.getInputCols())
    raise ValueError("pipeline has no assembled feature vector")


def feature_names(model) -> list[str]:
    """Display names of the assembled features (``Col_level`` for dummies), in vector order."""
    shown: dict[str, str] = {}
    for st in model.stages:
        if isinstance(st, DropFirstOneHotModel):
            shown.update(zip(st.outputColumns(), st.outputNames()))
    return [shown.get(c, c) for c in feature_columns(model)]


def named_features(model, df: DataFrame) -> DataFrame:
    """``df`` through the preparation stages, feature columns under their display names, others kept."""
    out = df
    for st in model.stages:
        if isinstance(st, VectorAssembler):
            break
        out = st.transform(out)
    return out.withColumnsRenamed(dict(zip(feature_columns(model), feature_names(model))))


def prepare_input(df: DataFrame, interaction: tuple[str, str, str]) -> DataFrame:
    """Add the engineered column only when it is not there yet (idempotent)."""
    name, a, b = interaction
    return InteractionFeature(inputCols=[a, b], outputCol=name).transform(df)
