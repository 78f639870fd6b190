"""Feature columns -> one vector, as a stored pipeline model.

Numbers (and Booleans): median for missing values, then optionally z-scores with
divisor n. Everything else: most frequent level for missing values, then one slot
per level; a level not seen in training sets no slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.columns import as_number, col, is_numeric, name, text_of
from plantlens.operators.identity import DataError
from plantlens.operators.quantiles import exact_quantiles

# One slot per level is only sensible for so many levels in all.
MAX_LEVELS = 20_000
FEATURES = "features"


def is_number_feature(df: DataFrame, column: str) -> bool:
    dtype = df.schema[column].dataType
    return is_numeric(dtype) or isinstance(dtype, T.BooleanType)


def number_of(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return col(column).cast("double")
    return as_number(column)


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, level, n) over all categorical columns, missing left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), text_of(df, c).alias("level")) for c in columns])
    return (df.select(F.explode(cells).alias("x")).select("x.*").filter("level is not null")
            .groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n")))


def modes_of(levels: DataFrame) -> DataFrame:
    """The most frequent level per feature, the smallest one of equals."""
    return levels.groupBy("feature").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))


def fill_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """What stands in for missing values: median per number, mode per category."""
    numbers = [c for c in features if is_number_feature(df, c)]
    others = [c for c in features if c not in numbers]
    q = exact_quantiles(df, {c: number_of(df, c) for c in numbers}, [0.5])
    rows = [(c, q[c][0], None) for c in numbers]
    out = df.sparkSession.createDataFrame(rows, "feature string, median double, mode string")
    if others:
        out = out.unionByName(modes_of(level_table(df, others)), allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Encoder:
    """A fitted encoding: `model` adds the vector column, `slots` names its entries."""

    model: PipelineModel
    features: tuple[str, ...]
    slots: tuple[str, ...]
    sources: tuple[str, ...]
    dropped: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def width(self) -> int:
        return len(self.slots)

    def source_ranges(self) -> list[tuple[str, int, int]]:
        """(source column, first slot, number of slots); the slots of a column lie together."""
        out: list[list] = []
        for i, s in enumerate(self.sources):
            if out and out[-1][0] == s:
                out[-1][2] += 1
            else:
                out.append([s, i, 1])
        return [tuple(x) for x in out]


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def fit_encoder(train: DataFrame, features: Sequence[str], scale: bool = True, output: str = FEATURES) -> Encoder:
    """Learn fill values, scales and levels from the training rows.

    A number without any training value cannot be filled and is left out. Jobs: one
    for medians, one for means and deviations, one for all levels.
    """
    unknown = [c for c in features if c not in train.columns]
    if unknown:
        raise DataError(f"unknown feature columns: {unknown}")
    numbers = [c for c in features if is_number_feature(train, c)]
    categories = [c for c in features if c not in numbers]
    medians = {c: v[0] for c, v in exact_quantiles(train, {c: number_of(train, c) for c in numbers}, [0.5]).items()}
    dropped = [c for c in numbers if medians[c] is None]
    numbers = [c for c in numbers if medians[c] is not None]
    center = {c: (0.0, 1.0) for c in numbers}
    if scale and numbers:
        aggs = []
        for i, c in enumerate(numbers):
            x = F.coalesce(number_of(train, c), F.lit(medians[c]))
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = train.agg(*aggs).first()
        center = {c: (row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] and row[f"s{i}"] > 0 else 1.0)
                  for i, c in enumerate(numbers)}
    levels: dict[str, list[str]] = {c: [] for c in categories}
    modes: dict[str, tuple[int, str]] = {}
    if categories:
        found = level_table(train, categories).limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise DataError(f"more than {MAX_LEVELS} category levels: leave out columns that name single rows")
        for r in found:
            levels[r["feature"]].append(r["level"])
            best = modes.get(r["feature"])
            if best is None or (-r["n"], r["level"]) < best:
                modes[r["feature"]] = (-r["n"], r["level"])
        dropped += [c for c in categories if not levels[c]]
        categories = [c for c in categories if levels[c]]
    if not numbers and not categories:
        raise DataError("no usable feature columns")
    cells = []
    for i, c in enumerate(numbers):
        source = f"CAST({name(c)} AS DOUBLE)"
        if not isinstance(train.schema[c].dataType, T.BooleanType):
            source = f"nanvl(try_cast({name(c)} AS DOUBLE), NULL)"
        m, s = center[c]
        cells.append(f"(coalesce({source}, {_sql_number(medians[c])}) - {_sql_number(m)}) / {_sql_number(s)} AS `_num{i}`")
    for i, c in enumerate(categories):
        text = name(c)
        if isinstance(train.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = f"date_format({text}, 'yyyy-MM-dd HH:mm:ss')"
        # a leading mark, since the one-hot stage cannot take an empty level name
        cells.append(f"concat('=', coalesce(CAST({text} AS STRING), {_sql_text(modes[c][1])})) AS `_cat{i}`")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")]
    inputs = [f"_num{i}" for i in range(len(numbers))]
    slots, sources = list(numbers), list(numbers)
    if categories:
        ordered = [sorted(levels[c]) for c in categories]
        indexers = [StringIndexerModel.from_labels(["=" + v for v in known], inputCol=f"_cat{i}",
                                                   outputCol=f"_idx{i}", handleInvalid="keep")
                    for i, known in enumerate(ordered)]
        # dropping the last slot drops the one for unseen levels, and only that
        hot = OneHotEncoder(inputCols=[f"_idx{i}" for i in range(len(categories))],
                            outputCols=[f"_hot{i}" for i in range(len(categories))], dropLast=True)
        head = PipelineModel([*stages, *indexers])
        stages += [*indexers, hot.fit(head.transform(train.limit(0)))]
        inputs += [f"_hot{i}" for i in range(len(categories))]
        for c, known in zip(categories, ordered):
            slots += [f"{c}_{v}" for v in known]
            sources += [c] * len(known)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    scratch = [x for i in range(len(categories)) for x in (f"_cat{i}", f"_idx{i}", f"_hot{i}")] + inputs[:len(numbers)]
    keep = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join('`' + s + '`' for s in dict.fromkeys(scratch))}) FROM __THIS__")
    stages.append(keep)
    return Encoder(PipelineModel(stages), tuple(features), tuple(slots), tuple(sources), tuple(dropped))
