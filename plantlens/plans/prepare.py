"""Feature preparation in its fixed order, with what was done."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.columns import col, numeric_columns
from plantlens.operators.decompose import stl_decompose
from plantlens.operators.features import add_ema, add_features, add_lags, add_sma, seasonal_decompose
from plantlens.operators.splits import clamp_ratio, effective_split, split, standardize


@dataclass
class PrepareConfig:
    """Each average or decomposition is a dict of its function's arguments, `column` among them."""

    lags: Mapping[str, Sequence[int]] = field(default_factory=dict)
    features: Sequence[tuple[str, str]] = ()
    sma: Sequence[Mapping] = ()
    ema: Sequence[Mapping] = ()
    seasonal: Sequence[Mapping] = ()
    stl: Sequence[Mapping] = ()
    split_method: str = "random"
    train_ratio: float = 0.8
    seed: int = 42
    stratify_col: str | None = None
    order_cols: Sequence[str] = ()
    series_cols: Sequence[str] = ()
    standardize: bool = False
    id_col: str = "id"
    flag: str = "is_train"

    @property
    def uses_order(self) -> bool:
        return bool(self.lags or self.sma or self.ema)

    @property
    def model_split(self) -> str:
        return effective_split(self.split_method, self.uses_order)


@dataclass
class Prepared:
    data: DataFrame
    added: dict[str, list[str]]
    standardized: list[str]
    warnings: list[str]
    flag: str

    def counts(self) -> DataFrame:
        return self.data.agg(F.count_if(self.flag).alias("train_count"), F.count_if(~F.col(self.flag)).alias("test_count"))


def prepare(df: DataFrame, config: PrepareConfig, for_model: bool = False) -> Prepared:
    """Lags, expressions, SMA, EMA, decomposition, split, scaling.

    For a model the decomposition and the scaling are left out (the one looks
    ahead, the other belongs to the model) and the split is the effective one.
    """
    warnings: list[str] = []
    order = list(dict.fromkeys([*config.order_cols, config.id_col]))
    placed = {"order_cols": order, "series_cols": list(config.series_cols), "warnings": warnings}
    added: dict[str, list[str]] = {}

    def note(kind: str, before: DataFrame, after: DataFrame) -> DataFrame:
        added[kind] = [c for c in after.columns if c not in before.columns]
        return after

    work = note("lags", df, add_lags(df, config.lags, order, config.series_cols, warnings=warnings))
    work = note("features", work, add_features(work, config.features, warnings))
    for kind, step, items in (("sma", add_sma, config.sma), ("ema", add_ema, config.ema),
                              ("seasonal", seasonal_decompose, () if for_model else config.seasonal),
                              ("stl", stl_decompose, () if for_model else config.stl)):
        start = work
        for item in items:
            work = step(work, **item, **placed)
        note(kind, start, work)
    method = config.model_split if for_model else config.split_method
    work = split(work, method, clamp_ratio(config.train_ratio), config.seed, config.stratify_col, config.order_cols,
                 config.series_cols, config.id_col, config.flag, warnings)
    scaled: list[str] = []
    if config.standardize and not for_model:
        scaled = numeric_columns(work, [config.id_col])
        work = standardize(work, col(config.flag), scaled, config.id_col)
    return Prepared(work, added, scaled, warnings, config.flag)
