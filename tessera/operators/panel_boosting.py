"""The panel forecaster with regularised boosting, or with Spark's trees on blocks: one fit for all entities, or for all folds of a backtest at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import block_trees, boosting, models, panel, splits
from tessera.sources.files import roundtrip

#: What a series' name stands before its fold with; folds come first, so that names may hold it.
MARK = "|"


class PanelModel:
    """A boosting.Model or block_trees.Boosted on the supervised frame of scaled values, and the entities that it has seen."""

    def __init__(self, model: boosting.Model | block_trees.Boosted, entities: DataFrame):
        self.model, self.entities = model, entities

    def forecast(self, history: DataFrame, horizon: int, step_days: int = 1) -> DataFrame:
        """(entity, ts, step, yhat) from a panel; raises for entities that the model doesn't know, or that have too few rows."""
        tails = roundtrip(models.recent(history))
        models.check_tails(tails, self.entities)
        return models.recursive(tails, {None: (self.model.base[0], self.model.trees())}, horizon, step_days)


def fit(history: DataFrame, **options) -> PanelModel:
    """options are those of boosting. Refuses null entities and repeated keys."""
    panel.guard(history)
    model = boosting.fit(models.panel_frame(history), "y_scaled", models.FRAME, **options)
    return PanelModel(model, roundtrip(history.select("entity").distinct()))


def fit_on_blocks(history: DataFrame, **options) -> PanelModel:
    """The trees of models.fit_panel, grown on blocks of bins, for panels of very many rows. options are those of block_trees.fit."""
    panel.guard(history)
    model = block_trees.fit(roundtrip(models.panel_frame(history).select("y_scaled", *models.FRAME)), "y_scaled", models.FRAME, **options)
    return PanelModel(model, roundtrip(history.select("entity").distinct()))


def backtest(history: DataFrame, initial: int, horizon: int, step: int, sliding: bool = False, step_days: int = 1, **options) -> DataFrame:
    """(fold, entity, ts, y, yhat, error) of the panel model fitted anew for each walk-forward fold and forecast from its end.

    A fold is a dimension of one fit: its training rows are a panel of their own (an entity is the same entity once for each fold), the trees of
    all folds grow in the same jobs, and all forecasts are one job. Entities with too few rows in a fold have a row with an error and nulls.
    """
    folded = splits.folds(history, initial, horizon, step, sliding)
    series = F.concat_ws(MARK, F.col("fold").cast("string"), "entity")
    of_fold = lambda df: df.select("*", F.substring_index("entity", MARK, 1).cast("int").alias("fold"))
    train = folded.where("role = 'train'").select(series.alias("entity"), "ts", "y")
    found = boosting.fit_groups(of_fold(models.panel_frame(train)), "fold", "y_scaled", models.FRAME, **options)
    tails = roundtrip(of_fold(models.recent(train)))
    n = tails.groupBy("fold", "entity").agg(F.count(F.lit(1)).alias("n"))
    long = n.where(F.col("n") >= max(panel.LAGS + panel.WINDOWS)).where(F.col("fold").isin(list(found)))
    ahead = models.recursive(tails.join(long.select("fold", "entity"), ["fold", "entity"]), {k: (m.base[0], m.trees()) for k, m in found.items()}, horizon + 1, step_days).select("fold", "entity", "ts", "yhat")
    test = folded.where("role = 'test'").select("fold", series.alias("entity"), "ts", "y")
    plain = F.expr(f"substring(entity, instr(entity, '{MARK}') + 1)").alias("entity")
    good = test.join(ahead, ["fold", "entity", "ts"]).select("fold", plain, "ts", "y", "yhat", F.lit(None).cast("string").alias("error"))
    bad = n.join(long.select("fold", "entity"), ["fold", "entity"], "left_anti").select("fold", plain, F.lit(None).cast("date").alias("ts"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("yhat"), F.concat(F.lit("too few rows: "), F.col("n").cast("string")).alias("error"))
    return good.unionByName(bad)
