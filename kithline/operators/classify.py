"""Frame states from integrated observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.functions.scalars import state
from kithline.operators.features import window_features
from kithline.operators.sessions import mark_bouts
from kithline.params import Params


def classify(frames: DataFrame, p: Params) -> DataFrame:
    """frames with features, state (1 interacting, 2 available, 3 alone) and the rules that held."""
    featured = window_features(mark_bouts(frames, p), p)
    close = F.coalesce(F.col("proximity") >= p.proximity, F.lit(False))
    return featured.withColumns({"state": state(p), "rule_turn_taking": F.col("in_bout"), "rule_proximity": close, "rule_sustained_speech": F.col("sustained_kcds")})
