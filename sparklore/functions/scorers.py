"""A hook for models that score pairs of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def pair_scorer(load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]], rows: int = 256):
    """A column function of two texts that gives the scores of a user's model.

    ``load`` is called once per task and returns the model: a function of two equally long lists of texts. It gets at most ``rows`` pairs at a
    time, whatever the size of an Arrow batch, so its memory is bounded. Pairs with a null text have a null score and do not reach it.
    """
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for left, right in batches:
            out = pd.Series([None] * len(left), index=left.index, dtype="float64")
            known = (left.notna() & right.notna()).to_numpy().nonzero()[0]
            for at in range(0, len(known), rows):
                here = known[at:at + rows]
                out.iloc[here] = list(model(left.iloc[here].tolist(), right.iloc[here].tolist()))
            yield out

    return score
