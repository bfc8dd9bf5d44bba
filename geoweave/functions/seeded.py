"""Numbers drawn from seeds: 64-bit arithmetic without signs, which the built-in functions lack, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

U = np.uint64
# What turns a seed into a state, and the generator's step.
_GOLDEN, _A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP, _ADD = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def states(seeds: np.ndarray) -> np.ndarray:
    """The states of the lower 32 bits of seeds."""
    x = ((seeds & U(0xFFFFFFFF)) ^ _GOLDEN) * _A
    for shift, factor in ((U(30), _B), (U(27), _GOLDEN)):
        x = (x ^ x >> shift) * factor
    return x ^ x >> U(31)


def drawn(state: np.ndarray) -> np.ndarray:
    """32 bits of each state: its middle, turned by its upper five bits."""
    low = (state ^ state >> U(18)) >> U(27) & U(0xFFFFFFFF)
    turn = state >> U(59)
    return (low >> turn | low << (U(32) - turn & U(31))) & U(0xFFFFFFFF)


@F.pandas_udf(StructType([StructField("number", LongType()), StructField("next", LongType())]))
def seeded(seed: pd.Series) -> pd.DataFrame:
    """For each seed a number of 32 bits and the seed after it."""
    state = states(seed.to_numpy(np.int64).view(U))
    return pd.DataFrame({"number": drawn(state).astype(np.int64), "next": (state * _STEP + _ADD >> U(32)).astype(np.int64)})
