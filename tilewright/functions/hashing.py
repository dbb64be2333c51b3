"""64-bit hashes with wrapping arithmetic, which SQL integers don't have: numpy behind Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An FNV multiplier; the seed of label keys isn't the standard basis, that of pairs is.
PRIME, LABEL_SEED, STANDARD_SEED = 1099511628211, 1469598103934665603, 14695981039346656037
MASK = (1 << 64) - 1


def fold_words(seed: int, words: list[int]) -> int:
    """Whole words are folded in, not their bytes."""
    for w in words:
        seed = ((seed ^ (w & MASK)) * PRIME) & MASK
    return seed


def fold_text(seed: int, text: str, with_length: bool) -> int:
    """The bytes of a text, after their number if wanted."""
    raw = text.encode()
    return fold_words(seed, ([len(raw)] if with_length else []) + list(raw))


def signed(x: int) -> int:
    """The same bits as a BIGINT."""
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def label_key(feature: pd.Series, text: pd.Series) -> pd.Series:
    """Key of a label: its feature's id, then its text with length. The bits of an unsigned number."""
    return pd.Series([None if f is None or f != f or t is None else signed(fold_text(fold_words(LABEL_SEED, [int(f)]), t, True)) for f, t in zip(feature, text, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def splitmix(x: pd.Series) -> pd.Series:
    """One step of SplitMix64 from each seed."""
    with np.errstate(over="ignore"):
        z = x.to_numpy().astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64))


@F.pandas_udf(T.DoubleType())
def pair_direction(a: pd.Series, b: pd.Series) -> pd.Series:
    """An angle for two markers at one place: the same whichever comes first."""
    out = []
    for x, y in zip(a, b, strict=True):
        low, high = sorted((int(x) & MASK, int(y) & MASK))
        h = fold_words(STANDARD_SEED, list(low.to_bytes(8, "little") + high.to_bytes(8, "little")))
        out.append(h / 2.0**64 * 2 * np.pi)
    return pd.Series(out)


def style_bucket(h: Column) -> Column:
    """Style keys 3 to 207 from a hash; different styles may share one."""
    return F.lit(3) + F.pmod(h, F.lit(205))
