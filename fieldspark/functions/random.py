"""Reproducible random columns (X11).

``F.rand(seed)`` depends on how rows are split into partitions.  Here every
uniform is a function of a seed, a salt and the row's key columns only: the
MD5 digest of their texts, of which hexadecimal digits become a number.  The
same keys give the same draws on any partitioning and any cluster size, and
any SQL engine with MD5 can repeat them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROPOSALS = 8


def _text(key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(c.cast("string"), F.lit("NA"))


def row_digest(keys: Sequence[str | Column], seed: int, salt: int = 0) -> Column:
    """MD5 of ``seed|salt|key|...`` as 32 hexadecimal digits (NULL keys: NA)."""
    return F.md5(F.concat_ws("|", F.lit(f"{int(seed)}|{int(salt)}"), *map(_text, keys)))


def _unit(digest: Column, start: int, digits: int) -> Column:
    number = F.conv(F.substring(digest, start, digits), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(16**digits))


def hashed_uniform(keys: Sequence[str | Column], seed: int, salt: int = 0) -> Column:
    """Uniform on the open interval (0, 1)."""
    return _unit(row_digest(keys, seed, salt), 1, 13)


def _box_muller(u1: Column, u2: Column) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hashed_normal(keys: Sequence[str | Column], seed: int, mean: float = 0.0, sd: float = 1.0,
                  salt: int = 0) -> Column:
    """Normal draw by Box-Muller from two uniforms of one digest."""
    d = row_digest(keys, seed, salt)
    return F.lit(float(mean)) + F.lit(float(sd)) * _box_muller(_unit(d, 1, 13), _unit(d, 14, 13))


def hashed_exponential(keys: Sequence[str | Column], seed: int, rate: float = 1.0,
                       salt: int = 0) -> Column:
    """Exponential draw by inversion: ``-ln(u) / rate``."""
    return -F.log(hashed_uniform(keys, seed, salt)) / F.lit(float(rate))


def _digests(prefix: str, keys: list[bytes]) -> np.ndarray:
    """Digest bytes, one row per key."""
    head = prefix.encode()
    raw = b"".join([hashlib.md5(head + k, usedforsecurity=False).digest() for k in keys])
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16).astype(np.float64)


def _units(digests: np.ndarray, start: int, digits: int) -> np.ndarray:
    """Hexadecimal digits of digests as uniforms (``start`` 0-based)."""
    value = np.zeros(len(digests))
    for d in range(start, start + digits):
        high = np.floor(digests[:, d // 2] / 16)
        value = value * 16 + (high if d % 2 == 0 else digests[:, d // 2] - 16 * high)
    return (value + 0.5) / 16.0**digits


def gamma_draws(keys: list[bytes], seed: int, shape: np.ndarray, scale: np.ndarray,
                salt: int = 0) -> np.ndarray:
    """Marsaglia and Tsang's method on the digests of ``keys``; NaN if undefined.

    A proposal is made only for keys whose earlier ones were all rejected.
    """
    boosted = np.where(shape < 1, shape + 1.0, shape)
    left = np.flatnonzero(shape > 0)
    out = np.full(len(keys), np.nan)
    out[left] = boosted[left] - 1.0 / 3.0  # if all proposals fail: below 1e-10
    for k in range(1, PROPOSALS + 1):
        if not len(left):
            break
        digest = _digests(f"{int(seed)}|{int(salt) + k}|", [keys[i] for i in left])
        u1, u2, u3 = (_units(digest, at, 10) for at in (0, 10, 20))
        z = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)
        d = boosted[left] - 1.0 / 3.0
        v = (1.0 + 1.0 / np.sqrt(9.0 * d) * z) ** 3.0
        log_v = np.log(np.where(v > 0, v, 1.0))
        accept = (v > 0) & (np.log(u3) < 0.5 * z * z + d - d * v + d * log_v)
        out[left[accept]] = (d * v)[accept]
        left = left[~accept]
    small = np.flatnonzero((shape > 0) & (shape < 1))
    if len(small):
        u = _units(_digests(f"{int(seed)}|{int(salt)}|", [keys[i] for i in small]), 0, 13)
        out[small] *= u ** (1.0 / shape[small])
    return out * scale


def hashed_gamma(keys: Sequence[str | Column], seed: int, shape: Column, scale: Column,
                 salt: int = 0) -> Column:
    """Gamma draw by Marsaglia and Tsang's method, in Arrow batches.

    Proposal ``k`` takes a normal and a uniform from the digest with salt
    ``salt + k``; the first accepted one counts.  Over 95 % of proposals are
    accepted; if all of ``PROPOSALS`` fail (probability below 1e-10) the mode
    of the proposal is taken, so the draw always ends.  Shapes below 1
    use ``G(a) = G(a + 1) * U^(1/a)``.  A NULL, NaN or non-positive shape
    gives NULL.
    """
    @F.pandas_udf("double")
    def draw(key: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(gamma_draws([k.encode() for k in key], seed, a.to_numpy(float),
                                     b.to_numpy(float), salt))

    joined = F.concat_ws("|", *map(_text, keys))
    return draw(joined, shape.cast("double"), scale.cast("double"))
