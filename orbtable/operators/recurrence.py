"""Legendre sums for high degrees: the recurrence runs while summing, so no table of basis values is made.

A row holds one order of one field: its values on all rings of the grid, or its coefficients of all degrees.
Rows of one order meet the same basis values, which are made degree by degree for a block of rings and
forgotten; the work is spread by order and field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rings whose basis values are held at once.
RINGS = 1024


def basis_by_degree(m: int, lmax: int, ct: np.ndarray, st: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(l, values on the rings) for l from m to lmax, orthonormal with the Condon-Shortley sign."""
    k = np.arange(1, m + 1)
    before, now = np.zeros_like(ct), (-1) ** m * np.sqrt(np.prod((2 * k + 1) / (2 * k)) / (4 * np.pi)) * st ** m
    for l in range(m, lmax + 1):
        yield l, now
        n, den = l + 1, (l + 1 - m) * (l + 1 + m)
        ahead = np.sqrt((2 * n + 1) * (2 * n - 1) / den) * ct * now
        if l > m:
            ahead -= np.sqrt((2 * n + 1) / (2 * n - 3) * ((l + m) * (l - m)) / den) * before
        before, now = now, ahead


def _by_order(part: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for m, rows in part.groupby("m", sort=True):
        yield int(m), rows


def _spread(rows: pd.DataFrame, at: str, n: int, first: int = 0) -> np.ndarray:
    """(rows, n) complex values from lists of places and parts; what is not named is 0."""
    out = np.zeros((len(rows), n), complex)
    owner = np.repeat(np.arange(len(rows)), rows[at].str.len())
    np.add.at(out, (owner, np.concatenate(list(rows[at])).astype(int) - first), np.concatenate(list(rows["re"])) + 1j * np.concatenate(list(rows["im"])))
    return out


def _packed(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    packed = df.groupBy(*keys, "m").agg(F.collect_list(F.struct(F.col(at).cast("int").alias(at), "re", "im")).alias("v"))
    return packed.select(*keys, "m", *[F.col("v." + c).alias(c) for c in (at, "re", "im")])


def _keyed(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def legendre_sums(modes: DataFrame, keys: list[str], nodes: tuple[np.ndarray, np.ndarray, np.ndarray], lmax: int) -> DataFrame:
    """coefficients(keys, l, m, re, im) = sum over rings of weight * basis * modes(keys, i, m, re, im); nodes are (ct, st, w)."""
    ct, st, w = nodes

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m, rows in _by_order(part):
                g = _spread(rows, "i", len(ct)) * w
                out = np.zeros((len(rows), lmax + 1 - m), complex)
                for a in range(0, len(ct), RINGS):
                    block = slice(a, a + RINGS)
                    for l, y in basis_by_degree(m, lmax, ct[block], st[block]):
                        out[:, l - m] += g[:, block] @ y
                done = rows[[*keys, "m"]].copy()
                done["l"] = [np.arange(m, lmax + 1, dtype=np.int32)] * len(rows)
                done["re"], done["im"] = list(out.real), list(out.imag)
                yield done[[*keys, "m", "l", "re", "im"]]

    packed = _packed(modes, keys, "i")
    each = packed.mapInPandas(sums, _keyed(modes, keys, "m int, l array<int>, re array<double>, im array<double>"))
    zipped = each.select(*keys, "m", F.explode(F.arrays_zip("l", "re", "im")).alias("q"))
    return zipped.select(*keys, "q.l", "m", "q.re", "q.im")


def legendre_values(coeffs: DataFrame, keys: list[str], nodes: tuple[np.ndarray, np.ndarray, np.ndarray], lmax: int) -> DataFrame:
    """modes(keys, i, m, re, im) = sum over degrees of coefficients(keys, l, m, re, im) * basis on every ring."""
    ct, st, _ = nodes

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m, rows in _by_order(part):
                q = _spread(rows, "l", lmax + 1 - m, m)
                out = np.zeros((len(rows), len(ct)), complex)
                for a in range(0, len(ct), RINGS):
                    block = slice(a, a + RINGS)
                    for l, y in basis_by_degree(m, lmax, ct[block], st[block]):
                        out[:, block] += q[:, l - m, None] * y
                done = rows[[*keys, "m"]].copy()
                done["re"], done["im"] = list(out.real), list(out.imag)
                yield done[[*keys, "m", "re", "im"]]

    packed = _packed(coeffs.where(F.col("l").between(F.col("m"), lmax)), keys, "l")
    each = packed.mapInPandas(values, _keyed(coeffs, keys, "m int, re array<double>, im array<double>"))
    zipped = each.select(*keys, "m", F.posexplode(F.arrays_zip("re", "im")).alias("i", "q"))
    return zipped.select(*keys, "i", "m", "q.re", "q.im")
