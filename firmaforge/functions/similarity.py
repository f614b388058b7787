"""Field similarities used by record matching, on a 0 to 1 scale in steps of 0.01."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def exact_similarity(a: Column, b: Column) -> Column:
    """1 where both are present and equal regardless of case, else 0."""
    hit = (F.length(a) > 0) & (F.length(b) > 0) & (F.lower(a) == F.lower(b))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def token_sort_text(c: Column) -> Column:
    """ASCII words in alphabetical order: the form that word-order-free ratios compare."""
    ascii_only = F.regexp_replace(F.lower(c), r"[^\x00-\x7f]", "")
    words = F.split(F.trim(F.regexp_replace(ascii_only, r"[^a-z0-9_]+", " ")), " +")
    return F.array_join(F.sort_array(words), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by nested ``aggregate``: built-ins only, no Python.

    One row of the dynamic programme is carried per character of ``a``. Handy for short
    texts and for checking; :func:`lcs_length_arrow` is the one to use on many pairs.
    """
    width = F.length(b)
    zero = F.array_repeat(F.lit(0), width + 1)

    def next_row(prev: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda row, j: F.concat(
                row,
                F.array(
                    F.when(F.substring(b, j, F.lit(1)) == ch, F.element_at(prev, j) + 1).otherwise(
                        F.greatest(F.element_at(prev, j + 1), F.element_at(row, -1))
                    )
                ),
            ),
        )

    filled = F.element_at(F.aggregate(F.split(a, ""), zero, next_row), -1)
    return F.when((F.length(a) == 0) | (width == 0), 0).otherwise(filled)


WORD = 64
CELLS = 4_000_000


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def _lcs_block(a: list[str], b: list[str], words: int) -> np.ndarray:
    """Common subsequence lengths of many pairs at once.

    The row of the table belonging to one letter of ``b`` is kept as bits, one per letter of
    ``a``; all pairs advance by a letter together.
    """
    width = words * WORD
    left = _codes(a, width)
    right = _codes(b, max(1, max(map(len, b))))
    right = np.where(right == 0, np.uint32(0xFFFFFFFF), right)  # padding matches nothing
    row = np.full((len(a), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(right.shape[1]):
        equal = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)
        hit = row & equal
        total = row + hit
        if words > 1:
            overflow = total < row
            for w in range(1, words):
                total[:, w] += overflow[:, w - 1]
                overflow[:, w] |= overflow[:, w - 1] & (total[:, w] == 0)
        row = total | (row - hit)
    return width - np.bitwise_count(row).sum(axis=1)


def _lcs_many(a: list[str | None], b: list[str | None]) -> np.ndarray:
    out = np.zeros(len(a), dtype="int32")
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y:
            # By both lengths, so that one long text does not widen all the others.
            groups.setdefault((-(-len(x) // WORD), len(y).bit_length()), []).append(i)
    for (words, bits), members in groups.items():
        # As many pairs at once as stay within some megabytes.
        step = max(1, CELLS // ((words * WORD) + (1 << bits)))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            out[part] = _lcs_block([a[i] for i in part], [b[i] for i in part], words)
    return out


@F.pandas_udf(IntegerType())
def lcs_length_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_lcs_many(a.tolist(), b.tolist()))


def ratio_from_lcs(common: Column, a: Column, b: Column) -> Column:
    """Share of matched characters as a whole percent (half to even), divided by 100."""
    total = F.length(a) + F.length(b)
    percent = F.bround(F.lit(100.0) * (F.lit(2.0) * common / total), 0)
    return F.when(a == b, 1.0).when((F.length(a) > 0) & (F.length(b) > 0), percent / 100).otherwise(0.0)


def ratio(a: Column, b: Column, arrow: bool = False) -> Column:
    common = (lcs_length_arrow if arrow else lcs_length)(F.lower(a), F.lower(b))
    return _where_present(a, b, ratio_from_lcs(common, F.lower(a), F.lower(b)))


def token_sort_ratio(a: Column, b: Column, arrow: bool = False) -> Column:
    left, right = token_sort_text(a), token_sort_text(b)
    common = (lcs_length_arrow if arrow else lcs_length)(left, right)
    return _where_present(a, b, ratio_from_lcs(common, left, right))


def _where_present(a: Column, b: Column, score: Column) -> Column:
    return F.when((F.length(a) > 0) & (F.length(b) > 0), score).otherwise(0.0)
