"""Join keys for texts whose similarity rounds to 100 percent.

A ratio of 99.5 % and more counts as full marks, so a pair of long texts may differ in one
letter per hundred. One letter put in or left out changes ``GRAM`` grams at most; of two texts
d such steps apart, the smallest gram that both have is therefore among the first
GRAM * d + 1 grams of each in any fixed order. Those few are the keys of a text. Texts under
100 characters can only be equal and have one key.

A name and an address are keyed together where the name is short (its whole text with each
key of the address); a long name is keyed alone and its address is left to the score.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 10
LONG = 100


def _slack(length: Column) -> Column:
    # d steps need d <= 0.005 * (length + length + d).
    return F.floor(length * 0.01 / 0.995 + 1e-9).cast("int")


def gram_keys(text: Column) -> Column:
    """The smallest hashes of the grams of a text, one more than a pair may lose."""

    def of(chars: Column) -> Column:
        n = F.size(chars)
        grams = F.transform(
            F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(GRAM)])
        )
        return F.slice(F.array_sort(F.array_distinct(grams)), 1, GRAM * _slack(n) + 1)

    return F.transform(F.array(F.filter(F.split(text, ""), lambda x: x != "")), of)[0]


def whole_key(name: Column, address: Column) -> Column:
    """The key that equal pairs of texts share."""
    return F.xxhash64(F.lit("="), name, address)


def near_equal_keys(name: Column, address: Column) -> Column:
    """Keys of a pair of texts; pairs with full marks in both have one in common."""
    by_name = F.transform(gram_keys(name), lambda k: F.xxhash64(F.lit("name"), k))
    by_address = F.transform(gram_keys(address), lambda k: F.xxhash64(F.lit("address"), name, k))
    whole = F.array(whole_key(name, address))
    long_name, long_address = F.length(name) >= LONG, F.length(address) >= LONG
    return F.when(long_name, F.concat(whole, by_name)).when(long_address, F.concat(whole, by_address)).otherwise(whole)
