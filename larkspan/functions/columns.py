"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shingle_key(shingle: Column) -> Column:
    """A 60-bit key of a string."""
    return F.conv(F.substring(F.md5(shingle), 1, 15), 16, 10).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x).cast("int")


def exact(x: Column) -> Column:
    """A double as a decimal, so that sums do not depend on their order."""
    return x.cast("decimal(28,12)")


def places5(x: Column) -> Column:
    return x.cast("decimal(20,5)").cast("double")


def pack_descriptor(a: Column, *deltas: Column) -> Column:
    """Five integers to a 40-bit key; an anchor outside 0..255 or a delta outside -128..127 is an error."""
    ok = a.between(0, 255)
    key = F.shiftleft(a.cast("long"), 32)
    for d, shift in zip(deltas, (24, 16, 8, 0), strict=True):
        ok = ok & d.between(-128, 127)
        key = key.bitwiseOR(F.shiftleft((d + 128).cast("long"), shift))
    return F.when(ok, key).otherwise(F.raise_error(F.lit("descriptor out of range")).cast("long"))


def descriptor_in_range(a: Column, *deltas: Column) -> Column:
    ok = a.between(0, 255)
    for d in deltas:
        ok = ok & d.between(-128, 127)
    return ok


def parse_descriptor(text: Column) -> Column:
    """``tri:a:b:c:d:e`` to its 40-bit key; malformed text is an error."""
    parts = F.split(text, ":")
    good = (F.size(parts) == 6) & (parts[0] == "tri")
    numbers = [parts[i].cast("int") for i in range(1, 6)]
    return F.when(good, pack_descriptor(*numbers)).otherwise(F.raise_error(F.lit("malformed descriptor")).cast("long"))


def probes(values: list[Column], radius: int) -> Column:
    """An array of descriptors: the given one, and those with one coordinate moved by up to ``radius``."""
    out = [F.array(*values)]
    for i in range(len(values)):
        for step in range(1, radius + 1):
            for s in (-step, step):
                out.append(F.array(*[v + s if j == i else v for j, v in enumerate(values)]))
    return F.array(*out)


def finite(x: Column) -> Column:
    """Non-finite numbers become -inf, so that they sort below all others."""
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return F.when(bad, F.lit(float("-inf"))).otherwise(x)
