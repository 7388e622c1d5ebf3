"""Addresses in networks: an interval join without a cross join.

A range of addresses is cut into prefixes (aligned blocks whose size is a power of two, at most 62 of them). An address
then meets a range if one of its own prefixes, of a length that the table has, is in the table: an equality join on
(length, prefix). An address has at most 33 prefixes, whatever the number of ranges; ranges may overlap or nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32


def address_number(address: Column) -> Column:
    """IPv4 in dotted form as a whole number; null for anything else."""
    parts = F.split(address, r"\.")
    # null wherever a part is missing, no number or above 255
    octets = [F.get(parts, F.lit(k)).try_cast("bigint") for k in range(4)]
    number = sum((F.when(octets[k].between(0, 255), octets[k]) * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def network_ranges(networks: DataFrame, column: str = "cidr") -> DataFrame:
    """first, last of every network given as a.b.c.d/length or as a single address; other texts are left out.

    Bits of the address beyond the length are ignored, as usual.
    """
    number = address_number(F.substring_index(F.col(column), "/", 1))
    length = F.when(~F.contains(F.col(column), F.lit("/")), F.lit(BITS)).when(F.col(column).rlike(r"/\d{1,2}$"), F.substring_index(F.col(column), "/", -1).try_cast("int"))
    block = F.pow(F.lit(2.0), F.lit(BITS) - F.least(F.greatest("_l", F.lit(0)), F.lit(BITS))).cast("bigint")
    found = networks.select(number.alias("_n"), length.alias("_l")).filter(F.col("_n").isNotNull() & F.col("_l").between(0, BITS))
    return found.select((F.col("_n") - F.col("_n") % block).alias("first"), (F.col("_n") - F.col("_n") % block + block - 1).alias("last"))


def prefixes(ranges: DataFrame) -> DataFrame:
    """length, prefix: the fewest aligned blocks that make up the ranges first..last, each once."""
    blocks = []
    for k in range(BITS + 1):
        size = 1 << k
        low, high = F.ceil(F.col("first") / size).cast("bigint"), F.floor((F.col("last") + 1) / size).cast("bigint")
        # of the blocks of this size, those that no larger one holds: one at either end at most
        for at, odd in ((low, low), (high - 1, high)):
            largest = F.lit(k == BITS) | (odd % 2 == 1)
            blocks.append(F.when((low < high) & largest, F.struct(F.lit(BITS - k).alias("length"), at.alias("prefix"))))
    return (ranges.filter("first <= last").select(F.explode(F.filter(F.array(*blocks), lambda b: b.isNotNull())).alias("b"))
            .select("b.length", "b.prefix").distinct())


def in_networks(addresses: DataFrame, ranges: DataFrame, column: str = "ip", name: str = "is_allowed") -> DataFrame:
    """Adds whether the address is in any range (first, last). Addresses that are no IPv4 are in none.

    Every distinct address is looked up once, by its prefixes of the lengths that the table has (at most 33).
    """
    cut = prefixes(ranges)
    lengths = sorted(r["length"] for r in cut.select("length").distinct().collect())
    known = addresses.select(F.col(column).alias("_address")).distinct().select("_address", address_number(F.col("_address")).alias("_n"))
    own = [F.struct(F.lit(n).alias("length"), F.floor(F.col("_n") / (1 << (BITS - n))).cast("bigint").alias("prefix")) for n in lengths]
    asked = known.filter("_n is not null").select("_address", F.explode(F.array(*own)).alias("b")).select("_address", "b.length", "b.prefix") if own else None
    if asked is None:
        return addresses.withColumn(name, F.lit(False))
    found = asked.join(cut, ["length", "prefix"], "left_semi").select("_address").distinct().withColumn("_in", F.lit(True))
    return (addresses.join(found, F.col(column) == F.col("_address"), "left")
            .withColumn(name, F.coalesce("_in", F.lit(False))).drop("_address", "_in"))
