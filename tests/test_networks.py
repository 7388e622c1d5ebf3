"""Addresses in networks against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import networks

NETWORKS = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "192.168.1.77/26", "0.0.0.0/32", "255.255.255.255", "172.16.5.4/31", "172.16.5.4/30",
            "nonsense", "300.1.1.1/8", "1.2.3.4/33", "1.2.3/8", None, "10.1.2.3"]
ADDRESSES = ["10.9.9.9", "11.0.0.0", "192.168.1.64", "192.168.1.127", "192.168.1.128", "192.168.1.63", "0.0.0.0", "0.0.0.1", "255.255.255.255",
             "255.255.255.254", "172.16.5.3", "172.16.5.4", "172.16.5.7", "172.16.5.8", "::1", "1.2.3.4", "1.2.3", "256.1.1.1", "", None, "10.9.9.9"]


def valid():
    found = []
    for text in NETWORKS:
        try:
            found.append(ipaddress.ip_network(text, strict=False) if text and text.count(".") == 3 else None)
        except ValueError:
            pass
    return [n for n in found if n is not None]


def expected(address):
    try:
        return any(ipaddress.ip_address(address) in n for n in valid())
    except ValueError:
        return False


def test_networks_equal_the_library(spark):
    ranges = networks.network_ranges(spark.createDataFrame([(n,) for n in NETWORKS], "cidr string"))
    draw = random.Random(1)
    more = [str(ipaddress.ip_address(draw.randrange(1 << 32))) for _ in range(300)] + [f"10.{draw.randrange(256)}.0.1" for _ in range(50)]
    rows = spark.createDataFrame([(a, "x") for a in ADDRESSES + more], "ip string, _n string")
    found = networks.in_networks(rows, ranges).collect()
    assert len(found) == len(ADDRESSES) + 350
    assert all(r["is_allowed"] == expected(r["ip"]) for r in found)
    assert networks.in_networks(rows, ranges.limit(0)).filter("is_allowed").count() == 0
    plan = networks.in_networks(rows, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("first,last", [(0, 0), (0, (1 << 32) - 1), (1, (1 << 32) - 2), (5, 9), (8, 15), (7, 16), (1000, 70_000), (9, 5)])
def test_ranges_are_cut_into_the_fewest_blocks(spark, first, last):
    frame = spark.createDataFrame([(first, last), (first, last)], "first bigint, last bigint")
    got = sorted((r["prefix"] << (32 - r["length"]), r["length"]) for r in networks.prefixes(frame).collect())
    want = [] if first > last else [(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(first), ipaddress.IPv4Address(last))]
    assert got == sorted(want)


def test_many_random_ranges(spark):
    draw = random.Random(3)
    pairs = [tuple(sorted((draw.randrange(5000), draw.randrange(5000)))) for _ in range(40)]
    pairs = [(a, min(b, a + 60)) for a, b in pairs]
    inside = {k for a, b in pairs for k in range(a, b + 1)}
    rows = spark.range(0, 5200).select(F.concat_ws(".", F.lit(0), F.lit(0), (F.col("id") / 256).cast("int"), F.col("id") % 256).alias("ip"), "id")
    found = networks.in_networks(rows, spark.createDataFrame(pairs, "first bigint, last bigint")).filter("is_allowed").select("id").collect()
    assert {r["id"] for r in found} == inside
