"""The guard of addresses against the standard library's registry."""

import ipaddress
import random

from pyspark.sql import functions as F

from tessera.operators import contracts

EDGES = """::1 :: fe80::1 fc00::1 fdff::1 ff02::1 fec0::1 2001:db8::1 2001:db9::1 2001:: 2001:1ff:ffff::1 2001:200::1 2001:1::1 2001:1::2 2001:1::3 2001:3::5 2001:4:112::1 2001:4:113::1 2001:20::1 2001:2f::1 2001:30::1
2001:3f::1 2001:40::1 2002::1 3fff::1 3fff:fff::1 3fff:1000::1 2606:4700:4700::1111 2a00:1450:4001:81b::200e 100::1 64:ff9b::8.8.8.8 64:ff9b::10.0.0.1 64:ff9b:1::1 ::ffff:127.0.0.1 ::ffff:8.8.8.8 ::FFFF:808:808 ::ffff:7f00:1
::8.8.8.8 4000::1 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 1:2:3:4:5:6:7 1::2::3 ::: :1 1: 12345::1 g::1 ::1.2.3 ::1.2.3.256 ::01.2.3.4 1.2.3.4 01.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5 192.0.0.9 192.0.0.10 192.0.0.8 192.0.2.1 192.0.1.1 100.63.1.1
100.64.0.1 100.127.255.255 100.128.0.0 169.254.169.254 172.15.0.1 172.16.0.1 172.31.0.1 172.32.0.1 198.17.0.1 198.18.0.1 198.19.1.1 198.20.0.1 203.0.113.9 224.0.0.1 239.1.1.1 240.0.0.1 255.255.255.255 0.0.0.0 10.0.0.1 127.0.0.1
example.com localhost 8.8.8.8""".split()


def want(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    if found.version == 6:
        if found.ipv4_mapped is not None:
            found = found.ipv4_mapped
        elif found in ipaddress.ip_network("64:ff9b::/96"):
            found = ipaddress.IPv4Address(int(found) & 0xFFFFFFFF)
    # set aside for examples since 2024, which older copies of the registry lack
    closed = found.version == 6 and found in ipaddress.ip_network("3fff::/20")
    closed = closed or found.is_private or found.is_loopback or found.is_link_local or found.is_multicast or found.is_reserved or found.is_unspecified
    return not closed and found.is_global


def test_addresses_are_judged_as_the_registry_says(spark):
    r = random.Random(2)
    some = [str(ipaddress.IPv6Address(r.getrandbits(128))) for _ in range(300)] + [str(ipaddress.IPv6Address((r.choice([0x2001, 0x2002, 0x3FFF, 0x64, 0, 0xFE80, 0x2600]) << 112) + r.getrandbits(r.choice([8, 40, 100])))) for _ in range(400)]
    some += [".".join(str(r.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 240, r.randrange(256)])) for _ in range(4)) for _ in range(300)]
    hosts = [*EDGES, *some, *(ipaddress.ip_address(x).exploded.upper() for x in some[:100]), "", None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id int, host string").select("id", contracts.public_address(F.col("host")).alias("public")).collect()
    assert {hosts[x.id]: x.public for x in rows if x.public != (want(hosts[x.id]) if hosts[x.id] else None)} == {}
