"""Addresses and trusted networks against the standard library's."""

import random
from ipaddress import ip_address, ip_network

from pyspark.sql import functions as F

from tempolyra.operators import queues

FIXED = [
    "::", "::1", "1::", "2001:db8::", "2001:DB8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1::2::3", ":1", "1:", ":::", "12345::", "g::", "",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1.2.3", "::1.2.3.400", "1.2.3.4", "01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "0:0:1:0:0:0:1:0", "a:0:0:b:0:0:0:c", " ::1 ", "fe80::abcd", "::01", "::00001", "1.2.3.4::",
]


def parsed(text):
    try:
        return ip_address(text.strip())
    except ValueError:
        return None


def made_up(rng):
    out = []
    for _ in range(400):
        parts = [f"{rng.choice([0, 0, 1, rng.randrange(65536)]):x}" for _ in range(8)]
        a, b = sorted((rng.randint(0, 8), rng.randint(0, 8)))
        out.append(":".join(parts) if rng.random() < 0.3 else ":".join(parts[:a]) + "::" + ":".join(parts[b:]))
    return out


def test_ipv6_like_the_library(spark):
    texts = FIXED + made_up(random.Random(4))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", queues.ipv6(F.col("t")).alias("d"), queues.ipv6_text(queues.ipv6(F.col("t"))).alias("s")).collect():
        want = parsed(r.t)
        six = want is not None and want.version == 6
        assert r.d == (f"{int(want):032x}" if six else None), r.t
        mapped = six and want.ipv4_mapped
        assert r.s == (f"::ffff:{mapped}" if mapped else str(want) if six else None), r.t


def test_trusted_networks_and_keys(spark):
    rng = random.Random(5)
    trusted = ["10.0.0.0/9", "192.0.2.7", "2001:db8::/33", "fe80::/10", "::1", "0:0::ab/127", "proxy", "bad/net"]
    nets = [ip_network(t, strict=False) for t in trusted[:-2]]
    known = lambda t: t in trusted or ((a := parsed(t)) is not None and any(a.version == n.version and a in n for n in nets))
    hosts = ["10.1.2.3", "10.200.0.1", "192.0.2.7", "203.0.113.9", "2001:db8:0:1::5", "2001:db8:8000::1", "2001:DB8::1", "fe80::1", "febf::1", "fec0::1", "0::1", "::ab", "::aa", "::ac", "proxy", "junk", "2001:0db8:ffff::0001"]
    rows = [(k, rng.choice(hosts), rng.choice([None, "", ", ".join(rng.choice(hosts) for _ in range(rng.randint(1, 4)))])) for k in range(300)]
    got = queues.client_key(spark.createDataFrame(rows, "id int, peer_host string, forwarded_for string"), trusted).collect()
    for r in got:
        want = r.peer_host
        if r.forwarded_for and known(r.peer_host):
            chain = [str(a) for x in r.forwarded_for.split(",") if (a := parsed(x)) is not None]
            want = next((x for x in reversed([*chain, r.peer_host]) if not known(x)), r.peer_host)
        assert r.client_key == want, r
