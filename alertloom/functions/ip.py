"""IPv4 addresses as long columns; headers of an access log."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network
from operator import or_

from pyspark.sql import Column, functions as F

from alertloom import constants as K

_OCTET = r"(?:0|[1-9]\d{0,2})"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def normalize_ip(text: Column) -> Column:
    """Dotted IPv4 or IPv4-mapped IPv6 text to a long; bad text to null."""
    plain = F.regexp_replace(F.trim(text), r"^(?i)(?:::ffff:|0:0:0:0:0:ffff:)(?=\d+\.)", "")
    octets = F.transform(F.split(F.when(plain.rlike(_V4), plain), r"\."), lambda o: o.cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(F.forall(octets, lambda o: o <= 255), value)


def ip_text(value: Column) -> Column:
    octet = lambda shift: F.shiftright(value, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def in_blocks(value: Column, blocks) -> Column:
    """CIDR membership by plain bounds; the block list is a parameter."""
    nets = [ip_network(b, strict=False) for b in blocks]
    tests = [value.between(int(n.network_address), int(n.broadcast_address)) for n in nets]
    return reduce(or_, tests, F.lit(False))


def is_public(value: Column) -> Column:
    return ~in_blocks(value, K.NON_GLOBAL_BLOCKS) | in_blocks(value, K.GLOBAL_EXCEPTIONS)


def _result(address: Column, source: str, invalid: Column, local: bool = False) -> Column:
    return F.struct(
        address.cast("bigint").alias("address"), F.lit(source).alias("source"),
        invalid.alias("invalid_input"), F.lit(local).alias("is_local_development"),
    )


def client_ip(peer_text: Column, cf: Column, forwarded: Column, real_ip: Column,
              trusted: list[str], trust_headers: bool = True, local_ip: str | None = None) -> Column:
    """Client address of a request: trusted proxy headers in order, then peer."""
    peer = normalize_ip(peer_text)
    can_trust = F.coalesce(in_blocks(peer, trusted), F.lit(False)) if trust_headers and trusted else F.lit(False)
    has = lambda h: F.coalesce(h != "", F.lit(False))

    cf_ip = normalize_ip(cf)
    bad_cf = can_trust & has(cf) & cf_ip.isNull()

    chain = F.transform(F.split(forwarded, ","), lambda e: normalize_ip(e))
    chain_ok = F.coalesce(F.forall(chain, lambda a: a.isNotNull()), F.lit(False))
    outside = F.filter(F.reverse(chain), lambda a: ~in_blocks(a, trusted))
    xff_ip = F.when(chain_ok, F.get(outside, 0))
    bad_xff = can_trust & has(forwarded) & ~chain_ok

    real = normalize_ip(real_ip)
    bad_real = can_trust & has(real_ip) & real.isNull()

    clean = F.lit(False)
    invalid = bad_cf | bad_xff | bad_real
    local = F.lit(local_ip is not None)
    local_value = normalize_ip(F.lit(local_ip).cast("string"))
    return (
        F.when(can_trust & has(cf) & cf_ip.isNotNull(), _result(cf_ip, "cf_connecting_ip", clean))
        .when(can_trust & has(forwarded) & xff_ip.isNotNull(), _result(xff_ip, "x_forwarded_for", clean))
        .when(can_trust & has(real_ip) & real.isNotNull(), _result(real, "x_real_ip", clean))
        .when(peer.isNotNull() & ~is_public(peer) & local, _result(local_value, "local_development", invalid, True))
        .when(peer.isNotNull(), _result(peer, "request_client", invalid))
        .when(local, _result(local_value, "local_development", invalid, True))
        .otherwise(_result(F.lit(None), "unavailable", F.lit(True)))
    )
