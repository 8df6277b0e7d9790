"""URL checks."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# Internal host names.
INTERNAL_HOSTS = ["localhost", "metadata.google.internal"]
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}\z"
INTERNAL_IPV4 = r"^(127|10)\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^169\.254\.|^224\.0\.0\."
# Internal IPv6 networks (loopback, unique local, link-local uni- and multicast).
INTERNAL_IPV6 = ["::1/128", "fc00::/7", "fe80::/10", "ff02::/16"]


@pandas_udf(T.BooleanType())
def _internal_ipv6(hosts: pd.Series) -> pd.Series:
    networks = [ipaddress.ip_network(n) for n in INTERNAL_IPV6]
    v4 = [ipaddress.ip_network(n) for n in
          ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/24")]

    def one(host):
        if host is None:
            return False
        try:
            address = ipaddress.IPv6Address(host)
        except ValueError:
            return False
        mapped = address.ipv4_mapped
        return any(mapped in n for n in v4) if mapped else any(address in n for n in networks)

    return hosts.map(one).astype(bool)


def url_host(url: Column) -> Column:
    """Host of an http(s) URL without port, user and brackets; empty when there is none."""
    authority = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]%]*)(%25[^\]]*)?\](:\d*)?\z", 1)
    return F.when(bare.startswith("["), v6).otherwise(F.regexp_replace(bare, r":\d*\z", ""))


def is_external_url(url: Column) -> Column:
    """Whether the URL is http(s) with a host outside loopback, private and link-local networks.

    IPv6 literals alone are decided in Python; all other hosts stay in the JVM.
    """
    host = url_host(url)
    malformed = url.rlike(r"[\x00-\x1f\x7f]|^https?://[^/?#]*[ <>\"\\^`{|}]") | url.rlike(r"%(?![0-9A-Fa-f]{2})")
    v6 = host.contains(":")
    internal = (
        F.when(v6, _internal_ipv6(F.when(v6, host)))
        .when(host.rlike(IPV4), host.rlike(INTERNAL_IPV4))
        .otherwise(F.lit(False))
    )
    return (
        url.rlike("^https?://") & ~malformed & (host != "") & ~host.isin(*INTERNAL_HOSTS) & ~internal
    )
