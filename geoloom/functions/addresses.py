"""Addresses with and without credentials, and what a failed transfer died of, as Columns. A null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, then what stands before the last @, then the host and the rest.
_WITH_USER = r"(?s)^(.*?://)(.*)@([^@]*)$"
_MASK = "***:***"


def with_scheme(address: Column) -> Column:
    """Without white space around it and slashes behind it; http where it names no scheme. An empty one stays empty."""
    tidy = F.regexp_replace(F.regexp_replace(address, r"^\s+|\s+$", ""), "/+$", "")
    return F.when((tidy == "") | F.contains(tidy, F.lit("://")), tidy).otherwise(F.concat(F.lit("http://"), tidy))


def _decoded(text: Column) -> Column:
    """Percent signs resolved; a plus stays one, and a text with faulty escapes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def split_credentials(address: Column) -> Column:
    """{address, user, password}: the address with a scheme and without credentials. User and password are divided by the first colon and null where there are none."""
    whole = with_scheme(address)
    part = lambda k: F.regexp_extract(whole, _WITH_USER, k)
    named = F.regexp_like(whole, F.lit(_WITH_USER))
    colon = F.instr(part(2), ":")
    user = F.when(colon > 0, F.substring_index(part(2), ":", 1)).otherwise(part(2))
    return F.struct(
        F.when(named, F.concat(part(1), part(3))).otherwise(whole).alias("address"),
        F.when(named, _decoded(user)).alias("user"),
        F.when(named & (colon > 0), _decoded(F.substr(part(2), colon + 1))).alias("password"),
    )


def masked(address: Column) -> Column:
    """The address as it may be logged: stars instead of credentials. Without a scheme nothing is taken for credentials."""
    return F.regexp_replace(address, _WITH_USER, rf"$1{_MASK}@$3".replace("*", r"\*"))


def last_segment(address: Column) -> Column:
    """What stands behind the last slash."""
    return F.element_at(F.split(address, "/"), -1)


def failure_code(kind: Column, status: Column, text: Column) -> Column:
    """PROXY_AUTH, SSL, TIMEOUT, DNS, PROXY, HTTP or OTHER.

    kind says what failed (ssl, timeout, host, socket or anything else), status is the answer's number and
    text the message; each may be null. A 407, also one inside the message, counts before all others.
    """
    is_ = lambda name: F.lower(kind) == name
    return (
        F.when((status == 407) | F.contains(text, F.lit("407")), "PROXY_AUTH").when(is_("ssl"), "SSL").when(is_("timeout"), "TIMEOUT")
        .when(is_("host"), "DNS").when(is_("socket"), "PROXY").when(status.isNotNull(), "HTTP").otherwise("OTHER")
    )
