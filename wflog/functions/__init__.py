"""Scalar functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_fingerprint(payload: Column) -> Column:
    """SHA-256 of the payload, upper-case hex."""
    return F.upper(F.sha2(payload, 256))


def envelope_fingerprint(*parts: Column) -> Column:
    """SHA-256, upper-case hex, of the parts in order, each with its length before it; null is marked."""
    text = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("~")) for p in parts]
    return F.upper(F.sha2(F.concat_ws("|", *text), 256))


def _b64(c: Column) -> Column:
    return F.base64(F.encode(c, "utf-8"))


#: What a route's storage key begins with: fixed values.
ROUTES = {"direct": "direct", "correlation": "correlation", "target": "definition-fanout-target"}


def route_key(kind: str, owners: list[Column], version: Column, name: Column, correlation: Column) -> Column:
    """Storage key of a route: its kind, its owners (instance, definition or both), version, name and correlation in base64."""
    return F.concat_ws("|", F.lit(ROUTES[kind]), *[o.cast("string") for o in owners], version.cast("string"), _b64(name), _b64(correlation))


def fiber_id(kind: str, *parts: Column) -> Column:
    """Upper-case SHA-256 of kind and parts joined by a bar."""
    return F.upper(F.sha2(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]), 256))


def child_id(run_id: Column, ordinal: Column) -> Column:
    """First 32 hex digits of SHA-256 over a label, the run and the ordinal, a line each; never all zero."""
    h = F.substring(F.sha2(F.concat(F.lit("wflog-dag-child-v1\n"), run_id.cast("string"), F.lit("\n"), ordinal.cast("string"), F.lit("\n")), 256), 1, 32)
    return F.when(h == "0" * 32, F.lit("0" * 31 + "1")).otherwise(h)


def backoff_seconds(attempt: Column, initial: float = 1.0, most: float = 60.0) -> Column:
    """Doubling from ``initial`` with each attempt, ``most`` at last."""
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def render_tags(tags: Column) -> Column:
    """`k=v, k=v` sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")


def canonical_location(path: Column) -> Column:
    """Compiler path -> canonical location.

    It begins with ``workflow:$``, which stands for the first token whatever it is, and is all of it for null, empty and ``root``. Then ``then`` and
    ``else`` become ``if:true`` and ``if:false``, ``body``, ``lease`` and ``item`` the bodies of a loop, a lease and a for-each, ``branches/k`` ``parallel:k`` and numbers
    ``n:k``, k in 8 digits. Other tokens are dropped, as is ``branches`` before anything but a number.
    """
    words = {"then": "if:true", "else": "if:false", "body": "while:body", "lease": "lease:body", "item": "foreach:body"}
    tokens = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    behind = F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))

    def step(acc, x):
        digits = x.rlike("^[0-9]+$")
        number = F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 8, "0")
        word = F.when(digits, F.concat(F.when(acc["held"], "parallel:").otherwise("n:"), number))
        for k, v in words.items():
            word = word.when(x == k, v)
        return F.struct(F.when(word.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(word))).alias("out"), (x == "branches").alias("held"))

    start = F.struct(F.array(F.lit("workflow:$")).alias("out"), F.lit(False).alias("held"))
    return F.array_join(F.aggregate(behind, start, step, lambda acc: acc["out"]), "/")
