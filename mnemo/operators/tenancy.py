"""Who sees what: grants on scopes, aliases of entities, policies of keys."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions.text import name_key

READS, PROMOTES = ("read", "write", "promote", "admin"), ("promote", "admin")
CAPABILITIES = READS


def checked(capability: str) -> str:
    if capability not in CAPABILITIES:
        raise ValueError(f"unknown capability {capability!r}")
    return capability


def visible(acl: DataFrame, principals: DataFrame) -> DataFrame:
    """principal, scope and place: own scope (own_scope of principals) first, then those granted, each once."""
    own = principals.select("principal", F.col("own_scope").alias("scope"), F.lit(0).alias("source"), F.lit(0).cast("long").alias("at"))
    given = acl.where(F.col("capability").isin(*READS)).join(principals.select("principal"), "principal", "left_semi").select("principal", "scope", F.lit(1).alias("source"), F.col("created_at").cast("long").alias("at"))
    first = own.unionByName(given).groupBy("principal", "scope").agg(F.min(F.struct("source", "at", "scope")).alias("k"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("principal").orderBy("k"))).drop("k")


def can(acl: DataFrame, principal: str, scope: str, own_scope: str, capabilities: tuple[str, ...]) -> bool:
    """Whether a principal has one of the capabilities on a scope; all on its own."""
    return scope == own_scope or bool(acl.where((F.col("principal") == principal) & (F.col("scope") == scope) & F.col("capability").isin(*capabilities)).limit(1).count())


def resolved(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (container_tag, name) with canonical: the newest alias's target, or the name itself."""
    newest = aliases.groupBy("container_tag", name_key(F.col("alias")).alias("_key")).agg(F.max_by("canonical", F.struct("created_at", "canonical")).alias("_canonical"))
    return names.withColumn("_key", name_key(F.col("name"))).join(newest, ["container_tag", "_key"], "left").withColumn("canonical", F.coalesce("_canonical", "name")).drop("_key", "_canonical")


def keys_of(spec: str) -> dict[str, list[str] | None]:
    """Namespaces by key of a spec 'key=tag1,tag2; other=*' (None: any); keys without one are dropped."""
    out: dict[str, list[str] | None] = {}
    for part in spec.split(";"):
        key, _, tags = part.strip().partition("=")
        names = [t.strip() for t in tags.split(",") if t.strip()]
        if key.strip() and names:
            out[key.strip()] = None if "*" in names else names
    return out


def allowed(keys: dict[str, list[str] | None], presented: str, tag: str | None, default: str = "default") -> str | None:
    """The namespace a request may use: the one asked for if its key allows it, else the key's first; None if refused."""
    found = [tags for key, tags in keys.items() if hmac.compare_digest(key.encode(), presented.encode())]
    if not found:
        return None
    if found[0] is None:
        return tag or default
    return found[0][0] if tag is None else tag if tag in found[0] else None
