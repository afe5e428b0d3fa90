"""The service's verbs on a warehouse: promote, forget, delete, alias, grant, jobs, audit, export and registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.text import name_key
from mnemo.operators import memory, tenancy
from mnemo.operators import predicates as P
from mnemo.plans import profiles
from mnemo.sources.warehouse import Warehouse

#: States of a job. Fixed values.
JOB_STATES = ("queued", "running", "done", "failed")


class Service:
    """Every change leaves an audit event; every read is of one namespace."""

    def __init__(self, warehouse: Warehouse, actor: str = "system"):
        self.w, self.actor = warehouse, actor

    def _row(self, table: str, **values) -> None:
        kinds = {str: "string", int: "bigint", bool: "boolean", float: "double"}
        kept = {k: v for k, v in values.items() if v is not None}
        self.w.write(table, self.w.spark.createDataFrame([tuple(kept.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in kept.items())))

    def audit(self, tag: str | None, action: str, target: str | None, now: int) -> None:
        self._row("audit_events", id=uuid.uuid4().hex, actor=self.actor, container_tag=tag, action=action, target_id=target, ts=now)

    def audit_list(self, tag: str, limit: int = 100) -> DataFrame:
        return memory.events_of(self.w.current("audit_events"), tag, max(1, min(limit, 1000)))

    # Memories.
    def promote(self, tag: str, id_: str, to: str, now: int) -> str | None:
        """The id of the copy in the shared scope, or None if the namespace has no such memory or the actor may not promote there."""
        if not tenancy.can(self.w.current("acl_entries"), tag, to, tag, tenancy.PROMOTES):
            return None
        new_id = uuid.uuid4().hex
        copy = memory.promoted(self.w.current("memories"), tag, id_, to, new_id, now)
        if not copy.limit(1).count():
            return None
        self.w.insert("memories", copy)
        self.audit(tag, "promote", id_, now)
        return new_id

    def forget(self, tag: str, id_: str, now: int) -> bool:
        """Erases a memory and its evidence from the files, if the namespace owns it."""
        if not self.w.current("memories", "container_tag").where((F.col("id") == id_) & P.in_tag(tag)).limit(1).count():
            return False
        self.w.erase("memories", F.col("id") == id_)
        self.w.erase("memory_evidence", F.col("memory_id") == id_)
        self.audit(tag, "forget", id_, now)
        return True

    def delete_document(self, tag: str, id_: str, now: int) -> bool:
        """Erases a document of the namespace from every table that holds something of it."""
        if not self.w.current("documents", "container_tag").where((F.col("id") == id_) & P.in_tag(tag)).limit(1).count():
            return False
        self.w.erase("documents", F.col("id") == id_)
        for name in ("chunks", "memories", "memory_evidence", "edges"):
            self.w.erase(name, F.col("document_id") == id_)
        profiles.invalidate(self.w, tag)
        self.audit(tag, "delete_document", id_, now)
        return True

    def as_of(self, tag: str, t: int, limit: int = 200) -> DataFrame:
        return memory.as_of(self.w.current("memories"), tag, t, max(1, min(limit, 1000)))

    # Documents.
    def timeline(self, tag: str, before: int | None = None, limit: int = 60, source: str | None = None) -> DataFrame:
        return memory.timeline(self.w.current("documents"), tag, before, max(1, min(limit, 500)), source)

    def text_of(self, document: str) -> DataFrame:
        """The document's chunks in order, set off by blank lines; overlaps are repeated."""
        parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
        return self.w.current("chunks", "document_id", "chunk_index", "content").where(F.col("document_id") == document).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))

    def chunks_of(self, document: str, limit: int | None = None) -> DataFrame:
        """chunk_index and content of a document, in order."""
        found = self.w.current("chunks", "document_id", "chunk_index", "content").where(F.col("document_id") == document).select("chunk_index", "content").orderBy("chunk_index")
        return found if limit is None else found.limit(limit)

    def get(self, table: str, tag: str, id_: str) -> DataFrame:
        """One row of a table, if the namespace owns it."""
        return self.w.current(table).where((F.col("id") == id_) & P.in_tag(tag))

    def memories_of(self, tag: str, limit: int = 1000) -> DataFrame:
        """The namespace's memories, newest first; ties by id, so that a limit is the same at every run."""
        return self.w.current("memories").where(P.in_tag(tag)).orderBy(F.desc("learned_at"), "id").limit(limit)

    def delete_everywhere(self, id_: str, now: int) -> int:
        """Erases a document from every namespace; the number of namespaces that had it."""
        tags = [r[0] for r in self.w.current("documents").where(F.col("id") == id_).select(F.coalesce("container_tag", F.lit(P.DEFAULT_TAG))).distinct().collect()]  # one document's
        if tags:
            self.delete_document(tags[0], id_, now)  # erasure is by id, whatever the namespace
        for tag in tags[1:]:
            profiles.invalidate(self.w, tag)
            self.audit(tag, "delete_document", id_, now)
        return len(tags)

    def export(self, tag: str, limit: int = 100_000) -> dict[str, DataFrame]:
        """All that the namespace owns: documents and memories (newest first, at most limit of each), and what belongs to those."""
        newest = {"documents": "captured_at", "memories": "learned_at"}
        found = {name: self.w.current(name).where(P.in_tag(tag)).orderBy(F.desc(at), "id").limit(limit) for name, at in newest.items()}
        found["memory_evidence"] = self.w.current("memory_evidence").join(found["memories"].select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        return found | {name: self.w.current(name).where(P.in_tag(tag)) for name in ("edges", "entity_aliases")}

    # Tenancy.
    def alias(self, tag: str, alias: str, canonical: str, now: int) -> None:
        if not alias.strip() or not canonical.strip():
            raise ValueError("an alias and its target need a name")
        key = self.w.spark.range(1).select(name_key(F.lit(alias))).first()[0]
        self._row("entity_aliases", id=f"{tag}/{key}", container_tag=tag, alias=alias, canonical=canonical, created_at=now)

    def aliases(self, tag: str) -> DataFrame:
        return self.w.current("entity_aliases").where(F.col("container_tag") == tag).select("alias", "canonical").orderBy("alias")

    def resolve(self, tag: str, name: str) -> str:
        names = self.w.spark.createDataFrame([(tag, name)], "container_tag string, name string")
        return tenancy.resolved(names, self.w.current("entity_aliases")).first()["canonical"]

    def grant(self, principal: str, scope: str, capability: str, now: int) -> None:
        self._row("acl_entries", id=f"{principal}/{scope}/{tenancy.checked(capability)}", principal=principal, scope=scope, capability=capability, created_at=now)
        self.audit(scope, "grant", principal, now)

    def revoke(self, principal: str, scope: str, capability: str, now: int) -> None:
        self.w.write("acl_entries", self.w.current("acl_entries").where(F.col("id") == f"{principal}/{scope}/{tenancy.checked(capability)}"), deleted=True)
        self.audit(scope, "revoke", principal, now)

    def grants(self, scope: str) -> DataFrame:
        """principal and capability of each grant on a scope."""
        return self.w.current("acl_entries").where(F.col("scope") == scope).select("principal", "capability").orderBy("principal", "capability")

    def may_administer(self, principal: str, scope: str) -> bool:
        return tenancy.can(self.w.current("acl_entries"), principal, scope, principal, ("admin",))

    def scopes(self, principal: str) -> list[str]:
        me = self.w.spark.createDataFrame([(principal, principal)], "principal string, own_scope string")
        return [r.scope for r in tenancy.visible(self.w.current("acl_entries"), me).orderBy("place").collect()]  # one principal's grants

    # Jobs.
    def job(self, kind: str, now: int, tag: str | None = None, total: int | None = None) -> str:
        id_ = uuid.uuid4().hex
        self._row("jobs", id=id_, container_tag=tag, kind=kind, state="queued", progress=0, total=total, created_at=now, updated_at=now)
        return id_

    def job_update(self, id_: str, state: str, progress: int, now: int, error: str | None = None) -> None:
        if state not in JOB_STATES:
            raise ValueError(f"unknown state {state!r}")
        self.w.update("jobs", F.col("id") == id_, state=F.lit(state), progress=F.lit(progress), updated_at=F.lit(now), error=F.lit(error))

    def job_get(self, id_: str) -> DataFrame:
        return self.w.current("jobs").where(F.col("id") == id_)
