"""Tenant-bound tables on Parquet: versioned snapshots behind a manifest, row isolation, merge-on-write.

A store is a folder of tables, each with a snapshot folder for each tenant and namespace. A numbered
manifest names the current ones; publishing a change writes new snapshots of what changed and then the
manifest of the next number, so readers see all tables of one version. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash
from graphloom.operators.resolve import merged_json

VERSION = 1
_ID = [("tenant_id", "string"), ("namespace", "string")]


def _schema(*fields: tuple[str, str]) -> dict[str, str]:
    return dict((*fields, *_ID))


def ddl(name: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in SCHEMAS[name].items())


SCHEMAS = {
    "documents": _schema(("document_id", "string"), ("source_id", "string"), ("content_hash", "string"), ("metadata", "string"), ("status", "string"), ("extraction_status", "string"), ("extraction_error", "string"), ("extraction_attempts", "int"), ("updated_at", "timestamp")),
    "chunks": _schema(("chunk_id", "string"), ("document_id", "string"), ("ordinal", "int"), ("content", "string"), ("content_hash", "string"), ("embedding", "array<float>"), ("metadata", "string"), ("status", "string")),
    "extractions": _schema(("content_hash", "string"), ("provider", "string"), ("model", "string"), ("prompt_version", "string"), ("status", "string"), ("result", "array<struct<subject:string,predicate:string,object:string>>"), ("lease_owner", "string"), ("lease_expires_at", "timestamp")),
    "nodes": _schema(("node_id", "string"), ("content", "string"), ("embedding", "array<float>"), ("metadata", "string")),
    "edges": _schema(("edge_id", "string"), ("src", "string"), ("dst", "string"), ("relation", "string"), ("manual", "double"), ("metadata", "string")),
    "entity_mentions": _schema(("chunk_id", "string"), ("node_id", "string")),
    "edge_mentions": _schema(("chunk_id", "string"), ("edge_id", "string")),
    "community_runs": _schema(("run_id", "string"), ("converged", "boolean"), ("passes", "int"), ("node_count", "long"), ("community_count", "long"), ("created_at", "timestamp")),
    "community_memberships": _schema(("run_id", "string"), ("node_id", "string"), ("community_id", "string")),
    "community_summaries": _schema(("run_id", "string"), ("community_id", "string"), ("summary", "string"), ("evidence_hash", "string")),
}
STATUSES = ("pending", "ready", "partial", "failed")


def make_id(*parts: Column) -> Column:
    """A deterministic id of a natural key."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


class Store:
    """The tables of all tenants; hand out a ``TenantSession`` to read or write."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: int = 3600):
        self.spark, self.root, self.lease_seconds = spark, root.rstrip("/"), lease_seconds
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, dimension: int) -> Store:
        """Makes an empty store, or checks that this one has the wanted vector width."""
        if not 1 <= dimension <= 16000:
            raise ValueError("vector width must be between 1 and 16000")
        if self._numbers():
            self.preflight(dimension)
            return self
        self._fs.mkdirs(self._path("manifests"))
        self._put(1, {"version": VERSION, "dimension": dimension, "tables": {}, "dirty": []})
        return self

    def preflight(self, dimension: int) -> None:
        """Raises where a provider's vector width is not the store's: before any text is sent to it."""
        if self.manifest()["dimension"] != dimension:
            raise ValueError(f"the store holds vectors of width {self.manifest()['dimension']}, not {dimension}")

    def _numbers(self) -> list[int]:
        """Of the manifests that are there."""
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The manifest of highest number. Manifests are never changed, so a reader always finds a whole one."""
        return json.loads(self._text(f"manifests/{self._numbers()[-1]:012d}.json"))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def status(self) -> dict:
        """Whether the store is there and of this version, with its vector width."""
        if not self._numbers():
            return {"ready": False, "dimension": None, "version": None}
        m = self.manifest()
        return {"ready": m["version"] == VERSION, "dimension": m["dimension"], "version": m["version"]}

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)  # fails where it is there
        out.write(bytearray(text.encode()))
        out.close()

    def _put(self, number: int, manifest: dict) -> None:
        """Publishes a manifest under its number, which no other may have: written aside, then renamed."""
        fresh, name = f"manifests/{uuid.uuid4().hex}.new", f"manifests/{number:012d}.json"
        self._write(fresh, json.dumps(manifest))
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(fresh), self._path(name)):
            self._fs.delete(self._path(fresh), False)
            raise RuntimeError(f"manifest {number} is there already: another writer was faster")

    def locked(self, body: Callable[[], None]) -> None:
        """Runs ``body`` while this driver alone holds the store's lock, a file with owner and expiry.

        A lock that has expired belongs to a dead writer and is taken over; if that one does live on, its
        manifest has a number that is taken, and fails.
        """
        owner = uuid.uuid4().hex
        if not self._lock(owner):
            held = json.loads(self._text("writer.lock") or "{}")
            if held.get("expires", 0) > time.time():
                raise RuntimeError("another writer holds the store")
            self._fs.delete(self._path("writer.lock"), False)
            if not self._lock(owner):
                raise RuntimeError("another writer took the store over")
        try:
            body()
        finally:
            if json.loads(self._text("writer.lock") or "{}").get("owner") == owner:
                self._fs.delete(self._path("writer.lock"), False)

    def _lock(self, owner: str) -> bool:
        if self._fs.exists(self._path("writer.lock")):
            return False
        try:
            self._write("writer.lock", json.dumps({"owner": owner, "expires": time.time() + self.lease_seconds}))
        except Exception:  # someone else was faster
            return False
        return True

    def read(self, name: str, tenant_id: str | None = None, namespace: str | None = None) -> DataFrame:
        """The rows of a table: of all, or of the partitions of a tenant or of one of its namespaces alone."""
        parts = {tuple(json.loads(k)): at for k, at in self.manifest()["tables"].get(name, {}).items()}
        paths = [f"{self.root}/{at}" for (t, n), at in sorted(parts.items()) if tenant_id in (None, t) and namespace in (None, n)]
        schema = ddl(name)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], key: tuple[str, str], dirty: bool = False, clean: bool = False) -> None:
        """New snapshots of the partition ``key`` (tenant, namespace) of ``tables``, all visible at once; the others stay."""

        def write() -> None:
            last = self._numbers()[-1]
            manifest = self.manifest()
            for name, df in tables.items():
                at = f"{name}/{uuid.uuid4().hex}"
                df.select(*SCHEMAS[name]).write.parquet(f"{self.root}/{at}")
                manifest["tables"].setdefault(name, {})[json.dumps(key)] = at
            marked = {tuple(x) for x in manifest["dirty"]} - ({key} if clean else set()) | ({key} if dirty else set())
            self._put(last + 1, manifest | {"dirty": sorted(marked)})

        self.locked(write)

    def tenant(self, tenant_id: str | None) -> TenantSession:
        return TenantSession(self, tenant_id)


class TenantSession:
    """Reads and writes of one tenant. Without a tenant every scan is empty; rows of others can't be written."""

    def __init__(self, store: Store, tenant_id: str | None):
        self.store, self.tenant_id = store, tenant_id

    def scan(self, name: str, namespace: str | None = None) -> DataFrame:
        """The tenant's rows, from its own partitions only; of one namespace if given."""
        if self.tenant_id is None:
            return self.store.spark.createDataFrame([], ddl(name))
        return self.store.read(name, self.tenant_id, namespace)

    def write(self, tables: dict[str, DataFrame], namespace: str, dirty: bool = True, clean: bool = False) -> None:
        """Replaces the tenant's rows of the namespace in each table; all other partitions are left as they are."""
        if self.tenant_id is None:
            raise PermissionError("no tenant is bound")
        if not 0 < len(namespace) <= 255:
            raise ValueError("a namespace has 1 to 255 characters")
        own = {name: df.withColumn("tenant_id", F.lit(self.tenant_id)).withColumn("namespace", F.lit(namespace)) for name, df in tables.items()}
        self.store.publish(own, (self.tenant_id, namespace), dirty and not clean, clean)

    def dirty(self, namespace: str) -> bool:
        """Whether the namespace's graph has changed since its communities were found."""
        return [self.tenant_id, namespace] in self.store.manifest()["dirty"]


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` documents with ``new`` ones (``document_id``, ``source_id``, ``content_hash``, ``metadata``) merged in.

    Metadata is merged field by field; new content sets the extraction back to pending. ``content_changed``
    tells new and changed documents apart from the rest.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.document_id") == F.col("n.document_id"), "full_outer")
    changed = F.col("n.document_id").isNotNull() & ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return both.select(
        pick("document_id"), pick("source_id"), pick("content_hash"),
        F.when(F.col("n.document_id").isNull(), F.col("o.metadata")).when(F.col("o.document_id").isNull(), F.col("n.metadata")).otherwise(merged_json(F.col("o.metadata"), F.col("n.metadata"))).alias("metadata"),
        F.coalesce("o.status", F.lit("active")).alias("status"),
        F.when(changed, "pending").otherwise(F.col("o.extraction_status")).alias("extraction_status"),
        F.when(~changed, F.col("o.extraction_error")).alias("extraction_error"),
        F.when(changed, F.lit(0)).otherwise(F.col("o.extraction_attempts")).alias("extraction_attempts"),
        F.coalesce("o.updated_at", F.current_timestamp()).alias("updated_at"), changed.alias("content_changed"),
    )


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` replaced by theirs."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Documents, their chunks and those chunks' mentions without ``gone`` (``document_id``). Nodes stay; edges
    that lose all support vanish with the derived edge view."""
    chunks = tables["chunks"].join(gone, "document_id", "left_semi").select("chunk_id")
    return {
        "documents": tables["documents"].join(gone, "document_id", "left_anti"),
        "chunks": tables["chunks"].join(gone, "document_id", "left_anti"),
        "entity_mentions": tables["entity_mentions"].join(chunks, "chunk_id", "left_anti"),
        "edge_mentions": tables["edge_mentions"].join(chunks, "chunk_id", "left_anti"),
    }


def set_status(documents: DataFrame, document_id: str, status: str, expected_hash: str, error: str | None = None, attempt: bool = False) -> tuple[DataFrame, bool]:
    """``documents`` with one status set if its content is still the expected, and whether it was."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    hit = (F.col("document_id") == document_id) & (F.col("content_hash") == expected_hash)
    if documents.where(hit).isEmpty():
        return documents, False
    out = documents.withColumn("extraction_status", F.when(hit, status).otherwise(F.col("extraction_status"))).withColumn("extraction_error", F.when(hit, F.lit(error)).otherwise(F.col("extraction_error")))
    return out.withColumn("extraction_attempts", F.when(hit, F.col("extraction_attempts") + int(attempt)).otherwise(F.col("extraction_attempts"))), True


#: What identifies an extraction.
EXTRACTION = ["content_hash", "provider", "model", "prompt_version"]


def claim_extractions(state: DataFrame, wanted: DataFrame, owner: str, now: Column, seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """The extractions of ``wanted`` (the columns of ``EXTRACTION``) claimed for ``owner``.

    Returns the new ``state`` and, for each wanted key, its ``outcome``: ``done`` (with the cached ``result``),
    ``in_progress`` where another lease still runs, else ``claimed``: it is new, its lease has expired or
    it was given back.
    """
    s, w = state.alias("s"), wanted.select(*EXTRACTION).distinct().withColumn("_wanted", F.lit(True)).alias("w")
    both = s.join(w, EXTRACTION, "full_outer")
    running = (F.col("status") == "in_progress") & (F.col("lease_expires_at") >= now)
    outcome = F.when(F.col("_wanted").isNull(), F.lit(None)).when(F.col("status") == "done", "done").when(running, "in_progress").otherwise("claimed")
    both = both.withColumn("outcome", outcome)
    mine = F.coalesce(F.col("outcome") == "claimed", F.lit(False))
    after = both.withColumns({
        "status": F.when(mine, "in_progress").otherwise(F.col("status")), "lease_owner": F.when(mine, owner).otherwise(F.col("lease_owner")),
        "lease_expires_at": F.when(mine, now + F.make_dt_interval(secs=F.lit(float(seconds)))).otherwise(F.col("lease_expires_at")),
    })
    return after.select(*state.columns), both.where("outcome is not null").select(*EXTRACTION, "outcome", F.when(F.col("outcome") == "done", F.col("result")).alias("result"))


def finish_extractions(state: DataFrame, results: DataFrame, owner: str) -> DataFrame:
    """``state`` with the ``results`` (``EXTRACTION``, ``ok``, ``result``) of leases that ``owner`` still holds.

    What is ``ok`` is done; what isn't is pending again and can be claimed at once. Of a lease that was
    taken over nothing is written.
    """
    got = results.select(*EXTRACTION, F.col("ok").alias("_ok"), F.col("result").alias("_result"))
    both = state.join(got, EXTRACTION, "left")
    mine = F.coalesce(F.col("_ok").isNotNull() & (F.col("status") == "in_progress") & (F.col("lease_owner") == owner), F.lit(False))
    return both.withColumns({
        "status": F.when(mine, F.when(F.col("_ok"), "done").otherwise("pending")).otherwise(F.col("status")), "result": F.when(mine & F.col("_ok"), F.col("_result")).otherwise(F.col("result")),
        "lease_owner": F.when(~mine, F.col("lease_owner")), "lease_expires_at": F.when(~mine, F.col("lease_expires_at")),
    }).select(*state.columns)


def active(rows: DataFrame) -> DataFrame:
    """The rows that searches see: those of status ``active``, or all where rows have no status."""
    return rows.where("status = 'active'") if "status" in rows.columns else rows


def unfinished(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """Chunks without a finished extraction of their content, by document and ordinal."""
    done = extractions.where("status = 'done'").select("content_hash").distinct()
    return chunks.join(done, "content_hash", "left_anti").orderBy("document_id", "ordinal")


__all__ = ["SCHEMAS", "Store", "TenantSession", "active", "claim_extractions", "content_hash", "finish_extractions", "delete_documents", "make_id", "replace_chunks", "set_status", "unfinished", "upsert_documents"]
