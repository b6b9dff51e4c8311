"""Ingest of one source: changed documents, chunks, plan, vectors, snapshots."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lineage import counted
from siltstone.operators import chunks as C
from siltstone.operators import index as I
from siltstone.operators import maintenance as M


def ingest(store: I.Snapshots, incoming: DataFrame, kind: str, embed=M.hashed_embedding, chunker=None, phases: dict[str, float] | None = None) -> dict[str, int]:
    """Index documents ``id, source, source_id, url, title, body, body_hash, metadata``; a second run changes nothing.

    Of rows with one natural key (source and source_id) the last by all columns counts.
    Vectors are made before any table is replaced, and all tables change in one
    commit, so a chunk never refers to a vector that isn't there. Counts are
    taken while rows are written, by no job of their own; ``phases`` receives
    the seconds that finding changes, planning chunks and writing took.
    """
    spark = incoming.sparkSession
    began = time.monotonic()

    def over(phase: str) -> None:
        nonlocal began
        now = time.monotonic()
        if phases is not None:
            phases[phase] = now - began
        began = now

    incoming = I.one_for_each(incoming, ["source", "source_id"])
    incoming = incoming.withColumn("chunker_version", F.lit(C.VERSIONS.get(kind, C.CHUNKER_VERSION)))
    docs, old, points = store.read("documents"), store.read("chunks"), store.read("points")
    empty = docs is None
    docs = incoming.limit(0) if empty else docs
    old = spark.createDataFrame([], "id string, document_id string, chunk_index int, chunk_type string, title string, text string, text_hash string, metadata map<string,string>, point_id string") if old is None else old
    points = spark.createDataFrame([], "point_id string, embedding array<float>") if points is None else points
    changed, seen = counted(I.changed_documents(incoming, docs), n=F.count("*"))
    over("changes")
    if not seen["n"]:
        return {"documents": 0, "embedded": 0, "reused": 0, "stale": 0}
    made = C.finished((chunker(changed) if chunker else C.chunked(changed, kind)), changed)
    # Documents that lost all their chunks are planned too.
    gone = changed.select(F.col("id").alias("document_id"))
    plan = I.chunk_plan(made, old).unionByName(
        old.join(gone, "document_id", "left_semi").join(made.select("document_id").distinct(), "document_id", "left_anti")
        .select("document_id", "chunk_index", "text_hash", "point_id", F.lit("stale").alias("action"))
    )
    plan, counts = counted(plan, **{a: F.count_if(F.col("action") == a) for a in ("embed", "reuse", "stale")})
    over("plan")
    key = ["document_id", "chunk_index", "text_hash"]
    todo = made.join(plan.where("action = 'embed'").select(*key), key, "left_semi")
    fresh = todo.select(F.col("id").alias("point_id"), embed("text").alias("embedding"))
    dead = plan.where("action = 'stale' and point_id is not null").select("point_id")
    kept = points.join(dead, "point_id", "left_anti").join(fresh.select("point_id"), "point_id", "left_anti")
    new_chunks = I.upserted(I.without_stale(old, plan), made.withColumn("point_id", F.col("id")).select(*old.columns), key)
    store.commit({"points": kept.unionByName(fresh), "chunks": new_chunks, "documents": changed if empty else I.upserted(docs, changed, ["source", "source_id"])})
    over("write")
    return {"documents": seen["n"], "embedded": counts["embed"], "reused": counts["reuse"], "stale": counts["stale"]}
