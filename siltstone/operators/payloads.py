"""Payloads of vectors: what a point carries of its chunk, and back.

A payload is a JSON object in a string column. Lists, objects and nulls of the
metadata don't become values; their keys are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: a chunk's own fields in a payload.
OWN = ("chunk_id", "document_id", "chunk_type", "title", "text_hash")
_SCALAR = r'^\s*(?:"|-?[0-9]|true|false)'


def _fields(payload) -> Column:
    """The top-level fields of a JSON object as raw JSON by key."""
    return F.from_json(payload, "map<string,string>")


def to_payload(chunks: DataFrame) -> DataFrame:
    """Chunks ``id, document_id, chunk_type, title, text_hash, metadata`` (JSON) with ``payload`` (values by key, as strings) and ``dropped`` (keys whose values are lists or objects).

    A key of the metadata replaces a chunk's own field of that name.
    """
    said = _fields("metadata")
    kinds = F.transform(F.coalesce(F.json_object_keys("metadata"), F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.substring(F.ltrim(said[k]), 1, 1).isin("[", "{").alias("nested")))
    dropped = F.array_sort(F.transform(F.filter(kinds, lambda x: x["nested"]), lambda x: x["key"]))
    rows = chunks.withColumn("_said", F.coalesce(said, F.create_map().cast("map<string,string>"))).withColumn("dropped", dropped)
    kept = F.map_filter("_said", lambda k, v: ~F.array_contains("dropped", k))
    own = F.map_from_arrays(F.array(*(F.lit(k) for k in OWN)), F.array(F.col("id").cast("string"), F.col("document_id").cast("string"), "chunk_type", "title", "text_hash"))
    own = F.map_filter(own, lambda k, _: ~F.map_contains_key(kept, k))
    return rows.withColumn("payload", F.map_concat(own, kept)).drop("_said")


def from_payload(points: DataFrame) -> DataFrame:
    """Chunks of points with ``payload``: the five own fields as columns, all others as metadata."""
    p = F.col("payload")
    own = F.array(*(F.lit(k) for k in OWN))
    return points.select(
        p["chunk_id"].alias("id"), p["document_id"].alias("document_id"), *(F.coalesce(p[k], F.lit("")).alias(k) for k in OWN[2:]),
        F.map_filter(p, lambda k, _: ~F.array_contains(own, k)).alias("metadata"),
    )


VERSION = 1


def decoded_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of index jobs ``id, payload``; jobs put aside for their version). The payload's version is looked at before anything else of it."""
    spec = "version int, kind string, document struct<id:string,source:string,source_id:string,url:string,title:string,body:string,body_hash:string,metadata:map<string,string>,created_at:timestamp,updated_at:timestamp>"
    version = F.get_json_object("payload", "$.version").cast("int")
    good = jobs.where(version.eqNullSafe(F.lit(VERSION))).select("id", F.from_json("payload", spec).alias("p"))
    return good.select(F.col("id").alias("job_id"), "p.kind", "p.document.*"), jobs.where(~version.eqNullSafe(F.lit(VERSION)))


def encoded_documents(docs: DataFrame, kind: str) -> DataFrame:
    """Documents as index jobs' payloads."""
    names = ("id", "source", "source_id", "url", "title", "body", "body_hash", "metadata", "created_at", "updated_at")
    doc = F.struct(*(F.col(n) if n in docs.columns else F.lit(None).cast("string").alias(n) for n in names))
    return docs.select("id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(kind).alias("kind"), doc.alias("document"))).alias("payload"))
