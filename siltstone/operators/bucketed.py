"""Documents, chunks and points in tables of which a change rewrites only a part.

Each table is partitioned by ``part``, a hash of the document's id, and bucketed
by that id within. New rows are joined with the buckets where they lie, so the
stored side is never shuffled, and only the parts that changed documents fall
into are written again, by Spark's dynamic partition overwrite. Points are
written first, then chunks, then documents: a run that stops between leaves
documents that the next run takes for changed, and does again.

While parts are rewritten a marker names them. A run that finds one of a run
that stopped takes all documents of these parts for changed.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import checkpointed, counted
from siltstone.operators import chunks as C
from siltstone.operators import index as I
from siltstone.operators import maintenance as M

# Columns by table; the first is the document's id.
TABLES = {
    "documents": "id string, source string, source_id string, url string, title string, body string, body_hash string, chunker_version string, metadata map<string,string>",
    "chunks": "document_id string, id string, chunk_index int, chunk_type string, title string, text string, text_hash string, metadata map<string,string>, point_id string",
    "points": "document_id string, point_id string, embedding array<float>",
}


class DocumentTables:
    """The three tables in one folder."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64, buckets: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.parts, self.buckets = parts, buckets
        fs, p = self._fs("_layout")
        if fs.exists(p):
            self.parts, self.buckets = json.loads(self._text(p))
        else:
            self._put("_layout", json.dumps([parts, buckets]))
        for table, spec in TABLES.items():
            key = spec.split()[0]
            place = f"{self.root}/{table}".replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({spec}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def _name(self, table: str) -> str:
        return f"siltstone_{table}_{hashlib.md5(self.root.encode()).hexdigest()[:12]}"

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, p) -> str:
        stream = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        fs, p = self._fs(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, table: str) -> DataFrame:
        self.spark.catalog.refreshTable(self._name(table))
        return self.spark.table(self._name(table))

    def part_of(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def unfinished(self) -> list[int]:
        """Parts that a run which stopped was rewriting."""
        fs, p = self._fs("_pending")
        files = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted({n for f in files for n in json.loads(self._text(f) or "[]")})

    def replaced(self, table: str, ids: DataFrame, rows: DataFrame, touched: list[int]) -> None:
        """The rows of the documents ``id`` of a table replaced by others; only the touched parts are read and written."""
        key = TABLES[table].split()[0]
        old = self.read(table).where(F.col("part").isin(touched))
        kept = old.join(ids.select(F.col("id").alias(key)).hint("merge"), key, "left_anti")
        new = kept.unionByName(rows.select(*[c for c in old.columns if c != "part"]).withColumn("part", self.part_of(key)))
        new, seen = counted(new.select(*old.columns), parts=F.collect_set("part"))  # the parts are read to their end before any is replaced
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.repartition("part").write.insertInto(self._name(table), overwrite=True)
        finally:
            self.spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        left = seen["parts"] or []
        for n in set(touched).difference(left):  # no row is left that would replace the part
            fs, p = self._fs(f"{table}/part={n}")
            fs.delete(p, True)
        self.spark.catalog.refreshTable(self._name(table))

    def changed(self, incoming: DataFrame) -> DataFrame:
        """Incoming documents that differ from the stored ones in body, link or chunker version, or lie in parts whose rewriting stopped."""
        broken = self.unfinished()
        stored = self.read("documents").select("id", F.col("body_hash").alias("_hash"), F.col("url").alias("_url"), F.col("chunker_version").alias("_version"), "part")
        both = incoming.hint("merge").join(stored, "id", "left")
        same = F.col("_hash").eqNullSafe(F.col("body_hash")) & F.col("_url").eqNullSafe(F.col("url")) & F.col("_version").eqNullSafe(F.col("chunker_version")) & F.col("part").isNotNull()
        return both.where(~same | self.part_of("id").isin(broken)).select(*incoming.columns)

    def _apply(self, changes: dict[str, DataFrame], ids: DataFrame) -> int:
        touched = [r[0] for r in ids.select(self.part_of("id")).distinct().collect()]  # a row for each part
        touched = sorted({*touched, *self.unfinished()})
        marker = f"_pending/{uuid.uuid4().hex}"
        old, p = self._fs("_pending")
        before = [x.getPath() for x in old.listStatus(p)] if old.exists(p) else []
        self._put(marker, json.dumps(touched))
        for table in ("points", "chunks", "documents"):
            self.replaced(table, ids, changes[table], touched)
        for done in [self._fs(marker)[1], *before]:
            old.delete(done, False)
        return len(touched)

    def ingest(self, incoming: DataFrame, kind: str, embed=M.hashed_embedding, chunker=None) -> dict[str, int]:
        """Index documents ``id, source, source_id, url, title, body, body_hash, metadata``; a second run writes nothing.

        ``id`` must follow from source and source id (``stable_id``). Vectors of
        chunks whose hash is known are kept; only others are embedded. Of rows
        with one natural key the last by all columns counts.
        """
        incoming = I.one_for_each(incoming, ["source", "source_id"]).withColumn("chunker_version", F.lit(C.VERSIONS.get(kind, C.CHUNKER_VERSION)))
        changed, seen = counted(self.changed(incoming), n=F.count("*"), parts=F.collect_set(self.part_of("id")))
        n, touched = seen["n"], sorted(seen["parts"] or [])
        if not n:
            return {"documents": 0, "embedded": 0, "reused": 0, "stale": 0, "parts": 0}
        ids = changed.select("id")
        made = checkpointed(C.finished(chunker(changed) if chunker else C.chunked(changed, kind), changed))
        mine = lambda t: self.read(t).where(F.col("part").isin(touched)).join(ids.select(F.col("id").alias("document_id")).hint("merge"), "document_id", "left_semi").drop("part")
        old = mine("chunks").where("point_id is not null").join(mine("points").select("document_id", "point_id", "embedding"), ["document_id", "point_id"]).select("document_id", "chunk_index", "text_hash", "point_id", "embedding")
        old = checkpointed(old.dropDuplicates(["document_id", "chunk_index", "text_hash"]))
        stale = mine("chunks").join(made.select("document_id", "chunk_index", "text_hash"), ["document_id", "chunk_index", "text_hash"], "left_anti").count()
        known = F.col("point_id").isNotNull()
        both, counts = counted(made.join(old, ["document_id", "chunk_index", "text_hash"], "left"), embedded=F.count_if(~known), reused=F.count_if(known))
        known = both.where("point_id is not null").select("document_id", "point_id", "embedding")
        fresh = both.where("point_id is null").select("document_id", F.col("id").alias("point_id"), embed("text").alias("embedding"))
        chunks = both.withColumn("point_id", F.coalesce("point_id", "id")).drop("embedding")
        parts = self._apply({"points": known.unionByName(fresh), "chunks": chunks, "documents": changed}, ids)
        return {"documents": n, "embedded": counts["embedded"], "reused": counts["reused"], "stale": stale, "parts": parts}

    def remove(self, ids: DataFrame) -> int:
        """Take documents ``id`` out of all tables; returns how many parts were rewritten."""
        ids = checkpointed(ids.select("id").distinct())
        none = {t: self.read(t).drop("part").limit(0) for t in TABLES}
        return self._apply(none, ids) if not ids.isEmpty() else 0

    def prune(self, walked: DataFrame, source: str, limited: bool = False) -> int:
        """Take out a source's documents that a full walk (``source_id``) no longer found; a limited walk prunes nothing."""
        if limited:
            return 0
        gone = self.read("documents").where(F.col("source") == source).join(walked.select("source_id").distinct(), "source_id", "left_anti")
        return self.remove(gone.select("id"))
