"""A stored term index of chunks that is kept up to date.

The index is a folder of generations. Each one holds the postings of the chunks
that were added or changed then, in files bucketed and sorted by term, what
ranking needs of these chunks, bucketed by id, and the ids that it takes out of
older generations. A search joins the terms of its queries with the buckets
where they lie, so nothing stored is shuffled: only hits are. ``compact`` writes
all that is live as one new generation, from which readers start anew.

A generation counts once its marker is written, so a writer that stops leaves
the index as it was. There must be one writer at a time: the marker is created,
never replaced, and a second writer of the same generation fails.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.lineage import checkpointed
from siltstone.operators import retrieval as R

#: Generations over which ``add`` compacts.
MOST_GENERATIONS = 8
#: Bytes of stored chunks for each bucket of a generation, at most.
BUCKET = 16 * 1024 * 1024


class TermIndex:
    """The index of one folder, for chunks ``id, title, text, metadata`` (and ``text_hash``, if they have it).

    A generation has at least ``buckets`` buckets, and more as its chunks take
    more than ``BUCKET`` for each, so no task sorts more than its share.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        marks = self._marks()
        self.buckets = min(m["buckets"] for m in marks.values()) if marks else buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _marks(self) -> dict[int, dict]:
        """What the markers of complete generations say."""
        fs, p = self._fs(f"{self.root}/_complete")
        out = {}
        for x in fs.listStatus(p) if fs.exists(p) else []:
            stream = fs.open(x.getPath())
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                out[int(x.getPath().getName())] = json.loads(text)
        return out

    def generations(self) -> list[int]:
        """The complete generations from the last compaction on."""
        marks = self._marks()
        base = max((g for g, m in marks.items() if m["base"]), default=0)
        return sorted(g for g in marks if g >= base)

    def _table(self, generation: int, part: str) -> DataFrame:
        """A part of a generation, with its buckets known to the planner."""
        whole = self._marks()[generation]
        mark = whole["parts"][part]
        if not mark["by"]:
            return self.spark.read.schema(mark["schema"]).parquet(f"{self.root}/{generation:06d}/{part}")
        name = f"siltstone_{part}_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{generation}"
        by = f"CLUSTERED BY ({mark['by']}) SORTED BY ({mark['by']}) INTO {whole['buckets']} BUCKETS"
        place = f"{self.root}/{generation:06d}/{part}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({mark['schema']}) USING parquet {by} LOCATION '{place}'")
        return self.spark.table(name)

    def _write(self, parts: dict[str, tuple[DataFrame, str | None]], base: bool, buckets: int) -> int:
        marks = self._marks()
        g = max(marks, default=0) + 1
        told = {}
        for part, (df, by) in parts.items():
            place = f"{self.root}/{g:06d}/{part}"
            told[part] = {"by": by, "schema": ", ".join(f"`{n}` {t}" for n, t in df.dtypes)}
            if by:  # hash partitioning is the buckets' own, so a bucket is one file
                name = f"siltstone_{part}_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{g}"
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", place).mode("overwrite").saveAsTable(name)
            else:
                df.write.mode("overwrite").parquet(place)
        fs, p = self._fs(f"{self.root}/_complete/{g:06d}")
        out = fs.create(p, False)
        out.write(bytearray((json.dumps({"base": base, "buckets": buckets, "parts": told}) + "\n").encode()))
        out.close()
        return g

    def add(self, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """Index new and changed chunks, and take out the ids of ``gone``; returns the generation.

        Of rows that repeat an id the last by all columns counts. Only the given
        chunks are read and written, until there are ``MOST_GENERATIONS``.
        """
        from siltstone.operators.index import one_for_each

        chunks = checkpointed(one_for_each(chunks.where("id is not null"), ["id"]))  # read for each part
        buckets = max(self.buckets, -(-(R.estimated(chunks) or 0) // BUCKET))
        out = chunks.select("id") if gone is None else chunks.select("id").unionByName(gone.select("id").where("id is not null")).distinct()
        first = not self.generations()
        g = self._write({"postings": (R.postings(chunks), "term"), "known": (R.haystacks(chunks), "id"), "gone": (out.limit(0) if first else out, None)}, first, buckets)
        return self.compact() if len(self.generations()) > MOST_GENERATIONS else g

    def _gone(self, after: int) -> DataFrame | None:
        """Ids that generations after this one have taken out."""
        later = [self._table(g, "gone") for g in self.generations() if g > after]
        return reduce(DataFrame.unionByName, later).distinct() if later else None

    def _live(self, g: int, rows: DataFrame) -> DataFrame:
        gone = self._gone(g)
        return rows if gone is None else rows.join(R.small(gone), "id", "left_anti")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """Live postings ``term, id, tf_title, tf_text``, of the given terms or of all."""
        out = []
        for g in self.generations():
            rows = self._table(g, "postings")
            if terms is not None:
                rows = rows.join(R.small(terms.select("term").distinct()), "term", "left_semi")
            out.append(self._live(g, rows))
        return reduce(DataFrame.unionByName, out)

    def haystacks(self) -> DataFrame:
        """``id, metadata, _hay, _key`` of all live chunks."""
        return reduce(DataFrame.unionByName, [self._live(g, self._table(g, "known")) for g in self.generations()])

    def known(self, lists: DataFrame) -> DataFrame:
        """A table of ids with what ranking needs of their chunks; each generation is joined where its buckets lie."""
        found, marks = self.generations(), self._marks()
        dealt = lambda g: lists.repartition(marks[g]["buckets"], "id")
        if len(found) == 1:
            return dealt(found[0]).join(self._table(found[0], "known").hint("merge"), "id", "left")
        lists = checkpointed(lists)
        met = reduce(DataFrame.unionByName, [self._live(g, dealt(g).join(self._table(g, "known").hint("merge"), "id")) for g in found])
        none = self._table(found[0], "known").limit(0)
        rest = lists.join(met.select("id"), "id", "left_anti").join(none, "id", "left")
        return met.unionByName(rest)

    def total(self) -> DataFrame:
        """One row: the number of live chunks ``n``."""
        return self.haystacks().agg(F.count("*").alias("n"))

    def compact(self) -> int:
        """Write all that is live as one generation."""
        found, marks = self.generations(), self._marks()
        empty = self._table(found[0], "gone").limit(0)
        buckets = sum(marks[g]["buckets"] for g in found)
        return self._write({"postings": (self.postings(), "term"), "known": (self.haystacks(), "id"), "gone": (empty, None)}, True, buckets)

    def vacuum(self) -> int:
        """Delete generations that the last compaction replaced, and those that were never completed; returns how many. Not while one is being written."""
        live, n = set(self.generations()), 0
        fs, p = self._fs(self.root)
        for x in fs.listStatus(p) if fs.exists(p) else []:
            name = x.getPath().getName()
            if name.isdigit() and int(name) not in live:
                fs.delete(self._fs(f"{self.root}/_complete/{name}")[1], False)
                fs.delete(x.getPath(), True)
                n += 1
        return n
