"""Files, commits and tags of checkouts as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions import text as T
from siltstone.functions.lineage import checkpointed
from siltstone.functions.scoring import stable_id

# What a file becomes, and how far it is trusted.
KIND_SOURCE = {"doc": "git_docs:", "manifest": "git_manifest:", "code": "git_code:"}
KIND_AUTHORITY = {"doc": "high", "manifest": "medium", "code": "low"}


def _by(kind: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below the root, ``content`` and ``modified_at`` of every file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.col("path"), "^(?:[a-zA-Z][\\w+.-]*:)?(?://[^/]*)?" + literal(base) + "/", "")
    return raw.select(path.alias("path"), "content", F.col("modificationTime").alias("modified_at"))


def literal(s: str) -> str:
    """A string as a literal Java pattern."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def classified(files: DataFrame, include=(), exclude=(), manifests: bool = True, code: bool = True, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """Files with their ``kind`` and ``outcome``: indexed, or why they are left out."""
    kind = P.file_kind("path", manifests, code)
    body = F.col("content").cast("string")
    outcome = (
        F.when(P.in_skipped_dir("path"), "skipped_dir")
        .when(kind.isNull(), "unknown_kind")
        .when(~P.selected_path("path", include, exclude), "excluded")
        .when(F.octet_length("content") > max_bytes, "too_large")
        .when(~F.is_valid_utf8(body), "not_text")
        .when((kind == "code") & P.generated_code(body), "generated")
        .when((kind == "manifest") & P.rendered_chart(body), "rendered")
        .otherwise("indexed")
    )
    return files.select("*", kind.alias("kind"), outcome.alias("outcome"))


def outcomes(files: DataFrame) -> DataFrame:
    """How many files of each repository ended how."""
    return files.groupBy("repo", "outcome").agg(F.count("*").alias("n"))


def repository_documents(files: DataFrame, base_url: str = "") -> DataFrame:
    """Documents of the indexed files of a repository; files: ``repo, path, kind, outcome, content``."""
    body = F.col("content").cast("string")
    title = F.when(F.col("kind") == "doc", T.first_heading(body, F.col("path"))).otherwise(F.col("path"))
    url = F.when(F.lit(base_url) != "", F.concat(F.lit(base_url.rstrip("/") + "/"), "path")).otherwise("")
    source = F.concat(_by(F.col("kind"), KIND_SOURCE), "repo")
    source_id = F.concat_ws(":", "repo", "path")
    meta = F.create_map(F.lit("path"), F.col("path"), F.lit("repo"), F.col("repo"), F.lit("lang"), T.language_of("path"), F.lit("authority"), _by(F.col("kind"), KIND_AUTHORITY))
    return files.where("outcome = 'indexed'").select(
        stable_id(source, source_id).alias("id"), source.alias("source"), source_id.alias("source_id"), url.alias("url"), title.alias("title"),
        body.alias("body"), T.body_hash(body).alias("body_hash"), meta.alias("metadata"),
    )


def context_documents(files: DataFrame, name: str, include=(), exclude=()) -> DataFrame:
    """Documents of a set of context files, those that are UTF-8 and match the patterns."""
    body = F.col("content").cast("string")
    good = files.where(P.selected_path("path", include, exclude, defaults=False) & F.is_valid_utf8(F.col("content").cast("string")))
    source, source_id = F.lit(f"context_files:{name}"), F.concat_ws(":", F.lit(name), "path")
    return good.select(
        stable_id(source, source_id).alias("id"), source.alias("source"), source_id.alias("source_id"), F.lit("").alias("url"),
        T.first_heading(body, F.col("path")).alias("title"), body.alias("body"), T.body_hash(body).alias("body_hash"),
        F.create_map(F.lit("path"), F.col("path"), F.lit("authority"), F.lit("high")).alias("metadata"),
    )


def placed(commits: DataFrame, *newest: Column) -> DataFrame:
    """Commits with ``position``, counted from their repository's newest, 0, in the order of ``newest``.

    Rows are dealt by ranges of that order and kept in the shared folder; the
    ranges' counts tell where each one begins, so no repository is one task.
    """
    n = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = commits.repartitionByRange(n, F.col("repo"), *newest).sortWithinPartitions(F.col("repo"), *newest)
    kept = checkpointed(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy("repo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = kept.groupBy("repo", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = each.select(F.col("repo").alias("_repo"), F.col("_part").alias("_range"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    # A row for each range, and for each repository.
    both = kept.join(F.broadcast(starts), F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("_part") == F.col("_range")))
    return both.select(*commits.columns, (F.col("_start") + F.col("_at")).alias("position"))


def after_commit(commits: DataFrame, cursor: str | None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits newer than the cursor, the next cursor as one row).

    ``position`` counts from the newest, 0. Under a limit the oldest unseen
    commits come first and the cursor moves to the newest one processed, so
    none is passed over.
    """
    fresh = commits
    if cursor:
        seen = commits.where(F.col("sha") == cursor).groupBy("repo").agg(F.min("position").alias("_seen"))
        # A row for each repository that has the cursor's commit.
        fresh = commits.join(F.broadcast(seen), "repo", "left").where("_seen is null or position < _seen").drop("_seen")
    if limit is not None:
        w = Window.partitionBy("repo").orderBy(F.desc("position"))
        fresh = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return fresh, fresh.groupBy("repo").agg(F.min_by("sha", "position").alias("cursor"))


def commit_documents(commits: DataFrame) -> DataFrame:
    """Documents of commits that are neither merges nor by bots nor trivial."""
    subject = T.trimmed(F.split("message", "\n")[0])
    good = commits.where((F.col("parents") < 2) & ~P.by_bot("author_name", "author_email") & ~P.trivial_subject(subject))
    source, source_id = F.concat(F.lit("git_commits:"), "repo"), F.concat_ws("@", "repo", F.substring("sha", 1, 12))
    body = T.trimmed("message")
    return good.select(
        stable_id(source, source_id).alias("id"), source.alias("source"), source_id.alias("source_id"), F.lit("").alias("url"), subject.alias("title"), body.alias("body"),
        T.body_hash(body).alias("body_hash"), F.create_map(F.lit("sha"), F.col("sha"), F.lit("author"), F.col("author_name"), F.lit("authority"), F.lit("low_medium")).alias("metadata"),
        F.col("committed_at").alias("created_at"),
    )


def tag_documents(tags: DataFrame) -> DataFrame:
    """Documents of tags: an annotated one's message, else what it points to; a lightweight tag's message is its commit's."""
    subject = T.trimmed(F.split(F.coalesce("message", F.lit("")), "\n")[0])
    plain = F.format_string("Lightweight tag pointing to %s: %s", F.substring("target", 1, 12), subject)
    body = F.when(F.col("annotated") & (T.trimmed("message") != ""), T.trimmed("message")).otherwise(plain)
    source, source_id = F.concat(F.lit("git_tags:"), "repo"), F.concat(F.col("repo"), F.lit("@tag:"), F.col("name"))
    return tags.select(
        stable_id(source, source_id).alias("id"), source.alias("source"), source_id.alias("source_id"), F.lit("").alias("url"), F.col("name").alias("title"), body.alias("body"),
        T.body_hash(body).alias("body_hash"), F.create_map(F.lit("tag"), F.col("name"), F.lit("authority"), F.lit("medium")).alias("metadata"),
    )


def resolved_content(requests: DataFrame, checkouts: DataFrame, documents: DataFrame, max_bytes: int = P.MAX_CONTENT_BYTES) -> DataFrame:
    """File contents for requests ``request_id, repo, path, start, end``: the checkout first, then indexed docs, code and manifests.

    Output: ``request_id, content, origin, missing``; unsafe paths and files
    over the limit are missing.
    """
    r = requests.where(P.safe_path("path"))
    local = r.join(checkouts.select("repo", "path", F.col("content").cast("string").alias("body")), ["repo", "path"]).select("request_id", "body", F.lit(0).alias("place"), F.lit("checkout").alias("origin"))
    kinds = F.when(F.startswith("source", F.lit("git_docs:")), 1).when(F.startswith("source", F.lit("git_code:")), 2).when(F.startswith("source", F.lit("git_manifest:")), 3)
    d = documents.select("source_id", "body", kinds.alias("place"), F.split("source", ":")[0].alias("origin")).where("place is not null")
    stored = r.withColumn("source_id", F.concat_ws(":", "repo", "path")).join(d, "source_id").select("request_id", "body", "place", "origin")
    best = local.unionByName(stored).where(F.octet_length("body") <= max_bytes).groupBy("request_id").agg(F.min_by(F.struct("body", "origin"), "place").alias("b"))
    out = requests.join(best, "request_id", "left")
    return out.select("request_id", T.line_slice(F.col("b.body"), "start", "end").alias("content"), F.col("b.origin").alias("origin"), F.col("b").isNull().alias("missing"))


def rectangle(cells: DataFrame) -> DataFrame:
    """Sheet rows ``row, cells array<string>`` padded with empty strings to the longest row."""
    width = cells.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("_w"))
    both = cells.crossJoin(F.broadcast(width))  # one row
    return both.select("row", F.concat("cells", F.array_repeat(F.lit(""), (F.col("_w") - F.size("cells")).cast("int"))).alias("cells"))


# Files that a converter turns into text.
CONVERTIBLE = (".docx", ".xlsx", ".pptx", ".pdf", ".html", ".htm", ".odt", ".ods", ".rtf", ".epub")


def convertible(path) -> Column:
    return T.extension(path).isin(*CONVERTIBLE)


def html_title(html) -> Column:
    return T.collapsed(F.regexp_extract(T._c(html), "(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space collapsed; character references stay."""
    out = T._c(html)
    for part in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?is)<!--.*?-->", "(?is)<[^>]*>"):
        out = F.regexp_replace(out, part, " ")
    return T.collapsed(out)


# What a converter's message means.
CONVERT_ERRORS = {"unsupported": "unsupported|unknown format", "encrypted": "encrypt|password", "too_large": "too large|limit", "timeout": "timed? ?out|deadline"}


def convert_error(message) -> Column:
    """The kind of a conversion failure: a known one, or ``failed``."""
    out = F.lit("failed")
    for kind, pattern in CONVERT_ERRORS.items():
        out = F.when(F.lower(T._c(message)).rlike(pattern), kind).otherwise(out)
    return out


def converted_documents(files: DataFrame, name: str, convert=html_text) -> DataFrame:
    """Context files that need a converter, as documents; those that give no text are left out."""
    rows = files.where(convertible("path")).withColumn("content", F.encode(convert(F.make_valid_utf8(F.col("content").cast("string"))), "UTF-8"))
    return context_documents(rows.where(F.octet_length("content") > 0), name)


def encoded_commit_cursor(sha, branch) -> Column:
    return F.to_json(F.struct(F.coalesce(T._c(sha), F.lit("")).alias("last_sha"), F.coalesce(T._c(branch), F.lit("")).alias("branch")))


def decoded_commit_cursor(cursor) -> Column:
    """``struct<last_sha, branch>``; an empty or unreadable cursor is an empty one."""
    got = F.from_json(T._c(cursor), "last_sha string, branch string")
    return F.struct(F.coalesce(got["last_sha"], F.lit("")).alias("last_sha"), F.coalesce(got["branch"], F.lit("")).alias("branch"))


# Sources of a repository, in the order of a clean-up.
REPOSITORY_SOURCES = ("git_docs:", "git_manifest:", "git_code:", "git_commits:", "git_tags:")


def sources_of(repo: str = "", source: str = "") -> list[str]:
    """The sources that a clean-up of a repository and of a named source covers, once each."""
    repo, source = repo.strip(), source.strip()
    return list(dict.fromkeys([*(p + repo for p in REPOSITORY_SOURCES if repo), *([source] if source else [])]))
