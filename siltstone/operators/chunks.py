"""Chunkers: documents to retrievable chunks.

Each takes documents ``id, source, source_id, url, title, body, metadata`` and
returns ``document_id, chunk_index, chunk_type, title, text, metadata``;
``finished`` adds ids, hashes and provenance. Windows, excerpts, commits and
issue objects are column expressions; Markdown, YAML and source files, which
need a parser's state, are Arrow functions over batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import bound
from siltstone.functions import predicates as P
from siltstone.functions import text as T
from siltstone.functions.lineage import shipped
from siltstone.functions.scoring import stable_id

WINDOW, STEP = 4000, 3700
EXCERPT = 2000
GROUP = 8
CHUNK_SCHEMA = "document_id string, chunk_index int, chunk_type string, title string, text string, metadata map<string,string>"
CHUNKER_VERSION = "1"


def _meta(*pairs: tuple[str, Column]) -> Column:
    """The document's metadata with further keys; null values are left out."""
    out = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    for k, v in pairs:
        rest = F.map_filter(out, lambda name, _: name != k)
        out = F.when(v.isNull(), out).otherwise(F.map_concat(rest, F.create_map(F.lit(k), v)))
    return out


def finished(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with id, text hash, and ``source`` and ``source_url`` in their metadata where absent."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("source").alias("_source"), F.col("url").alias("_url"))
    out = chunks.withColumn("text_hash", T.body_hash("text")).join(docs, "document_id")
    for key, col in (("source", "_source"), ("source_url", "_url")):
        absent = ~F.map_contains_key("metadata", key) & (F.coalesce(F.col(col), F.lit("")) != "")
        out = out.withColumn("metadata", F.when(absent, F.map_concat("metadata", F.create_map(F.lit(key), F.col(col)))).otherwise(F.col("metadata")))
    return out.select(
        stable_id("document_id", "chunk_index", "text_hash").alias("id"),
        "document_id", "chunk_index", "chunk_type", "title", "text", "text_hash", "metadata",
    )


def windows(text, size: int = WINDOW, step: int = STEP) -> Column:
    """Overlapping windows of a text; the last one ends where the text does."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.char_length(t)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * step + 1, F.lit(size)))


def source_windows(docs: DataFrame) -> DataFrame:
    """Source files other than Go: blocks between blank lines, each cut into windows."""
    blocks = F.filter(F.split("body", r"\n(?:[ \t\r]*\n)+"), lambda b: T.trimmed(b) != "")
    clean = F.transform(blocks, lambda b: F.regexp_replace(b, r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", ""))
    all_windows = F.flatten(F.transform(clean, lambda b: windows(b)))
    lang = F.regexp_extract(F.coalesce("title", F.lit("")), r"\.([^./]+)$", 1)
    return docs.select("*", F.posexplode(F.filter(all_windows, lambda w: w != "")).alias("chunk_index", "text")).select(
        F.col("id").alias("document_id"), "chunk_index", F.lit("code_symbol").alias("chunk_type"), T.title_line("text").alias("title"), "text",
        _meta(("lang", F.nullif(lang, F.lit("")))).alias("metadata"),
    )


def history_entries(docs: DataFrame) -> DataFrame:
    """Commits and tags: one chunk, its type by the source's prefix."""
    return docs.where("body <> ''").select(
        F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"),
        F.when(F.startswith("source", F.lit("git_tags:")), "git_tag").otherwise("git_commit").alias("chunk_type"),
        "title", F.col("body").alias("text"), _meta().alias("metadata"),
    )


def _exploded(docs: DataFrame, parts: Column, empty: bool = False) -> DataFrame:
    """Chunks of an array of (type, title, text); empty texts are left out, unless asked for, and indexes have no gaps."""
    live = parts if empty else F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return docs.select("*", F.posexplode(live).alias("chunk_index", "part")).select(
        F.col("id").alias("document_id"), "chunk_index", F.col("part.type").alias("chunk_type"), F.col("part.title").alias("title"),
        F.col("part.text").alias("text"), _meta().alias("metadata"),
    )


def _part(kind: str, title: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), title.alias("title"), text.alias("text"))


def chat_requests(docs: DataFrame, empty: bool = False) -> DataFrame:
    """Chat conversations: a summary, from the metadata or else an excerpt, and the raw excerpt; with ``empty`` both for each, also without text."""
    excerpt = T.truncated("body", EXCERPT)
    said = F.coalesce(F.nullif(F.col("metadata")["summary"], F.lit("")), excerpt)
    return _exploded(docs, F.array(_part("telegram_request_summary", F.col("title"), said), _part("telegram_raw_excerpt", F.col("title"), excerpt)), empty)


def _groups(items: Column, kind: str, render) -> Column:
    """Comment chunks of up to eight items, titled by their range."""

    def parts(x: Column) -> Column:
        n = F.size(x)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(GROUP))).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            title = F.format_string("Comments [%d-%d]", i + 1, F.least(i + GROUP, n))
            return _part(kind, title, F.array_join(F.transform(F.slice(x, i + 1, GROUP), render), "\n---\n\n"))

        return F.transform(starts, one)

    return bound(items, parts)


def _said(c: Column) -> Column:
    return F.concat(c["author"], F.lit(" ("), F.date_format(c["created"], "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("):\n"), c["body"])


def _threads(threads: Column) -> Column:
    """Threads without trivial comments; those that had no others are left out."""
    kept = F.transform(threads, lambda t: F.struct(F.coalesce(t["resolved"], F.lit(False)).alias("resolved"), F.filter(t["comments"], lambda c: ~P.trivial_comment(c["body"])).alias("comments")))
    return F.filter(F.coalesce(kept, F.array().cast("array<struct<resolved:boolean,comments:array<struct<author:string,created:timestamp,body:string>>>>")), lambda t: F.size(t["comments"]) > 0)


def _thread_text(t: Column) -> Column:
    return F.concat(F.when(t["resolved"], "[resolved] ").otherwise(""), F.array_join(F.transform(t["comments"], _said), "\n\n"))


def _tracker_parts(o, merge_requests: bool = False) -> Column:
    noun, prefix = ("MR !%d", "gitlab_mr") if merge_requests else ("Issue #%d", "gitlab_issue")
    parts = F.array(
        _part(f"{prefix}_summary", F.format_string(f"Summary: {noun}", o("iid")), o("summary")),
        _part(f"{prefix}_summary", F.format_string(f"Description: {noun}", o("iid")), o("description")),
    )
    return F.concat(parts, _groups(_threads(o("threads")), f"{prefix}_comment_group", _thread_text))


def tracker_items(docs: DataFrame, merge_requests: bool = False) -> DataFrame:
    """Issues or merge requests: summary, description and groups of threads.

    Besides document columns: ``iid, summary, description, threads
    array<struct<resolved, comments array<struct<author, created, body>>>>``.
    """
    return _exploded(docs, _tracker_parts(F.col, merge_requests))


def _release_parts(o) -> Column:
    said = F.coalesce(F.nullif(o("description"), F.lit("")), o("name"))
    return F.array(_part("gitlab_release_notes", F.format_string("Release: %s", o("tag_name")), said))


def releases(docs: DataFrame) -> DataFrame:
    """Release notes, else the name, else nothing. Besides document columns: ``tag_name, name, description``."""
    return _exploded(docs, _release_parts(F.col))


def _plain_parts() -> Column:
    return F.array(_part("section", F.col("title"), F.col("body")))


def plain_sections(docs: DataFrame) -> DataFrame:
    """The whole body as one section, where the object behind a document is unknown."""
    return _exploded(docs, _plain_parts())


def _ticket_parts(o) -> Column:
    kept = F.filter(F.coalesce(o("comments"), F.array().cast("array<struct<author:string,created:timestamp,body:string>>")), lambda c: ~P.trivial_comment(c["body"]))
    parts = F.array(
        _part("jira_issue_summary", F.format_string("Summary: %s", o("key")), o("summary")),
        _part("jira_issue_description", F.format_string("Description: %s", o("key")), o("description")),
        _part("jira_issue_resolution", F.format_string("Resolution: %s", o("key")), o("resolution")),
    )
    alone = F.array(_part("jira_issue_description", F.col("title"), F.col("body")))
    return F.when(F.coalesce(o("key"), F.lit("")) != "", F.concat(parts, _groups(kept, "jira_issue_comment_group", _said))).otherwise(alone)


def tickets(docs: DataFrame) -> DataFrame:
    """Tickets: summary, description, resolution and groups of comments; without a key the body as description.

    Besides document columns: ``key, summary, description, resolution, comments
    array<struct<author, created, body>>``.
    """
    return _exploded(docs, _ticket_parts(F.col))


def comment_groups(rows: DataFrame, parent: str, order: list, body: str) -> DataFrame:
    """Comment rows of a table in groups of eight for each parent, trivial ones left out: ``parent, part, n, text``.

    The place within the parent decides the group, so each group is gathered
    alone, however many comments a parent has.
    """
    w = Window.partitionBy(parent).orderBy(*order)
    placed = rows.where(~P.trivial_comment(body)).withColumn("_at", F.row_number().over(w) - 1)
    grouped = placed.groupBy(parent, F.floor(F.col("_at") / GROUP).cast("long").alias("part"))
    said = F.array_sort(F.collect_list(F.struct("_at", F.col(body).alias("said"))))
    return grouped.agg(F.count("*").alias("n"), F.array_join(F.transform(said, lambda x: x["said"]), "\n---\n\n").alias("text"))


# Parsers with state, over Arrow batches.

_HEADING = re.compile(r"(#{1,6})[ \t]+(.*)")


def split_paragraphs(body: str, size: int = WINDOW) -> list[str]:
    """Greedy paragraphs up to ``size``; each further piece begins with the last paragraph of the one before."""
    paras = [p.strip("\n") for p in re.split(r"\n(?:[ \t]*\n)+", body.strip()) if p.strip()]
    out: list[str] = []
    now: list[str] = []
    length = 0
    for p in paras:
        if now and length + 2 + len(p) > size:
            out.append("\n\n".join(now))
            now = [now[-1]]
            length = len(now[0])
        length += len(p) + (2 if now else 0)
        now.append(p)
    if now:
        out.append("\n\n".join(now))
    return out


def markdown_parts(title: str, body: str) -> list[tuple[str, str, str | None]]:
    """(title, text, heading path) of the preamble and of every heading's section."""
    sections: list[tuple[list[str] | None, list[str]]] = [(None, [])]
    stack: list[tuple[int, str]] = []
    for line in body.split("\n"):
        m = _HEADING.match(line)
        if m:
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2].strip()))
            sections.append(([t for _, t in stack], []))
        else:
            sections[-1][1].append(line)
    out: list[tuple[str, str, str | None]] = []
    for path, lines in sections:
        text = "\n".join(lines).strip()
        if path is None:
            if text:
                out.append((title, text, None))
            continue
        name = " > ".join(path)
        for piece in split_paragraphs(text) if len(text) > WINDOW else [text]:
            out.append((name, f"{name}\n{piece}", name))
    return out


def yaml_parts(body: str) -> list[tuple[str, str, dict[str, str]]]:
    """(title, text, metadata) of each object of a manifest; charts' output, CRDs and documents over the size limit are left out, and an undecodable document ends the file."""
    import yaml

    if re.match(r"\s*# Source:", body):
        return []
    out, line = [], 1
    for raw in re.split(r"(?m)^---[ \t]*$\n?", body):
        start, line = line, line + raw.count("\n") + 1
        if not raw.strip() or len(raw.encode()) > P.MAX_YAML_BYTES or re.match(r"\s*# Source:", raw):
            continue
        try:
            doc = yaml.safe_load(raw)
        except yaml.YAMLError:
            break
        if not isinstance(doc, dict) or doc.get("kind") == "CustomResourceDefinition":
            continue
        head = doc.get("metadata") if isinstance(doc.get("metadata"), dict) else {}
        meta = {"apiVersion": doc.get("apiVersion"), "kind": doc.get("kind"), "name": head.get("name"), "namespace": head.get("namespace"), "start_line": start}
        meta = {k: str(v) for k, v in meta.items() if v not in (None, "")}
        title = " ".join(x for x in (meta.get("kind"), meta.get("name")) if x)
        if "namespace" in meta:
            title += f" ({meta['namespace']})"
        out.append((title, raw.strip("\n"), meta))
    return out


_DECL = re.compile(r"^(func|type|var|const)\b")
_FUNC = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?([^)\s]+)\s*\)\s*)?(\w+)")
_GO_ON = re.compile(r"(?:[-+*/%&|^<>=!,.]|&&|\|\|)$")


def _go_lines(lines: list[str]) -> list[tuple[bool, int, bool, int, str]] | None:
    """For each line: whether it begins in a string or comment, the depth of brackets there, the same at its end, and its code without a trailing comment. None if the brackets don't balance."""
    depth, mode, out = 0, "", []
    for line in lines:
        begin, i, end = (bool(mode), depth), 0, len(line)
        while i < len(line):
            c = line[i]
            if mode:
                if line.startswith(mode[::-1], i):
                    i += len(mode) - 1
                    mode = ""
            elif line.startswith("//", i):
                end = i
                break
            elif line.startswith("/*", i):
                mode, i = "/*", i + 1
            elif c in "\"'":
                j = i + 1
                while j < len(line) and line[j] != c:
                    j += 2 if line[j] == "\\" else 1
                i = j
            elif c == "`":
                mode = "`"
            elif c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
                if depth < 0:
                    return None
            i += 1
        out.append((*begin, bool(mode), depth, line[:end].rstrip()))
    return None if depth or mode else out


def _go_spans(told: list, first: int, last: int, level: int, opens) -> Iterator[tuple[int, int, int | None]]:
    """(begin, end, line of its comment) of what ``opens`` at a depth of brackets, between two lines."""
    comment = begin = None
    for n in range(first, last):
        inside, depth, inside_after, depth_after, code = told[n]
        if begin is None and not inside and depth == level:
            if not code.strip():
                blank = not opens(n, False)
                comment = None if blank else n if comment is None else comment
                continue
            if not opens(n, True):
                comment = None
                continue
            begin = n
        if begin is not None and not inside_after and depth_after == level and not (_GO_ON.search(code) and not code.endswith(("++", "--"))):
            yield begin, n, comment
            begin = comment = None


def go_parts(title: str, body: str, url: str = "") -> list[tuple[str, str, dict[str, str]]]:
    """(title, text, metadata): an overview, then each function and each type, variable and constant with its comment.

    Every entry of a grouped declaration is a part of its own. A file whose
    brackets don't balance, or without a package, has no parts. A scanner of
    brackets, strings and comments stands in for a full parser; signatures in
    the overview are the heads of the declarations.
    """
    lines = body.split("\n")
    told = _go_lines(lines)
    package = next((m[1] for m in (re.match(r"package\s+(\w+)", x) for x in lines) if m), "")
    if told is None or not package:
        return []
    parts, heads = [], []

    def add(name: str, kind: str, begin: int, end: int, text: str, more: dict[str, str]) -> None:
        anchor = f"#L{begin + 1}-{end + 1}" if end > begin else f"#L{begin + 1}"
        meta = {"lang": "go", "package": package, "symbol": name, "symbol_kind": kind, "start_line": str(begin + 1), "end_line": str(end + 1)} | more
        parts.append((f"({more['receiver']}).{name}" if more else name, text, meta | ({"source_url": url + anchor} if url else {})))

    def text_of(begin: int, end: int, start: int = 0) -> str:
        return "\n".join([*lines[begin:end], told[end][4]])[start:].lstrip() if end > begin else told[end][4][start:].lstrip()

    top = lambda n, code: bool(_DECL.match(lines[n])) if code else lines[n].startswith("//")
    entry = lambda n, code: code or lines[n].strip().startswith("//")
    for a, b, comment in _go_spans(told, 0, len(lines), 0, top):
        kind, head = _DECL.match(lines[a])[1], re.sub(r"\s*\{[^{}]*$", "", told[a][4])
        since = a if comment is None else comment
        m = _FUNC.match(lines[a]) if kind == "func" else None
        if m:
            head = re.sub(r"\s\{.*$", "", told[a][4])
            heads.append(re.sub(r"^func\s*\([^)]*\)", f"func ({m[1]})", head) if m[1] else head)
            add(m[2], "func", since, b, text_of(since, b), {"receiver": m[1]} if m[1] else {})
        elif kind != "func" and b > a and re.match(rf"{kind}\s*\($", told[a][4]):
            for x, y, doc in _go_spans(told, a + 1, b, 1, entry):
                name = re.match(r"\s*(\w*)", lines[x])[1]
                said = re.sub(r"\s*\{[^{}]*$", "", told[x][4]).strip()
                heads.append(f"type {said}" if kind == "type" else said)
                add(name, kind, x if doc is None else doc, y, text_of(x if doc is None else doc, y), {})
        elif kind != "func":
            name = re.match(rf"{kind}\s*\(?\s*(\w*)", lines[a])[1]
            heads.append(head if kind == "type" else re.sub(rf"^{kind}\s+", "", head))
            add(name, kind, since, b, text_of(since, b, 0 if comment is not None else len(kind) + 1), {})
    imports = re.findall(r'"[^"\n]+"', "\n".join(re.findall(r"(?ms)^import\s*(\([^)]*\)|[^\n]*)", body)))
    block = ["import (", *(f"\t{x}" for x in imports), ")", ""] if imports else []
    overview = "\n".join([f"package {package}", "", *block, *heads]).strip()
    return [(f"file: {title} ({package})", overview, {"lang": "go", "package": package, "symbol": package, "symbol_kind": "package"}), *parts]


def _parsed(docs: DataFrame, parse) -> DataFrame:
    """``parse(title, body, url)`` gives (type, title, text, metadata) of each chunk; ``url`` is the document's link in its metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, kinds, titles, texts, metas = [], [], [], [], [], []
            for doc, title, body, meta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, (kind, name, text, more) in enumerate(parse(title or "", body or "", dict(meta or []).get("source_url") or "")):
                    ids.append(doc)
                    at.append(i)
                    kinds.append(kind)
                    titles.append(name)
                    texts.append(text)
                    metas.append(list((dict(meta or []) | more).items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(at, pa.int32()), pa.array(kinds, pa.string()), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(metas, pa.map_(pa.string(), pa.string()))],
                names=["document_id", "chunk_index", "chunk_type", "title", "text", "metadata"],
            )

    shipped(docs.sparkSession)
    return docs.select("id", "title", "body", "metadata").mapInArrow(run, CHUNK_SCHEMA)


def markdown(docs: DataFrame) -> DataFrame:
    return _parsed(docs, lambda title, body, _: [("section", t, x, {"heading_path": h} if h else {}) for t, x, h in markdown_parts(title, body)])


def manifests(docs: DataFrame) -> DataFrame:
    return _parsed(docs, lambda _, body, _url: [("manifest", t, x, m) for t, x, m in yaml_parts(body)])


def go_sources(docs: DataFrame) -> DataFrame:
    """Go files by declaration; a file that can't be scanned has no chunks."""
    return _parsed(docs, lambda title, body, url: [("code_file" if m["symbol_kind"] == "package" else "code_symbol", t, x, m) for t, x, m in go_parts(title, body, url)])


def code(docs: DataFrame) -> DataFrame:
    """Source files by language: those whose ``metadata.lang`` is go, and all others."""
    is_go = F.coalesce(F.col("metadata")["lang"] == "go", F.lit(False))
    return go_sources(docs.where(is_go)).unionByName(source_windows(docs.where(~is_go)))


# What documents of tracker objects hold of them, as JSON in the metadata.
_COMMENTS = "array<struct<author:string,created:timestamp,body:string>>"
OBJECTS = {
    "gitlab_issue": f"iid bigint, summary string, description string, threads array<struct<resolved:boolean,comments:{_COMMENTS}>>",
    "gitlab_mr": f"iid bigint, summary string, description string, threads array<struct<resolved:boolean,comments:{_COMMENTS}>>",
    "gitlab_release": "tag_name string, name string, description string",
    "jira_issue": f"key string, summary string, description string, resolution string, comments {_COMMENTS}",
}
_BASE = ("id", "source", "source_id", "url", "title", "body")


def _told(docs: DataFrame, **sources: Column) -> DataFrame:
    """Documents with the objects that their metadata hold, each decoded once where its condition holds; null where it can't be read. The objects leave the metadata."""
    plain = F.map_filter("metadata", lambda k, _: ~k.isin(*OBJECTS))
    objects = (F.when(here, F.from_json(F.col("metadata")[key], OBJECTS[key])).alias(f"_{key}") for key, here in sources.items())
    return docs.select(*_BASE, plain.alias("metadata"), *objects)


def _read(rows: DataFrame, key: str) -> Column:
    """Whether the object under ``key`` was readable."""
    o = F.col(f"_{key}")
    return o.isNotNull() & F.exists(F.array(*(o[f.name].isNotNull() for f in rows.schema[f"_{key}"].dataType)), lambda x: x)


def gitlab(docs: DataFrame) -> DataFrame:
    """Issues, merge requests and releases by their source; other sources, and objects that can't be read, as plain sections."""
    kinds = {"gitlab_issue": _tracker_parts, "gitlab_mr": lambda o: _tracker_parts(o, merge_requests=True), "gitlab_release": _release_parts}
    rows = _told(docs, **{k: F.col("source") == k for k in kinds})
    parts = _plain_parts()
    for key, of in kinds.items():
        parts = F.when(_read(rows, key), of(lambda name, key=key: F.col(f"_{key}")[name])).otherwise(parts)
    return _exploded(rows, parts)


def jira(docs: DataFrame) -> DataFrame:
    """Tickets; without a readable object the body is the description."""
    return _exploded(_told(docs, jira_issue=F.lit(True)), _ticket_parts(lambda name: F.col("_jira_issue")[name]))


CHUNKERS = {"markdown": markdown, "yaml": manifests, "code": code, "git": history_entries, "gitlab": gitlab, "jira": jira, "telegram": chat_requests}
#: Raised one by one when a chunker's output changes, so that its documents are chunked again.
VERSIONS = dict.fromkeys(CHUNKERS, CHUNKER_VERSION) | {"code": "2", "gitlab": "2", "jira": "2"}


def chunked(docs: DataFrame, kind: str, **options) -> DataFrame:
    """Chunks of documents of one kind; options go to its chunker."""
    if kind not in CHUNKERS:
        raise ValueError(f"no chunker for {kind!r}")
    return CHUNKERS[kind](docs, **options)
