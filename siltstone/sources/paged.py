"""Paged readers of trackers and chats as a Spark data source, in batch and as a stream.

``spark.read.format("siltstone_pages")`` and ``readStream`` give one partition
for each scope (a project or a chat) and page through it lazily, so a task holds
one page. An object's place is (time of its last change, number, name); a cursor
is the last place seen in each scope, and a read takes what lies behind the
cursor, so objects with equal times on both sides of a page's end are read once
each. Streams keep their cursors in the query's checkpoint; batch reads take one
as an option and ``next_cursor`` makes the following one.

Options: ``path`` (a service's address, or a folder of recorded pages that all
executors can read), ``kind`` (a key of ``KINDS``), ``scopes`` (JSON array),
``page_size``, ``token`` and ``cursor`` (JSON object of places by scope).

A recording is a folder ``kind/scope/`` of text files, at any depth; by path and
by line they hold the pages in order of change, each line one JSON array.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.functions.lineage import shipped
from siltstone.sources import trackers

FORMAT = "siltstone_pages"
SCHEMA = "scope string, updated_us bigint, number bigint, name string, body string"
#: Tries of a request that fails for a while, and seconds before the second one.
TRIES, WAIT = 5, 0.5
#: Bytes of a recording that are read at once from its end.
BLOCK = 1 << 20

Place = tuple[int, int, str]
START: Place = (-(2**62), -(2**62), "")


@dataclass(frozen=True)
class Kind:
    """How objects of a kind are found and placed; ``url`` is relative to the service's address."""

    url: str
    at: tuple[str, ...]
    number: str | None
    name: str | None = None
    order: str = ""
    #: History goes by number, newest first.
    by_number: bool = False
    spec: str = ""


# The services' paths and fields.
KINDS = {
    "issues": Kind("api/v4/projects/{scope}/issues", ("updated_at",), "iid", order="updated_at", spec=trackers.ISSUE),
    "merge_requests": Kind("api/v4/projects/{scope}/merge_requests", ("updated_at",), "iid", order="updated_at", spec=trackers.ISSUE),
    "releases": Kind("api/v4/projects/{scope}/releases", ("released_at",), None, "tag_name", order="released_at", spec=trackers.RELEASE),
    "tickets": Kind("rest/api/2/search", ("fields", "updated"), None, "key", spec=trackers.TICKET),
    "history": Kind("", (), "id", by_number=True, spec="id bigint, chat_id bigint, message string, date bigint, from_id struct<type:string,id:bigint>, reply_to bigint"),
}
#: What an issue or merge request has of its own, by the last part of its path.
PARTS = {"discussions": "discussions", "links": "links", "closes_issues": "closes_issues"}


def micros(text: object) -> int | None:
    """Microseconds since 1970 of a time with an offset (none: UTC); None where it can't be read."""
    try:
        at = datetime.fromisoformat(str(text))
    except ValueError:
        return None
    return (at.replace(tzinfo=at.tzinfo or UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def place(kind: Kind, x: dict) -> Place | None:
    """Where an object stands; None for one without a readable time or number."""
    at: object = x
    for part in kind.at:
        at = at.get(part) if isinstance(at, dict) else None
    us = micros(at) if kind.at else 0
    number = x.get(kind.number) if kind.number else 0
    name = str(x.get(kind.name) or "") if kind.name else ""
    if kind.name == "key" and (digits := re.search(r"\d+$", name)):
        number = int(digits[0])
    if us is None or not isinstance(number, int):
        return None
    return us, number, name


def as_offset(p: Place) -> dict:
    return dict(zip(("us", "number", "name"), p, strict=True))


def as_place(x: dict | None) -> Place:
    return (x["us"], x["number"], x["name"]) if x else START


class Recorded:
    """Pages from files; the place of a page's objects decides, so files may be read again from the first."""

    def __init__(self, options: dict, kind_name: str):
        self.fs, self.root = pafs.FileSystem.from_uri(re.sub("^file:/+", "/", options["path"]))
        self.name, self.kind = kind_name, KINDS[kind_name]

    def _files(self, scope: str) -> list[str]:
        where = f"{self.root}/{self.name}/{scope}"
        if self.fs.get_file_info(where).type != pafs.FileType.Directory:
            return []
        found = self.fs.get_file_info(pafs.FileSelector(where, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))

    def _lines(self, path: str) -> Iterator[list[dict]]:
        with self.fs.open_input_stream(path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (json.loads(x) for x in lines if x.strip())
            if rest.strip():
                yield json.loads(rest)

    def _last_lines(self, path: str) -> Iterator[list[dict]]:
        """The lines from the last one back."""
        with self.fs.open_input_file(path) as f:
            at, pieces = f.size(), []  # pieces: of a line whose begin isn't read yet, the last one first
            while at > 0:
                n = min(BLOCK, at)
                at -= n
                f.seek(at)
                first, *lines = f.read(n).split(b"\n")
                for x in reversed(lines):
                    if (line := x + b"".join(reversed(pieces))).strip():
                        yield json.loads(line)
                    pieces = []
                pieces.append(first)
            if (line := b"".join(reversed(pieces))).strip():
                yield json.loads(line)

    def _highest(self, page: list[dict]) -> Place | None:
        return max((p for x in page if (p := place(self.kind, x))), default=None)

    def _end(self, path: str) -> Place | None:
        """The highest place of a file: its pages are read from the last one until all objects are older; histories go by number alone, so all are read."""
        if self.kind.by_number:
            return max(filter(None, map(self._highest, self._lines(path))), default=None)
        best = None
        for page in self._last_lines(path):
            highest = self._highest(page)
            if best and highest and highest[0] < best[0]:
                break
            best = max(filter(None, (best, highest)), default=None)
        return best

    def newest(self, scope: str) -> Place | None:
        """The highest place; files are read from the last one until all objects are older."""
        best = None
        for path in reversed(self._files(scope)):
            highest = self._end(path)
            if best and highest and (self.kind.by_number or highest[0] < best[0]):
                break
            best = max(filter(None, (best, highest)), default=None)
        return best

    def pages(self, scope: str, after: Place) -> Iterator[list[dict]]:
        """Pages in order, without the files that end before the place's time."""
        files = self._files(scope)
        if after != START and not self.kind.by_number:
            behind = next((i for i in reversed(range(len(files))) if (p := self._end(files[i])) and p[0] < after[0]), -1)
            files = files[behind + 1 :]
        for path in files:
            yield from self._lines(path)

    def part(self, scope: str, number: int, what: str) -> list[dict]:
        path = f"{self.root}/{what}/{scope}/{number}.json"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return []
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())


class Service:
    """Pages over HTTP, in order of change.

    After each page the lower bound moves to the last time seen and counting
    starts anew, so an object that changes meanwhile shifts no other over a
    page's end; only within one time (tickets: one minute) pages are counted.
    """

    def __init__(self, options: dict, kind_name: str):
        self.base, self.token = options["path"].rstrip("/"), options.get("token", "")
        self.size = int(options.get("page_size", 100))
        self.name, self.kind = kind_name, KINDS[kind_name]

    def _get(self, url: str, **params: object) -> object:
        head = {"PRIVATE-TOKEN": self.token, "Authorization": f"Bearer {self.token}"} if self.token else {}
        request = urllib.request.Request(f"{self.base}/{url}?{urllib.parse.urlencode(params)}", headers=head)
        for i in range(TRIES):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if i + 1 == TRIES or e.code != 429 and e.code < 500:
                    raise
                wait = e.headers.get("Retry-After", "")
                time.sleep(float(wait) if wait.isdigit() else WAIT * 2**i)
            except urllib.error.URLError:
                if i + 1 == TRIES:
                    raise
                time.sleep(WAIT * 2**i)
        raise AssertionError("unreachable")

    def _page(self, scope: str, bound: int | None, n: int, down: bool = False) -> list[dict]:
        """The n-th page (from 0) of objects changed at the bound or later."""
        if self.name == "tickets":
            since = "" if bound is None else f' AND updated >= "{_iso(bound):%Y-%m-%d %H:%M}"'
            query = f'project IN ("{scope}"){since} ORDER BY updated {"DESC" if down else "ASC"}'
            return self._get(self.kind.url, jql=query, startAt=n * self.size, maxResults=self.size, fields="*all", expand="changelog")["issues"]
        params: dict[str, object] = {"order_by": self.kind.order, "sort": "desc" if down else "asc", "per_page": self.size, "page": n + 1}
        if bound is not None and self.name != "releases":
            params["updated_after"] = _iso(bound).isoformat(timespec="microseconds").replace("+00:00", "Z")
        return self._get(self.kind.url.format(scope=urllib.parse.quote(scope, safe="")), **params)

    def newest(self, scope: str) -> Place | None:
        best, n = None, 0
        while True:
            page = self._page(scope, None, n, down=True)
            places = [p for x in page if (p := place(self.kind, x))]
            best = max([*places, *([best] if best else [])], default=None)
            if len(page) < self.size or best and places and min(places)[0] < best[0]:
                return best
            n += 1

    def pages(self, scope: str, after: Place) -> Iterator[list[dict]]:
        minute = 60_000_000 if self.name == "tickets" else 1
        bound, n = None if after == START else after[0] // minute * minute, 0
        while True:
            page = self._page(scope, bound, n)
            yield page
            if len(page) < self.size:
                return
            last = max((p[0] for x in page if (p := place(self.kind, x))), default=None)
            if self.name != "releases" and last is not None and (bound is None or last // minute * minute > bound):
                bound, n = last // minute * minute, 0
            else:
                n += 1

    def part(self, scope: str, number: int, what: str) -> list[dict]:
        out, n = [], 0
        while True:
            url = f"{self.kind.url.format(scope=urllib.parse.quote(scope, safe=''))}/{number}/{PARTS[what]}"
            page = self._get(url, per_page=100, page=n + 1, **({"order_by": "created_at", "sort": "asc"} if what == "discussions" else {}))
            out += page
            if len(page) < 100:
                return out
            n += 1


def _iso(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)


def transport(options: dict) -> Recorded | Service:
    return (Service if re.match("https?://", options["path"]) else Recorded)(options, options["kind"])


@dataclass
class Scope(InputPartition):
    """What one task reads: a scope's objects after one place, up to another (None: all)."""

    scope: str
    after: Place
    upto: Place | None

    def rows(self, options: dict) -> Iterator[tuple]:
        """Each place within the bounds once; those of the latest time (for tickets: minute) are remembered, as pages may repeat them."""
        source = transport(options)
        recent: set[Place] = set()
        for page in source.pages(self.scope, self.after):
            for x in page:
                p = place(source.kind, x)
                if p and p > self.after and (self.upto is None or p <= self.upto) and p not in recent:
                    recent.add(p)
                    yield self.scope, *p, json.dumps(x, ensure_ascii=False)
            if source.kind.by_number:
                recent.clear()
            elif recent:
                last = max(recent)[0] // 60_000_000
                recent = {p for p in recent if p[0] // 60_000_000 == last}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Scope]:
        cursor = json.loads(self.options.get("cursor") or "{}")
        return [Scope(s, as_place(cursor.get(s)), None) for s in dict.fromkeys(json.loads(self.options["scopes"]))]

    def read(self, partition: Scope) -> Iterator[tuple]:
        return partition.rows(self.options)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.scopes = list(dict.fromkeys(json.loads(options["scopes"])))

    def initialOffset(self) -> dict:
        cursor = json.loads(self.options.get("cursor") or "{}")
        return {s: as_offset(as_place(cursor.get(s))) for s in self.scopes}

    def latestOffset(self) -> dict:
        source = transport(self.options)
        return {s: as_offset(source.newest(s) or START) for s in self.scopes}

    def partitions(self, start: dict, end: dict) -> list[Scope]:
        spans = [(s, as_place(start.get(s)), as_place(x)) for s, x in end.items()]
        return [Scope(s, a, b) for s, a, b in spans if a < b]

    def read(self, partition: Scope) -> Iterator[tuple]:
        return partition.rows(self.options)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _known(self) -> dict:
        options = dict(self.options)
        if options.get("kind") not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if not json.loads(options.get("scopes") or "[]"):
            raise ValueError("no projects or chats are configured")
        return options

    def reader(self, schema) -> PagedReader:
        return PagedReader(self._known())

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self._known())


def _options(path: str, kind: str, scopes: list[str], more: dict) -> dict[str, str]:
    return {"path": path, "kind": kind, "scopes": json.dumps([str(s).strip() for s in scopes if str(s).strip()]), **{k: str(v) for k, v in more.items()}}


def read(spark: SparkSession, path: str, kind: str, scopes: list[str], **options: object) -> DataFrame:
    """All objects of the scopes behind ``cursor``, as JSON texts with their places."""
    shipped(spark)
    spark.dataSource.register(PagedSource)
    return spark.read.format(FORMAT).options(**_options(path, kind, scopes, options)).load()


def stream(spark: SparkSession, path: str, kind: str, scopes: list[str], **options: object) -> DataFrame:
    """The same as a stream; each micro-batch takes what is new at its start."""
    shipped(spark)
    spark.dataSource.register(PagedSource)
    return spark.readStream.format(FORMAT).options(**_options(path, kind, scopes, options)).load()


def objects(rows: DataFrame, kind: str) -> DataFrame:
    """The objects' own columns behind their scope, as the functions of ``trackers`` take them."""
    return rows.select("scope", F.from_json("body", KINDS[kind].spec).alias("x")).select("scope", "x.*")


def next_cursor(rows: DataFrame, old: str | None = None) -> str | None:
    """The cursor behind these rows: each scope's last place, that of ``old`` where nothing is new."""
    last = rows.groupBy("scope").agg(F.max(F.struct("updated_us", "number", "name")).alias("p")).collect()  # a row for each configured scope
    new = {r["scope"]: as_offset(tuple(r["p"])) for r in last}
    both = json.loads(old or "{}") | new
    return json.dumps(both, sort_keys=True) if both else old


def parts(items: DataFrame, path: str, kind: str, what: str, **options: object) -> DataFrame:
    """``scope, number, position, body``: the discussions, links or closed issues of ``scope, number`` rows.

    Rows are fetched one after another in each task. Objects whose parts can't be
    fetched have none, so one broken object doesn't stop a run.
    """
    told = _options(path, kind, [], options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = transport(told)
        for batch in batches:
            rows = []
            for scope, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = source.part(scope, number, what)
                except (OSError, ValueError):
                    found = []
                rows += [(scope, number, i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["scope", "number", "position", "body"])

    shipped(items.sparkSession)
    return items.select(F.col("scope").cast("string").alias("scope"), F.col("number").cast("long").alias("number")).mapInArrow(run, "scope string, number long, position long, body string")


def notes_of(discussions: DataFrame) -> DataFrame:
    """The notes of discussions (``parts``), flat, as ``trackers.notes`` takes them; ``project_id`` is the hash of the scope where a note names none."""
    note = trackers.NOTE.replace("project_id bigint, iid bigint, thread_id string, ", "")
    inner = re.sub(r"(\w+) (bigint|string|boolean)", r"\1:\2", note).replace("author struct", "author:struct").replace("resolved_by struct", "resolved_by:struct").replace(", ", ",")
    d = discussions.select("scope", "number", F.from_json("body", f"id string, notes array<struct<{inner}>>").alias("d"))
    return d.select("scope", F.xxhash64("scope").alias("project_id"), F.col("number").alias("iid"), F.col("d.id").alias("thread_id"), F.explode("d.notes").alias("n")).select("scope", "project_id", "iid", "thread_id", "n.*")


def whole_items(rows: DataFrame, path: str, kind: str, **options: object) -> DataFrame:
    """Issues or merge requests with their threads and links, ready for ``trackers.issue_documents``."""
    raw = objects(rows, kind).withColumn("project_id", F.xxhash64("scope"))
    scopes = rows.select("scope", F.xxhash64("scope").alias("project_id")).distinct()
    items = trackers.issues(raw)
    keys = rows.select("scope", "number").distinct()
    said = trackers.notes(notes_of(parts(keys, path, kind, "discussions", **options)))
    what = "closes_issues" if kind == "merge_requests" else "links"
    linked = parts(keys, path, kind, what, **options).select(
        F.xxhash64("scope").alias("project_id"), F.col("number").alias("_number"), "position", F.from_json("body", "iid bigint, link_type string, title string, web_url string").alias("x")
    )
    linked = linked.select("project_id", F.col("_number").alias("iid"), "position", F.col("x.link_type").alias("link_type"), F.col("x.iid").alias("target_iid"), F.col("x.title").alias("title"), F.col("x.web_url").alias("web_url"))
    out = trackers.with_links(trackers.with_threads(items, said), linked, "closes" if kind == "merge_requests" else None)
    return out.join(scopes, "project_id", "left").drop("project_id")
