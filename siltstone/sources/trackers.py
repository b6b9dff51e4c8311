"""Issue-tracker and chat exports as tables: JSON scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import predicates as P
from siltstone.functions import text as T
from siltstone.functions.scoring import stable_id

# Fields of the tracker's objects.
USER = "struct<username:string,name:string>"
THREADS = "array<struct<resolved:boolean,comments:array<struct<author:string,created:timestamp,body:string>>>>"
ISSUE = f"iid bigint, project_id bigint, title string, description string, state string, labels array<string>, created_at string, updated_at string, web_url string, author {USER}, assignees array<{USER}>, reviewers array<{USER}>, merged_at string, has_conflicts boolean, detailed_merge_status string, sha string, source_branch string, target_branch string, draft boolean, merge_commit_sha string, merged_by {USER}"
LINK = "project_id bigint, iid bigint, link_type string, target_iid bigint, title string, web_url string"
NOTE = f"id bigint, project_id bigint, iid bigint, thread_id string, system boolean, body string, author {USER}, created_at string, resolved boolean, resolved_by {USER}, resolved_at string"
RELEASE = "project_id bigint, tag_name string, name string, description string, released_at string, web_url string"
TICKET = (
    "id string, key string, fields struct<summary:string,description:string,status:struct<name:string>,resolution:struct<name:string>,created:string,updated:string,resolutiondate:string,"
    "components:array<struct<name:string>>,labels:array<string>,assignee:struct<accountId:string,name:string,key:string,displayName:string>,reporter:struct<displayName:string>,"
    "comment:struct<comments:array<struct<id:string,author:struct<accountId:string,name:string,key:string,displayName:string>,body:string,created:string>>>>,"
    "changelog struct<total:int,histories:array<struct<id:string,author:struct<accountId:string,name:string,key:string,displayName:string>,created:string,items:array<struct<field:string>>>>>"
)
TICKET_TIMES = ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")


def timestamp(text) -> Column:
    """An RFC 3339 time, or null."""
    return F.try_to_timestamp(F.nullif(T._c(text), F.lit("")))


def ticket_time(text) -> Column:
    """The first of the known layouts that fits, or null."""
    return F.coalesce(*(F.try_to_timestamp(T._c(text), F.lit(f)) for f in TICKET_TIMES))


def chat_time(unix, local) -> Column:
    """Unix seconds if there are any, else a local time."""
    return F.coalesce(F.timestamp_seconds(F.expr(f"try_cast({unix} as bigint)")), F.try_to_timestamp(T._c(local)))


def person(user: Column) -> Column:
    """The user name, else the display name."""
    return F.coalesce(F.nullif(user["username"], F.lit("")), user["name"])


def people(users: Column) -> Column:
    return F.filter(F.transform(F.coalesce(users, F.array().cast(f"array<{USER}>")), person), lambda p: F.coalesce(p, F.lit("")) != "")


def ticket_person(user: Column) -> Column:
    """accountId, else name, else key."""
    return F.coalesce(F.nullif(user["accountId"], F.lit("")), F.nullif(user["name"], F.lit("")), F.nullif(user["key"], F.lit("")))


def read_json(spark: SparkSession, path: str, spec: str) -> DataFrame:
    return spark.read.schema(spec).json(path)


def after(rows: DataFrame, updated: Column, cursor: str | None, inclusive: bool = False) -> DataFrame:
    """Rows past a time cursor; one that can't be read counts as none."""
    at = timestamp(F.lit(cursor))
    new = updated >= at if inclusive else updated > at
    return rows.where(at.isNull() | new) if cursor else rows


def issues(raw: DataFrame, cursor: str | None = None) -> DataFrame:
    """Issues or merge requests, flattened; rows whose times can't be read are left out."""
    out = raw.select(
        "iid", "project_id", "title", "description", "state", "labels", timestamp("created_at").alias("created_at"), timestamp("updated_at").alias("updated_at"), F.col("web_url").alias("url"),
        person(F.col("author")).alias("author"), people(F.col("assignees")).alias("assignees"), people(F.col("reviewers")).alias("reviewers"),
        timestamp("merged_at").alias("merged_at"), "has_conflicts", "detailed_merge_status", "sha", "source_branch", "target_branch",
        F.coalesce("draft", F.lit(False)).alias("draft"), "merge_commit_sha", person(F.col("merged_by")).alias("merged_by"),
    ).where("created_at is not null and updated_at is not null")
    return after(out, F.col("updated_at"), cursor)


def conflicting(requests: DataFrame, since: Column | None = None) -> DataFrame:
    """Open merge requests that can't be merged, updated since the bound."""
    bad = F.coalesce(F.col("has_conflicts"), F.lit(False)) | F.coalesce(F.col("detailed_merge_status") == "conflict", F.lit(False))
    out = requests.where((F.col("state") == "opened") & bad)
    return out if since is None else out.where(F.col("updated_at") >= since)


def releases(raw: DataFrame, cursor: str | None = None) -> DataFrame:
    out = raw.select("project_id", "tag_name", "name", "description", timestamp("released_at").alias("released_at"), F.col("web_url").alias("url")).where("released_at is not null")
    return after(out, F.col("released_at"), cursor)


def notes(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").cast("string").alias("id"), "project_id", "iid", "thread_id", "system", "body", person(F.col("author")).alias("author"), timestamp("created_at").alias("created_at"),
        "resolved", person(F.col("resolved_by")).alias("resolved_by"), timestamp("resolved_at").alias("resolved_at"), T.mentions_at("body").alias("mentions"),
    ).where("created_at is not null")


def with_threads(items: DataFrame, all_notes: DataFrame) -> DataFrame:
    """Items with their threads, for the chunker; an item without notes has none."""
    said = all_notes.where("not coalesce(system, false)")
    c = F.array_sort(F.collect_list(F.struct("created_at", "id", "author", "body")))
    threads = said.groupBy("project_id", "iid", "thread_id").agg(F.bool_or(F.coalesce("resolved", F.lit(False))).alias("resolved"), F.min("created_at").alias("at"), c.alias("c"))
    comments = F.transform("c", lambda x: F.struct(x["author"].alias("author"), x["created_at"].alias("created"), x["body"].alias("body")))
    t = threads.groupBy("project_id", "iid").agg(F.array_sort(F.collect_list(F.struct("at", "thread_id", "resolved", comments.alias("comments")))).alias("t"))
    t = t.select("project_id", "iid", F.transform("t", lambda x: F.struct(x["resolved"].alias("resolved"), x["comments"].alias("comments"))).alias("threads"))
    return items.join(t, ["project_id", "iid"], "left")


def with_links(items: DataFrame, raw: DataFrame | None, kind: str | None = None) -> DataFrame:
    """Items with their links to issues, in their order of arrival ``position``; ``kind`` replaces the links' own type (merge requests: ``closes``).

    Items without links, and all items where the links could not be read
    (``raw`` is None), have an empty list.
    """
    none = F.array().cast("array<struct<type:string,target_kind:string,target_iid:bigint,title:string,url:string>>")
    if raw is None:
        return items.withColumn("links", none)
    order = F.col("position") if "position" in raw.columns else F.lit(0)
    one = F.struct((F.lit(kind) if kind else F.coalesce("link_type", F.lit("relates_to"))).alias("type"), F.lit("issue").alias("target_kind"), "target_iid", "title", F.col("web_url").alias("url"))
    links = raw.groupBy("project_id", "iid").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), one.alias("link")))).alias("l"))
    links = links.select("project_id", "iid", F.transform("l", lambda x: x["link"]).alias("links"))
    return items.join(links, ["project_id", "iid"], "left").withColumn("links", F.coalesce("links", none))


def project_refs(refs: Column) -> Column:
    """Trimmed project ids or paths without blanks, as path parts of a URL; repeats stay."""
    kept = F.filter(F.transform(refs, T.trimmed), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.transform(kept, lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))


def tickets(raw: DataFrame, cursor: str | None = None) -> DataFrame:
    """Tickets, flattened; the assignment dates from the creation if the whole change log never set it."""
    f = F.col("fields")
    log = F.col("changelog.histories")
    whole = F.coalesce(F.col("changelog.total") <= F.size(log), F.lit(False))
    touched = F.filter(F.coalesce(log, F.array().cast("array<struct<id:string,author:struct<accountId:string,name:string,key:string,displayName:string>,created:string,items:array<struct<field:string>>>>")), lambda h: F.exists(h["items"], lambda i: i["field"] == "assignee"))
    newest = F.array_max(F.transform(touched, lambda h: F.struct(ticket_time(h["created"]).alias("at"), ticket_person(h["author"]).alias("by"))))
    created = ticket_time(f["created"])
    born = whole & (F.size(touched) == 0) & f["assignee"].isNotNull()
    out = raw.select(
        "key", f["summary"].alias("summary"), f["description"].alias("description"), f["status"]["name"].alias("status"), f["resolution"]["name"].alias("resolution"),
        created.alias("created_at"), ticket_time(f["updated"]).alias("updated_at"), ticket_time(f["resolutiondate"]).alias("resolved_at"), F.transform(f["components"], lambda c: c["name"]).alias("components"), f["labels"].alias("labels"),
        ticket_person(f["assignee"]).alias("assignee"), f["assignee"]["displayName"].alias("assignee_name"), f["reporter"]["displayName"].alias("reporter"),
        F.coalesce(newest["at"], F.when(born, created)).alias("assigned_at"), newest["by"].alias("assigned_by"),
        F.transform(f["comment"]["comments"], lambda c: F.struct(c["id"].alias("id"), c["author"]["displayName"].alias("author"), ticket_time(c["created"]).alias("created"), c["body"].alias("body"), T.mentions_tilde(c["body"]).alias("mentions"))).alias("comments"),
    )
    return after(out, F.col("updated_at"), cursor, inclusive=True)


def ticket_query_bound(at: Column, tz: str) -> Column:
    """A cursor floored to the minute in the user's time zone, as the tracker's query language wants it."""
    return F.date_format(F.date_trunc("minute", F.from_utc_timestamp(at, tz)), "yyyy-MM-dd HH:mm")


def profile_url(base: str, user: Column) -> Column:
    """A person's page: by account id on hosted sites, by name elsewhere."""
    b = base.rstrip("/")
    return F.when(F.coalesce(user["accountId"], F.lit("")) != "", F.concat(F.lit(b + "/jira/people/"), F.url_encode(user["accountId"]))).otherwise(
        F.concat(F.lit(b + "/secure/ViewProfile.jspa?name="), F.url_encode(ticket_person(user)))
    )


def comment_url(url: Column, comment_id: Column, tickets_: bool = False) -> Column:
    """A link to one comment of an object; empty where the object has no link."""
    if not tickets_:
        return F.when(F.coalesce(url, F.lit("")) != "", F.concat(url, F.lit("#note_"), comment_id)).otherwise("")
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(F.contains(url, F.lit("?")), url).otherwise(F.concat(url, F.lit("?focusedCommentId="), comment_id))


def _time(c) -> Column:
    return F.date_format(T._c(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _said(label: str, text, end: str = "\n\n") -> Column:
    """A labelled paragraph, or nothing for an empty text."""
    return F.when(F.coalesce(T._c(text), F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), T._c(text), F.lit(end))).otherwise("")


def _links(links) -> Column:
    """The related objects of an issue or merge request; nothing if there are none."""
    line = lambda x: F.concat(F.lit("- "), x["type"], F.lit(" #"), x["target_iid"].cast("string"), F.lit(": "), x["title"], F.lit(" ("), x["url"], F.lit(")\n"))
    return F.when(F.coalesce(F.size(T._c(links)), F.lit(0)) > 0, F.concat(F.lit("Related:\n"), F.array_join(F.transform(T._c(links), line), ""), F.lit("\n"))).otherwise("")


def issue_body(iid, title, state, labels, assignees, author, created, updated, description, noun: str = "Issue #%d", links=None, more: tuple = ()) -> Column:
    """A readable rendering of an issue or merge request; ``more`` are labelled lines after the assignees, and after the times a second tuple of them."""
    between, after_ = more or ((), ())
    head = T.labelled_lines(
        ("State", state), ("Labels", F.array_join(T._c(labels), ", ")), ("Assignees", F.array_join(T._c(assignees), ", ")), *between,
        ("Author", author), ("Created", _time(created)), ("Updated", _time(updated)), *after_,
    )
    first = F.format_string(f"GitLab {noun} - %s", T._c(iid), T._c(title))
    return F.concat(F.concat_ws("\n", first, F.nullif(head, F.lit(""))), F.lit("\n\n"), _said("Description", description), F.lit("") if links is None else _links(links))


def merge_request_body() -> Column:
    """The rendering of a merge request, from the columns of ``issues``."""
    draft = F.when(F.coalesce("draft", F.lit(False)), "yes")
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    branch = F.concat(named("source_branch"), F.lit(" -> "), named("target_branch"))
    merged = F.concat(_time("merged_at"), F.lit(" by "), F.coalesce("merged_by", F.lit("")))
    commit = F.when(F.col("merged_at").isNotNull(), F.col("merge_commit_sha"))
    more = ((("Reviewers", F.array_join("reviewers", ", ")), ("Draft", draft), ("Branch", branch)), (("Merged", merged), ("Merge commit", commit)))
    return issue_body("iid", "title", "state", "labels", "assignees", "author", "created_at", "updated_at", "description", "MR !%d", "links", more)


def release_body(tag, name, released, description) -> Column:
    other = F.when(T._c(name) != T._c(tag), T._c(name))
    head = T.labelled_lines(("Name", other), ("Released", _time(released)))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("GitLab Release: "), T._c(tag)), F.nullif(head, F.lit(""))), F.lit("\n\n"), _said("Release Notes", description, "\n"))


def ticket_body() -> Column:
    """The rendering of a ticket, from the columns of ``tickets``."""
    head = T.labelled_lines(
        ("Status", "status"), ("Component", F.array_join("components", ", ")), ("Resolution", "resolution"), ("Created", _time("created_at")), ("Updated", _time("updated_at")),
        ("Resolved", _time("resolved_at")), ("Assignee", "assignee_name"), ("Reporter", "reporter"), ("Labels", F.array_join("labels", ", ")),
    )
    each = F.transform("comments", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(c["author"], F.lit("")), F.lit(" ("), F.coalesce(_time(c["created"]), F.lit("")), F.lit("):\n"), c["body"], F.lit("\n\n")))
    said = F.when(F.coalesce(F.size("comments"), F.lit(0)) > 0, F.concat(F.lit("Comments ("), F.size("comments").cast("string"), F.lit("):\n"), F.array_join(each, ""))).otherwise("")
    first = F.concat(F.lit("Jira: "), "key", F.lit(" - "), F.coalesce("summary", F.lit("")))
    return F.concat(F.concat_ws("\n", first, F.nullif(head, F.lit(""))), F.lit("\n\n"), _said("Description", "description"), said)


def ticket_summary() -> Column:
    head = T.labelled_lines(("Status", "status"), ("Component", F.array_join("components", ", ")), ("Resolution", "resolution"))
    return F.concat_ws("\n", F.concat(F.lit("Jira: "), "key", F.lit(" - "), F.coalesce("summary", F.lit(""))), F.nullif(head, F.lit("")))


def issue_documents(items: DataFrame, project: str, kind: str = "issue") -> DataFrame:
    """Issues or merge requests as documents; the object goes into the metadata as JSON, for the chunker."""
    source, part, noun = {"issue": ("gitlab_issue", "issues", "Issue #%d"), "mr": ("gitlab_mr", "merge_requests", "MR !%d")}[kind]
    items = items if "links" in items.columns else with_links(items, None)
    items = items if "threads" in items.columns else items.withColumn("threads", F.lit(None).cast(THREADS))
    body = merge_request_body() if kind == "mr" else issue_body("iid", "title", "state", "labels", "assignees", "author", "created_at", "updated_at", "description", noun, "links")
    sid = F.concat_ws("/", F.lit(project), F.lit(part), F.col("iid").cast("string"))
    people_ = [("Assignees", F.array_join("assignees", ", ")), *([("Reviewers", F.array_join("reviewers", ", "))] if kind == "mr" else [])]
    summary = F.concat_ws("\n", F.format_string(f"{noun} - %s", "iid", "title"), F.nullif(T.labelled_lines(("State", "state"), ("Labels", F.array_join("labels", ", ")), *people_), F.lit("")))
    out = items.select("*", stable_id(F.lit(source), sid).alias("id"), F.lit(source).alias("source"), sid.alias("source_id"), body.alias("body"), T.body_hash(body).alias("body_hash"), summary.alias("summary"))
    meta = F.create_map(
        F.lit("project"), F.lit(project), F.lit("iid"), F.col("iid").cast("string"), F.lit("state"), F.coalesce("state", F.lit("")), F.lit("authority"), F.lit("medium"),
        F.lit(source), F.to_json(F.struct("iid", "summary", "description", "threads")),
    )
    return out.withColumn("metadata", meta)


def ticket_documents(items: DataFrame, base_url: str = "") -> DataFrame:
    """Tickets as documents; the object goes into the metadata as JSON, for the chunker."""
    project = F.when(F.instr("key", "-") > 1, F.substring_index("key", "-", 1)).otherwise(F.col("key"))
    body = ticket_body()
    comments = F.transform("comments", lambda c: F.struct(c["author"].alias("author"), c["created"].alias("created"), c["body"].alias("body")))
    told = F.to_json(F.struct("key", ticket_summary().alias("summary"), "description", "resolution", comments.alias("comments")))
    meta = F.create_map(
        F.lit("jira_key"), F.col("key"), F.lit("project"), project, F.lit("status"), F.coalesce("status", F.lit("")), F.lit("authority"), F.lit("medium_high"), F.lit("jira_issue"), told,
    )
    return items.select("*", stable_id(F.lit("jira"), "key").alias("id"), F.lit("jira").alias("source"), F.col("key").alias("source_id"), F.col("summary").alias("title"),
                        F.concat(F.lit(f"{base_url.rstrip('/')}/browse/"), "key").alias("url"), body.alias("body"), T.body_hash(body).alias("body_hash"), meta.alias("metadata"))


# Fields of a chat export; ``text`` is a string or an array of strings and objects, so it is read as JSON text.
ENTRY = "id bigint, type string, date string, date_unixtime string, from string, from_id string, reply_to_message_id bigint, text string, text_entities array<struct<type:string,text:string>>"


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    spec = f"id bigint, name string, type string, messages array<struct<{ENTRY.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array<', ':array<').replace(', ', ',')}>>"
    return spark.read.option("multiLine", "true").schema(spec).json(path)


def entry_text(entities: Column, text: Column) -> Column:
    """Entities joined, else the string, else a mixed array's parts joined."""
    joined = F.array_join(F.transform(entities, lambda e: e["text"]), "")
    parts = F.from_json(text, "array<string>")
    mixed = F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)), "")
    return F.coalesce(F.when(F.size(entities) > 0, joined), F.when(F.startswith(F.ltrim(text), F.lit("[")), mixed), text, F.lit(""))


def chat_messages(exports: DataFrame) -> DataFrame:
    """Messages of chat exports; service entries and empty texts are left out."""
    m = exports.select(F.col("id").alias("chat_id"), F.explode("messages").alias("m"))
    return m.where("m.type = 'message'").select(
        "chat_id", F.col("m.id").alias("message_id"), F.lit(None).cast("bigint").alias("thread_id"), T.sender_number(F.col("m.from_id")).alias("sender_id"), F.col("m.from").alias("sender_name"),
        entry_text(F.col("m.text_entities"), F.col("m.text")).alias("text"), chat_time("m.date_unixtime", "m.date").alias("date"), F.nullif(F.col("m.reply_to_message_id"), F.lit(0)).alias("reply_to"),
    ).where(T.trimmed("text") != "")


def history_page(messages: DataFrame, chat: int, min_id: int = 0, offset_id: int | None = None, limit: int = 100) -> DataFrame:
    """One page of a chat's history, newest first, between two ids."""
    m = messages.where((F.col("chat_id") == chat) & (F.col("message_id") > min_id))
    if offset_id:
        m = m.where(F.col("message_id") < offset_id)
    return m.orderBy(F.desc("message_id")).limit(limit)


def cursor_of(states: DataFrame, source: str) -> str | None:
    """The stored cursor of a source; none if there is no row."""
    row = states.where(F.col("source") == source).select("last_cursor").first()
    return row[0] if row and row[0] else None


def usable(raw: DataFrame) -> DataFrame:
    """Comments worth keeping."""
    return raw.where(~P.trivial_comment("body"))


def release_documents(items: DataFrame, project: str) -> DataFrame:
    """Releases as documents; the object goes into the metadata as JSON, for the chunker."""
    sid = F.concat_ws("/", F.lit(project), F.lit("releases"), "tag_name")
    body = release_body("tag_name", "name", "released_at", "description")
    meta = F.create_map(F.lit("project"), F.lit(project), F.lit("tag"), F.col("tag_name"), F.lit("authority"), F.lit("medium_high"), F.lit("gitlab_release"), F.to_json(F.struct("tag_name", "name", "description")))
    return items.select("*", stable_id(F.lit("gitlab_release"), sid).alias("id"), F.lit("gitlab_release").alias("source"), sid.alias("source_id"), F.col("name").alias("title"),
                        body.alias("body"), T.body_hash(body).alias("body_hash"), meta.alias("metadata"))


def live_messages(raw: DataFrame) -> DataFrame:
    """Messages as the chat service delivers them: ``chat_id, id, message, date`` (unix seconds), ``from_id struct<type, id>`` and ``reply_to``.

    The sender of a basic group is its negated number, so it can't be taken for
    a user; without a sender it is 0.
    """
    f = F.col("from_id")
    sender = F.when(f["type"] == "chat", -f["id"]).when(f["type"].isin("user", "channel"), f["id"])
    return raw.select(
        "chat_id", F.col("id").alias("message_id"), F.lit(None).cast("bigint").alias("thread_id"), F.coalesce(sender, F.lit(0)).alias("sender_id"), F.lit("").alias("sender_name"),
        F.coalesce("message", F.lit("")).alias("text"), F.timestamp_seconds("date").alias("date"), F.nullif(F.col("reply_to"), F.lit(0)).alias("reply_to"),
    )
