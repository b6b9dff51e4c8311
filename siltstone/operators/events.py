"""Events: normalisation, routing, and projection to recipients.

Canonical events have the schema ``schemas.schema("event")``; payloads are
versioned JSON, and a version that isn't known is put aside, never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import bound
from siltstone.functions import predicates as P
from siltstone.functions import text as T
from siltstone.operators.retrieval import small

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PAYLOAD_VERSION = 1
NEWEST_COMMENTS = 20

# Fields of the payloads.
PERSON = "struct<username:string,name:string>"
COMMENTS = "array<struct<id:string,thread_id:string,author:string,body:string,mentions:array<string>,url:string,created_at:timestamp>>"
PAYLOADS = {
    "mr.updated": f"state string, author string, assignees array<string>, reviewers array<string>, updated_by string, updated_at timestamp, assigned_by string, assigned_at timestamp, review_requested_by string, review_requested_at timestamp, merged_by string, merged_at timestamp, approvals array<struct<username:string,at:timestamp>>, comments {COMMENTS}, threads array<struct<id:string,resolved_by:string,resolved_at:timestamp,participants:array<string>,url:string>>",
    "mr.conflict": "author string, assignees array<string>, sha string, source_branch string, target_branch string",
    "issue.updated": f"assignee string, assigned_by string, assigned_at timestamp, updated_by string, comments {COMMENTS}",
    "alert": "labels map<string,string>, annotations map<string,string>, external_url string, starts_at timestamp, ends_at timestamp",
    "investigation.completed": "job_id string, verdict string, title string, findings string, actions array<string>, links array<struct<text:string,url:string>>",
}


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339)


def with_payload(struct: Column, version: int = PAYLOAD_VERSION) -> list[Column]:
    """A payload as JSON with its version stamp."""
    return [F.to_json(struct).alias("payload"), F.lit(version).alias("payload_version")]


def decoded(events: DataFrame, kind: str, version: int = PAYLOAD_VERSION) -> tuple[DataFrame, DataFrame]:
    """(events with ``p``, the payload decoded; events put aside for their version)."""
    good = events.where(F.col("payload_version") == version).withColumn("p", F.from_json("payload", PAYLOADS[kind]))
    return good, events.where(F.coalesce(F.col("payload_version") != version, F.lit(True)))


def alert_events(webhooks: DataFrame) -> DataFrame:
    """One event for each alert of webhook bodies (column ``value``, JSON)."""
    hook = F.from_json("value", schemas.schema("alert_webhook"))
    rows = webhooks.select(hook.alias("h")).select("h.externalURL", F.explode("h.alerts").alias("a"))
    labels = F.coalesce(F.col("a.labels"), F.create_map().cast("map<string,string>"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    subject = F.coalesce(F.nullif(F.col("a.fingerprint"), F.lit("")), flat)
    resolved = F.col("a.status") == "resolved"
    kind = F.when(resolved, "alert.resolved").otherwise("alert.firing")
    at = F.when(resolved, F.coalesce("a.endsAt", "a.startsAt")).otherwise(F.col("a.startsAt"))
    name, said = labels["alertname"], F.col("a.annotations")["summary"]
    title = F.when((F.coalesce(name, F.lit("")) != "") & (F.coalesce(said, F.lit("")) != ""), F.concat_ws(": ", name, said)).otherwise(
        F.coalesce(F.nullif(name, F.lit("")), F.nullif(said, F.lit("")), F.lit("alert"))
    )
    return rows.select(
        F.concat_ws(":", F.lit("alertmanager"), subject, kind, rfc3339(at)).alias("id"),
        F.lit("alertmanager").alias("source"),
        kind.alias("type"),
        F.struct(subject.alias("id"), F.col("a.generatorURL").alias("url"), title.alias("title")).alias("subject"),
        F.struct(F.lit("").alias("key"), F.lit("").alias("display"), F.lit("").alias("url")).alias("actor"),
        P.severity_of_label(labels["severity"]).alias("severity"),
        at.alias("occurred_at"),
        labels.alias("attributes"),
        *with_payload(F.struct(labels.alias("labels"), F.col("a.annotations"), F.col("externalURL").alias("external_url"), F.col("a.startsAt").alias("starts_at"), F.col("a.endsAt").alias("ends_at"))),
    )


def _event(id_: Column, source: str, kind: str, subject: Column, actor: Column, at: Column, payload: Column) -> list[Column]:
    person = F.struct(F.coalesce(actor, F.lit("")).alias("key"), F.coalesce(actor, F.lit("")).alias("display"), F.lit("").alias("url"))
    none = F.create_map().cast("map<string,string>")
    return [id_.alias("id"), F.lit(source).alias("source"), F.lit(kind).alias("type"), subject.alias("subject"), person.alias("actor"), F.lit("").alias("severity"), at.alias("occurred_at"), none.alias("attributes"), *with_payload(payload)]


def _object(*, url: str = "url", title: str = "title") -> Column:
    return F.struct(F.col("object_id").alias("id"), F.col(url).alias("url"), F.col(title).alias("title"))


def merge_request_events(requests: DataFrame) -> DataFrame:
    """``mr.updated`` events of merge requests ``object_id, title, url`` and the payload's fields."""
    fields = [f.name for f in schemas._struct(PAYLOADS["mr.updated"]).fields]
    id_ = F.concat_ws(":", F.lit("gitlab_mr_update"), "object_id", rfc3339(F.col("updated_at")))
    return requests.select(*_event(id_, "gitlab", "mr.updated", _object(), F.col("updated_by"), F.col("updated_at"), F.struct(*fields)))


def conflict_events(requests: DataFrame, at: Column) -> DataFrame:
    """``mr.conflict`` events; the commit makes the id, so one conflict is one event."""
    fields = [f.name for f in schemas._struct(PAYLOADS["mr.conflict"]).fields]
    id_ = F.concat_ws(":", F.lit("gitlab_mr_conflict"), "object_id", "sha")
    return requests.select(*_event(id_, "gitlab", "mr.conflict", _object(), F.lit(None).cast("string"), at, F.struct(*fields)))


def issue_events(issues: DataFrame) -> DataFrame:
    fields = [f.name for f in schemas._struct(PAYLOADS["issue.updated"]).fields]
    id_ = F.concat_ws(":", F.lit("jira_issue_update"), "object_id", rfc3339(F.col("updated_at")))
    return issues.select(*_event(id_, "jira", "issue.updated", _object(), F.col("updated_by"), F.col("updated_at"), F.struct(*fields)))


def report_events(reports: DataFrame) -> DataFrame:
    """``investigation.completed`` events of reports ``job_id, verdict, title, description, findings, actions, links, completed_at``; actions stay only under verdicts that call for them."""
    title = F.coalesce(F.nullif(T.trimmed("title"), F.lit("")), F.nullif(T.title_line(F.col("description")), F.lit("")), F.lit("Investigation"))
    acts = F.when(P.actionable("verdict"), F.col("actions")).otherwise(F.array().cast("array<string>"))
    rows = reports.withColumn("title", title).withColumn("actions", acts).withColumn("object_id", F.col("job_id")).withColumn("url", F.lit(""))
    fields = [f.name for f in schemas._struct(PAYLOADS["investigation.completed"]).fields]
    return rows.select(*_event(F.concat_ws(":", F.lit("investigation"), "job_id"), "agent", "investigation.completed", _object(), F.lit(None).cast("string"), F.col("completed_at"), F.struct(*fields)))


def newest_by(rows: DataFrame, key: list[str], at: str, tie: list) -> DataFrame:
    """The newest row of each key; of equal times the first by ``tie``."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), *tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def standing_approvals(notes: DataFrame) -> DataFrame:
    """Approvals that still hold: ``object_id, username, at`` where an approver's newest approve or unapprove note approves. Notes: ``object_id, username, body, created_at``."""
    votes = notes.withColumn("_kind", P.system_note_kind("body")).where(F.col("_kind").isin("approved", "unapproved") & (F.coalesce("username", F.lit("")) != ""))
    last = votes.groupBy("object_id", "username").agg(F.max_by(F.struct("_kind", "created_at"), "created_at").alias("v"))
    return last.where("v._kind = 'approved'").select("object_id", "username", F.col("v.created_at").alias("at"))


def newest_notes(notes: DataFrame) -> DataFrame:
    """Newest system note by object and kind: ``object_id, kind, username, at``; a note without an author counts too."""
    kinds = notes.withColumn("kind", P.system_note_kind("body")).where("kind is not null")
    best = newest_by(kinds, ["object_id", "kind"], "created_at", ["id"])
    return best.select("object_id", "kind", "username", F.col("created_at").alias("at"))


def thread_states(notes: DataFrame) -> DataFrame:
    """Threads of notes ``object_id, thread_id, resolved, resolved_by, resolved_at``: resolved if any note is; the newest resolution counts, of equal times the last by name."""
    return notes.groupBy("object_id", "thread_id").agg(
        F.bool_or(F.coalesce("resolved", F.lit(False))).alias("resolved"),
        F.max(F.when(F.col("resolved") & F.col("resolved_at").isNotNull(), F.struct("resolved_at", "resolved_by"))).alias("_last"),
    ).select("object_id", "thread_id", "resolved", F.col("_last.resolved_by").alias("resolved_by"), F.col("_last.resolved_at").alias("resolved_at"))


def newest_comments(comments: DataFrame, key: str, at: str, tie: str, k: int = NEWEST_COMMENTS) -> DataFrame:
    """The k newest comments of each object; Spark drops the others before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return comments.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def routed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every event with every subscription that takes its source and type; empty lists take all.

    Subscriptions: ``name, sources, types``. Their lists become keys with open
    places, and each event looks for the four keys that can take it, so it is an
    equi-join however many subscriptions there are; an event meets a
    subscription once.
    """
    none = F.array(F.lit(None).cast("string"))

    def keys(c: str) -> Column:
        listed = F.coalesce(F.size(c), F.lit(0)) > 0
        return F.when(listed, F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(False).alias("any"), x.alias("key")))).otherwise(F.transform(none, lambda x: F.struct(F.lit(True).alias("any"), x.alias("key"))))

    s = subscriptions.select("name", F.explode(keys("sources")).alias("_s"), keys("types").alias("_t")).select("name", "_s", F.explode("_t").alias("_t"))
    s = s.select("name", F.struct("_s", "_t").alias("_want"))
    place = lambda c, open_: F.struct(F.lit(open_).alias("any"), (F.lit(None).cast("string") if open_ else F.col(c)).alias("key"))
    wants = F.array(*(F.struct(place("source", a).alias("_s"), place("type", b).alias("_t")) for a in (False, True) for b in (False, True)))
    asked = events.withColumn("_want", F.explode(wants))
    return asked.join(small(s).withColumnRenamed("_want", "_has"), F.col("_want").eqNullSafe(F.col("_has"))).select(*(asked[c] for c in events.columns), "name")


# Projection: event -> addressed notifications.


_NOTES = "array<struct<source:string,type:string,recipient:string,actor:struct<source:string,key:string,display:string>,title:string,body:string,description:string,said:string,labels:array<string>,buttons:array<struct<text:string,url:string>>,url:string,object_id:string,event_id:string,occurred_at:timestamp>>"


def _note(kind, recipient: Column, actor_source: str, actor: Column, event_id: Column, at: Column, description: Column | None = None, said: Column | None = None, labels: Column | None = None, buttons: Column | None = None, url: Column | None = None, body: Column | None = None) -> Column:
    """A note of its row's event; ``said`` is a comment, whose snippet becomes the description."""
    who = F.struct(F.lit(actor_source).alias("source"), F.coalesce(actor, F.lit("")).alias("key"), F.coalesce(actor, F.lit("")).alias("display"))
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(actor_source).alias("source"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), recipient.alias("recipient"), who.alias("actor"),
        F.col("subject.title").alias("title"), (F.lit("") if body is None else body).alias("body"),
        (description if description is not None else F.lit("") if said is None else none).alias("description"), (none if said is None else said).alias("said"),
        (F.array().cast("array<string>") if labels is None else labels).alias("labels"),
        (F.array().cast("array<struct<text:string,url:string>>") if buttons is None else buttons).alias("buttons"),
        (F.col("subject.url") if url is None else url).alias("url"), F.col("subject.id").alias("object_id"), event_id.alias("event_id"), at.cast("timestamp").alias("occurred_at"),
    )


def _each(rows: Column, note, when: Column | None = None) -> Column:
    """The notes of an array's entries, none where ``when`` doesn't hold."""
    told = rows.isNotNull() if when is None else when & rows.isNotNull()
    return F.when(told, F.transform(rows, note)).otherwise(F.array().cast(_NOTES))


def _emitted(events: DataFrame, *notes: Column) -> DataFrame:
    """The notes of each event, in one pass over the events."""
    out = events.select(F.explode(F.concat(*notes)).alias("_n")).select("_n.*")
    return out.withColumn("description", F.coalesce("description", T.comment_snippet("said"))).drop("said")


def _people(*arrays: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(a, none) for a in arrays)), lambda x: F.coalesce(x, F.lit("")) != ""))


def _id(prefix: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def _comment_notes(comments: Column, watchers: Column, prefix: str, source: str, now: Column, max_age: int) -> Column:
    def note(c: Column, to: Column, kind: str) -> Column:
        url = F.coalesce(F.nullif(c["url"], F.lit("")), F.col("subject.url"))
        return _note(f"{prefix}_{kind}", to, source, c["author"], _id(f"{prefix}_{kind}", "subject.id", c["id"], to), c["created_at"], said=c["body"], url=url)

    def named(c: Column) -> Column:
        return _each(F.filter(F.array_distinct(c["mentions"]), lambda to: to != ""), lambda to: note(c, to, "mentioned"))

    def newest(placed: Column, to: Column) -> Column:
        """Each thread's last comment by another: of those in order of threads and places, the ones that another thread follows."""
        others = F.filter(placed, lambda x: to != F.coalesce(x["c"]["author"], F.lit("")))
        silent = lambda x: ~F.coalesce(F.array_contains(x["c"]["mentions"], to), F.lit(False))
        lasts = bound(others, lambda p: F.filter(p, lambda x, i: ((i + 1 == F.size(p)) | ~F.get(p, i + 1)["thread"].eqNullSafe(x["thread"])) & silent(x)))
        return _each(lasts, lambda x: note(x["c"], to, "commented"))

    fresh = F.filter(F.coalesce(comments, F.from_json(F.lit("[]"), COMMENTS)), lambda c: (F.coalesce(c["id"], F.lit("")) != "") & P.fresh(c["created_at"], now, max_age))
    people = F.filter(F.array_distinct(F.coalesce(watchers, F.array().cast("array<string>"))), lambda to: to.isNotNull())
    placed = F.sort_array(F.transform(fresh, lambda c, i: F.struct(c["thread_id"].alias("thread"), i.alias("at"), c.alias("c"))))
    return bound(placed, lambda live: F.concat(F.flatten(F.transform(live, lambda x: named(x["c"]))), F.flatten(F.transform(people, lambda to: newest(live, to)))))


def comment_notes(rows: DataFrame, comments: Column, watchers: Column, prefix: str, source: str, now: Column, max_age: int) -> DataFrame:
    """Mentions for each comment, and for each thread and watcher the newest comment by another; a mention there makes the comment note needless.

    A row is an event with all its comments, so nothing is shuffled.
    """
    return _emitted(rows, _comment_notes(comments, watchers, prefix, source, now, max_age))


def _merge_request_notes(p: Column, now: Column, max_age: int) -> list[Column]:
    mine = _people(F.array(p["author"]), p["assignees"])
    watch = _people(F.array(p["author"]), p["assignees"], p["reviewers"])
    o = "subject.id"

    def assigned(u: Column) -> Column:
        return _note("mr_assigned", u, "gitlab", p["assigned_by"], _id("gitlab_mr_assign", o, u), F.coalesce(p["assigned_at"], "occurred_at"))

    def review(u: Column) -> Column:
        return _note("mr_review_requested", u, "gitlab", p["review_requested_by"], _id("gitlab_mr_review", o, u), F.coalesce(p["review_requested_at"], "occurred_at"))

    def merged(u: Column) -> Column:
        return _note("mr_merged", u, "gitlab", p["merged_by"], _id("gitlab_mr_merged", o, u), F.coalesce(p["merged_at"], "occurred_at"))

    def approved(a: Column) -> Column:
        return _each(mine, lambda u: _note("mr_approved", u, "gitlab", a["username"], _id("gitlab_mr_approved", o, a["username"], u), a["at"]))

    def resolved(t: Column) -> Column:
        others = F.filter(_people(t["participants"], F.array(p["author"])), lambda u: u != F.coalesce(t["resolved_by"], F.lit("")))
        return _each(others, lambda u: _note("mr_thread_resolved", u, "gitlab", t["resolved_by"], _id("gitlab_mr_thread_resolved", o, t["id"], u), t["resolved_at"]))

    votes = F.filter(p["approvals"], lambda a: (F.coalesce(a["username"], F.lit("")) != "") & P.fresh(a["at"], now, max_age))
    solved = F.filter(p["threads"], lambda t: t["resolved_at"].isNotNull() & P.fresh(t["resolved_at"], now, max_age))
    none = F.array().cast(_NOTES)
    return [
        _each(_people(p["assignees"]), assigned, P.fresh(p["assigned_at"], now, max_age)),
        _each(_people(p["reviewers"]), review, P.fresh(p["review_requested_at"], now, max_age)),
        _each(mine, merged, (p["state"] == "merged") & P.fresh(p["merged_at"], now, max_age)),
        F.coalesce(F.flatten(F.transform(votes, approved)), none),
        F.coalesce(F.flatten(F.transform(solved, resolved)), none),
        _comment_notes(p["comments"], watch, "mr", "gitlab", now, max_age),
    ]


def project_merge_requests(events: DataFrame, now: Column, max_age: int = 0) -> DataFrame:
    """All notes of ``mr.updated`` events."""
    e, _ = decoded(events.where("type = 'mr.updated'"), "mr.updated")
    return _emitted(e, *_merge_request_notes(F.col("p"), now, max_age))


def _conflict_notes(p: Column) -> list[Column]:
    branch, into = F.nullif(p["source_branch"], F.lit("")), F.coalesce(F.nullif(p["target_branch"], F.lit("")), F.lit("the target branch"))
    said = F.concat(F.coalesce(F.concat(branch, F.lit(" can no longer be merged into ")), F.lit("Cannot be merged into ")), into, F.lit(": rebase or resolve the conflicts."))
    return [_each(_people(F.array(p["author"]), p["assignees"]), lambda u: _note("mr_conflict", u, "gitlab", F.lit(None).cast("string"), _id("gitlab_mr_conflict", "subject.id", p["sha"], u), F.col("occurred_at"), description=said))]


def project_conflicts(events: DataFrame) -> DataFrame:
    e, _ = decoded(events.where("type = 'mr.conflict'"), "mr.conflict")
    return _emitted(e, *_conflict_notes(F.col("p")))


def _issue_notes(p: Column, now: Column, max_age: int) -> list[Column]:
    given = _each(_people(F.array(p["assignee"])), lambda u: _note("issue_assigned", u, "jira", p["assigned_by"], _id("jira_assign", "subject.id", u), F.coalesce(p["assigned_at"], "occurred_at")), P.fresh(p["assigned_at"], now, max_age))
    return [given, _comment_notes(p["comments"], _people(F.array(p["assignee"])), "issue", "jira", now, max_age)]


def project_issues(events: DataFrame, now: Column, max_age: int = 0) -> DataFrame:
    e, _ = decoded(events.where("type = 'issue.updated'"), "issue.updated")
    return _emitted(e, *_issue_notes(F.col("p"), now, max_age))


# Labels that a message shows, in this order.
LABELS_SHOWN = ("severity", "service", "namespace", "cluster", "instance")


def _annotated(notes: Column, word: str, text: str) -> Column:
    found = F.array_sort(F.filter(F.map_entries(notes), lambda e: F.contains(F.lower(e["key"]), F.lit(word)) & (e["value"] != "")))
    return F.transform(found, lambda e: F.struct(F.lit(text).alias("text"), e["value"].alias("url")))


def _alert_notes(p: Column) -> list[Column]:
    labels = F.filter(F.array(*(F.concat(F.lit(f"{k}="), F.nullif(p["labels"][k], F.lit(""))) for k in LABELS_SHOWN)), lambda x: x.isNotNull())
    notes = F.coalesce(p["annotations"], F.create_map().cast("map<string,string>"))
    outside = F.when(F.coalesce(p["external_url"], F.lit("")) != "", F.array(F.struct(F.lit("Alertmanager").alias("text"), p["external_url"].alias("url"))))
    none = F.array().cast("array<struct<text:string,url:string>>")
    buttons = F.concat(_annotated(notes, "runbook", "Runbook"), _annotated(notes, "dashboard", "Dashboard"), F.coalesce(outside, none))
    kind = F.when(F.col("type") == "alert.firing", "alert_firing").otherwise("alert_resolved")
    return [F.array(_note(kind, F.lit(""), "alerts", F.lit(None).cast("string"), F.col("id"), F.col("occurred_at"), description=T.trimmed(F.coalesce(notes["description"], F.lit(""))), labels=labels, buttons=buttons))]


def project_alerts(events: DataFrame) -> DataFrame:
    """Alert notes for broadcast; their recipient is empty."""
    e, _ = decoded(events.where("type in ('alert.firing', 'alert.resolved')"), "alert")
    return _emitted(e, *_alert_notes(F.col("p")))


MAX_FINDINGS = 700


def _report_notes(p: Column) -> list[Column]:
    found = T.trimmed(F.coalesce(p["findings"], F.lit("")))
    found = F.when(F.char_length(found) > MAX_FINDINGS, F.concat(T.trimmed(F.substring(found, 1, MAX_FINDINGS)), F.lit("…"))).otherwise(found)
    acts = F.filter(F.transform(F.coalesce(p["actions"], F.array().cast("array<string>")), T.trimmed), lambda a: a != "")
    lines = F.concat(
        F.array(F.concat(F.lit("Verdict: "), F.nullif(p["verdict"], F.lit(""))), F.nullif(found, F.lit(""))), F.transform(acts, lambda a: F.concat(F.lit("- "), a))
    )
    body = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "  \n")
    return [F.array(_note("investigation_completed", F.lit(""), "agent", F.lit(None).cast("string"), F.col("id"), F.col("occurred_at"), body=body, buttons=links(p["links"])))]


def project_reports(events: DataFrame) -> DataFrame:
    """Investigation notes for broadcast: verdict, findings up to 700 characters, and actions."""
    e, _ = decoded(events.where("type = 'investigation.completed'"), "investigation.completed")
    return _emitted(e, *_report_notes(F.col("p")))


def links(col: Column, k: int = 6) -> Column:
    """Valid links, the first of each URL, at most k."""
    none = F.array().cast("array<struct<text:string,url:string>>")
    good = F.filter(F.coalesce(col, none), lambda x: P.valid_link(x["text"], x["url"]))
    firsts = F.filter(good, lambda x, i: ~F.exists(F.slice(good, F.lit(1), i), lambda y: y["url"] == x["url"]))
    return F.slice(firsts, 1, k)


def project(events: DataFrame, now: Column, max_age: int = 0) -> DataFrame:
    """All notes of a batch or micro-batch of events, each read and decoded once."""
    known = {
        "mr.updated": (["mr.updated"], lambda p: _merge_request_notes(p, now, max_age)),
        "mr.conflict": (["mr.conflict"], _conflict_notes),
        "issue.updated": (["issue.updated"], lambda p: _issue_notes(p, now, max_age)),
        "alert": (["alert.firing", "alert.resolved"], _alert_notes),
        "investigation.completed": (["investigation.completed"], _report_notes),
    }
    told, notes = [], []
    for i, (kind, (types, of)) in enumerate(known.items()):
        here = F.col("type").isin(*types) & (F.col("payload_version") == PAYLOAD_VERSION)
        told.append(F.when(here, F.from_json("payload", PAYLOADS[kind])).alias(f"_p{i}"))
        notes.append(F.when(here, F.concat(*of(F.col(f"_p{i}")))).otherwise(F.array().cast(_NOTES)))
    return _emitted(events.select("*", *told), *notes)


def investigations(events: DataFrame, floor: str | None = None) -> DataFrame:
    """Events over a severity floor as investigation jobs: ``idempotency_key, description``."""
    title = F.coalesce(F.concat(F.lit(" — "), F.nullif(F.col("subject.title"), F.lit(""))), F.lit(""))
    first = F.concat(F.lit("Investigate this "), "source", F.lit(" event: "), "type", title, F.lit("."))
    facts = T.labelled_lines(("Severity", "severity"), ("Occurred at", rfc3339(F.col("occurred_at"))), ("Source URL", F.col("subject.url")))
    attributes = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    listed = F.when(F.size(attributes) > 0, F.concat(F.lit("Attributes:\n"), F.array_join(attributes, "\n")))
    said = F.concat(F.concat_ws("\n", first, F.nullif(facts, F.lit("")), listed), F.lit("\n"))
    return events.where(P.over_floor("severity", floor)).select(F.col("id").alias("idempotency_key"), said.alias("description"))

