"""Table schemas and fixed enumerations of the engine's data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


METADATA = "map<string,string>"

SPECS = {
    "documents": f"id string, source string, source_id string, url string, title string, body string, body_hash string, metadata {METADATA}, created_at timestamp, updated_at timestamp, captured_at timestamp",
    "chunks": f"id string, document_id string, chunk_index int, chunk_type string, title string, text string, text_hash string, metadata {METADATA}, point_id string",
    "points": "point_id string, embedding array<float>, payload map<string,string>",
    "queries": "query_id string, text string, service string, filters map<string,string>, source_tier string, source_prefixes array<string>, max_results int",
    "event": "id string, source string, type string, subject struct<id:string,url:string,title:string>, actor struct<key:string,display:string,url:string>, severity string, occurred_at timestamp, attributes map<string,string>, payload string, payload_version int",
    "notify_event": "source string, type string, recipient string, actor struct<source:string,key:string,display:string>, title string, body string, description string, labels array<string>, buttons array<struct<text:string,url:string>>, url string, object_id string, event_id string, occurred_at timestamp",
    "notifications": "id string, dedup_key string, channel string, peer_type string, peer_id bigint, source string, event_type string, text string, url string, status string, attempts int, error string, created_at timestamp, updated_at timestamp",
    "queue_jobs": "id string, queue string, dedup_key string, payload binary, status string, attempts int, max_attempts int, visible_at timestamp, lease_owner string, error string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "subscriptions": "user_id string, source string, event_types array<string>, filters map<string,string>, enabled boolean",
    "users": "id string, telegram_id bigint, gitlab_username string, jira_account string, enabled boolean, created_at timestamp",
    "peers": "peer_type string, peer_id bigint, access_hash bigint, username string, first_name string, last_name string, last_seen timestamp",
    "chats": "peer_type string, peer_id bigint, title string, enabled boolean, added_by bigint, created_at timestamp",
    "messages": "chat_id bigint, message_id bigint, thread_id bigint, sender_id bigint, sender_name string, text string, date timestamp, reply_to bigint",
    "support_requests": "chat_id bigint, first_message_id bigint, last_message_id bigint, raw_text string, summary string, status string, confidence double",
    "sync_states": "source string, last_cursor string, status string, count bigint, updated_at timestamp",
    "investigation_jobs": "id string, idempotency_key string, description string, status string, report string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "comment": "id string, thread_id string, author struct<source:string,key:string>, body string, mentions array<string>, url string, created_at timestamp",
    "alert_webhook": "version string, groupKey string, receiver string, status string, externalURL string, alerts array<struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:timestamp,endsAt:timestamp,generatorURL:string,fingerprint:string>>",
    "commits": "repo string, sha string, author_name string, author_email string, message string, parents int, committed_at timestamp, position bigint",
    "tags": "repo string, name string, target string, annotated boolean, message string, tagged_at timestamp",
}


def schema(name: str) -> T.StructType:
    return _struct(SPECS[name])


# Strings that stored data and events carry.
SOURCES = ("gitlab_issue", "gitlab_mr", "gitlab_release", "jira", "telegram")
SOURCE_PREFIXES = ("git_docs:", "git_commits:", "git_tags:", "git_manifest:", "git_code:", "context_files:")
AUTHORITY_WEIGHTS = {"high": 1.4, "medium_high": 1.25, "medium": 1.1, "low_medium": 1.0, "low": 0.85}
SEVERITY_RANK = {"info": 1, "warning": 2, "critical": 3}
QUEUE_STATUS = ("pending", "running", "done", "error")
OUTBOX_STATUS = ("pending", "delivered", "error")
VERDICTS = ("solved", "known_issue", "needs_investigation", "out_of_scope", "escalate")
JOB_KINDS = ("markdown", "yaml", "code", "git", "gitlab", "jira", "telegram")
