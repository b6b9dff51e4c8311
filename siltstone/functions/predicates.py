"""Filters as column expressions, so they reach the scan where Catalyst can push them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import as_column as _c
from siltstone.functions.text import extension, trimmed
from siltstone.schemas import SEVERITY_RANK

# File kinds by extension, and paths that are left out.
DOC_EXTENSIONS = (".md", ".markdown", ".mdx", ".mkd", ".mkdn", ".mdown", ".rst", ".adoc", ".asciidoc")
MANIFEST_EXTENSIONS = (".yaml", ".yml")
CODE_EXTENSIONS = (".go", ".ts", ".tsx", ".proto", ".sql")
SKIPPED_DIRS = ("node_modules", "vendor", "dist", "build", "coverage", ".git", "_out", "_oas", "_hack")
DEFAULT_EXCLUDES = (
    "CLAUDE.md", "**/CLAUDE.md", ".github/**", ".gitlab/**", "LICENSE", "LICENSE.*", "**/LICENSE", "**/LICENSE.*",
    "**/*.pb.go", "**/*_gen.go", "**/*.gen.go", "**/zz_generated*.go", "**/mock_*.go", "**/*.gen.ts", "**/routeTree.gen.ts",
    "**/kafka-op.yml", "**/cnpg.yaml", "**/gotk-components.yaml", "**/crd/**", "**/*dashboards*.yml",
)
BOT_WORDS = ("bot", "noreply", "dependabot", "renovate")
TRIVIAL_COMMENTS = ("ok", "done", "+1")

# Source prefixes of each tier; None is no restriction.
TIERS: dict[str, tuple[str, ...] | None] = {
    "curated": ("context_files:", "git_docs:", "git_manifest:", "jira", "gitlab_issue", "gitlab_mr", "gitlab_release"),
    "code": ("git_code:", "git_manifest:"),
    "history": ("git_commits:", "git_tags:", "gitlab_issue", "gitlab_mr", "telegram"),
    "all": None,
}

MAX_FILE_BYTES, MAX_YAML_BYTES, MAX_CONTENT_BYTES = 256 * 1024, 64 * 1024, 1024 * 1024


def tier_prefixes(tier: str | None = None, explicit=(), filters: dict[str, str] | None = None) -> tuple[str, ...] | None:
    """Prefixes that a query may see: a source filter lifts them, explicit ones replace the tier, unknown tiers are curated."""
    if filters and filters.get("source"):
        return None
    if explicit:
        return tuple(explicit)
    return TIERS.get(tier or "curated", TIERS["curated"])


def source_matches(source, prefixes) -> Column:
    """No prefixes: all. A prefix that ends in ``:`` matches by start, another the whole source."""
    if not prefixes:
        return F.lit(True)
    s = _c(source)
    exact = [p for p in prefixes if not p.endswith(":")]
    tests = [F.startswith(s, F.lit(p)) for p in prefixes if p.endswith(":")]
    return reduce(or_, [*tests, *([s.isin(*exact)] if exact else [])])


def metadata_matches(metadata, filters: dict[str, str], service: str | None = None) -> Column:
    """All given keys have these string values."""
    want = dict(filters) | ({"service": service} if service else {})
    test = F.lit(True)
    for k in sorted(want):
        test = test & F.coalesce(_c(metadata)[k] == want[k], F.lit(False))
    return test


def by_bot(name, email) -> Column:
    text = F.lower(F.concat_ws(" ", _c(name), _c(email)))
    return reduce(or_, [F.contains(text, F.lit(w)) for w in BOT_WORDS])


def trivial_subject(subject) -> Column:
    return F.lower(trimmed(F.coalesce(_c(subject), F.lit("")))).rlike(r"^$|^\.{3}$|^-+$|^wip")


def file_kind(path, manifests: bool = True, code: bool = True) -> Column:
    """``doc``, ``manifest``, ``code`` or null."""
    e = extension(path)
    out = F.when(e.isin(*DOC_EXTENSIONS), "doc")
    if manifests:
        out = out.when(e.isin(*MANIFEST_EXTENSIONS), "manifest")
    if code:
        out = out.when(e.isin(*CODE_EXTENSIONS), "code")
    return out


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` don't, ``{a,b}`` are choices."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out.append("[" + pattern[i + 1 : j].replace("!", "^", 1) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(path, patterns) -> Column:
    """Whether the path matches one of the patterns."""
    return _c(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def selected_path(path, include=(), exclude=(), defaults: bool = True) -> Column:
    """Not excluded, and included by some pattern where there are any."""
    out = ~any_glob(path, (*(DEFAULT_EXCLUDES if defaults else ()), *exclude))
    return out & any_glob(path, include) if include else out


def in_skipped_dir(path) -> Column:
    """A directory of the path is never descended into."""
    return _c(path).rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")


def url_allowed(url, method, patterns, methods=("GET",)) -> Column:
    """An http(s) URL with a host that matches a pattern, by an allowed method; no patterns allow nothing."""
    u = _c(url)
    shape = u.rlike(r"^https?://[^/?#\s]+")
    return F.coalesce(shape & any_glob(u, patterns) & F.upper(F.coalesce(F.nullif(_c(method), F.lit("")), F.lit("GET"))).isin(*methods), F.lit(False))


def within_bytes(body, n: int = MAX_FILE_BYTES) -> Column:
    return F.octet_length(_c(body)) <= n


def generated_code(body) -> Column:
    first = F.split(_c(body), "\n")[0]
    return F.contains(first, F.lit("Code generated")) & F.contains(first, F.lit("DO NOT EDIT"))


def rendered_chart(body) -> Column:
    return _c(body).rlike(r"^\s*# Source:")


def trivial_comment(body) -> Column:
    return trimmed(body).isin(*TRIVIAL_COMMENTS)


def unchanged_document(old_hash, new_hash, old_url, new_url, old_version, new_version) -> Column:
    """Same body, link and chunker version; title and other metadata don't count."""
    return _c(old_hash).eqNullSafe(_c(new_hash)) & _c(old_url).eqNullSafe(_c(new_url)) & _c(old_version).eqNullSafe(_c(new_version))


def subscription_matches(values, value) -> Column:
    """An empty or absent list matches everything."""
    return F.coalesce(F.size(_c(values)), F.lit(0)).isin(0, -1) | F.array_contains(_c(values), _c(value))


def severity_rank(severity) -> Column:
    """Unset severities rank over critical."""
    s = F.lower(F.coalesce(_c(severity), F.lit("")))
    out = F.lit(4)
    for k, v in SEVERITY_RANK.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def over_floor(severity, floor: str | None) -> Column:
    return F.lit(True) if not floor else severity_rank(severity) >= SEVERITY_RANK[floor]


def severity_of_label(label) -> Column:
    s = F.lower(trimmed(F.coalesce(_c(label), F.lit(""))))
    return (
        F.when(s.isin("critical", "fatal", "page"), "critical")
        .when(s.isin("warning", "warn", "major", "minor"), "warning")
        .when(s.isin("info", "informational", "none"), "info")
        .otherwise("")
    )


def fresh(at, now, max_age_seconds: int = 0) -> Column:
    """Unknown times are fresh; age 0 stands for a day, a negative one for ever; the bound is included."""
    if max_age_seconds < 0:
        return F.lit(True)
    age = max_age_seconds or 24 * 3600
    return _c(at).isNull() | (F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(_c(at).cast("timestamp")) <= age * 1_000_000)


def self_caused(actor_source, actor_key, recipient_source, recipient_key) -> Column:
    s, k = F.coalesce(_c(actor_source), F.lit("")), F.coalesce(_c(actor_key), F.lit(""))
    return (s != "") & (k != "") & (s == _c(recipient_source)) & (k == _c(recipient_key))


def valid_link(text, url) -> Column:
    """A text, and an http(s) URL with a host."""
    return F.coalesce((trimmed(text) != "") & _c(url).rlike(r"^https?://[^/?#\s:@]+"), F.lit(False))


def valid_button(text, url) -> Column:
    """A link whose host has a dot."""
    return valid_link(text, url) & F.coalesce(_c(url).rlike(r"^https?://[^/?#\s]*\.[^/?#\s]"), F.lit(False))


def unbound(chunk_id, point_id) -> Column:
    return ~_c(chunk_id).eqNullSafe(_c(point_id))


def system_note_kind(body) -> Column:
    """``assigned``, ``review_requested``, ``approved``, ``unapproved`` or null."""
    # The texts of system notes.
    b = _c(body)
    return (
        F.when(b.rlike("^(requested review from |removed review request for )"), "review_requested")
        .when(b.rlike("^(assigned to |unassigned )| and assigned "), "assigned")
        .when(b == "unapproved this merge request", "unapproved")
        .when(b == "approved this merge request", "approved")
    )


def assigned_at_creation(complete, items) -> Column:
    """The change log is whole and never set an assignee."""
    return _c(complete) & ~F.exists(_c(items), lambda i: i == "assignee")


def actionable(verdict) -> Column:
    # Verdicts that call for actions.
    return _c(verdict).isin("solved", "known_issue", "needs_investigation")


def safe_path(path) -> Column:
    """Relative, and no part of it climbs up."""
    return ~_c(path).rlike(r"^/|(^|/)\.\.(/|$)|\\|\x00") & (_c(path) != "")


def command_parts(text) -> Column:
    """``/name@bot rest`` as a struct (name, rest); null for other texts."""
    t = _c(text)
    name = F.regexp_extract(t, r"^/([A-Za-z0-9_]+)(?:@[A-Za-z0-9_]+)?(?:\s|$)", 1)
    rest = trimmed(F.regexp_extract(t, r"(?s)^/[A-Za-z0-9_]+(?:@[A-Za-z0-9_]+)?\s+(.*)$", 1))
    return F.when(name != "", F.struct(F.lower(name).alias("name"), rest.alias("rest")))


def allowed_peer(peer, allowed) -> Column:
    """No list allows nobody."""
    return _c(peer).isin(*allowed) if allowed else F.lit(False)
