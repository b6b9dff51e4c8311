"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import as_column as _c

# The Unicode white space that trimming removes, as a pattern and as characters.
SPACE = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(_c(text), F.lit(SPACES))


def body_hash(text) -> Column:
    """SHA-256 in hex of the text with LF line ends and trimmed."""
    return F.sha2(trimmed(F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))), 256)


def collapsed(text) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


def content_key(text_hash, text) -> Column:
    """``hash:`` and the text's hash; without one ``text:`` and the hash of the lower-case collapsed text; null if that is empty."""
    flat = collapsed(F.lower(_c(text)))
    return F.when(F.coalesce(_c(text_hash), F.lit("")) != "", F.concat(F.lit("hash:"), _c(text_hash))).when(
        F.coalesce(flat, F.lit("")) != "", F.concat(F.lit("text:"), F.sha2(flat, 256))
    )


def tokens(text) -> Column:
    """Lower-case runs of letters and digits, two characters at least, with repeats."""
    words = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: F.char_length(w) >= 2)


def query_tokens(text) -> Column:
    """Distinct tokens in order of first appearance."""
    return F.array_distinct(tokens(text))


def haystack(title, text, *extra) -> Column:
    """What specificity searches: title, text and metadata words, in lower case."""
    return F.lower(F.concat_ws(" ", _c(title), _c(text), *map(_c, extra)))


def heading_level(line) -> Column:
    """1 to 6 for a Markdown heading at column 0, else null."""
    n = F.char_length(F.regexp_extract(_c(line), r"^(#{1,6})[ \t]", 1))
    return F.when(n > 0, n)


def paragraphs(body) -> Column:
    """Blocks between blank lines, without empty ones."""
    parts = F.split(trimmed(body), r"\n(?:[ \t]*\n)+")
    return F.filter(parts, lambda p: trimmed(p) != "")


def first_heading(body, path) -> Column:
    """The first level-1 heading, else the file name without its extension."""
    h = trimmed(F.regexp_extract(_c(body), r"(?m)^\s*# (.*)$", 1))
    return F.when(h != "", h).otherwise(file_stem(path))


def file_stem(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def extension(path) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))


# Languages by file extension.
LANGUAGES = {
    ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".proto": "protobuf", ".sql": "sql",
    ".md": "markdown", ".yaml": "yaml", ".yml": "yaml",
}


def language_of(path) -> Column:
    e = extension(path)
    out = F.lit("")
    for k, v in LANGUAGES.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def truncated(text, n: int, mark: str = " …") -> Column:
    """The first n characters and a mark; shorter texts as they are."""
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def title_line(text, n: int = 60) -> Column:
    """The first line, cut at n characters with three dots."""
    return truncated(trimmed(F.split(_c(text), "\n")[0]), n, "...")


def snippet(text, n: int = 300) -> Column:
    """At most n characters, trimmed on the right, then an ellipsis if cut."""
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.regexp_replace(F.substring(t, 1, n), f"{SPACE}+$", ""), F.lit("…"))).otherwise(t)


def comment_snippet(body, n: int = 280) -> Column:
    """Non-blank lines with single spaces, joined by hard breaks; over n characters cut at the last space before n."""
    lines = F.transform(F.split(_c(body), "\n"), collapsed)
    flat = F.array_join(F.filter(lines, lambda x: x != ""), "  \n")
    head = F.substring(flat, 1, n)
    cut = F.regexp_replace(head, r"(?s)^(.+) .*$", "$1")
    return F.when(F.char_length(flat) > n, F.concat(F.regexp_replace(cut, f"{SPACE}+$", ""), F.lit("…"))).otherwise(flat)


def summary(text, sentences: int = 3, n: int = 500) -> Column:
    """Leading sentences within both limits, then a mark if any text is left out.

    A sentence that would pass the length limit is left out whole; an ellipsis
    stands for it before the mark.
    """
    flat = collapsed(text)
    found = F.regexp_extract_all(flat, F.lit(r"[^.!?]*[.!?]+"), F.lit(0))
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("over"))

    def step(acc: Column, s: Column) -> Column:
        over = acc["over"] | (F.char_length(acc["said"]) + F.char_length(s) > n)
        return F.struct(F.when(over, acc["said"]).otherwise(F.concat(acc["said"], s)).alias("said"), over.alias("over"))

    def finish(acc: Column) -> Column:
        said = acc["said"]
        room = F.when(F.char_length(said) < n, F.lit("…")).otherwise("")
        return F.when(acc["over"], F.concat(said, room, F.lit(" …"))).when(F.char_length(said) < F.char_length(flat), F.concat(said, F.lit(" …"))).otherwise(said)

    return F.aggregate(F.slice(found, 1, sentences), start, step, finish)


def line_slice(body, start, end) -> Column:
    """Lines start to end, counted from 1, both included and clamped to the text; 0 leaves a side open."""
    lines = F.split(_c(body), "\n")
    n = F.size(lines)
    a = F.greatest(F.when(_c(start) > 0, _c(start)).otherwise(F.lit(1)), F.lit(1))
    b = F.least(F.when(_c(end) > 0, _c(end)).otherwise(n), n)
    return F.when(a > b, F.lit("")).otherwise(F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n"))


def line_anchor(start, end) -> Column:
    return F.format_string("#L%d-%d", _c(start), _c(end))


def escape_markdown(text) -> Column:
    """A backslash before all ASCII punctuation."""
    return F.regexp_replace(_c(text), r"([!-/:-@\[-`{-~])", r"\\$1")


def hard_breaks(text) -> Column:
    """Paragraphs between blank lines, whose lines end in hard breaks; fenced code stays as it is and empty paragraphs go."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("para"), none.alias("fence"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["para"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["para"]))

    def step(acc: Column, line: Column) -> Column:
        mark = F.startswith(F.trim(line), F.lit("```"))
        inside = acc["fence"].isNotNull()
        grown = F.concat(acc["fence"], F.lit("\n"), line)
        clean = F.regexp_replace(line, r"[ \t]+$", "")
        blank = clean == ""
        out = F.when(inside & mark, F.array_append(acc["out"], grown)).when(inside, acc["out"]).when(mark | blank, flushed(acc)).otherwise(acc["out"])
        para = F.when(inside, acc["para"]).when(mark | blank, F.lit("")).when(acc["para"] == "", clean).otherwise(F.concat(acc["para"], F.lit("  \n"), clean))
        fence = F.when(inside & mark, none).when(inside, grown).when(mark, line)
        return F.struct(out.alias("out"), para.alias("para"), fence.alias("fence"))

    def finish(acc: Column) -> Column:
        kept = F.when(acc["fence"].isNotNull(), F.array_append(acc["out"], acc["fence"])).otherwise(flushed(acc))
        return F.array_join(kept, "\n\n")

    return F.aggregate(F.split(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), "\n"), start, step, finish)


def mentions_at(body) -> Column:
    """Names after ``@`` that no word, address or path holds; trailing ``._-`` go; distinct, in order."""
    found = F.regexp_extract_all(_c(body), F.lit(r"(?:^|[^\w@./-])@([a-zA-Z0-9][a-zA-Z0-9._-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"[._-]+$", "")))


def mentions_tilde(body) -> Column:
    """Ids in ``[~id]`` and ``[~accountid:id]``; distinct, in order."""
    found = F.regexp_extract_all(_c(body), F.lit(r"\[~(?:accountid:)?([^\]\s]+)\]"), F.lit(1))
    return F.array_distinct(found)


def sender_number(sender) -> Column:
    """The number in ``user12``, ``channel12`` or ``chat12``; 0 if there is none."""
    return F.coalesce(F.try_to_number(F.regexp_replace(_c(sender), "^(user|channel|chat)", ""), F.lit("9999999999999999999")).cast("long"), F.lit(0))


def spreadsheet_id(ref) -> Column:
    """The id in a spreadsheet URL, or the reference itself."""
    got = F.regexp_extract(_c(ref), r"/spreadsheets/d/([a-zA-Z0-9_-]+)", 1)
    return F.when(got != "", got).otherwise(trimmed(ref))


def safe_dir_name(name) -> Column:
    return F.regexp_replace(_c(name), r"[^a-zA-Z0-9._-]+", "_")


def redacted_url(url) -> Column:
    """A URL without its user information."""
    return F.regexp_replace(_c(url), r"^([a-zA-Z][\w+.-]*://)[^/@]*@", "$1")


def repository_name(url) -> Column:
    """The last path part of a repository URL, without ``.git``."""
    return F.regexp_extract(F.regexp_replace(_c(url), r"(\.git)?/*$", ""), r"([^/:]+)$", 1)


def cleaned_url(text) -> Column:
    """An http(s) URL without trailing punctuation; null for anything else."""
    u = F.regexp_replace(trimmed(text), r"[.,;:!?)\]}>]+$", "")
    return F.when(u.rlike("^https?://"), u)


def valid_utf8(raw) -> Column:
    return F.is_valid_utf8(_c(raw).cast("string"))


def made_valid(raw) -> Column:
    return F.make_valid_utf8(_c(raw).cast("string"))


def byte_capped(text, n: int = 192 * 1024) -> Column:
    """At most n bytes of UTF-8, cut between characters."""
    raw = F.encode(_c(text), "UTF-8")
    whole = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, n).cast("string")), "�+$", "")
    return F.when(F.octet_length(raw) > n, whole).otherwise(_c(text))


def rendered_comments(comments) -> Column:
    """``author (time):`` and the body of each comment, joined by a rule; resolved ones are marked."""

    def one(c: Column) -> Column:
        mark = F.when(F.coalesce(c["resolved"], F.lit(False)), F.lit("[resolved] ")).otherwise(F.lit(""))
        return F.concat(mark, c["author"], F.lit(" ("), F.date_format(c["at"], "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("):\n"), c["body"])

    return F.array_join(F.transform(_c(comments), one), "\n---\n\n")


def labelled_lines(*pairs: tuple[str, object]) -> Column:
    """``label: value`` lines of the values that are neither null nor empty."""
    return F.concat_ws("\n", *(F.when(F.coalesce(_c(v).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), _c(v).cast("string"))) for k, v in pairs))
