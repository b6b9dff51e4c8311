"""Scores, back-off and deduplication keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import as_column as _c
from siltstone.schemas import AUTHORITY_WEIGHTS

RRF_K = 60
ANCHOR_SHARE, MISSED_ANCHORS = 0.8, 0.2
RELATIVE_CUT = 0.2
SERVICE_BOOST, KEY_BOOST, REQUEST_BOOST = 1.5, 2.0, 2.0


def reciprocal_rank(rank) -> Column:
    return F.lit(1.0) / (F.lit(RRF_K) + _c(rank))


def idf(total, df) -> Column:
    return F.log1p(_c(total).cast("double") / (_c(df) + 1))


def seen_terms(terms, hay) -> Column:
    """Those of ``terms`` (array<struct<term, idf>>) that a text has."""
    h = _c(hay)
    return F.filter(_c(terms), lambda x: F.contains(h, x["term"]))


def specific(score, terms, hay, total, seen=None) -> Column:
    """A score times how much of the query's rarity a text has.

    ``terms`` is array<struct<term, idf>>. The factor is (1 + matched / total
    rarity), times 0.2 if the rarest terms (the anchors) are all missing; 1 where
    the query has a single term or the collection is empty. ``seen`` is a column
    with the ``seen_terms``, so that the text isn't searched twice.
    """
    t, s = _c(terms), seen_terms(terms, hay) if seen is None else _c(seen)
    rarity = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x["idf"])
    rarest = lambda items: F.array_max(F.transform(items, lambda x: x["idf"]))
    whole = rarity(t)
    missed = F.coalesce(rarest(s), F.lit(-1.0)) < ANCHOR_SHARE * rarest(t)
    told = _c(score) * (1 + rarity(s) / whole) * F.when(missed, MISSED_ANCHORS).otherwise(1.0)
    return F.when((F.size(t) <= 1) | (_c(total) <= 0) | (whole <= 0), _c(score)).otherwise(F.coalesce(told, _c(score)))


def specificity(terms, hay, total, seen=None) -> Column:
    """How much of the query's rarity a text has: ``specific`` of 1."""
    return F.when(_c(terms).isNotNull(), specific(F.lit(1.0), terms, hay, total, seen))


def authority_weight(authority) -> Column:
    out = F.lit(1.0)
    for k, v in AUTHORITY_WEIGHTS.items():
        out = F.when(_c(authority) == k, v).otherwise(out)
    return out


def identifier_boost(metadata, query_text, query_service, request_rule: bool = False) -> Column:
    """Service, issue key and, behind a switch, merge request number named in the query."""
    m, q = _c(metadata), F.lower(_c(query_text))
    service = F.coalesce(F.lower(m["service"]) == F.lower(_c(query_service)), F.lit(False)) & (F.coalesce(_c(query_service), F.lit("")) != "")
    key = F.coalesce((m["jira_key"] != "") & F.contains(q, F.lower(m["jira_key"])), F.lit(False))
    out = F.when(service, SERVICE_BOOST).otherwise(1.0) * F.when(key, KEY_BOOST).otherwise(1.0)
    if request_rule:
        named = F.coalesce((m["source"] == "gitlab_mr") & F.contains(q, F.concat(F.lit("!"), m["iid"])), F.lit(False))
        out = out * F.when(named, REQUEST_BOOST).otherwise(1.0)
    return out


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Sums of 1 / j**2, by the number of terms in the sum, up to the 256 positions that the database keeps of a word.
_SQUARES = [0.0]
for _j in range(1, 257):
    _SQUARES.append(_SQUARES[-1] + 1.0 / (_j * _j))
TITLE_WEIGHT, TEXT_WEIGHT, ALL_SQUARES = 1.0, 0.4, 1.64493406685


def text_rank(tf_title, tf_text) -> Column:
    """A word's part of the database's text rank, in whole billionths, so that sums don't depend on their order.

    The rank of a query of alternatives is the mean of its words' parts. A part
    sums the weights of the word's places, those in the title (weight A) first,
    each over the square of its number, over the limit of such a sum.
    """
    a = F.least(_c(tf_title), F.lit(255))
    b = F.least(_c(tf_text), F.lit(255), 256 - a)
    table = F.array(*(F.lit(x) for x in _SQUARES))
    upto = lambda n: F.element_at(table, (n + 1).cast("int"))
    part = (TITLE_WEIGHT * upto(a) + TEXT_WEIGHT * (upto(a + b) - upto(a))) / ALL_SQUARES
    return F.round(part * 1e9).cast("long")


def backoff_seconds(attempts, base: float = 30.0, cap: float = 600.0) -> Column:
    """Doubles with each attempt up to the cap; without jitter, so results repeat."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(_c(attempts) - 1, F.lit(0))), F.lit(cap))


def lock_number(name) -> Column:
    return F.crc32(F.encode(_c(name), "UTF-8"))


def send_number(uuid) -> Column:
    """A signed 64-bit id: the first eight bytes, big-endian, of the SHA-256 of a UUID's bytes."""
    h = F.substring(F.sha2(F.unhex(F.replace(_c(uuid), F.lit("-"), F.lit(""))), 256), 1, 16)
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def user_key(user_id, event_id) -> Column:
    return F.sha2(F.concat_ws(":", _c(user_id).cast("string"), _c(event_id)), 256)


def chat_key(peer_type, peer_id, event_id) -> Column:
    return F.sha2(F.concat_ws(":", _c(peer_type), _c(peer_id).cast("string"), _c(event_id)), 256)


def stable_id(*parts) -> Column:
    """A deterministic id of a natural key, so a second run makes the same ids."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(_c(p).cast("string") for p in parts)), 256), 1, 32)
