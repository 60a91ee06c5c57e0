"""Normalisers of names, paths, addresses, dates and fingerprints as column functions.

The six name normalisers look alike and are not: each resolver names the one it
uses. Case folding and NFKC are those of Unicode: ASCII takes the short way over
``lower``, other text goes to the library of Unicode functions that Spark ships.
Spark counts a call of it as non-deterministic, so normalise in a projection, not
in a join condition or inside an aggregate.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Prefixes that a tag name may carry, and fingerprint type names.
KNOWN_PREFIXES = ("artist", "character", "copyright", "general", "meta")
FINGERPRINT_TYPES = {
    "md5": "md5", "oshash": "oshash", "opensubtitles": "oshash", "opensubtitleshash": "oshash", "sha1": "sha1", "sha256": "sha256",
    "sha512": "sha512", "phash": "phash", "perceptualhash": "phash",
}
ARCHIVES = ("cbz", "cbr", "cb7", "cbt", "zip", "rar", "7z")
PREFIX_PATTERN = r"^\s*(?:" + "|".join(KNOWN_PREFIXES) + r")\s*:\s*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def _unicode(function: str, c: Column) -> Column:
    """A static function (string, flag) of the library of Unicode functions."""
    return F.reflect(F.lit(f"com.ibm.icu.{function.rpartition('.')[0]}"), F.lit(function.rpartition(".")[2]), c, F.lit(True))


def _beyond_ascii(c: Column, full: Column) -> Column:
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.lower(c)).when(c.isNotNull(), full)


def casefolded(c: Column) -> Column:
    """Full case folding."""
    return _beyond_ascii(c, _unicode("lang.UCharacter.foldCase", F.coalesce(c, F.lit(""))))


def folded(c: Column) -> Column:
    """NFKC, then full case folding."""
    return _beyond_ascii(c, _unicode("lang.UCharacter.foldCase", _unicode("text.Normalizer.compose", F.coalesce(c, F.lit("")))))


def key_ci(c: Column) -> Column:
    """Case-insensitive key."""
    return strip(casefolded(c))


def tag_key(c: Column) -> Column:
    """Tag key: known prefix dropped, runs of separators collapsed, other punctuation kept."""
    return strip(F.regexp_replace(F.regexp_replace(strip(folded(c)), PREFIX_PATTERN, ""), r"(?U)[_\-\s]+", " "))


def _spaced(c: Column, kept: str = "") -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[_\-]", " "), rf"(?U)[^\p{{L}}\p{{N}}_\s{kept}]+", " "))


def entity_name(c: Column) -> Column:
    """Entity name: punctuation becomes space except parentheses."""
    return _spaced(strip(folded(c)), "()")


def tag_cleanup_name(c: Column) -> Column:
    """Tag name for cleanup: known prefix dropped, all punctuation becomes space."""
    return _spaced(F.regexp_replace(strip(folded(c)), PREFIX_PATTERN, ""))


def plain_name(c: Column) -> Column:
    """Name for cleanup and migration: all punctuation becomes space, no prefix rule."""
    return _spaced(strip(folded(c)))


def compact(normalised: Column) -> Column:
    """Letters and digits of a normalised name."""
    return F.regexp_replace(normalised, r"[^\p{L}\p{N}]", "")


def fingerprint_type(c: Column) -> Column:
    plain = F.regexp_replace(key_ci(c), r"[^a-z0-9]+", "")
    names = F.create_map(*[F.lit(x) for pair in FINGERPRINT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)


@pandas_udf(StringType())
def posix_path(s: pd.Series) -> pd.Series:
    """POSIX path without ``.``, ``..`` and doubled separators; a leading ``//`` stays."""
    return s.map(lambda v: None if v is None else posixpath.normpath(v.strip()))


def url_key(c: Column) -> Column:
    """Lower-case scheme and host, no trailing slashes of the path, query kept, fragment dropped."""
    bare = F.regexp_replace(strip(c), r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([^:/?]+://[^/?]*)", 1))
    rest = F.regexp_replace(bare, r"^[^:/?]+://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    return F.concat(head, path, F.regexp_extract(rest, r"(\?.*)$", 1))


def tenths(score: Column) -> Column:
    """The score with one decimal as text, rounded by its exact binary value, halves to even (0.25 to 0.2, 12.35 to 12.3, for it lies below its digits)."""
    return F.replace(F.format_number(score.cast("double"), 1), F.lit(","))


def with_confidence(url: Column, score: Column, key: str = "confidence") -> Column:
    """Address with its score, 0 to 100 and in tenths, as fragment; without one where the score is null."""
    bare = F.regexp_replace(strip(url), r"#.*$", "")
    text = tenths(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))
    return F.when(score.isNull(), bare).otherwise(F.concat(bare, F.lit(f"#{key}="), text))


def confidence_of(url: Column, key: str = "confidence") -> Column:
    got = F.regexp_extract(url, rf"#(?:.*&)?{key}=([^&]*)", 1)
    score = got.try_cast("double")
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def route(url: Column, routes: list[tuple[str, str]]) -> Column:
    """``source:id`` by the first pattern that matches; each pattern has one group, the id."""
    found = [F.when(url.rlike(p), F.concat(F.lit(f"{name}:"), F.regexp_extract(url, p, 1))) for name, p in routes]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def extensions(path: Column) -> Column:
    """Sorted distinct suffixes of every component of a path, archive members included."""
    parts = F.split(F.regexp_replace(F.lower(path), r"\\", "/"), r"[#!|/]")
    suffix = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(F.trim(p), r"\?.*$", ""), r"(\.[a-z0-9]{1,10})$", 1))
    inner = F.transform(F.array(*[F.lit(a) for a in ARCHIVES]), lambda a: F.when(F.regexp_like(F.lower(path), F.concat(F.lit(r"\."), a, F.lit(r"(?=$|[/\\#!|?])"))), F.concat(F.lit("."), a)).otherwise(F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(suffix, inner), lambda x: x != "")))


def source_date(c: Column) -> Column:
    """``yyyy-MM-dd`` of a source's date: seconds or milliseconds since 1970, ISO, four other layouts, or a date prefix."""
    t = strip(c)
    stamp = t.try_cast("bigint")
    seconds = F.when(stamp > 10_000_000_000, F.floor(stamp / 1000)).otherwise(stamp)
    epoch = F.when(t.rlike(r"^\d{9,13}$"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))
    named = F.date_format(F.try_to_timestamp(F.regexp_replace(t, r"^\w{3} (\w{3}) (\d{1,2}) ([\d:]{8}) [+-]\d{4} (\d{4})$", "$4 $1 $2 $3"), F.lit("yyyy MMM d HH:mm:ss")), "yyyy-MM-dd")
    prefix = F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    basic = F.regexp_extract(t, r"^(\d{8})(?:T\d{2}(?:\d{2}){0,2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?(?:\d{2})?)?)?$", 1)
    short = F.date_format(F.try_to_timestamp(F.nullif(basic, F.lit("")), F.lit("yyyyMMdd")), "yyyy-MM-dd")
    return F.coalesce(epoch, short, F.when(prefix.try_cast("date").isNotNull(), prefix), named, prefix)


def date_text(c: Column) -> Column:
    """A date as text; of a JSON object the first of its date, timestamp, s and iso that says something."""
    value = lambda k: F.nullif(F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")), F.lit("0"))
    return F.when(strip(c).startswith("{"), F.coalesce(value("date"), value("timestamp"), value("s"), value("iso"))).otherwise(c)


def custom_image(path: Column) -> Column:
    """Whether an image path names something other than the default image."""
    return F.coalesce((strip(path) != "") & ~F.contains(casefolded(path), F.lit("default=true")), F.lit(False))


def allowed_source(source: Column, allowed: Sequence[str]) -> Column:
    """Whether metadata of a source may be used."""
    return F.coalesce(source.isin(*allowed), F.lit(False))


def retryable(causes: Column) -> Column:
    """Whether an error may be tried again, by its chain of causes (``kind, code``), outermost first: an open breaker and
    network errors may, an answer code decides by itself, a failed foreign key may not; other kinds ask their cause."""
    known = F.filter(causes, lambda x: x["kind"].isin("open", "http", "network", "foreign_key"))
    first = F.try_element_at(known, F.lit(1))
    return F.coalesce(first["kind"].isin("open", "network") | ((first["kind"] == "http") & first["code"].isin(*RETRYABLE)), F.lit(False))


def hash_bits(hex_text: Column) -> Column:
    """A 64-bit hexadecimal hash as a signed number; null if it isn't one."""
    return F.when(key_ci(hex_text).rlike("^[0-9a-f]{1,16}$"), F.conv(key_ci(hex_text), 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(score: Column, high: float = 93.0, review: float = 85.0) -> Column:
    """HIGH, REVIEW or LOW of a score in tenths: a score that prints as the limit reaches it."""
    shown = tenths(score).cast("double")
    return F.when(shown >= high, "HIGH").when(shown >= review, "REVIEW").otherwise("LOW")


def is_empty(c: Column, kind: str) -> Column:
    """Null, and what counts as nothing for a kind: empty string, 0, False, empty collection."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind == "boolean":
        return c.isNull() | ~c
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == 0)


def scalar_fill(current: Column, old: Column, kind: str = "string") -> Column:
    """The current value unless it is empty."""
    return F.when(is_empty(current, kind), old).otherwise(current)


def to_int(c: Column) -> Column:
    return F.when(c.try_cast("double").isNotNull(), c.try_cast("double").try_cast("bigint"))


def to_bool(c: Column) -> Column:
    return F.coalesce(key_ci(c).isin("1", "true", "yes", "on"), F.lit(False))


def canonical_map(c: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def data_uri(c: Column) -> Column:
    """Artwork that is an address stays; raw base64 gets the data URI that its first bytes ask for; else null."""
    t = strip(c)
    payload = F.regexp_replace(t, r"\s+", "")
    head = F.rpad(F.substring(payload, 1, 96), 96, "A")
    raw = F.hex(F.when(head.rlike("^[A-Za-z0-9+/]{96}$"), F.unbase64(head)))
    mime = (
        F.when(raw.startswith("FFD8FF"), "image/jpeg").when(raw.startswith("89504E470D0A1A0A"), "image/png").when(raw.startswith("474946383761") | raw.startswith("474946383961"), "image/gif")
        .when(raw.startswith("52494646") & (F.substring(raw, 17, 8) == "57454250"), "image/webp").when(raw.rlike("^(?:20|09|0A|0B|0C|0D)*3C737667"), "image/svg+xml")
    )
    return F.when(F.lower(t).rlike("^(data:image/|https?://)"), t).when(mime.isNotNull(), F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload))


def backoff(attempt: Column, base: float = 0.75, cap: float = 20.0, jitter: Column | None = None, retry_after: Column | None = None) -> Column:
    """Seconds to wait: doubling up to ``cap``, plus the share ``jitter`` (0 to 1, the caller's random number) of a quarter of it, at least ``retry_after``."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    wait = wait if jitter is None else wait + jitter * F.greatest(F.lit(0.05), wait * 0.25)
    return wait if retry_after is None else F.greatest(F.coalesce(retry_after, F.lit(0.0)), wait)


def effective_rate(*rates: Column) -> Column:
    """The smallest positive rate; null if there is none."""
    return F.least(*[F.when(r > 0, r) for r in rates]) if len(rates) > 1 else F.when(rates[0] > 0, rates[0])


# Answer codes after which a request may be tried again.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)


def outcome_class(status: Column) -> Column:
    """What a provider's answer code means: match, miss, retryable_error or unavailable."""
    return F.when(status.between(200, 299), "match").when(status == 404, "miss").when(status.isin(*RETRYABLE), "retryable_error").otherwise("unavailable")


def token_subset(a: Column, b: Column) -> Column:
    """Whether one token set is a proper subset of the other; false if either is empty."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    more, less = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    return (F.size(x) > 0) & (F.size(y) > 0) & (((more == 0) & (less > 0)) | ((more > 0) & (less == 0)))


def usage_sum(*counts: Column) -> Column:
    """Sum of the counts of all child collections; what is no whole number counts 0."""
    total = F.lit(0).cast("long")
    for c in counts:
        total = total + F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    return total


def metadata_fields(*fields: tuple[Column, str]) -> Column:
    """The fields (column, kind) of a rich record as texts, each in its place: an empty one (``is_empty``) is an empty text."""
    return F.array(*[F.when(is_empty(c, kind), "").otherwise(F.trim(F.to_json(F.struct(c.alias("v")))) if kind in ("array", "map") else F.trim(c.cast("string"))) for c, kind in fields])


def signature(fields: Column) -> Column:
    """What tells rich records apart: records sign alike only if every field is equal, gaps included."""
    return F.sha2(F.to_json(fields), 256)


def nontrivial(fields: Column) -> Column:
    """Whether any field holds something."""
    return F.exists(fields, lambda v: v != "")


def relation_key(folder: Column, zips: Column, title: Column) -> Column:
    """How a gallery is referred to: by its folder, else its archives (an array of paths, in order of the normal forms), else its title; empty without any."""
    path = F.trim(F.coalesce(folder, F.lit("")))
    normal = F.array_sort(F.filter(F.coalesce(zips, F.array().cast("array<string>")), lambda z: z.isNotNull() & (F.trim(z) != "")))
    name = F.trim(F.coalesce(title, F.lit("")))
    return (
        F.when(path != "", F.concat(F.lit("folder:"), posix_path(path)))
        .when(F.size(normal) > 0, F.concat(F.lit("zip:"), F.array_join(F.array_sort(F.split(posix_paths(F.array_join(normal, "\n")), "\n")), "|")))
        .when(name != "", F.concat(F.lit("title:"), plain_name(name)))
        .otherwise("")
    )


@pandas_udf(StringType())
def posix_paths(s: pd.Series) -> pd.Series:
    """Each line as ``posix_path`` makes it; an empty text stays empty."""
    return s.map(lambda v: "\n".join(posixpath.normpath(x.strip()) for x in v.split("\n")) if v else v)
