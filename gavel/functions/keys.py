"""Identifiers and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_MARK = "|"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid_text(*parts: Column) -> Column:
    """UUID-shaped text of the MD5 of ``parts``: the same row gets the same id on
    every retry, which a random id would not. Marks inside a part are escaped, so that
    different parts never read the same."""

    def framed(part: Column) -> Column:
        text = F.coalesce(part.cast("string"), F.lit(""))
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(escaped, F.lit(FIELD_MARK), F.lit("\\" + FIELD_MARK))

    digest = F.md5(F.concat_ws(FIELD_MARK, *map(framed, parts)))
    # one reference to the digest, so that plans do not multiply when this is inlined
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def plane_of_key(key: Column) -> Column:
    """Plane declared by an object key; null when it names neither or both."""
    k = F.lower(key)
    access = k.contains("/access/") | k.startswith("access/")
    content = k.contains("/content/") | k.startswith("content/")
    return F.when(access & ~content, F.lit("access")).when(content & ~access, F.lit("content"))


def decoded_key(key: Column) -> Column:
    """URL-decoded object key (``+`` is a space); a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(key), key)


def output_key(key: Column) -> Column:
    """Key with its first path segment dropped."""
    return F.regexp_replace(key, "^[^/]*/", "")


def run_id(created_at: str, token: str) -> str:
    """``YYYYmmddTHHMMSS-xxxxxx``: sorts by time, so the largest id is the latest run."""
    return created_at[:19].replace("-", "").replace(":", "") + "-" + token[:6]


def framework_of(reference: Column) -> Column:
    return F.split_part(reference, F.lit("-"), F.lit(1))
