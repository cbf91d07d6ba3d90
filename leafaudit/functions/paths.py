"""URL and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# References with these starts never point into the library.
EXTERNAL_PREFIXES = r"^(?:http://|https://|//|mailto:|tel:|data:|#)"


def is_local(ref: Column) -> Column:
    return ~ref.rlike(EXTERNAL_PREFIXES)


def clean_url(ref: Column) -> Column:
    """Drop query and fragment, then percent-decode; stray % and + stay literal."""
    bare = F.regexp_extract(ref, r"^[^?#]*", 0)
    bare = F.regexp_replace(bare, r"%(?![0-9a-fA-F]{2})", "%25")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def resolve(base_dir: Column, ref: Column) -> Column:
    """Resolve a cleaned relative reference against a directory ('.' and '..' removed)."""
    full = F.when(ref.startswith("/"), ref).otherwise(F.concat(base_dir, F.lit("/"), ref))
    steps = F.filter(F.split(full, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        steps,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, s)
        ),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
