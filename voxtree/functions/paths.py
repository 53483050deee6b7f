"""File names that mean the same file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolved_path(text: Column) -> Column:
    """A path or file URI in one spelling.

    Outer white space goes, backslashes become slashes, a ``file:`` URI loses scheme and host and has
    its escapes decoded (never a plain path), and empty, ``.`` and ``..`` parts are resolved. Letter
    case, padding and suffixes stay. Null and empty are null.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    uri = t.rlike(r"^(?i)file:")
    bare = F.regexp_replace(t, r"^(?i)file:(?://[^/]*(?=/))?", "")
    # '+' stands for itself in a path, a broken escape leaves the text as it is
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    path = F.replace(F.when(uri, decoded).otherwise(t), F.lit("\\"), F.lit("/"))
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, p)),
    )
    clean = F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    # most paths are in that spelling already
    plain = ~path.rlike(r"//|(?:^|/)\.{1,2}(?:/|$)|.+/$")
    return F.when(t != "", F.when(plain, path).otherwise(clean))
