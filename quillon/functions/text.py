"""Scalar rules for titles, prose and identities."""

from __future__ import annotations

import json
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EDGES = "(?U)^\\s+|\\s+$"
# The most common special character entities of wiki text.
ENTITIES = (("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def normalized_title(title: Column) -> Column:
    """Underscores become spaces; white space of any script at the edges goes."""
    return F.regexp_replace(F.translate(title, "_", " "), EDGES, "")


def title_key(title: Column) -> Column:
    """Titles are equal up to the case of their first character only."""
    own = normalized_title(title)
    return F.concat(F.upper(F.left(own, F.lit(1))), F.substring(own, 2, 1 << 30))


def redirect_title(target: Column) -> Column:
    """A redirect's target without its section."""
    return normalized_title(F.substring_index(target, "#", 1))


def archive_name(label: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), label, F.lit(".tar.gz"))


def category_title(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("Category:")), name).otherwise(F.concat(F.lit("Category:"), name))


def quoted(title: Column, safe: str) -> Column:
    """Percent-encoding of a title for a wiki address; spaces are underscores, safe characters stay."""
    out = F.replace(F.url_encode(F.translate(title, " ", "_")), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def collapsed(text: Column) -> Column:
    """White space of any script becomes single spaces, none at the edges."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "), "^ | $", "")


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def snippet(text: Column, width: int, whole: bool = False) -> Column:
    """The text, or its beginning with a mark where it is longer than the width allows."""
    limit = max(16, min(160, width - 14))
    if whole:
        return text
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(max(1, limit - 16))), "(?U)\\s+$", ""), F.lit("... [truncated]")))


def shortened(text: str, width: int) -> str:
    """As snippet, of one text."""
    limit = max(16, min(160, width - 14))
    return text if len(text) <= limit else text[: max(1, limit - 16)].rstrip() + "... [truncated]"


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most width characters; long words break, hyphens don't, and there is always a line."""
    return textwrap.wrap(text, max(1, width), break_long_words=True, break_on_hyphens=False) or [""]


def json_identity(prefix: str, value: object) -> str:
    """prefix_ and the SHA-256 of the value's compact ASCII JSON."""
    import hashlib

    return f"{prefix}_{hashlib.sha256(json.dumps(value, sort_keys=True, separators=(',', ':')).encode()).hexdigest()}"


def canonical_document(value: object) -> str:
    """JSON as published documents have it: indented, keys sorted, a line end."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def canonical_line(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def canonical_json(**fields: Column) -> Column:
    """The fields as canonical_line has them, without the line end: keys in order, nulls written, control characters in small letters."""
    out = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    fixed = out
    for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(out.contains("\\u00"), fixed).otherwise(out)


def heading_label(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " › "), F.lit("")), F.lit("Lead"))


def repeat_refused(key: Column, before: Column, at: Column, earlier: Column, seconds: float) -> Column:
    """Whether a key repeats the one right before it within so many seconds."""
    return F.coalesce((key == before) & (at.cast("double") - earlier.cast("double") < seconds), F.lit(False))
