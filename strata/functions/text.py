"""Column functions on text: terms, token estimates, clean-up, codecs."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: The CJK blocks that count as one token for each character, and one more that counts as terms.
BLOCKS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF))
MORE = (0x2F800, 0x2FA1F)
CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in BLOCKS)
CJK_MORE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in (*BLOCKS, MORE))
_PY = "".join(f"{chr(a)}-{chr(b)}" for a, b in (*BLOCKS, MORE))
LITERAL_TERMS = re.compile(rf"[{_PY}]|[^\W_{_PY}]+")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; CJK characters are terms of their own. Null: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    mixed = F.regexp_extract_all(low, F.lit(rf"[\p{{L}}\p{{N}}&&[^{CJK_MORE}]]+|[{CJK_MORE}]"), F.lit(0))
    return F.when(low.rlike(f"[{CJK_MORE}]"), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def chunk_tokens(text: Column) -> Column:
    """CJK characters and runs of other characters between blanks; 1 at least."""
    n = F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit(rf"[^ \t\n\r{CJK}]+"))
    return F.greatest(n, F.lit(1))


def context_tokens(text: Column) -> Column:
    """Two for each CJK character, a quarter for any other, rounded down."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK_MORE}]"))
    return F.floor(2 * cjk + 0.25 * (F.length(text) - cjk)).cast("long")


def tidy_markdown(text: Column) -> Column:
    """At most one blank line in a row, none at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_variant(line: Column) -> Column:
    """A generated query without its list marker."""
    return F.trim(F.regexp_replace(line, r"^[0-9. )\-、]+", ""))


def split_tags(tags: Column, default: str | None = "Concept") -> Column:
    """Trimmed, non-blank parts between commas; [default] if there are none."""
    out = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return out if default is None else F.when(F.size(out) == 0, F.array(F.lit(default))).otherwise(out)


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def point_id(key: Column, namespace: str = "strata.points") -> Column:
    """A version-5 style UUID of the key: SHA-1 of the first 16 bytes of the namespace's SHA-1, then the key."""
    ns = F.unhex(F.substring(F.sha1(F.lit(namespace)), 1, 32))
    h = F.sha1(F.concat(ns, key.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant.substr(nibble + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def safe_token(name: Column) -> Column:
    """Whether a label or relation type is made of letters, digits, _ and - only."""
    return name.rlike(r"^[A-Za-z0-9_-]+$")


def loose_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def loose_timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value)
