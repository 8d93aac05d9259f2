"""Scalar text functions as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: The host part of an http or https address: user part and port are dropped, the scheme may be in any case.
HOST_PATTERN = r"^(?i:https?)://(?:[^/?#\[\]]*@)?([A-Za-z0-9.\-]+)(?::[^/?#\[\]@]*)?(?:[/?#]|$)"

#: Characters kept of a host name.
HOST_LENGTH = 253


def strip(value: Column) -> Column:
    """Remove leading and trailing white space, in the wide sense of Python's str.strip()."""
    return F.btrim(value, F.lit(WHITESPACE))


def not_blank(value: Column) -> Column:
    """True for text with a character other than white space; false for null."""
    return F.coalesce(F.length(strip(value)) > 0, F.lit(False))


def source_host(url: Column) -> Column:
    """Lower-case ASCII host of an http(s) address, else the empty string (also for null)."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    host = F.substring(F.lower(F.regexp_extract(clean, HOST_PATTERN, 1)), 1, HOST_LENGTH)
    return F.coalesce(host, F.lit(""))


def fingerprint(text: Column) -> Column:
    """First 16 hexadecimal characters of the SHA-256 of the text in UTF-8; null for null."""
    return F.substring(F.sha2(text, 256), 1, 16)


def normalize_label(value: Column) -> Column:
    """'True' or 'False' for these words in any case, padded or not; else null."""
    return F.when(F.lower(strip(value)) == "true", F.lit("True")).when(F.lower(strip(value)) == "false", F.lit("False"))


def provider_key(provider: Column) -> Column:
    """Provider names in one spelling: stripped and in lower case, 'unknown' when null or blank."""
    return F.coalesce(F.nullif(F.lower(strip(provider)), F.lit("")), F.lit("unknown"))


def segment_join(parts: list[Column | list[Column]], separator: str = "\n\n\n") -> Column:
    """Texts joined by ``separator``: single ones stripped, members of lists as they are, the whole
    stripped. Null texts count as the word None, as Python prints them."""
    columns: list[Column] = []
    for part in parts:
        if isinstance(part, list):
            columns.extend(F.coalesce(p, F.lit("None")) for p in part)
        else:
            columns.append(strip(F.coalesce(part, F.lit("None"))))
    return strip(F.array_join(F.array(*columns), separator))


def with_postamble(query: Column, postamble: str = "") -> Column:
    """The query with a fixed addition behind a space; unchanged without one."""
    return F.concat(query, F.lit(f" {postamble}")) if postamble else query


def backoff_seconds(retries: Column, most: int = 30) -> Column:
    """Seconds waited before each of ``retries`` retries: powers of two, at most ``most``."""
    attempts = F.when(retries > 0, F.sequence(F.lit(0), F.greatest(retries, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(attempts, lambda a: F.least(F.pow(F.lit(2.0), a), F.lit(float(most))).cast("int"))
