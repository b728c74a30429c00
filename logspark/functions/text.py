"""Names, identifiers and secrets for storage and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters replaced in file names, and white space trimmed from texts.
FILE_NAME_CHARACTERS = '/\\:*?"<>|'
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Display texts.
SECRET_MISSING = "❌ Not set"
SECRET_SHORT = "***"
URL_MISSING = "❌ Not configured"
URL_INVALID = "✅ Configured (invalid format)"
ORPHAN_PREFIX = "orphaned-"


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# The same in Java's dialect, from the start of a name or behind the address before: tried once for a
# run of characters, and with possessive groups, which are loops where others call themselves.
EMAIL_JAVA = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
              r"(?:\.[A-Za-z0-9-]++)++")

# Patterns of personal data and what takes their place, in this order.
PERSONAL = (
    (r"((?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*)(?:\"[^\"\n]*\"|[^\s\"']+)", "$1[SECRET]"),
    (EMAIL, "[EMAIL]"),
    (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[IP]"),
    (r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", "[PHONE]"),
    (r"[0-9](?:[ -]?[0-9]){12,18}", "[NUMBER]"),
)


def mask_personal(text: Column) -> Column:
    """Addresses, numbers and secrets replaced by what they are, before a text leaves for a model."""
    for pattern, mask in PERSONAL:
        text = F.regexp_replace(text, EMAIL_JAVA if pattern == EMAIL else pattern, mask)
    return text


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def sanitize(name: Column) -> Column:
    """A container name as a storage name."""
    return F.translate(name, "/", "_")


def unsanitize(name: Column) -> Column:
    """A storage name for display. Lossy: an underscore of the original name becomes a slash."""
    return F.translate(name, "_", "/")


def sanitize_filename(name: Column) -> Column:
    return F.translate(name, FILE_NAME_CHARACTERS, "_" * len(FILE_NAME_CHARACTERS))


def short_id(container_id: Column) -> Column:
    return F.when(container_id.startswith(ORPHAN_PREFIX), container_id).otherwise(
        F.left(container_id, F.lit(12)))


def mask_secret(secret: Column) -> Column:
    """The first and last four bytes with a star for each byte between them."""
    raw = secret.cast("binary")
    n = F.octet_length(secret)
    ends = [F.make_valid_utf8(part.cast("string")) for part in (
        F.substring(raw, 1, 4), F.substring(raw, -4, 4))]
    return (F.when(F.coalesce(secret, F.lit("")) == "", SECRET_MISSING)
            .when(n <= 8, SECRET_SHORT)
            .otherwise(F.concat(ends[0], F.repeat(F.lit("*"), n - 8), ends[1])))


def mask_url(url: Column) -> Column:
    scheme = F.substring_index(url, "://", 1)
    return (F.when(F.coalesce(url, F.lit("")) == "", URL_MISSING)
            .when(F.instr(url, "://") == 0, URL_INVALID)
            .otherwise(F.concat(F.lit("✅ Configured ("), scheme, F.lit("://***)"))))
