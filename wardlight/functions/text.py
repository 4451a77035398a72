"""String expressions: redaction, addresses, request fields, JSON checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction patterns and their replacement tokens.
EMAIL_PATTERN = r"[\w\.-]+@[\w\.-]+\.\w+"
PHONE_PATTERN = r"\b\d{10}\b|\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\b\d{3}[-.]?\d{4}\b"
EMAIL_TOKEN = "[REDACTED_EMAIL]"
PHONE_TOKEN = "[REDACTED_PHONE]"

# Fixed value: the phone form that no stored description may contain.
AUDIT_PHONE_PATTERN = r"\b\d{3}[-.]?\d{4}\b"

UNICODE = "(?U)"

# An address is only looked for where a run of address characters begins or the
# last one ended. It changes no match, because a run that fails at its start
# fails everywhere, and it keeps a long run from being walked once per character.
_RUN_START = r"(?:(?<![\w\.-])|\G)"


# Fixed value: every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space; touches only the ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def redact(c: Column) -> Column:
    """Replace e-mail addresses, then phone numbers.

    Text without an ``@`` cannot hold an address and skips that scan.
    """
    mails = UNICODE + _RUN_START + EMAIL_PATTERN
    mails_gone = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, mails, EMAIL_TOKEN)).otherwise(c)
    return F.regexp_replace(mails_gone, UNICODE + PHONE_PATTERN, PHONE_TOKEN)


def zip_of(address: Column) -> Column:
    """The last five digits of an address that ends with digits, else null."""
    digits = F.regexp_extract(address, r"(\d{5})\n?\z", 1)
    return F.try_to_number(blank_to_null(digits), F.lit("99999")).cast("int")


def street_of(address: Column) -> Column:
    """Text before the first comma, stripped; empty for a missing address."""
    return strip(F.substring_index(F.coalesce(address, F.lit("")), ",", 1))


def describe(name: Column, subtype: Column, details: Column) -> Column:
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return F.concat(
        F.lit("service_name: "), text(name),
        F.lit(" service_subtype: "), text(subtype),
        F.lit(" service_details: "), text(details),
    )


def media_link(c: Column) -> Column:
    """The ``url`` of an object, or the value itself; empty counts as missing."""
    is_object = F.startswith(F.ltrim(c), F.lit("{"))
    return blank_to_null(F.when(is_object, F.get_json_object(c, "$.url")).otherwise(c))


def title(description: Column) -> Column:
    return F.substring_index(description, "|", 1)


# A field name that no text is expected to have.
_AFTER = "after_the_text_4f1c"


def json_objects(c: Column, schema) -> Column:
    """The JSON objects a text consists of, null when it is not JSON.

    The parser stops after the first value of a text, so the text is put in a
    list before an object that no text is expected to hold: if that comes out
    as the last one, all of the text was read, and what stands before it are
    the text's values; one object gives one element.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString()
    if not kind.startswith("struct<"):
        raise ValueError(f"not the schema of an object: {kind}")
    whole = F.concat(F.lit("["), c, F.lit(f',{{"{_AFTER}":1}}]'))
    parsed = F.from_json(whole, f"array<{kind[:-1]},{_AFTER}:int>>", {"allowSingleQuotes": "false"})
    # through a list of one, so that the parse is written once
    return F.element_at(F.transform(F.array(parsed), lambda found: F.when(
        F.get(found, F.size(found) - 1)[_AFTER] == 1,
        F.transform(F.slice(found, 1, F.size(found) - 1), lambda o: o.dropFields(_AFTER)))), 1)


def single(objects: Column) -> Column:
    """True when a text was exactly one JSON object."""
    return F.coalesce(F.size(objects) == 1, F.lit(False))


def has_key(keys: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))
