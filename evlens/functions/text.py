"""String functions of the admission pipeline.

All are Column expressions (JVM-side). ``metadata_walk`` reaches the values of nested
JSON; the admission pipeline feeds it only the rows whose text could change or
trip the screen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Sanitising (applied in this order to every string value):
#   remove the characters  < >
#   remove "javascript:"            (case-insensitive)
#   remove on<word chars><spaces>=  (case-insensitive)
# Injection screen (case-insensitive; any match rejects the request):
#   \b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b
#   (--|;|/\*|\*/|xp_|sp_)
#   (\bUNION\b.*\bSELECT\b)
#   (\bOR\b.*=.*)
# Event names: ^[a-zA-Z0-9_\-:.]+$ (whole string), at most 255 characters.
# URL at most 2048 characters. Body at most 1 MB (1048576 bytes).
# ---------------------------------------------------------------------------
JS_SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SANITIZE_STEPS = (
    ("[<>]", ""),
    ("(?i)javascript:", ""),
    (r"(?i)on\w+" + JS_SPACE + "*=", ""),
)
INJECTION_PATTERNS = (
    r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b",
    r"(--|;|/\*|\*/|xp_|sp_)",
    r"(\bUNION\b.*\bSELECT\b)",
    r"(\bOR\b.*=.*)",
)
EVENT_NAME_PATTERN = r"^[a-zA-Z0-9_\-:.]+\z"
EVENT_NAME_MAX = 255
URL_MAX = 2048
BODY_MAX_BYTES = 1024 * 1024

# UUID version 4, case-insensitive, whole string.
UUID_V4_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"

# ISO-8601 date or date-time as accepted at the API boundary (our own pattern):
# calendar date (YYYY-MM-DD or YYYYMMDD), optional time hh:mm[:ss[.fraction]]
# after 'T' or a space, optional Z or +/-hh[:mm] offset.
ISO8601_PATTERN = (r"^\d{4}-?\d{2}-?\d{2}"
                   r"([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?\z")

_INJECTION_ANY = "(?i)" + "|".join(INJECTION_PATTERNS)


_SANITIZE_ANY = "|".join(f"(?:{p})" for p, _ in SANITIZE_STEPS)


def sanitize(c: Column) -> Column:
    """C14: strip angle brackets, ``javascript:`` and inline ``on...=`` handlers.

    One regex test decides whether the three replacements run at all.
    """
    out = c
    for pattern, repl in SANITIZE_STEPS:
        out = F.regexp_replace(out, pattern, repl)
    return F.when(c.rlike(_SANITIZE_ANY), out).otherwise(c)


def injection_hit(c: Column) -> Column:
    """True when the string matches any injection pattern (NULL -> false)."""
    return F.coalesce(c.rlike(_INJECTION_ANY), F.lit(False))


def js_or(*cols: Column) -> Column:
    """JavaScript ``a || b``: the first value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def json_field(text: Column, name: str) -> Column:
    """A top-level field of a JSON object text (strings unquoted, others as JSON)."""
    return F.get_json_object(text, f"$.{name}")


def is_json_object(text: Column) -> Column:
    """C17: the text parses as JSON and is an object (NULL stays NULL)."""
    return F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")


def valid_event_name(c: Column) -> Column:
    return c.rlike(EVENT_NAME_PATTERN)


def is_iso8601(c: Column) -> Column:
    return c.rlike(ISO8601_PATTERN)


def is_uuid_v4(c: Column) -> Column:
    """A version-4 UUID (NULL stays NULL; an absent id is not checked)."""
    return c.rlike(UUID_V4_PATTERN)


# --- nested values --------------------------------------------------------------

# Raw-text test for JSON that needs the walk: anything that sanitising could
# change, anything the screen could match, or any escape sequence (an escaped
# character is only visible after decoding).
NEEDS_WALK_PATTERN = ("(?i)[<>\\\\]|javascript:|on\\w+" + JS_SPACE + "*=|" + "|".join(INJECTION_PATTERNS))

# One string of a valid JSON text and, if it is a key, the colon behind it. The quantifiers are
# possessive, so the match is linear and needs no stack however long the string.
_JSON_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*+:)?+'


def metadata_walk(text: Column) -> Column:
    """C14 and C15 over all string values of a JSON text, at any depth: a struct of the sanitised
    ``text`` and ``injection``, whether any sanitised value trips the screen. Keys stay as they are.

    The text is cut at its strings (a valid JSON text has quotes nowhere else); values are
    decoded one by one, and only those that change are encoded anew; spaces between values
    go. NULL for texts that are no valid JSON.
    """
    body, colon = (F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(k)) for k in (1, 2))
    # Between n strings there are n + 1 stretches of other characters.
    between = F.split(text, _JSON_STRING, -1)

    def decode(t: Column) -> Column:
        quoted = F.concat(F.lit('"'), t["body"], F.lit('"'))
        plain = F.when(t["body"].contains("\\"), F.get_json_object(F.concat(F.lit("["), quoted, F.lit("]")), "$[0]"))
        return F.struct(quoted.alias("quoted"), (t["colon"] != "").alias("key"), plain.otherwise(t["body"]).alias("plain"))

    def clean(t: Column) -> Column:
        return F.struct(t["quoted"].alias("quoted"), t["key"].alias("key"), t["plain"].alias("plain"), sanitize(t["plain"]).alias("clean"))

    def encode(t: Column) -> Column:
        anew = F.regexp_extract(F.to_json(F.array(t["clean"])), r"(?s)^\[(.*)\]$", 1)
        return F.struct(F.when(t["key"], F.concat(t["quoted"], F.lit(":"))).when(t["clean"] == t["plain"], t["quoted"]).otherwise(anew).alias("text"),
                        (~t["key"] & injection_hit(t["clean"])).alias("hit"))

    # One step a lambda, so that no expression repeats another.
    tokens = F.arrays_zip(body.alias("body"), colon.alias("colon"))
    for step in (decode, clean, encode):
        tokens = F.transform(tokens, step)
    both = F.struct(between.alias("gaps"), tokens.alias("tokens"))

    def join(x: Column) -> Column:
        pieces = F.zip_with(x["gaps"], x["tokens"], lambda gap, t: F.concat(F.regexp_replace(gap, r"\s+", ""), F.coalesce(t["text"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.exists(x["tokens"], lambda t: t["hit"]).alias("injection"))

    walked = F.element_at(F.transform(F.array(both), join), 1)
    return F.when(F.try_parse_json(text).isNotNull(), walked)
