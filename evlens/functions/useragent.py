"""I11 user-agent enrichment as a small rule table evaluated with ``rlike``.

The reference hands the header to a parsing library; here a short ordered rule
list (first match wins) classifies the browser family, the OS family and
whether the device is a handheld. It is a CASE expression inside whole-stage codegen: no
Python, no shuffle, no join. Admission evaluates it on every row, or once a distinct agent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our rules (pattern, family, version-capturing pattern or None), first match wins.
BROWSER_RULES = (
    (r"Edg(e|A|iOS)?/", "Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"),
    (r"OPR/|Opera", "Opera", r"(?:OPR|Opera)/([\d.]+)"),
    (r"Firefox/|FxiOS/", "Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"),
    (r"Chrome/|CriOS/", "Chrome", r"(?:Chrome|CriOS)/([\d.]+)"),
    (r"\b(iPhone|iPad|iPod)\b.*Safari/", "Mobile Safari", r"Version/([\d.]+)|Safari/([\d.]+)"),
    (r"Safari/", "Safari", r"Version/([\d.]+)|Safari/([\d.]+)"),
    (r"MSIE |Trident/", "IE", r"(?:MSIE |rv:)([\d.]+)"),
    (r"curl/", "curl", r"curl/([\d.]+)"),
    (r"(?i)bot|crawler|spider", "Bot", None),
)
OS_RULES = (
    (r"iPhone|iPad|iPod", "iOS"),
    (r"Android", "Android"),
    (r"Windows", "Windows"),
    (r"Mac OS X|Macintosh", "Mac OS X"),
    (r"CrOS", "Chrome OS"),
    (r"Linux", "Linux"),
)
HANDHELD_PATTERN = r"iPhone|iPad|iPod|Android|Mobile|BlackBerry|Windows Phone"


def _first(rules, ua: Column, value_of) -> Column:
    expr = None
    for rule in rules:
        cond = ua.rlike(rule[0])
        expr = F.when(cond, value_of(rule)) if expr is None else expr.when(cond, value_of(rule))
    return expr.otherwise(F.lit("Other"))


def _version(rule, ua: Column) -> Column:
    if rule[2] is None:
        return F.lit(rule[1])
    v = F.coalesce(F.nullif(F.regexp_extract(ua, rule[2], 1), F.lit("")),
                   F.nullif(F.regexp_extract(ua, rule[2], 2) if rule[2].count("(") > 1 else F.lit(""),
                            F.lit("")))
    return F.when(v.isNull(), F.lit(rule[1])).otherwise(F.concat_ws(" ", F.lit(rule[1]), v))


def agent_browser(ua: Column) -> Column:
    """Browser family and version, e.g. 'Chrome 120.0'; 'Other' when no rule matches."""
    return _first(BROWSER_RULES, ua, lambda r: _version(r, ua))


def agent_os(ua: Column) -> Column:
    """OS family; 'Other' when no rule matches."""
    return _first(OS_RULES, ua, lambda r: F.lit(r[1]))


def agent_is_handheld(ua: Column) -> Column:
    """True when the device family is known (phone/tablet), i.e. not 'Other'."""
    return ua.rlike(HANDHELD_PATTERN)


#: What I11 takes from an agent.
AGENT_RULES = {"browser": agent_browser, "os": agent_os, "handheld": agent_is_handheld}
