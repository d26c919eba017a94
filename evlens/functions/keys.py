"""API-key helpers (C9-C12) and key predicates (F8-F10) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys are stored as SHA-256 hex, shown by an 8-character prefix,
# expire 365 days after creation, and are 64 characters long when well formed.
KEY_PREFIX_LEN = 8
KEY_TTL_DAYS = 365
KEY_LENGTH = 64


def key_hash(c: Column) -> Column:
    """SHA-256 hex digest of the key text."""
    return F.sha2(c, 256)


def key_prefix(c: Column) -> Column:
    """The shown prefix of a key."""
    return F.substring(c, 1, KEY_PREFIX_LEN)


def key_expiry(created: Column) -> Column:
    """C11: expiry one year after creation."""
    return created + F.expr(f"INTERVAL {KEY_TTL_DAYS} DAYS")


def key_well_formed(c: Column) -> Column:
    """Key format check (length only)."""
    return F.length(c) == KEY_LENGTH


def ip_allowed(allowed_ips: Column, ip: Column) -> Column:
    """F8: NULL or empty allow-list admits everyone, else the IP or '*' must be listed."""
    return (allowed_ips.isNull() | (F.size(allowed_ips) == 0)
            | F.coalesce(F.array_contains(allowed_ips, ip), F.lit(False))
            | F.array_contains(allowed_ips, F.lit("*")))


def has_permission(permissions: Column, name: str) -> Column:
    """a NULL permission object means read+write; a missing/false flag denies."""
    return F.when(permissions.isNull(), F.lit(True)).otherwise(
        F.coalesce(permissions.getField(name), F.lit(False)))


def key_usable(is_active: Column, expires_at: Column, now: Column) -> Column:
    """Known, active, and not expired (expiring exactly now is still valid)."""
    return (F.coalesce(is_active, F.lit(False))
            & (expires_at.isNull() | (expires_at >= now)))


def stale_touch(last_used: Column, now: Column, minutes: int = 5) -> Column:
    """last_used_at is NULL or older than ``minutes`` before now."""
    return last_used.isNull() | (last_used < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
