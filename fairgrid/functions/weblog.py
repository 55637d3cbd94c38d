"""Classifiers of access-log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairgrid.functions.text import blank_to_null

EVENT_PAGE = "^/events?/[a-f0-9-]+$"
# Suffixes of static files.
STATIC = [".js", ".css", ".png", ".ico"]


def visitor_id(cookie: Column, ip: Column) -> Column:
    """The cookie's id, else the address."""
    return F.coalesce(blank_to_null(F.regexp_extract(cookie, "mid=([a-f0-9-]+)", 1)), ip)


def browser(agent: Column, variant: str = "B") -> Column:
    """Browser by user agent. A tests Chrome first and is case-sensitive, B tests bots first and knows Edge."""
    low = F.lower(agent)
    if variant == "A":
        return (
            F.when(agent.contains("Chrome"), "Chrome").when(agent.contains("Firefox"), "Firefox").when(agent.contains("Safari"), "Safari")
            .when(agent.contains("Edge"), "Edge").when(low.contains("bot") | low.contains("crawler"), "Bot").otherwise("Other")
        )
    return (
        F.when(low.rlike("bot|crawler|spider"), "Bot").when(low.contains("chrome") & ~low.contains("edg"), "Chrome").when(low.contains("firefox"), "Firefox")
        .when(low.contains("safari") & ~low.contains("chrome"), "Safari").when(low.contains("edg"), "Edge").otherwise("Other")
    )


def path_category(uri: Column) -> Column:
    """Kind of page by path."""
    static = uri.startswith("/assets/")
    for suffix in STATIC:
        static = static | uri.endswith(suffix)
    return (
        F.when(uri.isin("/", "/index.html"), "Homepage").when(uri.rlike(EVENT_PAGE), "Event Detail").when(uri == "/api/events", "Calendar API")
        .when(uri.startswith("/api/events/geocode"), "Location Search").when(uri.startswith("/api/"), "Other API").when(static, "Static Assets").otherwise("Other")
    )


def is_success(status: Column) -> Column:
    """2xx or 3xx."""
    return status.rlike("^[23]")
