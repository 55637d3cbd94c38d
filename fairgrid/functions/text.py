"""Text rules of the calendar: categories, prices, cities, display names, lists and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event categories and their colours.
PRE_RIFT, SKIRMISH, NEXUS, OTHER = "Pre-Rift", "Summoner Skirmish", "Nexus Night", "Other"
COLOURS = {NEXUS: "#bd93f9", SKIRMISH: "#ff79c6", PRE_RIFT: "#73d393", OTHER: "#6272a4"}
# Words that tell a place outside the US.
NON_US = [
    "uk", "united kingdom", "england", "scotland", "wales", "ireland", "canada", "australia", "germany", "france",
    "spain", "italy", "japan", "mexico", "brazil", "india", "china", "netherlands", "belgium", "sweden", "norway",
    "denmark", "finland", "poland", "austria", "switzerland", "portugal", "greece", "new zealand", "south africa",
    "singapore",
]
# Place types worth indexing, headings of buylists, currency signs.
PLACE_TYPES = [
    "city", "town", "village", "hamlet", "suburb", "neighbourhood", "borough", "county", "district", "state",
    "province", "region", "country", "municipality", "locality",
]
HEADINGS = "(?i)^(Legend|Champion|MainDeck|Battlefields?|Runes?|Sideboard|Deck|Main|Side)$"
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£"}


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def normalised(c: Column) -> Column:
    """Key form: trimmed lower case."""
    return F.lower(F.trim(c))


def contains_text(c: Column, term: str, wildcards: bool = False) -> Column:
    """Case-blind substring; ``%`` and ``_`` are literal unless ``wildcards``. Null doesn't match."""
    hit = c.ilike(f"%{term}%") if wildcards else F.contains(F.lower(c), F.lower(F.lit(term)))
    return F.coalesce(hit, F.lit(False))


def infer_category(name: Column, description: Column) -> Column:
    """Category told from name and description."""
    text = F.concat(name, F.lit(" "), F.coalesce(description, F.lit("")))
    low = F.lower(text)
    return F.when(text.rlike(r"(?i)pre[\s-]?rift"), PRE_RIFT).when(low.contains("summoner skirmish"), SKIRMISH).when(low.contains("nexus night"), NEXUS).otherwise(OTHER)


def template_category(name: Column) -> Column:
    """Category told from a template's name, or null."""
    found = infer_category(name, F.lit(None).cast("string"))
    return F.when(found != OTHER, found)


def format_price(cents: Column, currency: Column) -> Column:
    """Price text: ``Free`` for 0, else sign and two decimals from whole cents."""
    sign = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), currency), F.lit(""))
    digits = F.concat(F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return F.when(cents == 0, F.lit("Free")).otherwise(F.concat(sign, F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), digits))


def city_from_address(address: Column, city: Column, state: Column) -> Column:
    """The store's city when it looks like one, else the likeliest part of the address, else the city as it is."""
    good = F.coalesce((blank_to_null(city).isNotNull()) & (~city.eqNullSafe(state)) & (F.length(city) > 2), F.lit(False))
    parts = F.transform(F.split(address, ","), lambda x: F.trim(x))
    inner = F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 3, F.lit(0))))
    likely = F.get(F.filter(inner, lambda p: ~p.rlike(r"^\d{5}") & ~p.rlike("^[A-Z]{2}$") & (F.length(p) > 3)), F.lit(0))
    return F.when(good, city).otherwise(F.coalesce(F.when(F.size(parts) >= 4, likely), city))


def is_non_us(query: Column) -> Column:
    """A country word stands in the query."""
    return F.lower(query).rlike(r"\b(" + "|".join(NON_US) + r")\b")


def is_zip(query: Column) -> Column:
    """Five digits, spaces around aside."""
    return F.trim(query).rlike(r"^\d{5}$")


def non_ascii(c: Column) -> Column:
    """A character beyond ASCII is there."""
    return c.rlike(r"[^\x00-\x7F]")


def display_name(*parts: Column, distinct: bool = True) -> Column:
    """Non-empty parts joined by comma, each once if ``distinct``."""
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept) if distinct else kept, ", ")


def format_city(city: Column, name: Column, state: Column, country: Column, code: Column) -> Column:
    """``City, State`` in the US, ``City, Country`` elsewhere, or the city alone."""
    own = F.coalesce(blank_to_null(city), blank_to_null(name))
    us = (F.upper(code) == "US") & blank_to_null(state).isNotNull()
    return F.when(own.isNull(), F.lit(None)).when(us, F.concat(own, F.lit(", "), state)).when(blank_to_null(country).isNotNull(), F.concat(own, F.lit(", "), country)).otherwise(own)


def provider_name(place: Column, region: Column, country: Column, address: Column) -> Column:
    """A provider's display name."""
    place, region, country = blank_to_null(place), blank_to_null(region), blank_to_null(country)
    return F.coalesce(F.concat(place, F.lit(", "), region), F.concat(place, F.lit(", "), country), blank_to_null(address), place, F.lit("Unknown Location"))


def buylist_lines(text: Column) -> Column:
    """Array of ``(quantity, card)`` of a buylist's lines: blanks, lines ending in a colon and headings are skipped.

    A quantity too large for an integer is null.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.endswith(":") & ~x.rlike(HEADINGS))
    counted = r"(?i)^(\d+)x?\s+(.+)$"
    return F.transform(
        lines,
        lambda x: F.when(x.rlike(counted), F.struct(F.regexp_extract(x, counted, 1).try_cast("int").alias("quantity"), F.trim(F.regexp_extract(x, counted, 2)).alias("card")))
        .otherwise(F.struct(F.lit(1).alias("quantity"), x.alias("card"))),
    )


def is_email(c: Column) -> Column:
    """Looks like an address."""
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def quick_line(quantity: Column, set_code: Column, number: Column, card: Column) -> Column:
    """``3x SET 12``, or the card's name."""
    code = F.concat(blank_to_null(set_code), F.lit(" "), blank_to_null(number))
    return F.concat(quantity.cast("string"), F.lit("x "), F.coalesce(code, card))


def metric_line(kind: Column, key: str, value: Column, success: Column) -> Column:
    """A geocoder metric line."""
    return F.concat(F.lit("[GEOCODE] type="), kind, F.lit(f' {key}="'), value, F.lit('" success='), success.cast("string"))


def metric_type(line: Column) -> Column:
    """The type of a metric line, or null."""
    return blank_to_null(F.regexp_extract(line, r"type=([a-z_]+)", 1))


def metric_success(line: Column) -> Column:
    """Whether the line tells success; null where it says nothing."""
    return F.when(line.contains("success=true"), True).when(line.contains("success=false"), False)


def event_title(time_text: Column, organizer: Column, city: Column) -> Column:
    """``time | organizer``, else city, else ``Event``."""
    return F.concat(time_text, F.lit(" | "), F.coalesce(blank_to_null(organizer), blank_to_null(city), F.lit("Event")))


def occupancy(players: Column, capacity: Column) -> Column:
    """``players/capacity`` with ``?`` for what is unknown."""
    return F.concat(F.coalesce(players.cast("string"), F.lit("?")), F.lit("/"), F.coalesce(capacity.cast("string"), F.lit("?")))


def first_forwarded(header: Column) -> Column:
    """The client's address in a forwarding header."""
    return F.trim(F.split_part(header, F.lit(","), F.lit(1)))
