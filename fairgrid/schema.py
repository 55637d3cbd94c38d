"""Query parameters and row schemas."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from urllib.parse import parse_qsl, urlencode

#: Columns whose change makes an event worth writing; images and bookkeeping times don't.
COMPARED_EVENT = [
    "name", "description", "location", "address", "city", "state", "country", "latitude", "longitude", "start_date", "start_time", "end_date",
    "event_type", "organizer", "player_count", "capacity", "price", "url", "shop_id", "geohash3", "shop_name", "shop_latitude", "shop_longitude",
]
COMPARED_SHOP = ["name", "location_text", "latitude", "longitude", "geohash3", "geohash4"]

WIRE_STORE = "struct<id:long,name:string,full_address:string,city:string,state:string,country:string,latitude:double,longitude:double,website:string,email:string>"
WIRE_FIELDS = {
    "id": "long", "name": "string", "description": "string", "start_datetime": "string", "end_datetime": "string", "full_address": "string", "latitude": "double", "longitude": "double",
    "event_format": "string", "event_type": "string", "cost_in_cents": "long", "currency": "string", "capacity": "int", "registered_user_count": "int", "full_header_image_url": "string",
    "event_configuration_template": "string", "store": WIRE_STORE,
}
WIRE_EVENT = "struct<" + ",".join(f"{name}:{kind}" for name, kind in WIRE_FIELDS.items()) + ">"
WIRE_PAGE = f"page_size int, count int, total int, current_page_number int, next_page_number int, results array<{WIRE_EVENT}>"

CALENDAR_LIMIT = 1000


@dataclass(frozen=True)
class EventQuery:
    """A search; None leaves a filter out."""

    page: int = 1
    limit: int = 20
    city: str | None = None
    state: str | None = None
    country: str | None = None
    start_from: str | None = None
    start_to: str | None = None
    search: str | None = None
    event_type: str | None = None
    lat: float | None = None
    lng: float | None = None
    radius_km: float = 100.0
    calendar_mode: bool = False
    wildcards: bool = False
    default_window_days: int | None = None

    def __post_init__(self) -> None:
        for name in ("lat", "lng", "radius_km"):
            value = getattr(self, name)
            if value is not None and not math.isfinite(value):
                raise ValueError(f"{name} is not a number")
        if self.limit < 0:
            raise ValueError("limit is negative")

    def key(self) -> str:
        """A shareable text of the filters: defaults left out, coordinates to four decimals, names in order."""
        told = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value != f.default and f.name not in ("page", "limit"):
                told[f.name] = f"{value:.4f}" if f.name in ("lat", "lng") else repr(float(value)) if f.name == "radius_km" else str(value)
        return urlencode(sorted(told.items()))

    @classmethod
    def of_key(cls, key: str) -> EventQuery:
        """The filters of :meth:`key`."""
        kinds = {"radius_km": float, "lat": float, "lng": float, "default_window_days": int, "calendar_mode": "True".__eq__, "wildcards": "True".__eq__}
        return cls(**{name: kinds.get(name, str)(value) for name, value in parse_qsl(key)})

    @property
    def window(self) -> tuple[int, int]:
        """(limit, offset); the calendar takes its first CALENDAR_LIMIT rows, pages below 1 count as 1."""
        return (CALENDAR_LIMIT, 0) if self.calendar_mode else (self.limit, max(0, (self.page - 1) * self.limit))
