"""Parameters of the dashboard queries: identity, local days, filters, limits."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class QueryParams:
    """Who asks, for which local days.  ``now`` is given, never read from a clock, so results repeat."""

    now: dt.datetime
    seat_id: str = ""
    org_id: str = ""
    account_id: str = ""
    local_all: bool = False
    tz: str = "UTC"
    start: dt.date | None = None
    end: dt.date | None = None
    app_slug: str = ""
    session_id: str = ""
    limit: int = 50
    filters: dict[str, str] = field(default_factory=dict)

    @property
    def zone(self) -> ZoneInfo:
        """The named zone; '' and unknown names count as UTC."""
        try:
            return ZoneInfo(self.tz or "UTC")
        except (ZoneInfoNotFoundError, ValueError):
            log.warning("unknown time zone %r, using UTC", self.tz)
            return ZoneInfo("UTC")

    def days(self) -> tuple[dt.date, dt.date]:
        """First and last local day; by default the 30 days up to today."""
        end = self.end or self.now.astimezone(self.zone).date()
        return self.start or end - dt.timedelta(days=30), end

    def window(self) -> tuple[dt.datetime, dt.datetime]:
        """The UTC instants [first local midnight, local midnight after the last day)."""
        first, last = self.days()
        midnight = lambda d: dt.datetime.combine(d, dt.time(), self.zone).astimezone(dt.UTC)
        return midnight(first), midnight(last + dt.timedelta(days=1))

    def prune_days(self) -> tuple[dt.date, dt.date] | None:
        """UTC days that surely hold the window, one day wider on both sides; None for a window not to be trusted."""
        since, until = self.window()
        if until <= since or since.year < 2000:
            return None
        return since.date() - dt.timedelta(days=1), until.date() + dt.timedelta(days=1)


def scope_all(deployment_is_local: bool, scope: str) -> bool:
    """Whether everyone's rows may be asked for: only where the deployment is one person's own, whatever the request says."""
    return deployment_is_local and scope == "all"


def clamp(limit: int, default: int, most: int) -> int:
    """A page size: not positive means the default, and never above the most."""
    return default if limit <= 0 else min(limit, most)
