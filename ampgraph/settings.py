"""Settings of the live monitor and their coherence, checked on the driver before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from .errors import SettingsError
from .operators.detect import DetectorConfig
from .operators.windows import WindowConfig


def zone_filter(text: str | None) -> list[str] | None:
    """Trimmed names of a comma list; none if nothing is left."""
    return [z.strip() for z in (text or "").split(",") if z.strip()] or None


@dataclass(frozen=True)
class MonitorSettings:
    magnitude: str = "voltage"
    cycle_s: float = 3.0
    topology_check_s: float = 300.0
    top_k: int | None = 5
    zones: tuple[str, ...] | None = None
    topic_in: str = "net/readings/#"
    topic_out: str = "net-out"

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "MONITOR_") -> MonitorSettings:
        get = lambda k, d: env.get(prefix + k, d)
        zones = zone_filter(get("ZONES", ""))
        try:
            return cls(get("MAGNITUDE", "voltage"), float(get("CYCLE_S", "3")), float(get("TOPOLOGY_CHECK_S", "300")), int(get("TOP_K", "5")), tuple(zones) if zones else None)
        except ValueError as e:
            raise SettingsError(str(e)) from e

    def check(self, window: WindowConfig, detector: DetectorConfig) -> None:
        """The cycle runs at least twice a bin, checks are spaced, and windows agree; topics don't feed each other."""
        if not 0 < self.cycle_s <= window.bin_us / 2e6:
            raise SettingsError("the cycle is positive and at most half a bin")
        if self.topology_check_s <= 0 or (self.top_k is not None and self.top_k < 0):
            raise SettingsError("topology checks are spaced, and top_k isn't negative")
        if window.length != detector.window:
            raise SettingsError(f"windows of {window.length} bins, thresholds for {detector.window}")
        if self.topic_out.startswith(self.topic_in.rstrip("#").rstrip("/")):
            raise SettingsError("what is published would be read again")


def cycle_interval(bin_s: float, p99_s: float, most: int = 60) -> float | None:
    """The largest whole part of a bin that is at most half of it and at least twenty times the p99 cycle."""
    fits = [bin_s / k for k in range(2, most + 1) if bin_s / k <= bin_s / 2 and bin_s / k >= 20 * p99_s]
    return max(fits, default=None) if p99_s <= bin_s / 10 else None
