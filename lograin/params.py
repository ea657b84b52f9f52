"""Settings of a distillation run, passed explicitly to every operator."""

from __future__ import annotations

import socket
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Integration:
    """A service that receives the report of every interval."""

    url: str
    headers: Mapping[str, str] = field(default_factory=dict)
    on_aggregation: bool = False


@dataclass(frozen=True)
class Params:
    # Defaults users already rely on.
    id_log: str = field(default_factory=socket.gethostname)
    words: tuple[str, ...] = ()
    generate_logs_file: bool = False
    hour: str = "00:00:00"
    webhook_urls: tuple[str, ...] = ()
    limit_break: float = 10.0  # seconds
    report_interval: float = 60.0  # minutes
    integrations: tuple[Integration, ...] = ()
    destination: str = ""

    # Burst detection constants.
    severity_levels: tuple[str, ...] = ("ERROR", "CRITICAL")
    severity_threshold: int = 10
    overall_category: str = "AGGREGATE_TRAFFIC"
    overall_threshold: int = 100
    cooldown: float = 5.0  # seconds
    alert_cap: int = 10

    # Messages in one row of a payload, see operators.payloads.
    payload_messages: int = 10_000
    # Distinct timestamps one task should take, and the most it may, see operators.chain.
    slice_rows: int = 100_000
    max_group_rows: int = 8_000_000
    user_agent: str = "lograin/1"

    def __post_init__(self):
        if self.limit_break <= 0 or self.cooldown <= 0 or self.report_interval <= 0:
            raise ValueError("limit_break, cooldown and report_interval must be positive")

    @property
    def limit_us(self) -> int:
        return int(self.limit_break * 1_000_000)

    @property
    def cooldown_us(self) -> int:
        return int(self.cooldown * 1_000_000)

    @property
    def interval(self) -> str:
        return f"{int(self.report_interval * 60_000_000)} microseconds"

    @property
    def day_offset(self) -> str:
        hours, minutes, seconds = (int(part) for part in self.hour.split(":"))
        return f"{hours * 3600 + minutes * 60 + seconds} seconds"
