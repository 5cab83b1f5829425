"""Settings with defaults, read from the environment, and a cache whose entries grow old."""

from __future__ import annotations

import os
import time
from collections import OrderedDict
from dataclasses import dataclass, fields

PREFIX = "QUARRY_"


@dataclass(frozen=True)
class Config:
    """Default values are fixed; an absent or unreadable variable leaves one as it is."""

    server_port: int = 4174
    batch_size: int = 50
    batch_flush_secs: int = 2
    event_bus_capacity: int = 256
    max_file_bytes: int = 20 << 20
    search_default_limit: int = 20
    llm_max_concurrent: int = 1
    llm_timeout_secs: int = 180
    persist_events: bool = False


def from_env(env=os.environ) -> Config:
    """A flag is on for true, 1 and yes and off for anything else."""
    own = {}
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper())
        if raw is None:
            continue
        if isinstance(f.default, bool):
            own[f.name] = raw in ("true", "1", "yes")
        elif raw.strip().lstrip("+").isdigit():
            own[f.name] = int(raw)
    return Config(**own)


class Answers:
    """At most ``most`` answers, each for ``seconds``; the oldest goes first."""

    def __init__(self, most: int = 500, seconds: float = 600, clock=time.monotonic):
        self.most, self.seconds, self.clock, self.held = most, seconds, clock, OrderedDict()

    def get(self, key, make):
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        self.held.pop(key, None)
        self.held[key] = (now, make())
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return self.held[key][1]
