"""What a provider may raise."""

from __future__ import annotations

import time


class Unavailable(Exception):
    """Every model that could be asked is cooling down, until ``until`` (epoch seconds) at the earliest."""

    def __init__(self, until: float):
        super().__init__(f"no model before {time.strftime('%Y-%m-%d %H:%M', time.gmtime(until))} UTC")
        self.until = until

    def __reduce__(self):
        return type(self), (self.until,)


class InvalidReply(Exception):
    """The model answered, but not with the JSON that was asked for."""
