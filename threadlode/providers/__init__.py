"""The seam to language models: a provider is a function of a prompt, and these are what it may raise. No network here."""

from __future__ import annotations

from threadlode.providers.errors import InvalidReply, Unavailable

__all__ = ["InvalidReply", "Unavailable"]
