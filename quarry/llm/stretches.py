"""Whole texts in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator


def stretches(text: bytes, marks: tuple[bytes, ...], size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in order, each piece of some ``size`` bytes and ending with one of ``marks``; a run without a mark is never cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = max(text.rfind(m, at, end) for m in marks) + 1
            if end <= at:
                end = min((p for m in marks if (p := text.find(m, at + size)) >= 0), default=len(text) - 1) + 1
        yield text[at:end] if at or end < len(text) else text
        at = end
