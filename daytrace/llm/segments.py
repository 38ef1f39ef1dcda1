"""Cutting text where a byte-level BPE pattern is sure to begin a new match.

The pattern ends a match before a single space that stands between two characters which are not white space: no class of
the pattern runs across it, and the match that follows begins at that space whatever stands before. Such a place is a safe
boundary. A text is a list of segments, the first written out and each later one without the space that precedes it.
"""

from __future__ import annotations

import regex

_WHITE = regex.compile(r"\s").match


def white(ch: str) -> bool:
    return ch.isspace() or (ch > "\x7f" and _WHITE(ch) is not None)


def clean(part: str) -> bool:
    """Whether a part of ``text.split(' ')`` may stand between two safe boundaries."""
    return part != "" and not white(part[0]) and not white(part[-1])


def segments(text: str) -> list[str]:
    """The text cut at all its safe boundaries."""
    out: list[str] = []
    held: list[str] = []  # parts that belong to one segment
    for part in text.split(" "):
        if held and held[-1] != "" and part != "" and not white(held[-1][-1]) and not white(part[0]):
            out.append(" ".join(held))
            held = []
        held.append(part)
    out.append(" ".join(held))
    return out


class Unsafe(KeyError):
    """A part that is no segment of its own: the caller cuts that text with ``segments``."""
