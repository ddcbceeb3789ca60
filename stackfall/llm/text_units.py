"""Whole texts in small units that tokenizers cut at anyway, one window of a text at a time.

A unit begins with white space after a visible character: byte-level patterns end a match there,
and a vocabulary without white space inside its pieces never merges over that place. So the tokens of a
text are the tokens of its units, and a unit seen lately needs no second look.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import regex

#: Characters looked at together.
WINDOW = 1 << 18
#: Units remembered before those not met since then are forgotten.
MAX_UNITS = 150_000
#: Characters of a unit that is remembered beyond its portion.
LONG = 64
#: Characters of the texts whose unknown units are worked out together.
PORTION = 1 << 20

_BREAK = regex.compile(r"(?<=\S)(?=[ \n])")
_CROWDED = regex.compile(r"\s[ \n]").search
_ANY = regex.compile(r"\s*\S+(?:(?![ \n])\s+\S+)*(?:(?![ \n])\s+)?|\s+").findall


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Consecutive parts of a text, cut only where a space or line feed follows a visible character."""
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:] if start else text


def units(window: str) -> list[str]:
    """All characters of a window in units; a space or line feed after a visible character begins one."""
    if "\0" in window or _CROWDED(window):
        return _ANY(window)
    parts = window.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


def is_word(unit: str) -> bool:
    """Letters only, or a space and letters only: byte-level patterns match it as a whole."""
    return unit.isalpha() or unit[:1] == " " and unit[1:].isalpha()


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the cycle collector, which would walk over all that is remembered time and again:
    the many small objects made here refer to no cycle and go when they are let go."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memory:
    """Values by unit, made for many units together; those not met lately are forgotten.

    Units that have been learned last can all be looked up; long ones only until the next time.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int = MAX_UNITS) -> None:
        self.make, self.limit = make, limit
        self.known: dict = {}
        self.older: dict = {}
        self.long: list[str] = []
        #: the value of a unit
        self.get = self.known.__getitem__

    def learn(self, found: Iterable[Iterable[str]]) -> None:
        """See to it that the units of all these lists can be looked up."""
        known = self.known
        for unit in self.long:
            del known[unit]
        if len(known) >= self.limit:
            self.older = dict(known)
            known.clear()
        wanted = set().union(*found).difference(known)
        older = self.older
        met = older.keys() & wanted  # looks up what is wanted, not all that is remembered
        fresh = list(wanted.difference(met)) if met else list(wanted)
        for unit in met:
            known[unit] = older[unit]
        known.update(zip(fresh, self.make(fresh)))
        self.long = [unit for unit in fresh if len(unit) > LONG]


def portions(texts: Iterable[str | None], size: int = PORTION) -> Iterator[list[tuple[int, list[str]]]]:
    """``(position of the text, its units)`` of many texts, in portions of about ``size`` characters;
    a long text comes window by window, a text without characters not at all."""
    held, total = [], 0
    for place, text in enumerate(texts):
        for window in windows(text or ""):
            held.append((place, units(window)))
            total += len(window)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held
