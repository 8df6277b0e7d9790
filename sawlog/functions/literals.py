"""Texts that every match of a pattern must contain, and finding many of them at once."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

LEAST_LITERAL = 3
_QUANTIFIER = re.compile(r"(?:([*?+])|\{(\d+)(?:,\d*)?\})\??")
_GROUP = re.compile(r"\((?:\?:|\?P?<\w+>|(?!\?))")
_CLASS = re.compile(r"\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]", re.DOTALL)
_NOT_TEXT = "AzdDwWsSbBafnrtv"


class _Unknown(Exception):
    """A part of a pattern this reading does not go into."""


class _Reader:
    """One pass over a pattern in the linear-time dialect."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def choices(self) -> set[str] | None:
        """Of the branches up to a closing parenthesis or the end; None if one of them needs no text."""
        found = [self._branch()]
        while self.text.startswith("|", self.at):
            self.at += 1
            found.append(self._branch())
        return None if None in found else set().union(*found)

    def _branch(self) -> set[str] | None:
        offers: list[set[str]] = []
        run = ""
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            char, inner = self._atom()
            least, repeated = self._repeats()
            if char is not None and least > 0:
                run += char
            elif inner and least > 0:
                offers.append(inner)
            if char is None or repeated:
                offers.append({run})
                run = ""
        offers.append({run})
        best = max(offers, key=lambda texts: min(map(len, texts)))
        return best if min(map(len, best)) >= LEAST_LITERAL else None

    def _repeats(self) -> tuple[int, bool]:
        found = _QUANTIFIER.match(self.text, self.at)
        if found is None:
            return 1, False
        self.at = found.end()
        return (int(found[2]) if found[2] else int(found[1] == "+")), True

    def _atom(self) -> tuple[str | None, set[str] | None]:
        """The next character if it stands for itself, or what a group needs."""
        char = self.text[self.at]
        if char == "(":
            opened = _GROUP.match(self.text, self.at)
            if opened is None:
                raise _Unknown  # flags change how all that follows is read
            self.at = opened.end()
            inner = self.choices()
            self.at += 1
            return None, inner
        if char == "[":
            found = _CLASS.match(self.text, self.at)
            if found is None:
                raise _Unknown
            self.at = found.end()
            return None, None
        if char == "\\":
            escaped = self.text[self.at + 1]
            self.at += 2
            if escaped in _NOT_TEXT:
                return None, None
            if escaped.isalnum():
                raise _Unknown
            return escaped, None
        self.at += 1
        return (None if char in ".^$" else char), None


def required_texts(pattern: str) -> set[str] | None:
    """Texts of which each match of a valid pattern contains one at least, in lower case (A-Z only); None if none are known."""
    try:
        found = _Reader(pattern).choices()
    except _Unknown:
        return None
    return None if found is None or any("�" in text for text in found) else {_lower(text) for text in found}


def _lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@functools.lru_cache(maxsize=4)
def _automaton(texts: tuple[tuple[str, tuple[int, ...]], ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for text, numbers in texts:
        machine.add_word(text, numbers)
    machine.make_automaton()
    return machine


def holders(column: Column, needed: dict[int, set[str]]) -> Column:
    """The numbers, ascending, of which a required text occurs in the column, whatever the case of A-Z: one pass over the text for all.

    Null gives an empty list. A text that is not valid UTF-8 is read with replacement characters, as patterns read it.
    """
    owners: dict[str, list[int]] = {}
    for number, texts in needed.items():
        for text in texts:
            owners.setdefault(text, []).append(number)
    texts = tuple((text, tuple(numbers)) for text, numbers in sorted(owners.items()))

    @F.arrow_udf("array<int>")
    def found(values: pa.Array) -> pa.Array:
        machine = _automaton(texts)
        lists = []
        for value in values.to_pylist():
            met = {numbers for _, numbers in machine.iter(_read(value))} if value else ()
            lists.append(sorted({number for numbers in met for number in numbers}))
        return pa.array(lists, pa.list_(pa.int32()))

    return found(column.cast("binary"))


def _read(value: bytes) -> str:
    # Lower case of single bytes leaves every byte of a longer character alone.
    return value.lower().decode("utf-8", "replace")
