"""Reading the answer to a bulk request as it arrives, whatever its length.

An answer is one JSON object: ``errors`` tells whether any item failed, ``items`` has one object per document, in the order of
the request, with the item's ``status`` under the name of its action. It is read in pieces of bounded size; what is kept is one
item at a time and the places of those that failed.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

# Names in a bulk answer.
ERRORS, ITEMS, STATUS, ERROR = "errors", "items", "status", "error"
#: Status from which on an item has failed, and those that a later try may mend.
FAILED, TOO_MANY, SERVER = 400, 429, 500
READ_BYTES = 1 << 16
_SPACE = " \t\n\r"


class AnswerError(ValueError):
    """An answer that is not one whole JSON object of the expected form."""


@dataclass
class Answer:
    """What a bulk answer says: whether any item failed, how many items it has, and status and reason of those that failed, by place."""

    errors: bool = False
    items: int = 0
    failed: dict[int, tuple[int, str]] = field(default_factory=dict)

    def again(self) -> list[int]:
        """Places of failed items that another try may mend."""
        return [place for place, (status, _) in self.failed.items() if status == TOO_MANY or status >= SERVER]

    def refused(self) -> dict[int, tuple[int, str]]:
        """Failed items that no further try can mend."""
        return {place: told for place, told in self.failed.items() if not (told[0] == TOO_MANY or told[0] >= SERVER)}


def pieces_of(response, size: int = READ_BYTES) -> Iterator[bytes]:
    """The body of a response in pieces."""
    while piece := response.read(size):
        yield piece


class _Text:
    """Text that arrives in pieces; what has been read is given up."""

    def __init__(self, pieces: Iterable[bytes]):
        self._pieces, self._decode = iter(pieces), codecs.getincrementaldecoder("utf-8")()
        self.held, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Takes in the next piece; false at the end."""
        if self.ended:
            return False
        piece = next(self._pieces, None)
        try:
            new = self._decode.decode(piece or b"", final=piece is None)
        except UnicodeDecodeError as error:
            raise AnswerError(f"the answer is not UTF-8: {error}") from error
        self.ended = piece is None
        self.held, self.at = self.held[self.at :] + new, 0
        return True

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def expect(self, marks: str) -> str:
        mark = self.peek()
        if not mark or mark not in marks:
            raise AnswerError(f"expected one of {marks!r}, found {mark or 'the end'!r}")
        self.at += 1
        return mark

    def value_end(self) -> int:
        """Where the value ends that starts here; takes in as many pieces as it needs."""
        self.peek()
        i, depth, quoted = self.at, 0, False
        while True:
            while i < len(self.held):
                c = self.held[i]
                if quoted:
                    if c == "\\":
                        i += 1
                    elif c == '"':
                        quoted = False
                        if not depth:
                            return i + 1
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    depth += 1
                elif c in "}]":
                    if depth <= 1:
                        return i + 1 if depth else i
                    depth -= 1
                elif not depth and (c == "," or c in _SPACE):
                    return i
                i += 1
            i -= self.at
            if not self.more():
                return len(self.held)

    def value(self):
        end = self.value_end()
        try:
            found = json.loads(self.held[self.at : end])
        except ValueError as error:
            raise AnswerError(f"the answer breaks off or is not JSON: {error}") from error
        self.at = end
        return found


def _members(text: _Text) -> Iterator[str]:
    """Names of an object's members; the caller reads each value."""
    text.expect("{")
    if text.peek() == "}":
        text.at += 1
        return
    while True:
        name = text.value()
        if not isinstance(name, str):
            raise AnswerError("a member has no name")
        text.expect(":")
        yield name
        if text.expect(",}") == "}":
            return


def _elements(text: _Text) -> Iterator[int]:
    """Numbers of an array's elements; the caller reads each."""
    text.expect("[")
    if text.peek() == "]":
        text.at += 1
        return
    number = 0
    while True:
        yield number
        number += 1
        if text.expect(",]") == "]":
            return


def _status(item) -> tuple[int, str]:
    """Status and reason of an item such as ``{"index": {"status": 201}}``."""
    told = next(iter(item.values()), None) if isinstance(item, dict) else None
    if not isinstance(told, dict):
        raise AnswerError("an item without its action")
    status, error = told.get(STATUS), told.get(ERROR)
    if not isinstance(status, int):
        status = SERVER if error is not None else 0
    if isinstance(error, dict):
        error = error.get("reason") or error.get("type") or json.dumps(error)
    return status, str(error or "")


def read_answer(pieces: Iterable[bytes]) -> Answer:
    """Reads a whole answer. An empty one says that nothing failed; one that breaks off, or is no JSON object, raises."""
    text, answer = _Text(pieces), Answer()
    if not text.peek():
        return answer
    for name in _members(text):
        if name == ITEMS and text.peek() == "[":
            for place in _elements(text):
                status, reason = _status(text.value())
                answer.items += 1
                if status >= FAILED or reason:
                    answer.failed[place] = (status, reason)
        elif name == ERRORS:
            answer.errors = text.value() is True
        else:
            text.value()
    if text.peek():
        raise AnswerError("something follows the answer")
    return answer
