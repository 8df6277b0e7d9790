"""Linear-time regular expression syntax on Spark's Java engine.

Patterns are written in the RE2 dialect. ``translate_regex`` rewrites what the two dialects
read differently and refuses what RE2 does not have (look-around, back-references,
possessive quantifiers).
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MAX_FILTER_PATTERN = 1024
MAX_REPEAT = 1000

# POSIX class names and their Java spelling.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
SPACES = r"\t\n\f\r "
_PLAIN_ESCAPES = set("AzdDwWafnrtQE")
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>")


class RegexError(ValueError):
    """A pattern outside the supported dialect."""


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.multiline = [False]

    def run(self) -> str:
        while self.at < len(self.text):
            self._next()
        if len(self.multiline) != 1:
            raise RegexError(f"missing closing ): {self.text!r}")
        return "(?d)" + "".join(self.out)

    def _emit(self, java: str, used: int) -> None:
        self.out.append(java)
        self.at += used

    def _next(self) -> None:
        char = self.text[self.at]
        if char == "\\":
            self._escape(in_class=False)
        elif char == "[":
            self._char_class()
        elif char == "(":
            self._group()
        elif char == ")":
            if len(self.multiline) == 1:
                raise RegexError(f"unexpected ): {self.text!r}")
            self.multiline.pop()
            self._emit(")", 1)
        elif char == "$":
            self._emit("$" if self.multiline[-1] else r"\z", 1)
        elif char in "*+?":
            self._quantifier(char, 1)
        elif char == "{":
            repeat = _REPEAT.match(self.text, self.at)
            if repeat is None:
                self._emit(r"\{", 1)
            elif max(int(n) for n in (repeat[1], repeat[3] or "0")) > MAX_REPEAT:
                raise RegexError(f"repeat count too large: {repeat[0]}")
            else:
                self._quantifier(repeat[0], len(repeat[0]))
        elif char in "}]":
            self._emit("\\" + char, 1)
        else:
            self._emit(char, 1)

    def _quantifier(self, java: str, used: int) -> None:
        self._emit(java, used)
        if self.text.startswith("?", self.at):
            self._emit("?", 1)
        if self.at < len(self.text) and (
            self.text[self.at] in "*+?" or _REPEAT.match(self.text, self.at)
        ):
            raise RegexError(f"invalid nested repetition: {self.text!r}")

    def _group(self) -> None:
        flags = _FLAGS.match(self.text, self.at)
        named = _NAMED.match(self.text, self.at)
        if named:
            self.multiline.append(self.multiline[-1])
            self._emit("(", len(named[0]))
        elif flags:
            on, off, end = flags[1], flags[2] or "", flags[3]
            if "U" in on + off:
                raise RegexError("the ungreedy flag is not supported")
            multiline = "m" in on or (self.multiline[-1] and "m" not in off)
            if end == ":":
                self.multiline.append(multiline)
            else:
                self.multiline[-1] = multiline
            self._emit(flags[0], len(flags[0]))
        elif self.text.startswith("(?", self.at):
            raise RegexError(f"unsupported group: {self.text[self.at:self.at + 4]!r}")
        else:
            self.multiline.append(self.multiline[-1])
            self._emit("(", 1)

    def _escape(self, in_class: bool) -> None:
        if self.at + 1 >= len(self.text):
            raise RegexError("trailing backslash")
        char = self.text[self.at + 1]
        if char == "s":
            self._emit(SPACES if in_class else f"[{SPACES}]", 2)
        elif char == "S":
            self._emit(f"[^{SPACES}]", 2)
        elif char == "v":
            self._emit(r"\x0B", 2)
        elif char in "bB" and not in_class:
            edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
            inside = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
            self._emit(edge if char == "b" else inside, 2)
        elif char in "pP":
            self._property()
        elif char == "x":
            found = re.compile(r"\\x(\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})").match(self.text, self.at)
            if found is None:
                raise RegexError("invalid \\x escape")
            self._emit(found[0], len(found[0]))
        elif char.isdigit():
            octal = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(self.text, self.at)
            if octal is None:
                raise RegexError("back-references are not supported")
            self._emit(f"\\x{{{int(octal[1], 8):x}}}", len(octal[0]))
        elif char == "Q" and not in_class:
            end = self.text.find("\\E", self.at)
            stop = len(self.text) if end < 0 else end
            literal = self.text[self.at + 2:stop]
            self._emit("".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in literal),
                       stop - self.at + (2 if end >= 0 else 0))
        elif char in _PLAIN_ESCAPES and char not in "QE":
            if in_class and char in "Az":
                raise RegexError(f"invalid escape \\{char} in a class")
            self._emit("\\" + char, 2)
        elif ord(char) < 128 and not char.isalnum():
            self._emit("\\" + char, 2)
        else:
            raise RegexError(f"invalid escape \\{char}")

    def _property(self) -> None:
        found = re.compile(r"\\([pP])(?:([A-Z])|\{(\^?)([A-Za-z_]+)\})").match(self.text, self.at)
        if found is None:
            raise RegexError("invalid character property")
        name = found[2] or found[4]
        kind = {"p": "P", "P": "p"}[found[1]] if found[3] else found[1]
        java = name if len(name) <= 2 else "Is" + name
        self._emit(f"\\{kind}{{{java}}}", len(found[0]))

    def _char_class(self) -> None:
        self._emit("[", 1)
        if self.text.startswith("^", self.at):
            self._emit("^", 1)
        first = True
        while self.at < len(self.text):
            char = self.text[self.at]
            if char == "]" and not first:
                self._emit("]", 1)
                return
            posix = re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at)
            if posix:
                if posix[2] == "word":
                    self._emit(r"\W" if posix[1] else r"\w", len(posix[0]))
                elif posix[2] in POSIX:
                    kind = "P" if posix[1] else "p"
                    self._emit(f"\\{kind}{{{POSIX[posix[2]]}}}", len(posix[0]))
                else:
                    raise RegexError(f"unknown class {posix[0]}")
            elif char == "\\":
                self._escape(in_class=True)
            elif char in "[]&":
                self._emit("\\" + char, 1)
            else:
                self._emit(char, 1)
            first = False
        raise RegexError(f"missing closing ]: {self.text!r}")


def translate_regex(pattern: str) -> str:
    """The Java pattern that matches the same texts."""
    return _Translator(pattern).run()


def checked_regexes(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Translate the patterns and have the driver's JVM compile each once; no query runs. Raises if one is invalid."""
    java = [translate_regex(p) for p in patterns]
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for source, pattern in zip(patterns, java):
        try:
            compile_(pattern)
        except Py4JJavaError as error:
            raise RegexError(f"invalid regex pattern {source!r}") from error
    return java
