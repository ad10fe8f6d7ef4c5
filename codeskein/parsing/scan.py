"""Helpers shared by the language readers: masking, bracket matching, splitting, doc comments."""

from __future__ import annotations

import bisect
import re

_PAIRS = {")": "(", "]": "[", "}": "{"}


def blank(pattern: re.Pattern, text: str, keep: str = "") -> str:
    """Replace matches by blanks of the same length, newlines kept. Matches that start with one
    of the characters in `keep` stay."""

    def wipe(m: re.Match) -> str:
        found = m.group()
        return found if keep and found[0] in keep else re.sub(r"[^\n]", " ", found)

    return pattern.sub(wipe, text)


_BRACKETS = re.compile(r"[(){}\[\]]")


def closing(code: str, opening: int) -> int:
    """Where the bracket at `opening` is closed, as `Outline.closing` tells it, without looking at the rest of the text."""
    stack: list[str] = []
    for m in _BRACKETS.finditer(code, max(opening, 0)):
        char = m.group()
        if char in "({[":
            stack.append(char)
        elif stack[-1] == _PAIRS[char]:
            stack.pop()
            if not stack:
                return m.start()
    return len(code) - 1


class Outline:
    """Bracket structure and line numbers of one text whose strings and comments are blank."""

    def __init__(self, code: str):
        self.code = code
        self.close: dict[int, int] = {}
        self._at, self._depth = [-1], [0]
        self._lines = [m.start() for m in re.finditer("\n", code)]
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", code):
            i, char = m.start(), m.group()
            if char in "({[":
                stack.append(i)
            elif stack and code[stack[-1]] == _PAIRS[char]:
                self.close[stack.pop()] = i
            self._at.append(i)
            self._depth.append(len(stack))

    def depth(self, i: int) -> int:
        """Open brackets before position `i`."""
        return self._depth[bisect.bisect_left(self._at, i) - 1]

    def line(self, i: int) -> int:
        return bisect.bisect_left(self._lines, i) + 1

    def closing(self, i: int) -> int:
        return self.close.get(i, len(self.code) - 1)

    def find(self, chars: str, start: int) -> int:
        """First of `chars` at the depth of `start`, or the end of the text."""
        level = self.depth(start)
        for m in re.compile(f"[{re.escape(chars)}]").finditer(self.code, start):
            if self.depth(m.start()) <= level:
                return m.start()
        return len(self.code)

    def skip_angles(self, i: int) -> int:
        """Position after a `<...>` that starts at `i` (blanks allowed), else `i`."""
        start = re.compile(r"\s*").match(self.code, i).end()
        if self.code[start : start + 1] != "<":
            return i
        level = 0
        for m in re.compile(r"->|=>|[<>]").finditer(self.code, start):
            level += {"<": 1, ">": -1}.get(m.group(), 0)
            if level == 0:
                return m.end()
        return i

    def body(self, i: int, type_marks: str) -> int:
        """The `{` that opens a body after `i`; one that follows a type mark belongs to a type.

        Returns -1 if the declaration ends without a body.
        """
        while True:
            i = self.find("{;", i)
            if i >= len(self.code) or self.code[i] == ";":
                return -1
            end = i
            while end and self.code[end - 1].isspace():  # comments are masked by blanks of any length
                end -= 1
            if not re.search(type_marks, self.code[max(end - 40, 0) : end]):
                return i
            i = self.closing(i) + 1


def split_top(text: str) -> list[str]:
    """Split at commas outside of brackets, angle brackets included; arrows do not count."""
    parts, level, start = [], 0, 0
    for m in re.finditer(r"[-=]>|[(\[{<]|[)\]}>]|,", text):
        token = m.group()
        if token in "([{<":
            level += 1
        elif token in ")]}>":
            level -= 1
        elif token == "," and level == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def comment_above(lines: list[str], line: int, marks: tuple[str, ...]) -> str | None:
    """Comment lines right above a 1-based line; blank lines between them are stepped over."""
    found: list[str] = []
    for i in range(line - 2, -1, -1):
        text = lines[i].strip()
        mark = next((m for m in marks if text.startswith(m)), None)
        if mark:
            found.append(text[len(mark) :].strip())
        elif text:
            break
    return "\n".join(reversed(found)) if found else None
