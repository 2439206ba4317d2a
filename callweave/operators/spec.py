"""Selections and path patterns written as text, for those who type them.

    name  "quoted name"  /regex/  [label]  [a,b|!c]  []  !x  x:callers:callees   x y (either)
    paths:  a b   a | b   (a b)*   a ... b
"""

from __future__ import annotations

import re

from .automata import ANY, Alt, One, Pattern, Seq, Star
from .select import ALL, Label, Name, Not, Or, And, Regex, Selection

_TOKEN = re.compile(r'\s*(?:(?P<op>:(?:all_)?calle(?:rs|es))|(?P<any>\.\.\.)|(?P<word>[\w.]+)|"(?P<name>(?:\\.|[^"\\])*)"|/(?P<regex>(?:\\.|[^/\\])*)/|(?P<mark>[\[\]!,|()*]))', re.S)


class SpecError(ValueError):
    """What the text can't be read as, from where it fails."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                break
            self.tokens.append((m.lastgroup, m[m.lastgroup], at, at + len(m[0]) - len(m[0].lstrip())))
            at = m.end()
        self.rest, self.k = text[at:], 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.k][:2] if self.k < len(self.tokens) else (None, "")

    def take(self, *marks: str) -> bool:
        if self.peek()[0] == "mark" and self.peek()[1] in marks:
            self.k += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            self.fail()

    def fail(self):
        rest = self.text[self.tokens[self.k][2] :].strip() if self.k < len(self.tokens) else self.rest.strip()
        raise SpecError(f"invalid search terms at '{rest or self.text}'")

    def end(self) -> None:
        if self.k < len(self.tokens) or self.rest.strip():
            self.fail()

    def node(self, inside: bool) -> Selection:
        negated = self.take("!")
        group, value = self.peek()
        if group == "word":
            found: Selection = Label(value) if inside else Name(value)
            self.k += 1
        elif group == "name":
            found = Name(re.sub(r"\\(.)", r"\1", value, flags=re.S))
            self.k += 1
        elif group == "regex":
            try:
                found = Regex(re.sub(r"\\(.)", r"\1", value, flags=re.S))
            except ValueError as e:
                raise SpecError(str(e)) from e
            self.k += 1
        elif self.take("["):
            found = self.either()
            self.need("]")
        elif inside:
            found = ALL
        else:
            self.fail()
        found = Not(found) if negated else found
        while self.peek()[0] == "op":
            found = getattr(found, self.peek()[1][1:])()
            self.k += 1
        return found

    def either(self) -> Selection:
        parts = []
        while True:
            both = [self.node(True)]
            while self.take(","):
                both.append(self.node(True))
            parts.append(both[0] if len(both) == 1 else And(tuple(both)))
            if not self.take("|"):
                return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def starts_node(self) -> bool:
        group, value = self.peek()
        return group in ("word", "name", "regex") or group == "mark" and value in "![" and value != ""

    def path(self) -> Pattern:
        options = []
        while True:
            parts: list[Pattern] = []
            while self.starts_node() or self.peek()[0] == "any" or self.peek() == ("mark", "("):
                if self.peek()[0] == "any":
                    self.k += 1
                    parts.append(ANY)
                    continue
                if self.take("("):
                    atom = self.path()
                    self.need(")")
                else:
                    atom = One(self.node(False))
                if self.peek() == ("mark", "*") and self.tokens[self.k][2] == self.tokens[self.k][3]:
                    self.k += 1
                    atom = Star(atom)
                parts.append(atom)
            if not parts:
                self.fail()
            options.append(parts[0] if len(parts) == 1 else Seq(tuple(parts)))
            if not self.take("|"):
                return options[0] if len(options) == 1 else Alt(tuple(options))


def selection(text: str) -> Selection:
    """The union of the node specifications in a text. Bare words are names, in brackets labels; ! binds tighter than a step."""
    reader = _Reader(text)
    parts = [reader.node(False)]
    while reader.starts_node():
        parts.append(reader.node(False))
    reader.end()
    return parts[0] if len(parts) == 1 else Or(tuple(parts))


def pattern(text: str) -> Pattern:
    """The path pattern of a text. A star follows its atom directly."""
    reader = _Reader(text)
    found = reader.path()
    reader.end()
    return found
