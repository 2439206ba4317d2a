"""Python's regular expressions as Java's: the parsed pattern is written out again in constructs that both read alike."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as reader

#: What Python's \s matches in text, beyond and including ASCII.
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"
_CLASSES = {"DIGIT": (r"\p{Nd}", "0-9"), "SPACE": (_SPACE, r"\x09-\x0d\x20"), "WORD": (r"\p{L}\p{N}_", "A-Za-z0-9_")}


def java(pattern: str) -> str:
    """A pattern for Java's find that finds what re.search finds. What Python rejects, or Java has no counterpart for, raises ValueError."""
    try:
        re.compile(pattern)
        parsed = reader.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(f"invalid regular expression '{pattern}': {e}") from e
    out = _Writer(pattern).sequence(parsed, parsed.state.flags)
    # Java looks behind by whole characters only where the pattern itself shows one beyond the first 65,536.
    return out + "(?:\U00010000){0}" if "(?<" in out else out


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}"


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    for i, c in enumerate(codes):
        start = c if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(_char(start) if start == c else f"{_char(start)}-{_char(c)}")
            start = None
    return "".join(out)


class _Writer:
    def __init__(self, pattern: str):
        self.pattern, self.repeats, self.repeated = pattern, 0, set()

    def refuse(self, what: str):
        raise ValueError(f"invalid regular expression '{self.pattern}': {what} can't be searched for here")

    def sequence(self, items, flags: int) -> str:
        return "".join(self.one(op, value, flags) for op, value in items)

    def category(self, name: str, flags: int) -> tuple[bool, str]:
        """Whether it is negated, and the inside of a bracket."""
        kind = name.removeprefix("CATEGORY_")
        return kind.startswith("NOT_"), _CLASSES[kind.removeprefix("NOT_")][bool(flags & re.ASCII)]

    def set_of(self, items, flags: int) -> str:
        """One character out of a set."""
        if flags & re.IGNORECASE:
            return self.folded(items, flags)
        negated, parts = False, []
        for op, value in items:
            if op is sre.NEGATE:
                negated = True
            elif op is sre.LITERAL:
                parts.append(_char(value))
            elif op is sre.RANGE:
                parts.append(f"{_char(value[0])}-{_char(value[1])}")
            else:
                inverse, inside = self.category(str(value), flags)
                parts.append(f"[^{inside}]" if inverse else inside)
        return f"[{'^' * negated}{''.join(parts)}]"

    def folded(self, items, flags: int) -> str:
        """The characters that a set matches if case doesn't count, found by asking Python for each."""
        negated = any(op is sre.NEGATE for op, _ in items)
        text = ""
        for op, value in items:
            if op is sre.LITERAL:
                text += f"\\U{value:08x}"
            elif op is sre.RANGE:
                text += f"\\U{value[0]:08x}-\\U{value[1]:08x}"
            elif op is sre.CATEGORY:
                kind = str(value).removeprefix("CATEGORY_")
                letter = kind.removeprefix("NOT_")[0]
                text += "\\" + (letter if kind.startswith("NOT_") else letter.lower())
        own = re.compile(f"[{text}]", re.IGNORECASE | flags & re.ASCII)
        found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and own.match(chr(c))]
        return f"[{'^' * negated}{_ranges(found)}]" if found else "(?!)"

    def one(self, op, value, flags: int) -> str:
        if op is sre.LITERAL:
            return self.folded([(op, value)], flags) if flags & re.IGNORECASE else _char(value)
        if op is sre.NOT_LITERAL:
            return self.set_of([(sre.NEGATE, None), (sre.LITERAL, value)], flags)
        if op is sre.ANY:
            return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\x0a]"
        if op is sre.IN:
            return self.set_of(value, flags)
        if op is sre.BRANCH:
            return f"(?:{'|'.join(self.sequence(x, flags) for x in value[1])})"
        if op is sre.SUBPATTERN:
            group, more, fewer, inside = value
            self.repeated |= {group} if self.repeats else set()
            return f"({'?:' if group is None else ''}{self.sequence(inside, (flags | more) & ~fewer)})"
        if op is sre.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inside = value
            if low > 2**31 - 1 or (high is not sre.MAXREPEAT and high > 2**31 - 1):
                self.refuse("so many repeats")
            most = "" if high is sre.MAXREPEAT else str(int(high))
            self.repeats += 1
            once = self.sequence(inside, flags)
            self.repeats -= 1
            return f"(?:{once}){{{int(low)},{most}}}" + {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}[op]
        if op is sre.GROUPREF:
            if flags & re.IGNORECASE:
                self.refuse("a back-reference regardless of case")
            if value in self.repeated:  # Java keeps what a repeat has given back
                self.refuse("a back-reference to a repeated group")
            return f"(?:\\{value})"
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            way, inside = value
            return f"(?{'<' if way < 0 else ''}{'=' if op is sre.ASSERT else '!'}{self.sequence(inside, flags)})"
        if op is sre.FAILURE:
            return "(?!)"
        if op is sre.AT:
            return self.at(str(value), flags)
        self.refuse("a conditional group" if op is sre.GROUPREF_EXISTS else str(op).lower())

    def at(self, place: str, flags: int) -> str:
        word = f"[{_CLASSES['WORD'][bool(flags & re.ASCII)]}]"
        lines = bool(flags & re.MULTILINE)
        return {
            "AT_BEGINNING": r"(?:\A|(?<=\x0a))" if lines else r"\A", "AT_BEGINNING_STRING": r"\A", "AT_END": r"(?=\x0a|\z)" if lines else r"(?=\x0a?\z)", "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", "AT_NON_BOUNDARY": f"(?!\\A\\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
        }[place]
