"""The hex-pattern language: tokens, anchors, and regexes for the JVM and for Python.

Tokens: aabb literal; ?? any byte; a? and ?a nibbles; {n} {n-m} {-n} {n-} and [..] skips; *
any skip; (aa|bbcc) the first alternative that fits, for good; !(aa|bb) none of them, as wide
as the first; (B) fails between two alphanumeric bytes; (L) a line end or the object's
bounds; (W) one byte that isn't alphanumeric.

A rule is found through its anchor, its longest literal (the first of equals). The start is
the anchor's place minus its distance in the pattern, not below 0; a variable skip before
the anchor makes that distance infinite, so that such a rule starts at byte 0 only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

INFINITE = None
ALNUM = "[0-9A-Za-z]"
_SKIP = re.compile(r"(?:(\+?\d+)|-(\+?\d+)|(\+?\d+)-|(\+?\d+)-(\+?\d+))")


class PatternError(ValueError):
    pass


def _skip(inner: str) -> tuple:
    m = _SKIP.fullmatch(inner.strip())
    if not m:
        raise PatternError(f"skip {inner!r}")
    n, up_to, at_least, low, high = (x and int(x) for x in m.groups())
    if n is not None:
        return ("skip", n, n)
    if up_to is not None:
        return ("skip", 0, up_to)
    if at_least is not None:
        return ("skip", at_least, None)
    if high < low:
        raise PatternError(f"skip {inner!r}")
    return ("skip", low, high)


def _group(inner: str) -> tuple:
    if inner in ("B", "L", "W"):
        return (inner,)
    options = []
    for option in inner.split("|"):
        option = option.strip()
        if not re.fullmatch(r"(?:[0-9a-fA-F]{2})+", option):
            raise PatternError(f"alternative {option!r}")
        options.append(bytes.fromhex(option))
    return ("alt", tuple(options), False)


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return i
    raise PatternError("unclosed (")


def tokenize(text: str) -> list[tuple]:
    """Tokens of a pattern; PatternError if it isn't one."""
    text, out, i = text.strip(), [], 0
    literal = bytearray()

    def flush():
        if literal:
            out.append(("lit", bytes(literal)))
            literal.clear()

    while i < len(text):
        c = text[i]
        pair = text[i : i + 2]
        if c in " \t\r\n":
            i += 1
        elif re.fullmatch("[0-9a-fA-F]{2}", pair):
            literal += bytes.fromhex(pair)
            i += 2
        else:
            flush()
            if c == "*":
                out.append(("skip", 0, None))
                i += 1
            elif c in "{[":
                end = text.find("}" if c == "{" else "]", i)
                if end < 0:
                    raise PatternError(f"unclosed {c}")
                out.append(_skip(text[i + 1 : end]))
                i = end + 1
            elif c == "(":
                end = _closing(text, i)
                out.append(_group(text[i + 1 : end]))
                i = end + 1
            elif pair == "!(":
                end = _closing(text, i + 1)
                token = _group(text[i + 2 : end])
                if token[0] != "alt":
                    raise PatternError("only alternatives can be negated")
                out.append(("alt", token[1], True))
                i = end + 1
            elif pair == "??":
                out.append(("any",))
                i += 2
            elif re.fullmatch(r"\?[0-9a-fA-F]", pair):
                out.append(("nibble", None, int(pair[1], 16)))
                i += 2
            elif re.fullmatch(r"[0-9a-fA-F]\?", pair):
                out.append(("nibble", int(pair[0], 16), None))
                i += 2
            else:
                raise PatternError(f"unexpected {pair!r}")
    flush()
    if not out:
        raise PatternError("empty pattern")
    return out


def _bytes(b: bytes) -> str:
    return "".join(f"\\x{x:02x}" for x in b)


def _regex(tokens: list[tuple], end: str) -> str:
    """A regex of the tokens over one character a byte; end is the flavour's end of input."""
    out = []
    for t in tokens:
        match t:
            case ("lit", b):
                out.append(_bytes(b))
            case ("any",):
                out.append(".")
            case ("nibble", None, low):
                out.append("[" + "".join(f"\\x{h:x}{low:x}" for h in range(16)) + "]")
            case ("nibble", high, None):
                out.append(f"[\\x{high:x}0-\\x{high:x}f]")
            case ("skip", low, None):
                out.append(f".{{{low},}}?")
            case ("skip", low, high):
                out.append(f".{{{low}}}" if low == high else f".{{{low},{high}}}?")
            case ("alt", options, False):
                out.append("(?>" + "|".join(map(_bytes, options)) + ")")
            case ("alt", options, True):
                width = len(options[0])
                out.append("(?!" + "|".join(_bytes(o) for o in options if len(o) == width) + f").{{{width}}}")
            case ("B",):
                out.append(f"(?:(?<!{ALNUM})|(?!{ALNUM}))")
            case ("L",):
                out.append(rf"(?>\A|{end}|\n|\r\n?)")
            case ("W",):
                out.append("[^0-9A-Za-z]")
    return "".join(out)


@dataclass(frozen=True)
class Offset:
    """kind: any, absolute, eof, ep, section or last; add is the place or distance; shift widens it."""

    kind: str = "any"
    add: int = 0
    shift: int = 0
    index: int = 0

    def base(self, size: int, image) -> int | None:
        """The first allowed start, or None if there is none."""
        match self.kind:
            case "absolute":
                return self.add
            case "eof":
                return max(size - self.add, 0)
            case "ep":
                return None if image is None else max(image.ep_off + self.add, 0)
            case "section":
                return None if image is None or self.index >= len(image.sections) else image.sections[self.index].raw_ptr + self.add
            case "last":
                return None if image is None or not image.sections else image.sections[-1].raw_ptr + self.add

    def allows(self, start: int, size: int, image) -> bool:
        if self.kind == "any":
            return True
        base = self.base(size, image)
        return base is not None and base <= start <= base + self.shift


_NUMBER = r"\+?\d+"


def _u32(text: str) -> int:
    if not re.fullmatch(_NUMBER, text, re.A) or int(text) > 0xFFFFFFFF:
        raise PatternError(f"number {text!r}")
    return int(text)


def parse_offset(text: str) -> Offset:
    text = text.strip()
    if text == "*":
        return Offset()
    base, comma, shift = text.partition(",")
    shift = _u32(shift) if comma else 0
    if base == "EP":
        return Offset("ep", 0, shift)
    if m := re.fullmatch(r"EP([+-])([+-]?\d+)", base, re.A):
        n = int(m[2])
        if not -(2**31) <= n < 2**31:
            raise PatternError(f"offset {text!r}")
        return Offset("ep", n if m[1] == "+" else -n, shift)
    if base.startswith("EOF-"):
        return Offset("eof", _u32(base[4:]), shift)
    if base.startswith("SL+"):
        return Offset("last", _u32(base[3:]), shift)
    if m := re.fullmatch(r"SE(\d+)", base, re.A):
        return Offset("section", 0, shift, _u8(m[1]))
    if m := re.fullmatch(rf"S({_NUMBER})\+({_NUMBER})", base, re.A):
        return Offset("section", _u32(m[2]), shift, _u8(m[1]))
    return Offset("absolute", _u32(base), shift)


def _u8(text: str) -> int:
    n = _u32(text)
    if n > 0xFFFF:
        raise PatternError(f"index {text!r}")
    return n


@dataclass(frozen=True)
class Pattern:
    tokens: tuple[tuple, ...]
    anchor: bytes = field(init=False)
    anchor_off: int | None = field(init=False)

    @classmethod
    def parse(cls, text: str, wide: bool = False) -> Pattern:
        tokens = tokenize(text)
        if wide:  # a zero byte after each literal byte; other tokens stay
            tokens = [("lit", b"".join(bytes([x, 0]) for x in t[1])) if t[0] == "lit" else t for t in tokens]
        return cls(tuple(tokens))

    def __post_init__(self):
        best, best_off, off = b"", 0, 0
        for t in self.tokens:
            width = 0
            match t:
                case ("lit", b):
                    if len(b) > len(best):
                        best, best_off = b, off
                    width = len(b)
                case ("any",) | ("nibble", _, _):
                    width = 1
                case ("skip", low, high):
                    width = low if low == high else INFINITE
                case ("alt", options, _):
                    width = min(map(len, options))
            off = INFINITE if off is INFINITE or width is INFINITE else off + width
        object.__setattr__(self, "anchor", best)
        object.__setattr__(self, "anchor_off", best_off)

    @property
    def min_len(self) -> int:
        total = 0
        for t in self.tokens:
            match t:
                case ("lit", b):
                    total += len(b)
                case ("any",) | ("nibble", _, _):
                    total += 1
                case ("skip", low, _):
                    total += low
                case ("alt", options, _):
                    total += min(map(len, options))
        return total

    @cached_property
    def python(self) -> re.Pattern[bytes]:
        return re.compile(_regex(list(self.tokens), r"\Z").encode("ascii"), re.S)

    def matches_at(self, data: bytes, start: int) -> bool:
        return start <= len(data) and self.python.match(data, start) is not None

    def find(self, data: bytes, first: int = 0, end: int | None = None) -> int | None:
        """The slow search, for anchors of less than two bytes: `end` bounds the anchor's byte, or
        the start itself (inclusively) where there is no anchor."""
        end = len(data) if end is None else min(end, len(data))
        if first > end:
            return None
        if not self.anchor:
            return next((i for i in range(first, end + 1) if self.matches_at(data, i)), None)
        if self.anchor_off is INFINITE:
            return None
        at = data.find(self.anchor, first + self.anchor_off, end)
        while at >= 0:
            if self.matches_at(data, at - self.anchor_off):
                return at - self.anchor_off
            at = data.find(self.anchor, at + 1, end)
        return None

    def find_within(self, data: bytes, offset: Offset, image) -> int | None:
        if offset.kind == "any":
            return self.find(data)
        base = offset.base(len(data), image)
        return None if base is None else self.find(data, base, base + offset.shift + 1)

    def _guards(self, offset: Offset) -> tuple[list[str], str]:
        """Lookaheads that admit a start, and what admits start 0."""
        match offset.kind:
            case "any":
                return [""], ""
            case "absolute":
                return [rf"\A.{{{offset.add},{offset.add + offset.shift}}}?"], "" if offset.add == 0 else "(?!)"
            case "eof":
                n, shift = offset.add, offset.shift
                guards = [rf"(?=.{{{max(n - shift, 0)},{n}}}\z)"]
                if n:
                    guards.append(rf"\A(?!.{{{n}}}).{{0,{shift}}}?")
                return guards, rf"(?=.{{0,{n}}}\z)"
        raise PatternError(f"offset {offset.kind} has no regex")

    def java(self, offset: Offset = Offset()) -> str:
        """A regex for rlike over latin(): the rule is found as its anchor search finds it."""
        if len(self.anchor) < 2:
            raise PatternError("the anchor is too short for the fast search")
        body, anchor = _regex(list(self.tokens), r"\z"), _bytes(self.anchor)
        guards, zero = self._guards(offset)
        if self.anchor_off is INFINITE:
            return rf"(?s)\A{zero}(?=.*?{anchor}){body}"
        off = self.anchor_off
        branches = [rf"{g}(?=.{{{off}}}{anchor}){body}" for g in guards]
        if off:
            branches.append(rf"\A{zero}(?=.{{0,{off - 1}}}{anchor}){body}")
        return "(?s)(?:" + "|".join(branches) + ")"

    def java_count(self) -> tuple[str, str, str]:
        """Regexes (starts, start 0, anchors that clamp to 0) whose counts make the hit count:
        count(starts) + [start 0 matches] * count(clamped)."""
        body, anchor = _regex(list(self.tokens), r"\z"), _bytes(self.anchor)
        zero = rf"(?s)\A{body}"
        if self.anchor_off is INFINITE:
            return r"(?!)", zero, rf"(?s)(?={anchor})"
        off = self.anchor_off
        clamped = rf"(?s)(?<!.{{{off}}})(?={anchor})" if off else r"(?!)"
        return rf"(?s)(?=(?=.{{{off}}}{anchor}){body})", zero, clamped
