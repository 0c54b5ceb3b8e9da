"""String functions on Columns, with the meaning Python's own string methods have."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f\x85   -     　]"

#: Patterns a whole, non-empty string must match.
PREDICATES = {
    "isalnum": r"\A[\p{L}\p{N}]+\z",
    "isalpha": r"\A\p{L}+\z",
    "isdecimal": r"\A\p{Nd}+\z",
    "isdigit": r"\A[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z",
    "isnumeric": r"\A\p{N}+\z",
    "isspace": rf"\A{WHITE}+\z",
    "islower": r"(?s)\A(?=.*\p{Ll})[^\p{Lu}\p{Lt}]*\z",
    "isupper": r"(?s)\A(?=.*\p{Lu})[^\p{Ll}\p{Lt}]*\z",
    "istitle": r"\A(?=[\s\S]*[\p{Lu}\p{Lt}])[^\p{Lu}\p{Ll}\p{Lt}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Ll}\p{Lt}]+|\z))+\z",
}


def predicate(name: str, c: Column) -> Column:
    """One of Python's ``str.is*`` questions; false for the empty string."""
    return c.rlike(PREDICATES[name])


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def strip(c: Column, side: str = "both") -> Column:
    """Without the white space of every kind at the given side."""
    ends = {"left": rf"\A{WHITE}+", "right": rf"{WHITE}+\z", "both": rf"\A{WHITE}+|{WHITE}+\z"}[side]
    return F.regexp_replace(c, ends, "")


def find(c: Column, sub: str) -> Column:
    """Place of the first occurrence from 0, or -1."""
    return F.instr(c, sub) - 1


def replace(c: Column, old: str, new: str, most: int | None = None) -> Column:
    """Literal replacement, of the first ``most`` occurrences if given."""
    if most is None or most < 0:
        return F.replace(c, F.lit(old), F.lit(new))
    if most == 0:
        return c
    return F.array_join(F.split(c, rf"\Q{old}\E", most + 1), new)


def pad(c: Column, width: int, side: str | None = None, fill: str | None = None) -> Column:
    """Padded to ``width`` at ``side`` (left unless told), never cut."""
    side, fill = side or "left", fill or " "
    if side not in ("left", "right", "both"):
        raise ValueError("side must be left, right or both")
    if len(fill) != 1:
        raise TypeError("the fill must be one character")
    if side == "both":
        short = F.greatest(F.lit(width) - F.length(c), F.lit(0))
        left = F.floor(short / 2).cast("int")
        return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), (short - left).cast("int")))
    put = F.lpad if side == "left" else F.rpad
    return F.when(F.length(c) >= width, c).otherwise(put(c, width, fill))


def cat(a: Column, b: Column, sep: str | None = None) -> Column:
    """Concatenation; null if either is."""
    return F.concat(a, F.lit(sep), b) if sep else F.concat(a, b)


def _bounds(n: Column, start: int | None, stop: int | None) -> tuple[Column, Column]:
    def at(i: int | None, none: Column) -> Column:
        if i is None:
            return none
        return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + F.lit(i), F.lit(0))

    return at(start, F.lit(0)), at(stop, n)


def slice_(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """Python's ``s[start:stop:step]``."""
    n = F.length(c)
    if step is None or step == 1:
        lo, hi = _bounds(n, start, stop)
        return F.substring(c, lo + F.lit(1), F.greatest(hi - lo, F.lit(0)))
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if step > 0:
        lo, hi = _bounds(n, start, stop)
        last, some = hi - 1, hi > lo
    else:
        down = lambda i, none: none if i is None else F.least(F.lit(i), n - 1) if i >= 0 else F.greatest(n + F.lit(i), F.lit(-1))
        lo, hi = down(start, n - 1), down(stop, F.lit(-1))
        last, some = hi + 1, lo > hi
    chars = F.transform(F.sequence(lo, last, F.lit(step)), lambda i: F.substring(c, i + F.lit(1), F.lit(1)))
    return F.when(c.isNull(), F.lit(None)).when(some, F.array_join(chars, "")).otherwise(F.lit(""))


def char_at(c: Column, i: int) -> Column:
    """Python's ``s[i]``, null beyond the ends."""
    n = F.length(c)
    at = F.lit(i) if i >= 0 else n + F.lit(i)
    return F.when((at >= 0) & (at < n), F.substring(c, at + F.lit(1), F.lit(1)))


def slice_replace(c: Column, start: int | None = None, stop: int | None = None, repl: str | None = None) -> Column:
    lo, hi = _bounds(F.length(c), start, stop)
    hi = F.greatest(lo, hi)
    return F.concat(F.substring(c, F.lit(1), lo), F.lit(repl or ""), F.substring(c, hi + F.lit(1), F.length(c)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern: ``*``, ``?``, ``[seq]`` and ``[!seq]``, matching the whole string."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                out.append(r"\[")
                continue
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", glob[i + (glob[i] == "!") : end])
            out.append(f"[{'^' if glob[i] == '!' else ''}{inner}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", ch) if ord(ch) < 128 else ch)
    return rf"\A(?s:{''.join(out)})\z"


def like(c: Column, glob: str) -> Column:
    """Whether the whole string matches a shell pattern; plain ``*`` and ``?`` go to LIKE, which storage understands."""
    if "[" in glob:
        return c.rlike(glob_pattern(glob))
    escaped = re.sub(r"([\\%_])", r"\\\1", glob)
    return c.like(escaped.replace("*", "%").replace("?", "_"))


def interp(fmt: Column | str, *values: Column) -> Column:
    """printf-style interpolation."""
    return F.printf(F.lit(fmt) if isinstance(fmt, str) else fmt, *values)
