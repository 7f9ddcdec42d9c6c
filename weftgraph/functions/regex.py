"""Python regular expressions as Java ones, for Spark's regexp functions."""

from __future__ import annotations

import re


class Untranslatable(ValueError):
    """A pattern that Java can't express."""


def context_free(pattern: str) -> bool:
    """Whether a hit of the pattern, matched by itself, has the same groups: it looks at nothing beyond the hit."""
    return not re.search(r"\\[AbBZzGK]|\(\?[=!<>(]|[\^$]|[*+?}]\+", pattern.replace("[^", "["))


def one_group(pattern: re.Pattern) -> bool:
    """Whether the pattern is one group and nothing else, so that the group is the hit."""
    return pattern.groups == 1 and bool(re.fullmatch(r"\((?!\?)(?:[^()\[\]\\]|\\.|\[\^?(?:\\.|[^\]\\\[])+\])*\)", pattern.pattern, re.S))


def java_flags(flags: int) -> str:
    """Inline flags: Unix line ends always, Unicode classes unless ASCII."""
    letters = "d" + ("" if flags & re.A else "U")
    for flag, letter in ((re.S, "s"), (re.I, "i"), (re.M, "m"), (re.X, "x")):
        if flags & flag:
            letters += letter
    return f"(?{letters})"


def java_name(name: str) -> str:
    """Java's group names hold no underscore."""
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}" for c in name)


#: What Python takes for blanks besides Unicode's own.
_BLANK = "\\x1c-\\x1f"


def _class(pattern: str, at: int, ascii_: bool = False) -> tuple[str, int]:
    """A character class that starts at at, in Java, and where it ends."""
    out, k = "[", at + 1
    if pattern[k : k + 1] == "^":
        out, k = "[^", k + 1
    first = True
    while first or pattern[k] != "]":
        c = pattern[k]
        if c == "\\":
            two = pattern[k : k + 2]
            if two[1] == "0" or two[1].isdigit():
                m = re.compile(r"\\[0-7]{1,3}").match(pattern, k)
                if not m:
                    raise Untranslatable(pattern)
                out += f"\\x{int(m[0][1:], 8):02x}"
                k = m.end()
                first = False
                continue
            if two == "\\s" and not ascii_:
                out += two + _BLANK
            elif two == "\\S" and not ascii_ and not out.startswith("[^"):
                out += f"[^\\s{_BLANK}]"
            else:
                out += "\\x08" if two[1] == "b" else two
            k += 2
        else:
            out += "\\" + c if c in "[&]^" or c == "-" and pattern[k + 1] == "-" else c
            k += 1
        first = False
    return out + "]", k + 1


def translate(pattern: str, flags: int = re.S, shift: int = 0, inline: bool = True) -> str:
    """The pattern in Java's syntax; shift is added to the numbers of back references."""
    compiled = re.compile(pattern, flags)
    out, k, n = [], 0, len(pattern)
    opened = 0
    while k < n:
        c = pattern[k]
        if c == "\\":
            d = pattern[k + 1]
            if d == "Z":
                out.append("\\z")
            elif d.isdigit() and d != "0":
                m = re.compile(r"\\(\d{1,2})").match(pattern, k)
                if int(m[1]) > compiled.groups:
                    raise Untranslatable(f"octal escape in {pattern!r}")
                out.append(f"(?:\\{int(m[1]) + shift})")
                k = m.end()
                continue
            elif d == "0":
                m = re.compile(r"\\0[0-7]{0,2}").match(pattern, k)
                out.append(f"\\x{int(m[0][1:], 8):02x}")
                k = m.end()
                continue
            elif d in "sS" and not compiled.flags & re.A:
                out.append(f"[{'^' if d == 'S' else ''}\\s{_BLANK}]")
            elif d == "N":
                raise Untranslatable(f"named character in {pattern!r}")
            else:
                out.append(pattern[k : k + 2])
            k += 2
        elif c == "[":
            text, k = _class(pattern, k, bool(compiled.flags & re.A))
            out.append(text)
        elif pattern.startswith("(?P<", k):
            end = pattern.index(">", k)
            out.append(f"(?<{java_name(pattern[k + 4 : end])}>" if not shift else "(")
            k = end + 1
        elif pattern.startswith("(?P=", k):
            end = pattern.index(")", k)
            out.append(f"(?:\\{compiled.groupindex[pattern[k + 4 : end]] + shift})")
            k = end + 1
        elif pattern.startswith("(?(", k):
            raise Untranslatable(f"conditional group in {pattern!r}")
        elif pattern.startswith("(?#", k):
            k = pattern.index(")", k) + 1
        elif m := re.compile(r"\(\?([aiLmsux]+)\)").match(pattern, k):
            if set(m[1]) & set("aLu"):
                raise Untranslatable(f"flag in {pattern!r}")
            out.append(m[0])
            k = m.end()
        elif c == "{" and not re.compile(r"\{(\d+(,\d*)?|,\d+)\}").match(pattern, k):
            out.append("\\{")
            k += 1
        elif m := re.compile(r"\{,(\d+)\}").match(pattern, k):
            out.append(f"{{0,{m[1]}}}")
            k = m.end()
        elif c == "}" and "{" not in "".join(out[-1:]):
            opening = pattern.rfind("{", 0, k)
            out.append("}" if opening >= 0 and re.compile(r"\{\d+(,\d*)?\}").match(pattern, opening) and re.compile(r"\{\d+(,\d*)?\}").match(pattern, opening).end() == k + 1 else "\\}")
            k += 1
        else:
            opened += c == "("
            out.append(c)
            k += 1
    return (java_flags(flags | compiled.flags & (re.I | re.M | re.X)) if inline else "") + "".join(out)


def local(pattern: str, flags: int, shift: int) -> str:
    """The pattern as a part of a larger one, with its flags for itself alone."""
    on = "".join(letter for flag, letter in ((re.S, "s"), (re.I, "i"), (re.M, "m"), (re.X, "x")) if flags & flag)
    off = "".join(letter for flag, letter in ((re.S, "s"), (re.I, "i"), (re.M, "m"), (re.X, "x")) if not flags & flag)
    if flags & re.A:
        off += "U"
    return f"(?{on}{'-' + off if off else ''}:{translate(pattern, flags, shift, inline=False)})"


def replacement(template: str, pattern: str) -> str:
    r"""A Python replacement (\1, \g<n>, escapes) in Java's syntax."""
    compiled = re.compile(pattern, re.S)
    out, k = [], 0
    simple = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "\\": "\\\\"}
    while k < len(template):
        c = template[k]
        if c == "$":
            out.append("\\$")
            k += 1
        elif c == "\\" and k + 1 < len(template):
            if m := re.compile(r"\\g<(\w+)>|\\([1-9]\d?)").match(template, k):
                name = m[1] or m[2]
                number = int(name) if name.isdigit() else compiled.groupindex.get(name, -1)
                if not 0 <= number <= compiled.groups:
                    raise ValueError(f"there is no group {name} in {pattern!r}")
                # Java takes as many digits as it can, so a digit that follows is escaped
                out.append(f"${number}")
                k = m.end()
                if template[k : k + 1].isdigit():
                    out.append(f"\\{template[k]}")
                    k += 1
            elif template[k + 1] in simple:
                out.append(simple[template[k + 1]])
                k += 2
            else:
                raise ValueError(f"bad escape in {template!r}")
        else:
            out.append(c)
            k += 1
    return "".join(out)
