"""Lines of ignore files as regular expressions that Python and Java read alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Characters of named classes, and those that stand for themselves in a class.
CLASSES = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t-\r\ ", "blank": r"\t\ ", "punct": r"!-\/:-@\[-`\{-~", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "graph": "!-~", "print": r"\ -~"}


@dataclass(frozen=True)
class Rule:
    """regex: of a whole path below the rule's folder. reinstates: a match is not ignored. folders: only they match."""

    regex: str
    reinstates: bool
    folders: bool


def _plain(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def _class(p: str, i: int) -> tuple[str, int]:
    """The class that begins at p[i], and where it ends. A class holds no slash."""
    i += 1
    out = "^" if p[i : i + 1] in ("!", "^") else ""
    i += len(out)
    first = True
    while first or p[i : i + 1] != "]":
        if i >= len(p):
            raise ValueError("a class has no end")
        first = False
        if p.startswith("[:", i) and (end := p.find(":]", i)) > 0 and p[i + 2 : end] in CLASSES:
            out, i = out + CLASSES[p[i + 2 : end]], end + 2
            continue
        low, i = _member(p, i)
        if p[i : i + 1] == "-" and p[i + 1 : i + 2] not in ("", "]"):
            high, i = _member(p, i + 1)
            if low > high:
                raise ValueError(f"{low}-{high} is no range")
            out += f"{_plain(low)}-{_plain(high)}"
        else:
            out += _plain(low)
    return f"(?!/)[{out}]", i + 1


def _member(p: str, i: int) -> tuple[str, int]:
    if p[i] == "\\" and i + 1 < len(p):
        return p[i + 1], i + 2
    return p[i], i + 1


def regex(glob: str) -> str:
    """``*`` and ``?`` stay within a name; ``**`` as a whole name is any number of folders; braces hold alternatives."""
    out, i, open_ = "", 0, 0
    while i < len(glob):
        c = glob[i]
        begins = not i or glob[i - 1] in "/{,"
        if glob.startswith("**", i):
            after = glob[i + 2 : i + 3]
            if begins and after == "/":
                out, i = out + "(?:.*/)?", i + 3
            else:
                out, i = out + (".*" if begins and after in ("", "}") else "[^/]*"), i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            part, i = _class(glob, i)
            out += part
        elif c == "{":
            out, i, open_ = out + "(?:", i + 1, open_ + 1
        elif c == "}" or c == "," and open_:
            if not open_:
                raise ValueError("a brace is closed that was not opened")
            out, i, open_ = out + (")" if c == "}" else "|"), i + 1, open_ - (c == "}")
        elif c == "\\":
            if i + 1 == len(glob):
                raise ValueError("a backslash ends the pattern")
            out, i = out + _plain(glob[i + 1]), i + 2
        else:
            out, i = out + _plain(c), i + 1
    if open_:
        raise ValueError("a brace has no end")
    return rf"(?s)\A{out}\z"


def compiled(pattern: str) -> re.Pattern:
    """``regex``'s result for Python, which writes the end of a text otherwise."""
    return re.compile(pattern.removesuffix(r"\z") + r"\Z")


def retained(line: str) -> str | None:
    """What an ignore file's line has of a pattern: no comment, no space at its end that is not escaped; else null."""
    p = line if line.endswith("\\ ") else line.rstrip()
    return None if line.startswith("#") else p or None


def rule(line: str) -> Rule | None:
    """The rule of a line, if it has one; a malformed pattern is a ValueError."""
    p = retained(line)
    if p is None:
        return None
    back = p.startswith("!")
    p = p[1:] if back or p.startswith(("\\!", "\\#")) else p
    rooted = p.startswith("/")
    p = p[1:] if rooted else p
    folders = p.endswith("/")
    p = p[:-1] if folders else p
    if not p:
        return None
    if not rooted and "/" not in p and p != "**":
        p = "**/" + p
    if p.endswith("/**"):
        p += "/*"
    return Rule(regex(p), back, folders)
