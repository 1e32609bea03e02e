"""Source code as tokens, in one pass, and the end of every bracket.

Every pattern reads on or takes all that is left: an unfinished comment or string is one token up to its line's or the
text's end, so the time grows with the length of a text, whatever stands in it. A regular expression of JavaScript is
looked for in the next ``REGEX`` characters.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

REGEX = 256
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:.*?\*/|.*)"
_ONE_LINE = r'"(?:[^"\\\n]|\\.)*+"?'
_CHAR = r"'(?:[^'\\\n]|\\.)*+'?"
_PUNCTUATION = r"=>|->|::|[=!<>]=|&&|\|\||\+\+|--|\.\.\.|[^\w\s]"
_WORD = r"[^\W\d]\w*"


def _lexer(comments: str, strings: str, word: str = _WORD) -> re.Pattern:
    return re.compile(rf"(?P<comment>{comments})|(?P<string>{strings})|(?P<word>{word})|(?P<number>\d[\w.]*)|{_PUNCTUATION}", re.S)


_C = _lexer(rf"{_LINE}|{_BLOCK}|\#(?:[^\n\\]|\\.)*+", rf"{_ONE_LINE}|{_CHAR}")
_JS = _lexer(f"{_LINE}|{_BLOCK}", rf"{_ONE_LINE}|{_CHAR}|`(?:[^`\\]|\\.)*+`?", r"[^\W\d$]\w*(?:\$\w*)*|\$[\w$]*")
LEXERS = {
    "rust": _lexer(f"{_LINE}|{_BLOCK}", r"""b?r(?P<hashes>\#*)"(?:.*?"(?P=hashes)|.*)|b?"(?:[^"\\]|\\.)*+"?|b?'(?:\\[^\n][^'\n]{0,10}|[^'\\\n])'|'\w+"""),
    "go": _lexer(f"{_LINE}|{_BLOCK}", rf"{_ONE_LINE}|{_CHAR}|`[^`]*`?"),
    "java": _lexer(f"{_LINE}|{_BLOCK}", rf'"""(?:.*?"""|.*)|{_ONE_LINE}|{_CHAR}'),
    "c": _C, "cpp": _C, "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "bash": _lexer(r"(?<![^\s;|&()])\#[^\n]*|\\.", r"""'[^']*'?|"(?:[^"\\]|\\.)*+"?""", r"[^\s;|&(){}<>\"'`$#=\\\[\],!]+"),
    "hcl": _lexer(rf"\#[^\n]*|{_LINE}|{_BLOCK}", _ONE_LINE, r"[^\W\d][\w-]*"),
}
#: Lines of plain calls, ``name(word, word);``, after a bracket of a block or a semicolon. No declaration is, has or needs one of
#: their tokens but the last semicolon, so where only declarations are looked for it stands for all of them.
_CALL = r"\s*+[A-Za-z_]\w*+\(\s*+(?:\w[\w.]*+(?:\s*+,\s*+\w[\w.]*+)*+\s*+)?+\);"
CALL = re.compile(_CALL)
_PLAIN = rf"(?<=[;{{}}])(?P<plain>[ \t\r]*+\n(?:{_CALL})++)"
BRIEF = {k: re.compile(f"{x.pattern}|{_PLAIN}", re.S) for k, x in LEXERS.items() if k not in ("bash", "hcl")}
_GROUPED = re.compile(r"\btype\s*\(")  # Go's groups of types take any line for one
_NESTED = re.compile(r"/\*|\*/")
_HEREDOC = re.compile(r"<<[-~]?[ \t]*(['\"]?)(\w+)\1")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/\w*")
#: After these a slash, a function or a class belongs to an expression.
EXPRESSION = {*"=(,:?[!&|+-*%<>~^", "&&", "||", "=>", "==", "!=", "<=", ">=", "...", "return", "typeof", "void", "delete", "new", "in", "of", "await", "yield", "case", "throw", "instanceof", "do"}
PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """text: of each token; at, ends: its offsets; kinds: word, string, number or None. Comments are kept apart.

    match: of a bracket its partner, or -1; around: the bracket that each token stands in, or -1.
    brief: lines of plain calls are one semicolon, as for declarations only; plain: by its token, the offsets of the lines.
    """

    def __init__(self, source: str, language: str, brief: bool = False):
        self.source, self.language = source, language
        self.lexer = LEXERS[language]
        if brief and language in BRIEF and not (language == "go" and _GROUPED.search(source)):
            self.lexer = BRIEF[language]
        self.text: list[str] = []
        self.at: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str | None] = []
        self.comments: list[tuple[int, int]] = []
        self.plain: dict[int, tuple[int, int]] = {}
        self._read()
        self._pair()

    def _read(self) -> None:
        lexer, source, at = self.lexer, self.source, 0
        while at is not None:
            at = self._read_from(lexer, source, at)

    def _read_from(self, lexer: re.Pattern, source: str, at: int, stop: int = sys.maxsize) -> int | None:
        """Tokens from ``at`` on; the offset to go on from where a token has an end of its own."""
        text, starts, ends, kinds = self.text.append, self.at.append, self.ends.append, self.kinds.append
        rust, script, shell = self.language == "rust", self.language in ("javascript", "typescript", "tsx"), self.language in ("bash", "hcl")
        for m in lexer.finditer(source, at, stop):
            kind, t = m.lastgroup, m[0]
            a, z = m.span()
            if kind == "plain":
                if self.ends and self.ends[-1] == a and self.text[-1] in ("{", "}", ";"):
                    self.plain[len(self.text)] = (a, z)
                    self._add(z - 1, z, None)
                else:  # a comment or an open string ends so
                    self._read_from(LEXERS[self.language], source, a, z)
                continue
            if kind == "comment":
                if rust and t.startswith("/*") and t.find("/*", 2) >= 0:
                    level = 0
                    for x in _NESTED.finditer(source, a):
                        level += 1 if x[0] == "/*" else -1
                        if not level:
                            break
                    z = x.end() if not level else len(source)
                    self.comments.append((a, z))
                    return z
                self.comments.append((a, z))
                continue
            if kind is None:
                if script and t == "/" and (not self.text or self.text[-1] in EXPRESSION or self.text[-1] in "{};") and (x := _REGEX.match(source, a, a + REGEX)):
                    self._add(a, x.end(), "string")
                    return x.end()
                if shell and t == "<" and source.startswith("<<", a) and (x := _HEREDOC.match(source, a)):
                    return self._heredoc(x)
            text(t)
            starts(a)
            ends(z)
            kinds(kind)
        return None

    def _add(self, a: int, z: int, kind: str | None) -> None:
        self.text.append(self.source[a:z])
        self.at.append(a)
        self.ends.append(z)
        self.kinds.append(kind)

    def _heredoc(self, begin: re.Match) -> int:
        """The rest of the line is lost, with the lines up to the mark; without one, all that is left."""
        line = self.source.find("\n", begin.end())
        end = re.compile(rf"^[ \t]*{re.escape(begin[2])}[ \t\r]*$", re.M).search(self.source, line) if line >= 0 else None
        z = end.end() if end else len(self.source)
        self._add(begin.start(), z, "string")
        return z

    def _pair(self) -> None:
        n = len(self.text)
        self.match, self.around = [-1] * n, [-1] * n
        stack: list[int] = []
        open_ = {"(": 0, "[": 0, "{": 0}
        for i, t in enumerate(self.text):
            self.around[i] = stack[-1] if stack else -1
            if t in open_:
                stack.append(i)
                open_[t] += 1
            elif t in PAIRS and open_[PAIRS[t]]:
                while True:  # brackets that are still open within have no end
                    j = stack.pop()
                    open_[self.text[j]] -= 1
                    if self.text[j] == PAIRS[t]:
                        break
                self.match[i], self.match[j] = j, i
                self.around[i] = stack[-1] if stack else -1

    @cached_property
    def _newlines(self) -> list[int]:
        return [k + n for k, n in enumerate(accumulate(map(len, self.source.split("\n")[:-1])))]

    def line(self, offset: int) -> int:
        return bisect_right(self._newlines, offset - 1) + 1

    @cached_property
    def lines(self) -> list[int]:
        """The line of each token's beginning."""
        out, k, marks = [], 0, self._newlines
        for a in self.at:
            while k < len(marks) and marks[k] < a:
                k += 1
            out.append(k + 1)
        return out

    @cached_property
    def stop(self) -> list[int]:
        """Of each token the next one at its level, itself included, that is ``{``, ``;`` or closes a bracket; the last entry: none."""
        n = len(self.text)
        out = [n] * (n + 2)
        for i in range(n - 1, -1, -1):
            t = self.text[i]
            if t == "{" or t == ";" or t in PAIRS:
                out[i] = i
            elif t in ("(", "[") and self.match[i] >= 0:
                out[i] = out[self.match[i] + 1]
            else:
                out[i] = out[i + 1]
        return out

    @cached_property
    def last(self) -> list[int]:
        """Of each token the last one of its statement, where a line's end ends a statement outside brackets."""
        n, lines = len(self.text), self.lines
        out = [0] * n
        for i in range(n - 1, -1, -1):
            j = self.match[i] if self.match[i] > i else i
            last = j + 1 >= n or lines[j + 1] > self.line(self.ends[j] - 1) or self.text[j + 1] == ";" or self.text[j + 1] in PAIRS
            out[i] = j if last else out[j + 1]
        return out

    @cached_property
    def statement(self) -> tuple[list[int], list[bool]]:
        """Of each token the first one of its statement, and whether an equals sign stands between."""
        first, assigned = [], []
        begin, equals, outer = 0, False, []
        for i, t in enumerate(self.text):
            if t in PAIRS and self.match[i] >= 0:
                while outer:
                    j, begin, equals = outer.pop()
                    if j == self.match[i]:
                        break
            first.append(begin)
            assigned.append(equals)
            if t in ("(", "[", "{") and self.match[i] >= 0:
                outer.append((i, begin, equals))
                begin, equals = i + 1, False
            elif t == ";" or t == "}":
                begin, equals = i + 1, False
            elif t == "=":
                equals = True
        return first, assigned
