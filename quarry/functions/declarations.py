"""Declarations in tokens of languages with braces: each by a look at the tokens around its name, so that a file's time
grows with its length. A declaration is (first token, last token, kind, name, the name's token)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .tokens import EXPRESSION, Tokens

#: Tokens of type parameters before a name that are looked at.
HEAD = 2048

Found = tuple[int, int, str, str, int]
#: Words that no method or function of C, Java and JavaScript is called, as a statement begins with them.
CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw", "synchronized", "try", "sizeof", "function", "with", "super", "await", "yield", "case", "goto"}
RUST_MODIFIERS = {"pub", "async", "unsafe", "const", "extern", "default"}
JS_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "override", "readonly", "abstract", "accessor", "declare"}
JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "sealed", "transient", "volatile"}


def _word(t: Tokens, i: int) -> bool:
    return 0 <= i < len(t.text) and t.kinds[i] == "word"


def _is(t: Tokens, i: int, what: str) -> bool:
    return 0 <= i < len(t.text) and t.text[i] == what


def _body(t: Tokens, i: int, bodiless: bool = False) -> int | None:
    """The last token of what goes on from token i: its block's end, or, if it may have none, its semicolon."""
    j = t.stop[min(i, len(t.text))]
    if _is(t, j, "{") and t.match[j] >= 0:
        return t.match[j]
    return j if bodiless and _is(t, j, ";") else None


def _back(t: Tokens, i: int, modifiers: set[str]) -> int:
    """The first of the modifiers before token i; ``pub(crate)`` and ``extern "C"`` are ones."""
    while i:
        if t.text[i - 1] in modifiers:
            i -= 1
        elif t.text[i - 1] == ")" and t.match[i - 1] > 0 and t.text[t.match[i - 1] - 1] == "pub" and "pub" in modifiers:
            i = t.match[i - 1] - 1
        elif t.kinds[i - 1] == "string" and i > 1 and t.text[i - 2] == "extern" and "extern" in modifiers:
            i -= 2
        else:
            break
    return i


def rust(t: Tokens) -> Iterator[Found]:
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"}
    skip = -1
    for i, x in enumerate(t.text):
        if i <= skip:
            continue
        if x in "([{" and t.match[i] > i and (_is(t, i - 1, "!") or _word(t, i - 1) and _is(t, i - 2, "!")):
            skip = t.match[i]  # what a macro is given is no item
        elif x in kinds and _word(t, i + 1):
            if (end := _body(t, i + 2, x == "struct")) is not None:
                yield _back(t, i, RUST_MODIFIERS), end, kinds[x], t.text[i + 1], i + 1
        elif x == "impl" and (end := _body(t, i + 1)) is not None:
            j = t.match[end]
            # The type before the block: a plain name right after impl, its parameters, or for.
            if _word(t, j - 1) and (j - 2 == i or _is(t, j - 2, "for") or _is(t, j - 2, ">") and _is(t, i + 1, "<") and _plain(t, i + 1, j - 2)):
                yield _back(t, i, RUST_MODIFIERS), end, "impl", t.text[j - 1], j - 1


def _plain(t: Tokens, a: int, z: int) -> bool:
    """Do the angles from a close with z, and not before?"""
    level = 0
    for k in range(a, min(z + 1, a + HEAD)):
        level += (t.text[k] == "<") - (t.text[k] == ">")
        if not level:
            return k == z
    return False


def go(t: Tokens) -> Iterator[Found]:
    for i, x in enumerate(t.text):
        if x not in ("func", "type") or t.around[i] >= 0 or i and t.lines[i - 1] == t.lines[i] and t.text[i - 1] != ";":
            continue
        if x == "func":
            if _word(t, i + 1) and (_is(t, i + 2, "(") or _is(t, i + 2, "[")):
                yield i, t.last[i], "function", t.text[i + 1], i + 1
            elif _is(t, i + 1, "(") and t.match[i + 1] > 0 and _word(t, j := t.match[i + 1] + 1) and _is(t, j + 1, "("):
                yield i, t.last[i], "method", t.text[j], j
        elif _is(t, i + 1, "(") and t.match[i + 1] > 0:
            k, end = i + 2, t.match[i + 1]
            while k < end:  # a group: each of its types is declared by the whole
                if _word(t, k) and not _is(t, k + 1, "="):
                    yield i, end, "struct", t.text[k], k
                k = t.last[k] + 1
                k += _is(t, k, ";")
        elif _word(t, i + 1) and not _is(t, i + 2, "="):
            yield i, t.last[i], "struct", t.text[i + 1], i + 1


def _script(t: Tokens, typed: bool) -> Iterator[Found]:
    classes: set[int] = set()
    for i, x in enumerate(t.text):
        before = t.text[i - 1] if i else ";"
        if x == "class" and before != "." and not _is(t, i + 1, ":"):
            end = _body(t, i + 1)
            if end is not None:
                classes.add(t.match[end])
                first = _back(t, i, {"declare"})
                if _word(t, i + 1) and t.text[i + 1] != "extends" and before not in EXPRESSION and before != "abstract":
                    yield first if typed else i, end, "class", t.text[i + 1], i + 1
        elif x == "function" and _word(t, i + 1):
            own = i - 1 if before == "async" else i
            if (t.text[own - 1] if own else ";") not in EXPRESSION and (end := _body(t, i + 2)) is not None:
                yield own, end, "function", t.text[i + 1], i + 1
        elif typed and x == "interface" and _word(t, i + 1) and before not in EXPRESSION and before != ".":
            if (end := _body(t, i + 2)) is not None:
                yield i, end, "interface", t.text[i + 1], i + 1
        elif t.kinds[i] == "word" and x not in CONTROL and before != "#" and before != ".":
            j = i + 1
            if typed and _is(t, j, "<"):  # type parameters of a method
                j = next((k for k in range(j, min(j + 32, len(t.text))) if t.text[k] == "("), j)
            around = t.around[i]
            if _is(t, j, "(") and t.match[j] > j and around >= 0 and t.text[around] == "{" and _members(t, around, classes) and (k := _block(t, t.match[j] + 1, typed)) is not None:
                first = _back(t, i, JS_MODIFIERS | {"*"})
                if first - 1 == around or t.text[first - 1] not in EXPRESSION - {","}:
                    yield first, t.match[k], "method", x, i


def _members(t: Tokens, around: int, classes: set[int]) -> bool:
    """Is this brace a class body or an object?"""
    return around in classes or around > 0 and t.text[around - 1] in EXPRESSION and t.text[around - 1] != "=>"


def _block(t: Tokens, i: int, typed: bool) -> int | None:
    """The block that a method's parameters lead to, with a result type between or not."""
    if _is(t, i, "{"):
        return i if t.match[i] > 0 else None
    if not typed or not _is(t, i, ":"):
        return None
    j = t.stop[i]
    if _is(t, j, "{") and t.match[j] > 0 and _is(t, t.match[j] + 1, "{"):
        j = t.match[j] + 1  # the type is an object's
    return j if _is(t, j, "{") and t.match[j] > 0 else None


def java(t: Tokens) -> Iterator[Found]:
    bodies: set[int] = set()
    first, assigned = t.statement
    for i, x in enumerate(t.text):
        before = t.text[i - 1] if i else ";"
        if x in ("class", "interface", "enum", "record") and _word(t, i + 1) and before not in (".", "@"):
            if (end := _body(t, i + 2)) is not None:
                bodies.add(t.match[end])
                if x in ("class", "interface"):
                    yield first[i], end, x, t.text[i + 1], i + 1
        elif x == "new":
            j = t.stop[min(i + 1, len(t.text))]  # a class without a name
            if _is(t, j, "{") and _is(t, j - 1, ")"):
                bodies.add(j)
        elif t.kinds[i] == "word" and x not in CONTROL and _is(t, i + 1, "(") and t.match[i + 1] > 0 and t.around[i] in bodies and not assigned[i]:
            typed = before in (">", "]") or t.kinds[i - 1] == "word" and before not in CONTROL | JAVA_MODIFIERS and not (i > 1 and t.text[i - 2] == "@")
            if typed and (end := _body(t, t.match[i + 1] + 1, True)) is not None:
                yield first[i], end, "method", x, i


def c(t: Tokens) -> Iterator[Found]:
    first, assigned = t.statement
    outer: dict[int, bool] = {-1: True}  # can functions be declared in this bracket: in none, or a namespace
    for i, x in enumerate(t.text):
        if x == "{":
            f = first[i]
            outer[i] = outer.get(t.around[i], False) and (_is(t, f, "namespace") or _is(t, f, "inline") and _is(t, f + 1, "namespace") or _is(t, f, "extern") and i == f + 2)
        elif x == "struct" and _word(t, i + 1):
            j = t.stop[i + 2]
            head = _is(t, j, "{") and t.match[j] > 0 and (j == i + 2 or t.language == "cpp" and (_is(t, i + 2, ":") or _is(t, i + 2, "final")))
            yield i, t.match[j] if head else i + 1, "struct", t.text[i + 1], i + 1
        elif t.kinds[i] == "word" and x not in CONTROL and _is(t, i + 1, "(") and t.match[i + 1] > 0 and outer.get(t.around[i]) and (not assigned[i] or _is(t, first[i], "template")) and i > first[i]:
            before = t.text[i - 1]
            if (t.kinds[i - 1] == "word" and before not in CONTROL or before in (">", "]", "}")) and (end := _body(t, t.match[i + 1] + 1)) is not None:
                yield _untemplated(t, first[i], i), end, "function", x, i


def _untemplated(t: Tokens, a: int, z: int) -> int:
    """The first token after ``template <...>``."""
    if not _is(t, a, "template"):
        return a
    level, k = 0, a + 1
    while k < min(z, a + HEAD):
        level += (t.text[k] == "<") - (t.text[k] == ">")
        k = 1 + (t.match[k] if t.text[k] in ("(", "[", "{") and t.match[k] > 0 else k)
        if not level:
            return k
    return a


def bash(t: Tokens) -> Iterator[Found]:
    for i, x in enumerate(t.text):
        if t.kinds[i] != "word":
            continue
        plain = _is(t, i + 1, "(") and t.match[i + 1] == i + 2
        marked = i > 0 and t.text[i - 1] == "function"
        j = i + 3 if plain else i + 1
        if (plain or marked) and x != "function" and j < len(t.text) and t.text[j] in "{(" and t.match[j] > 0:
            yield i - marked, t.match[j], "function", x, i


def hcl(t: Tokens) -> Iterator[Found]:
    for i, x in enumerate(t.text):
        if x != "{" or t.match[i] < 0:
            continue
        j = i
        while j and t.lines[j - 1] == t.lines[i] and t.kinds[j - 1] in ("word", "string") and t.match[j - 1] < 0:
            j -= 1
        if j < i and t.kinds[j] == "word" and (not j or t.lines[j - 1] < t.lines[j] or t.text[j - 1] == "{"):
            for k in range(j, i):
                if t.kinds[k] == "word":
                    yield j, t.match[i], "struct", t.text[k], k


FINDERS: dict[str, Callable[[Tokens], Iterator[Found]]] = {
    "rust": rust, "go": go, "java": java, "c": c, "cpp": c, "bash": bash, "hcl": hcl,
    "javascript": lambda t: _script(t, False), "typescript": lambda t: _script(t, True), "tsx": lambda t: _script(t, True),
}


def declarations(t: Tokens) -> list[Found]:
    """In the order of their beginnings, wider ones first."""
    return sorted(set(FINDERS[t.language](t)), key=lambda f: (f[0], -f[1], f[4]))
