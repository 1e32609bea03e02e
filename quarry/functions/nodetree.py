"""Source files as trees of nodes: Python by its own parser, languages with braces by tokens, brackets and declarations.

Kinds and fields have the names that grammars give them, for this part of each language:

* the root; declarations with ``name`` (of Rust's impl: ``type``), ``parameters`` and ``body``; in Go a type_declaration
  holds type_spec nodes, in C a function_definition holds its ``declarator``;
* calls with ``function`` (Java: ``name``) and ``arguments``; blocks; other brackets as ``group``;
* identifiers, strings, numbers and comments.

A node: (id, last, parent, kind, field, start, end, line_start, line_end, text). Ids count from 0 in document order, a
node's descendants are id + 1 to last, offsets are characters, text is that of a leaf.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from .declarations import declarations
from .tokens import Tokens

# Names of kinds in each language's grammar.
ROOTS = {"rust": "source_file", "go": "source_file", "c": "translation_unit", "cpp": "translation_unit", "hcl": "config_file", "python": "module"}
DECLARED = {
    "rust": {"function": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "impl": "impl_item"},
    "go": {"function": "function_declaration", "method": "method_declaration", "struct": "type_declaration"},
    "java": {"class": "class_declaration", "interface": "interface_declaration", "method": "method_declaration"},
    "c": {"function": "function_definition", "struct": "struct_specifier"},
    "bash": {"function": "function_definition"},
    "hcl": {"struct": "block"},
    "javascript": {"function": "function_declaration", "class": "class_declaration", "method": "method_definition"},
    "typescript": {"function": "function_declaration", "class": "class_declaration", "method": "method_definition", "interface": "interface_declaration"},
}
BODIES = {"class": "class_body", "interface": "interface_body", "trait": "declaration_list", "impl": "declaration_list", "enum": "enum_variant_list", "struct": "field_declaration_list"}
BLOCKS = {"javascript": "statement_block", "typescript": "statement_block", "c": "compound_statement", "bash": "compound_statement"}
PARAMETERS = {"rust": "parameters", "go": "parameter_list", "c": "parameter_list"}
ARGUMENTS = {"go": "argument_list", "java": "argument_list", "c": "argument_list"}
STRINGS = {"rust": "string_literal", "go": "interpreted_string_literal", "java": "string_literal", "c": "string_literal", "hcl": "string_lit"}
NUMBERS = {"rust": "integer_literal", "go": "int_literal", "java": "decimal_integer_literal", "c": "number_literal", "hcl": "numeric_lit"}
COMMENTS = {"rust": ("line_comment", "block_comment"), "java": ("line_comment", "block_comment")}
#: Names of types and members.
NAMES = {
    "rust": {"struct": "type_identifier", "enum": "type_identifier", "trait": "type_identifier", "impl": "type_identifier"},
    "go": {"method": "field_identifier", "struct": "type_identifier"},
    "c": {"struct": "type_identifier"},
    "bash": {"function": "word"},
    "javascript": {"method": "property_identifier"},
    "typescript": {"method": "property_identifier", "class": "type_identifier", "interface": "type_identifier"},
}
# Words that are no identifiers, in each language.
_COMMON = "break case const continue default do else enum extern for goto if return static struct switch while sizeof volatile union typedef inline int char float double void long short unsigned signed bool class namespace template typename public private protected virtual using new delete this try catch throw true false nullptr operator"
KEYWORDS = {
    "c": set(_COMMON.split()),
    "rust": set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str".split()),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "java": set("abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()),
    "javascript": set("async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield true false null".split()),
    "bash": set("if then else elif fi for while until do done case esac in function select time".split()),
    "hcl": {"true", "false", "null"},
}
KEYWORDS |= {x: KEYWORDS["javascript"] | {"interface", "type", "declare", "abstract", "public", "private", "protected", "readonly", "implements"} for x in ("typescript", "tsx")}
# Nodes of Python: kind and fields, by the parser's names.
PYTHON = {
    "Module": ("module", {}), "FunctionDef": ("function_definition", {"returns": "return_type"}), "AsyncFunctionDef": ("function_definition", {"returns": "return_type"}), "ClassDef": ("class_definition", {}),
    "Return": ("return_statement", {}), "Delete": ("delete_statement", {}), "Assign": ("assignment", {"targets": "left", "value": "right"}), "AugAssign": ("augmented_assignment", {"target": "left", "value": "right"}), "AnnAssign": ("assignment", {"target": "left", "annotation": "type", "value": "right"}),
    "For": ("for_statement", {"target": "left", "iter": "right"}), "AsyncFor": ("for_statement", {"target": "left", "iter": "right"}), "While": ("while_statement", {"test": "condition"}), "If": ("if_statement", {"test": "condition", "body": "consequence", "orelse": "alternative"}),
    "With": ("with_statement", {}), "AsyncWith": ("with_statement", {}), "Raise": ("raise_statement", {"cause": "cause"}), "Try": ("try_statement", {}), "ExceptHandler": ("except_clause", {}), "Assert": ("assert_statement", {}),
    "Import": ("import_statement", {"names": "name"}), "ImportFrom": ("import_from_statement", {"names": "name"}), "alias": ("dotted_name", {}), "Global": ("global_statement", {}), "Nonlocal": ("nonlocal_statement", {}), "Expr": ("expression_statement", {}),
    "Pass": ("pass_statement", {}), "Break": ("break_statement", {}), "Continue": ("continue_statement", {}), "BoolOp": ("boolean_operator", {}), "NamedExpr": ("named_expression", {"target": "name", "value": "value"}), "BinOp": ("binary_operator", {"left": "left", "right": "right"}),
    "UnaryOp": ("unary_operator", {"operand": "argument"}), "Lambda": ("lambda", {"body": "body"}), "IfExp": ("conditional_expression", {}), "Dict": ("dictionary", {}), "Set": ("set", {}), "ListComp": ("list_comprehension", {"elt": "body"}), "SetComp": ("set_comprehension", {"elt": "body"}),
    "DictComp": ("dictionary_comprehension", {}), "GeneratorExp": ("generator_expression", {"elt": "body"}), "Await": ("await", {}), "Yield": ("yield", {}), "YieldFrom": ("yield", {}), "Compare": ("comparison_operator", {}), "Call": ("call", {"func": "function"}),
    "keyword": ("keyword_argument", {"value": "value"}), "JoinedStr": ("string", {}), "Attribute": ("attribute", {"value": "object"}), "Subscript": ("subscript", {"value": "value", "slice": "subscript"}), "Starred": ("list_splat", {}), "Name": ("identifier", {}), "List": ("list", {}),
    "Tuple": ("tuple", {}), "Slice": ("slice", {}), "arg": ("identifier", {}), "Match": ("match_statement", {"subject": "subject"}),
}
_CONSTANTS = {str: "string", bytes: "string", int: "integer", float: "float", complex: "float", bool: "true", type(None): "none", type(...): "ellipsis"}
# Kinds that Python's parser has no class for.
_MADE = {"block", "parameters", "argument_list", "identifier", "string", "integer", "float", "true", "false", "none", "ellipsis", "not_operator", "decorated_definition", "decorator", "else_clause", "finally_clause"}


def _like(table: dict, language: str, default=None):
    base = {"cpp": "c", "tsx": "typescript"}.get(language, language)
    return table.get(base, default)


def vocabulary(language: str) -> tuple[set[str], set[str]]:
    """The kinds and fields that trees of this language can have."""
    if language == "python":
        fields = {f for _, own in PYTHON.values() for f in own.values()}
        return {k for k, _ in PYTHON.values()} | _MADE, fields | {"name", "parameters", "body", "definition", "superclasses", "arguments", "attribute", "alternative", "module_name"}
    kinds = {ROOTS.get(language, "program"), "group", "identifier", "comment", *_like(DECLARED, language).values(), *BODIES.values(), _like(BLOCKS, language, "block"), _like(PARAMETERS, language, "formal_parameters"), _like(ARGUMENTS, language, "arguments")}
    kinds |= {_like(STRINGS, language, "string"), _like(NUMBERS, language, "number"), *_like(COMMENTS, language, ()), *_like(NAMES, language, {}).values(), "method_invocation" if language == "java" else "call_expression"}
    kinds |= {"type_spec"} if language == "go" else {"function_declarator"} if language in ("c", "cpp") else set()
    return kinds, {"name", "parameters", "body", "function", "arguments", "type", "declarator"}


class _Tree:
    def __init__(self, line):
        self.nodes: list[list] = []
        self.line = line

    def add(self, parent: int | None, kind: str, field: str | None, start: int, end: int, text: str | None = None) -> int:
        self.nodes.append([len(self.nodes), len(self.nodes), parent, kind, field, start, end, self.line(start), self.line(max(start, end - 1)), text])
        return len(self.nodes) - 1

    def close(self) -> list[tuple]:
        for n in reversed(self.nodes):
            if n[2] is not None:
                self.nodes[n[2]][1] = max(self.nodes[n[2]][1], n[1])
        return [tuple(n) for n in self.nodes]


def of_tokens(source: str, language: str, plain: list | None = None) -> list[tuple]:
    """plain: lines of plain calls are not read but added to it: (place among the nodes, parent, first offset, end)."""
    t = Tokens(source, language, plain is not None)
    tree = _Tree(t.line)
    root = tree.add(None, ROOTS.get(language, "program"), None, 0, len(source))
    kinds, names = _like(DECLARED, language), _like(NAMES, language, {})
    keywords = KEYWORDS.get(language, KEYWORDS["c"])
    block, own_comments = _like(BLOCKS, language, "block"), _like(COMMENTS, language, ("comment", "comment"))
    begun: dict[int, list] = {}
    for f in declarations(t):
        begun.setdefault(f[0], []).append(f)
    # What opens: (last token or offset, node, what its brackets are)
    open_: list[tuple[int, int, dict[int, tuple[str, str | None]]]] = [(len(t.text), root, {})]
    named: dict[int, tuple[int, str, str]] = {}  # name's token: declaration, its kind, the name's
    comments, c = t.comments, 0
    seen: dict[tuple[int, int], int] = {}

    def comment(limit: int) -> None:
        nonlocal c
        while c < len(comments) and comments[c][0] < limit:
            a, z = comments[c]
            tree.add(open_[-1][1], own_comments[source.startswith("/*", a)], None, a, z, source[a:z] if z - a <= 4096 else None)
            c += 1

    for i, x in enumerate(t.text):
        while open_[-1][0] < i:
            open_.pop()
        comment(t.at[i])
        for a, z, kind, _, name in begun.get(i, ()):
            at, end = t.at[a], t.ends[z]
            if (a, z) in seen:  # a group's further types, a block's further labels
                node = seen[a, z]
            else:
                node = seen[a, z] = tree.add(open_[-1][1], kinds[kind], None, at, end)
                brackets: dict[int, tuple[str, str | None]] = {}
                if kind in ("function", "method"):
                    j = name + 1
                    while j < z and t.text[j] != "(":
                        j += 1
                    if j < z and t.match[j] > 0:
                        brackets[j] = (_like(PARAMETERS, language, "formal_parameters"), "parameters")
                if t.text[z] == "}":
                    brackets[t.match[z]] = ({**BODIES, "function": block, "method": block}[kind] if language not in ("hcl", "go") else block, "body")
                open_.append((z, node, brackets))
            named[name] = (node, kind, names.get(kind, "identifier"))
        parent = open_[-1][1]
        if i in t.plain:
            plain.append((len(tree.nodes), parent, *t.plain[i]))
        elif i in named:
            own, kind, leaf = named[i]
            field = "type" if kind == "impl" else None if language == "hcl" else "name"
            if language == "go" and kind == "struct":
                own = tree.add(own, "type_spec", None, t.at[i], t.ends[t.last[i]])
                open_.append((t.last[i], own, {}))
            elif language in ("c", "cpp") and kind == "function":
                own, field = tree.add(own, "function_declarator", "declarator", t.at[i], t.ends[t.match[i + 1]]), "declarator"
                open_.append((t.match[i + 1], own, {i + 1: ("parameter_list", "parameters")}))
            tree.add(own, leaf, field, t.at[i], t.ends[i], x)
        elif t.kinds[i] == "word":
            if x in keywords:
                continue
            called = i + 1 < len(t.text) and t.text[i + 1] == "(" and t.match[i + 1] > 0 and language not in ("bash", "hcl") and (not i or t.text[i - 1] not in ("fn", "func", "function"))
            if called:
                z = t.match[i + 1]
                parent = tree.add(parent, "method_invocation" if language == "java" else "call_expression", None, t.at[i], t.ends[z])
                open_.append((z, parent, {i + 1: (_like(ARGUMENTS, language, "arguments"), "arguments")}))
            tree.add(parent, "word" if language == "bash" else "identifier", ("name" if language == "java" else "function") if called else None, t.at[i], t.ends[i], x)
        elif t.kinds[i] == "string":
            tree.add(parent, _like(STRINGS, language, "string"), None, t.at[i], t.ends[i], x if len(x) <= 4096 else None)
        elif t.kinds[i] == "number":
            tree.add(parent, _like(NUMBERS, language, "number"), None, t.at[i], t.ends[i], x)
        elif x in ("(", "[", "{") and t.match[i] > i:
            z = t.match[i]
            kind, field = open_[-1][2].get(i, (block if x == "{" else "group", None))
            open_.append((z, tree.add(parent, kind, field, t.at[i], t.ends[z]), {}))
    while len(open_) > 1:
        open_.pop()
    comment(len(source) + 1)
    return tree.close()


def of_python(source: str) -> list[tuple]:
    """Raises what the parser raises."""
    module = ast.parse(source)
    plain = source.isascii()
    starts = [0]
    for row in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source):
        starts.append(starts[-1] + len(row))

    def at(line: int, column: int) -> int:
        begin = starts[line - 1]
        if plain:
            return begin + column
        return begin + len(source[begin : starts[line]].encode()[:column].decode("utf-8", "ignore"))

    newlines = [m.start() for m in re.finditer("\n", source)]
    tree = _Tree(lambda offset: bisect_right(newlines, offset - 1) + 1)

    def span(nodes: list[ast.AST]) -> tuple[int, int]:
        first = (getattr(nodes[0], "decorator_list", None) or nodes)[0]
        begin = at(first.lineno, first.col_offset)
        return source.rfind("@", 0, begin) if first is not nodes[0] else begin, at(nodes[-1].end_lineno, nodes[-1].end_col_offset)

    # Depth first without recursion: what is taken up next stands last.
    root = tree.add(None, "module", None, 0, len(source))
    todo: list = [(n, root, None) for n in reversed(module.body)]
    while todo:
        node, parent, field = todo.pop()
        if callable(node):
            node()
            continue
        own_kind, fields = PYTHON.get(type(node).__name__, (None, {}))
        a, z = span([node])
        if decorators := getattr(node, "decorator_list", None):
            if field != "definition":
                whole = tree.add(parent, "decorated_definition", field, a, z)
                todo.append((node, whole, "definition"))
                todo.extend((lambda d=d, whole=whole: todo.append((d, tree.add(whole, "decorator", None, source.rfind("@", 0, span([d])[0]), span([d])[1]), None)), None, None) for d in reversed(decorators))
                continue
            a = at(node.lineno, node.col_offset)
        if isinstance(node, ast.Constant):
            kind = {True: "true", False: "false"}[node.value] if isinstance(node.value, bool) else _CONSTANTS.get(type(node.value), "string")
            tree.add(parent, kind, field, a, z, source[a:z] if z - a <= 4096 else None)
            continue
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            parent = tree.add(parent, "expression_statement", None, a, z)
        if own_kind is None:
            continue
        leaf = isinstance(node, (ast.Name, ast.arg, ast.alias))
        own = tree.add(parent, own_kind if not (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not)) else "not_operator", field, a, z, source[a:z] if leaf and z - a <= 4096 else None)
        parts: list[tuple[int, object]] = []  # (offset, what to do), put in order
        again = lambda n, f, own=own: (span([n])[0], (n, own, f))

        def later(kind: str, f: str | None, nodes: list, own: int = own) -> tuple[int, object]:
            def do() -> None:
                inner = tree.add(own, kind, f, *span(nodes))
                todo.extend((n, inner, None) for n in reversed(nodes))

            return span(nodes)[0], (do, None, None)

        def leafed(kind: str, f: str, start: int, end: int, own: int = own) -> tuple[int, object]:
            return start, (lambda: tree.add(own, kind, f, start, end, source[start:end]), None, None)

        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            m = re.compile(rf"(?:async\s+)?(?:def|class)\s+({re.escape(node.name)})").match(source, a)
            start = m.start(1) if m else a
            parts.append(leafed("identifier", "name", start, start + len(node.name)))
            if isinstance(node, ast.ClassDef):
                given = [*node.bases, *node.keywords]
                if given:
                    parts.append(later("argument_list", "superclasses", sorted(given, key=lambda n: (n.lineno, n.col_offset))))
            else:
                given = [x for x in (*node.args.posonlyargs, *node.args.args, node.args.vararg, *node.args.kwonlyargs, node.args.kwarg, *node.args.defaults, *node.args.kw_defaults) if x is not None]
                if given:
                    parts.append(later("parameters", "parameters", sorted(given, key=lambda n: (n.lineno, n.col_offset))))
                else:
                    empty = source.find("(", start)
                    parts.append(leafed("parameters", "parameters", empty, source.find(")", empty) + 1))
                if node.returns is not None:
                    parts.append(again(node.returns, "return_type"))
            parts.append(later("block", "body", node.body))
        elif isinstance(node, ast.Call):
            parts.append(again(node.func, "function"))
            given = [*node.args, *node.keywords]
            if given:
                parts.append(later("argument_list", "arguments", sorted(given, key=lambda n: (n.lineno, n.col_offset))))
            else:
                begin = span([node.func])[1]
                parts.append(leafed("argument_list", "arguments", begin, z))
        else:
            if isinstance(node, ast.Attribute):
                parts.append(leafed("identifier", "attribute", z - len(node.attr), z))
            if isinstance(node, ast.keyword) and node.arg:
                parts.append(leafed("identifier", "name", a, a + len(node.arg)))
            for name, value in ast.iter_fields(node):
                if leaf or isinstance(node, ast.JoinedStr):
                    break
                if isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                    kind = {"orelse": "else_clause", "finalbody": "finally_clause"}.get(name, "block")
                    parts.append(later(kind, fields.get(name) or ("body" if name == "body" else "alternative" if name == "orelse" else None), value))
                    continue
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST) and hasattr(child, "lineno"):
                        parts.append(again(child, fields.get(name)))
                    elif isinstance(child, ast.comprehension):
                        parts += [again(x, None) for x in (child.target, child.iter, *child.ifs)]
                    elif isinstance(child, ast.withitem):
                        parts += [again(x, None) for x in (child.context_expr, child.optional_vars) if x is not None]
                    elif isinstance(child, ast.arguments):
                        parts += [again(x, None) for x in (*child.posonlyargs, *child.args, child.vararg, *child.kwonlyargs, child.kwarg, *child.defaults, *child.kw_defaults) if x is not None]
        todo.extend(p for _, p in sorted(parts, key=lambda p: p[0], reverse=True))
    return tree.close()


def nodes(source: str, language: str, plain: list | None = None) -> list[tuple]:
    """plain: see ``of_tokens``."""
    return of_python(source) if language == "python" else of_tokens(source, language, plain)
