"""Languages of files by extension, name or first line, and how each writes comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension, file_name

# Extensions (lower case) of each language.
EXTENSIONS = {
    "rust": "rs",
    "go": "go",
    "typescript": "ts",
    "tsx": "tsx",
    "javascript": "js jsx mjs cjs",
    "python": "py pyi",
    "java": "java",
    "ruby": "rb",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hxx",
    "csharp": "cs",
    "kotlin": "kt kts",
    "swift": "swift",
    "scala": "scala",
    "php": "php",
    "lua": "lua",
    "bash": "sh bash zsh",
    "hcl": "tf tofu hcl",
    "yaml": "yaml yml",
    "toml": "toml",
    "json": "json",
    "markdown": "md markdown",
    "sql": "sql",
    "html": "html htm",
    "css": "css scss sass less",
    "xml": "xml xsl xslt",
    "protobuf": "proto",
    "graphql": "graphql gql",
    "zig": "zig",
    "nim": "nim",
    "elixir": "ex exs",
    "erlang": "erl hrl",
    "haskell": "hs lhs",
    "ocaml": "ml mli",
    "r": "r",
    "dart": "dart",
    "vue": "vue",
    "svelte": "svelte",
}
# File names of each language.
NAMES = {
    "dockerfile": "Dockerfile Containerfile",
    "makefile": "Makefile GNUmakefile",
    "cmake": "CMakeLists.txt",
    "toml": "Cargo.toml Cargo.lock",
    "ruby": "Gemfile Rakefile",
    "groovy": "Jenkinsfile",
}
# Pairs that open and close a block comment.
SLASH, MARKUP = ("/*", "*/"), ("<!--", "-->")
# Fixed values: (line markers, block pairs) of a comment style.
STYLES = {
    "c": (["//"], [SLASH]),
    "hash": (["#"], []),
    "hcl": (["#", "//"], [SLASH]),
    "python": (["#"], [('"""', '"""'), ("'''", "'''")]),
    "ruby": (["#"], [("=begin", "=end")]),
    "sql": (["--"], [SLASH]),
    "lua": (["--"], [("--[[", "]]")]),
    "haskell": (["--"], [("{-", "-}")]),
    "ocaml": ([], [("(*", "*)")]),
    "erlang": (["%"], []),
    "markup": ([], [MARKUP]),
    "web": (["//"], [SLASH, MARKUP]),
    "none": ([], []),
}
# Languages of each style.
STYLE_LANGUAGES = {
    "c": "c cpp csharp css dart go groovy java javascript kotlin php protobuf rust scala swift tsx typescript zig",
    "hash": "bash cmake dockerfile elixir graphql makefile nim perl r toml yaml",
    "hcl": "hcl",
    "python": "python",
    "ruby": "ruby",
    "sql": "sql",
    "lua": "lua",
    "haskell": "haskell",
    "ocaml": "ocaml",
    "erlang": "erlang",
    "markup": "html markdown xml",
    "web": "svelte vue",
    "none": "json",
}
# Names that are not just the capitalized id.
SHOWN = {
    "bash": "Shell",
    "cmake": "CMake",
    "cpp": "C++",
    "csharp": "C#",
    "css": "CSS",
    "graphql": "GraphQL",
    "hcl": "HCL",
    "html": "HTML",
    "javascript": "JavaScript",
    "json": "JSON",
    "ocaml": "OCaml",
    "php": "PHP",
    "protobuf": "Protocol Buffers",
    "sql": "SQL",
    "toml": "TOML",
    "tsx": "TSX",
    "typescript": "TypeScript",
    "xml": "XML",
    "yaml": "YAML",
}
STYLE_OF = {language: style for style, all_ in STYLE_LANGUAGES.items() for language in all_.split()}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [x for value, keys in table.items() for k in keys.split() for x in (F.lit(k), F.lit(value))]
    return F.try_element_at(F.create_map(*pairs), key)


def by_path(path: Column) -> Column:
    """By extension, else by file name; null if neither is known."""
    return F.coalesce(_lookup(EXTENSIONS, F.lower(extension(path))), _lookup(NAMES, file_name(path)))


def by_first_line(line: Column) -> Column:
    """By the interpreter that a ``#!`` line names."""
    l = F.lower(line)
    has = lambda word: F.contains(l, F.lit(word))
    named = F.when(has("python"), "python").when(has("node"), "javascript").when(has("bash") | l.endswith("/sh"), "bash").when(has("ruby"), "ruby").when(has("perl"), "perl")
    return F.when(F.startswith(line, F.lit("#!")), named)


def detect(path: Column, first_line: Column) -> Column:
    return F.coalesce(by_path(path), by_first_line(first_line))


def shown(language: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv))
    return F.when(language.isin(list(STYLE_OF)), F.coalesce(F.try_element_at(names, language), F.initcap(language))).otherwise(language)


def style(language: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STYLE_OF.items() for x in kv)), language), F.lit("none"))
