"""Text columns: the line model, byte budgets, escaping, exact-once lookups. All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker of truncated text; characters that Markdown reads; characters that are shown as escapes;
# white space other than line ends.
MARKER = "…[truncated]"
MARKUP = r"([\\`*_{}\[\]()#+\-.!|=~])"
HIDDEN = r"[\p{Cc}\x{061C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
WHITE = r"[ \t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end adds no line, empty text has none; null gives null."""
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1))


def line_count(text: Column | str) -> Column:
    return F.size(lines(text)).cast("long")


def trim(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_slice(text: Column | str, start: Column | int, end: Column | int) -> Column:
    """Lines start..end (from 1, inclusive) joined again; what lies past the end is left out."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.array_join(F.slice(lines(text), first, last - first + 1), "\n")


def truncate(text: Column | str, size: int) -> Column:
    """At most ``size`` bytes, cut between characters."""
    t = _c(text)
    raw = t.cast("binary")
    cut = F.make_valid_utf8(F.substring(raw, 1, size).cast("string"))
    inside = F.hex(F.substring(raw, size + 1, 1)).rlike("^[89AB]")  # the next byte goes on with a character
    return F.when(F.octet_length(t) <= size, t).otherwise(F.when(inside, F.regexp_replace(cut, "�$", "")).otherwise(cut))


def truncate_marked(text: Column | str, size: int) -> Column:
    """At most ``size`` bytes with the marker; a size below the marker's cuts without it."""
    room = size - len(MARKER.encode())
    t = _c(text)
    short = F.concat(truncate(t, max(room, 0)), F.lit(MARKER)) if room >= 0 else truncate(t, size)
    return F.when(F.octet_length(t) <= size, t).otherwise(short)


def _pieces(text: Column, keep: str = "") -> Column:
    """Runs of plain characters, and each hidden one as ``\\u{hex}``. keep: a hidden character that stays."""
    hidden = HIDDEN if not keep else f"(?!{keep}){HIDDEN}"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({hidden}|(?:(?!{hidden}).)+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike(rf"\A{hidden}\z"), _escape(x)).otherwise(x))


def _escape(x: Column) -> Column:
    return F.concat(F.lit("\\u{"), F.lower(F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 16)), F.lit("}"))


def _shown(text: Column, keep: str = "") -> Column:
    """Most texts hold nothing hidden and are left as they are."""
    return F.when(text.rlike(HIDDEN if not keep else f"(?!{keep}){HIDDEN}"), F.array_join(_pieces(text, keep), "")).otherwise(text)


def sanitize(text: Column | str) -> Column:
    """Control, direction and zero-width characters as ``\\u{hex}``."""
    return _shown(_c(text))


def sanitize_bounded(text: Column | str, size: int) -> Column:
    """The sanitized text in at most ``size`` bytes. A longer one is cut between characters, never within an escape, and
    ends with the marker, or with as much of the marker as there is room for."""
    chars = F.regexp_extract_all(F.substring(_c(text), 1, size + 1), F.lit("(?s)(.)"), F.lit(1))  # a character takes a byte at least
    parts = F.transform(chars, lambda x: F.when(x.rlike(HIDDEN), _escape(x)).otherwise(x))
    room = size - len(MARKER.encode())

    def fitting(most: int) -> Column:
        """How many parts fit."""
        start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"))
        step = lambda s, x: F.struct((s["bytes"] + F.octet_length(x)).alias("bytes"), F.when(s["bytes"] + F.octet_length(x) <= most, s["n"] + 1).otherwise(s["n"]).alias("n"))
        return F.aggregate(parts, start, step)["n"]

    whole = sanitize(text)
    cut = F.concat(F.array_join(F.slice(parts, 1, fitting(room)), ""), F.lit(MARKER)) if room >= 0 else truncate(F.lit(MARKER), size)
    return F.when(F.octet_length(whole) <= size, whole).otherwise(cut)


def _entities(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def markdown_inline(text: Column | str) -> Column:
    """Text that Markdown shows as it is, in one line: line ends are shown as escapes too."""
    return _shown(_entities(F.regexp_replace(_c(text), MARKUP, r"\\$1")))


def markdown_block(text: Column | str) -> Column:
    """The same over several lines."""
    return _shown(_entities(F.regexp_replace(_c(text), MARKUP, r"\\$1")), r"\n")


def markdown_code(text: Column | str) -> Column:
    """Text for a code block: only hidden characters are escaped."""
    return _shown(_c(text), r"\n")


def code_fence(text: Column | str) -> Column:
    """A fence longer than any run of its character in the text, three at least; backticks unless tildes are shorter."""
    longest = lambda ch: F.greatest(F.lit(2), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_c(text), F.lit(f"({ch}+)"), F.lit(1)), F.length)), F.lit(0))) + 1
    ticks, tildes = longest("`"), longest("~")
    return F.when(ticks <= tildes, F.repeat(F.lit("`"), ticks)).otherwise(F.repeat(F.lit("~"), tildes))


def occurrences(text: Column | str, part: Column | str) -> Column:
    """How often ``part`` stands in the text without overlap; 0 for an empty part."""
    t, p = _c(text), _c(part)
    return F.when(F.length(p) == 0, F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).cast("long")


def once_lines(text: Column | str, part: Column | str) -> tuple[Column, Column]:
    """First and last line of ``part`` if it stands exactly once in the text, else nulls. What overlaps with the first place
    is no other one."""
    t, p = _c(text), _c(part)
    before = F.call_function("substring_index", t, p, F.lit(1))
    again = F.contains(F.substr(t, F.length(before) + F.length(p) + F.lit(1)), p)
    once = (F.length(p) > 0) & F.contains(t, p) & ~again
    first = newlines(before) + 1
    return F.when(once, first).cast("long"), F.when(once, first + newlines(F.regexp_replace(p, r"\n\z", ""))).cast("long")


def token_estimate(size: Column | str) -> Column:
    """Tokens of so many bytes, at four bytes each."""
    return F.floor(_c(size) / 4).cast("long")


def render_ranges(ranges: Column | str) -> Column:
    """array<struct<start, end>> as ``1-3, 7``."""
    one = lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    return F.array_join(F.transform(_c(ranges), one), ", ")


def signature_budget(context: Column | str) -> Column:
    """Tokens for signatures in a context of so many tokens: 15 per cent, 8,000 at least; hundreds are counted first."""
    return F.greatest(F.floor(_c(context) / 100) * 15, F.lit(8_000)).cast("long")


def shard_budget(context: Column | str) -> Column:
    """Tokens of a shard's contents: 40 per cent, 16,000 at least."""
    return F.greatest(F.floor(_c(context) / 100) * 40, F.lit(16_000)).cast("long")
