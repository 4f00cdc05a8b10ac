r"""Text normalisation as Column expressions.

Regular expressions are written so that Java and RE2 read them alike: no
``\b`` (use :func:`bounded`), no ``\s`` (its members are spelt out), ``\z`` for
the end of a text, ``(?d)`` in Java so that ``.``, ``^`` and ``$`` know only
the line feed. Null is the empty text throughout: callers coalesce first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundling.functions.cutting import WHITE

#: Members of Unicode White_Space, with and without the line feed.
WS_BUT_LF = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = r"\n" + WS_BUT_LF
#: What a regular expression's ASCII space class holds.
SP = r"\t\n\f\r "
#: Characters that may close a sentence.
CLOSERS = ".!?\"')\\]”’…»"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """A text without nulls."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def bounded(pattern: str) -> str:
    """``pattern`` between ASCII word borders; it must begin and end with a word character."""
    return rf"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def quoted(literal: str) -> str:
    """A literal inside a regular expression of either dialect."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in literal)


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(WHITE))


_OTHER_WHITE = WHITE.replace(" ", "")


def collapse(c: Column, mapped: str = "", to: str = "", without: str = "") -> Column:
    """Words joined by single spaces; letters of ``mapped`` become those of ``to``, those of ``without`` go, in the same pass."""
    white = "".join(x for x in _OTHER_WHITE if x not in without)
    plain = F.translate(c, mapped + white + without, to + " " * len(white))
    return F.trim(F.when(F.contains(plain, F.lit("  ")), sub(plain, " {2,}", " ")).otherwise(plain))


def lower(c: Column) -> Column:
    """Lower case by simple mapping, one character for one."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def normalise_space(c: Column) -> Column:
    """Line ends as line feeds, four or more of them as three, ends trimmed."""
    return strip(sub(sub(c, "\r\n?", "\n"), "\n{4,}", "\n\n\n"))


def normalise_claim(c: Column) -> Column:
    """Straight quotes, single spaces, lower case: how quotes and sources are compared."""
    return lower(collapse(c, "“”‘’", "\"\"''"))


def clean_output(c: Column) -> Column:
    """Without terminal escapes, carriage returns and control characters but line feed and tab."""
    return sub(sub(c, "\x1b\\[[0-?]*[ -/]*[@-~]"), r"[\x00-\x08\x0B-\x1F]")


def strip_thinking(c: Column) -> Column:
    """What follows the last ``</think>``, from the first top heading on if there is one."""
    after = F.substring_index(c, "</think>", -1)
    found = F.regexp_extract(after, rf"(?ds)\A(?:.*?\n)??([{WS_BUT_LF}]*# [{WS_BUT_LF}]*[^{WS}].*)\z", 1)
    return strip(F.when(found != "", found).otherwise(after))


def strip_placeholders(c: Column) -> Column:
    """Without a leaked thesis label, empty bold lines and ellipsis headings below the first level."""
    c = sub(c, rf"(?iu)\*\*[{SP}]*opening thesis paragraph\.?[{SP}]*\*\*[{SP}]*")
    c = sub(c, r"(?dm)^\*\*[ \t]*(?:\.{2,}|…)?[ \t]*\*\*[ \t]*\r?\n?")
    return sub(c, r"(?dm)^#{2,6}[ \t]*(?:\.{2,}|…)[ \t]*\r?\n?")


def clean_text(c: Column) -> Column:
    """Markdown and tags removed, link texts kept, single spaces."""
    c = sub(sub(c, "<[^>]*>"), r"(?d)\[(.*?)\]\([^)]*\)", "$1")
    return collapse(c, without="*_`~\r")


def as_bytes(c: Column) -> Column:
    """One character (U+0000 to U+00FF) for each UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def from_bytes(c: Column) -> Column:
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


_PART = r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF7][\x80-\xBF]{0,2})\z"


def clip_bytes(c: Column, n: int) -> Column:
    """The first ``n`` bytes, less a character that is cut."""
    return F.when(F.octet_length(c) <= n, c).otherwise(from_bytes(sub(F.left(as_bytes(c), F.lit(n)), _PART)))


def truncate_word(c: Column, n: int) -> Column:
    """At most ``n`` bytes, cut at the last space, or without one at a character."""
    head = F.left(as_bytes(c), F.lit(n))
    word = F.regexp_extract(head, r"(?s)\A(.+) ", 1)
    return F.when(F.octet_length(c) <= n, c).otherwise(from_bytes(F.when(word != "", word).otherwise(sub(head, _PART))))


def slugify(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, at most 90 bytes."""
    dashed = F.regexp_replace(sub(lower(c), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")
    cut = F.regexp_replace(F.left(dashed, F.lit(90)), "^-+|-+\\z", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled-article"))


def quote_yaml(c: Column) -> Column:
    """A double-quoted scalar without control characters."""
    c = sub(F.translate(c, "\n\t\r", "   "), r"[\x00-\x1F\x7F]")
    c = collapse(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    return F.concat(F.lit('"'), c, F.lit('"'))


def extract_title(c: Column) -> Column:
    """Text of the first top heading."""
    found = strip(F.regexp_extract(c, rf"(?dm)^#[{SP}]+(.+)$", 1))
    return F.when(F.regexp_like(c, F.lit(rf"(?dm)^#[{SP}]+.+$")), found).otherwise(F.lit("untitled-article"))


def first_line(c: Column) -> Column:
    """What stands before the first line feed, trimmed; a text without one as it is."""
    return F.when(F.contains(c, F.lit("\n")), strip(F.substring_index(c, "\n", 1))).otherwise(c)


def trim_sentence(c: Column) -> Column:
    """Up to the last closer that ends the text or stands before white space; empty without one."""
    return F.regexp_extract(c, rf"(?s)\A(.*[{CLOSERS}])(?=[{WS}]|\z)", 1)


def ends_sentence(c: Column) -> Column:
    return F.regexp_like(c, F.lit(rf"(?:---|[{CLOSERS}])\z"))


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n]+\z", "")


def numbers(c: Column) -> Column:
    """Distinct numeric tokens, thousands separators removed, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))))


def word_count(c: Column) -> Column:
    """Runs of letters and numbers."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+"))
