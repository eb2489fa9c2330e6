"""Column expressions on free text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends (``trim`` by itself knows only U+0020)."""
    return F.btrim(col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def plain_form(c: Column | str) -> Column:
    """Lower case, ``_`` as space, no backslashes, single spaces, trimmed. NULL stays NULL."""
    return squeeze(F.translate(F.lower(col(c)), "_\\", " "))


def blank(c: Column | str) -> Column:
    """True for NULL and for text without any visible character."""
    return F.coalesce(~col(c).rlike(r"(?U)\S"), F.lit(True))


def source_key(c: Column | str, default: str = "danbooru") -> Column:
    """Letters and digits of a source name in lower case; NULL is the default source."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(default))), r"[^\p{L}\p{N}]+", "")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column | str) -> Column:
    """ASCII letters in lower case; other letters as they stand."""
    return F.translate(col(c), UPPER, LOWER)


def like_contains(c: Column | str, term: Column | str) -> Column:
    """Substring test with live ``%`` and ``_`` wildcards, ASCII case-insensitive and without an escape character.

    ``term`` is a Python string (folded when the plan is built) or a column.
    """
    if isinstance(term, str):
        return like_folded(fold(c), term)
    pattern = F.concat(F.lit("%"), F.replace(fold(term), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.like(fold(c), pattern)


def like_folded(c: Column | str, term: str) -> Column:
    """The same for a column that is folded already and a constant term."""
    return col(c).like("%" + term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def search_terms(query: str | None) -> list[str]:
    """Terms of a query: split at commas and white space, blanks dropped."""
    import re

    return [t for t in re.split(r"[,\s]+", (query or "").strip()) if t]


def search_terms_of(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)[,\s]+"), lambda t: t != "")


def title(c: Column | str) -> Column:
    """First letter of every run of cased letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(col(c), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def or_default(c: Column | str, default: Column) -> Column:
    """The value, or the default for NULL and the empty text."""
    return F.coalesce(F.nullif(col(c), F.lit("")), default)


def file_name(c: Column | str, longest: int = 50) -> Column:
    """A name usable as a file name: lower case, ``_`` for spaces, only a-z, 0-9, ``_`` and ``-``."""
    return F.substring(F.regexp_replace(query_form(c), "[^a-z0-9_-]", ""), 1, longest)


def query_form(c: Column | str) -> Column:
    """Stripped, ``_`` for spaces, lower case."""
    return F.lower(F.replace(strip(F.coalesce(col(c), F.lit(""))), F.lit(" "), F.lit("_")))


def display_form(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("_"), F.lit(" "))


def compare_form(c: Column | str) -> Column:
    """Form in which tags of a list are compared: stripped, lower case, blanks for ``_``."""
    return display_form(F.lower(strip(c)))


#: Words that say nothing about a name. The short list belongs to name resolution.
STOP_WORDS_SHORT = ["the", "of", "a", "an", "in", "no", "to", "de", "la", "el", "wa", "ga"]
STOP_WORDS = STOP_WORDS_SHORT + (
    "and or but is are was were be been being have has had do does did will would shall should can could may might must i you he she it we they".split()
)


def meaningful_words(c: Column | str, stop: list[str] | None = None) -> Column:
    """Distinct words without stop words; brackets, backslashes and ``_`` separate."""
    pieces = F.split(F.regexp_replace(F.lower(col(c)), r"[_()\\]", " "), r"(?U)\s+")
    return F.array_except(F.filter(F.array_distinct(pieces), lambda w: w != ""), F.array(*map(F.lit, stop or STOP_WORDS)))


def unescape_brackets(c: Column | str) -> Column:
    return strip(F.replace(F.replace(col(c), F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")")))


def without_suffix(c: Column | str) -> Column:
    """The text without one bracketed group at its end."""
    return strip(F.regexp_replace(col(c), r"(?U)\s*\([^)]+\)\s*$", ""))


def suffix(c: Column | str) -> Column:
    """The text of the bracketed group at the end, or the empty text."""
    return F.regexp_extract(col(c), r"(?U)\(([^)]+)\)\s*$", 1)


def inverted(c: Column | str) -> Column:
    """Exactly two words change places; otherwise, or where a bracket stands, the empty text."""
    parts = F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")
    return F.when((F.size(parts) == 2) & ~col(c).contains("("), F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 1))).otherwise("")


def comma_tags(c: Column | str) -> Column:
    """Plain comma list: stripped, blanks dropped. NULL gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda t: strip(t)), lambda t: t != "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern with ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + (3 if pattern[k + 1 : k + 2] == "!" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[k + 1 : end]
            negated, body = ("^", body[1:]) if body[:1] == "!" else ("", body)
            out.append(f"[{negated}{body.translate(str.maketrans({'[': chr(92) + '[', chr(92): chr(92) * 2, '^': chr(92) + '^', '&': chr(92) + '&'}))}]")
            k = end
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_ " and c.isascii() else c)
        k += 1
    return "(?s)^" + "".join(out) + r"\z"
