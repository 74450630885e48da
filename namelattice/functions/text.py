"""Names to tokens: column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uncamel(name: Column, mode: str = "truncate") -> Column:
    """Upper case with a space at camel-case borders.

    A border lies behind a lower-case letter before a capital, and behind the
    second of two capitals before a lower-case letter; the first character and
    the last two never end a word of the first kind.  Names of three characters
    keep only the first unless ``mode`` is "fixed".
    """
    parted = F.regexp_replace(name, r"(?<=.)(\p{Ll})(?=\p{Lu}.)", "$1 ")
    parted = F.upper(F.regexp_replace(parted, r"(?<=.\p{Lu})(\p{Lu})(?=\p{Ll})", "$1 "))
    three = F.upper(F.substring(name, 1, 1) if mode == "truncate" else name)
    size = F.length(name)
    return F.when(size < 3, F.upper(name)).when(size == 3, three).otherwise(parted)


def tokens(name: Column, mode: str = "truncate") -> Column:
    """Tokens of a name: ``#`` deleted, ``- _ . :`` read as spaces, cut at ``/`` and spaces, empties dropped."""
    cleaned = F.translate(uncamel(name, mode), "-_.:#", "    ")
    cut = F.transform(F.split(cleaned, "[/ ]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda t: t != "")


def split_trailing(token: Column) -> Column:
    """A token without its last digits, and these digits; a token of digits, or without any behind, is whole."""
    head, tail = F.regexp_extract(token, r"^(.*?)([0-9]+)$", 1), F.regexp_extract(token, r"^(.*?)([0-9]+)$", 2)
    return F.when((tail == "") | (head == ""), F.array(token)).otherwise(F.array(head, tail))


def split_runs(token: Column) -> Column:
    """Runs of letters and runs of digits; other characters are dropped."""
    return F.regexp_extract_all(token, F.lit(r"[\p{L}]+|\d+"), F.lit(0))


def without_digits(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.rlike(r"^\p{Nd}+$"))


def blank_digits(token: Column) -> Column:
    return F.when(token.rlike(r"^[0-9]+$"), F.lit("")).otherwise(token)


#: Tokenizers by name; a pipeline takes one of these or any function of a name column.
TOKENIZERS = {"simple": tokens}


#: What Python's strip() takes off.
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(line: Column) -> Column:
    """Without white space at both ends, as Python's strip() has it."""
    return F.regexp_replace(line, rf"^[{WHITE}]+|[{WHITE}]+$", "")
