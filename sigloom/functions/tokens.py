"""Tokens of messages, in the two senses that searches use.

A term is a run of Unicode letters and digits, compared without case. A token
is a run of ASCII letters, digits, underscores and characters beyond ASCII; its
case folds in ASCII only. Single-token tests are regular expressions with
look-arounds behind a plain `contains`, so no array of tokens is built for them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_TOKEN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"
BETWEEN = r"[\x00-\x7F&&[^0-9A-Za-z_]]+"
IN_TERM = r"[\p{IsAlphabetic}\p{N}]"


def tokens(message: Column) -> Column:
    return F.filter(F.split(message, BETWEEN), lambda t: t != "")


def terms(message: Column) -> Column:
    return F.transform(F.regexp_extract_all(message, F.lit(f"{IN_TERM}+"), F.lit(0)), lambda t: F.lower(t))


def quoted(text: str) -> str:
    """A literal for Java's regular expressions."""
    return re.sub(r"([^0-9A-Za-z_\s\u0080-\U0010FFFF])", r"\\\1", text)


def is_token(text: str) -> bool:
    """A needle with a separator in it, or none at all, is no token."""
    return bool(text) and not re.search(r"[\x00-\x7F]", re.sub(r"[0-9A-Za-z_]", "", text))


def has_token(message: Column, needle: str, any_case: bool = False) -> Column:
    if not is_token(needle):
        return F.lit(False)
    whole = F.rlike(message, F.lit(f"{'(?i)' if any_case else ''}(?<!{IN_TOKEN}){quoted(needle)}(?!{IN_TOKEN})"))
    return whole if any_case else message.contains(needle) & whole


def has_all_tokens(message: Column, needles: list[str]) -> Column:
    """Every needle as a token, in any order; none at all match everything."""
    return reduce(lambda a, b: a & b, [has_token(message, n) for n in needles], F.lit(True))


def has_term(message: Column, needle: str) -> Column:
    if not re.fullmatch(r"[^\W_]+", needle):
        return F.lit(False)
    return F.rlike(message, F.lit(f"(?iu)(?<!{IN_TERM}){quoted(needle)}(?!{IN_TERM})"))


def has_token_prefix(message: Column, prefix: str, any_case: bool = False) -> Column:
    if not is_token(prefix):
        return F.lit(False)
    return F.rlike(message, F.lit(f"{'(?i)' if any_case else ''}(?<!{IN_TOKEN}){quoted(prefix)}"))


def has_token_like(message: Column, pattern: str, any_case: bool = False) -> Column:
    """A token in which the regular expression is found."""
    flag = "(?i)" if any_case else ""
    return F.exists(tokens(message), lambda t: F.rlike(t, F.lit(flag + pattern)))


def wildcard(pattern: str) -> str:
    """% and _ as an anchored regular expression."""
    return "^" + "".join(".*" if c == "%" else "." if c == "_" else quoted(c) for c in pattern) + "$"


def has_phrase(message: Column, words: list[str], gap: int = 0, any_case: bool = True) -> Column:
    """The words in order: next to each other, or each within gap other tokens of the one before, nearest first."""
    if not words or not all(map(is_token, words)):
        return F.lit(False)
    if gap == 0 or len(words) == 1:
        return F.rlike(message, F.lit(f"{'(?i)' if any_case else ''}(?<!{IN_TOKEN})" + BETWEEN.join(map(quoted, words)) + f"(?!{IN_TOKEN})"))
    # Tokens that are skipped are not the next word, so each word is met at its nearest place.
    parts = [quoted(words[0])]
    for word in words[1:]:
        end = f"{quoted(word)}(?!{IN_TOKEN})"
        parts.append(f"(?!{IN_TOKEN})(?:{BETWEEN}(?!{end}){IN_TOKEN}++){{0,{gap}}}{BETWEEN}{end}")
    return F.rlike(message, F.lit(f"{'(?i)' if any_case else ''}(?<!{IN_TOKEN})" + "".join(parts)))


def has_fuzzy(message: Column, needle: str, distance: int) -> Column:
    return F.exists(tokens(message), lambda t: F.levenshtein(F.lower(t), F.lit(needle.lower()), distance) >= 0)


def relevance(message: Column, needles: list[str]) -> Column:
    """Sum over the needles of tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 12)); 1 without needles."""
    needles = list(dict.fromkeys(n.lower() for n in needles if n))
    if not needles:
        return F.lit(1.0)
    low = F.lower(message)
    length = F.greatest(F.regexp_count(low, F.lit(f"{IN_TOKEN}+")), F.lit(1))

    def part(needle: str) -> Column:
        whole = F.lit(f"(?<!{IN_TOKEN}){quoted(needle)}(?!{IN_TOKEN})")
        tf = F.regexp_count(low, whole).cast("double") if is_token(needle) else F.lit(0.0)
        return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 12.0))

    total = part(needles[0])
    for needle in needles[1:]:
        total = total + part(needle)
    return total
