"""Text scalars: whitespace, normal form, opening signature, keyword classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import constants as K

# Unicode white space; Java's plain \s covers ASCII only.
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{WS[1:]}")


def normal_form(text: Column) -> Column:
    """Stripped, lower-cased, inner white space collapsed to one space."""
    return F.regexp_replace(F.lower(strip(text)), f"{WS}+", " ")


def opening_tokens(text: Column, words: int = K.SIGNATURE_WORDS) -> Column:
    """The first ``words`` lower-case word tokens of the text.

    Tokens are maximal runs of word characters, so the scan can stop after the
    last one needed: lower-casing never merges or removes a token, hence the
    first tokens of the lower-cased text all come from this head.
    """
    head = F.regexp_extract(text, f"^(?:{NOT_WORD}*{WORD}+){{0,{words}}}", 0)
    tokens = F.split(F.lower(head), f"{NOT_WORD}+")
    return F.slice(F.array_remove(tokens, ""), 1, words)


def opening_signature(text: Column, words: int = K.SIGNATURE_WORDS) -> Column:
    """SHA-1 of the opening tokens: equal for texts whose openings differ only in
    case, punctuation or spacing."""
    return F.sha1(F.array_join(opening_tokens(text, words), " "))


def keyword_class(
    text: Column, keywords: Mapping[str, Sequence[str]] = K.KEYWORDS, *, whole_words: bool = False
) -> Column:
    """First class, in dictionary order, with a keyword in the text; else the fallback.

    Keywords match as substrings ("bank" hits "embankment"); ``whole_words``
    asks for word boundaries instead.
    """
    lowered = F.lower(text)

    def hit(word: str) -> Column:
        if not whole_words:
            return lowered.contains(word)
        return lowered.rlike(f"(?<!{WORD})\\Q{word}\\E(?!{WORD})")

    chain = None
    for name, words in keywords.items():
        found = reduce(lambda a, b: a | b, [hit(w) for w in words])
        chain = F.when(found, F.lit(name)) if chain is None else chain.when(found, F.lit(name))
    fallback = F.lit(K.FALLBACK_CLASS)
    return fallback if chain is None else chain.otherwise(fallback)


def keyword_confidence(content_class: Column) -> Column:
    return F.when(content_class == K.FALLBACK_CLASS, F.lit(K.FALLBACK_CONFIDENCE)).otherwise(
        F.lit(K.KEYWORD_CONFIDENCE)
    )
