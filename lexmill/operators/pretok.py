"""Pre-tokenizers: text column to an array of pieces.

The published splitting grammars are single Java regular expressions, so that
splitting stays in the JVM. Pieces of the non-remapping ones join to the text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import byte_level_encode

#: The published splitting grammars.
PATTERNS = {
    "cl100k": r"(?U)'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "o200k": r"(?U)[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?:'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL]))?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?:'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL]))?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "tekken": r"(?U)[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    "gpt2": r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "digits": r"(?U)\p{N}+|\P{N}+",
    "digits_each": r"(?U)\p{N}|\P{N}+",
    "whitespace": r"(?U)[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]",
    "whitespace_split": r"(?U)\S+",
    "bert": r"(?U)[\p{P}\p{S}]|[^\s\p{P}\p{S}]+",
}
#: Their pieces join to the text.
LOSSLESS = ("identity", "cl100k", "o200k", "tekken", "gpt2", "digits", "digits_each")


def pieces(text: Column, scheme: str) -> Column:
    if scheme == "identity":
        return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    if scheme == "metaspace":
        marked = F.concat(F.when(text.startswith(" "), F.lit("")).otherwise(F.lit("▁")), F.translate(text, " ", "▁"))
        return F.regexp_extract_all(marked, F.lit("▁[^▁]*"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(PATTERNS[scheme]), F.lit(0))


def byte_level_pieces(text: Column, prefix_space: bool = False, use_regex: bool = True) -> Column:
    """Pieces of the byte-level view, in which no byte is a space."""
    text = F.when(text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text)) if prefix_space else text
    own = pieces(text, "gpt2" if use_regex else "identity")
    # one call for the whole text: the map is byte by byte, so it can be applied before the pieces are cut apart
    joined = byte_level_encode(F.array_join(own, "\x00"))
    return F.when(F.size(own) > 0, F.split(joined, "Ā")).otherwise(own)  # U+0100 stands for the byte 0


BEHAVIOURS = ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")


def split_text(text: str, pattern: str, behaviour: str, invert: bool = False) -> list[str]:
    """Split at the matches of a pattern; what becomes of a match is its behaviour."""
    parts, at = [], 0
    for m in regex.finditer(pattern, text):
        if m.end() == m.start():
            continue
        if m.start() > at:
            parts.append((text[at : m.start()], invert))
        parts.append((m[0], not invert))
        at = m.end()
    if at < len(text):
        parts.append((text[at:], invert))
    out: list[str] = []
    if behaviour == "removed":
        return [t for t, hit in parts if not hit]
    if behaviour == "isolated":
        return [t for t, _ in parts]
    if behaviour == "contiguous":
        last = None
        for t, hit in parts:
            if hit and last:
                out[-1] += t
            else:
                out.append(t)
            last = hit
        return out
    if behaviour == "merged_with_previous":
        last = True
        for t, hit in parts:
            if hit and not last:
                out[-1] += t
            else:
                out.append(t)
            last = hit
        return out
    if behaviour == "merged_with_next":
        held = ""
        for t, hit in parts:
            if hit:
                if held:
                    out.append(held)
                held = t
            else:
                out.append(held + t)
                held = ""
        return out + [held] * bool(held)
    raise ValueError(behaviour)


def split_pieces(pattern: str, behaviour: str, invert: bool = False) -> Callable[[Column], Column]:
    """split_text() as a function on columns: one pattern in the JVM, unless matches may be empty or are inverted."""
    if not invert and regex.fullmatch(pattern, "") is None:
        gap = rf"(?:(?!{pattern})[\s\S])+"
        if behaviour == "removed":
            return lambda c: F.filter(F.regexp_extract_all(c, F.lit(rf"(?U)(?:{pattern})|({gap})"), F.lit(1)), lambda x: x != "")
        whole = {"isolated": rf"(?:{pattern})|{gap}", "contiguous": rf"(?:{pattern})+|{gap}", "merged_with_previous": rf"(?:{gap})?(?:{pattern})|{gap}", "merged_with_next": rf"(?:{pattern})(?:{gap})?|{gap}"}
        return lambda c: F.regexp_extract_all(c, F.lit("(?U)" + whole[behaviour]), F.lit(0))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, pattern, behaviour, invert), na_action="ignore")

    return run


def punctuation_pieces(text: Column, behaviour: str = "isolated") -> Column:
    """Split at punctuation; the two usual behaviours need no UDF."""
    if behaviour == "isolated":
        return F.regexp_extract_all(text, F.lit(r"(?U)\p{P}|\P{P}+"), F.lit(0))
    if behaviour == "removed":
        return F.regexp_extract_all(text, F.lit(r"(?U)\P{P}+"), F.lit(0))
    return split_pieces(r"\p{P}", behaviour)(text)


def chain(text: Column, schemes: list[str]) -> Column:
    """Pieces of pieces, in order."""
    out = pieces(text, schemes[0])
    for scheme in schemes[1:]:

        def again(p: Column) -> Column:
            return pieces(p, scheme)  # noqa: B023  used at once

        out = F.flatten(F.transform(out, again))
    return out


def safe_cut_rows(text: Column, target: int) -> Column:
    """Parts of a text of at least target characters, cut where no grammar joins what it separates: after a newline before a character that isn't white space. The last part may be shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?U).{{{target},}}?\n(?=\S)|.+"), F.lit(0))


CLASSES = {"letter": r"\p{L}", "number": r"\p{N}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "title": r"\p{Lt}", "modifier": r"\p{Lm}", "other_letter": r"\p{Lo}", "mark": r"\p{M}", "format": r"\p{Cf}", "punctuation": r"\p{P}", "white_space": r"\s"}


def class_count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){CLASSES[name]}"))


def added_token_pattern(tokens: list[dict]) -> str:
    """One pattern for added tokens, longest first. A token is {content, single_word, lstrip, rstrip}."""
    parts = []
    for t in sorted(tokens, key=lambda t: (-len(t["content"]), t["content"])):
        own = regex.escape(t["content"], special_only=True)
        if t.get("single_word"):
            own = rf"(?<![\p{{L}}\p{{N}}_]){own}(?![\p{{L}}\p{{N}}_])"
        parts.append((r"\s*" if t.get("lstrip") else "") + own + (r"\s*" if t.get("rstrip") else ""))
    return "|".join(parts)


def added_token_segments(text: Column, tokens: list[dict]) -> Column:
    """The text in order: ranges between added tokens, and the tokens themselves."""
    pattern = added_token_pattern(tokens)
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)(?U)(?:{pattern})|(?:(?!(?:{pattern})).)+"), F.lit(0)), lambda x: x != "")
