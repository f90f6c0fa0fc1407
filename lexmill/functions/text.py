"""Text normalizers as functions from Column to Column.

What built-in functions can say is said with them; the rest are Arrow-batched
UDFs over pure kernels, which are kept apart so that they can be tested alone.
Nulls stay null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Kernel = Callable[[str], str]
ASCII_SPACE = r"[\t\n\x0B\f\r ]"


#: Bytes of texts that a worker looks at together.
BYTES = 1 << 20


def text_slices(a: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array of texts of about BYTES bytes; a text stays whole."""
    total, lo = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BYTES, side="right")))
        yield a.slice(lo, hi - lo)
        lo = hi


def lift(kernel: Kernel) -> Callable[[Column], Column]:
    """A text kernel as a function on columns. Batches come back in slices, so a worker holds some MB of what the kernel made."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            if not len(whole):
                yield pa.array([], pa.string())
            for a in text_slices(whole):
                yield pa.array([None if t is None else kernel(t) for t in a.to_pylist()], pa.string())

    return run


def identity(c: Column) -> Column:
    return c


def unicode_form(form: str) -> Callable[[Column], Column]:
    """NFC, NFD, NFKC or NFKD; texts of ASCII are so already."""
    normal = unicodedata.normalize

    @F.arrow_udf(T.StringType())
    def run(a: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else normal(form, t) for t in a.to_pylist()], pa.string())

    return run


def replace_literal(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def replace_regex(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


def strip_ascii(c: Column, left: bool = True, right: bool = True) -> Column:
    """Without ASCII white space at the ends."""
    c = F.regexp_replace(c, f"^{ASCII_SPACE}+", "") if left else c
    return F.regexp_replace(c, f"{ASCII_SPACE}+$", "") if right else c


class Table(dict):
    """A table for str.translate(): what a function makes of each character, looked up once."""

    def __init__(self, of: Callable[[str], str]):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        made = self[code] = self.of(chr(code))
        return made


FOLDED = Table(lambda c: x if len(x := c.lower()) == 1 else c)


def fold_simple(text: str) -> str:
    """Lower case where it is one character for one."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


lowercase_simple = lift(fold_simple)


def prepend(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), c)


def sequence(steps: Iterable[Callable[[Column], Column]]) -> Callable[[Column], Column]:
    steps = list(steps)
    return lambda c: reduce(lambda x, f: f(x), steps, c)


# --- byte-level view ---------------------------------------------------------


@cache
def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it prints in Latin-1, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    keep = set(own)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def to_byte_level(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_byte_level())


@cache
def _byte_level() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


@cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def from_byte_level(text: str) -> str:
    table = _byte_of()
    return bytes(table[c] for c in text if c in table).decode("utf-8", "replace")


byte_level_encode, byte_level_decode = lift(to_byte_level), lift(from_byte_level)


# --- BERT and SentencePiece --------------------------------------------------


#: The blocks of CJK ideographs.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def _cleaned(c: str) -> str:
    kind = unicodedata.category(c)
    return " " if c in "\t\n\r" or kind == "Zs" else "" if c in "\0\ufffd" or kind in ("Cc", "Cf") else c


CLEANED = Table(_cleaned)
APART = Table(lambda c: f" {c} " if is_cjk(c) else c)
UNMARKED = Table(lambda c: "" if unicodedata.category(c) == "Mn" else c)


def bert_text(text: str, clean: bool = True, cjk: bool = True, strip_accents: bool | None = None, lower: bool = True) -> str:
    """Clean, set CJK characters apart, strip accents (by default with lower) and lower."""
    if clean:
        text = text.translate(CLEANED)
    if text.isascii():
        return text.lower() if lower else text
    if cjk:
        text = text.translate(APART)
    if lower if strip_accents is None else strip_accents:
        text = unicodedata.normalize("NFD", text).translate(UNMARKED)
    return text.lower() if lower else text


def bert(clean: bool = True, cjk: bool = True, strip_accents: bool | None = None, lower: bool = True) -> Callable[[Column], Column]:
    return lift(lambda t: bert_text(t, clean, cjk, strip_accents, lower))


def sentence_piece(c: Column, nfkc: bool = False, dummy_prefix: bool = True, collapse: bool = True) -> Column:
    """Spaces become U+2581: runs collapsed, one put before the text."""
    c = unicode_form("NFKC")(c) if nfkc else c
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), "^ | $", "") if collapse else c
    c = F.when(F.length(c) > 0, F.concat(F.lit(" "), c)).otherwise(c) if dummy_prefix else c
    return F.translate(c, " ", "▁")


def charsmap_text(text: str, rules: dict[str, str]) -> str:
    """Longest rule first, left to right; what no rule starts is kept."""
    longest = max(map(len, rules), default=0)
    out, i = [], 0
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            if (to := rules.get(text[i : i + n])) is not None:
                out.append(to)
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def charsmap(rules: dict[str, str]) -> Callable[[Column], Column]:
    return lift(lambda t: charsmap_text(t, rules))


# --- capitals as marks -------------------------------------------------------

#: The marks of a capital, a word of capitals and a deleted space. Texts that hold them don't come back as they were.
CAP, WORD, DEL = "\x0e", "\x0f", "\x11"


def caps_text(text: str) -> str:
    """A capital is written as CAP and its small letter, a word of two or more capitals as WORD and small letters. A letter or digit that no space or mark precedes gets DEL and a space, so that words look alike everywhere."""
    out, i, n = [], 0, len(text)
    last = ""
    while i < n:
        c = text[i]
        if c.isalpha():
            j = i
            while j < n and text[j].isalpha():
                j += 1
            word = text[i:j]
            low = word.lower()
            if last and not last.isspace():
                out.append(DEL + " ")
            if len(word) > 1 and word.isupper() and low.upper() == word and len(low) == len(word):
                out.append(WORD + low)
            else:
                out += [CAP + x if x != c and len(x) == 1 and x.upper() == c else c for c, x in ((c, c.lower()) for c in word)]
            last, i = word[-1], j
        else:
            if c.isdigit() and last and not last.isspace() and not last.isdigit():
                out.append(DEL + " ")
            out.append(c)
            last, i = c, i + 1
    return "".join(out)


def uncaps_text(text: str) -> str:
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == DEL and text[i + 1 : i + 2] == " ":
            i += 2
        elif c == CAP and i + 1 < n:
            out.append(text[i + 1].upper())
            i += 2
        elif c == WORD:
            j = i + 1
            while j < n and text[j].isalpha():
                j += 1
            out.append(text[i + 1 : j].upper())
            i = j
        else:
            out.append(c)
            i += 1
    return "".join(out)


def spaced_text(text: str) -> str:
    """Without the capital marks: 0x7F and a space before a word that no space precedes."""
    out, last = [], ""
    for c in text:
        if c.isalpha() and last and not last.isspace() and not last.isalpha():
            out.append("\x7f ")
        out.append(c)
        last = c
    return "".join(out)


def unspaced_text(text: str) -> str:
    return text.replace("\x7f ", "")


caps_encode, caps_decode, spaced_encode, spaced_decode = map(lift, (caps_text, uncaps_text, spaced_text, unspaced_text))


# --- origins ------------------------------------------------------------------


def with_origin(kernel: Kernel, text: str) -> tuple[str, list[int]]:
    """The normalised text and for each of its bytes the first byte of the source character it stems from.

    The kernel is taken to work character cluster by cluster; what it makes of
    each prefix tells how far the source has been used."""
    made, origin = _origins(Clusters(kernel), text)
    return made, origin.tolist()


class Clusters(dict):
    """What a kernel makes of a cluster, and the bytes of both; worked out once, for some clusters at a time."""

    def __init__(self, kernel: Kernel):
        super().__init__()
        self.kernel = kernel

    def __missing__(self, cluster: str) -> tuple[str, int, int]:
        if len(self) > 1 << 16:
            self.clear()
        made = self.kernel(cluster)
        own = self[cluster] = made, _size(made), _size(cluster)
        return own


def _origins(known: Clusters, text: str) -> tuple[str, np.ndarray]:
    if not text:
        return "", np.zeros(0, np.int32)
    clusters = text
    if not text.isascii() and any(map(unicodedata.combining, set(text))):
        cut = [i for i, c in enumerate(text) if i == 0 or not unicodedata.combining(c)]
        clusters = [text[i:j] for i, j in zip(cut, [*cut[1:], len(text)], strict=True)]
    made, sizes, used = zip(*[known[c] for c in clusters], strict=True)
    used = np.array(used)
    return "".join(made), np.repeat(np.cumsum(used) - used, sizes).astype(np.int32)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def origin_column(kernel: Kernel) -> Callable[[Column], Column]:
    """STRUCT<text, origin ARRAY<INT>> of a cluster-wise kernel; of a worker's batch some MB at a time."""

    @F.arrow_udf(T.StructType().add("text", T.StringType()).add("origin", T.ArrayType(T.IntegerType())))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Clusters(kernel)
        for whole in batches:
            for a in text_slices(whole) if len(whole) else [whole]:
                made, origins, ends = [], [np.zeros(0, np.int32)], [0]
                for t in a.to_pylist():
                    text, own = _origins(known, t) if t is not None else (None, origins[0])
                    made.append(text)
                    origins.append(own)
                    ends.append(ends[-1] + len(own))
                lost = np.array([t is None for t in made], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32), mask=np.append(lost, False)), pa.array(np.concatenate(origins)))
                yield pa.StructArray.from_arrays([pa.array(made, pa.string()), lists], ["text", "origin"])

    return run


def project_span(origin: list[int], start: int, end: int, source_bytes: int) -> tuple[int, int]:
    """The source bytes that a span of normalised bytes stems from."""
    if start >= end:
        at = origin[start] if start < len(origin) else source_bytes
        return at, at
    first = origin[start]
    after = next((x for x in origin[end:] if x > origin[end - 1]), source_bytes)
    return first, after


# --- machine code ---------------------------------------------------------------

#: Prefix bytes of instructions.
PREFIXES = {0x66, 0x67, 0xF0, 0xF2, 0xF3, 0x2E, 0x36, 0x3E, 0x26, 0x64, 0x65, *range(0x40, 0x50)}


def instruction(code: bytes, at: int) -> tuple[int, str, str]:
    """(length, opcode class, operand class) of the x86-64 instruction at a byte: a coarse classifier; what it doesn't know is one byte long."""
    i = at
    while i < len(code) and code[i] in PREFIXES and i - at < 4:
        i += 1
    if i >= len(code):
        return 1, "unknown", "none"
    op, size = code[i], i - at + 1

    def modrm(extra: int = 0) -> int:
        if i + 1 >= len(code):
            return 0
        m = code[i + 1]
        mod, rm = m >> 6, m & 7
        n = 1 + (mod != 3 and rm == 4) + (1 if mod == 1 else 4 if mod == 2 or mod == 0 and rm == 5 else 0)
        return n + extra

    if op == 0x90:
        return size, "nop", "none"
    if op in (0xC3, 0xC2, 0xCB):
        return size + 2 * (op == 0xC2), "return", "immediate" if op == 0xC2 else "none"
    if op in (0xE8, 0xE9):
        return size + 4, "call" if op == 0xE8 else "jump", "relative"
    if op == 0xEB:
        return size + 1, "jump", "relative"
    if 0x70 <= op <= 0x7F:
        return size + 1, "branch", "relative"
    if 0x50 <= op <= 0x5F:
        return size, "stack", "register"
    if 0xB8 <= op <= 0xBF:
        wide = any(0x48 <= b <= 0x4F for b in code[at:i])
        return size + (8 if wide else 4), "move", "immediate"
    if op in (0x88, 0x89, 0x8A, 0x8B, 0x8D):
        kind = "register" if i + 1 < len(code) and code[i + 1] >> 6 == 3 else "memory"
        return size + modrm(), "address" if op == 0x8D else "move", kind
    if op < 0x40 and op & 7 < 4:
        kind = "register" if i + 1 < len(code) and code[i + 1] >> 6 == 3 else "memory"
        return size + modrm(), "arithmetic", kind
    if op in (0x84, 0x85):
        return size + modrm(), "compare", "register"
    if op in (0x80, 0x83, 0xC6):
        return size + modrm(1), "arithmetic" if op != 0xC6 else "move", "immediate"
    if op in (0x81, 0xC7):
        return size + modrm(4), "arithmetic" if op == 0x81 else "move", "immediate"
    if op == 0xFF:
        return size + modrm(), "call", "memory"
    if op == 0x0F and i + 1 < len(code):
        if 0x80 <= code[i + 1] <= 0x8F:
            return size + 5, "branch", "relative"
        return size + 1, "extended", "none"
    return 1, "unknown", "none"


def routes(code: bytes) -> list[tuple[int, int, str, str]]:
    """(start, length, opcode class, operand class) of each instruction; the last is cut at the end."""
    out, at = [], 0
    while at < len(code):
        n, kind, operand = instruction(code, at)
        n = min(n, len(code) - at)
        out.append((at, n, kind, operand))
        at += n
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("length", T.IntegerType()).add("opcode", T.StringType()).add("operand", T.StringType())))
def route_column(s: pd.Series) -> pd.Series:
    names = ("start", "length", "opcode", "operand")
    return s.map(lambda b: [dict(zip(names, r, strict=True)) for r in routes(b)], na_action="ignore")
