"""Corpus analytics over tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def lines(text: Column) -> Column:
    """Lines of a text; a last one without a newline counts."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (n + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\t-\r ]+")).cast("long")


def scan(docs: DataFrame, *more: Column) -> DataFrame:
    t = F.col("text")
    return docs.agg(*more, F.sum(F.octet_length(t)).alias("bytes"), F.sum(F.char_length(t)).alias("chars"), F.sum(lines(t)).alias("lines"), F.sum(words(t)).alias("words"))


def top(counts: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    return counts.orderBy(F.col("n") if ascending else F.col("n").desc(), "id").limit(k)


def kv_bytes(tokens: Column, heads: int, layers: int, width: int, size: int) -> Column:
    return (tokens * F.lit(2 * heads * layers * width * size)).cast("long")


def cost(tokens: Column, price: float, unit: int = 1_000_000) -> Column:
    return tokens / F.lit(float(unit)) * F.lit(price)


#: Where each range of code points ends (exclusive) and its name.
SCRIPTS = [
    (0x0080, "Latin (ASCII)"),
    (0x0100, "Latin (extended)"),
    (0x0400, "Latin/Greek/Coptic/Cyrillic"),
    (0x0500, "Cyrillic"),
    (0x0600, "Armenian/Hebrew"),
    (0x0700, "Arabic"),
    (0x0900, "Other"),
    (0x0A00, "Devanagari/Bengali"),
    (0x1000, "Indic"),
    (0x2000, "Other"),
    (0x2E80, "Symbols/Punctuation"),
    (0x3000, "CJK Radicals"),
    (0x3040, "CJK Symbols"),
    (0x30A0, "Hiragana"),
    (0x3100, "Katakana"),
    (0x4E00, "Bopomofo/Other"),
    (0xA000, "CJK Unified Ideographs"),
    (0xAC00, "Yi/Other"),
    (0xD800, "Hangul"),
    (0xE000, "Surrogates"),
    (0xF900, "Private Use"),
    (0x110000, "Other"),
]


def script(code: Column) -> Column:
    """Script of a code point, by ranges."""
    out = F.when(code < SCRIPTS[0][0], SCRIPTS[0][1])
    for end, name in SCRIPTS[1:-1]:
        out = out.when(code < end, name)
    return out.otherwise(SCRIPTS[-1][1])


def _run_pattern() -> str:
    """A run: its first character, whatever it is, then letters of that character's script and characters that aren't letters."""
    ranges: dict[str, str] = {}
    first = 0
    for end, name in SCRIPTS:
        if name != "Surrogates":
            ranges[name] = ranges.get(name, "") + rf"\x{{{first:X}}}-\x{{{end - 1:X}}}"
        first = end
    return "|".join(rf"[{r}](?:[{r}&&\p{{L}}]|\P{{L}})*+" for r in ranges.values())


def script_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run, script, chars, bytes): a run has the script of its first character and ends before a letter of another script; what isn't a letter belongs to the run it stands in. One pattern finds the runs of a text."""
    runs = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_run_pattern()), F.lit(0))).alias("run", "t"))
    return runs.select("doc_id", F.col("run").cast("long").alias("run"), script(F.ascii("t")).alias("script"), F.char_length("t").cast("long").alias("chars"), F.octet_length("t").cast("long").alias("bytes"))


def fairness(rows: DataFrame) -> DataFrame:
    """Summary of (group, tokens, units): rows without units are left out. premium is against the best, gini over fertilities."""
    f = rows.filter("units > 0").withColumn("fertility", F.col("tokens") / F.col("units"))
    s = f.agg(F.count("*").alias("n"), F.avg("fertility").alias("mean"), F.min("fertility").alias("best"), F.max("fertility").alias("worst"), F.sort_array(F.collect_list("fertility")).alias("x"))
    # sum of |xi - xj| over all pairs, from the ranks of the sorted values: groups are few, their pairs needn't be made
    spread = F.aggregate(F.transform("x", lambda v, i: v * (2 * i - F.col("n") + 1)), F.lit(0.0), lambda a, v: a + v)
    return s.select("n", "mean", "best", "worst", (F.col("worst") / F.col("best")).alias("max_premium"), F.when(F.col("mean") > 0, 2 * spread / (2 * F.col("n") * F.col("n") * F.col("mean"))).otherwise(0.0).alias("gini"))


def buckets(distance: Column) -> Column:
    return F.when(distance == 0, "exact").when(distance <= 3, "1-3").when(distance <= 10, "4-10").otherwise(">10")


def bounded_levenshtein(a: Column, b: Column, cap: int) -> Column:
    """Edit distance of two id arrays (ids under 1,112,063) if it is at most cap, else cap + 1. Ids become code points, past the surrogates from 0xD7FF on."""
    point = lambda i: F.when(i < 0xD7FF, i + 1).otherwise(i + 0x801)
    chars = lambda ids: F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(point(i)), 8, "0")), "UTF-32")), "")
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    d = F.levenshtein(chars(a), chars(b), cap)
    return F.when(empty, F.least(F.greatest(F.size(a), F.size(b)), F.lit(cap + 1))).otherwise(F.when(d < 0, cap + 1).otherwise(d)).cast("int")


#: Ids whose hashes a worker makes together.
HASHED = 1 << 17


def ngram_hashes(ids: Column, n: int, heads: int):
    """ARRAY<LONG> of (size - n + 1) * heads hashes, position by position: a splitmix fold of the ids from a head's salt, with the length folded in last. 64-bit wrap-around is done by numpy."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def mix(x: np.ndarray) -> np.ndarray:
        x = x + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def hashes(x: np.ndarray) -> np.ndarray:
        m = len(x) - n + 1
        if n <= 0 or heads <= 0 or m <= 0:
            return np.zeros(0, np.int64)
        salts = mix(step ^ np.arange(heads, dtype=np.uint64) * step)
        h = (salts ^ step)[None, :] + np.zeros((m, 1), np.uint64)
        for j in range(n):
            h = mix(h ^ x[j : j + m, None])
        return mix(h ^ np.uint64(n)).reshape(-1).view(np.int64)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            if not len(whole):
                yield pa.array([], pa.list_(pa.int64()))
            sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            before, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
            while lo < len(whole):  # some ids at a time: each becomes a hash for each head
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + HASHED, side="right")) - 1)
                own = whole.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                ends = before[lo : hi + 1] - before[lo]
                with np.errstate(over="ignore"):
                    made = [hashes(own[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                places = np.cumsum([0, *map(len, made)], dtype=np.int64).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(made)))
                lo = hi

    return run(ids)


def split_of(seed: int, text: Column, fraction: float) -> Column:
    """validation or train, by the first 8 bytes of SHA-256 over seed (little-endian) and text."""
    digest = F.sha2(F.concat(F.lit(seed.to_bytes(8, "little")), F.encode(text, "UTF-8")), 256)
    little = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.when(F.conv(little, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64) < fraction, "validation").otherwise("train")
