"""Sampling of fixed-length windows by their minimizers.

A document is a sequence of units (words or bytes) with 64-bit hashes. Each
window of the document has an anchor: the gram inside it with the smallest
hash, the leftmost of equal ones. The choice depends on the window alone, so
equal windows have equal anchors at equal offsets, wherever they stand.
Consecutive windows with one anchor form a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each run of length units, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, power, size, rest = 0, None, M, 1, length
    block = h
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = block[done : done + n] if out is not None else block[:n]
                out = part.copy() if out is None else out * power + part
                done += size
            rest >>= 1
            if rest:
                block = block[: len(block) - size] * power + block[size:]
                power, size = power * power, size * 2
        return mix(out)


def anchors(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For gram hashes g and windows of span grams: position of the anchor, first window and number of windows of each segment."""
    n = len(g) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at, size = np.arange(len(g), dtype=np.int32), 1
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at = np.where(g[b] < g[a], b, a)
        size *= 2
    if size < span:
        a, b = at[:n], at[span - size : span - size + n]
        at = np.where(g[b] < g[a], b, a)
    at = at[:n]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first].astype(np.int64), first, np.diff(np.concatenate([first, [n]]))


def segment_hashes(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    """Hash of each segment's units, their number, and the anchor's offset: equal segments hold equal windows at equal offsets."""
    if not len(first):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        scaled = h * np.cumprod(np.full(len(h), M, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled, dtype=np.uint64)])
        inverse = np.uint64(pow(int(M), -1, 1 << 64))
        back = np.cumprod(np.full(len(h), inverse, np.uint64))
        end = first + count + window - 1
        x = (sums[end] - sums[first]) * back[first]
        return mix(mix(x) + count.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + (at - first).astype(np.uint64) * np.uint64(0xAF251AF3B0F025B5))


# --- tables of segments -----------------------------------------------------
# A segment's row: k (where it is dealt), s (hash of the segment), doc and th (the document), a (first window), n (windows), st:
NORMAL, RESOLVED, NEEDS, MARK = 0, 1, 2, 3
#: Segments of an anchor that a task deals out normally; the anchor's further ones are hot. In unordered mode what is hot costs a row for each window.
HOT_ANCHOR, HOT_UNORDERED = 64, 1000
ROWS = 400_000
#: Bytes of rows that a task gathers at a time.
PIECE = 64 << 20
#: Windows of a text that are looked at together; a segment that is cut there is compared window by window.
TOGETHER = 1 << 19


def both(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A hash that, together with s, tells g too."""
    return mix(s + g * M)


class Thinner:
    """Map-side thinning of segment rows, in bounded memory.

    A segment that this task has met before (in ordered mode: in a document
    with a smaller id) is known to repeat, so its row is marked RESOLVED and
    dealt out at random. Segments of an anchor that this task has met more
    than HOT_ANCHOR (unordered: HOT_UNORDERED) times are marked NEEDS and dealt out at random; one MARK
    row tells the anchor's own task that there are more. So no anchor or
    segment, however frequent, sends more than a few rows from a task to one place.
    Segments count as equal if the hashes of their anchor and of the whole agree, 128 bits.

    In ordered mode a RESOLVED row holds the document it repeats in s, and the
    first window there in the lower half of k; a NEEDS row holds its anchor in s.
    """

    def __init__(self, ordered: bool, most: int | None = None, slots: int = 1 << 20):
        self.ordered, self.mask, self.most = ordered, np.uint64(slots - 1), most or (HOT_ANCHOR if ordered else HOT_UNORDERED)
        self.seen_s, self.seen_of, self.seen_doc, self.told = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, bool)
        self.seen_a = np.zeros(slots, np.int64)
        self.seen_g, self.count_g = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)

    def __call__(self, g: np.ndarray, s: np.ndarray, doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(k, s, st) of each row, and (k, s) of further MARK rows."""
        n = len(g)
        slot = (s & self.mask).astype(np.int64)
        order = np.lexsort((doc, g, s))
        so, go, do = s[order], g[order], doc[order]
        new = np.concatenate([[True], (so[1:] != so[:-1]) | (go[1:] != go[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        known = (self.seen_s[slot[order]] == so) & (self.seen_of[slot[order]] == go)
        least = do[first]
        if self.ordered:
            hit = (do > least) | (known & (self.seen_doc[slot[order]] < do))
        else:
            hit = ~new | known
        st = np.full(n, NORMAL, np.int8)
        st[order[hit]] = RESOLVED
        marks_k, marks_s = [], []
        if not self.ordered:  # the row that was dealt out normally must learn that it isn't alone
            again = np.flatnonzero(hit)
            again = again[np.unique(first[again], return_index=True)[1]] if len(again) else again
            fresh = again[~(known[again] & self.told[slot[order[again]]])]
            marks_k += [go[fresh], both(go[fresh], so[fresh])]
            marks_s += [so[fresh], so[fresh]]
        if self.ordered:  # where each row that repeats is repeated from
            at = np.flatnonzero(hit)
            stored = known[at] & (self.seen_doc[slot[order[at]]] < do[at]) & ~(least[at] < do[at])
            from_doc = np.where(stored, self.seen_doc[slot[order[at]]], least[at])
            from_a = np.where(stored, self.seen_a[slot[order[at]]], a[order[first[at]]])
        heads = np.flatnonzero(new)
        put = heads[~known[heads] | (self.seen_doc[slot[order[heads]]] > do[heads])] if self.ordered else heads[~known[heads]]
        self.seen_s[slot[order[put]]] = so[put]
        self.seen_of[slot[order[put]]] = go[put]
        self.seen_doc[slot[order[put]]] = do[put]
        self.seen_a[slot[order[put]]] = a[order[put]]
        self.told[slot[order[put]]] = False
        if not self.ordered and len(again):
            mine = (self.seen_s[slot[order[again]]] == so[again]) & (self.seen_of[slot[order[again]]] == go[again])
            self.told[slot[order[again[mine]]]] = True

        normal = np.flatnonzero(st == NORMAL)
        if len(normal):
            gn = g[normal]
            by = np.argsort(gn, kind="stable")
            ga = gn[by]
            new = np.concatenate([[True], ga[1:] != ga[:-1]])
            start = np.flatnonzero(new)
            rank = np.arange(len(ga)) - start[np.cumsum(new) - 1]
            sizes = np.diff(np.concatenate([start, [len(ga)]]))
            gslot = (ga & self.mask).astype(np.int64)
            before = np.where(self.seen_g[gslot] == ga, self.count_g[gslot], 0)
            rank = rank + before
            hot = rank >= self.most
            st[normal[by[hot]]] = NEEDS
            told = np.flatnonzero(rank == self.most)
            marks_k.append(ga[told])
            marks_s.append(np.zeros(len(told), np.uint64))
            self.seen_g[gslot[start]] = ga[start]
            self.count_g[gslot[start]] = before[start] + sizes
        spread = mix(s ^ (doc.astype(np.uint64) << np.uint64(17)) ^ np.arange(n).astype(np.uint64))
        if self.ordered:
            k = np.where(st == NORMAL, g, spread)
            s = np.where(st == NEEDS, g, s)
            at = order[at]
            s[at] = from_doc.view(np.uint64)
            k[at] = k[at] & ~np.uint64(0xFFFFFFFF) | from_a.astype(np.uint64)
        else:
            k = np.where(st == NORMAL, g, np.where(st == NEEDS, both(g, s), spread))
        return k, s, st, np.concatenate(marks_k) if marks_k else np.zeros(0, np.uint64), np.concatenate(marks_s) if marks_s else np.zeros(0, np.uint64)


def segment_rows(docs: DataFrame, split, hashes, gram: int, window: int, ordered: bool, hot: int | None = None) -> DataFrame:
    """Rows of all segments of docs (doc, th, t). split(bytes) gives the units of a document, hashes(units) their hashes, a piece of TOGETHER windows at a time; hot is another bound than HOT_ANCHOR."""
    together = TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin, held, size = Thinner(ordered, hot), [], 0

        def out() -> pa.RecordBatch:
            g, s, doc, th, a, n = (np.concatenate(x) for x in zip(*held, strict=True))
            k, s, st, mk, ms = thin(g, s, doc, a)
            m = len(mk)
            cols = [np.concatenate(x) for x in ((k, mk), (s, ms), (doc, np.full(m, -1, np.int64)), (th, np.zeros(m, np.int64)), (a, np.zeros(m, np.int64)), (n, np.zeros(m, np.int64)), (st, np.full(m, MARK, np.int8)))]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols[:4]] + [pa.array(cols[4].astype(np.int32)), pa.array(cols[5].astype(np.int32)), pa.array(cols[6])], ["k", "s", "doc", "th", "a", "n", "st"])

        for b in batches:
            for doc, th, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                units = split(t.encode("utf-8", "surrogatepass"))
                for lo in range(0, len(units) - window + 1, together):
                    h = hashes(units[lo : lo + together + window - 1])
                    g = run_hashes(h, gram)
                    at, first, count = anchors(g, window - gram + 1)
                    held.append((g[at], segment_hashes(h, first, count, window, at), np.full(len(at), doc), np.full(len(at), th), first + lo, count))
                    size += len(at)
                    if size >= ROWS:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "k long, s long, doc long, th long, a int, n int, st byte")


def keyed_runs(batches: Iterator[pa.RecordBatch], rows: int = ROWS, key: int = 0) -> Iterator[list[np.ndarray]]:
    """Columns of a sorted partition in pieces of some rows, or some MB, that don't cut through a key."""
    held, size, weight = [], 0, 0
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        size += len(cols[0])
        weight += b.nbytes
        if size < rows and weight < PIECE:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[key], cols[key][-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held, size, weight = [[c[cut:] for c in cols]], len(cols[0]) - cut, weight if not cut else 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def resolved(rows: DataFrame, ordered: bool) -> DataFrame:
    """(doc, th, a, n, st, s, k) of the segments that matter: RESOLVED ones, whose windows all repeat (in ordered mode: in the document s with a smaller id, from its window k on), and NEEDS ones, whose anchor k occurs in unequal segments so that their windows must be compared one by one.

    In unordered mode a segment that repeats is also kept once as a reference for the others of its anchor, with st MARK; where the anchor is hot, st is NEEDS + 8 or MARK + 8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s, doc, th, a, n, st in keyed_runs(batches):
            ready = (st == RESOLVED) | (st == NEEDS) & ordered  # unordered, hot rows are dealt by their segment and compared with their like first
            newk = np.concatenate([[True], k[1:] != k[:-1]])
            kid = np.cumsum(newk) - 1
            hot_mark = (st == MARK) & (s == 0)
            hot = np.bincount(kid, weights=hot_mark | (st == NEEDS) & ~ready)[kid] > 0
            body = ~ready & ~hot_mark
            news = np.zeros(len(k), bool)
            at = np.flatnonzero(body)
            news[at] = np.concatenate([[True], (s[at][1:] != s[at][:-1]) | (kid[at][1:] != kid[at][:-1])]) if len(at) else []
            sid = np.cumsum(news)
            kinds = np.bincount(kid, weights=news)[kid]
            multi = (kinds > 1) | hot
            new = st.copy()
            if ordered:
                first = np.zeros(len(k), np.int64)
                first[at] = doc[np.flatnonzero(news)][sid[at] - 1] if len(at) else []
                again = body & (doc > first)
                new[again] = RESOLVED
                new[body & ~again] = np.where(multi, NEEDS, -1)[body & ~again]
                first_a = np.zeros(len(k), np.int64)
                first_a[at] = a[np.flatnonzero(news)][sid[at] - 1] if len(at) else []
                k = np.where(again, first_a, np.where(st == RESOLVED, k & 0xFFFFFFFF, np.where(st == NEEDS, s, k)))
                s = np.where(again, first, s)
            else:
                rows_of = np.bincount(sid, weights=body)[sid]
                again = body & (rows_of > 1)
                new[again] = RESOLVED
                new[body & ~again] = np.where(multi, NEEDS + 8 * hot, -1)[body & ~again]
                new[body & (st == MARK)] = -1
                # the first real row of each segment that repeats stands for it among the other segments of its anchor
                real = np.flatnonzero(again & (st != MARK) & multi)
                real = real[np.unique(sid[real], return_index=True)[1]] if len(real) else real
                extra = [x[real] for x in (doc, th, a, n)] + [(MARK + 8 * hot[real]).astype(np.int8), s[real], k[real]]
            keep = new >= 0
            keep &= ~hot_mark
            out = [x[keep] for x in (doc, th, a, n, new, s, k)]
            if not ordered:
                out = [np.concatenate(x) for x in zip(out, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "th", "a", "n", "st", "s", "k"])

    dealt = rows.repartition("k").sortWithinPartitions("k", "s", "doc", "st")
    return dealt.mapInArrow(run, "doc long, th long, a int, n int, st byte, s long, k long")


def read_lists(column: pa.ListArray) -> Iterator[list[np.ndarray] | None]:
    """For each row of a column of lists of structs the arrays of their fields; None for a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fields = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()]
    ends = column.offsets.to_pylist()
    for i, there in enumerate(column.is_valid().to_pylist()):
        yield [f[ends[i] : ends[i + 1]] for f in fields] if there else None


def united(first: np.ndarray, count: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of units that the windows of some runs cover."""
    order = np.argsort(first, kind="stable")
    first = first[order].astype(np.int64)
    end = np.maximum.accumulate(first + count[order] + window - 1)
    new = np.flatnonzero(first[1:] > end[:-1]) + 1
    return first[np.concatenate([[0], new])].tolist(), end[np.append(new - 1, len(end) - 1)].tolist()


def keyed_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, t) with null ids last and null texts empty; th tells apart rows that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.crc32(text.cast("binary")).alias("th"), text.alias("t"))
