"""Near-duplicate search by SimHash fingerprints and Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of 4 errors
two segments together take at most 2, and two such segments each share a
Golay key with their counterparts; so every link has a pair of segments with a
pair of keys in common. Fingerprints meet under these keys, links are
verified by their distance, and components follow from the links.

Only distinct fingerprints are searched, so copies are never paired. Within
the rows of one key a spanning forest of the verified links is kept rather
than all of them, which keeps every component. A key with more rows than RUN
is dealt anew as pairs of blocks, so no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import discard, documents, fresh, stored
from .components import components
from .windows import M, keyed_runs, mix

SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, bits)
#: Rows of a key that one task compares; beyond, blocks of BLOCK rows are compared in pairs.
RUN, BLOCK = 20_000, 10_000
#: Rows that the comparing task gathers before it looks at them.
GATHER = 200_000
#: Shingle sets of a candidate group that one task compares; beyond, blocks of so many are compared in pairs.
SETS = 2000
#: Bytes of the shingle sets of a block.
SET_BYTES = 16 << 20
#: Keys of a shingle set, of so many MinHash values each: sets alike to 0.8 share a key in 998 of 1,000 cases, wherever they differ.
BANDS, ROWS = 16, 5


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """(m, 8) bytes: XXH64, seed 42, big-endian, of each n-word shingle of the ASCII-lower-cased text; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= n:
        return np.frombuffer(digest(line, 42), np.uint8).reshape(1, 8)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - n + 1].tolist()
    ends = np.concatenate([gaps, [len(line)]])[n - 1 :].tolist()
    return np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> np.ndarray:
    """64 booleans: the bits that are set in over half the rows."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16384):
        total += np.unpackbits(hashes[i : i + 16384], axis=1).sum(0, dtype=np.int64)
    return total * 2 > len(hashes)


def fingerprint(text: str | None, n: int = 4) -> int:
    return int(np.packbits(majority(shingle_hashes(text, n))).view(">i8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number; 0 for a null or blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the keys of the fingerprints, each with the row it is for."""
    u = fps.astype(np.int64).view(np.uint64)
    parts = [golay.keys((u >> np.uint64(s)) & np.uint64((1 << b) - 1)) for s, b in SEGMENTS]
    keys, rows = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        both = np.where((a < 0) | (b < 0), -1, tag << 24 | a << 12 | b).reshape(len(fps), 36)
        r, c = np.nonzero(both >= 0)
        keys.append(both[r, c])
        rows.append(r)
    return np.concatenate(keys).astype(np.int32), np.concatenate(rows)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, *columns of nodes) for each key of the column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                key, row = golay_keys(part.column("fp").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(row)) for c in part.columns)], ["key", *part.schema.names])

    return nodes.mapInArrow(run, "key int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields))


def _near(a: np.ndarray, b: np.ndarray, limits: list[int]) -> np.ndarray:
    """a, b: (columns, n) fingerprints. Whether each differs in at most its limit of bits; a limit of None adds to the next column."""
    ok, carried = True, 0
    for x, y, limit in zip(a, b, limits, strict=True):
        bits = np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) + carried  # of a negative number, the sign would not count
        if limit is None:
            carried = bits
        else:
            ok, carried = ok & (bits <= limit), 0
    return ok


def forest(values: np.ndarray, limits: list, cross: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of a spanning forest of the links among n fingerprints, (columns, n)."""
    left = np.arange(values.shape[1])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            ok = _near(values[:, left], values[:, x : x + 1], limits)
            if ok.any():
                found = left[ok]
                yield np.full(len(found), x), found
                queue.extend(found.tolist())
                left = left[~ok]


def spanning(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray, limits: list, most: int | None, hot: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within limits among nodes of equal keys, (columns, n) and sorted, that connect what all of them do; keys with over most nodes are added to hot instead."""
    new = np.any(keys[:, 1:] != keys[:, :-1], axis=0)
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    sizes = np.diff(np.concatenate([starts, [keys.shape[1]]]))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= 8
    a, b = [], []
    for d in range(1, 8):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[run[d:]])
        i = i[_near(values[:, i], values[:, i + d], limits)]
        a.append(nodes[i])
        b.append(nodes[i + d])
    for r in np.flatnonzero(~small):
        at = slice(starts[r], starts[r] + sizes[r])
        if most and sizes[r] > most:
            hot.append(int(keys[0, starts[r]]))
            continue
        for i, j in forest(values[:, at], limits):
            a.append(nodes[at][i])
            b.append(nodes[at][j])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def linked(rows: DataFrame, by: list[str], node: str, columns: list[str], limits: list, most: int | None = RUN) -> DataFrame:
    """Links (a, b) between nodes under the same key (columns by), verified and thinned to a spanning forest for each key; for a key with over most rows a row (key, key) with hot = true instead."""
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        over: int | None = None  # a key that is past the limit: its rows are passed over

        def out(table: list[np.ndarray]) -> pa.RecordBatch:
            hot: list[int] = []
            a, b = spanning(np.stack(table[:width]), table[width], np.stack(table[width + 1 :]), limits, most, hot)
            both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            h = np.asarray(hot, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[:, 0], h])), pa.array(np.concatenate([both[:, 1], h])), pa.array(np.arange(len(both) + len(h)) >= len(both))], ["a", "b", "hot"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if over is not None:
                stay = now[0] != over
                if not stay.any():
                    continue
                now, over = [x[stay] for x in now], None
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if len(rest[0]) < GATHER:
                continue
            last = np.any([x != x[-1] for x in rest[:width]], axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield out([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
            if most and len(rest[0]) > most:
                over = int(rest[0][0])
                yield pa.RecordBatch.from_arrays([pa.array([over]), pa.array([over]), pa.array([True])], ["a", "b", "hot"])
                rest = None
        if rest is not None and len(rest[0]):
            yield out(rest)

    dealt = rows.select(*by, node, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns))).repartition(*by).sortWithinPartitions(*by, node)
    return dealt.mapInArrow(run, "a long, b long, hot boolean")


def golay_links(nodes: DataFrame, node: str, columns: list[str], limits: list) -> DataFrame:
    """Links (a, b) that join the same nodes as all links between nodes: at most limits bits between their columns. columns[0] is fp, and its limit 4 is what the keys promise to find."""
    found = stored(linked(keyed(nodes), ["key"], node, columns, limits), "golay")
    hot = found.filter("hot").select(F.col("a").cast("int").alias("key"))
    links = found.filter("not hot").select("a", "b")
    n_hot = hot.count()
    if n_hot:  # pairs of blocks: a row in block i meets the blocks j >= i; each key with over RUN rows is counted once, so the list is small
        rows = stored(keyed(nodes).join(F.broadcast(hot), "key"), "hot")
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(F.broadcast(sizes), "key").withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        links = links.unionByName(linked(rows, ["key", "lo", "hi"], node, columns, limits, None).select("a", "b"))
    return links


def simhash_components(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 4 bits or fewer. component_id is the smallest id
    that can be reached over links, its own included. Null and blank texts have
    fingerprint zero and link like any other; rows that repeat count once each.
    A null id has a row but is never the smallest. An empty table gives no rows.
    """
    fps = stored(fingerprints(df, shingle, id_col, text_col), "fps")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    links = stored(golay_links(classes.select("fp"), "fp", ["fp"], [4]).distinct(), "near")
    roots = components(links)
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select(F.col("fp").alias("k"), "component_id", "n")
    return dealt_join(fps, "fp", named, "k", "n").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dealt_join(rows: DataFrame, key: str, by: DataFrame, by_key: str, count: str) -> DataFrame:
    """rows joined with by, which has each key once with the count of its rows. Keys with over a thousandth of all rows, of which there are at most a thousand, are dealt out under salts."""
    by = stored(by, "by")
    total = by.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    salts = F.ceil(F.col(count) * 1000 / F.lit(max(total, 1))).cast("int")
    hot = F.broadcast(by.filter(F.col(count) * 1000 > total).select(F.col(by_key).alias("_hot"), salts.alias("_salts")))
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_hot", "_salts")
    right = by.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count)
    return left.join(right, (F.col(key) == F.col(by_key)) & (F.col("_salt") == F.col("_salt2"))).drop("_salt", "_salt2", by_key)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, lower case; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_digest
    made = b"".join([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))])
    return np.unique(np.frombuffer(made, ">u8").astype(np.uint64))


def band_keys(own: np.ndarray) -> bytes:
    """The keys (int32) of a set of hashes, of BANDS runs of ROWS MinHash values; none of an empty set."""
    if not len(own):
        return b""
    with np.errstate(over="ignore"):
        least = np.array([mix(own + np.uint64(k) * M).min() for k in range(1, BANDS * ROWS + 1)], np.uint64).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key * M + least[:, k])
    return (key >> np.uint64(32)).astype(np.uint32).tobytes()


def banded(nodes: DataFrame) -> DataFrame:
    """(key, node) for each key of the column bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_pylist()
            key = np.frombuffer(b"".join(own), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 4 for x in own]))], ["key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key int, node long")


def band_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes with a key of bands in common: each to the least of its key."""
    rows = banded(nodes)
    least = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    return dealt_join(rows, "key", least, "k", "n").filter("a <> node").select("a", F.col("node").alias("b"))


def pair_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp, v0, v1, w, bands): a 64-bit fingerprint of a text's word pairs, to search by, 128 bits of its set of word shingles, to look closer, a hash of its words, and the keys of the set."""

    def wide(text: str | None) -> list:
        own = shingle_set(text, shingle)
        if not len(own):
            return [0, 0, 0, b""]
        with np.errstate(over="ignore"):
            halves = (mix(own), mix(own + M))
        words = xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
        return [*(int(np.packbits(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8))).view(">i8")[0]) for h in halves), words - (1 << 63), band_keys(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            v = [wide(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, 2) for t in texts], pa.int64()), *(pa.array([x[k] for x in v], pa.int64()) for k in (0, 1, 2)), pa.array([x[3] for x in v], pa.binary())], ["id", "fp", "v0", "v1", "w", "bands"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long, v0 long, v1 long, w long, bands binary")


def jaccard_links(members: DataFrame, by: list[str], limits: list, least: float) -> DataFrame:
    """Links (a, b) among members (node, fp, v0, v1, own) with equal by that keep every connected group of the pairs within limits whose sets own are alike to least or more."""
    width = len(by)

    def forest_of(node: np.ndarray, values: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) for x in own])
        left = np.arange(len(node))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                ok = _near(values[:, left], values[:, x : x + 1], limits)
                ok &= np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x])
                near = np.flatnonzero(ok)
                hits = []
                for lo in range(0, len(near), 500):  # some sets at a time
                    part = near[lo : lo + 500]
                    sets = [own[i] for i in left[part]]
                    ends = np.cumsum(size[left[part]])
                    same = np.concatenate([[0], np.cumsum(np.isin(np.concatenate(sets), own[x], assume_unique=False))])
                    both = same[ends] - same[ends - size[left[part]]]
                    hits.append(part[(both >= least * (size[left[part]] + size[x] - both) - 1e-9)])
                hit = np.concatenate(hits) if hits else near
                if len(hit):
                    found = left[hit]
                    yield from ((int(node[x]), int(node[y])) for y in found)
                    queue.extend(found.tolist())
                    left = np.delete(left, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in keyed_runs(batches, 2000):
            keys = np.stack([c.astype(np.int64) for c in cols[:width]])
            node, values, own = cols[width], np.stack(cols[width + 1 : width + 4]), [np.frombuffer(x, np.uint64) for x in cols[width + 4]]
            new = np.flatnonzero(np.concatenate([[True], np.any(keys[:, 1:] != keys[:, :-1], axis=0)]))
            links = [x for i, j in zip(new, np.append(new[1:], len(node)), strict=True) for x in forest_of(node[i:j], values[:, i:j], own[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return members.select(*by, "node", "fp", "v0", "v1", "own").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def with_sets(df: DataFrame, members: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """members (node, w, ...) with own, the shingle set of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                own = pa.array([shingle_set(t, shingle).tobytes() for t in part.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], own], [*part.schema.names[1:], "own"])

    kept = [c for c in members.columns if c != "w"]
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id IS NOT NULL")
    rows = texts.join(members, F.col("id") == F.col("node")).select("t", *kept)
    return rows.mapInArrow(run, ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in kept) + ", own binary").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, search_bits: int = 10, verify_bits: int = 28) -> DataFrame:
    """(id, keep_id) for each distinct id of df whose group has others: keep_id is the smallest id of the group.

    Texts link if their sets of five-word shingles have a Jaccard similarity of
    0.8 or more, which is computed exactly. Candidates share a MinHash key of
    their sets, or are found by the Golay keys of a fingerprint of word pairs
    (search_bits) and 128 bits of the shingles (verify_bits). Their groups are
    then compared set by set, whatever their fingerprints. Rows with null ids are left out; ids must be
    integers, or text that Spark casts to such. Texts without words are copies of one another; of rows that share an id one text is compared.
    """
    fps = stored(pair_fingerprints(df.filter(F.col(id_col).isNotNull()), id_col, text_col, shingle), "fps")
    columns, limits = ["fp", "v0", "v1"], [search_bits, None, verify_bits]
    classes = stored(fps.groupBy(*columns, "w").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.min("bands").alias("bands")), "classes")
    near = golay_links(classes.drop("bands"), "node", columns, limits).unionByName(band_links(classes))
    classes, limits = classes.drop("bands"), [64, None, 128]
    found = components(stored(near.distinct(), "near"))
    groups = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "groups")
    members = stored(with_sets(df, classes.drop("n").join(groups, "node"), shingle, id_col, text_col), "sets")
    blocks = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum(F.octet_length("own")) / SET_BYTES)).cast("int")
    big = stored(members.groupBy("root").agg(blocks.alias("blocks")).filter("blocks > 1"), "big")
    links = jaccard_links(members.join(big, "root", "left_anti"), ["root"], limits, similarity)
    if not big.isEmpty():  # blocks of a group in pairs, so that a task holds two at most
        rows = members.join(big, "root").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("at", "other"), "hi": F.greatest("at", "other")})
        links = links.unionByName(jaccard_links(rows, ["root", "lo", "hi"], limits, similarity))
    links = stored(links.distinct(), "alike")
    discard(members)
    roots = components(links).withColumnRenamed("root", "top")
    tops = roots.select(F.col("top").alias("node"), "top").distinct()
    named = classes.join(roots.unionByName(tops), "node", "left").withColumn("keep_id", F.coalesce("top", "node"))
    named = named.filter((F.col("n") > 1) | F.col("top").isNotNull()).select(F.xxhash64(*columns, "w").alias("k"), "keep_id", "n", *(F.col(c).alias(f"{c}2") for c in (*columns, "w")))
    out = dealt_join(fps.drop("bands").withColumn("key", F.xxhash64(*columns, "w")), "key", named, "k", "n").filter("fp = fp2 AND v0 = v02 AND v1 = v12 AND w = w2")
    return out.select(F.col("id").alias(id_col), "keep_id")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df without the rows whose id isn't the one that stays of its group; repeated ids stay together."""
    (name,) = fresh(df.columns, "_gone")
    gone = stored(near_duplicates(df, id_col, **options).filter(F.col(id_col) != F.col("keep_id")).select(F.col(id_col).alias(name)).distinct(), "gone")
    return df.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
