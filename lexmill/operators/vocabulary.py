"""Vocabulary algebra: tables of (id, hex, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored


def splits(v: DataFrame) -> DataFrame:
    """(id, k, left_id, right_id): ways to cut a token into two tokens with lower ids."""
    s = v.filter("length > 1").select("id", "hex", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    s = s.select("id", "k", F.expr("left(hex, 2 * k)").alias("l"), F.expr("substring(hex, 2 * k + 1)").alias("r"))
    a, b = v.select(F.col("hex").alias("l"), F.col("id").alias("left_id")), v.select(F.col("hex").alias("r"), F.col("id").alias("right_id"))
    return s.join(a, "l").join(b, "r").filter("left_id < id AND right_id < id").select("id", "k", "left_id", "right_id")


def merged(a: DataFrame, b: DataFrame, prefix_hex: str = "") -> tuple[DataFrame, DataFrame]:
    """The merged vocabulary, in which a keeps its ids and what b has alone follows in b's order; and the map of b's ids."""
    b = b.select(F.col("id").alias("b_id"), F.concat(F.lit(prefix_hex), "hex").alias("hex"))
    base = a.agg(F.max("id").alias("m")).first().m
    both = b.join(a.select("hex", F.col("id").alias("a_id")), "hex", "left")
    # new ids by two-level ranks would serve a large table; a vocabulary is one task's work
    fresh = both.filter("a_id IS NULL").withColumn("merged_id", F.lit(base) + F.row_number().over(W.orderBy("b_id"))).select("b_id", "hex", F.col("merged_id").cast("long").alias("merged_id"))
    ids = both.filter("a_id IS NOT NULL").select("b_id", "hex", F.col("a_id").alias("merged_id")).unionByName(fresh)
    vocab = a.select("id", "hex").unionByName(fresh.select(F.col("merged_id").alias("id"), "hex"))
    return vocab, ids


def pruned(v: DataFrame, counts: DataFrame, min_count: int, keep_bytes: bool = True, rounds: int = 64) -> DataFrame:
    """(id, new_id) of what stays: tokens under min_count go, and then, until nothing changes, tokens that no two staying tokens make. Bytes stay."""
    usage = v.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    alive = stored(usage.filter((F.col("n") >= min_count) | (F.lit(keep_bytes) & (F.col("length") == 1))).select("id", "length"), "alive")
    ways = stored(splits(v), "splits")
    size = alive.count()
    for _ in range(rounds):
        a, b = alive.select(F.col("id").alias("left_id")), alive.select(F.col("id").alias("right_id"))
        made = ways.join(a, "left_id", "left_semi").join(b, "right_id", "left_semi").select("id").distinct()
        alive = stored(alive.filter("length = 1").unionByName(alive.filter("length > 1").join(made, "id", "left_semi")), "alive")
        n = alive.count()
        if n == size:
            break
        size = n
    return alive.select("id", (F.row_number().over(W.orderBy("id")) - 1).cast("long").alias("new_id"))


def doctor(v: DataFrame, special: list[str] = ()) -> DataFrame:
    """(severity, check, id): bytes that no token covers, merges that can't be reached, duplicates, empty tokens, tokens that end or begin in a space run, special tokens that hide a token."""
    spark = v.sparkSession
    bytes_ = spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("hex"), F.col("id").alias("byte"))
    issue = lambda df, level, name: df.select(F.lit(level).alias("severity"), F.lit(name).alias("check"), F.col("id").cast("long").alias("id"))
    missing = issue(bytes_.join(v, "hex", "left_anti").select(F.col("byte").alias("id")), "error", "byte_coverage")
    unreachable = issue(v.filter("length > 1").join(splits(v).select("id").distinct(), "id", "left_anti"), "warning", "unreachable_merge")
    twice = v.groupBy("hex").agg(F.count("*").alias("c"), F.max("id").alias("id")).filter("c > 1")
    empty = issue(v.filter("length = 0"), "error", "empty_token")
    spaces = issue(v.filter(F.col("hex").rlike("^(20){2,}$")), "info", "whitespace_run")
    named = spark.createDataFrame([(s.encode().hex().upper(),) for s in special] or [("-",)], "hex string")
    shadow = issue(v.join(named, "hex", "left_semi"), "warning", "special_shadowing")
    return missing.unionByName(unreachable).unionByName(issue(twice, "error", "duplicate")).unionByName(empty).unionByName(spaces).unionByName(shadow)


#: Scores of log probabilities beyond it are out of range.
SANE = 1000.0


def doctor_scores(v: DataFrame) -> DataFrame:
    """(severity, check, id) of a unigram vocabulary (id, hex, length, score): scores that are no numbers, infinite or out of range, and bytes that neither a token of their own nor a <0x..> token covers (their number)."""
    bad = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), "error").when(F.abs("score") > SANE, "warning")
    scores = v.withColumn("severity", bad).filter("severity IS NOT NULL").select("severity", F.lit("score_sanity").alias("check"), F.col("id").cast("long").alias("id"))
    named = F.upper(F.decode(F.unhex(F.regexp_extract("hex", "^3C3078((?:3[0-9]|[46][1-6]){2})3E$", 1)), "UTF-8"))
    reached = v.select(F.when(F.col("length") == 1, F.col("hex")).otherwise(named).alias("hex")).filter("hex <> ''").distinct()
    missing = v.sparkSession.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("hex")).join(reached, "hex", "left_anti")
    cover = missing.agg(F.count("*").alias("id")).filter("id > 0").select(F.lit("info").alias("severity"), F.lit("unk_coverage").alias("check"), "id")
    return scores.unionByName(cover)


def doctor_continuations(v: DataFrame, prefix_hex: str = "2323") -> DataFrame:
    """Tokens that carry on a word, by their prefix, and whose rest is no token itself."""
    rest = v.filter(F.col("hex").startswith(prefix_hex) & (F.length("hex") > len(prefix_hex))).select("id", F.expr(f"substring(hex, {len(prefix_hex) + 1})").alias("hex"))
    return rest.join(v.select("hex"), "hex", "left_anti").select(F.lit("info").alias("severity"), F.lit("continuation_consistency").alias("check"), F.col("id").cast("long").alias("id"))


def doctor_branches(v: DataFrame) -> DataFrame:
    """For a model that weighs shorter tokens: lengths 1 to 6 and over (as far as tokens reach) that no token has, an error if there are single bytes alone, and how many tokens begin with a deleted space."""
    spark = v.sparkSession
    sizes = v.select(F.least(F.lit(6), F.col("length")).alias("n"))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    single = most.filter("most = 1").select(F.lit("error").alias("severity"), F.lit("branch_coverage").alias("check"), F.lit(1).cast("long").alias("id"))
    wanted = spark.range(1, 7).join(most.filter("most > 1"), F.col("id") <= F.col("most")).select(F.col("id").alias("n"))
    dead = wanted.join(sizes.distinct(), "n", "left_anti").select(F.lit("warning").alias("severity"), F.lit("branch_coverage").alias("check"), F.col("n").cast("long").alias("id"))
    marked = v.agg(F.count(F.when(F.col("hex").startswith("7F20"), 1)).alias("id")).select(F.lit("info").alias("severity"), F.lit("lilbuf_prefix_count").alias("check"), "id")
    return single.unionByName(dead).unionByName(marked)


def doctor_roundtrip(texts: DataFrame, decoded: DataFrame, check: str) -> DataFrame:
    """Texts (id, text) that don't come back from their tokens, decoded being (id, text); one without tokens counts as empty."""
    both = texts.join(decoded.withColumnRenamed("text", "back"), "id", "left").filter(F.coalesce("back", F.lit("")) != F.coalesce("text", F.lit("")))
    return both.select(F.lit("error").alias("severity"), F.lit(check).alias("check"), F.col("id").cast("long").alias("id"))


def extended(v: DataFrame, new: DataFrame, encode_new: DataFrame) -> DataFrame:
    """(id, hex, source, weight): how to start the embedding of each appended token: the mean of the tokens it is now encoded to (encode_new: piece_hex, ids)."""
    base = v.agg(F.max("id").alias("m")).first().m
    fresh = new.join(v, "hex", "left_anti").withColumn("id", (F.lit(base) + F.row_number().over(W.orderBy("rank"))).cast("long"))
    plan = fresh.join(encode_new.withColumnRenamed("piece_hex", "hex"), "hex").select("id", "hex", F.explode("ids").alias("source"), F.size("ids").alias("m"))
    return plan.groupBy("id", "hex", "source").agg(F.round(F.sum(1 / F.col("m")), 9).alias("weight"))


def similar_tokens(v: DataFrame, new: DataFrame, q: int = 4, top: int = 3) -> DataFrame:
    """(hex, id, shared): for each new token the tokens that share most of its runs of q hex digits (two bytes), ties by id. Candidates meet on the runs."""
    runs = lambda df, *keep: df.filter(F.length("hex") >= q).select(*keep, "hex", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(hex) - {q - 1}, 2), i -> substring(hex, i, {q}))"))).alias("g"))
    pairs = runs(new).withColumnRenamed("hex", "new_hex").join(runs(v, "id"), "g").groupBy("new_hex", "id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(W.partitionBy("new_hex").orderBy(F.desc("shared"), "id"))
    return pairs.withColumn("r", rank).filter(F.col("r") <= top).select(F.col("new_hex").alias("hex"), "id", "shared")
