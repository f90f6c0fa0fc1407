"""Benchmark decontamination by templates.

Texts are turned into templates: numbers, names and units become typed
placeholders, everything else is lower-cased words. Windows of template
tokens are hashed and joined with the windows of the benchmark items, so a
question whose numbers or names were changed still meets its original. A
document and an item that share windows are then checked for consistent slots:
one value of the item must stand for one value of the document throughout,
and the other way round.

Everything is column expressions. The benchmark side is broadcast only if its
windows are no more than BROADCAST rows; otherwise they are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, stored

WINDOW = 8
#: Share of an item's windows that a document must have with consistent slots.
SHARE = 0.4
BROADCAST = 500_000

#: Stands before a name; no other token holds it.
NAME = "\u0001"
UNITS = """kg g mg km m cm mm mi ft lb lbs oz l ml kmh mph kwh kw w v hz khz mhz ghz kb mb gb tb usd eur gbp percent
percents dollar dollars cent cents euro euros pound pounds inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters gram grams kilogram
kilograms kilo kilos ounce ounces ton tons tonne tonnes liter liters litre litres milliliter milliliters gallon gallons second seconds
minute minutes hour hours day days week weeks month months year years degree degrees celsius fahrenheit watt watts volt volts joule
joules newton newtons hertz""".split()


#: Capitalised words that open a question or sentence and aren't names.
OPENERS = """A After All Also An And Are As At Because Before Both But By Calculate Can Could Did Do Does Each Every Find For From Give Given Had Has
Have He Her His How However If In Is It Its Let Many More Most No Not Now Of On Once One Or Our She Should Since So Some Such Suppose That The Their
Then There These They This Those To Under Was We Were What When Where Whether Which While Who Whose Why Will With Would You Your""".split()
NAMED = r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}])(?!(?:" + "|".join(OPENERS) + r")(?![\p{L}\p{N}]))"


def tokens(text: Column) -> Column:
    """Words of a text: letters and digits, lower case; a name (a capitalised word anywhere that isn't one of OPENERS) keeps a mark before it, a number is one token however it is grouped."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), NAMED, NAME)
    joined = F.regexp_replace(F.lower(marked), r"(\d)[.,](?=\d)", "$1")
    spaced = F.regexp_replace(joined, r"[^\p{L}\p{N}\x01]+", " ")
    return F.split(F.trim(spaced), " ")


def kind(token: Column) -> Column:
    """1 number, 2 name, 3 unit; 0 any other word."""
    first = F.substring(token, 1, 1)
    return F.when((first >= "0") & (first <= "9"), 1).when(first == NAME, 2).when(token.isin(UNITS), 3).otherwise(0)


def token_hash(token: Column) -> Column:
    """Hash of a word, or of its placeholder."""
    first = F.substring(token, 1, 1)
    return F.when((first >= "0") & (first <= "9"), F.lit(1)).when(first == NAME, F.lit(2)).when(token.isin(UNITS), F.lit(3)).otherwise(F.xxhash64(token))


def windows(hashes: Column, length: int) -> Column:
    """Hashes of the runs of length elements, by doubling: the hash of a run is that of its parts of 1, 2, 4, ... elements. Empty if there are fewer."""

    def joined(a: Column, b: Column, shift: int) -> Column:
        """Hashes of a[i] and b[i + shift]; arrays are bound to variables so that each is made once."""
        both = F.array(F.struct(a.alias("a"), b.alias("b")))
        least = lambda x: F.greatest(F.least(F.size(x["a"]), F.size(x["b"]) - shift), F.lit(0))
        return F.element_at(F.transform(both, lambda x: F.zip_with(F.slice(x["a"], F.lit(1), least(x)), F.slice(x["b"], F.lit(shift + 1), least(x)), lambda p, q: F.xxhash64(p, q))), 1)

    out, done, block, step = None, 0, hashes, 1
    while True:
        if length & step:
            out = block if out is None else joined(out, block, done)
            done += step
        if done == length:
            return out
        block, step = joined(block, block, step), 2 * step


def benchmark_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, length, w, place, words, total): each window of each item, with its words; an item of fewer words than a window is one window."""
    t = items.select(F.col(id_col).alias("item"), tokens(F.col(text_col)).alias("t")).filter("t[0] <> ''")
    t = t.withColumns({"length": F.least(F.lit(window), F.size("t")), "h": F.transform("t", token_hash)})
    t = t.withColumn("total", F.size("t") - F.col("length") + 1)
    at_length = F.coalesce(*(F.when(F.col("length") == n, windows(F.col("h"), n)) for n in range(1, window + 1)))
    t = t.select("item", "length", "total", "t", F.posexplode(at_length).alias("place", "w"))
    return t.select("item", "length", "w", (F.col("place") + 1).alias("place"), F.slice("t", F.col("place") + 1, F.col("length")).alias("words"), "total")


def contaminated(df: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_windows, share, exact) for each document and item that meet: the item's windows that the document has with consistent slots, as a number and as a share of at least share of all its windows; exact if no slot differs.

    Items of fewer words than window are matched whole. Null and blank texts
    match nothing, nor do null ids; items with one id are one item. A
    document that has an item more than once counts its windows once. Rows that
    share an id are one document here. Other columns are ignored. No items, or
    no documents, give no rows.
    """
    bench = stored(benchmark_windows(items, window, item_col, item_text_col), "bench")
    sizes = bench.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most window rows
    small = sum(r.n for r in sizes) <= BROADCAST
    side = F.broadcast if small else (lambda x: x)
    keys = bench.select("length", "w").distinct()
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = docs.select("id", F.transform(tokens(F.col("text")), token_hash).alias("h"))
    found = None
    for n in sorted(r.length for r in sizes) or [window]:
        at = hashed.select("id", F.posexplode(windows(F.col("h"), n)).alias("at", "w"))
        hit = at.join(side(keys.filter(F.col("length") == n).select("w")), "w").select("id", "at", F.lit(n).alias("length"), "w")
        found = hit if found is None else found.unionByName(hit)
    found = stored(found, "hits")
    # the words of the hits, from the documents that have any
    own = found.groupBy("id").agg(F.collect_set(F.struct("at", "length", "w")).alias("hit"))
    few = found.limit(BROADCAST + 1).count() <= BROADCAST
    # the words are bound to a variable, so that a text is split once and no row carries all its words
    cut = F.transform(F.array(tokens(F.col("text"))), lambda t: F.transform("hit", lambda x: F.struct(x["w"].alias("w"), x["length"].alias("length"), F.slice(t, x["at"] + 1, x["length"]).alias("own"))))
    own = docs.join(F.broadcast(own) if few else own, "id").select("id", F.explode(F.element_at(cut, 1)).alias("x")).select("id", "x.*")
    own = own.filter(F.size("own") == F.col("length")).distinct().withColumn("h", F.transform("own", token_hash))
    again = F.coalesce(*(F.when(F.col("length") == r.length, F.element_at(windows(F.col("h"), r.length), 1)) for r in sizes)) if sizes else F.lit(None)
    own = own.filter(again == F.col("w")).drop("h")
    hits = own.join(side(bench), ["w", "length"])
    # slots of a window: (kind and value of the item, value of the document)
    pairs = F.filter(F.arrays_zip(F.col("words").alias("theirs"), F.col("own").alias("ours")), lambda x: kind(x["theirs"]) > 0)
    hits = hits.withColumn("slots", pairs).withColumn("differ", F.exists("slots", lambda x: x["theirs"] != x["ours"]))
    # of the ways in which a document has a window, equal words come first, then the least
    hits = hits.groupBy("id", "item", "total", "place").agg(F.min(F.struct("differ", "slots")).alias("best")).select("id", "item", "total", "place", "best.*")
    # a value of the item that stands for several of the document, or the other way round, makes the windows that hold it inconsistent
    slots = hits.select("id", "item", "place", F.explode("slots").alias("x")).select("id", "item", "place", kind(F.col("x.theirs")).alias("k"), "x.theirs", "x.ours")
    one = slots.groupBy("id", "item", "k", "theirs", "ours").agg(F.count("*").alias("c"))
    wrong = one.groupBy("id", "item", "k", "theirs").agg(F.countDistinct("ours").alias("m")).filter("m > 1").select("id", "item", "k", F.col("theirs").alias("value"), F.lit(0).alias("side"))
    wrong = wrong.unionByName(one.groupBy("id", "item", "k", "ours").agg(F.countDistinct("theirs").alias("m")).filter("m > 1").select("id", "item", "k", F.col("ours").alias("value"), F.lit(1).alias("side")))
    both = slots.select("id", "item", "place", "k", F.explode(F.array(F.struct(F.col("theirs").alias("value"), F.lit(0).alias("side")), F.struct(F.col("ours").alias("value"), F.lit(1).alias("side")))).alias("v")).select("id", "item", "place", "k", "v.*")
    bad = both.join(wrong, ["id", "item", "k", "value", "side"], "left_semi").select("id", "item", "place").distinct()
    good = hits.join(bad, ["id", "item", "place"], "left_anti")
    sums = good.groupBy("id", "item", "total").agg(F.count("*").alias("n_windows"), F.max("differ").alias("differ"))
    sums = sums.withColumn("share", F.col("n_windows") / F.col("total")).filter(F.col("share") >= share)
    return sums.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "share", (~F.col("differ")).alias("exact"))


def decontaminated(df: DataFrame, items: DataFrame, **options) -> DataFrame:
    """df without the rows whose id contaminated() finds; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    (name,) = fresh(df.columns, "_found")
    found = stored(contaminated(df, items, **options).select(F.col(id_col).alias(name)).distinct(), "contaminated")
    few = found.limit(BROADCAST + 1).count() <= BROADCAST  # else the join shuffles
    return df.join(F.broadcast(found) if few else found, F.col(id_col) == F.col(name), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
