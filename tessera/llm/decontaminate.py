"""Benchmark decontamination in DataFrame functions only: a broadcast hash set of the test texts' word windows, probed
with every window of every document."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch, small

#: ASCII characters that are in no word, alone and as a class; a piece of a text is a word and what follows it.
PARTING = "".join(c for c in map(chr, range(128)) if not c.isalnum())
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PIECES = f"(?<={OTHER})(?!{OTHER})"
#: Windows of test texts that are broadcast at once, at some 150 bytes each.
HELD = 250_000


def words(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased; a null text has none. Characters are replaced and the text is split at
    blanks: what finds all matches of a pattern copies the text for each of them."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase + PARTING, string.ascii_lowercase + " " * len(PARTING))
    return F.array_remove(F.split(plain, " "), "")


def _window(array: str, at: Column, length: Column, n: int) -> list[Column]:
    """The up to n elements of a window; those past its length are null, which hashes and joined strings leave out. A
    slice would look at the whole array each time."""
    return [F.when(length > k, F.get(array, at + k)) for k in range(n)]


def _key(id_: Column, text: Column) -> Column:
    """What rows of the same id and text share. They have the same hits."""
    return F.md5(F.concat(F.coalesce(id_.cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(hash, gram, len, item_id)``: every window of n words of every item; an item of fewer words is one window, an
    item without words none."""
    own = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    own = own.withColumn("len", F.least(F.size("words"), F.lit(n)))
    own = own.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.explode(F.expr("sequence(0, size(words) - len)")).alias("at"))
    at, length = F.col("at"), F.col("len")
    return own.select(F.xxhash64(*_window("h", at, length, n)).alias("hash"), F.concat_ws(" ", *_window("words", at, length, n)).alias("gram"), "len", "item_id").distinct()


def occurrences(docs: DataFrame, grams: DataFrame, lengths: list[int], n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, doc_id, n_words, pos, len, gram)``: where windows ``(hash, gram)`` of the given lengths, n at most, occur
    in documents; for length 0 a row for each document, if grams hold the empty window. Every window of a document is
    looked up by its hash; what is found is held against the words themselves."""
    text = F.col(text_col)
    own = docs.select(_key(F.col(id_col), text).alias("key"), F.col(id_col).cast("long").alias("doc_id"), words(text).alias("words"))
    own = own.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").cast("long").alias("n_words"))
    own = own.select("*", F.explode(F.array(*(F.lit(x) for x in lengths))).alias("len"))
    starts = F.when(F.col("len") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("h"))
    own = own.select("*", F.posexplode(starts).alias("pos", "first")).where("pos + len <= n_words")
    at, length = F.col("pos"), F.col("len")
    own = own.select("key", "doc_id", "n_words", "words", "pos", "len", F.xxhash64(*_window("h", at, length, n)).alias("probe"))
    found = F.concat_ws(" ", *_window("words", at, length, n))
    # between, not equal: an equality would become a key of the join, and be built for every window rather than for hits
    met = own.join(F.broadcast(grams), (F.col("probe") == F.col("hash")) & found.between(F.col("gram"), F.col("gram")))
    return met.select("key", "doc_id", "n_words", "pos", "len", "gram")


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, keep: Scratch, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences, stored, and the windows with their items. So many windows as HELD are broadcast in one pass over the
    documents; more take as many passes as they fill."""
    held = keep.keep(windows(benchmark, n, item_col, item_text_col), "windows")
    grams = held.select("hash", "gram", "len").distinct()
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # n at most
    passes = max(1, -(-grams.count() // HELD))
    none = docs.sparkSession.range(1).select(F.xxhash64(F.lit(None).cast("long")).alias("hash"), F.lit("").alias("gram"))
    parts = []
    for i in range(passes):
        share = grams.where(F.pmod(F.xxhash64("gram"), F.lit(passes)) == i).select("hash", "gram")
        parts.append(occurrences(docs, share.unionByName(none) if i == 0 else share, [0, *lengths] if i == 0 else lengths, n, id_col, text_col))
    return keep.keep(reduce(DataFrame.unionByName, parts), "occurrences", gather=False), held


def spans(hits: DataFrame) -> DataFrame:
    """``(key, start, end)``: the runs of words that occurrences cover, end exclusive, from ``(key, pos, len)``."""
    before = F.expr("max(pos + len) over (partition by key order by pos, len rows between unbounded preceding and 1 preceding)")
    marked = hits.select("key", "pos", "len").distinct().select("*", F.coalesce((F.col("pos") > before).cast("int"), F.lit(1)).alias("new"))
    runs = marked.select("*", F.expr("sum(new) over (partition by key order by pos, len rows unbounded preceding)").alias("nth"))
    return runs.groupBy("key", "nth").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end")).drop("nth")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row per document.

    A word inside any occurrence of a window is hit; ``n_items`` counts the items that have occurring windows, the
    digest is of their ids, sorted as strings and joined by commas.

    Null texts have no words, texts of any length count whole, empty ones are clean. Rows that repeat id and text each
    get a row; items that share an id are one; an item without an id hits words, but is no counted item. An empty
    benchmark leaves all clean, empty documents give no rows; other columns are not read.
    """
    keep = Scratch(docs.sparkSession)
    seen, held = _scan(docs, benchmark, n, keep, id_col, text_col, item_col, item_text_col)
    hits = seen.where("len > 0")
    covered = spans(hits).groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    items = held.where(F.col("item_id").isNotNull()).select(F.col("gram").alias("of"), F.col("item_id").cast("string").alias("item")).distinct()
    met = hits.select("key", "gram").distinct().join(small(items), F.col("gram") == F.col("of")).select("key", "item").distinct()
    named = met.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    out = seen.where("len = 0").select("key", "doc_id", "n_words").join(covered, "key", "left").join(named, "key", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, how: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without what the benchmark has: ``how`` "documents" drops every document with a hit, "spans" takes
    the hit words out of its text, each with what follows it up to the next word.

    All columns are kept, whatever their names. Nulls, repeats and empty tables are as in ``report``; a text without
    hits stays as it is, a text that is all hit becomes what stands before its first word.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how: spans or documents")
    keep = Scratch(docs.sparkSession)
    seen, _ = _scan(docs, benchmark, n, keep, id_col, text_col, item_col, item_text_col)
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_, text = (F.col(f"c{names.index(x)}") for x in (id_col, text_col))
    rows = numbered.withColumn("own", _key(id_, text))
    # a document's runs are no more than its words, so they fit a row as its text does
    runs = spans(seen.where("len > 0")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    runs = small(keep.keep(runs, "runs"), 100_000)
    if how == "documents":
        return rows.join(runs, F.col("own") == F.col("key"), "left_anti").select(*numbered.columns).toDF(*names)
    joined = rows.join(runs, F.col("own") == F.col("key"), "left")
    pieces = F.split(text.cast("string"), PIECES)
    lead = text.cast("string").rlike(f"^{OTHER}").cast("int")  # then the first piece is no word's
    joined = joined.select("*", F.when(F.col("runs").isNotNull(), pieces).alias("pieces"))
    hit = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"] + lead, r["end"] + lead - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), hit)
    cut = F.array_join(F.transform(left, lambda i: F.get("pieces", i)), "")
    new = F.when(F.col("runs").isNull(), text).otherwise(cut)
    at = f"c{names.index(text_col)}"
    return joined.select(*(new.alias(c) if c == at else F.col(c) for c in numbered.columns)).toDF(*names)
