"""Ranked lexical search: three phases of thresholds (TPUT) over postings that are partitioned by term."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.portions import give_back, slices
from tessera.session import Scratch, small, stored

#: Query terms of so many are sent along with the tasks that read documents; beyond it all terms are kept and joined.
#: Of an item's terms so many, at most, are sent along with the tasks that add up scores; more take several passes.
FEW = 500_000
#: Postings of the documents whose scores are added up together.
BATCH = 500_000
#: Bytes of a text that are cut into terms at once.
PORTION = 1 << 20
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c if c in _KEPT or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """How often a text has each term: runs of letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    out: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        part = text[start : start + PORTION].translate(_PLAIN)
        end = len(part) if start + len(part) == len(text) else part.rfind(b" ") + 1
        if not end:  # one term fills the portion
            part = text[start:].translate(_PLAIN)
            end = part.find(b" ") if b" " in part else len(part)
        out.update(part[:end].split())
        start += end
    return out


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term, times)``; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            counts = [term_counts(t or b"") for t in b.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            terms, times = [t.decode() for c in counts for t in c], [n for c in counts for n in c.values()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").cast("binary"))
    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(run, f"item_id {kind}, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def forward(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, doc_id, n, terms, counts)`` of the documents that have terms: n counts all of them, the arrays hold those
    of ``terms`` in order. ``doc`` numbers the rows; it holds once this is stored."""
    few = terms.limit(FEW + 1).count() <= FEW
    known = docs.sparkSession.sparkContext.broadcast({r[0].encode() for r in terms.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for b in slices(batches, 2):
            at, sizes, names, counts = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                found = term_counts(text or b"")
                if found:
                    own = sorted(found.keys() & wanted if wanted is not None else found)
                    at.append((i, found.total()))
                    sizes.append(len(own))
                    names += own
                    counts += [found[t] for t in own]
            if at:
                rows, n = (pa.array(x, pa.int64()) for x in zip(*at, strict=True))
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), n, *lists], ["doc", "doc_id", "n", "terms", "counts"])
        give_back()

    own = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary"))
    return own.mapInArrow(run, "doc long, doc_id long, n long, terms array<string>, counts array<bigint>")


def inverted(index: DataFrame, docs: int, length: int) -> DataFrame:
    """``(term, batch, top, docs, impacts)`` from ``forward``: postings by term, a row for each batch of documents, by
    falling impact; ``top`` is the first. Rows are dealt by term; a list of any length is of many rows, which
    rebalancing spreads over as many partitions as they fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH, "right")))
                part, start = b.slice(start, stop - start), stop
                doc, n = (part.column(i).to_numpy() for i in (0, 1))
                doc, n = (np.repeat(x, part.column(2).value_lengths().to_numpy()) for x in (doc, n))
                named = part.column(2).flatten().dictionary_encode()
                term, tf = named.indices.to_numpy(), part.column(3).flatten().to_numpy()
                if not len(term):
                    continue
                # n docs may be too large for 64 bits, so whole lengths are taken out first
                m = 75 + 25 * docs // length * n + (25 * docs % length * n) // length
                value = (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype(np.int32)
                order = np.lexsort((doc, -value, term))
                term, doc, value = term[order], doc[order], value[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(term)) + 1, [len(term)]))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (doc, value)]
                first = cuts[:-1]
                yield pa.RecordBatch.from_arrays(
                    [named.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), doc.min())), pa.array(value[first]), *lists],
                    ["term", "batch", "top", "docs", "impacts"]
                )

    made = index.select("doc", "n", "terms", "counts").mapInArrow(run, "term string, batch long, top int, docs array<bigint>, impacts array<int>")
    return made.hint("rebalance", "term").sortWithinPartitions("term", F.col("top").desc())


def kth(sums: DataFrame, k: int) -> DataFrame:
    """``(item, floor)``: the k-th largest ``low`` of each item, for items that have so many."""
    place = F.expr("row_number() over (partition by item order by low desc)")
    best = sums.select("item", "low", place.alias("place")).where(F.col("place") <= k)
    return best.groupBy("item").agg(F.min("low").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def _bounded(lists: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(item, doc, low, high)``: of each batch of documents those whose scores may be among an item's k highest, as far
    as that batch and the item's floor tell, with bounds of their scores."""
    rows = wanted.orderBy("item", "term").collect()
    items: dict[int, list] = {}
    for r in rows:
        items.setdefault(r.item, [r.floor, 0, []])[2].append((r.term, r.weight, r.least, r.rest))
        items[r.item][1] += r.rest
    shared = lists.sparkSession.sparkContext.broadcast(items)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        named = {t: i for i, t in enumerate(group["term"].to_pylist())}
        ends = np.concatenate(([0], np.cumsum(group["docs"].combine_chunks().value_lengths().to_numpy())))
        docs, at = np.unique(group["docs"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        impacts = group["impacts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        found = []
        for item, (floor, rests, terms) in shared.value.items():
            low, seen = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for term, weight, least, rest in terms:
                if (i := named.get(term)) is not None:
                    own = impacts[ends[i] : ends[i + 1]]
                    own = own[: np.searchsorted(-own, -least, "right")]
                    to = at[ends[i] : ends[i] + len(own)]
                    low[to] += weight * own
                    seen[to] += rest
            some = np.flatnonzero(low > 0)
            if len(some) >= k:
                floor = max(floor, np.partition(low[some], -k)[-k])
            some = some[low[some] + rests - seen[some] >= floor]
            found.append((np.full(len(some), item), docs[some], low[some], low[some] + rests - seen[some]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], ["item", "doc", "low", "high"])

    least = wanted.groupBy("term").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
    met = lists.join(small(least, FEW), "term").where("top >= least")
    reached = F.size(F.filter("impacts", lambda x: x >= F.col("least")))
    met = met.select("batch", "term", *(F.slice(c, F.lit(1), reached).alias(c) for c in ("docs", "impacts")))
    return met.groupBy("batch").applyInArrow(run, "item long, doc long, low long, high long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of the highest scores above 0 for each item.

    N documents have terms, L in all; a term that df of them hold weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``. Of n
    terms, tf of them one term, a document gets ``1000000000 tf div (1000 tf + 12 m)`` of that term's weight, with m =
    ``75 + 25 n N div L``. Its score sums that over the item's terms, repeats included; all but the logarithm is in
    64-bit integers. Equal scores go by ascending id.

    First the heads of the items' lists are fetched, k postings each: sums of these are no more than true scores, and an
    item's k-th largest is its floor. A document that reaches the floor has, in one of the item's m lists, a value of
    the floor divided by m or more: all postings with such values are fetched, each once for all items that want it,
    and added up for a batch of documents. What a document can have in lists that gave nothing of it is bounded by that
    threshold and the list's largest value, so most are out; the scores of the rest are looked up in their own terms.

    Rows of documents each count, also those that share an id; items that share an id are one, a null id is one too.
    Null and empty texts have no terms, texts of any length count whole; items without terms, or whose terms no document
    has, give no rows; a null doc_id comes last among equal scores. Empty tables give no rows; other columns are not
    read.
    """
    keep = Scratch(docs.sparkSession)
    asked = keep.keep(query_terms(items, item_col, item_text_col), "asked")
    numbers = keep.keep(asked.select("item_id").distinct().select(F.monotonically_increasing_id().alias("item"), F.col("item_id").alias("whose")), "items")
    asked = asked.join(small(numbers), F.col("item_id").eqNullSafe(F.col("whose"))).select("item", "term", "times")
    known = asked.select("term").distinct()
    index = keep.keep(forward(docs, known, id_col, text_col), "forward", gather=False)
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).head()
    length = total.length or 1

    lists = inverted(index, total.docs, length)
    if known.limit(FEW + 1).count() > FEW:
        lists = lists.join(known, "term", "left_semi")
    lists = keep.keep(lists, "lists", gather=False)
    sizes = keep.keep(lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("top").cast("long").alias("largest")), "sizes")
    weight = F.floor(1000 * F.log(F.lit(float(2 * total.docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = asked.join(small(sizes), "term").select("item", "term", (F.col("times") * weight).alias("weight"), "largest").where("weight > 0 and largest > 0")
    per = terms.groupBy("item").agg(F.count("*").alias("m"))
    terms = keep.keep(terms.join(per, "item"), "terms")

    # a list's k highest postings lie in the k rows of the highest tops
    place = F.expr("row_number() over (partition by term order by top desc, batch)")
    tops = lists.select("term", "batch", "top", F.slice("docs", 1, k).alias("docs"), F.slice("impacts", 1, k).alias("impacts"))
    tops = tops.select("*", place.alias("place")).where(F.col("place") <= k)
    heads = tops.select("term", F.explode(F.arrays_zip("docs", "impacts")).alias("p")).select("term", "p.docs", "p.impacts")
    place = F.expr("row_number() over (partition by term order by impacts desc, docs)")
    heads = heads.select("*", place.alias("place")).where(F.col("place") <= k)
    first = heads.join(small(terms), "term").groupBy("item", "docs").agg(F.sum(F.col("weight") * F.col("impacts")).alias("low"))

    # the least impact whose value times m reaches the floor, and the most that a posting below it is worth
    floored = terms.join(small(keep.keep(kth(first, k), "floors")), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    share = F.col("m") * F.col("weight")
    least = F.greatest(F.lit(1), F.call_function("div", F.col("floor") + share - 1, share))
    rest = F.least(F.call_function("div", F.greatest(F.lit(0), F.col("floor") - 1), F.col("m")), F.col("weight") * F.col("largest"))
    wanted = keep.keep(floored.select("item", "term", "weight", "largest", "floor", least.alias("least"), rest.alias("rest")), "wanted")

    passes = max(1, -(-wanted.count() // FEW))
    for i in range(passes):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i)
        part = keep.keep(_bounded(lists, own, k), "sums", gather=False)
        sums = part if i == 0 else sums.unionByName(part)
    better = small(keep.keep(kth(sums, k), "floors"))
    left = sums.join(better, "item", "left").where("high >= coalesce(floor, 0)").select("item", "doc")
    own = terms.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("own"))
    own = keep.keep(own.select("item", F.col("own.term").alias("own"), F.col("own.weight").alias("weights")), "own")
    found = index.join(small(keep.keep(left, "candidates"), 500_000), "doc").join(small(own), "item")
    scored = _scores(found, total.docs, length).where("score > 0")
    rank = F.expr("row_number() over (partition by item order by score desc, doc_id asc nulls last)")
    best = scored.select("*", rank.alias("rank")).where(F.col("rank") <= k)
    out, _ = stored(best.join(small(numbers), "item").select(F.col("whose").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"), "ranked")
    keep.clear()
    return out


def _scores(rows: DataFrame, docs: int, length: int) -> DataFrame:
    """``(item, doc_id, score)`` of rows that hold a document's terms and an item's weighted terms: exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for n, terms, counts, own, weights in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                tf, m = dict(zip(terms, counts, strict=True)), 75 + 25 * n * docs // length
                scores.append(sum(w * (1_000_000_000 * n // (1000 * n + 12 * m)) for w, n in zip(weights, map(tf.get, own), strict=True) if n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return rows.select("item", "doc_id", "n", "terms", "counts", "own", "weights").mapInArrow(run, "item long, doc_id long, score long")
