"""Near copies: SimHash links, and five-word shingles of which four fifths are shared, found without all pairs of a
group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.portions import slices
from tessera.operators.graph import connected_components
from tessera.session import Scratch, stored

WORDS = 5
#: Near copies share this part of all their shingles.
SHARED, ALL = 4, 5
#: Sets that share four fifths have four equal minima in none of 32 bands in 5 of 10^8 cases.
BANDS, ROWS = 32, 4
#: Bits of a set's odd sketch, 64 to a column: each shingle turns one bit over.
BITS = 512
LONGS = BITS // 64
STEP = 4096
#: Of so many first shingles a set knows at which it meets another first.
HEAD = 16
#: Members of a band that are compared with one of them.
PART = 8
#: Sets of so many documents are broadcast by name at most.
FEW = 500_000
SEED = 42
_FACTORS, _SHIFTS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending. Words are those of ``simhash.fingerprint``; a text of
    fewer words is one shingle, one without words has none. Only the hashes of a very long text are held."""
    parts = simhash.split(text)
    if not parts:
        return np.zeros(0, np.uint64)
    joined, out = simhash.joined(parts, words), []
    while block := [xxhash.xxh64_intdigest(x, SEED) for x in islice(joined, simhash.PIECE)]:
        out.append(np.array(block, np.uint64))
    return np.unique(np.concatenate(out))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key per band, none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(low, (hashes[i : i + STEP] * _FACTORS + _SHIFTS).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch: in two sets' sketches no more bits differ than shingles are in one of the sets alone."""
    turned = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def shape(hashes: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))


def text_key(text: Column) -> Column:
    """What stands for a text beside its id: a hash of the whole of it, of null another than of the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, key, fp, shape, size, sketch, bands)``, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            fp, name, size, odd, keys = [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t)
                fp.append(simhash.fingerprint(t))
                name.append(shape(h))
                size.append(len(h))
                odd.append(sketch(h))
                keys.append(bands(h))
            longs = pa.list_(pa.int64())
            columns = [
                b.column(0), b.column(1), pa.array(fp, pa.int64()), pa.array(name, pa.int64()), pa.array(size, pa.int64()), pa.array(odd, longs),
                pa.array(keys, longs)
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "shape", "size", "sketch", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, key long, fp long, shape long, size long, sketch array<long>, bands array<long>"
    )


def may_share(a: str, b: str) -> str:
    """SQL: whether the sizes and odd sketches of two sets, structs of both, allow four fifths; no pair of near copies
    is ruled out. Near copies of sizes x and y have at most (x + y) / 9 shingles that are in one of them alone."""
    alone = " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(LONGS))
    return f"{ALL} * least({a}.size, {b}.size) >= {SHARED} * greatest({a}.size, {b}.size) and 9 * ({alone}) <= {a}.size + {b}.size"


def whole_sets(docs: DataFrame, own: DataFrame, need: DataFrame, id_col: str, text_col: str, keep: Scratch) -> DataFrame:
    """``(shape, hashes)`` of the sets named in ``need``, counted anew from one text each."""
    texts = _texts(docs, id_col, text_col)
    one = own.join(need, F.col("shape") == F.col("need"), "left_semi").groupBy("shape").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key")).alias("first")
    )
    one = keep.keep(one.select("first.*").distinct().toDF("at", "text_key"))
    few = one.limit(FEW + 1).count() <= FEW
    texts = texts.join(F.broadcast(one) if few else one, (F.coalesce("doc_id", F.lit(0)) == F.col("at")) & (F.col("key") == F.col("text_key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(shape, sets), pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["shape", "hashes"]
            )

    sets = texts.select("text").mapInArrow(run, "shape long, hashes array<long>").join(need, F.col("shape") == F.col("need"), "left_semi")
    return keep.keep(sets.groupBy("shape").agg(F.any_value("hashes").alias("hashes")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of set names whose sets are near copies, as links ``(src, dst)``."""
    x, y = sets.select(F.col("shape").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("shape").alias("b"), F.col("hashes").alias("y"))
    met = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return met.where(f"{ALL} * both >= {SHARED} * (size(x) + size(y) - both)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct()


def _torn(members: DataFrame, nodes: DataFrame, keep: Scratch) -> DataFrame:
    """``(band, shape, c)`` of the bands that hold sets of several components ``c``."""
    placed = members.join(nodes, F.col("shape") == F.col("node"), "left").select("band", "shape", F.coalesce("component", "shape").alias("c"))
    placed = keep.keep(placed)
    torn = placed.groupBy("band").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first <> last").select("band")
    return keep.keep(placed.join(keep.keep(torn), "band", "left_semi"))


def dealt_pairs(torn: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different components: the members of each band are dealt into parts of some
    ``PART``, by their names and the band's, and each is paired with its part's least one. So a set meets up to
    ``BANDS`` others of a crowd, other ones in each band, and the number of pairs grows with the crowd."""
    sizes = torn.groupBy("band").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = torn.join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("band", "shape"), F.col("parts")))
    lows = dealt.groupBy("band", "part").agg(F.min(F.struct("shape", "c")).alias("low"))
    return dealt.join(lows, ["band", "part"]).where("c <> low.c").select(F.col("low.shape").alias("a"), F.col("shape").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets that lie in different components and may be near copies, among the sets given.

    Shingles are ordered by how few of the sets hold them. Two near copies share a shingle among the first fifth of the
    larger set and the first ninth of the smaller one (of equal sizes that of the smaller name), and what follows it in
    both is long enough; so only these meet, and those that every set of a group holds come last. Sizes and sketches
    are compared where they meet. Sets of a crowd share many of these shingles; a pair is made at the first one that is
    among the first ``HEAD`` of both, and at each only if there is none. That loses nothing: what follows the first is
    longer than what follows a later one. ``nodes`` has ``(shape, c, size, s0, s1, ...)``: component, size and sketch.
    """
    tokens = sets.select("shape", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    often = sets.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(often, "token", "left").withColumn(
        "at", F.row_number().over(Window.partitionBy("shape").orderBy(F.coalesce("df", F.lit(1)), "token")) - 1
    )
    front = ranked.where("df is not null and at <= floor(n / 5)").select("token", "shape", "n", "at")
    front = front.withColumn("k", F.row_number().over(Window.partitionBy("shape").orderBy("at")))
    head = F.sort_array(F.collect_list(F.when(F.col("k") <= HEAD, F.struct("at", "token"))).over(Window.partitionBy("shape")))
    front = front.withColumn("head", head).join(nodes, "shape").select(
        "token", "n", "at", "head", F.struct("shape", "c", "size", *(f"s{i}" for i in range(LONGS))).alias("e")
    )
    larger = front.select("token", F.col("at").alias("i"), F.col("head.token").alias("ps"), F.col("e").alias("p"))
    smaller = front.where("at <= floor(n / 9)").select(
        "token", F.col("at").alias("j"), F.expr("filter(head, h -> h.at <= floor(n / 9)).token").alias("qs"), F.col("e").alias("q")
    )
    order = "(q.size < p.size or (q.size = p.size and q.shape < p.shape))"
    rest = "9 * least(p.size - i, q.size - j) >= 4 * (p.size + q.size)"
    first = "coalesce(get(array_intersect(ps, qs), 0), l.token) = l.token"
    near = f"p.c <> q.c and {order} and {rest} and {may_share('p', 'q')} and {first}"
    met = larger.alias("l").join(smaller.alias("r"), F.expr(f"l.token = r.token and {near}"))
    return met.select(F.col("p.shape").alias("a"), F.col("q.shape").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row ``(doc_id, key, times, component)`` per id and whole text: ``key`` is the text's (``text_key``), ``times``
    how many rows have both, ``component`` the name of its group.

    Documents link if their SimHashes differ in at most ``radius`` bits (``simhash.links``) or if they share four fifths
    of their five-word shingles. Equal sets of shingles are one node. Sets that meet in a band are compared with the
    band's least one. The sets of bands that are not in one component by that are compared with a few others of their
    bands (``dealt_pairs``); those of bands that still are not are joined by rare shingles (``prefix_pairs``), which
    loses no pair. So a group of near copies costs two pairs per member and band, not their square. Texts without words are one group; null ids are ids like others; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession)
    own = keep.keep(prints(docs, id_col, text_col), gather=False)
    one = own.groupBy("shape").agg(F.min("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"))
    one = keep.keep(one.select("shape", "size", *(F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(LONGS)), "bands"))
    entry = F.struct("shape", "size", *(f"s{i}" for i in range(LONGS)))
    posted = one.select("shape", F.explode("bands").alias("band"))
    shared = keep.keep(posted.groupBy("band").agg(F.min("shape").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low"))
    members = keep.keep(posted.join(shared, "band"))
    stars = members.where("shape <> low").select(F.col("low").alias("a"), F.col("shape").alias("b")).distinct()
    ends = [one.select(F.col("shape").alias(x), entry.alias(f"{x}{x}")) for x in "ab"]
    stars = keep.keep(stars.join(ends[0], "a").join(ends[1], "b").where(may_share("aa", "bb")).select("a", "b"))

    same = keep.keep(own.select("fp", "shape").distinct())
    rep = keep.keep(same.groupBy("fp").agg(F.min("shape").alias("rep")))
    rep_of = [rep.select(F.col("fp").alias(f"{x}_fp"), F.col("rep").alias(x)) for x in ("src", "dst")]
    near = simhash.links(rep.select("fp"), radius).select(
        F.col("src").alias("src_fp"), F.col("dst").alias("dst_fp")
    ).join(rep_of[0], "src_fp").join(rep_of[1], "dst_fp").select("src", "dst")
    edges = same.join(rep, "fp").where("shape <> rep").select(F.col("rep").alias("src"), F.col("shape").alias("dst")).unionByName(near)
    edges = keep.keep(edges.unionByName(verified(stars, whole_sets(docs, own, _named(stars), id_col, text_col, keep))))
    nodes = connected_components(edges)

    torn = _torn(members, nodes, keep)
    sets = whole_sets(docs, own, torn.select(F.col("shape").alias("need")).distinct(), id_col, text_col, keep)
    dealt = dealt_pairs(torn).join(ends[0], "a").join(ends[1], "b").where(may_share("aa", "bb")).select("a", "b")
    more = keep.keep(verified(keep.keep(dealt), sets))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        nodes = connected_components(edges)
        torn = _torn(torn, nodes, keep)
    torn = keep.keep(torn.select("shape", "c").distinct())
    left = sets.join(torn.select("shape"), "shape", "left_semi")
    rest = keep.keep(prefix_pairs(left, keep.keep(torn.join(one.drop("bands"), "shape"))))
    if not rest.isEmpty():
        nodes = connected_components(edges.unionByName(verified(rest, sets)))

    texts = own.groupBy("doc_id", "key").agg(F.count("*").alias("times"), F.any_value("shape").alias("shape"))
    out, _ = stored(
        keep.keep(texts).join(nodes, F.col("shape") == F.col("node"), "left").select(
            F.col("doc_id").alias(id_col), "key", "times", F.coalesce("component", "shape").alias("component")
        ),
        "groups"
    )
    keep.clear()
    return out


def leavers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, goes)`` of the rows that are not all kept if one row of each group stays: that of the group's
    least id (null last), of its least text key. ``goes`` is false where rows repeat both and one of them stays."""
    found = groups(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key")
    stays, _ = stored(found.groupBy("component").agg(F.min(order).alias("stays")), "groups")
    out = found.join(stays, "component").select("doc_id", "key", (F.col("stays") != order).alias("goes"), "times")
    return out.where("goes or times > 1").drop("times")
