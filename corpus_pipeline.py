"""A corpus pipeline: what the quality classifier rejects goes, one document of each near-duplicate group stays, secrets
are masked, sources are mixed to their target weights, and what is left is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of their docs.
Every stage works with null texts, ids and sources, empty tables and repeated rows, and keeps further columns as they
are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessera.llm import alike, credentials, mixing, pieces, quality
from tessera.session import remove, settle, stored, table

#: Keys of so many rows (two numbers each) are broadcast at most.
FEW = 500_000
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more stay. Labels are learnt from the documents' own labelled rows; without
    any, nothing is rejected."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the least id (null last), of its texts the one of the least hash. Of rows
    that repeat id and text one stays; which, their other columns of sortable types decide. Different texts of one id
    are documents of their own.

    Groups are linked by SimHash (``op9``'s rule) and by five-word shingles of which four fifths are shared.
    The ids and text hashes that go or repeat are found first; up to FEW of them are broadcast, so that no text is
    shuffled, beyond that the join is.
    """
    odd = settle(alike.leavers(docs).toDF("odd_id", "odd_key", "goes"))
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {x: F.col(f"c{names.index(x)}") for x in ("doc_id", "text")}
    keyed = numbered.withColumn("key", alike.text_key(at["text"].cast("string")))
    same = at["doc_id"].cast("long").eqNullSafe(F.col("odd_id")) & (F.col("key") == F.col("odd_key"))
    joined = keyed.join(F.broadcast(odd) if odd.limit(FEW + 1).count() <= FEW else odd, same, "left")
    once = joined.where("goes is null").select(*numbered.columns)
    row = F.struct(*numbered.columns)
    order = F.struct(*(f.name for f in numbered.schema.fields if _sortable(f.dataType)))
    again = joined.where("not goes").groupBy("odd_id", "odd_key").agg(F.min_by(row, order).alias("row")).select("row.*")
    return once.unionByName(again).toDF(*names)


def _sortable(kind: DataType) -> bool:
    """Whether values of a type can be put in order; maps, and what holds them, can't."""
    if isinstance(kind, StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return _sortable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is masked in the text; no document goes."""
    return credentials.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes whole, as often as the mix takes it. The one document of a source in which its budget ends
    comes once more if at least half of it is taken, so a source misses its target by half a document at most.
    Documents without words are in no mix and go."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {x: f"c{names.index(x)}" for x in ("doc_id", "text", "source")}
    mixed = mixing.mix(numbered, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"], carry=numbered.columns)
    times = F.expr("cast(floor(taken / size + 0.5) as int)")
    rows = mixed.where("size > 0 and 2 * taken >= size").select("carried.*", F.explode(F.sequence(F.lit(1), times)).alias("nth"))
    return rows.select(*numbered.columns).toDF(*names)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text decoded from them."""
    # workers live on from the stages before: they hold less here than alone
    return pieces.encode_documents(docs, PIECES, keep=150_000, portion=1_000_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL: the classifier, the SimHash, the automata and the piece lattice can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again by the next; what only the next
    one reads is removed after it."""

    def step(done: tuple[DataFrame, str | None], stage: tuple) -> tuple[DataFrame, str | None]:
        docs, was = done
        out, folder = stored(stage[1](spark, docs, sf_dir), stage[0].replace(" ", "-"), gather=False)
        remove(spark, *[was] * bool(was))
        return out, folder

    return reduce(step, STAGES, (table(spark, sf_dir, "documents"), None))[0]
