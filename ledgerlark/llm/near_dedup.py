"""MinHash near-duplicate documents: one-permutation hashing, banded buckets, star-shaped edges, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .clusters import BUCKETS, bucket_links, combined, components, cut, distinct_by_row, hub_join, release
from .textblocks import U64, Words, blocks, byte_class, mix, shingles

BANDS, ROWS = 30, 6


def _sets(data: np.ndarray, offsets: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and their rows."""
    words = Words(data, offsets, table)
    grams, bounds = shingles(words.hashes(), words.first, width)
    return distinct_by_row(grams, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)))


def _prepare(width: int, word_class: str):
    """Arrow function: (doc_id, text) to set size, set digest and band keys."""
    table = byte_class(word_class)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                grams, row = _sets(data, offsets, width, table)
                n = len(offsets) - 1
                size = np.bincount(row, minlength=n)
                ends = np.concatenate([[0], np.cumsum(size)])
                digest = []
                for salt in (0x51ED270B, 0x2545F491):
                    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(grams + U64(salt)))])
                    digest.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                signature, some = minhash.signatures(grams, row, n, BANDS * ROWS)
                keyed = minhash.bands(signature, ROWS).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keyed[some].ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(digest[0]), pa.array(digest[1]), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _combined(batches):
    """Arrow function: (node, bands) to the buckets of ``combined``."""
    return combined((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(U64).reshape(-1, BANDS)) for batch in batches if batch.num_rows)


def _expand(width: int, word_class: str):
    """Function: texts to their distinct shingle hashes and rows."""
    table = byte_class(word_class)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        for rows, data, offsets in blocks(pa.RecordBatch.from_arrays([texts], ["text"])):
            grams, row = _sets(data, offsets, width, table)
            parts.append((grams, row + at))
            at += rows.num_rows
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, word_class: str = "space") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split into words (``word_class`` 'space': at ASCII white space;
    'alnum': runs of ASCII letters, digits and non-ASCII characters). A text's set holds its distinct
    ``width``-word shingles, or its whole word sequence if that is shorter. Texts link when the
    intersection is at least ``percent`` hundredths of the union, confirmed on the whole sets.

    Equal sets are first folded into one class. Classes meet in banded buckets of a densified
    one-permutation signature (30 bands of 6: a link at 0.85 is missed by all bands with odds under
    1e-6). A bucket gives star-shaped edges to its least class, not all pairs; ``bucket_links`` confirms
    them and finds the links that the choice of centre would lose.

    Null or wordless texts have n_shingles 0 and link with nothing. A null id keeps its row, with a
    null component, and links with nothing. Rows that repeat an id share its component; if several
    different texts of one id each lead their class, near links of that id are confirmed on one of
    them. An empty table gives no rows; extra columns are ignored.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(given.mapInArrow(_prepare(width, word_class), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    equal = ["d1", "d2", "n_shingles"]
    classes = usable.groupBy(equal).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    folded = cut(hub_join(usable, classes, equal, usable.count()).select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")))
    buckets = folded.where("bands is not null").select("rep", "bands").mapInArrow(_combined, BUCKETS)

    def bodies_of(nodes: DataFrame) -> DataFrame:
        texts = given.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        return texts.select(F.col("doc_id").alias("node"), F.col("text").alias("body")).dropDuplicates(["node"])

    links = bucket_links(buckets, bodies_of, _expand(width, word_class), percent)
    release(docs.sparkSession)
    twice = folded.groupBy("doc_id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    found = components(links.unionByName(folded.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("first").alias("b"))))
    placed = folded.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, less those whose component holds a smaller doc_id; of rows with one id, one stays."""
    kept = near_duplicates(docs, **options).where("kept").select("doc_id").distinct()
    some = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return some.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
