"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search, with full strings against collisions."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import cut

# The stated rules, host and path in one string.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
# The method's own list, a file beside this one: hosts of advertising and tracking, blocked with all subdomains.
LISTED = tuple(f"{line}/" for line in files(__package__).joinpath("listed_hosts.txt").read_text().splitlines() if line and not line.startswith("#"))
#: A list of up to so many bytes is one array that each executor maps; a larger one is dealt into arrays of that size,
#: and what is looked up goes to the array that may hold it.
MOST_BYTES = 64 << 20


class DigestArray:
    """Sorted xxhash64 keys in one file, full strings and their starts in two more; all are memory-mapped."""

    PARTS = ("keys", "starts", "strings")

    def __init__(self, folder: str, name: str):
        self.keys, self.starts, self.strings = (np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r") for part in self.PARTS)

    @staticmethod
    def packed(strings: list[str]) -> dict[str, bytes]:
        """The three files' contents."""
        entries = sorted((xxhash.xxh64_intdigest(s), s) for s in {x.encode() for x in strings})
        arrays = {
            "keys": np.array([k for k, _ in entries], dtype=np.uint64),
            "starts": np.cumsum([0, *(len(s) for _, s in entries)]),
            "strings": np.frombuffer(b"".join(s for _, s in entries), dtype=np.uint8),
        }
        out = {}
        for part, array in arrays.items():
            np.save(file := io.BytesIO(), array)
            out[part] = file.getvalue()
        return out

    @classmethod
    def write(cls, folder: str, name: str, strings: list[str]) -> None:
        cls.unpack(folder, name, cls.packed(strings))

    @staticmethod
    def unpack(folder: str, name: str, files: dict[str, bytes]) -> None:
        for part, content in files.items():
            with open(own := os.path.join(folder, f"{name}.{part}.{uuid.uuid4().hex}"), "wb") as file:
                file.write(content)
            os.replace(own, os.path.join(folder, f"{name}.{part}.npy"))

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The number of each probe's entry, or -1; equal digests of other strings don't count."""
        digests = np.array([xxhash.xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(probes), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests) if len(self.keys) else []):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.strings[self.starts[k] : self.starts[k + 1]].tobytes() == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def text(self, k: int) -> str:
        return self.strings[self.starts[k] : self.starts[k + 1]].tobytes().decode()


@lru_cache(maxsize=4)
def _opened(name: str, shared) -> DigestArray:
    """The broadcast array, written once to the executor's own working folder and mapped by all its tasks."""
    folder = SparkFiles.getRootDirectory()
    if not all(os.path.exists(os.path.join(folder, f"{name}.{part}.npy")) for part in DigestArray.PARTS):
        DigestArray.unpack(folder, name, shared.value)
    return DigestArray(folder, name)


def _probes(hosts: pa.Array, paths: pa.Array, lengths: tuple[int, ...]) -> Iterator[pa.Array]:
    """For each parent domain, the host first, and each length: domain and start of the path as one string, null where there is none."""
    size = pc.utf8_length(paths)
    starts = [pc.if_else(pc.greater_equal(size, n), pc.utf8_slice_codeunits(paths, 0, n), None) for n in lengths]
    domain = hosts
    while domain.null_count < len(domain):
        for start in starts:
            yield pc.binary_join_element_wise(domain, start, "")
        domain = pc.if_else(pc.match_substring(domain, "."), pc.replace_substring_regex(domain, r"^[^.]*\.", ""), None)


def _look_up(array: DigestArray, probes: pa.Array) -> np.ndarray:
    """The number of each probe's entry, or -1; each distinct string is digested once."""
    coded = pc.dictionary_encode(probes)
    found = np.append(array.find([p.encode() for p in coded.dictionary.to_pylist()]), -1)
    return found[pc.fill_null(coded.indices, len(found) - 1).to_numpy(zero_copy_only=False)]


def _judge(name: str, shared, lengths: tuple[int, ...], verdicts: dict[str, str]):
    def run(batches):
        array = _opened(name, shared)
        rules = sorted(verdicts, key=len)
        number = array.find([r.encode() for r in rules])
        names, says = pa.array([*rules, None], pa.string()), pa.array([*(verdicts[r] for r in rules), None], pa.string())
        for batch in batches:
            hosts, paths = (batch.column(i).cast(pa.string()) for i in (1, 2))
            best, listed = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, dtype=bool)
            for probes in _probes(hosts, paths, lengths):
                found = _look_up(array, probes)
                for i, k in enumerate(number):  # the rules, the longest last
                    best[(found == k) & (best < i)] = i
                listed |= (found >= 0) & ~np.isin(found, number)
            which = pa.array(np.where(best < 0, len(rules), best))
            verdict = pc.coalesce(says.take(which), pa.array(np.where(listed, "block", "allow")))
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(which), verdict], [*batch.schema.names, "rule", "verdict"])

    return run


def _in_share(key, entries: pa.Table, probes: pa.Table) -> pa.Table:
    """One share of a large list: the probes that it holds, by its own mapped array."""
    folder, name = SparkFiles.getRootDirectory(), f"share-{uuid.uuid4().hex}"
    DigestArray.write(folder, name, entries.column("entry").to_pylist())
    array = DigestArray(folder, name)
    for part in DigestArray.PARTS:
        os.remove(os.path.join(folder, f"{name}.{part}.npy"))  # the maps stay open
    found = _look_up(array, probes.column("entry").combine_chunks())
    return probes.select(["host", "path"]).filter(pa.array(found >= 0))


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path); a null url, or one without '://', has both empty."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, listed: DataFrame | tuple[str, ...] = LISTED, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A url's host runs from after its first '://' to '/', '?', '#' or the end, with A-Z lower-cased; its
    path from there to '?', '#' or the end. A rule, host and path in one string, fits its host and all
    subdomains if the url's path starts with the rule's; of several the longest wins. ``rule`` is that
    rule, or null, and ``verdict`` its verdict; without a rule the verdict is 'block' if an entry of
    ``listed``, of the same form, fits, else 'allow'.

    Entries are looked up by all parent domains of the host and all path lengths that entries have, in a
    sorted array of 64-bit digests, memory-mapped, by binary search, with the full string against collisions.
    ``listed`` may be a table of one string column (null and repeated entries are skipped). Up to
    ``most_bytes`` it goes into one array, which is broadcast; a larger one is dealt by hashed entry into
    arrays of about that size, and the distinct look-ups go to the array that may hold them.

    A null url, or one without '://', has an empty host and path, which no entry with a host fits. Null ids
    and repeated rows keep a row each; an empty table gives none; other columns are ignored.
    """
    spark, rest = pages.sparkSession, None
    if isinstance(listed, DataFrame):
        column = cut(listed.select(F.col(listed.columns[0]).alias("entry")).where("entry is not null").distinct())
        total = column.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
        listed, rest = (tuple(r["entry"] for r in column.collect()), None) if total <= most_bytes else ((), column)
    entries = [*rules, *listed]
    lengths = tuple(sorted({len(e) - e.find("/") if "/" in e else 0 for e in entries}))
    shared = spark.sparkContext.broadcast(DigestArray.packed(entries))
    rows = parsed(pages, id_col, url_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    judged = rows.mapInArrow(_judge(f"urls-{uuid.uuid4().hex}", shared, lengths, dict(rules)), f"page_id {kind}, host string, path string, rule string, verdict string")
    if rest is None:
        return judged
    sizes = tuple(r["n"] for r in rest.select(F.when(F.instr("entry", "/") > 0, F.length("entry") - F.instr("entry", "/") + 1).otherwise(0).alias("n")).distinct().collect())
    asked = rows.select("host", "path").distinct().mapInArrow(_asked(sizes), "host string, path string, entry string")
    shares = F.lit(1 + total // max(most_bytes, 1 << 16) + asked.count() // SHARE_PROBES)
    dealt = lambda df: df.withColumn("share", F.pmod(F.xxhash64("entry"), shares)).groupBy("share")
    hit = dealt(rest).cogroup(dealt(asked)).applyInArrow(_in_share, "host string, path string").distinct().withColumn("hit", F.lit(True))
    return judged.join(hit, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull() & F.col("hit"), "block").otherwise(F.col("verdict")).alias("verdict"))


#: Look-ups that meet one share of a large list.
SHARE_PROBES = 1 << 20


def _asked(sizes: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            hosts, paths = (batch.column(i).cast(pa.string()) for i in (0, 1))
            for probes in _probes(hosts, paths, sizes):
                some = pc.is_valid(probes)
                yield pa.RecordBatch.from_arrays([x.filter(some) for x in (hosts, paths, probes)], ["host", "path", "entry"])

    return run


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
