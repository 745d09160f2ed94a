"""Exact deduplication over cuckoo-filter indexes of live digests.

Every task keeps an index of the digests it holds. A fingerprint hit is verified against the full digest and length kept
in the hit's bucket; a copy with a larger id deletes the live digest of the row it replaces and is inserted instead; an
insertion that finds no place after `KICKS` moves doubles the table and refills it from the stored keys. Tasks first
index their own rows, so a group of copies reaches the shuffle as one row per task, then the digests meet by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from aerolattice.llm.bytetext import columns
from aerolattice.runtime import pinned

SLOTS = 4
KICKS = 64

#: A digest that more than one in HOT_SHARE rows carry is looked up by broadcast: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints over buckets of `SLOTS`; every slot knows its key, so hits can be verified."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.values: list[list] = []
        self.free: list[int] = []
        self.false_hits = self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = [0] * (buckets * SLOTS)
        self.rows = [-1] * (buckets * SLOTS)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets; the second follows from the first and the fingerprint, and back."""
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, key: bytes) -> int:
        mark, *both = self._place(key)
        for bucket in both:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark:
                    if self.keys[self.rows[slot]] == key:
                        return slot
                    self.false_hits += 1
        return -1

    def find(self, key: bytes) -> list | None:
        slot = self._slot(key)
        return None if slot < 0 else self.values[self.rows[slot]]

    def insert(self, key: bytes, value: list) -> None:
        if self.free:
            row = self.free.pop()
            self.keys[row], self.values[row] = key, value
        else:
            row = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        if not self._settle(row):
            self._resize()

    def delete(self, key: bytes) -> list | None:
        """Take a live digest out; other digests, also those with the same fingerprint, stay."""
        slot = self._slot(key)
        if slot < 0:
            return None
        row = self.rows[slot]
        self.marks[slot], self.rows[slot] = 0, -1
        self.keys[row] = None
        self.free.append(row)
        return self.values[row]

    def _settle(self, row: int) -> bool:
        mark, *both = self._place(self.keys[row])
        bucket = both[0]
        for bucket in both:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.rows[slot] = mark, row
                    return True
        for turn in range(KICKS):
            slot = bucket * SLOTS + (turn + mark) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.rows[slot], row = row, self.rows[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.rows[slot] = mark, row
                    return True
        return False

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._settle(row) for row, key in enumerate(self.keys) if key is not None):
                return

    def live(self) -> Iterator[tuple[bytes, list]]:
        return ((key, self.values[row]) for row, key in enumerate(self.keys) if key is not None)


def _later(a, b):
    return a if b is None or (a is not None and a >= b) else b


def _merge(index: CuckooIndex, key: bytes, row_id, size: int, repeats: int) -> None:
    """Take rows of one digest into the index; the largest id is the live one, and no id is smaller than any."""
    old = index.find(key)
    if old is None:
        index.insert(key, [row_id, size, repeats])
    elif row_id == old[0]:
        old[1] += size
        old[2] += repeats
    elif _later(row_id, old[0]) == row_id:
        index.delete(key)
        index.insert(key, [row_id, size + old[1], repeats])
    else:
        old[1] += size


SUMMARY = "digest binary, keep_id bigint, group_size bigint, repeats bigint"
SUMMARY_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("repeats", pa.int64())])


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = list(index.live())
    for at in range(0, len(live), 10_000):
        part = live[at : at + 10_000]
        yield pa.record_batch(
            [pa.array([k for k, _ in part], pa.binary()), *[pa.array([v[i] for _, v in part], pa.int64()) for i in range(3)]],
            schema=SUMMARY_ARROW,
        )


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for row_id, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _merge(index, key, row_id, 1, 1)
    yield from _emit(index)


def _index_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for key, row_id, size, repeats in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            _merge(index, key, row_id, size, repeats)
    yield from _emit(index)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        digests = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in texts]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased; no text counts as an empty one."""
    rows = columns(docs, id_column, text).toDF("doc_id", "text")
    return rows.mapInArrow(_digest, "doc_id bigint, digest binary")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept, repeats.

    Texts are equal if they are once A-Z is lower-cased; of equal texts the row with the largest id stays. A null text is
    an empty one; empty texts are a group like any other. A row without id counts in its group and gives way to any row
    that has one; if none has, keep_id is null and the rows count as kept. Rows that repeat the id that stays are all
    marked kept; `repeats` says how many there are. Other columns are not read. An empty table gives no rows.
    """
    rows = pinned(digests(docs, id_column, text))
    index = pinned(rows.mapInArrow(_index_rows, SUMMARY).repartition("digest").mapInArrow(_index_summaries, SUMMARY))
    total = index.agg(F.sum("group_size")).first()[0] or 0
    grouped = index.where("group_size > 1")
    hot = F.broadcast(grouped.where(F.col("group_size") * HOT_SHARE > total))
    common = grouped.where(F.col("group_size") * HOT_SHARE <= total)
    wide = rows.join(hot, "digest", "left")
    found = wide.where("group_size IS NOT NULL")
    rest = wide.where("group_size IS NULL").select("digest", "doc_id").join(common, "digest", "left")
    single = F.col("group_size").isNull()
    one = F.lit(1).cast("bigint")
    return (
        found.select(*rest.columns)
        .unionByName(rest)
        .select(
            "doc_id",
            "digest",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", one).alias("group_size"),
            F.coalesce("repeats", one).alias("repeats"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )


def _mark(width: int, text_at: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            keys = pa.array([hashlib.sha256((x.as_py() or b"").lower()).digest() for x in texts], pa.binary())
            yield pa.record_batch([*batch.columns, keys], names=[f"_c{i}" for i in range(width)] + ["_key"])

    return mark


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of equal texts.

    Rows are matched by digest and, null-safely, by id; of rows that repeat both, one stays.
    """
    kept = pinned(exact_dedup(docs, id_column, text).where("kept").select("doc_id", "digest", "repeats").distinct())
    names, width = docs.columns, len(docs.columns)
    spread = docs.toDF(*[f"_c{i}" for i in range(width)])
    at = names.index(id_column)
    schema = StructType([*spread.schema.fields, StructField("_key", BinaryType())])
    marked = spread.mapInArrow(_mark(width, names.index(text)), schema)
    same = (F.col("_key") == F.col("digest")) & F.col(f"_c{at}").eqNullSafe(F.col("doc_id"))
    once = marked.join(kept.where("repeats = 1"), same, "left_semi")
    again = marked.join(kept.where("repeats > 1"), same, "left_semi").dropDuplicates([f"_c{at}", "_key"])
    return once.unionByName(again).drop("_key").toDF(*names)
