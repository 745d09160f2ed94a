"""Filter interaction audit by truth-table survival words.

Five filters have 32 subsets. A document becomes a 32-bit word whose bit S says that it survives every filter of subset S.
Tasks add words up with carry-save adders: three words of one weight become a sum of that weight and a carry of the next,
so a batch of any length ends as a few words whose bits are read once. All that is asked of any order of the filters is
then a difference of the survivors of two subsets; nothing is counted order by order over documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import columns
from aerolattice.llm.lookup import with_group
from aerolattice.runtime import pinned

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
COPY = FILTERS.index("E")

#: Fixed values of the filters: least words, least share of distinct words, most share of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The word of a document by the bits of the filters that it fails.
WORD = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def text_failures(text: str) -> int:
    """Bits of the filters A to D that a text fails. Words lie between ASCII blanks, as `bytes.split` has them."""
    data = text.encode()
    words = data.split()
    few = len(words) < LEAST_WORDS
    repetitive = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)
    return few | repetitive << 1 | loud << 2 | (SYMBOLS.search(data) is not None) << 3


FAILURES = "doc_id bigint, part string, text_key binary, failed int"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, failed = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            failed.append(text_failures(text))
        facts = [pa.array(keys, pa.binary()), pa.array(failed, pa.int32())]
        yield pa.record_batch([*batch.columns[:2], *facts], names=["doc_id", "part", "text_key", "failed"])


def failures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, failed (bits in the order of FILTERS) of every row.

    A text is a copy if any row with a smaller id holds the same; a row without id is neither a copy nor the first of one.
    Only the 128-bit keys of texts move, folded by task before they are shuffled; groups that hold much of the table are
    broadcast to the rows, which stay where they are.
    """
    rows = columns(docs, id_column, text, part)
    rows = rows.select(F.col(id_column).cast("bigint"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col(text).cast("string"))
    judged = pinned(rows.mapInArrow(_judge, FAILURES))
    same = judged.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows"))
    found = with_group(judged, pinned(same.where("_rows > 1")), "text_key", "_rows")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int") * (1 << COPY)
    return found.select("doc_id", "part", (F.col("failed") + copy).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame, marks: dict[str, tuple[str, int]], id_column: str = "doc_id") -> DataFrame:
    """Rows with a boolean per mark (name: label column and its value); an id that is labelled twice has what either says."""
    plain = columns(labels, id_column, *[c for c, _ in marks.values()])
    flags = [F.max(F.coalesce(F.col(c) == v, F.lit(False))).alias(name) for name, (c, v) in marks.items()]
    known = plain.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("doc_id")).agg(*flags)
    found = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select(*rows.columns, *marks)
    found = found.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    return found.fillna(False, subset=list(marks))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save adders."""
    counts, places, weight = np.zeros(32, np.int64), np.arange(32, dtype=np.uint32), 1
    while len(words):
        carries = [words[:0]]
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        for word in words:
            counts += ((word >> places) & np.uint32(1)).astype(np.int64) * weight
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def _adder(marks: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            part = parts.indices.to_numpy()
            words = WORD[batch.column(1).to_numpy()]
            groups = part.astype(np.int64) << marks
            for k in range(marks):
                groups |= batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) << k
            order = np.argsort(groups, kind="stable")
            found, starts = np.unique(groups[order], return_index=True)
            counts = [positional_counts(w) for w in np.split(words[order], starts[1:])] if len(found) else []
            names = parts.dictionary.take(pa.array(found >> marks))
            kinds = pa.array((found & ((1 << marks) - 1)).astype(np.int32))
            yield pa.record_batch([names, kinds, pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], names=["part", "kind", "counts"])

    return add


def survivors(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Per part: `survivors` and one more array per mark, each with the rows that survive every subset of filters."""
    words = rows.select("part", "failed", *marks)
    added = words.mapInArrow(_adder(len(marks)), "part string, kind int, counts array<bigint>")
    kinds = [("survivors", F.lit(True))] + [(m, F.col("kind").bitwiseAND(1 << k) > 0) for k, m in enumerate(marks)]
    sums = [F.sum(F.when(held, F.get("counts", s)).otherwise(0)).alias(f"_{name}{s}") for name, held in kinds for s in range(SUBSETS)]
    total = added.groupBy("part").agg(*sums)
    return total.select("part", *[F.array(*[f"_{name}{s}" for s in range(SUBSETS)]).alias(name) for name, _ in kinds])


def _shapley(letter: int) -> Column:
    """Rows that the filter removes, summed over all orders: each subset before it stands for the orders it is followed in."""
    bit, n, total = 1 << letter, len(FILTERS), F.lit(0)
    for before in (s for s in range(SUBSETS) if not s & bit):
        ways = math.factorial(before.bit_count()) * math.factorial(n - 1 - before.bit_count())
        total = total + ways * (F.get("survivors", before) - F.get("survivors", before | bit))
    return total.cast("bigint")


def audit(counted: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Every order of the filters and every step of it, for each part of `survivors`; `marks` names the losses by mark."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    before, after, letter = [], [], []
    for order in orders:
        done = 0
        for x in order:
            before.append(done)
            letter.append(FILTERS.index(x))
            done |= 1 << letter[-1]
            after.append(done)
    n = len(FILTERS)
    values = F.array(*[_shapley(k) for k in range(n)]).alias("_values")
    rows = counted.select("*", values, F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))).alias("_at"))

    def fixed(items: list) -> Column:
        return F.get(F.array(*map(F.lit, items)), F.col("_at"))

    rows = rows.withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), F.floor(F.col("_at") / n).cast("int")))
    rows = rows.select("*", fixed(before).alias("_before"), fixed(after).alias("_after"), fixed(letter).alias("_letter"))

    def at(name: str, subset: str | Column) -> Column:
        return F.get(name, F.col(subset) if isinstance(subset, str) else subset)

    bit = F.lit(1).cast("int") * F.pow(2, F.col("_letter")).cast("int")
    removed = at("survivors", "_before") - at("survivors", "_after")
    return rows.select(
        "part",
        "filter_order",
        (F.col("_at") % n + 1).cast("int").alias("step"),
        at("survivors", "_after").alias("kept"),
        removed.alias("removed"),
        (at("survivors", F.lit(0)) - at("survivors", bit) - removed).alias("redundant"),
        (at("survivors", F.lit(ALL) - bit) - at("survivors", F.lit(ALL))).alias("unique_fails"),
        *[(at(mark, "_before") - at(mark, "_after")).alias(name) for mark, name in marks.items()],
        F.get("_values", F.col("_letter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every row is judged by its whole text and counts by itself, repeated rows too; a null text is empty, a null part is the
    part '', and rows without id or label are in no loss. Only the columns named are read. No rows give no parts.
    """
    rows = labelled(failures(docs, id_column, text, part), labels, {"_good": ("quality", 1), "_toxic": ("toxic", 1)}, id_column)
    return audit(survivors(rows, ["_good", "_toxic"]), {"_good": "good_lost", "_toxic": "toxic_lost"})
