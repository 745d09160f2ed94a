"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for every term that the search asks for, the documents and the word positions where it occurs. A window
of test words is looked for from its rarest terms: a posting at position p of the term that stands at place q of an item
lies on the diagonal p - q, and lists intersect where they agree on document and diagonal. What is left is compared with
the text word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import NOT_ALNUM, columns, flat, slices, word_hashes
from aerolattice.runtime import pinned, shuffle_width

#: Test words that go to the tasks at once (8 bytes each); larger benchmarks are searched block by block.
BLOCK_WORDS = 1 << 20

#: Rarest terms of a window whose posting lists are intersected before the text is read.
RAREST = 3


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = flat(batch.column(1))
        hashes, at = word_hashes(data, places, NOT_ALNUM)
        blobs = [hashes[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["item", "words"])


@dataclass
class Block:
    """Items of one search: their ids, their words end to end, and the windows over them."""

    ids: list[str]
    words: np.ndarray
    places: np.ndarray
    size: int

    def __post_init__(self):
        counts = np.diff(self.places)
        self.window_items = np.repeat(np.arange(len(counts)), np.where(counts > 0, np.maximum(counts - self.size, 0) + 1, 0))
        first = np.searchsorted(self.window_items, np.arange(len(counts)))
        self.window_at = np.arange(len(self.window_items)) - first[self.window_items]
        self.window_size = np.minimum(counts, self.size)[self.window_items]
        self.terms = np.unique(self.words)

    def picks(self, counts: np.ndarray) -> list[list[int]]:
        """For each window the places in its item of its rarest different terms."""
        rank = np.searchsorted(self.terms, self.words)
        out = []
        for item, at, size in zip(self.window_items, self.window_at, self.window_size, strict=True):
            here = rank[self.places[item] + at : self.places[item] + at + size]
            order = np.lexsort((here, counts[here]))
            _, firsts = np.unique(here[order], return_index=True)
            out.append([int(at + order[i]) for i in np.sort(firsts)[:RAREST]])
        return out


def blocks(benchmark: DataFrame, id_column: str, text: str, size: int) -> Iterator[Block]:
    """Items in blocks of about BLOCK_WORDS words; items without words have no window and are left out."""
    rows = columns(benchmark, id_column, text)
    rows = rows.select(F.col(id_column).cast("string"), F.col(text).cast("string"))
    found = pinned(rows.mapInArrow(_item_words, "item string, words binary").where("octet_length(words) > 0"))
    ids, parts, held = [], [], 0
    for row in found.toLocalIterator():
        ids.append("" if row[0] is None else row[0])
        parts.append(np.frombuffer(row[1], np.uint64))
        held += len(parts[-1])
        if held >= BLOCK_WORDS:
            yield Block(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), size)
            ids, parts, held = [], [], 0
    if ids:
        yield Block(ids, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), size)


def _found(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `hashes` that hold one of the sorted terms, and which."""
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == hashes)
    return hit, at[hit]


def _frequencies(terms: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            data, places = flat(batch.column(0))
            for _, _, part, at in slices(data, places):
                hashes, _ = word_hashes(part, at, NOT_ALNUM)
                total += np.bincount(_found(terms, hashes)[1], minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    return count


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each test term occurs in all texts."""
    partial = docs.mapInArrow(_frequencies(terms), "term int, n bigint")
    out = np.zeros(len(terms), np.int64)
    for row in partial.groupBy("term").agg(F.sum("n")).collect():  # a row per test term at most
        out[row[0]] = row[1]
    return out


POSTINGS = "term int, doc_id bigint, positions binary"


def _postings(terms: np.ndarray, wanted: np.ndarray):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = terms[wanted], np.flatnonzero(wanted)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if batch.column(0).null_count == 0 else None
            names = batch.column(0).to_pylist() if ids is None else ids
            data, places = flat(batch.column(1))
            term_rows, doc_rows, lists = [], [], []
            for first, _, part, at in slices(data, places):
                hashes, starts = word_hashes(part, at, NOT_ALNUM)
                hit, term = _found(own, hashes)
                doc = np.searchsorted(starts, hit, "right") - 1
                order = np.lexsort((hit, term, doc))
                hit, term, doc = hit[order], term[order], doc[order]
                edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(hit) else hit
                spots = (hit - starts[doc]).astype("<i4").tobytes()
                ends = np.append(edge[1:], len(hit))[: len(edge)]  # none without a hit
                term_rows.append(back[term[edge]].astype(np.int32))
                doc_rows.append(doc[edge] + first)
                lists += [spots[4 * a : 4 * b] for a, b in zip(edge.tolist(), ends.tolist(), strict=True)]
            docs = np.concatenate(doc_rows) if doc_rows else np.zeros(0, int)
            owners = pa.array(ids[docs], pa.int64()) if ids is not None else pa.array([names[i] for i in docs], pa.int64())
            term_column = np.concatenate(term_rows) if term_rows else np.zeros(0, np.int32)
            yield pa.record_batch([pa.array(term_column), owners, pa.array(lists, pa.binary())], names=["term", "doc_id", "positions"])

    return post


def build_index(docs: DataFrame, terms: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """The postings of the wanted terms, written as a table; a term that most documents hold is split by document."""
    rows = docs.mapInArrow(_postings(terms, wanted), POSTINGS)
    width = shuffle_width(docs.sparkSession)
    return pinned(rows.repartition(width, "term", F.pmod(F.xxhash64("doc_id"), F.lit(16))))


def _aligner(spots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Postings to offset-adjusted ones: every place q of an item that asks for the term gives diagonal position - q."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, diagonals, places = [], [], [], []
            for i, (term, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                at = np.frombuffer(raw.as_py(), "<i4")
                item, q = spots[term]
                rows.append(np.full(len(at) * len(q), i))
                items.append(np.tile(item, len(at)))
                places.append(np.tile(q, len(at)))
                diagonals.append(np.repeat(at, len(q)) - places[-1])
            if not rows:
                continue
            owner = batch.column(1).take(pa.array(np.concatenate(rows)))
            out = [np.concatenate(x).astype(np.int32) for x in (items, diagonals, places)]
            yield pa.record_batch([owner, *map(pa.array, out)], names=["doc_id", "item", "diagonal", "q"])

    return align


def _chosen(block: Block, picks: list[list[int]]):
    """Windows whose rarest terms all lie on the diagonal."""
    by_item: dict[int, list[tuple[int, frozenset]]] = {}
    for item, at, places in zip(block.window_items.tolist(), block.window_at.tolist(), picks, strict=True):
        by_item.setdefault(item, []).append((at, frozenset(places)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, windows = [], []
            for i, (item, qs) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                have = set(qs)
                full = [at for at, places in by_item[item] if places <= have]
                if full:
                    keep.append(i)
                    windows.append(full)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [*part.columns[:3], pa.array(windows, pa.list_(pa.int32()))], names=["doc_id", "item", "diagonal", "windows"]
            )

    return choose


def candidates(postings: DataFrame, block: Block, picks: list[list[int]]) -> DataFrame:
    """doc_id, item, diagonal, windows: where all the rarest terms of a window stand as they do in the item."""
    rank = np.searchsorted(block.terms, block.words)
    pairs = {(item, q) for item, places in zip(block.window_items.tolist(), picks, strict=True) for q in places}
    spots: dict[int, list[tuple[int, int]]] = {}
    for item, q in sorted(pairs):
        spots.setdefault(int(rank[block.places[item] + q]), []).append((item, q))
    arrays = {t: tuple(np.array(x, np.int32) for x in zip(*rows, strict=True)) for t, rows in spots.items()}
    aligned = postings.mapInArrow(_aligner(arrays), "doc_id bigint, item int, diagonal int, q int")
    met = aligned.groupBy("doc_id", "item", "diagonal").agg(F.collect_set("q").alias("qs"))
    return met.mapInArrow(_chosen(block, picks), "doc_id bigint, item int, diagonal int, windows array<int>")


def _verifier(block: Block):
    item_words = [block.words[block.places[i] : block.places[i + 1]] for i in range(len(block.ids))]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            counts, spans, names, digests = [], [], [], []
            for first, end, part, at in slices(data, places):
                hashes, starts = word_hashes(part, at, NOT_ALNUM)
                counts += np.diff(starts).tolist()
                for row in range(first, end):
                    digests.append(hashlib.sha256(part[at[row - first] : at[row - first + 1]].tobytes()).digest())
                    asked = batch.column(2)[row].as_py() or []
                    words = hashes[starts[row - first] : starts[row - first + 1]]
                    found, items = [], set()
                    for ask in asked:
                        item = item_words[ask["item"]]
                        size = min(block.size, len(item))
                        for w in ask["windows"]:
                            s = ask["diagonal"] + w
                            if 0 <= s and s + size <= len(words) and np.array_equal(words[s : s + size], item[w : w + size]):
                                found.append((s, s + size))
                                items.add(ask["item"])
                    spans.append([{"start": a, "end": b} for a, b in sorted(set(found))])
                    names.append(sorted(block.ids[i] for i in items))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            found = [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string())), pa.array(digests, pa.binary())]
            yield pa.record_batch([batch.column(0), *found], names=["doc_id", "n_words", "spans", "items", "digest"])

    return verify


MATCHES = "doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, digest binary"


def _named(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = columns(docs, id_column, text)
    return rows.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def phrase_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """For every document and block of items: doc_id, n_words, spans of words in occurring windows, items that occur,
    digest of the text, number of the block from 0.

    A window is `size` consecutive words of an item, or all words of a shorter item. Null texts have no words; an empty
    benchmark gives each document once, without spans. Documents that share an id, or have none, are each matched by
    their own text. Equal items are all named; item ids are compared as strings, a null one as an empty string.
    """
    rows = _named(docs, id_column, text)
    found = None
    for number, block in enumerate(blocks(benchmark, item_id, item_text, size)):
        picks = block.picks(term_counts(rows.select("text"), block.terms))
        rank = np.searchsorted(block.terms, block.words)
        wanted = np.zeros(len(block.terms), bool)
        for item, places in zip(block.window_items, picks, strict=True):
            wanted[rank[block.places[item] + np.array(places)]] = True
        asked = candidates(build_index(rows, block.terms, wanted), block, picks)
        per_doc = asked.groupBy(F.col("doc_id").alias("_asked")).agg(F.collect_list(F.struct("item", "diagonal", "windows")).alias("_asks"))
        joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_asked")), "left").select("doc_id", "text", "_asks")
        here = joined.mapInArrow(_verifier(block), MATCHES).withColumn("block", F.lit(number))
        found = here if found is None else found.unionByName(here)
    if found is None:
        empty = Block([], np.zeros(0, np.uint64), np.zeros(1, np.int64), size)
        asks = F.lit(None).cast("array<struct<item:int,diagonal:int,windows:array<int>>>")
        found = rows.withColumn("_asks", asks).mapInArrow(_verifier(empty), MATCHES).withColumn("block", F.lit(0))
    return found


def _union_length(spans: list[dict]) -> int:
    covered, reach = 0, 0
    for span in sorted(spans, key=lambda x: (x["start"], x["end"])):
        covered += max(0, span["end"] - max(reach, span["start"]))
        reach = max(reach, span["end"])
    return covered


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words, spans, items = (batch.column(i) for i in range(4))
        hits = [_union_length(x) for x in spans.to_pylist()]
        names = [sorted(set(x)) for x in items.to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        bad = [h > 0 and 20 * h >= n for h, n in zip(hits, words.to_pylist(), strict=True)]
        counted = pa.array([len(x) for x in names], pa.int64())
        yield pa.record_batch(
            [ids, words, pa.array(hits, pa.int64()), counted, pa.array(digest, pa.string()), pa.array(bad, pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


JUDGED = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit).

    See `phrase_matches` for nulls and repeats. Each row is judged by its own text, however many blocks the benchmark needs.
    """
    total = columns(benchmark, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = phrase_matches(docs, benchmark, size, id_column, text)
    names = ["doc_id", "n_words", "spans", "items"]
    if total >= BLOCK_WORDS:  # each word has a byte at least, so fewer bytes are one block
        # rows that repeat id and text are found alike in each block, so sets do not grow with them
        merged = found.groupBy("doc_id", "digest").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.flatten(F.collect_set("items")).alias("items"),
            F.count_if(F.col("block") == 0).cast("int").alias("copies"),
        )
        found = merged.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return found.select(*names).mapInArrow(_judge, JUDGED)
