"""Cross-tokenizer alignment by inverted pair bitmaps.

Every text is spelled by two vocabularies, a byte-level one and one of pieces. Byte offsets where a token of both ends cut
the text into groups, and the two tokens that end there are linked. For every pair of ids the documents that link it are
kept as compressed bitmaps by block of documents, with planes for how often: plane k holds the documents in whose number
of further links bit k is set. OR-merged bitmaps and popcounts give the documents and links of a pair, and its postings
carry that count back to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import columns
from aerolattice.llm.packing import tokenizer
from aerolattice.runtime import pinned

#: Documents of a block, so that a place in it is a 16-bit number, and the bytes of a full bitmap over them.
BLOCK = 1 << 15
FULL = BLOCK // 8
#: A block is closed beyond so many (pair, document) entries, and texts are aligned together up to so many bytes.
ENTRIES = 1 << 21
SLICE = 1 << 20

DOCS = "block bigint, slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
INDEX = "a int, b int, docs binary, planes array<binary>, n_docs bigint, n_pair_links bigint"
SCHEMA = pa.schema(
    [("block", pa.int64()), ("slot", pa.int32())]
    + [(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.binary())]
    + [("planes", pa.list_(pa.binary())), ("n_docs", pa.int64()), ("n_pair_links", pa.int64())]
)


class Speller:
    """Ids of a text under both vocabularies, and the bytes of every id.

    The byte-level vocabulary spells a space and the text, that of pieces the text, before which it puts a space itself.
    """

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import sentencepiece

        self.first = tokenizer(byte_vocabulary, plain=True)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        vocabulary = self.first.inner.get_vocab(with_added_tokens=True)
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a, self.b)]
        size = max(len(self.a), len(self.b))
        self.digits = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(size)]
        self.size = size

    def spell(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both id sequences; none where the text is empty or either one's bytes are not a space and the text."""
        if text:
            want = b" " + text.encode()
            a = self.first.encode(" " + text)
            b = self.second.encode(text, num_threads=1)
            if b"".join(map(self.b.__getitem__, b)) == want and b"".join(map(self.a.__getitem__, a.tolist())) == want:
                return a.astype(np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


_spellers: dict[tuple[str, str], Speller] = {}


def speller(*paths: str) -> Speller:
    if paths not in _spellers:
        _spellers[paths] = Speller(*paths)
    return _spellers[paths]


class Aligned:
    """Texts spelled both ways and laid end to end: ids, the places where both end, and the group of every token."""

    def __init__(self, spell: Speller, texts: list[str | None]):
        spelled = [spell.spell(t) for t in texts]
        self.ids = [np.concatenate([s[k] for s in spelled]) if spelled else np.zeros(0, np.int64) for k in (0, 1)]
        self.counts = [np.array([len(s[k]) for s in spelled], np.int64) for k in (0, 1)]
        ends = [np.cumsum(spell.sizes[k][self.ids[k]]) for k in (0, 1)]
        self.ends = np.intersect1d(*ends, assume_unique=True)
        self.linked = [np.searchsorted(e, self.ends) for e in ends]
        self.group = [np.searchsorted(self.ends, e) for e in ends]
        owner = np.repeat(np.arange(len(texts)), self.counts[0])
        self.owner = owner[self.linked[0]]
        self.groups = np.bincount(self.owner, minlength=len(texts))

    def written(self, spell: Speller) -> Iterator[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        last = [np.zeros(len(ids), bool) for ids in self.ids]
        for k in (0, 1):
            last[k][self.linked[k]] = True
        final = np.zeros_like(last[1])
        tops = np.cumsum(self.counts[1])
        final[tops[self.counts[1] > 0] - 1] = True
        marks = [np.where(last[0], 1, 0), np.where(final, 3, np.where(last[1], 2, 0))]
        codes = np.concatenate([ids + spell.size * mark for ids, mark in zip(self.ids, marks, strict=True)])
        keys = np.concatenate([2 * self.group[0], 2 * self.group[1] + 1])
        codes = codes[np.argsort(keys, kind="stable")].tolist()
        at = 0
        for n in (self.counts[0] + self.counts[1]).tolist():
            yield "".join(map(spell.digits.__getitem__, codes[at : at + n]))
            at += n


def containers(cells: np.ndarray, slots: np.ndarray, count: int) -> tuple[pa.Array, np.ndarray]:
    """One compressed bitmap per cell, and its popcount: 16-bit places in order, or a full bitmap where that is smaller.

    `cells` and the places within each are sorted. Only a full bitmap has FULL bytes.
    """
    held = np.bincount(cells, minlength=count)
    dense = 2 * held >= FULL
    sizes = np.where(dense, FULL, 2 * held)
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = np.zeros(places[-1], np.uint8)
    light = ~dense[cells]
    if light.all():
        out[:] = slots.astype("<u2").view(np.uint8)
    else:
        at = places[cells[light]] + 2 * (np.arange(len(cells)) - (np.cumsum(held) - held)[cells])[light]
        low = slots[light].astype("<u2")
        out[at], out[at + 1] = low & 255, low >> 8
        for cell in np.flatnonzero(dense):
            bits = np.zeros(BLOCK, bool)
            bits[slots[np.searchsorted(cells, cell) : np.searchsorted(cells, cell, "right")]] = True
            out[places[cell] : places[cell + 1]] = np.packbits(bits)
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(places), pa.py_buffer(out)]), held


def opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all bits of a column of containers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(places)
    light = np.repeat(sizes != FULL, sizes)
    inside = whole[places[0] : places[-1]]
    rows, slots = [np.repeat(np.arange(len(sizes)), np.where(sizes != FULL, sizes // 2, 0))], [inside[light].view("<u2")]
    for row in np.flatnonzero(sizes == FULL):
        bits = np.flatnonzero(np.unpackbits(whole[places[row] : places[row + 1]]))
        rows.append(np.full(len(bits), row))
        slots.append(bits)
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def _rows(kind: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(kind.values())))
    return pa.record_batch([kind[f.name].cast(f.type) if f.name in kind else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


class BlockIndex:
    """The pair index of one block of documents, filled slice by slice."""

    def __init__(self, number: int):
        self.number, self.documents, self.entries = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray, slots: np.ndarray, documents: int) -> None:
        keys, times = np.unique((a << 40) | (b << 16) | (slots + self.documents), return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.documents += documents
        self.entries += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Bitmaps of the slices OR-merged (no document is in two slices), a row per pair."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        pairs, cells = np.unique(keys >> 16, return_inverse=True)
        slots = keys & 0xFFFF
        docs, held = containers(cells, slots, len(pairs))
        deepest = np.zeros(len(pairs), np.int64)
        np.maximum.at(deepest, cells, times - 1)
        depth = np.where(deepest > 0, np.floor(np.log2(np.maximum(deepest, 1))).astype(np.int64) + 1, 0)
        first = np.concatenate([[0], np.cumsum(depth)])
        more = [(cells[:0], slots[:0])]
        for k in range(int(depth.max())):
            bit = np.flatnonzero((times - 1) >> k & 1)
            more.append((first[cells[bit]] + k, slots[bit]))
        plane, place = (np.concatenate(x) for x in zip(*more, strict=True))
        order = np.lexsort((place, plane))
        bitmaps, popcounts = containers(plane[order], place[order], int(first[-1]))
        planes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), bitmaps)
        weights = popcounts << (np.arange(first[-1]) - np.repeat(first[:-1], depth))
        total = np.concatenate([[0], np.cumsum(weights)])
        links = held + total[first[1:]] - total[first[:-1]]
        made = {"block": np.full(len(pairs), self.number), "a": pairs >> 24, "b": pairs & 0xFFFFFF, "n_docs": held, "n_pair_links": links}
        yield _rows({name: pa.array(x) for name, x in made.items()} | {"docs": docs, "planes": planes})


def _aligner(paths: tuple[str, str]):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(*paths)
        base = TaskContext.get().partitionId() << 32
        index = BlockIndex(base)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum([0, *(len(t.as_py() or "") + 1 for t in texts)])
            first = 0
            while first < len(batch):
                end = max(first + 1, int(np.searchsorted(sizes, sizes[first] + SLICE, "right")) - 1)
                end = min(end, first + BLOCK)
                if index.documents + end - first > BLOCK or index.entries > ENTRIES:
                    yield from index.rows()
                    index = BlockIndex(index.number + 1)
                found = Aligned(spell, texts[first:end].to_pylist())
                written = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.written(spell)]
                numbers = {"n_a": found.counts[0], "n_b": found.counts[1], "n_groups": found.groups, "n_links": found.groups}
                numbers |= {"block": np.full(end - first, index.number), "slot": index.documents + np.arange(end - first)}
                rows = {name: pa.array(x) for name, x in numbers.items()}
                yield _rows(rows | {"doc_id": ids[first:end], "groups_sha256": pa.array(written, pa.string())})
                linked = [ids_[at] for ids_, at in zip(found.ids, found.linked, strict=True)]
                index.add(*linked, found.owner, end - first)
                first = end
        if index.documents:
            yield from index.rows()

    return align


def pair_index(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, postings): a row per input row with its place in a block, and a row per block and pair with its bitmaps."""
    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    made = pinned(rows.mapInArrow(_aligner((byte_vocabulary, piece_model)), f"{DOCS}, {INDEX}"))
    documents = made.where("slot IS NOT NULL").select(*[x.split()[0] for x in DOCS.split(", ")])
    return documents, made.where("slot IS NULL").select("block", *[x.split()[0] for x in INDEX.split(", ")])


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, documents, links, best (no other a has more links with b) of every pair, summed over its blocks' popcounts.

    The pairs of one b are no more than the first vocabulary has entries.
    """
    pairs = pinned(postings.groupBy("a", "b").agg(F.sum("n_docs").alias("documents"), F.sum("n_pair_links").alias("links")))
    top = pairs.groupBy("b").agg(F.max("links").alias("_top"))
    return pairs.join(top, "b").select("a", "b", "documents", "links", (F.col("links") == F.col("_top")).alias("best"))


SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _score(table: pa.Table) -> pa.Table:
    """One block: every pair's postings add its count, as often as it is linked, to the documents' sums."""
    is_doc = table.column("slot").is_valid()
    documents, pairs = table.filter(is_doc), table.filter(table.column("a").is_valid())
    sums, best = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    links = pairs.column("links").to_numpy()
    top = pairs.column("best").to_numpy().astype(np.int64)

    def carry(rows: np.ndarray, slots: np.ndarray, times: np.ndarray | int) -> None:
        np.add.at(sums, slots, links[rows] * times)
        np.add.at(best, slots, top[rows] * times)

    carry(*opened(pairs.column("docs")), 1)
    planes = pairs.column("planes").combine_chunks() if len(pairs) else pa.array([], pa.list_(pa.binary()))
    if len(planes):
        depth = planes.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(planes)), depth)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
        rows, slots = opened(planes.flatten())
        carry(owner[rows], slots, np.int64(1) << level[rows])
    slot = documents.column("slot").to_numpy()
    found = {"n_best": pa.array(best[slot]), "count_sum": pa.array(sums[slot])}
    return pa.table({name: found[name] if name in found else documents.column(name) for name in (x.split()[0] for x in SCORED.split(", "))})


def alignment(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that a vocabulary does not spell back, have no tokens: zeros and ''. Repeated rows count
    each; a null id stays null. Columns other than the two named are not read, and no rows give no rows. A block holds at
    most BLOCK documents and some ENTRIES entries (or those of one longer text), so its postings meet in one task.
    """
    documents, postings = pair_index(docs, byte_vocabulary, piece_model, id_column, text)
    known = postings.join(pair_counts(postings), ["a", "b"]).select("block", "a", "docs", "planes", "links", "best")
    rows = documents.unionByName(known, allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(_score, SCORED)


GROUPS = "doc_id bigint, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>"


def aligned_groups(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups themselves: byte offsets in a space and the text, and the ids of both vocabularies in order."""
    paths = (byte_vocabulary, piece_model)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(*paths)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for row in range(len(batch)):
                found = Aligned(spell, [batch.column(1)[row].as_py()])
                cuts = [np.split(ids, at[:-1] + 1) if len(at) else [] for ids, at in zip(found.ids, found.linked, strict=True)]
                starts = [0, *found.ends[:-1].tolist()]
                made = [
                    {"start": s, "end": e, "a": a.tolist(), "b": b.tolist()}
                    for s, e, a, b in zip(starts, found.ends.tolist(), *cuts, strict=False)
                ]
                yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([made], kind)], names=["doc_id", "groups"])

    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(groups, GROUPS)
