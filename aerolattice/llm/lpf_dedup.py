"""Removal of repeated passages with longest-previous-factor arrays, distributed by content.

Every window of `length` bytes has one anchor: the leftmost of its smallest hashed grams. Equal windows have equal anchors at
equal places, so windows only have to meet where their anchor's gram is dealt. There, stretches around an anchor that are
equal throughout stand behind the one of the smallest document. Stretches that differ are put into suffix order; a
suffix whose previous or next smaller position (of a smaller document) shares `length` bytes with it has an earlier copy,
and the bytes it covers go. The first copy of everything stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import U, columns, flat, mix, powers, prefix_hashes, slices, span_hashes
from aerolattice.runtime import pinned, shuffle_width

GRAM = 16
#: Windows whose anchors are looked for at once.
STEP = 1 << 16
#: Different stretches around one gram beyond which they are dealt window by window instead of by the gram.
CROWDED = 4096
#: Windows put into suffix order at once, in whole groups.
SORTED_AT_ONCE = 1 << 19
#: Bytes of text whose stretches are dealt at once.
DEALT_AT_ONCE = 4 << 20

ROWS = "bucket int, kind int, head binary, body binary, text binary"
NAMES = ["bucket", "kind", "head", "body", "text"]
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in NAMES[2:]]])
ANCHOR, REMOVED, CHECK, TEXT, STRETCH = range(5)

#: What a row's body holds, one array after the other. `doc` counts in the row's own table of documents, its head.
HEAD = np.dtype([("id", "<i8"), ("tag", "<u4")])
BODY = {
    ANCHOR: (("gram", "<u8"), ("stretch", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("size", "<u1"), ("back", "<u1")),
    REMOVED: (("doc", "<u4"), ("at", "<u4"), ("size", "<u4")),
    CHECK: (("doc", "<u4"), ("at", "<u4"), ("size", "<u1"), ("gram", "<u8"), ("crowded", "<u1")),
    TEXT: (("size", "<u4"),),
    STRETCH: (("doc", "<u4"), ("at", "<u4"), ("size", "<u1"), ("gram", "<u8")),
}
RISING = {"doc", "at"}


def _pack(kind: int, **arrays: np.ndarray) -> bytes:
    """Arrays of one length end to end; rising ones as differences, which the shuffle's compression likes."""
    out = []
    for name, dtype in BODY[kind]:
        x = arrays[name].astype(dtype)
        out.append((np.diff(x, prepend=x.dtype.type(0)) if name in RISING else x).tobytes())
    return b"".join(out)


def _unpack(kind: int, body: bytes) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in BODY[kind])
    count, at, out = len(body) // width, 0, {}
    for name, dtype in BODY[kind]:
        x = np.frombuffer(body, dtype, count, at)
        out[name] = np.cumsum(x, dtype=dtype) if name in RISING else x
        at += x.nbytes
    return out


class Sheaf:
    """Rows to be dealt: arrays that share a table of documents, split by bucket."""

    def __init__(self):
        self.rows: list[tuple[int, int, bytes, bytes, bytes | None]] = []

    def add(self, kind: int, bucket: np.ndarray, docs: np.ndarray, text: tuple[np.ndarray, np.ndarray] | None = None, **arrays) -> None:
        """`docs` is the table that arrays["doc"] counts in; `text` the bytes and places of each entry, if it has any."""
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        arrays = {k: v[order] for k, v in arrays.items()}
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            used, local = np.unique(arrays["doc"][a:b], return_inverse=True)
            part = {k: v[a:b] for k, v in arrays.items()} | {"doc": local}
            raw = None
            if text is not None:
                raw = zlib.compress(_gather(text[0], text[1][order[a:b]], part["size"].astype(np.int64)).tobytes(), 1)
            self.rows.append((int(bucket[a]), kind, docs[used].tobytes(), _pack(kind, **part), raw))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), 512):
            part = self.rows[at : at + 512]
            yield pa.record_batch([pa.array([r[i] for r in part], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)
        self.rows = []


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many spans end to end."""
    total = np.cumsum(sizes)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)]


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    key = mix(docs["id"].astype(np.uint64) * U(0x9E3779B97F4A7C15) + docs["tag"])
    return (key % U(buckets)).astype(np.int32)


def anchors(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: gram and stretch hash, first byte, number of bytes, anchor less first byte."""
    found = []
    for s in range(0, max(0, len(data) - length + 1), STEP):
        part = data[s : s + STEP + length - 1]
        count = len(part) - length + 1
        prefix = prefix_hashes(part)
        down = powers(len(prefix))[1]
        grams = len(part) - GRAM + 1
        gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:grams])
        low = (gram & ~U(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
        width, reach = length - GRAM + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if width > reach:
            low = np.minimum(low[: -(width - reach)], low[width - reach :])
        start = np.arange(count)
        anchor = (low[:count] & U(0xFFFFFF)).astype(np.int64)
        doc = np.searchsorted(places, start + s, "right") - 1
        inside = np.flatnonzero(start + s + length <= places[doc + 1])
        if not len(inside):
            continue
        start, anchor, doc = start[inside], anchor[inside], doc[inside]
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        last = np.append(edge[1:], len(start)) - 1
        first, end = start[edge], start[last] + length
        back = anchor[edge] - first
        stretch = mix(span_hashes(prefix, first, end) + back.astype(np.uint64))
        # anchors are minima, so their hashes are small ones: spread them again before they are dealt
        found.append((mix(gram[anchor[edge]] + U(1)), stretch, first + s, end - first, back, doc[edge]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _table(batch: pa.RecordBatch, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch's documents as rows of HEAD, and which of its rows they are: those without id take no part."""
    known = np.flatnonzero(~np.asarray(batch.column(0).is_null()))
    docs = np.zeros(len(known), HEAD)
    docs["id"] = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
    docs["tag"] = [zlib.crc32(data[places[i] : places[i + 1]]) for i in known]
    return docs, known


def _anchored(length: int, buckets: int):
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            docs, known = _table(batch, data, places)
            number = np.full(batch.num_rows, -1)
            number[known] = np.arange(len(known))
            for first, end, part, at in slices(data, places, DEALT_AT_ONCE):
                yield from _dealt(part, at, docs, number[first:end], length, buckets).batches()

    return anchor


def _dealt(data: np.ndarray, places: np.ndarray, docs: np.ndarray, number: np.ndarray, length: int, buckets: int) -> Sheaf:
    """The stretches of some texts by their gram; `number` is each text's place in the table of documents, or -1."""
    parts = []
    for first, _, part, at in slices(data, places):
        gram, stretch, begin, size, back, doc = anchors(part, at, length)
        row = number[doc + first]
        keep = row >= 0
        parts.append([x[keep] for x in (gram, stretch, begin - at[doc], size, back, row)])
    gram, stretch, begin, size, back, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    # of stretches that are equal throughout, only those of the smallest document here travel by their gram
    ids = docs["id"][doc]
    order = np.lexsort((ids, stretch))
    new = np.r_[True, stretch[order][1:] != stretch[order][:-1]] if len(order) else np.zeros(0, bool)
    least = np.zeros(len(order), np.int64)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = ids > least
    sheaf = Sheaf()
    home = _doc_bucket(docs, buckets)
    gone, stay = np.flatnonzero(later), np.flatnonzero(~later)
    sheaf.add(REMOVED, home[doc[gone]], docs, doc=doc[gone], at=begin[gone], size=size[gone])
    place = (((gram[stay] >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
    rest = {"doc": doc[stay], "at": begin[stay], "size": size[stay], "back": back[stay]}
    sheaf.add(ANCHOR, place, docs, gram=gram[stay], stretch=stretch[stay], **rest)
    return sheaf


def _collected(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> dict[int, list]:
    """Rows of a partition by kind: (table of documents, arrays, text)."""
    out: dict[int, list] = {k: [] for k in kinds}
    for batch in batches:
        for kind, head, body, text in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
            out[kind].append((np.frombuffer(head, HEAD), _unpack(kind, body), text))
    return out


def _joined(rows: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Tables and arrays of several rows as one: documents sorted by id and tag."""
    docs, back = np.unique(np.concatenate([np.zeros(0, HEAD), *[h for h, _, _ in rows]]), return_inverse=True)
    offset, parts = 0, []
    for head, arrays, _ in rows:
        parts.append(arrays | {"doc": back[offset + arrays["doc"].astype(np.int64)]})
        offset += len(head)
    return docs, {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _compared(buckets: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _collected(batches, (ANCHOR, REMOVED))
        sheaf = Sheaf()
        for docs, arrays, _ in got[REMOVED]:
            sheaf.add(REMOVED, _doc_bucket(docs, buckets)[arrays["doc"]], docs, **arrays)
        docs, x = _joined(got[ANCHOR])
        if x:
            ids = docs["id"][x["doc"]]
            order = np.lexsort((x["at"], x["doc"], x["stretch"], x["gram"]))
            x = {k: v[order] for k, v in x.items()}
            ids = ids[order]
            group = np.r_[True, x["gram"][1:] != x["gram"][:-1]]
            new = group | np.r_[True, x["stretch"][1:] != x["stretch"][:-1]]
            later = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
            number = np.cumsum(group) - 1
            different = np.bincount(number[new], minlength=number[-1] + 1)[number]
            home = _doc_bucket(docs, buckets)[x["doc"]]
            gone = np.flatnonzero(later)
            sheaf.add(REMOVED, home[gone], docs, doc=x["doc"][gone], at=x["at"][gone], size=x["size"][gone])
            look = np.flatnonzero(~later & (different > 1))
            crowd = (different[look] > CROWDED).astype(np.uint8)
            sheaf.add(
                CHECK, home[look], docs, doc=x["doc"][look], at=x["at"][look], size=x["size"][look], gram=x["gram"][look], crowded=crowd
            )
        yield from sheaf.batches()

    return compare


def _texts(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            docs, known = _table(batch, data, places)
            home, sheaf = _doc_bucket(docs, buckets), Sheaf()
            for bucket in np.unique(home).tolist():
                mine = np.flatnonzero(home == bucket)
                sizes = (places[1:] - places[:-1])[known[mine]]
                raw = zlib.compress(_gather(data, places[known[mine]], sizes).tobytes(), 1)
                sheaf.rows.append((bucket, TEXT, docs[mine].tobytes(), _pack(TEXT, size=sizes), raw))
            yield from sheaf.batches()

    return deal


class Shelf:
    """All texts of a partition in one run of bytes, found by document."""

    def __init__(self, rows: list):
        self.docs = np.concatenate([np.zeros(0, HEAD), *[h for h, _, _ in rows]])
        self.data = np.frombuffer(b"".join(zlib.decompress(t) for _, _, t in rows), np.uint8)
        sizes = np.concatenate([np.zeros(0, np.int64), *[a["size"].astype(np.int64) for _, a, _ in rows]])
        self.places = np.concatenate([[0], np.cumsum(sizes)])
        self.order = np.argsort(self.docs, order=["id", "tag"])
        self.sorted = self.docs[self.order]

    def starts(self, docs: np.ndarray) -> np.ndarray:
        return self.places[self.order[np.searchsorted(self.sorted, docs)]]


def _stretched(length: int, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _collected(batches, (CHECK, TEXT))
        if not got[CHECK]:
            return
        shelf, sheaf = Shelf(got[TEXT]), Sheaf()
        for docs, x, _ in got[CHECK]:
            at = shelf.starts(docs)[x["doc"]] + x["at"].astype(np.int64)
            whole = np.flatnonzero(x["crowded"] == 0)
            _send(sheaf, docs, {k: x[k][whole] for k in ("doc", "at", "size", "gram")}, at[whole], shelf.data, buckets)
            crowd = np.flatnonzero(x["crowded"])
            many = x["size"][crowd].astype(np.int64) - length + 1
            entry = np.repeat(crowd, many)
            step = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
            begin = at[entry] + step
            key = np.zeros(len(begin), np.uint64)
            for k in range(0, length, 8):  # windows that differ may share a key, so it need not tell all apart
                low = np.minimum(begin + k, begin + length - 8)
                word = np.zeros(len(begin), np.uint64)
                for b in range(8):
                    word = (word << U(8)) | shelf.data[low + b]
                key = mix(key * U(3) + word + U(k))
            single = {"doc": x["doc"][entry], "at": x["at"][entry] + step, "size": np.full(len(entry), length), "gram": key}
            _send(sheaf, docs, single, begin, shelf.data, buckets)
            yield from sheaf.batches()

    return cut


def _send(sheaf: Sheaf, docs: np.ndarray, x: dict, at: np.ndarray, data: np.ndarray, buckets: int) -> None:
    """Deal stretches with their bytes by their gram."""
    place = (((x["gram"] >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
    sheaf.add(STRETCH, place, docs, text=(data, at), **x)


def earlier_copies(words: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which suffixes have a longest previous factor of the full width: bool for each.

    `words` are the first bytes of each suffix as big-endian integers, `group` keeps unrelated suffixes apart. In suffix
    order, with equal suffixes by id, the run of suffixes that share all their words is where the common prefix with
    neighbours is long enough; the previous smaller id of a suffix lies in its run exactly if the run begins with a
    smaller one, and a next smaller id never does.
    """
    order = np.lexsort((ids, *words.T[::-1], group))
    rows, groups, owner = words[order], group[order], ids[order]
    head = np.r_[True, (groups[1:] != groups[:-1]) | (rows[1:] != rows[:-1]).any(1)] if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = owner > owner[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else out
    return out


def _factored(length: int, buckets: int):
    offsets = [min(k, length - 8) for k in range(0, length, 8)]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _collected(batches, (STRETCH,))[STRETCH]
        if not rows:
            return
        docs, x = _joined(rows)
        data = np.frombuffer(b"".join(zlib.decompress(t) for _, _, t in rows), np.uint8)
        size = x["size"].astype(np.int64)
        start = np.cumsum(size) - size
        many = size - length + 1
        order = np.argsort(x["gram"], kind="stable")
        gram, ids, home = x["gram"][order], docs["id"], _doc_bucket(docs, buckets)
        total = np.cumsum(many[order])
        group = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True])
        at, sheaf = 0, Sheaf()
        while at < len(group) - 1:
            base = total[group[at]] - many[order][group[at]]
            end = max(at + 1, int(np.searchsorted(total[group[1:] - 1] - base, SORTED_AT_ONCE, "right")))
            mine = order[group[at] : group[end]]
            entry = np.repeat(mine, many[mine])
            step = np.arange(len(entry)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
            begin = start[entry] + step
            words = np.zeros((len(entry), len(offsets)), np.uint64)
            for k, offset in enumerate(offsets):
                for b in range(8):
                    words[:, k] = (words[:, k] << U(8)) | data[begin + offset + b]
            gone = earlier_copies(words, x["gram"][entry], ids[x["doc"][entry]])
            entry, step = entry[gone], step[gone]
            if len(entry):
                first = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)])
                last = np.append(first[1:], len(entry)) - 1
                doc = x["doc"][entry[first]]
                spot = x["at"][entry[first]] + step[first]
                by = np.lexsort((spot, doc))
                sizes = (step[last] - step[first] + length)[by]
                sheaf.add(REMOVED, home[doc[by]], docs, doc=doc[by], at=spot[by], size=sizes)
                yield from sheaf.batches()
            at = end

    return factor


CLEANED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _clean_batch(ids: list, data: np.ndarray, places: np.ndarray, cover: np.ndarray) -> pa.RecordBatch:
    removed = np.diff(np.concatenate([[0], np.cumsum(cover)])[places])
    before = np.r_[False, cover[:-1]] if len(cover) else cover
    before[places[:-1][places[:-1] < len(cover)]] = False
    starts = np.flatnonzero(cover & ~before)
    after = np.r_[cover[1:], False] if len(cover) else cover
    after[places[1:][places[1:] > 0] - 1] = False
    ends = np.flatnonzero(cover & ~after) + 1
    at = np.searchsorted(starts, places)
    digests, spans = [], []
    for i in range(len(ids)):
        a, b = places[i], places[i + 1]
        digests.append(hashlib.sha256(data[a:b][~cover[a:b]] if removed[i] else data[a:b]).hexdigest())
        mine = zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)
        spans.append([{"start": int(s - a), "end": int(e - a)} for s, e in mine])
    out = [pa.array(ids, pa.int64()), *[pa.array(c.astype(np.int64)) for c in (np.diff(places), removed, np.diff(at))]]
    return pa.record_batch([*out, pa.array(digests, pa.string()), pa.array(spans, SPAN)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = _collected(batches, (TEXT, REMOVED))
    shelf = Shelf(got[TEXT])
    edges = np.zeros(len(shelf.data) + 1, np.int32)
    slots: dict[tuple[int, int], list[int]] = {}
    for i in range(len(shelf.docs) - 1):
        a, b = shelf.sorted[i], shelf.sorted[i + 1]
        if a == b:  # rows that repeat: all of them lose what the first does
            slots.setdefault((int(a["id"]), int(a["tag"])), [int(shelf.order[i])]).append(int(shelf.order[i + 1]))
    for docs, x, _ in got[REMOVED]:
        begin = shelf.starts(docs)[x["doc"]] + x["at"].astype(np.int64)
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + x["size"].astype(np.int64), -1)
    cover = np.cumsum(edges[:-1], dtype=np.int32) > 0
    for rows in slots.values():
        spans = [slice(shelf.places[r], shelf.places[r + 1]) for r in rows]
        joint = np.logical_or.reduce([cover[s] for s in spans])
        for s in spans:
            cover[s] = joint
    for at in range(0, len(shelf.docs), 2000):
        part = shelf.places[at : at + 2001]
        here = slice(part[0], part[-1])
        yield _clean_batch(shelf.docs["id"][at : at + 2000].tolist(), shelf.data[here], part - part[0], cover[here])


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = flat(batch.column(1))
        yield _clean_batch(batch.column(0).to_pylist(), data, places, np.zeros(len(data), bool))


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of removed UTF-8 bytes).

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller id; strings are judged on
    the texts as given. Null and empty texts have no bytes. Rows that share an id are no copies of each other, and rows
    without an id keep their whole text. Other columns are not read. Stretches are told apart by 128 bits of hash, windows
    within them byte by byte.
    """
    if not GRAM + 8 <= length <= 128:
        raise ValueError("length must be between 24 and 128")
    rows = columns(docs, id_column, text)
    rows = rows.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    width = shuffle_width(docs.sparkSession)
    anchored = rows.mapInArrow(_anchored(length, width), ROWS).repartitionById(width, F.col("bucket"))
    marks = pinned(anchored.mapInArrow(_compared(width), ROWS))
    texts = rows.mapInArrow(_texts(width), ROWS)
    checks = marks.where(F.col("kind") == CHECK).unionByName(texts).repartitionById(width, F.col("bucket"))
    stretches = checks.mapInArrow(_stretched(length, width), ROWS).repartitionById(width, F.col("bucket"))
    factors = pinned(stretches.mapInArrow(_factored(length, width), ROWS))
    removed = marks.where(F.col("kind") == REMOVED).unionByName(factors)
    found = removed.unionByName(texts).repartitionById(width, F.col("bucket")).mapInArrow(_cleaned, CLEANED)
    return found.unionByName(rows.where("doc_id IS NULL").mapInArrow(_untouched, CLEANED))
