"""Language-model scoring of whole documents: corpus counts for the base score, a gated recurrent model for the score.

Counts of all training tokens come from one shuffle of word hashes. The most frequent words are the recurrent model's
vocabulary. Any other word is one member of it, followed by its share of the training counts of such words or, if it has
none, by its spelling under a byte model counted over all training texts; what is set aside for unseen words is the
share of words seen once. The recurrent model is trained by rounds: tasks start from the same parameters, train on their share of the
training documents, and the parameters are averaged by tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm import gru
from aerolattice.llm.bytetext import BLANK, LOWER, U, byte_hashes, columns, flat, mix, slices, words
from aerolattice.llm.labelled import fold
from aerolattice.runtime import pinned, shuffle_width

#: Every training document takes part in the gradient steps of one of so many rounds.
ROUNDS = 3
CHUNKS = 32
#: Contexts of the byte model: three bytes before, hashed.
CONTEXTS = 8192
SYMBOLS = 257
COUNT_SLICE = 4 << 20
#: Batches are scored together once they hold so many tokens.
ABREAST = 2 << 20

END = U(0xE4D0F70E4D0F7E4D)
UNKNOWN = 1  # place of other words in the vocabulary; place 0 is the end of a text
PART, STATS, TOP, SPELL, TEXT, UNSEEN = range(6)
OUT = "bucket int, kind int, body binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        types = (pa.int32(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names=["bucket", "kind", "body"])


def _tokens(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, places of each text's first, and starts and ends of the words."""
    low = LOWER[data]
    starts, ends, at = words(low, places, BLANK)
    hashes = byte_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.full(len(hashes) + len(at) - 1, END)
    out[np.arange(len(hashes)) + owner] = hashes
    return out, at + np.arange(len(at)), starts, ends


def _keys(ids: pa.Array, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 bits of id and text, by which the parts of a row find each other."""
    return np.array(
        [
            (zlib.crc32(data[a:b]) << 32 | zlib.crc32(f"{i}:{b - a}".encode(), zlib.adler32(data[a:b])))
            for i, a, b in zip(ids.to_pylist(), places[:-1], places[1:], strict=True)
        ],
        np.uint64,
    )


def _counted(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            keys = _keys(batch.column(0), data, places)
            held = np.asarray(batch.column(2))
            for first, end, part, at in slices(data, places, COUNT_SLICE):
                pieces, spots = [], [np.zeros(1, np.int64)]
                for _, _, small, near in slices(part, at):
                    hashes, starts, _, _ = _tokens(small, near)
                    pieces.append(hashes)
                    spots.append(starts[1:] + spots[-1][-1])
                hashes, starts = np.concatenate(pieces), np.concatenate(spots)
                doc = np.repeat(np.arange(end - first), np.diff(starts))
                order = np.argsort(hashes, kind="stable")
                hashes, doc = hashes[order], doc[order]
                new = np.r_[True, hashes[1:] != hashes[:-1]]
                edge = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]])
                times = np.diff(np.append(edge, len(hashes)))
                word, owner = hashes[edge], doc[edge]
                bucket = ((word >> U(32)) * U(buckets)) >> U(32)  # rises with the hash
                cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                table = keys[first:end].tobytes() + held[first:end].astype(np.uint8).tobytes()
                out = []
                for b in range(buckets):
                    mine = slice(cut[b], cut[b + 1])
                    if cut[b + 1] > cut[b]:
                        unique, each = np.unique(word[mine], return_counts=True)
                        head = np.array([end - first, len(unique), cut[b + 1] - cut[b]], "<i8").tobytes()
                        arrays = (unique, each.astype("<u4"), owner[mine].astype("<u4"), times[mine].astype("<u4"))
                        out.append((b, PART, head + table + b"".join(x.tobytes() for x in arrays)))
                yield from _rows(out)

    return count


def _opened(body: bytes) -> tuple[np.ndarray, ...]:
    docs, unique, entries = np.frombuffer(body, "<i8", 3).tolist()
    at, out = 24, []
    for dtype, count in (("<u8", docs), ("<u1", docs), ("<u8", unique), ("<u4", unique), ("<u4", entries), ("<u4", entries)):
        out.append(np.frombuffer(body, dtype, count, at))
        at += out[-1].nbytes
    return tuple(out)


MERGED_NAMES = ("key", "base", "seen_log", "n_known", "unseen", "unseen_times")
MERGED = "key bigint, base double, seen_log double, n_known bigint, unseen binary, unseen_times binary"


def _summed(buckets: int):
    kind = np.dtype([("key", "<u8"), ("sum", "<f8"), ("log", "<f8"), ("known", "<u4"), ("rows", "<u4")])
    lacking = np.dtype([("key", "<u8"), ("hash", "<u8"), ("times", "<u4")])

    def dealt(number: int, part: np.ndarray) -> list[tuple[int, int, bytes]]:
        home = (part["key"] % U(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        return [(b, number, part[order[cut[b] : cut[b + 1]]].tobytes()) for b in range(buckets) if cut[b + 1] > cut[b]]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_opened(x) for batch in batches for x in batch.column(2).to_pylist()]
        if not parts:
            return
        own = np.concatenate([p[2] for p in parts])
        vocabulary, back = np.unique(own, return_inverse=True)
        counts, at = np.zeros(len(vocabulary), np.int64), 0
        places = []
        for _, held, unique, each, doc, times in parts:
            word = np.repeat(back[at : at + len(unique)], each)
            at += len(unique)
            train = held[doc] == 0
            np.add.at(counts, word[train], times[train].astype(np.int64))
            places.append(word)
        found, lack = [], []
        weight, plain = np.log10(counts + 1.0), np.log10(np.maximum(counts, 1.0))
        plain[vocabulary == END] = 0
        for (keys, _, _, _, doc, times), word in zip(parts, places, strict=True):
            n = len(keys)
            part = np.zeros(n, kind)
            part["key"] = keys
            part["sum"] = np.bincount(doc, times * weight[word], minlength=n)
            part["log"] = np.bincount(doc, times * plain[word], minlength=n)
            part["known"] = np.bincount(doc, times * (counts[word] > 0), minlength=n)
            part["rows"] = np.bincount(doc, vocabulary[word] == END, minlength=n)
            found.append(part[np.bincount(doc, minlength=n) > 0])
            new = np.flatnonzero((counts[word] == 0) & (vocabulary[word] != END))
            unseen = np.zeros(len(new), lacking)
            unseen["key"], unseen["hash"], unseen["times"] = keys[doc[new]], vocabulary[word[new]], times[new]
            lack.append(unseen)
        out = dealt(PART, np.concatenate(found)) + dealt(UNSEEN, np.concatenate(lack))
        out.append((0, STATS, np.array([(counts > 0).sum(), counts.sum(), (counts == 1).sum()], "<i8").tobytes()))
        words_ = np.flatnonzero((counts > 0) & (vocabulary != END))
        top = words_[np.lexsort((vocabulary[words_], -counts[words_]))[: gru.VOCABULARY]]
        out.append((0, TOP, vocabulary[top].tobytes() + counts[top].astype("<i8").tobytes()))
        yield from _rows(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, unseen = [np.zeros(0, kind)], [np.zeros(0, lacking)]
        for batch in batches:
            for number, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (parts if number == PART else unseen).append(np.frombuffer(body, kind if number == PART else lacking))
        every, new = np.concatenate(parts), np.concatenate(unseen)
        keys, back = np.unique(every["key"], return_inverse=True)
        rows = np.maximum(1, np.bincount(back, every["rows"], minlength=len(keys)))
        sums = [np.bincount(back, every[k], minlength=len(keys)) / rows for k in ("sum", "log", "known")]
        new = new[np.lexsort((new["hash"], new["key"]))]
        cut = np.searchsorted(new["key"], keys), np.searchsorted(new["key"], keys, "right")
        once = [np.unique(new["hash"][a:b], return_index=True) for a, b in zip(*cut, strict=True)]
        hashes = [h.tobytes() for h, _ in once]
        times = [
            (np.add.reduceat(new["times"][a:b], i) // int(r)).astype("<u4").tobytes() if b > a else b""
            for (_, i), a, b, r in zip(once, *cut, rows, strict=True)
        ]
        yield pa.record_batch(
            [
                pa.array(keys.astype(np.int64)),
                pa.array(sums[0]),
                pa.array(sums[1]),
                pa.array(np.rint(sums[2]).astype(np.int64)),
                pa.array(hashes, pa.binary()),
                pa.array(times, pa.binary()),
            ],
            names=[*MERGED_NAMES],
        )

    return total, merge


class Speller:
    """Log-probabilities of words letter by letter: each byte, and the end, after the three bytes before it."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(CONTEXTS, SYMBOLS).astype(np.float64)
        overall = (counts.sum(0) + 1) / (counts.sum() + SYMBOLS)
        self.logs = np.log((counts + 2 * overall) / (counts.sum(1, keepdims=True) + 2)).astype(np.float32).ravel()

    def score(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of the spelling of each of the words."""
        code, owner = spelled(low, starts, ends)
        return np.bincount(owner, self.logs[code], minlength=len(starts))


def spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the byte model of every byte of the words and of their ends, and the word each belongs to."""
    sizes = ends - starts + 1
    owner = np.repeat(np.arange(len(starts)), sizes)
    last = np.cumsum(sizes) - 1
    first = last + 1 - sizes
    at = np.arange(len(owner)) + np.repeat(starts - first, sizes)
    symbol = np.append(low, 0)[at].astype(np.int64)
    symbol[last] = 0  # an end shares its place with byte 0
    one, two, three = (np.zeros_like(symbol) for _ in range(3))
    for later, earlier in ((one, symbol), (two, one), (three, two)):
        later[1:] = earlier[:-1]
        later[first] = 0
    context = (one * 65536 + two * 256 + three) * 2654435761 % 4294967291 % CONTEXTS
    return context * SYMBOLS + symbol, owner


class Vocabulary:
    #: Bits of the hashes by which a word's place is found; no two words of a vocabulary fall together in all of them.
    BITS = U(20)
    spread = U(0x9E3779B97F4A7C15)

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.logs = np.concatenate([[0, 0], np.log10(np.maximum(counts, 1))])
        self.hashes = np.concatenate([[END, END], hashes]).astype(np.uint64)
        spread, slots = int(self.spread), np.zeros(0, np.uint64)
        while len(np.unique(slots)) < len(hashes):
            spread = (spread * 0xD1342543DE82EF95 + 2) % (1 << 64)
            self.spread = U(spread)
            slots = self._slots(hashes)
        self.places = np.zeros(1 << int(self.BITS), np.uint16)
        self.places[slots] = np.arange(2, len(hashes) + 2)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self.spread) >> (U(64) - self.BITS)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        place = self.places[self._slots(hashes)].astype(np.int64)
        return np.where(self.hashes[place] == hashes, place, np.where(hashes == END, 0, UNKNOWN))


def _others(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that are not in the vocabulary, and their places among the tokens."""
    other = ids[ids != 0] == UNKNOWN
    return starts[other], ends[other], np.flatnonzero(ids == UNKNOWN)


def _studied(vocabulary: Vocabulary):
    """Byte counts of all training texts' other words, and the words of each text by the round that trains on it."""

    def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CONTEXTS * SYMBOLS, np.int64)
        codes: list[np.ndarray] = []
        for batch in batches:
            data, places = flat(batch.column(0))
            turn = np.asarray(batch.column(1))
            out = []
            for first, end, part, at in slices(data, places):
                hashes, begin, starts, ends = _tokens(part, at)
                ids = vocabulary.ids(hashes)
                code, _ = spelled(LOWER[part], *_others(ids, starts, ends)[:2])
                codes.append(code)
                if sum(map(len, codes)) >= len(counts):  # counting costs as much as the model is large
                    counts += np.bincount(np.concatenate(codes), minlength=len(counts))
                    codes = []
                for i in range(first, end):
                    out.append((int(turn[i]), TEXT, ids[begin[i - first] : begin[i - first + 1]].astype("<u2").tobytes()))
            yield from _rows(out)
        counts += np.bincount(np.concatenate([np.zeros(0, np.int64), *codes]), minlength=len(counts))
        size = -(-len(counts) // CHUNKS)
        chunks = ((c, counts[c * size : (c + 1) * size]) for c in range(CHUNKS))
        yield from _rows([(c, SPELL, zlib.compress(x.astype("<i8").tobytes(), 1)) for c, x in chunks])

    return study


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in table.column("body").to_pylist())
    return pa.table({"bucket": table.column("bucket")[:1], "body": pa.array([total.tobytes()], pa.binary())})


def _trained(p: gru.Parameters):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [np.frombuffer(x, "<u2") for batch in batches for x in batch.column(2).to_pylist()]
        if not texts:
            return
        new, tokens, loss = gru.train(p, texts)
        whole = np.append(gru.flatten(new).astype("<f8") * tokens, [tokens, loss])
        size = -(-len(whole) // CHUNKS)
        yield from _rows([(c, TEXT, whole[c * size : (c + 1) * size].tobytes()) for c in range(CHUNKS)])

    return train


SCORED_NAMES = ["doc_id", "held_out", "key", "n_tokens", "recurrent", "own_log", "n_own", "others", "spelling"]
SCORED = (
    "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, recurrent double, own_log double, n_own bigint,"
    " others binary, spelling binary"
)


def _scored(vocabulary: Vocabulary, speller: Speller, p: gru.Parameters):
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        """The batch's words and its texts' sizes, and the columns but the recurrent score."""
        data, places = flat(batch.column(1))
        held = np.asarray(batch.column(2))
        ids, own, sizes, others, spelling = [], [], [], [], []
        for head, end, part, at in slices(data, places):
            hashes, begin, starts, ends = _tokens(part, at)
            mine = vocabulary.ids(hashes)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(begin))
            own.append(np.stack([np.bincount(owner, x, minlength=len(at) - 1) for x in (vocabulary.logs[mine], mine > UNKNOWN)]))
            first, last, where = _others(mine, starts, ends)
            asked = held[head:end][owner[where]]  # only these may be unseen
            logs = speller.score(LOWER[part], first[asked], last[asked]).astype("<f4")
            other, cut = hashes[where][asked], np.searchsorted(owner[where][asked], np.arange(len(at)))
            for i in range(len(at) - 1):
                unique, place = np.unique(other[cut[i] : cut[i + 1]], return_index=True)
                others.append(unique.tobytes())
                spelling.append(logs[cut[i] : cut[i + 1]][place].tobytes())
            ids.append(mine.astype(np.uint16))
            sizes.append(np.diff(begin))
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        own_log, n_own = np.concatenate([np.zeros((2, 0)), *own], 1)
        out = [batch.column(0), batch.column(2), pa.array(_keys(batch.column(0), data, places).astype(np.int64)), pa.array(size)]
        out += [pa.array(own_log), pa.array(n_own.astype(np.int64)), pa.array(others, pa.binary()), pa.array(spelling, pa.binary())]
        return np.concatenate([np.zeros(0, np.uint16), *ids]), size, out

    def together(waiting: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]]) -> Iterator[pa.RecordBatch]:
        """The waiting batches with the recurrent scores, whose texts go through the model side by side."""
        ids, sizes, kept = zip(*waiting, strict=True)
        logs = gru.score(p, np.concatenate(ids), np.cumsum(np.concatenate([[0], *sizes]))) / np.log(10)
        ends = np.cumsum([len(x) for x in sizes])
        for cols, mine in zip(kept, np.split(logs, ends[:-1]), strict=True):
            yield pa.record_batch([*cols[:4], pa.array(mine), *cols[4:]], names=SCORED_NAMES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            waiting.append(read(batch))
            if sum(len(x[0]) for x in waiting) >= ABREAST:
                yield from together(waiting)
                waiting = []
        if waiting:
            yield from together(waiting)

    return score


def _completed(floor: float, others: float, aside: float, end_known: int):
    """The base score, and the recurrent score with the shares or spellings of words outside the vocabulary."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(i) for i, n in enumerate([*SCORED_NAMES, *MERGED_NAMES[1:]])}
            n = {k: x[k].to_numpy(zero_copy_only=False) for k in ("n_tokens", "recurrent", "own_log", "n_own", "base", "seen_log", "n_known")}
            seen = n["n_known"] - end_known - n["n_own"]
            score = n["recurrent"] + n["seen_log"] - n["own_log"] + seen * (np.log10(1 - aside) - np.log10(max(others, 1.0)))
            for i in np.flatnonzero(n["n_tokens"] - 1 > n["n_known"] - end_known):
                asked, logs = (np.frombuffer(x[k][i].as_py(), t) for k, t in (("others", "<u8"), ("spelling", "<f4")))
                unseen, times = (np.frombuffer(x[k][i].as_py(), t) for k, t in (("unseen", "<u8"), ("unseen_times", "<u4")))
                spelled_ = logs[np.searchsorted(asked, unseen)].astype(float) / np.log(10) + np.log10(aside)
                score[i] += (times * spelled_).sum()
            out = [x["n_tokens"], x["n_known"], pa.array(n["base"] - n["n_tokens"] * floor), pa.array(score)]
            yield pa.record_batch([x["doc_id"], x["held_out"], *out], names=names)

    return complete


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) for every document.

    Tokens are the words of the text, lower-cased in A-Z, and one end. Null and empty texts have the end alone. A null id
    counts as an empty one for the folds and stays null; rows that repeat id and text score alike, and all of them
    count. Without training documents everything is unknown. Other columns are not read.
    """
    width = shuffle_width(docs.sparkSession)
    rows = columns(docs, id_column, text)
    rows = rows.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("held_out", fold("doc_id", folds) == held)
    total, merge = _summed(width)
    counted = rows.mapInArrow(_counted(width), OUT).repartitionById(width, F.col("bucket"))
    sums = pinned(counted.mapInArrow(total, OUT))

    known = [np.frombuffer(r[0], "<i8") for r in sums.where(F.col("kind") == STATS).select("body").toLocalIterator()]
    distinct, tokens, once = (int(sum(x[i] for x in known)) for i in range(3))
    best: list[tuple[int, int]] = []
    for row in sums.where(F.col("kind") == TOP).select("body").toLocalIterator():
        half = len(row[0]) // 16
        found = zip(np.frombuffer(row[0], "<i8", half, 8 * half).tolist(), np.frombuffer(row[0], "<u8", half).tolist(), strict=True)
        best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[: gru.VOCABULARY - 2]
    vocabulary = Vocabulary(np.array([h for _, h in best], np.uint64), np.array([c for c, _ in best]))
    training = rows.where("NOT held_out")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(ROUNDS)).cast("int")
    studied = training.select("text", turn.alias("turn")).mapInArrow(_studied(vocabulary), OUT)
    studied = pinned(studied)

    ends = training.count()
    frequency = np.zeros(gru.VOCABULARY)
    frequency[0], frequency[2 : 2 + len(best)] = ends, [c for c, _ in best]
    frequency[UNKNOWN] = max(0, tokens - frequency.sum())
    spelled_ = studied.where(F.col("kind") == SPELL).select("bucket", "body")
    speller = Speller(_chunks(spelled_.groupBy("bucket").applyInArrow(_add_counts, "bucket int, body binary")))
    p = gru.start(frequency)
    for turn_ in range(ROUNDS):
        mine = studied.where((F.col("kind") == TEXT) & (F.col("bucket") == turn_))
        new = mine.mapInArrow(_trained(p), OUT).groupBy("bucket").applyInArrow(_add, "bucket int, body binary")
        whole = _chunks(new)
        if len(whole):
            p = gru.unflatten(whole[:-2] / whole[-2])

    parts = sums.where(F.col("kind").isin(PART, UNSEEN)).repartitionById(width, F.col("bucket"))
    scored = rows.mapInArrow(_scored(vocabulary, speller, p), SCORED)
    joined = scored.join(parts.mapInArrow(merge, MERGED), "key", "left").select(*SCORED_NAMES, *MERGED_NAMES[1:])
    others = float(frequency[UNKNOWN])
    aside = float(np.clip(once / max(1.0, others), 1e-4, 0.9))
    complete = _completed(float(np.log10(tokens + distinct + 1)), others, aside, int(ends > 0))
    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    found = joined.mapInArrow(complete, kinds)
    train_tokens = F.lit(tokens).cast("bigint").alias("train_tokens")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, "base_score", "score")


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in table.column("body").to_pylist()).astype("<f8")
    return pa.table({"bucket": table.column("bucket")[:1], "body": pa.array([total.tobytes()], pa.binary())})


def _chunks(rows: DataFrame) -> np.ndarray:
    """The whole of an array that is kept in CHUNKS rows; its size is fixed by the model."""
    found = sorted((r[0], bytes(r[1])) for r in rows.select("bucket", "body").collect())
    return np.concatenate([np.zeros(0), *[np.frombuffer(b, "<f8") for _, b in found]])
