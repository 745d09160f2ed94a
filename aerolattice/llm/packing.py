"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized where they lie and cut into pieces. The plan sees only how many pieces there are of each length:
best-fit decreasing over counts, where equal sequences are one pattern with a multiplicity. A piece then takes the
planned slot with its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import columns
from aerolattice.runtime import pinned

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)

#: Fixed pattern of this family of vocabularies, by which a text falls into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Texts with a longer run of blanks go to `tokenizers`: the pattern takes back a run step by step, and tiktoken's matcher
#: keeps its steps on the stack.
MOST_BLANKS = 50_000
BLANKS = re.compile(r"\s{2,}")


def _merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings, or None if its ids are not the order in which its merges apply."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if all(c in letters for c in token)}
    merged = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    order = [model["vocab"][x] for x in merged]
    return ranks if order == list(range(256, 256 + len(order))) else None


class TextTokenizer:
    """Token ids of whole texts under a byte-level vocabulary, as the `tokenizers` library gives them.

    Where the vocabulary's merges apply in the order of their ids, the same merges are run by tiktoken, which is some ten
    times faster. A text that holds one of the vocabulary's special tokens or a very long run of blanks is given to
    `tokenizers`. If `plain`, strings of special tokens within texts are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.inner.encode_special_tokens = plain
        self.special = [] if plain else special
        ranks = _merge_ranks(path)
        self.fast = None
        if ranks:
            ranks = {k: n for k, n in ranks.items() if k not in {x.encode() for x in special}}
            self.fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _far_blank(text: str) -> bool:
        return len(text) > MOST_BLANKS and any(m.end() - m.start() > MOST_BLANKS for m in BLANKS.finditer(text))

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special) or self._far_blank(text):
            ids = self.inner.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


_tokenizers: dict[tuple[str, bool], TextTokenizer] = {}


def tokenizer(path: str, plain: bool = False) -> TextTokenizer:
    if (path, plain) not in _tokenizers:
        _tokenizers[path, plain] = TextTokenizer(path, plain)
    return _tokenizers[path, plain]


def _cutter(path: str, end_id: int, room: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = tokenizer(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(spell.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start, piece, end = 0, 0, len(ids) % room or room
                while start < len(ids):
                    end = min(end, len(ids))
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, piece, end = end, piece + 1, end + room
            fields = enumerate(PIECES_ARROW)
            yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in fields], schema=PIECES_ARROW)

    return cut


def pieces(docs: DataFrame, path: str, end_id: int = 2, room: int = 1024, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized pieces of every text: doc_id, piece, start, length, ids_crc32. Only texts over `room` ids are cut.

    The remainder of a cut text is its first piece, all others hold `room` ids. A null text is an empty one and has the
    end id alone.
    """
    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(_cutter(path, end_id, room), PIECES)


def plan(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths of a sequence in order, how many such sequences).

    Lengths are taken from long to short. Pieces of one length go together to the open sequences with the least room that
    still holds them, as many per sequence as fit, and open new ones when none is left. Sequences with the same lengths
    are one pattern, so work and memory depend on `room` alone, not on the number of pieces.
    """
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    closed: list[tuple[tuple[int, ...], int]] = []

    def keep(pattern: tuple[int, ...], left: int, number: int) -> None:
        if number and left == 0:
            closed.append((pattern, number))
        elif number:
            same = open_by_room.setdefault(left, {})
            same[pattern] = same.get(pattern, 0) + number

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        for left in sorted(x for x in open_by_room if x >= length):
            fit = left // length
            for pattern, number in sorted(open_by_room.pop(left).items()):
                full = min(number, count // fit)
                keep(pattern + (length,) * fit, left - fit * length, full)
                count, number = count - full * fit, number - full
                if number and count:  # fewer are left than fit
                    keep(pattern + (length,) * count, left - count * length, 1)
                    count, number = 0, number - 1
                keep(pattern, left, number)
            if not count:
                break
        fit = room // length
        keep((length,) * fit, room - fit * length, count // fit)
        if count % fit:
            keep((length,) * (count % fit), room - count % fit * length, 1)
    return closed + [item for left in sorted(open_by_room) for item in sorted(open_by_room[left].items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset, per sequence, step): which ranks of a length go where.

    The `per` equal lengths of a pattern lie side by side, so rank r of a row is in sequence first + (r - rank) // per, at
    offset + (r - rank) % per * length.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, number in patterns:
        offset = at = 0
        while at < len(pattern):
            length = pattern[at]
            per = pattern.count(length)
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + per * number, sequence, offset, per))
            taken[length] = rank + per * number
            offset, at = offset + per * length, at + per
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


PLACED = PIECES + ", sequence_id bigint, offset bigint"


def _placer(table: np.ndarray):
    lengths, first = table[:, 0], table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lengths * (1 << 40) + first
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = table[np.searchsorted(key, length * (1 << 40) + rank, "right") - 1]
            inside = rank - row[:, 1]
            where = [pa.array(row[:, 3] + inside // row[:, 5]), pa.array(row[:, 4] + inside % row[:, 5] * length)]
            yield pa.record_batch([*batch.columns[:5], *where], names=[*PIECES_ARROW.names, "sequence_id", "offset"])

    return place


def pack(cut: DataFrame, room: int = 1024) -> DataFrame:
    """Place pieces (see `pieces`) into sequences of at most `room` ids: adds sequence_id and offset, gapless from 0.

    Only the histogram (at most `room` rows) reaches the driver, and the plan made of it (its size depends on `room`
    alone) goes to the tasks. Ranks are counted in hash parts of each length, so a length that most pieces have is ranked
    by many tasks. Repeated rows are packed like any other; no rows give no sequences.
    """
    cut = pinned(cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1024)).cast("int")))
    counted = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").agg(F.count("*")).collect()}
    table = slots(plan(histogram, room))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_inside", F.row_number().over(inside) - 1).join(parts, ["length", "_part"])
    rows = ranked.select(*PIECES_ARROW.names, (F.col("_before") + F.col("_inside")).cast("bigint").alias("_rank"))
    return rows.mapInArrow(_placer(table), PLACED)


def best_fit_packing(
    docs: DataFrame, path: str, end_id: int = 2, room: int = 1024, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All texts tokenized and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty ones and empty texts hold the end id alone; rows without id keep a null doc_id. Columns other
    than the two named are not read. An empty table gives no rows.
    """
    return pack(pieces(docs, path, end_id, room, id_column, text), room)
