"""Secret scan with dictionary-primed compression.

Three fixed patterns give the base findings. Beyond them, strings in a sensitive context are weighed by how many bytes
they add to a zstandard frame of their surroundings, primed with the corpus' own most frequent identifiers: words and
names that the corpus knows add little, a key or a password adds about as many bytes as it has.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import columns
from aerolattice.runtime import pinned

#: Fixed patterns of the base findings.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones never hold a longer
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|signing|encryption)[ _-]?key|credential|authorization|bearer",
    re.IGNORECASE,
)
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.!@#$%^&*-]{12,}")
LEAST = 12
REACH = 48
SURROUNDING = 256
#: A string is novel if it adds so many bytes per byte, or so large a share of what random strings of its length and
#: alphabet add in the same place. Short ones vary more, so several are drawn.
NOVEL, NOVEL_SHARE = 0.75, 0.85
DRAWN, DRAWN_ONCE = 4, 64
#: A string is drawn from the union of the classes it uses, or from hexadecimal digits if it has no others.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=~.!@#$%^&*-")
HEXADECIMAL = ("0123456789abcdef", "0123456789ABCDEF")

IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{3,40}")
DICTIONARY_BYTES = 1 << 16
COUNTED_AT_ONCE = 200_000


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update(IDENTIFIER.findall(text.as_py() or b""))
            if len(counts) > COUNTED_AT_ONCE:
                yield flush(counts)
                counts.clear()
    yield flush(counts)


def identifier_dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifiers of all texts, the commonest last as zstandard prefers, `most` bytes at most."""
    rows = columns(docs, text).select(F.col(text).cast("string"))
    counted = pinned(rows.mapInArrow(_identifiers, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    most_words = most // 5  # each takes five bytes at least
    step = F.floor(F.log2("n") * 16).cast("int")
    enough, least = 0, 0
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):  # some hundred steps
        least, enough = row[0], enough + row[1]
        if enough >= most_words:
            break
    top = counted.where(step >= least).orderBy(F.desc("n"), "word").limit(most_words).collect()
    words, room = [], most
    for row in top:
        room -= len(row[0]) + 1
        if room < 0:
            break
        words.append(bytes(row[0]))
    return b" ".join(reversed(words))


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, per byte of the string."""

    def __init__(self, dictionary: bytes):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.inner = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)

    def of(self, string: str, around: str) -> float:
        near, own = around.encode("utf-8", "replace"), string.encode("utf-8", "replace")
        return (len(self.inner.compress(near + own)) - len(self.inner.compress(near))) / len(own)

    def against_random(self, string: str, around: str) -> tuple[float, float]:
        """Marginal bytes per byte of the string, and of random strings of its length and alphabet."""
        near, own = around.encode("utf-8", "replace"), string.encode("utf-8", "replace")
        bare = len(self.inner.compress(near))
        draw, letters = random.Random(len(string)), alphabet(string)
        times = DRAWN if len(string) < DRAWN_ONCE else 1
        drawn = ["".join(draw.choices(letters, k=len(string))).encode() for _ in range(times)]
        added = [(len(self.inner.compress(near + x)) - bare) / len(own) for x in (own, *drawn)]
        return added[0], sum(added[1:]) / times


def alphabet(string: str) -> str:
    used = set(string)
    for digits in HEXADECIMAL:
        if used <= set(digits) and not used <= set(CLASSES[0]):
            return digits
    return "".join(x for x in CLASSES if used & set(x))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _without(a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a string outside the base spans, without those too short to be judged."""
    for s, e, _ in base:
        if e <= a or b <= s:
            continue
        if s - a >= LEAST:
            yield a, s
        a = max(a, e)
    if b - a >= LEAST:
        yield a, b


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, float]]:
    """Strings soon after a sensitive word that neither the surroundings nor the dictionary help to compress."""
    low = text.lower()
    if not any(x in low for x in SENSITIVE_PARTS):
        return []
    found: dict[tuple[int, int], float] = {}
    measured: set[tuple[int, int]] = set()
    covered = done = 0
    for word in SENSITIVE.finditer(text):
        # an unbroken string is looked at once, from the first sensitive word that leads to it or lies in it
        stop, at = word.end() + REACH, max(word.end(), done)
        # only where a string begins is limited; it runs to its true end
        while m := CANDIDATE.search(text, at, min(len(text), stop + LEAST)):
            a, at = m.start(), CANDIDATE.match(text, m.start()).end()
            done = at
            for start, end in _without(a, at, base):
                if (start, end) in measured or start < covered:  # inside a string that is found already
                    continue
                measured.add((start, end))
                around = text[max(0, start - SURROUNDING) : start] + text[end : end + SURROUNDING // 2]
                score, by_chance = novelty.against_random(text[start:end], around)
                if score >= min(NOVEL, NOVEL_SHARE * by_chance):
                    found[start, end] = score
                    covered = max(covered, end)
    last, out = 0, []
    for (a, b), score in sorted(found.items()):
        if a >= last:
            out.append((a, b, score))
            last = b
    return out


SCANNED = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint,"
    " novelty double, findings array<struct<kind:string,start:int,end:int,novelty:double>>"
)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scanner(dictionary: bytes):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64(), pa.list_(kind)]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "novelty", "findings"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty)
                weights = {(a, b, 3): s for a, b, s in more}
                for a, b, k in base:
                    weights[a, b, k] = novelty.of(text[a:b], text[max(0, a - SURROUNDING) : a] + text[b : b + SURROUNDING // 2])
                every = sorted(weights, key=lambda x: (x[0], x[2]))
                counts = [sum(k == i for _, _, k in base) for i in range(3)]
                findings = [{"kind": KINDS[k], "start": a, "end": b, "novelty": weights[a, b, k]} for a, b, k in every]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, _joined(every), len(more), max(weights.values(), default=0.0), findings))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return scan


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, all spans, and each with its novelty.

    Spans count code points, end exclusive. A null or empty text has no findings; rows that repeat are scanned alike; a
    null id stays null; other columns are not read. The dictionary is made from all texts unless one is given.
    """
    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    if dictionary is None:
        dictionary = identifier_dictionary(docs, text)
    return rows.mapInArrow(_scanner(dictionary), SCANNED)
