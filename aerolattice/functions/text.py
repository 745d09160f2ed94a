"""Text statistics, their report, and a guarded ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that separates words, the Unicode spaces and separators included, as UTF-8.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SHORT = np.isin(np.arange(256), [ord(x) for x in BLANKS if ord(x) < 0x80])
LONG = [np.frombuffer(x.encode(), np.uint8) for x in BLANKS if ord(x) >= 0x80]
LEADS = np.isin(np.arange(256), [x[0] for x in LONG])

#: Bytes of text that are looked at together.
SLICE = 1 << 22


def _blank(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a blank."""
    blank = SHORT[data]
    leads = np.flatnonzero(LEADS[data])
    for wanted in LONG if len(leads) else []:
        at = leads[leads <= len(data) - len(wanted)]
        for k, byte in enumerate(wanted):
            at = at[data[at + k] == byte]
        for k in range(len(wanted)):
            blank[at + k] = True
    return blank


def _counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and their characters of texts that lie end to end in `data`, from `ends[i]` to `ends[i + 1]`."""
    shown = ~_blank(data)
    before = np.zeros(len(data), bool)
    before[1:] = shown[:-1]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    words, characters = (np.concatenate([[0], np.cumsum(x)]) for x in (shown & ~before, shown & ((data & 0xC0) != 0x80)))
    return np.diff(words[ends]), np.diff(characters[ends])


def _counted(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    words, characters, first = [], [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        found = _counts(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        words.append(found[0])
        characters.append(found[1])
        first = last
    columns = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int32)) for x in (words, characters)]
    return pa.StructArray.from_arrays(columns, ["word_count", "character_count"], mask=texts.is_null())


COUNTS = T.StructType([T.StructField("word_count", T.IntegerType()), T.StructField("character_count", T.IntegerType())])


def text_stats(text: Column) -> Column:
    """Words are runs between white space; their characters are all but white space. A null text has neither."""
    counts = F.arrow_udf(_counted, COUNTS)(text)
    return F.struct(
        counts.word_count.alias("word_count"),
        counts.character_count.alias("character_count"),
        F.contains(F.lower(text), F.lit("python")).alias("contains_python"),
    )


def text_report(stats: Column) -> Column:
    """Three lines; the flag is spelled True or False."""
    flag = F.when(stats.contains_python, F.lit("True")).otherwise(F.lit("False"))
    return F.format_string(
        "Words: %d\nCharacters: %d\nContains 'Python': %s", stats.word_count, stats.character_count, flag
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
