"""The filter audit against a plain loop over orders and documents."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from llm.conftest import messy_rows, prose
from pyspark.sql import functions as F

from aerolattice.llm import filter_audit

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
EXTRA = [(30, prose(9, 150), "en"), (31, "SHOUT " * 120, "en"), (32, "a$b " + prose(10, 120), None), (33, " ".join(f"w{i}" for i in range(100)), "")]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (30, 1, None), (33, 1, 0), (31, 0, 1), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def rows():
    return [(i, t, p) for i, t, p, _ in messy_rows()] + EXTRA


def fails(i, text, firsts):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    found = "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    found += "D" if re.search(r"[#$%&*|]", text) else ""
    return found + ("E" if i is not None and any(x < i for x in firsts[text]) else "")


def brute(rows, labels):
    firsts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts, out = defaultdict(list), []
    for i, t, p in rows:
        parts[p or ""].append((fails(i, t or "", firsts), i in good, i in toxic))
    for part, docs in parts.items():
        value, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                kept = [d for d in left if f not in d[0]]
                gone = [d for d in left if f in d[0]]
                value[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                line = (len(kept), len(gone), redundant, sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
                lines.append((part, order, step, *line, f))
                left = kept
        out += [(*line[:-1], value[line[-1]]) for line in lines]
    return Counter(out)


def test_audit_equals_a_loop_over_orders(spark):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("QUALITY ", F.lit(0))
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string").repartition(3).withColumn("part", F.lit("clash"))
    want = brute(rows(), LABELS)
    found = filter_audit.filter_audit(docs, labels)
    assert Counter(map(tuple, found.select(*NAMES).collect())) == want
    clash = docs.toDF("doc_id", "text", "lang", "TEXT").withColumn("failed", F.lit(1))
    assert Counter(map(tuple, filter_audit.filter_audit(clash, labels).select(*NAMES).collect())) == want
    assert filter_audit.filter_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0


def test_a_group_of_copies_with_a_third_of_all_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    row = filter_audit.filter_audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.removed, row.kept) == (999, 2001)


def test_carry_save_adders_count_bits():
    draw = np.random.default_rng(0)
    for size in (0, 1, 2, 3, 4, 100, 4099):
        words = draw.integers(0, 1 << 32, size, dtype=np.uint32)
        want = [(int(((words >> np.uint32(b)) & np.uint32(1)).sum())) for b in range(32)]
        assert filter_audit.positional_counts(words).tolist() == want


def test_very_long_texts():
    assert filter_audit.text_failures(" " * 1_000_000) == 1
    assert filter_audit.text_failures("Ab" * 1_000_000) == 5
    assert filter_audit.text_failures("x\n" * 500_000 + "é|") == 2 | 8
