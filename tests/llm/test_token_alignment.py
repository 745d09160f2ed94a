"""Cross-tokenizer alignment against plain loops over tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm.conftest import messy_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolattice.llm import token_alignment
from aerolattice.llm.queries import byte_bpe, piece_model

NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
EXTRA = [
    (40, "x<|endoftext|>y <s> </s> <unk> <0x0A>"),
    (41, "a▁b is not spelled back"),
    (42, "ﬁ é é 　x﻿ \r\n\t end "),
    (43, "  two  blanks   "),
    (44, "the the the the the " * 40),
    (44, "the the the the the " * 40),
]


def rows():
    return [(i, t) for i, t, *_ in messy_rows()] + EXTRA


def spelled(text, library, pieces):
    """Ends of the tokens by their decoded bytes, without the operator's tables."""
    if not text:
        return [], []
    want = (" " + text).encode()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found = library.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in token)) for i, token in zip(found.ids, found.tokens)]
    b = []
    for i in pieces.encode(text):
        p = pieces.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(rows):
    import sentencepiece

    library = Tokenizer.from_file(byte_bpe())
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = spelled(text, library, pieces)
        ends = []
        for side in (a, b):
            at, places = 0, []
            for _, token in side:
                at += len(token)
                places.append(at)
            ends.append(places)
        second = {e: k for k, e in enumerate(ends[1])}
        both = [(k, second[e]) for k, e in enumerate(ends[0]) if e in second]
        links = [(a[x][0], b[y][0]) for x, y in both]
        cut, x0, y0 = [], 0, 0
        for x, y in both:
            cut.append(",".join(str(t) for t, _ in a[x0 : x + 1]) + "|" + ",".join(str(t) for t, _ in b[y0 : y + 1]))
            x0, y0 = x + 1, y + 1
        counts.update(links)
        docs.append((i, len(a), len(b), len(cut), links, ";".join(cut)))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = Counter()
    for i, n_a, n_b, groups, links, cut in docs:
        best = sum(counts[p] == top[p[1]] for p in links)
        digest = hashlib.sha256(cut.encode()).hexdigest() if cut else ""
        out[i, n_a, n_b, groups, len(links), best, sum(counts[p] for p in links), digest] += 1
    return out, counts


def test_alignment_equals_a_loop_over_tokens(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string").repartition(3).withColumn("docs", F.lit("clash"))
    want, counts = brute(rows())
    found = token_alignment.alignment(docs, byte_bpe(), piece_model())
    assert Counter(map(tuple, found.select(*NAMES).collect())) == want
    clash = docs.toDF("doc_id", "text", "TEXT")
    assert Counter(map(tuple, token_alignment.alignment(clash, byte_bpe(), piece_model()).select(*NAMES).collect())) == want
    assert token_alignment.alignment(docs.limit(0), byte_bpe(), piece_model()).count() == 0
    _, postings = token_alignment.pair_index(docs, byte_bpe(), piece_model())
    pairs = token_alignment.pair_counts(postings)
    assert {(r.a, r.b): r.links for r in pairs.collect()} == dict(counts)
    assert pairs.where("documents > links").count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    want, _ = brute(rows())
    monkeypatch.setattr(token_alignment, "SLICE", 500)
    monkeypatch.setattr(token_alignment, "ENTRIES", 300)
    batches = [pa.record_batch([pa.array([i for i, _ in rows()], pa.int64()), pa.array([t for _, t in rows()])], names=["doc_id", "text"])]
    monkeypatch.setattr(token_alignment.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 7})())
    made = pa.Table.from_batches(token_alignment._aligner((byte_bpe(), piece_model()))(batches))
    documents, index = made.filter(made["slot"].is_valid()), made.filter(made["slot"].is_null())
    assert len(set(documents["block"].to_pylist())) > 3 and set(index["block"].to_pylist()) <= set(documents["block"].to_pylist())
    facts = Counter(zip(*[documents[name].to_pylist() for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]))
    assert facts == Counter({k[:5] + k[7:]: 0 for k in want}) + Counter(k[:5] + k[7:] for k in want.elements())


def test_containers_round_trip():
    draw = np.random.default_rng(1)
    sets = [np.sort(draw.choice(token_alignment.BLOCK, n, replace=False)) for n in (0, 1, 5, 2047, 2048, 30000, 3, 0)]
    cells = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column, counts = token_alignment.containers(cells, np.concatenate(sets), len(sets))
    assert counts.tolist() == [len(s) for s in sets] and len(column[4].as_py()) == token_alignment.FULL
    found_rows, places = token_alignment.opened(column)
    for k, s in enumerate(sets):
        assert sorted(places[found_rows == k].tolist()) == s.tolist()


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame(EXTRA, "doc_id bigint, text string")
    for row in token_alignment.aligned_groups(docs, byte_bpe(), piece_model()).collect():
        text = dict(EXTRA)[row.doc_id]
        if row.doc_id == 41:
            assert row.groups == []
        else:
            assert [g.start for g in row.groups[1:]] == [g.end for g in row.groups[:-1]]
            assert row.groups[-1].end == len(text.encode()) + 1 and all(g.a and g.b for g in row.groups)


def test_very_long_texts():
    spell = token_alignment.speller(byte_bpe(), piece_model())
    for text in (" " * 1_000_000, "\n" * 1_000_000, "ab" * 500_000):
        found = token_alignment.Aligned(spell, [text])
        assert found.ends[-1] == len(text) + 1
    assert public_tokenizers.path("piece_bpe_32k.model") == piece_model()
