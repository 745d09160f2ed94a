"""Operators against brute force on messy rows, on the same rows with clashing columns, and on no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import messy_rows, prose

from aerolattice.llm import bytetext, decontamination, exact_dedup, jaccard_join, lpf_dedup, packing, secrets
from aerolattice.llm.queries import byte_bpe

PLAIN = [(i, t or "") for i, t, *_ in messy_rows()]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return text.translate(FOLD)


def counted(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def both(messy, clashing, run, *names):
    found = counted(run(messy), *names)
    assert found == counted(run(clashing), *names)
    return found


def test_exact_dedup(messy, clashing, empty):
    groups = defaultdict(list)
    for i, t in PLAIN:
        groups[folded(t)].append(i)
    want = Counter()
    for i, t in PLAIN:
        ids = groups[folded(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(folded(t).encode()).digest()] += 1
    names = ("doc_id", "keep_id", "group_size", "kept", "digest")
    assert both(messy, clashing, exact_dedup.exact_dedup, *names) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    rows = exact_dedup.keep_one(messy)
    assert rows.columns == messy.columns
    assert counted(rows, "doc_id", "text") == Counter({(i, dict((a, b) for a, b, *_ in messy_rows() if a == i)[i]): 1 for i, *_ in want if (i, *_)[3]})
    assert exact_dedup.keep_one(empty).count() == 0


def test_hot_group_is_found_by_broadcast(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) AS text")
    found = exact_dedup.exact_dedup(rows)
    assert found.where("group_size = 1000 AND keep_id = 2997").count() == 1000
    assert found.where("kept").count() == 2001


def test_cuckoo_index_inserts_deletes_and_resizes():
    draw = random.Random(0)
    index, truth = exact_dedup.CuckooIndex(2), {}
    for step in range(20000):
        key = hashlib.sha256(str(draw.randrange(3000)).encode()).digest()
        if draw.random() < 0.6 and key not in truth:
            truth[key] = [step]
            index.insert(key, [step])
        elif draw.random() < 0.5:
            assert index.delete(key) == truth.pop(key, None)
        assert index.find(key) == truth.get(key)
    assert dict(index.live()) == truth and index.resizes


def test_cuckoo_index_tells_equal_fingerprints_apart():
    index = exact_dedup.CuckooIndex()
    keys = [bytes(10) + bytes([i]) * 22 for i in range(40)]
    for i, key in enumerate(keys):
        if i < 8:  # two buckets hold eight of one fingerprint; more need other fingerprints
            index.insert(key, [i])
    assert [index.find(k) for k in keys[:8]] == [[i] for i in range(8)] and index.find(keys[9]) is None
    assert index.false_hits


def test_packing_round_trip(messy, clashing, empty):
    from tokenizers import Tokenizer

    spell = Tokenizer.from_file(byte_bpe())

    def run(rows):
        return packing.best_fit_packing(rows, byte_bpe(), room=128)

    rows = run(messy).collect()
    ids = [np.array([*spell.encode(t, add_special_tokens=False).ids, 2], "<u4") for _, t in PLAIN]
    want = Counter()
    for (i, _), x in zip(PLAIN, ids, strict=True):
        cuts = sorted({0, *range(len(x), 0, -128)} - {len(x)}) if len(x) > 128 else [0]
        for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(x)], strict=True)):
            want[i, n, a, b - a, zlib.crc32(x[a:b].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want == counted(run(clashing), *run(messy).columns[:5])
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert len(held) <= -(-sum(map(len, ids)) // 128) + 3
    assert run(empty).count() == 0


def test_special_token_in_a_text():
    t = packing.tokenizer(byte_bpe())
    text = "a <|endoftext|> b  c\n\n d' 's"
    assert t.encode(text).tolist() == t.inner.encode(text, add_special_tokens=False).ids
    assert t.encode(PLAIN[0][1]).tolist() == t.inner.encode(PLAIN[0][1], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    histogram = dict(Counter(min(64, 1 + int(draw.expovariate(0.08))) for _ in range(500)))
    patterns = packing.plan(histogram, 64)
    assert all(sum(p) <= 64 for p, _ in patterns)
    placed = Counter()
    for pattern, number in patterns:
        for length in pattern:
            placed[length] += number
    assert placed == Counter(histogram)
    # best fit decreasing over single pieces needs as many sequences
    rooms = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            rooms.append(64 - length)
        else:
            rooms.remove(fit)
            rooms.append(fit - length)
    assert sum(n for _, n in patterns) <= len(rooms) + 2
    assert len(packing.slots(patterns)) == sum(len(set(p)) for p, _ in patterns)


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_text(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_scan(messy, clashing, empty):
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = Counter()
    for i, t in PLAIN:
        base = base_text(t)
        want[i, *(base.count(k) for k in ("assign:", "access:", "hex:")), hashlib.sha256(base.encode()).hexdigest()] += 1
    assert both(messy, clashing, secrets.secret_scan, *names) == want
    assert secrets.secret_scan(empty).count() == 0


def test_novel_strings_are_found_in_sensitive_context_only(spark):
    draw = random.Random(4)
    key = "".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        "authorization: Bearer " + key + " end",
        "see page " + key + " end",
        "bearer word1word1word1word1word1 end",
        "password=token=abcdefghijkl password: token: abcdefghijklmnop",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in secrets.secret_scan(rows, dictionary=b"word1 word2 token password").collect()}
    assert found[0].spans == f"novel:22:{22 + 40}" and found[0].n_novel == 1
    assert found[1].spans == "" and found[2].spans == ""
    assert found[3].spans == base_text(texts[3]) or found[3].spans.startswith(base_text(texts[3]))


def test_long_strings_end_where_they_end(spark):
    draw = random.Random(5)
    key = "".join(draw.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(2000))
    rows = spark.createDataFrame([(1, "bearer " + key + " end"), (2, "credential, bearer " + key + " end")], "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in secrets.secret_scan(rows, dictionary=b"end").collect()}
    assert found == {1: "novel:7:2007", 2: "novel:19:2019"}


def test_novelty_is_measured_for_every_alphabet_and_beside_base_spans():
    novelty, missed = secrets.Novelty(b"end"), []
    near = prose(3, 30)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for size in (12, 40, 64, 128, 384):
        for kind in ("0123456789ABCDEF", letters, letters + "0123456789+/", letters[:26]):
            for k in range(20):
                key = "".join(random.Random(k).choices(kind, k=size))
                text = near + " bearer " + key + " " + near
                base = secrets.base_spans(text)
                spans = secrets.novel_spans(text, base, novelty)
                if not base and [x[:2] for x in spans] != [(len(near) + 8, len(near) + 8 + size)]:
                    missed.append((size, kind, k))
    assert all(size == 12 for size, _, _ in missed) and len(missed) <= 8  # short ones vary
    key = "Qx" + letters[::-3] + "0123456789abcdef" + letters[::-5] + "GhJkWz"
    text = "bearer " + key + " end"
    base = secrets.base_spans(text)
    spans = [x[:2] for x in secrets.novel_spans(text, base, novelty)]
    (start, end, _), = base
    assert spans == [(7, start), (end, 7 + len(key))]


def removed(rows, length):
    owner = {}
    for i, t in rows:
        if i is not None:
            b = t.encode()
            for s in range(len(b) - length + 1):
                owner[b[s : s + length]] = min(i, owner.get(b[s : s + length], i))
    out = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if i is not None and owner[b[s : s + length]] < i:
                gone[s : s + length] = True
        starts = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_passage_removal(messy, clashing, empty, monkeypatch):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = removed(PLAIN, 50)
    assert both(messy, clashing, lpf_dedup.remove_repeats, *names) == want
    monkeypatch.setattr(lpf_dedup, "CROWDED", 1)  # windows are dealt one by one
    monkeypatch.setattr(lpf_dedup, "STEP", 257)  # stretches are cut
    monkeypatch.setattr(lpf_dedup, "SORTED_AT_ONCE", 40)
    assert counted(lpf_dedup.remove_repeats(messy), *names) == want
    assert lpf_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [24, 37, 64])
def test_passage_removal_lengths(spark, length):
    draw = random.Random(length)
    parts = [prose(k, 12) for k in range(8)]
    rows = [(i, "".join(draw.choice(parts)[: draw.randrange(90)] for _ in range(6))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = lpf_dedup.remove_repeats(df, length)
    assert counted(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, length)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_components(messy, clashing, n, percent):
    def run(rows):
        return jaccard_join.jaccard_components(rows, n, percent)

    assert both(messy, clashing, run, "doc_id", "n_shingles", "component_id") == components(PLAIN, n, percent)


def test_jaccard_chains_through_large_clusters(spark, empty, monkeypatch):
    draw = random.Random(8)
    rows, text = [], [f"w{draw.randrange(5000)}" for _ in range(60)]
    for i in range(160):  # each a step from the one before, so ends differ but hang together
        text = list(text)
        text[draw.randrange(60)] = f"w{draw.randrange(5000)}"
        rows.append((1000 - i, " ".join(text[: 60 - i % 4])))
        if i % 9 == 0:
            text = text[10:] + [f"w{draw.randrange(5000)}" for _ in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = components(rows, 3, 80)
    for block, crowded in ((512, 4096), (5, 4096), (5, 2)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
        assert counted(jaccard_join.jaccard_components(df, 3, 80), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_a_small_set_in_a_group_does_not_tie_large_ones():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 1 << 63, 5000).astype(np.uint64))
    other = np.unique(draw.integers(0, 1 << 63, 5000).astype(np.uint64))
    near = np.unique(np.r_[base[20:], other[:20]])
    sets = [base[:40], base, other, near]
    maps = [jaccard_join.bitmap(x, jaccard_join.bits_for(len(x))).tobytes() for x in sets]
    ties = jaccard_join.group_ties(np.arange(4), np.array([len(x) for x in sets]), maps, 90)
    assert [sorted(t) for t in ties] == [[1, 3]]


def test_jaccard_links_survive_a_copy_without_id(spark):
    base = prose(1, 300)
    rows = [(None, base), (1, base), (2, base + " tail"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert counted(jaccard_join.jaccard_components(docs), "doc_id", "component_id") == Counter({(None, None): 2, (1, 1): 1, (2, 1): 1})


def test_bitmaps_bound_the_overlap_from_above():
    draw = np.random.RandomState(1)
    pool = draw.randint(0, 1 << 62, 900).astype(np.uint64)
    for _ in range(30):
        a, b = (np.unique(draw.choice(pool, draw.randint(5, 500))) for _ in range(2))
        maps = [jaccard_join.bitmap(x, 256)[None] for x in (a, b)]
        wide = jaccard_join._folded(jaccard_join.bitmap(a, 1024).tobytes(), 256)
        assert (wide == maps[0][0]).all()
        bound = jaccard_join._overlap_bound(*maps, np.array([len(a) + len(b)]))[0]
        assert bound >= len(np.intersect1d(a, b))


def alnum(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text)) if w]


def contaminated(rows, items):
    out = Counter()
    for i, t in rows:
        w, hit, names = alnum(t), set(), set()
        for name, text in items:
            v = alnum(text or "")
            size = min(13, len(v))
            windows = {tuple(v[s : s + size]) for s in range(len(v) - size + 1)} if v else set()
            for s in range(len(w) - size + 1 if v else 0):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    names.add(name)
        joined = ",".join(sorted(names))
        digest = hashlib.sha256(joined.encode()).hexdigest()
        out[i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontamination(spark, messy, clashing, empty):
    passage = prose(2, 60).split()
    items = [("a", " ".join(passage[5:30])), ("b", "Two words"), ("c", None), ("d", ""), ("e", " ".join(passage[20:33])), ("f", prose(99, 30))]
    items += [("g", " ".join(passage[5:30])), ("h", " ".join((passage[0] + " ") * 3 + w for w in passage[:3]))]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def run(rows):
        return decontamination.contamination(rows, bench)

    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert both(messy, clashing, run, *names) == contaminated(PLAIN, items)
    assert run(empty).count() == 0
    none = bench.where("item_id = 'zz'")
    assert counted(decontamination.contamination(messy, none), *names) == contaminated(PLAIN, [])


def test_decontamination_in_blocks(spark, monkeypatch):
    rows = [(k, prose(k, 50)) for k in range(30)]
    items = [(f"i{k}", prose(k % 20, 40 + k)) for k in range(25)]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    found = decontamination.contamination(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    )
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert counted(found, *names) == contaminated(rows, items)


def test_rows_keep_their_own_text_in_blocks(spark, monkeypatch):
    items = [(f"i{k}", prose(k, 40)) for k in (2, 3, 5, 6, 90, 91)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = [*PLAIN, (1, prose(5, 60)), (None, prose(3, 50)), (None, prose(3, 50))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (decontamination.BLOCK_WORDS, 1000, 60):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        assert counted(decontamination.contamination(docs, bench), *names) == contaminated(rows, items)


def test_tokenizer_takes_very_long_blank_runs():
    t = packing.tokenizer(byte_bpe())
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 60_000 + "b", "a" + " " * 40_000 + "b"):
        assert t.encode(text).tolist() == t.inner.encode(text, add_special_tokens=False).ids


def twins():
    """Two words of 1,024 letters that any sum of powers modulo 2^64 gives one hash."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_by_construction_stay_apart(spark):
    one, two = twins()
    docs = spark.createDataFrame([(1, f"x {one} y z"), (2, f"x {two} y z"), (3, one), (4, two)], "doc_id bigint, text string")
    groups = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4}
    test = spark.createDataFrame([("t", one)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(docs, test).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_byte_hashes_name_their_bytes():
    draw = random.Random(3)
    parts = [bytes(draw.randrange(3) for _ in range(n)) for n in [*range(0, 140), 8, 8, 16, 64, 65, 5000] for _ in range(8)] + [b"", b"\0", b"\0" * 8, b"\0" * 9]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    hashes = bytetext.byte_hashes(data, ends - [len(p) for p in parts], ends)
    named = {}
    for part, value in zip(parts, hashes.tolist(), strict=True):
        assert named.setdefault(part, value) == value
    assert len(set(named.values())) == len(named)


def test_unbroken_strings_of_sensitive_words_are_measured_once():
    novelty, asked = secrets.Novelty(b"dictionary"), []
    counted = type("Counted", (), {"against_random": lambda self, *x: asked.append(len(x[0])) or novelty.against_random(*x)})()
    for text in ("token" * 20_000, "password" + "secret" * 20_000 + "!"):
        asked.clear()
        secrets.novel_spans(text, secrets.base_spans(text), counted)
        assert len(asked) <= 2
