"""Prefix trie, packing, resampling and running sums against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import groupby, product
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medialog.llm import packing, prefix_trie, resampling
from medialog.llm.queries import QUERIES
from medialog.llm.running import running
from medialog.llm.vocabulary import read_vocabulary

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet " * 40_000
CLASH = "doc_id long, text string, id long, row string, nth long, score long, task long, length long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 5, "r", 1, 2, 3, 4) for i, t in rows], CLASH).repartition(3)


# Running sums


def test_running_sums_of_a_group_that_fills_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(20), k, rng.randrange(-(1 << 63), 1 << 63)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    got = running(df, "g", ["k"], ["v"], partitions=16).collect()
    want = {}
    for g, own in groupby(sorted(rows), key=lambda r: r[0]):
        total = 0
        for n, (_, k, v) in enumerate(own, 1):
            total = (total + v) % (1 << 64)
            want[k] = (g, n, total - (1 << 64) if total >= 1 << 63 else total)
    assert {r.k: (r.g, r.nth, r.run_v) for r in got} == want and len(got) == len(rows)
    assert running(df.where("g < 0"), "g", ["k"], ["v"]).count() == 0


# Prefix trie


def plain_trie(turns, reopen):
    """Nodes of (conv, turn, role, text) rows, by nested loops over all prefixes."""
    own = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    convs = {}
    for c, mine in own.items():
        h = crc32(str(c).encode()) % 6 if reopen else 0
        convs[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, mine in convs.items():
        for d in range(len(mine) + 1):
            members[tuple(mine[:d])].append(c)
    out = []
    for node, mine in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(w[: len(v)] == v and len(w) > len(v) for w in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        ends = ",".join(str(c) for c in sorted(c for c in mine if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(mine), len(node), parent, len(mine), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def conversations(n=60):
    rng = random.Random(5)
    rows = []
    for c in range(n):
        first = rng.choice(["hot", "hot", "hot", "other", ""])
        texts = [first, *(rng.choice("ab") * rng.randrange(3) for _ in range(rng.randrange(5)))]
        rows += [(c if c < n - 5 else c + 95, None if k == 0 else k, None if rng.random() < 0.1 else "user", None if t == "" else t) for k, t in enumerate(texts)]
    rows += [(400, k, "user", f"turn {k % 7}") for k in range(70)]  # far longer than a shard
    return rows


@pytest.mark.parametrize("shard", [7, 1 << 20])
def test_trie_is_exact(spark, shard):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, a long, depth long").repartition(4)
    numbered = prefix_trie.numbered_turns(turns)
    assert trie_rows(prefix_trie.trie(numbered, shard=shard)) == plain_trie(rows, False)
    assert trie_rows(prefix_trie.trie(*prefix_trie.rebuilt(numbered), shard=shard)) == plain_trie(rows, True)


def test_trie_of_rows_without_ids_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "lost")]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))) == plain_trie(rows[:2], False)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))
    a[:5_000] = a[0]  # digests that differ in one half only
    twice = np.concatenate([np.arange(20_000), np.arange(100)])
    nodes = prefix_trie.NodeTable(a[twice], b[twice])
    assert sorted(nodes.slots(a, b).tolist()) == list(range(20_000))
    with pytest.raises(ValueError):
        nodes.slots(a[:1], b[6_000:6_001])


# Packing


def test_ids_in_chunks_are_those_of_the_library():
    library = Tokenizer.from_file(BYTE_BPE)
    vocabulary = read_vocabulary(BYTE_BPE)
    encoders = [packing.Encoder(vocabulary), packing.Encoder(vocabulary, packing.ranks_of(vocabulary))]
    assert encoders[1].merger
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Bc", " ", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "12", "!", "漢", "²", "<|endoftext|>"]) for _ in range(rng.randrange(1, 14)))
        for encoder in encoders:
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_are_merged_as_the_library_merges():
    vocabulary = read_vocabulary(BYTE_BPE)
    library, encoder = Tokenizer.from_file(BYTE_BPE), packing.Encoder(vocabulary, packing.ranks_of(vocabulary))
    rng = random.Random(7)
    letters = "etaoinshrdlucmfwypvbgkjqxzETAOIN.,'-0123456789éüñß"
    for _ in range(20_000):
        text = " " + "".join(rng.choices(letters, k=rng.randrange(1, 25)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    # Ranks are given up where they would not do.
    assert packing.ranks_of(vocabulary.replace('"use_regex": true', '"use_regex": false').replace('"use_regex":true', '"use_regex":false')) is None


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 50)
    vocabulary, library = read_vocabulary(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for encoder, text in product((packing.Encoder(vocabulary), packing.Encoder(vocabulary, packing.ranks_of(vocabulary))), ("word  and\n\n  other   words " * 40, "x" * 300, " " * 300)):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 5_000)
    cache = packing._Cache(lambda chunk: b"1234" * len(chunk))
    for k in range(1_000):
        cache[f"{k}" * 30]
    assert cache.bytes <= 5_000 and len(cache) < 20


def least_sequences(sizes, capacity):
    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        best = len(left)
        for mask in range(1 << len(rest)):
            with_ = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(with_) <= capacity:
                best = min(best, 1 + least(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(sizes)))


def check_solution(solution, counts, capacity):
    used = Counter()
    for filling, times in solution:
        assert sum(s * n for s, n in filling) <= capacity and times > 0
        for s, n in filling:
            used[s] += n * times
    assert used == Counter(counts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_packing_is_as_good_as_trying_all(sizes):
    counts = Counter(sizes)
    solution = packing.pack(counts, 20)
    check_solution(solution, counts, 20)
    fewest = sum(n for _, n in solution)
    assert fewest == least_sequences(sizes, 20) and packing.lower_bound(counts, 20) <= fewest


def test_search_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}  # 3 of 10: best fit needs 4
    best = packing.best_fit({44: 2, 24: 4, 22: 2, 21: 2, 17: 4, 12: 2, 9: 2, 8: 2, 7: 1}, 61)
    assert sum(n for _, n in packing.pack(counts, 10)) == 3
    assert sum(n for _, n in packing.pack({44: 2, 24: 4, 22: 2, 21: 2, 17: 4, 12: 2, 9: 2, 8: 2, 7: 1}, 61)) <= sum(n for _, n in best)


def test_best_fit_by_classes_is_best_fit_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 60) for _ in range(8)}
        rooms = []
        for size in sorted(Counter(counts).elements(), reverse=True):
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                rooms.append(40)
                fit = 40
            rooms.remove(fit)
            rooms.append(fit - size)
        solution = packing.best_fit(counts, 40)
        check_solution(solution, counts, 40)
        assert sorted(40 - sum(s * n for s, n in f) for f, t in solution for _ in range(t)) == sorted(rooms)


def test_a_billion_documents_are_no_more_work():
    counts = {s: 10**9 // s for s in range(1, 1025)}
    solution = packing.pack(counts)
    check_solution(solution, counts, 1024)
    assert sum(n for _, n in solution) <= packing.lower_bound(counts, 1024) * 1.001 and len(solution) < 20_000


def check_packed(rows, texts, capacity=1024):
    """Every document whole, pieces where they should be, sequences without gaps."""
    library = Tokenizer.from_file(BYTE_BPE)
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[(r["id"], r["nth"])].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    found = Counter()
    for own in by_doc.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        starts = np.cumsum([0, *(r["length"] for r in own)]).tolist()
        assert [r["start"] for r in own] == starts[:-1]
        assert all(r["length"] == capacity for r in own[1:]) and own[0]["length"] <= capacity
        found[(own[0]["id"], tuple(r["ids_crc32"] for r in own))] += 1
    want = Counter()
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[(i, tuple(crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)))] += 1
    assert found == want
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    counts = Counter(r["length"] for r in rows)
    assert len(by_sequence) == sum(n for _, n in packing.pack(counts, capacity)) >= packing.lower_bound(counts, capacity)
    return len(by_sequence), packing.lower_bound(counts, capacity)


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    packed = [r.asDict() for r in packing.pack_documents(docs, BYTE_BPE).collect()]
    sequences, bound = check_packed(packed, texts)
    assert sequences <= bound + 1
    query = QUERIES["op12_packing"](spark, SF).collect()
    kept = ["piece", "start", "length", "ids_crc32"]
    assert sorted((r.doc_id, *(r[c] for c in kept)) for r in query) == sorted((r["id"], *(r[c] for c in kept)) for r in packed)


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "same"), (3, "same"), (4, LONG), (5, "<|endoftext|> x"), (6, "z" * 5000)]
    packed = [r.asDict() for r in packing.pack_documents(docs_of(spark, rows), BYTE_BPE, capacity=64).collect()]
    check_packed(packed, rows, 64)
    assert packing.pack_documents(docs_of(spark, []), BYTE_BPE).count() == 0


# Resampling


def plain_resample(rows, target, runs, buckets, min_words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, runs + 1) for k in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("runs", [1, 2])
def test_resampling_is_exact(spark, runs):
    rng = random.Random(8)
    rows = [(k % 90 if k % 11 else None, " ".join(rng.choice(["Red", "green", "blau", "été", "漢字"]) for _ in range(rng.randrange(12)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, LONG), (502, LONG), (503, "!?")]
    target = ["red red green", None, "", "red été"]
    want, drawn = plain_resample(rows, target, runs, 50, 3, 30)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs_of(spark, rows), items, runs=runs, buckets=50, min_words=3, percent=30).collect()
    columns = ["id", "n_words", "n_features", "weight", "score"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_nothing_to_draw(spark):
    items = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of(spark, []), items).count() == 0
    one = resampling.resample(docs_of(spark, [(1, "a b")]), items).collect()
    assert [(r.id, r.n_features, r.rank) for r in one] == [(1, 2, None)]


def test_words_across_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 10)
    text = b"one two three four five six seven eight nine ten eleven"
    words = text.split()
    for runs in (1, 2, 3):
        found = [f for _, own in resampling.features(text, runs) for f in own]
        assert sorted(found) == sorted(b" ".join(words[k : k + n]) for n in range(1, runs + 1) for k in range(len(words) - n + 1))


def test_cutoff_among_ties(spark):
    rng = random.Random(9)
    keys = [(rng.randrange(5), rng.choice([None, 1, 2, 3]), rng.randrange(3), n) for n in range(500)]
    df = spark.createDataFrame(keys, "score long, id long, row long, nth long").repartition(7)
    order = sorted(keys, key=resampling._rank)
    for wanted in (1, 2, 77, 250, 499, 500):
        assert resampling.cutoff(df, wanted) == order[wanted - 1]
        assert df.where(resampling._before(order[wanted - 1])).count() == wanted - 1
    with pytest.raises(ValueError):
        resampling.cutoff(df, 501)


def test_string_ids(spark):
    rows = spark.createDataFrame([(f"d{k}", "a b c") for k in range(40)], "doc_id string, text string")
    got = resampling.resample(rows, rows.select(F.col("text")).limit(1), min_words=1, percent=50).where("rank IS NOT NULL").count()
    assert got == 20
