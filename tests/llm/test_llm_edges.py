"""Nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402

from medialog.llm import (  # noqa: E402
    bpe, chat_format, decontaminate, exact_dedup, language_id, license_scan, near_dedup, quality, token_counts, warc,
)
from medialog.llm.common import pick_rows  # noqa: E402
from medialog.llm.queries import QUERIES  # noqa: E402
from medialog.llm.shingles import Bands, estimates, minima, packed, shingle_set, word_hashes  # noqa: E402
from medialog.llm.vocabulary import read_vocabulary  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, kept string, id long, row string, digest string"
LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [
    (1, "one two three four five six"), (2, "one two\nthree four five six "), (3, None), (4, ""), (5, " \t\n"),
    (6, LONG), (6, LONG), (None, "alone with no id"), (None, "alone with no id"), (None, "another one"), (7, "ÀÉ ünï 漢字 😀"),
    (8, "123 456 !!"), (8, "same id, other text"), (9, "<|endoftext|> and <|startoftext|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "mine", 5, "r", "d") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    assert (by_id[1][0].keep_id, by_id[1][0].group_size, by_id[1][0].kept) == (2, 2, False)
    assert by_id[2][0].kept  # more code points
    assert {by_id[k][0].keep_id for k in (3, 4, 5)} == {5}  # null, empty and blank are equal
    assert [r.group_size for r in by_id[6]] == [2, 2]
    assert len(by_id[None]) == 3 and all(r.kept for r in by_id[None])
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[:8]) for r in left.collect()) == sorted(
        (i or 0, t[:8]) for i, t in {(i, t) for i, t in ROWS if i not in (1, 3, 4)}
    )
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_row_with_an_id_is_kept_before_one_without(spark):
    rows = spark.createDataFrame([(None, "a b"), (5, "ab "), (4, "a b")], "doc_id long, text string")
    assert [r.id for r in exact_dedup.exact_duplicates(rows).where("kept").collect()] == [4]


def test_near_duplicates(docs, empty, spark):
    got = near_dedup.near_duplicates(docs, words=3, percent=85).collect()
    assert len(got) == len(ROWS)
    found = {(r.id, r.row): r for r in got}
    assert {r.component_id for r in got if r.id in (1, 2)} == {1}
    assert all(r.kept and r.component_id == r.id and r.n_shingles == 0 for r in got if r.id in (3, 4, 5))
    assert len(found) == len(set(ROWS))
    left = near_dedup.drop_near_duplicates(docs, words=3, percent=85)
    assert left.columns == docs.columns and left.count() == len({r for r in ROWS if r[0] != 2})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_copies_of_one_centre_meet(spark):
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]

    def copy(k):
        out = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 5)):
            out[at] = f"x{k}-{at}"
        return " ".join(out)

    texts = {k: copy(k) for k in range(150)} | {k: " ".join(rnd.sample(base, 60)) for k in range(150, 170)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(rows, words=3, percent=85).collect()}
    assert got == plain.components(texts, 3, 85)


def test_no_block_holds_a_group_of_strays(spark):
    rows = spark.createDataFrame([(0, k, max(k, 20), 20) for k in range(200)], "centre long, class long, component long, largest long")
    sizes = rows.withColumn("bytes", F.lit(100))
    for most, most_bytes in ((16, 1 << 20), (1000, 1600)):
        blocks = {}
        for r in near_dedup.dealt(rows, sizes, most, most_bytes).collect():
            blocks.setdefault(r.block, []).append((r["class"], r.own))
        assert max(map(len, blocks.values())) <= 4 * 16
        met = []
        for members in blocks.values():
            own = [c for c, mine in members if mine]
            others = [c for c, mine in members if not mine]
            met += [(a, b) for a in own for b in others] if others else [(a, b) for a in own for b in own if a < b]
        assert sorted((min(p), max(p)) for p in met) == [(a, b) for a in range(200) for b in range(a + 1, 200) if b > 20]


def test_estimates_are_near_the_similarity():
    bands = Bands(0.85)
    assert (1 - 0.85**bands.rows) ** bands.count <= bands.miss
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:1800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sign = packed(minima([a, b], bands.hashes), bands)
    assert abs(float(estimates(sign[0], sign[1], bands)) - true) < 0.12


@given(st.lists(st.text(alphabet="aAbé \n\t\x1c.", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingle_counts(texts):
    for text, found in zip(texts, word_hashes([t.encode() for t in texts]), strict=True):
        assert len(shingle_set(found, 3)) == len(plain.shingles(text, 3))


def test_language(docs, empty, spark):
    labelled = spark.createDataFrame([("aa", "abab baba abba"), ("bb", "xyxy yxyx"), (None, "zz"), ("aa", None)], "lang string, text string")
    model = language_id.fit(labelled)
    assert model.languages == ["aa", "bb"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(ROWS)
    assert {r.id for r in got if r.lang_pred == "und"} == {3, 4, 5, 8} - {8} | {8}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = language_id.drop_unknown(docs, model, least=-1e9)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert language_id.drop_unknown(docs, model).count() == 0  # none is like the few words learned
    assert language_id.predict(empty, model).count() == 0
    none = language_id.fit(labelled.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_language_is_learned_from_texts_not_copies(spark):
    page, words = "qqq " * 20, [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rnd = random.Random(5)
    other = [" ".join(rnd.sample(words, 12)) for _ in range(40)]
    rows = [("aa", page)] * 4_000 + [("aa", t) for t in other] + [("bb", f"xyz{k} zyx yxz") for k in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string").repartition(4), rows_per_language=100)
    unseen = spark.createDataFrame([(k, " ".join(rnd.sample(words, 12))) for k in range(50)], "doc_id long, text string")
    assert {r.lang_pred for r in language_id.predict(unseen, model).collect()} == {"aa"}
    # The page counts once among the 41 texts, so its letter is not the most of the language.
    matrix = model.parts[0].value
    grams = language_id.features(["q"])[0]
    assert np.exp(matrix[grams[3], 0]) < 0.1


def test_no_label_is_left_out_of_the_model(spark, monkeypatch):
    rows = [(f"l{k}", f"{chr(97 + k) * 3} {chr(98 + k) * 2}") for k in range(7)] + [("l0", "aaaa bbb")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    whole = language_id.fit(labelled)
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    parts = language_id.fit(labelled)
    assert len(parts.parts) == 3 and parts.languages == whole.languages == [f"l{k}" for k in range(7)]
    docs = labelled.withColumn("doc_id", F.monotonically_increasing_id())
    found = [{(r.id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, m).collect()} for m in (whole, parts)]
    assert found[0] == found[1] and len({f[1] for f in found[1]}) == 7


def test_quality(docs, empty, spark):
    texts = spark.createDataFrame([(k, "good fine text" if k % 2 else "!! ## !!") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    model = quality.fit(texts, labels)
    assert model.score([b"good fine"])[0] > 0.5 > model.score([b"!! ##"])[0]
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    assert quality.fit(texts, labels.where("false")).score([b"x", b""]) == [0.5, 0.5]


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    got = token_counts.count_tokens(docs, BYTE_BPE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library.encode(t or "", add_special_tokens=False)) for _, t in ROWS)
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def test_copies_of_a_very_long_run_are_counted(spark):
    text = "z" * 140_000
    rows = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(BYTE_BPE)
    want = len(library.encode(text, add_special_tokens=False))
    assert want > 65_535
    assert {r.id: r.n_tokens for r in token_counts.count_tokens(rows, BYTE_BPE).collect()} == {1: want, 2: want, 3: 1}
    assert token_counts.Frequent({text: want}).table() == {text: want}


def test_bpe(docs, empty):
    library = Tokenizer.from_file(WORD_BPE)
    got = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    assert sorted(list(r.ids) for r in got) == sorted(want)
    assert sorted(r.text for r in got) == sorted(library.decode(i, skip_special_tokens=False) for i in want)
    both = bpe.encode(docs, WORD_BPE, and_decode=True).select("ids", "text").collect()
    assert sorted(r.text for r in both) == sorted(r.text for r in got)
    assert bpe.decode(bpe.encode(empty, WORD_BPE), WORD_BPE).count() == 0


ENCODER = bpe.Encoder(read_vocabulary(WORD_BPE))
WORDS = Tokenizer.from_file(WORD_BPE)
COUNTS = token_counts.Counts(read_vocabulary(BYTE_BPE), token_counts.Frequent({" the": 1}))
BYTES = Tokenizer.from_file(BYTE_BPE)
ODD = st.text(alphabet=st.one_of(st.sampled_from(list("aabeinnt ' .0123éüÉİßΣςσ漢<|>\n\t\x1c\x00́ ")), st.characters(codec="utf-8")), max_size=30)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_any_text_is_encoded_as_by_the_library(text):
    assert list(ENCODER.encode([text.encode()])[0]) == WORDS.encode(text, add_special_tokens=False).ids
    assert COUNTS.of(text) == len(BYTES.encode(text, add_special_tokens=False))


@given(st.text(alphabet="aein", min_size=1, max_size=16))
@settings(max_examples=300, deadline=None)
def test_trie_gives_plain_merges(word):
    ids = np.frombuffer(ENCODER.merges.encode_words([word])[word], np.int32).tolist()
    assert ids == ENCODER.merges.merged(ENCODER.merges.symbols(word + "</w>"))


def test_unicode_classes_agree_where_the_library_is_not_asked():
    for point in range(0x30000):
        c = chr(point)
        if not 0xD800 <= point < 0xE000 and not token_counts._OTHER.search(c):
            text = f"a{c}1 {c}{c}  !{c} "
            spans = [m.span() for m in token_counts.PRE_TOKENS.finditer(text)]
            assert spans == [o for _, o in BYTES.pre_tokenizer.pre_tokenize_str(text)], hex(point)


def test_conversations(spark):
    rows = [
        (1, 0, "user", "a</turn>###\\"), (1, 1, "assistant", None), (1, 1, "assistant", "é😀"), (2, None, None, "x"), (2, 5, "odd: role:", ": y"),
        (None, 0, "user", "no conversation"), (3, 0, "assistant", "z" * 9_000_000), (3, 1, "assistant", "end"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    formatted = chat_format.format_conversations(turns)
    read = {}
    for r in formatted.orderBy("conv_id", "part").collect():
        read.setdefault(r.conv_id, []).extend(chat_format.read_turns(r.text))
    order = sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or ""))
    for conv in {r[0] for r in rows}:
        assert sorted(read[conv]) == sorted((r[2] or "", r[3] or "") for r in order if r[0] == conv)
    sums = {r.conv_id: r for r in chat_format.sum_up(formatted).collect()}
    assert (sums[1].n_turns, sums[1].loss_chars, sums[3].loss_chars, sums[4].n_turns) == (3, 2, 9_000_003, 2)
    assert chat_format.sum_up(chat_format.format_conversations(turns.where("false"))).count() == 0


def test_a_long_conversation_over_many_tasks(spark):
    turns = spark.range(4000).select(
        (F.col("id") % 3 * F.lit(0) + F.when(F.col("id") < 3900, 7).otherwise(F.col("id"))).cast("long").alias("conv_id"),
        F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"),
    )
    formatted = chat_format.format_conversations(turns, partitions=16)
    assert formatted.where("conv_id = 7").count() > 4
    many = {r.conv_id: tuple(r) for r in chat_format.sum_up(formatted).collect()}
    one = {r.conv_id: tuple(r) for r in chat_format.sum_up(chat_format.format_conversations(turns, partitions=1)).collect()}
    assert many == one and len(many) == 101


def test_archive(spark, tmp_path):
    big = "x" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (3, "u", ""), (None, "v", big), (9, "w", "small"), (8, "w", "small"), (5, "u", big[:-1] + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "a"), "2024-01-01T00:00:00Z")
    assert warc.read_payloads(spark, str(tmp_path / "a")).count() == 4
    records = warc.read_archive(spark, str(tmp_path / "a"))
    got = sorted((r.page_id or 0, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in records.collect())
    assert got == sorted(
        (i or 0, h or "", "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, _, h in rows
    )
    whole = {r.page_id: bytes(r.record) for r in warc.record_bytes(records.where("page_id IN (2, 1)")).collect()}
    assert whole[2].endswith(big.encode() + b"\r\n\r\n") and whole[1].endswith(b"charset=utf-8\r\n\r\n\r\n\r\n") and b"\r\nX: y" not in whole[1]
    warc.write_archive(pages.where("false"), str(tmp_path / "none"), "2024-01-01T00:00:00Z")
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_damaged_payloads_are_refused(spark, tmp_path):
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "address string, payload binary").write.parquet(str(tmp_path / "payloads"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_payloads(spark, str(tmp_path)).collect()


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/LICENSE.2", "Licensed under CC BY-NC 4.0."), ("a/b/x.py", "nothing"), ("a/b/c/COPYING", None),
        ("a/b/y.py", "code\nLicensed under the Apache License, Version 2.0.\nmore"), ("z/q.py", ""), ("top.py", "x"), (None, "Released under the MIT License."),
        ("a/d/licence.md", "Something else altogether"), ("a/d/e/f.c", LONG), ("a/b/x.py", "nothing again"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("clash"))
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in license_scan.scan_licences(files).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", None)
    assert got["a/b/x.py"] == ("CC-BY-NC-4.0", "inherited", "a")  # both score 1: the first by name
    assert got["a/b/y.py"] == ("Apache-2.0", "own", None)
    assert got["a/d/e/f.c"] == ("CC-BY-NC-4.0", "inherited", "a")
    assert got["z/q.py"] == got["top.py"] == (None, "none", None)
    assert len(got) == 9
    assert license_scan.scan_licences(files.where("false")).count() == 0


def test_first_notices_are_found(spark):
    header = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    files = spark.createDataFrame([("a/x.c", f"code\n{header}\nmore")], "path string, text string")
    assert [(r.own_licence, r.own_score) for r in license_scan.scan_licences(files).collect()] == [("Apache-2.0", 1.0)]
    common = license_scan.scan_licences(files, (("X", "for the use of this file by any and all"),))
    assert [r.licence for r in common.collect()] == [None]


def test_wrapped_notices_sentences_and_tags_are_found(spark):
    rows = [
        ("a/bsd.c", "/* Redistribution and use in source and\n * binary forms, with or without\n * modification, are permitted. */\nint x;"),
        ("b/sentence.md", "A tool for many small tasks of all kinds. Released under the MIT License. It runs on most machines."),
        ("c/tag.py", "# SPDX-License-Identifier: MIT\nx = 1"), ("d/none.py", "nothing\nof the kind"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.licence for r in license_scan.scan_licences(files).collect()}
    assert got == {"a/bsd.c": "BSD-3-Clause", "b/sentence.md": "MIT", "c/tag.py": "MIT", "d/none.py": None}
    lines = {r.path: r.licence for r in license_scan.scan_licences(files, lines_only=True).collect()}
    assert set(lines.values()) == {None}


def test_registered_scan_finds_wrapped_notices_and_tags(spark, tmp_path):
    rows = [
        (1, "/* Redistribution and use in source and\n * binary forms, with or without\n * modification, are permitted. */\n" + "int x;\n" * 20),
        (2, "# SPDX-License-Identifier: MIT\n" + "x = 1\n" * 20), (3, "nothing of the kind\n" * 20),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'code' AS source", "length(text) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.own_licence for r in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "MIT", 3: None}


def test_passages(docs, empty, spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "Short item"), (None, "no id here"), (4, None), (5, "..."), (2, "Short item")], "item_id long, text string")
    texts = [(1, f"x {item.upper()} y"), (2, "a short, item! SHORT item"), (3, None), (4, item[:40]), (5, "has no id here too"), (None, "short item"), (None, "short item")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = sorted((r.id or 0, r.n_words, [(s.start, s.end) for s in r.spans], list(r.items)) for r in decontaminate.find_passages(rows, items).collect())
    assert got == [
        (0, 2, [(0, 2)], ["2"]), (0, 2, [(0, 2)], ["2"]), (1, 13, [(1, 12)], ["1"]), (2, 5, [(1, 5)], ["2"]), (3, 0, [], []), (4, 7, [], []), (5, 5, [(1, 4)], []),
    ]
    blocks = decontaminate.find_passages(rows, items, block=1)
    assert sorted((r.id or 0, r.n_words, [(s.start, s.end) for s in r.spans], list(r.items)) for r in blocks.collect()) == got
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(rows, items).collect()) == [3, 4]
    assert decontaminate.drop_contaminated(rows, items.where("false")).count() == len(texts)
    assert decontaminate.find_passages(empty, items).count() == 0
    assert decontaminate.find_passages(docs, items).count() == len(ROWS)


WORD = st.sampled_from("a b c d".split())


@given(st.lists(WORD, max_size=40), st.lists(st.lists(WORD, min_size=1, max_size=13), max_size=4))
@settings(max_examples=200, deadline=None)
def test_search_finds_what_a_plain_search_finds(text, items):
    windows = {}
    for k, item in enumerate(items):
        n = min(10, len(item))
        for at in range(len(item) - n + 1):
            windows.setdefault(" ".join(item[at : at + n]), set()).add(str(k))
    patterns = decontaminate.compile_patterns([(w, sorted(i)) for w, i in windows.items()])
    spans, names = decontaminate.spans_in([w.encode() for w in text], patterns)
    hit, found = plain.hit_words(" ".join(text), {str(k): " ".join(i) for k, i in enumerate(items)})
    assert {p for a, b in spans for p in range(a, b)} == hit and names == found


def test_rows_are_picked_once(docs):
    chosen = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"))
    assert pick_rows(docs, chosen).count() == len(set(ROWS))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["#", "##", "\\", "<", "/turn>", "</turn>", ": ", " ", "a", "\n"]), max_size=12).map("".join))
def test_no_control_string_in_escaped_texts(text):
    safe = chat_format.escaped(pa.array([text]))[0].as_py()
    assert "###" not in safe and "</turn>" not in safe and chat_format.unescaped(safe) == text
    role = chat_format._escaped_roles(pa.array([text]))[0].as_py()
    assert "###" not in role and "</turn>" not in role and ": " not in role and chat_format.unescaped(role) == text


def test_records_are_rebuilt_and_lost_or_changed_ones_refused(spark, tmp_path):
    big = "ü<html>" + "x" * 2_000 + "\r\n\r\nmore"
    rows = [(1, "http://a\r\nX: y", "small"), (2, None, big), (3, "u", big), (None, "v", big), (4, "w", None)]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a")
    warc.write_archive(pages, path, "2024-01-01T00:00:00Z")
    found = warc.reconstructed(warc.read_archive(spark, path)).collect()
    assert sorted((r.page_id or 0, bytes(r.payload).decode()) for r in found) == sorted((i or 0, h or "") for i, _, h in rows)
    whole = {r.page_id: bytes(r.record) for r in found}
    assert whole[3].count(big.encode()) == 1 and big.encode() not in whole[2] and whole[4].endswith(b"utf-8\r\n\r\n\r\n\r\n")
    headers = spark.read.parquet(f"{path}/headers")
    changed = headers.withColumn("header", F.expr("cast(replace(cast(header as string), 'Content-Length: ', 'Content-Length: 1') as binary)"))
    changed.write.parquet(str(tmp_path / "b/headers"))
    spark.read.parquet(f"{path}/payloads").write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="differs from its header"):
        warc.reconstructed(warc.read_archive(spark, str(tmp_path / "b"))).collect()
    headers.write.parquet(str(tmp_path / "c/headers"))
    spark.read.parquet(f"{path}/payloads").where("octet_length(payload) < 100").write.parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(Exception, match="no payload has the digest"):
        warc.read_archive(spark, str(tmp_path / "c")).collect()


def test_language_of_a_text_in_pieces(monkeypatch):
    text = "Viele Wörter ΟΔΥΣΣΕΥΣ İstanbul und so weiter, " * 60
    whole = np.concatenate(list(language_id.points_of(text)))
    monkeypatch.setattr(language_id, "SLICE", 100)
    for own in (text, text.replace("Σ", "s"), "x" * 1_000):
        pieces = list(language_id.points_of(own))
        joined = np.concatenate([pieces[0], *(p[2:] for p in pieces[1:])])
        assert len(pieces) > 5 and joined.tolist() == [ord(c) for c in f"  {own.lower()} "]
    assert len(whole) == len(f"  {text.lower()} ")


def test_rows_are_picked_whatever_their_columns_are_called(spark):
    clash = "doc_id long, text string, __id string, __row long, __NTH int, ___no_id boolean"
    docs = spark.createDataFrame([(1, "a", "x", 1, 1, True), (1, "a", "x", 1, 1, True), (2, "b", "y", 2, 2, None)], clash)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_bpe_caches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    encoder, library = bpe.Encoder(read_vocabulary(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 60))) for _ in range(20))
        (ids,) = encoder.encode([text.encode()])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(encoder.cache.held, encoder.words.held) < 20_000 + 20 * 600
        assert encoder.cache.held == sum(encoder.cache.size(*x) for x in encoder.cache.items())


def test_crowded_buckets_have_one_centre(spark):
    """Each member is in two of three crowded buckets, one in all; a small bucket keeps that of the most rows."""
    rows = [(k, 1, band) for k in range(300) for band in (1, 2, 3) if k == 5 or k % 3 + 1 != band]
    rows += [(7, 1, 9), (8, 2, 9), (11, 1, 10)]
    got = near_dedup._centres(spark.createDataFrame(rows, "class long, rows long, band long"))
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 5), (3, 5), (9, 8)]
