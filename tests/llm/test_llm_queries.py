"""The registered queries over whole tables, against DuckDB or a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from compare import compare, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from medialog.llm import chat_format, language_id  # noqa: E402
from medialog.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) == []


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_conversations_read_back(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]

    def row(conv, rows):
        learned = "".join(t for r, t in rows if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in rows)
        return conv, len(rows), _sha(whole), len(learned), _sha(learned)

    got = QUERIES["op2_chat_format"](spark, SF).collect()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(row(c, r) for c, r in turns.items())
    # The formatted texts, read by their marks alone.
    rows = [(c, k, role, text) for c, own in turns.items() for k, (role, text) in enumerate(own)]
    parts = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    for conv, own in turns.items():
        formatted = "".join(r.text for r in parts if r.conv_id == conv)
        found = re.findall(r"### ([^:]*): (.*?)</turn>\n", formatted, re.DOTALL)
        assert len(formatted) == sum(len(r) + len(t) + len("### : </turn>\n") for r, t in found) == next(r.formatted_chars for r in got if r.conv_id == conv)
        assert [(r, re.sub(r"\\(.)", r"\1", t, flags=re.DOTALL)) for r, t in found] == own
        assert not any(x in t for _, t in found for x in ("###", "</turn>"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_near_duplicates_are_exact(spark, docs):
    want = plain.components(docs, 3, 85)
    got = QUERIES["op3_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (k, len(plain.shingles(t, 3)), want[k], want[k] == k) for k, t in docs.items()
    }


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    right = Counter(r.quality for r in found if r.predicted == r.quality)
    every = Counter(r.quality for r in found)
    assert right[0] >= 0.8 * every[0] and right[1] >= 0.95 * every[1]


def test_tokens_as_the_library_counts_them(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    counts = {k: len(library.encode(t or "", add_special_tokens=False)) for k, t in docs.items()}
    assert got == {k: (len((t or "").encode()), counts[k], counts[k] > 512) for k, t in docs.items()}


def test_encoding_as_the_library_has_it(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe"](spark, SF).collect()}
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in docs.items()}
    assert got == {k: (len(i), _sha(" ".join(map(str, i))), _sha(library.decode(i, skip_special_tokens=False))) for k, i in ids.items()}


def test_pipeline_against_its_plain_version(spark, docs):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bayes = plain.Bayes([(langs[k], t) for k, t in docs.items()])
    left = {k: t for k, t in docs.items() if any(c.isalpha() for c in t or "") and bayes.likely(t) >= -15 * math.log(2)}
    groups = defaultdict(list)
    for k, t in left.items():
        groups[plain.bare(t)].append(k)
    left = {k: left[k] for g in groups.values() for k in [min(g, key=lambda x: (-len(left[x]), x))]}
    roots = plain.components(left, 5, 80)
    left = {k: t for k, t in left.items() if roots[k] == k}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    left = {k: t for k, t in left.items() if not plain.hit_words(t, items)[0]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in left.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("kept", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("kept <> 'mine'").count() == 0, name


def test_language_against_a_plain_naive_bayes(spark, docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in docs}
    langs = {r.doc_id: r.lang for r in rows.collect()}
    bayes = plain.Bayes([(langs[k], t) for k, t in docs.items() if not out[k]])
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    for k, text in docs.items():
        lang, score = bayes.predict(text)
        assert (got[k].lang_pred, got[k].held_out) == (lang, out[k]) and abs(got[k].score - score) < 1e-3


def test_gibberish_is_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "qqq zzz jjj xxk vvv"), (-2, "12 !!"), (-3, None), (-4, "xkqj zzvw " * 200_000)], "doc_id long, text string")
    model = language_id.fit(docs)
    left = language_id.drop_unknown(docs.select("doc_id", "text").union(odd), model)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert language_id.drop_unknown(odd, language_id.fit(docs.where("false"))).count() == 2
