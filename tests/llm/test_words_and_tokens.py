from __future__ import annotations

import gc
import os
import random
import re
import tempfile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import bpe
from ferry.llm import words as W
from ferry.llm.bpe import Lexicon, chunks, encode_decode, frequent_words, minimal_automaton, split_words
from ferry.llm.packing import CapacityTree, best_fit_decreasing, packed_tokens, position_ids, unpacked

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "a<|startoftext|>b <|endoftext|>", "x" * 5000, "ab" * 300 + "é" * 100, "don't I'LL 'S '", "É é ẛ̣ ΑΣ Σ", "a\x1cb\x85c d", "½²Ⅷ12 _-_ 日本🙂", "the the the."]


def brute_shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found)} if len(found) < 5 else {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1cZ", max_size=60)), max_size=8))
def test_shingles_follow_the_words(texts):
    for first, hashes, at in W.row_shingles(pa.array(texts, pa.string())):
        for r in range(len(at) - 1):
            assert len(set(hashes[at[r] : at[r + 1]].tolist())) == len(brute_shingles(texts[first + r]))


def test_very_long_text_is_hashed_in_pieces():
    text = "word " * 300_000 + "y" * 700_000 + " end"
    hashes, first = W.word_hashes(*W.utf8(pa.array([text])))
    assert first.tolist() == [0, 300_002] and len(set(hashes.tolist())) == 3
    short, _ = W.word_hashes(*W.utf8(pa.array(["word end"])))
    assert short[0] == hashes[0] and short[1] == hashes[-1]


def test_automaton_is_minimal_and_numbers_its_words():
    listed = sorted(w.encode() for w in ["tap", "taps", "top", "tops", "a", "map", "maps"])
    a = minimal_automaton(listed)
    # start, after m, after t, after ma/ta/to, after p (final), end: "a" shares the end.
    assert len(a["final"]) == 6
    lex = Lexicon({**a, "name_end": np.zeros(0, np.int64), "names": np.zeros(0, np.uint8)}, {})
    assert lex.looked_up(listed + [b"ta", b"", b"mapss"]).tolist() == [*range(7), -1, -1, -1]


def test_frequent_words_come_by_a_least_count(spark):
    counts = {"often": 5000, "more": 4990, "some": 40, "few": 3, "rare": 3, "once": 1}
    texts = [w for w, n in counts.items() for _ in range(n)] + [None, ""]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame([(" ".join(t or "" for t in texts[i : i + 100]),) for i in range(0, len(texts), 100)], "text string").repartition(40)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert frequent_words(docs) == order
    # The words of one step of counts come together or not at all.
    assert frequent_words(docs, limit=4) == frequent_words(docs, limit=3) == order[:3]
    assert frequent_words(docs, limit=1) == [] == frequent_words(docs.limit(0))


def test_no_words_compile():
    lex = Lexicon({**minimal_automaton([]), "name_end": np.zeros(0, np.int64), "names": np.zeros(0, np.uint8)}, {})
    assert lex.looked_up([b"a"]).tolist() == [-1]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(spark, library):
    random.seed(3)
    signs = list("abcXYZ  '’sS12½ÉéßüñΣσς 日本🙂\n\t\x00\x85​ﬁǅİ!!%%$|<>_-ªⅧ²")
    texts = ODD + ["".join(random.choices(signs, k=random.choice([1, 4, 30, 200]))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in encode_decode(frame, PATH).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == want, t
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_encoding_of_no_rows_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, PATH).collect() == [] and packed_tokens(empty, PATH).collect() == []
    twice = spark.createDataFrame([(None, "hello"), (None, "hello")], "doc_id long, text string")
    assert [(r["doc_id"], r["decoded"]) for r in encode_decode(twice, PATH).collect()] == [(None, "hello</w>")] * 2


def test_chunks_keep_signs_that_are_no_white_space():
    assert chunks("a\x1cb c") == ["a\x1cb", "c"] and split_words(["Abc.", "ÉΣ", "x're1"]) == [["abc", "."], ["éσ"], ["x", "'re", "1"]]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_decreasing_is_the_plain_one(case):
    capacity, sizes = case
    rows = best_fit_decreasing(sizes, capacity)
    free, n = [], 0
    for p in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= p]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - p)
        else:
            n += 1
            free.append(capacity - p)
    assert len(rows) == n and sorted(sum(rows, [])) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= capacity for r in rows)


def test_capacity_tree_takes_the_smallest_sufficient():
    tree = CapacityTree(10)
    for free, row in ((3, 0), (7, 1), (5, 2)):
        tree.add(free, row)
    assert tree.take(4) == (5, 2) and tree.take(4) == (7, 1) and tree.take(4) is None and tree.take(3) == (3, 0)


def test_packing_is_lossless(spark):
    texts = [*ODD, "w " * 700, "some words here"] * 2
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = packed_tokens(docs, PATH, row_tokens=64, window_tokens=500).cache()
    for r in rows.collect():
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and len(r["ids"]) == 256
        places = np.frombuffer(bytes(r["position_ids"]), "<u2")
        assert (places == position_ids(r["cu_seqlens"], 64)).all()
        assert all(places[c] == 0 for c in r["cu_seqlens"] if c < 64)
    whole: dict = {}
    for r in sorted(unpacked(rows).collect(), key=lambda r: r["offset"]):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    want = {r["doc_id"]: bytes(r["ids"]) for r in encode_decode(docs, PATH).collect()}
    assert {k: v for k, v in want.items() if v} == whole


def test_a_worker_with_a_lexicon_remembers_fewer_texts():
    with open(PATH, encoding="utf-8") as f:
        tokenizer = f.read()
    sizes = []
    for k, words in enumerate(([], ["the", "tokens"])):
        body = Lexicon.compiled(tokenizer, words)
        path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), f"{k}.bin")
        with open(path, "wb") as f:
            f.write(body)
        sizes.append(Lexicon.mapped(path).memory.size)
    assert 0 < 2 * sizes[1] < sizes[0]


def test_a_worker_gives_back_what_a_task_of_coding_took(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        body = Lexicon.compiled(f.read(), ["the", "tokens"])
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "lexicon.bin")
    with open(path, "wb") as f:
        f.write(body)
    lex = Lexicon.mapped(path)
    monkeypatch.setattr(bpe, "opened", lambda name: lex)
    monkeypatch.setattr(bpe, "CODED_AT_ONCE", 40)
    texts = ["The tokens, and others.", None, "many words " * 30, "x"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    assert gc.isenabled()
    for end in (False, True):  # as the last task of a worker, and where its reader stops early
        coded = bpe._coder("lexicon")(iter([rows, rows]))
        parts = list(coded) if end else [next(coded)]
        assert parts[0].num_rows < len(texts) and (not end or sum(p.num_rows for p in parts) == 2 * len(texts))
        coded.close()
        assert not lex.memory.new and not lex.memory.old and gc.isenabled()
    assert b"".join(parts[-1].column(1).to_pylist()) == lex.encode(["x"])[0]


def test_words_are_counted_a_part_of_the_chunks_at_a_time(monkeypatch):
    rows = pa.RecordBatch.from_arrays([pa.array(["a b, a", None, "c. b A c-c", ""], pa.string())], names=["text"])
    monkeypatch.setattr(bpe, "COUNTED_AT_ONCE", 2)
    got = {r["word"]: r["n"] for b in bpe._count(iter([rows, rows])) for r in b.to_pylist()}
    assert got == {"a": 6, "b": 4, ",": 2, "c": 6, ".": 2, "-": 2} and list(bpe._count(iter([]))) == []
