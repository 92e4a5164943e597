"""Word transducer and byte-pair encoding against the tokenizers library."""

import collections
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from hyposcape.llm import bpe, lexicon
from hyposcape.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
DOCS = "doc_id long, text string, ids string, n_tokens double, decoded int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts():
    rng = random.Random(7)
    texts = [None, "", " \n\t", "<|endoftext|>", "a<|startoftext|><|endoftext|>b <|ENDOFTEXT|>", "<|endoftext|", "It's we'll THEY'VE 'S", "a" * 5000, "é" * 3000, "!?" * 2000]
    texts += ["İSTANBUL ΣΑΣ ς ﬁ é ́x 1²½ ٣ 中文字 日本語 🎉👍🏽 ​﻿\x00\x1c\x85\xa0x", "힣각", "Ʉ Ʌ Ⱥ Ⱦ ɏ"]
    plain = [chr(k) for k in range(0x250)] + [chr(k) for k in (0x2010, 0x2019, 0x201C, 0x2026, 0x20AC, 0x2022)]
    some = [chr(k) for k in (0x300, 0x301, 0x327, 0x4E2D, 0x1F600, 0x3A3, 0x10FFFF, 0x1E9E, 0xAC00, 0x2028, 0x3000)]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    texts += ["".join(rng.choice(plain + some * 20) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    texts += [a + c + b for c in plain + some for a in ("", " ", "a", "1") for b in ("", "b", "'s", "!")]
    valid = [*range(0, 0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(chr(rng.choice(valid)) for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    return texts


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))) for _ in range(3000)} | {b"running", b"walking", b"\xff\x00", b"\x00"})
    ids = {w: [k, *range(k % 4)] for k, w in enumerate(words)}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compiled(words[::-1], ids))
    held = lexicon.Lexicon(str(path))
    assert len(held) == len(words) and held.rows(words).tolist() == list(range(len(words)))
    assert [np.frombuffer(p, "<u4").tolist() for p in held.packed(held.rows(words))] == [ids[w] for w in words]
    unseen = [b"", b"e", b"abcde", b"runnin", b"runningx", b"x" * 500, b"\xff", *(w + b"a" for w in words if w + b"a" not in ids), *(w[:-1] for w in words if w[:-1] not in ids)]
    assert (held.rows(unseen) == -1).all()
    # minimal: as many states as there are different sets of continuations
    ends = collections.defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            ends[w[:k]].add(w[k:])
    assert len(held.final) == len(set(map(frozenset, ends.values())))
    path.write_bytes(lexicon.compiled([], {}))
    assert lexicon.Lexicon(str(path)).rows([b"a", b""]).tolist() == [-1, -1]


def test_words_and_merges_equal_the_library(library, tmp_path):
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    texts = odd_texts()
    some = sorted({w.encode() for t in texts[::3] for p in vocab.pieces(t or "") if isinstance(p, list) for w in p if len(w.encode()) < 40})
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compiled(some, {w: vocab.merged(w) for w in some}))
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for held in (lexicon.Lexicon(str(path)), None):
        assert [np.frombuffer(p, "<u4").tolist() for p in bpe.Encoder(vocab, held).packed(texts)] == want


def test_long_texts_are_cut_at_blanks(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    monkeypatch.setattr(bpe, "HELD", 30)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["it's", "é", "é", "́", "x" * 70, "中文", "<|endoftext|>", "12", ""]) for _ in range(400)) for _ in range(20)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe.Encoder(vocab, None).packed(texts)] == want


def test_round_trip_on_rows(spark, library):
    texts = odd_texts()[:60] + ["a word " * 60_000]
    rows = [(i, t, "x", 0.5, 3) for i, t in enumerate(texts)] + [(0, "again", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for size in (bpe.LEXICON, 5, 0):
        got = bpe.decoded(bpe.encoded(docs, size=size)).collect()
        want = collections.Counter()
        for i, t, *_ in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
        assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    empty = spark.createDataFrame([], DOCS)
    assert bpe.decoded(bpe.encoded(empty)).count() == 0


def test_ids_outside_the_vocabulary(spark, library):
    raw = np.array([5, 49407, 49408, 2**32 - 1, 320], "<u4").tobytes()
    got = bpe.decoded(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, ids binary")).orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == [library.decode([5, 49407, 320], skip_special_tokens=False), ""]


def test_word_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "hot " * 3 + f"w{i % 4}") for i in range(50)], "doc_id long, text string").repartition(6)
    got = {r["word"]: r["n"] for r in bpe.word_counts(docs, bpe.vocabulary_path()).collect()}
    assert got == {"hot": 150, "w": 50, "0": 13, "1": 13, "2": 12, "3": 12}


@needs_tables
def test_query_on_all_documents(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_bpe_round_trip"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
