"""BPE encoding and decoding with a word lexicon compiled from the corpus.

A text is split into words as the vocabulary's JSON file says (special strings first, then normal form, lower case and the word
pattern). A word's ids depend on the word alone. One pass counts the words of all documents; the ``LEXICON`` most frequent (a parameter) are merged once
and compiled into a minimal acyclic transducer (``lexicon``). Its file goes to the shared folder, Spark hands it to every
executor, whose workers map it into memory. Encoding looks up the distinct words of a batch in it; words that it does not hold
are merged exactly: the pair of lowest rank first, the leftmost of equal pairs. The lexicon only saves time; ids never depend on it.

Texts of Latin letters and common punctuation are split by one regular expression; there the normal form is the text itself. All others
go through the library's own normaliser and splitter, whose Unicode tables may be newer than Python's. Long texts are worked
off in stretches that end at a blank, which no word crosses.

Defined cases: null and empty texts have no ids and decode to the empty text. Repeated rows and ids get a row each, a null doc_id is
kept. Bytes that the vocabulary lacks give no id, as in the library. Ids outside the vocabulary decode to nothing. An empty table
gives an empty result. Extra columns are unread.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lexicon import Lexicon, compiled

LEXICON = 1 << 16  # words of the lexicon
LONGEST = 48  # bytes of its longest word
SLICE = 8 << 20
STRETCH = 1 << 20  # characters split at once
WORDS = 1 << 18  # words resolved at once
HELD = 1 << 18  # words a worker remembers
PLAIN = re.compile("[\0-ɏ‐-―‘-‟•…€]*")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the rest from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def plain_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes (they stand inside brackets) spelled out for PLAIN in lower case: three times as fast."""
    held = sorted({c for k in range(0x3000) if PLAIN.fullmatch(chr(k)) for c in chr(k).lower()})
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(kind, "".join(re.escape(c) for c in held if regex.fullmatch(kind, c)))
    return pattern


class Vocabulary:
    """Ids, merge ranks and splitting rules of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        ids, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        self.inner = [ids.get(c) for c in letters]
        self.last = [ids.get(c + suffix) for c in letters]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {text: np.uint32(i).tobytes() for text, i in special.items()}
        self.tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for text, i in [*ids.items(), *special.items()]:
            self.tokens[i] = text
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in special) + ")")
        self.word = re.compile(plain_pattern(steps[0]["pattern"]["Regex"]))
        rules = Tokenizer.from_str(json.dumps({**spec, "pre_tokenizer": steps[0]}))
        self.normal, self.splitter = rules.normalizer, rules.pre_tokenizer

    def pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """Lists of words, and the packed id of each special string, in order."""
        for part in self.cut.split(text):
            if part in self.special:
                yield self.special[part]
                continue
            start = 0
            while start < len(part):
                end = part.find(" ", start + STRETCH) if len(part) - start > STRETCH else -1
                end = end if end >= 0 else len(part)
                yield self.words(part[start:end])
                start = end

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.word.findall(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(text))]

    def merged(self, word: bytes) -> list[int]:
        """Exact ids of one word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[b] for b in word[-1:]]
        ids = [i for i in ids if i is not None]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [(pair[0], k) for k in range(n - 1) if (pair := get((ids[k], ids[k + 1])))]
        heapify(queue)
        while queue:
            rank, k = heappop(queue)
            right = after[k]
            pair = get((ids[k], ids[right])) if right < n else None
            if pair is None or pair[0] != rank:
                continue  # one of its sides has been merged meanwhile
            ids[k], ids[right] = pair[1], -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if pair := get((ids[k], ids[right])):
                    heappush(queue, (pair[0], k))
            left = before[k]
            if left >= 0 and (pair := get((ids[left], ids[k]))):
                heappush(queue, (pair[0], left))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Words to packed ids: what the worker remembers, then the lexicon, then exact merges."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon, self.known = vocab, lexicon, {}

    def resolve(self, words: set[str]) -> None:
        if len(self.known) + len(words) > HELD:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        rows = self.lexicon.rows(raw) if self.lexicon else np.full(len(new), -1)
        listed = np.flatnonzero(rows >= 0)
        if len(listed):
            self.known.update(zip([new[k] for k in listed.tolist()], self.lexicon.packed(rows[listed]), strict=True))
        for k in np.flatnonzero(rows < 0).tolist():
            self.known[new[k]] = np.array(self.vocab.merged(raw[k]), "<u4").tobytes()

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0

        def flush() -> None:
            self.resolve(set().union(*[w for _, w in held if isinstance(w, list)]))
            for k, w in held:
                out[k].append(w if isinstance(w, bytes) else b"".join(map(self.known.__getitem__, w)))
            held.clear()

        for k, text in enumerate(texts):
            for words in self.vocab.pieces(text or ""):
                held.append((k, words))
                n += len(words)
                if n > WORDS:
                    flush()
                    n = 0
        flush()
        return [b"".join(o) for o in out]


@lru_cache(maxsize=2)
def encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(vocabulary(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def word_counts(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counts = vocabulary(path), Counter()

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in common.slices(whole, column, SLICE):
                for text in batch.column(column).to_pylist():
                    for words in vocab.pieces(text or ""):
                        if isinstance(words, list):
                            counts.update(words)
                        if len(counts) > HELD:
                            yield emitted()
                            counts.clear()
        yield emitted()

    return docs.select(column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, size: int = LEXICON, column: str = "text") -> str:
    """Compile at most ``size`` of the most frequent words and hand the file to the executors; returns its name among Spark's files.

    Counts are told apart in eighths of powers of two; the lexicon takes the classes from the top that fit in whole, so no task
    sends more than its words of them.
    """
    spark = docs.sparkSession
    counted = word_counts(docs, path, column).where(F.octet_length("word") <= LONGEST)
    counted = common.scratch(counted.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
    fits, taken = None, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        taken += r["count"]
        if taken > size:
            break
        fits = r["level"]
    words = [r["word"].encode() for r in counted.where(F.col("level") >= F.lit(fits)).select("word").collect()]  # at most ``size``
    common.delete(counted)
    vocab = vocabulary(path)
    name = f"{uuid.uuid4().hex}-lexicon"
    place = f"{common.shared_folder(spark)}/tables/{name}"
    common.write_file(spark, place, compiled(words, {w: vocab.merged(w) for w in words}))
    spark.sparkContext.addFile(place)
    return name


def encoded(docs: DataFrame, path: str | None = None, size: int = LEXICON) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens long, ids binary): ids are little-endian unsigned 32-bit integers."""
    path = path or vocabulary_path()
    rows = common.add_id_check(docs, ["doc_id", "text"])
    lexicon = frequent_lexicon(rows, path, size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, lexicon)
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE):
                ids = model.packed(batch.column("text").to_pylist())
                sizes = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of packed ids: the tokens joined by a blank, as a vocabulary without a decoder has it."""
    path = path or vocabulary_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for whole in batches:
            for batch in common.slices(whole, column, SLICE):
                texts = []
                for raw in batch.column(column).to_pylist():
                    ids = np.frombuffer(raw or b"", "<u4")
                    ids = ids[ids < len(tokens)]
                    texts.append(" ".join(map(tokens.__getitem__, ids.tolist())))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decode, f"{kinds}, `{out}` string")
