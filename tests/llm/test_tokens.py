import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from leadloom.llm.bpe import encode_decode, vocabulary
from leadloom.llm.token_files import Code, Encoder, code_lengths, read_ids, round_trip, write_ids
from tokenizers import Tokenizer

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def odd_texts(n=1500):
    rnd = random.Random(4)
    pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0x500), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x1F300, 0x1F700), 32, 10, 39, 115]))
    texts = ["".join(pick() for _ in range(rnd.randrange(80))) for _ in range(n)]
    return texts + ["", "a" * 20_000, "aaaa aaa", "<|endoftext|> x<|endoftext|>", "it's WE'LL", "é ́e", "\x1ca\x1db", "<|startoftext|>a b<|endoftext|>", "a​b c d\u0085e", "ſ İ ǅ ﬁ"]


def test_byte_bpe_equals_the_library():
    own, lib = vocabulary(BYTES), Tokenizer.from_file(BYTES)
    texts = odd_texts()
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False), t


def test_pieces_equal_whole_texts():
    own, lib, texts = Encoder(WORDS, 1), Tokenizer.from_file(WORDS), odd_texts()
    for t in texts:
        assert own(pa.array([t]))[0].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1], repr(t)
    ids, ends = own(pa.array(texts + texts))
    for t, part in zip(texts + texts, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_a_long_document_and_many_words():
    """Five million tokens in one document; many calls of the library."""
    rnd = np.random.default_rng(3)
    words = ["w" + np.base_repr(int(x), 36).lower() for x in rnd.integers(1, 1 << 40, 3000)]
    own = Encoder(WORDS, 1)
    lib = Tokenizer.from_file(WORDS)
    for k in range(0, 3000, 500):
        text = " ".join(words[k : k + 500])
        assert own(pa.array([text]))[0].tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]
    long = np.tile(own(pa.array(["some words of one very long document"]))[0].astype(np.int64), 620_000)
    symbols, counts = np.unique(long, return_counts=True)
    code = Code(symbols, code_lengths(counts))
    payload, marks = code.encode(long)
    assert len(long) > 4_900_000 and (code.decode(payload, marks, len(long)) == long).all()


def test_code_lengths_are_optimal_and_limited():
    rnd = np.random.default_rng(1)
    for n in (2, 3, 17, 300):
        counts = rnd.integers(1, 1000, n)
        heap = [(int(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], -1))
        lengths = code_lengths(counts)
        assert (counts * lengths).sum() == cost
    steep = code_lengths(2 ** np.arange(40, dtype=np.int64))
    assert steep.max() <= 16 and (0.5**steep).sum() <= 1


def test_code_round_trip():
    rnd = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000, 65_536, 65_537, 200_001):
        ids = rnd.zipf(1.3, n) % 5000
        symbols, counts = np.unique(ids, return_counts=True)
        code = Code(symbols, code_lengths(counts))
        payload, marks = code.encode(ids)
        assert (code.decode(payload, marks, n) == ids).all()


def test_files(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(odd_texts(60))][::-1] + [(1000, None), (None, "x"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS start").repartition(3)
    lib = Tokenizer.from_file(WORDS)
    got = round_trip(docs, WORDS).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    ids = {(i, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == ids and len(got) == len(rows)
    before = 0
    for r in got:
        assert r.start == before
        before += r.n_tokens
    write_ids(docs.limit(0), f"file://{tmp_path}/none", WORDS)
    assert read_ids(spark, f"file://{tmp_path}/none").collect() == []


def test_encode_decode(spark):
    rows = [(1, "Hello é"), (None, None), (2, ""), (2, "")]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()
    assert sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in got) == [(0, "", 0), (1, "Hello é", 2), (2, "", 0), (2, "", 0)]
