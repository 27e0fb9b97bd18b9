"""Token-id files: canonical length-limited Huffman coding from global counts.

Ids are counted over all documents; a canonical code of at most MAX_CODE bits
is built from the counts. Documents in ascending order of ids are coded into
independent blocks, each with the bit offset of every CHECKPOINT-th token, so
that a reader can begin at any of them; the decoder steps through all of a
block's checkpoints side by side, by one table lookup a token.

On disk a data set is two tables: ``blocks`` (file, block, start, doc ids, token
counts, checkpoints, payload) and ``code`` (id, length), from which the
canonical code follows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import application_folder, cut, discard, id_and_text

#: Longest code in bits; tokens between checkpoints; tokens in a block, except that a document is never split.
MAX_CODE, CHECKPOINT, BLOCK_TOKENS = 16, 256, 1 << 18
#: Characters in one call of the library (or one word), and in the texts that are encoded together.
CALL_CHARS, SLICE = 10_000, 16_000_000
#: Tokens that are packed at a time: a long document needs no memory for each of its bits.
PACKED = 1 << 16
#: White space of the vocabulary's pattern; Arrow's own also takes the four marks from \x1c on.
SPACES = regex.compile(r"\p{White_Space}+")
#: Letters that have one lower-case letter each and compose with nothing, and marks that a word may end with.
LETTERS, MARKS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}", ".,;:!?"
WORD = f"^[{LETTERS}]+[{MARKS}]*$"


@lru_cache(2)
def library(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def joined_runs(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given runs of a flat array one after another, and where each ends."""
    sizes = ends - begins
    upto = np.cumsum(sizes)
    take = np.repeat(begins - (upto - sizes), sizes)
    take += np.arange(len(take))
    return flat[take], upto


class Encoder:
    """Ids by the tokenizers library, which a word of a slice of texts meets once.

    The vocabulary's normalizer and pattern never look across white space, so
    a text's ids are those of the pieces between it in turn. A piece of
    letters and closing marks is a word, which lower case leaves alike, and
    its marks; any other piece is one unit. Words go to the library many in
    one call, parted by spaces: each ends with the one id of its word's end.
    Other units are parted by a special token.
    """

    def __init__(self, path: str, end_id: int) -> None:
        self.library, self.end_id = library(path), end_id
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        special = sorted((i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special)
        self.mark_id, self.mark = special[-1] if special else (None, "")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        end = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if end and t.endswith(end)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def call(self, units: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and where each one's end."""
        joined = lambda by: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), by)[0].as_py()
        if plain:
            ids = self.ids(joined(" "))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(units) and ends[-1] == len(ids):
                return ids, ends
        if self.mark_id is None or pc.any(pc.match_substring(units, self.mark)).as_py():
            found = [self.ids(u) for u in units.to_pylist()]
            return np.concatenate(found), np.cumsum(list(map(len, found)))
        ids = self.ids(joined(self.mark))
        between = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, between), np.r_[between, len(ids)] - np.arange(len(units))

    def units(self, units: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and where those of each unit begin and end in it; a unit that repeats meets the library once."""
        units = units.dictionary_encode()
        upto = np.cumsum(np.asarray(pc.binary_length(units.dictionary), dtype=np.int64) + 1)
        flat, ends, size, at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0, 0
        while at < len(upto):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CALL_CHARS)))
            ids, own = self.call(units.dictionary.slice(at, to - at), plain)
            flat.append(ids)
            ends.append(own + size)
            size += len(ids)
            at = to
        ends, rows = np.concatenate(ends), np.asarray(units.indices) if len(units) else np.zeros(0, np.int64)
        return np.concatenate(flat), ends[rows], ends[rows + 1]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, and where each one's end."""
        plain = pc.match_substring_regex(pieces, WORD)
        words, others = pieces.filter(plain), pieces.filter(pc.invert(plain))
        # Two runs a piece: its word and its marks, or the whole of it and nothing.
        begins, ends = np.zeros((2, len(pieces), 2), np.int64)
        parts = (
            (np.asarray(plain), 0, pc.utf8_lower(pc.utf8_rtrim(words, MARKS)), True), (np.asarray(plain), 1, pc.replace_substring_regex(words, f"^[{LETTERS}]+", ""), False),
            (~np.asarray(plain), 0, others, False),
        )
        flats, size = [], 0
        for who, side, texts, is_plain in parts:
            flat, begin, end = self.units(texts, is_plain)
            begins[who, side], ends[who, side] = begin + size, end + size
            flats.append(flat)
            size += len(flat)
        ids, upto = joined_runs(np.concatenate(flats).astype(self.kind), begins.ravel(), ends.ravel())
        return ids, upto[1::2]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), each with the end id, and where each text ends."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([SPACES.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        pieces = lists.flatten().dictionary_encode()
        ids, upto = self.pieces(pieces.dictionary)
        # After all others comes one more piece: a text's end.
        flat, bounds = np.append(ids, self.kind.type(self.end_id)), np.r_[0, upto, len(ids) + 1]
        ends = np.asarray(lists.offsets)[1:]
        rows = np.insert(np.asarray(pieces.indices) if len(pieces) else np.zeros(0, np.int64), ends, len(upto))
        ids, upto = joined_runs(flat, bounds[rows], bounds[rows + 1])
        return ids, upto[ends + np.arange(len(ends))]


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    """One a worker process."""
    return Encoder(path, end_id)


def encoded(path: str, end_id: int):
    """(doc_id, text) to (doc_id, ids), ids as little-endian integers of 16 bits, or 32 for a larger vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE)))
                ids, ends = encode(batch.column(1).slice(at, to - at))
                offsets = np.r_[0, ends * encode.kind.itemsize].astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), raw], ["doc_id", "ids"])
                at = to

    return run


def counted(kind: np.dtype):
    """(ids) to (id, n): a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                own = np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=len(total))
                own[: len(total)] += total
                total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, longest: int = MAX_CODE) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits, by package-merge; one symbol alone gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols have no code of {longest} bits")
    order = np.argsort(counts, kind="stable")
    base = counts[order].astype(np.float64)
    values, levels = base, []
    for _ in range(longest - 1):
        pairs = values[: len(values) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([base, pairs])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank)
        values = merged[rank]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2  # cheapest items of the last list; each package stands for two of the list before
    for rank in reversed(levels):
        chosen = rank[:take]
        leaves = chosen[chosen < n]
        lengths[order[leaves]] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[order[:take]] += 1
    return lengths


class Code:
    """A canonical code: symbols in order of length, then id."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        span = (1 << MAX_CODE) >> self.lengths
        first = np.r_[0, np.cumsum(span)[:-1]]
        self.codes = first >> (MAX_CODE - self.lengths)
        self.row = np.zeros((int(symbols.max()) if len(symbols) else 0) + 1, np.int64)
        self.row[self.symbols] = np.arange(len(symbols))
        self.table = np.zeros(1 << MAX_CODE, np.int64)
        filled = np.repeat(np.arange(len(symbols)), span)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every CHECKPOINT-th id; PACKED ids at a time."""
        parts, marks, at, carry = [], [], 0, 0
        for k in range(0, len(ids), PACKED):
            rows = self.row[ids[k : k + PACKED]]
            sizes, codes = self.lengths[rows], self.codes[rows]
            ends = np.cumsum(sizes) + (at & 7)
            starts = ends - sizes
            marks.append(starts[::CHECKPOINT] + (at - (at & 7)))
            # A code and what stands before it in its byte fit three bytes; codes share no bit, so sums put them together.
            window, byte = codes << (24 - sizes - (starts & 7)), starts >> 3
            total = sum(np.bincount(byte + j, window >> (16 - 8 * j) & 255, int(ends[-1] >> 3) + 3) for j in range(3)).astype(np.uint8)
            total[0] |= carry
            whole = int(ends[-1] >> 3)
            parts.append(total[:whole].tobytes())
            carry = int(total[whole])
            at += int(ends[-1]) - (at & 7)
        parts.append(bytes([carry]) if at & 7 else b"")
        return b"".join(parts), np.concatenate(marks) if marks else np.zeros(0, np.int64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block; every checkpoint's stretch advances by one id a step."""
        raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int64)
        out = np.zeros(len(checkpoints) * CHECKPOINT, np.int64)
        at, place = checkpoints.astype(np.int64).copy(), np.arange(len(checkpoints)) * CHECKPOINT
        last = n - (len(checkpoints) - 1) * CHECKPOINT
        for step in range(min(CHECKPOINT, n)):
            if step == last:  # the last stretch may be shorter
                at, place = at[:-1], place[:-1]
            byte = at >> 3
            window = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
            row = self.table[(window >> (8 - (at & 7))) & 0xFFFF]
            out[place + step] = self.symbols[row]
            at += self.lengths[row]
        return out[:n]


BLOCK = "block int, start long, doc_ids array<long>, sizes array<int>, checkpoints array<long>, payload binary"


def coded(code, kind: np.dtype) -> callable:
    """(doc_id, ids) in order to blocks; start counts the ids before a block in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(*code.value)
        block, start = 0, 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload, marks = own.encode(np.frombuffer(b"".join(held), kind))
            sizes = [len(x) // kind.itemsize for x in held]
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], ["block", "start", "doc_ids", "sizes", "checkpoints", "payload"])

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                held.append(raw.as_py())
                size += len(held[-1]) // kind.itemsize
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, start, docs, held, size = block + 1, start + size, [], [], 0
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the data set to the folder ``path``.

    Null texts count as empty and are written as the end id alone; documents
    are in ascending order of ids, null ids first; repeated rows are written
    each. An empty table gives an empty data set. The counts that come to the
    driver are at most one number for each id of the vocabulary.
    """
    spark = docs.sparkSession
    tokens = cut(id_and_text(docs, id_col, text_col).mapInArrow(encoded(vocabulary, end_id), "doc_id long, ids binary"), "tokens")
    kind = encoder(vocabulary, end_id).kind
    counts = tokens.select("ids").mapInArrow(counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    symbols = np.array([r.id for r in counts], np.int64)
    lengths = code_lengths(np.array([r.n for r in counts], np.int64))
    code = spark.sparkContext.broadcast((symbols, lengths))
    rows = pa.Table.from_arrays([pa.array(symbols), pa.array(lengths.astype(np.int32))], ["id", "length"])
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/code")
    files = max(1, tokens.rdd.getNumPartitions())
    ordered = tokens.repartitionByRange(files, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(coded(code, kind), BLOCK).withColumn("file", F.spark_partition_id()).write.parquet(f"{path}/blocks")
    discard(tokens)


def read_ids(spark, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids), or ids_crc32 in place of ids, from a data set's files.

    ``start`` counts the ids of all documents before a document. Blocks are
    decoded independently of each other.
    """
    table = spark.read.parquet(f"{path}/code").collect()
    code = spark.sparkContext.broadcast((np.array([r.id for r in table], np.int64), np.array([r.length for r in table], np.int64)))
    blocks = spark.read.schema(f"{BLOCK}, file int").parquet(f"{path}/blocks")
    # One row a file: where each file begins.
    totals = blocks.select("file", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    begins, before = [], 0
    for r in totals.orderBy("file").collect():
        begins.append((r.file, before))
        before += r.n
    shared = spark.sparkContext.broadcast(dict(begins))
    last = "ids_crc32 long" if digests else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(*code.value)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                sizes = np.array(row["sizes"], np.int64)
                ids = own.decode(row["payload"], np.array(row["checkpoints"]), int(sizes.sum()))
                ends = np.cumsum(sizes)
                starts = ends - sizes
                if digests:
                    raw = ids.astype("<u4").tobytes()
                    value = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
                first = shared.value[row["file"]] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first + starts), pa.array(sizes), value], ["doc_id", "start", "n_tokens", last.split()[0]])

    return blocks.select("file", *[c.split()[0] for c in BLOCK.split(", ")]).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a data set to the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""

    spark = docs.sparkSession
    path = f"{application_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary, end_id, id_col, text_col)
    return read_ids(spark, path, digests=True)
