"""Token ids in compressed shards: one wavelet matrix per shard with rank, select, access and counting.

Documents are range-partitioned by id and sorted, so shards in (part, seq) order hold ids in ascending document order.
A shard holds about SHARD_TOKENS ids (a longer single document gets a shard of its own size). Its file keeps one packed
bit-plane per id bit, most significant first, a directory of the ones before every BLOCK bits of each plane, the number
of zeros of each plane, and the document table. Spark writes the shards (one row and one zstd file each) and so commits
them atomically on any file system; a lost executor only repeats its own task.

Defined cases: a null or empty text is the end id alone; rows with the same id follow each other, ordered by text; null
ids come first; extra columns are ignored; an empty table gives no shard and no row.
"""

from __future__ import annotations

import contextlib
import os
import re
import threading
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import batches_of

SHARD_TOKENS = 1 << 21
BLOCK = 512
CACHE_WORDS = 300_000  # pieces remembered, and what one call adds
IDLE_SECONDS = 5
#: Bytes of the documents encoded together, so that a word they share is looked up once; Arrow batches are as large.
ENCODE_BYTES = 1 << 22
#: Pieces that go to the library in one text, and texts that go there at once: its results take some hundred bytes a token.
LED, BATCH = 128, 64
SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, planes array<binary>, ranks array<binary>, zeros array<long>"
#: A space between white space, or at a text's end after white space: here the pre-tokenizer joins what a split would part.
JOINED_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Letters, and what follows from an ASCII sign, digit or line end on: the pre-tokenizer parts a word between them.
STEM = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>(?s:[\x00-@\[-`{-\x7f].*)?)$"


class WaveletMatrix:
    """Succinct sequence of non-negative integers over bit-planes."""

    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.ranks, self.zeros, self.n = planes, ranks, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        for b in range(width - 1, -1, -1):
            bit = ((ids >> ids.dtype.type(b)) & ids.dtype.type(1)).astype(bool)
            planes.append(np.packbits(bit))
            ones = np.zeros(-(-len(bit) // BLOCK) * BLOCK // 64, np.uint64)
            ones.view(np.uint8)[: len(planes[-1])] = planes[-1]
            ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(ones).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32))]).astype("<u4"))
            zeros.append(int(len(bit) - ranks[-1][-1]))
            ids = ids[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])]
        return cls(planes, ranks, zeros, len(ids))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        first = block * BLOCK // 8
        part = np.unpackbits(self.planes[level][first : (i + 7) // 8])[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(part.sum())

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value * 2 + bit, zeros + ones if bit else i - ones
        return value

    def _descend(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol among the first i."""
        lo, hi = self._descend(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._descend(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        lo, hi = self._descend(symbol, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - level) & 1
            want, first, last = (i - self.zeros[level] if bit else i), 0, self.n
            while first < last:  # the least end whose prefix holds want+1 such bits
                mid = (first + last) // 2
                ones = self._ones(level, mid + 1)
                first, last = (first, mid) if (ones if bit else mid + 1 - ones) > want else (mid + 1, last)
            i = first
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """The whole sequence, undoing the planes from the last to the first."""
        out = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)], up[np.flatnonzero(bit)] = out[: self.zeros[level]], out[self.zeros[level] :]
            up |= bit.astype(out.dtype) << out.dtype.type(len(self.zeros) - 1 - level)
            out = up
        return out


class Encoder:
    """Ids of whole texts from the tokenizers library, remembering pieces of words.

    The byte-level pre-tokenizer never joins across a space that follows a character other than white space or precedes
    one, so such a text's ids are those of its space-led words in turn. Other texts, and those that hold a token added to
    the vocabulary, go to the library whole. Arrow finds the distinct words of a call and parts them into pieces: the
    letters they begin with, and the rest. Words are many more than pieces, so pieces alone are remembered. New ones go to
    the library many to a text: a piece's ids begin at a token that begins with a space, as no other does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: What a text doesn't hold that is split here: added tokens, and NUL, which marks a text's first word.
        self.unsplit = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level sign of a space
        self.known: dict[str, int] = {}  # number of each piece kept; its ids are ids[bounds[number] : bounds[number + 1]]
        self.ids, self.bounds = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int64)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), BATCH):
            out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts[i : i + BATCH], add_special_tokens=False)]
        return out

    def _led(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and numbers of ids of pieces that begin with their only space, before something other than white space."""
        ids, lengths = [], []
        chunks = [pieces[i : i + LED] for i in range(0, len(pieces), LED)]
        for chunk, found in zip(chunks, self._batch(["".join(c) for c in chunks])):
            at = np.flatnonzero(self.leads[found])
            if len(at) != len(chunk) or at[0]:  # another vocabulary may part words otherwise
                each = self._batch(chunk)
                found, at = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            ids.append(found)
            lengths.append(np.diff(at, append=len(found)))
        return ids, lengths

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each piece's number of ids; those that begin with their only space go to the library together."""
        led = np.fromiter((p[:1] == " " and p[1:2] != "" and not p[1].isspace() and p.find(" ", 1) < 0 for p in pieces), bool, len(pieces))
        ids, lengths = self._led([p for p, x in zip(pieces, led) if x])
        rest = self._batch([p for p, x in zip(pieces, led) if not x])
        order = np.argsort(np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)]))
        ends = np.cumsum(np.concatenate([[0], *lengths, list(map(len, rest))]).astype(np.int64))
        return self._taken(ends, np.concatenate([self.ids[:0], *ids, *rest]), order)

    def _taken(self, ends: np.ndarray, ids: np.ndarray, which) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chosen pieces in turn, and the number of each; `ends` has one entry more than there are pieces."""
        size = self.kind.itemsize
        kept = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * size), pa.py_buffer(ids)])
        taken = kept.take(pa.array(which))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1, taken.offset * 8) // size
        return np.frombuffer(data, self.kind)[ends[0] : ends[-1]] if data is not None and len(taken) else self.ids[:0], np.diff(ends)

    def _numbers(self, pieces: np.ndarray) -> np.ndarray:
        """Number of each of these distinct pieces in `ids` and `bounds`; new ones stand behind those kept and, where there is room, are kept."""
        known = self.known
        number = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0)
        ids, lengths = self._pieces(pieces[new].tolist())
        first = len(known)
        number[new] = first + np.arange(len(new))
        begin, bounds = int(self.bounds[first]), first + len(new) + 1
        if bounds > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(bounds, np.int64)])
        if begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(begin + len(ids), self.kind)])
        self.ids[begin : begin + len(ids)] = ids
        self.bounds[first + 1 : bounds] = begin + np.cumsum(lengths)
        if first < CACHE_WORDS:  # pieces met first, so mostly the frequent ones, stay
            known.update(zip(pieces[new].tolist(), range(first, bounds)))
        self.end = bounds
        return number

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [any(x in t for x in self.unsplit) or bool(JOINED_SPACE.search(t)) for t in texts]
        lists = pc.split_pattern(pa.array([None if w else "\0" + t for t, w in zip(texts, whole)], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        parted = pc.extract_regex(words, STEM)
        stems, tails = pc.struct_field(parted, [0]), pc.struct_field(parted, [1]).fill_null("")
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.coalesce(stems, words), pa.scalar(" ", pa.large_string()))
        heads = pc.if_else(pc.starts_with(words, "\0"), pc.utf8_slice_codeunits(words, 1), led)
        pieces = pa.concat_arrays([heads, tails]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False))[pieces.indices.to_numpy()]
        # A word's ids are those of its two pieces; a text's are those of its words.
        ids, lengths = self._taken(self.bounds[: self.end], self.ids, np.stack([number[: len(words)], number[len(words) :]], 1).ravel())
        out, lengths = self._taken(np.cumsum([0, *lengths.reshape(-1, 2).sum(1)]), ids, coded.indices)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])]
        rest = iter(self._batch([t for t, w in zip(texts, whole) if w]))
        return [next(rest) if w else out[a:b] for w, a, b in zip(whole, ends[:-1].tolist(), ends[1:].tolist())]


_encoders: dict[str, Encoder] = {}
_users: list[threading.Timer | None] = [None]


@contextlib.contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """One encoder for each Python worker, so that its word memory serves all its tasks; freed when none has come for a while."""
    if _users[0]:
        _users[0].cancel()
    words = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    try:
        yield words
    finally:
        _users[0] = threading.Timer(IDLE_SECONDS, _encoders.clear)
        _users[0].daemon = True
        _users[0].start()


def _shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as words:
            yield from shards(words, batches)

    def shards(words: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, docs, counts = None, 0, 0, [], [], []

        def flush():
            w = WaveletMatrix.build(np.concatenate(ids), max(words.width, int(end_id).bit_length()))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": w.n, "doc_ids": docs, "doc_tokens": counts, "planes": [p.tobytes() for p in w.planes], "ranks": [r.tobytes() for r in w.ranks], "zeros": w.zeros}], SHARD_ARROW)

        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // ENCODE_BYTES)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                rows = batch.slice(i, j - i)
                texts = [t or "" for t in rows.column(2).to_pylist()]
                for p, doc, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), words.encode(texts)):
                    if ids and (p != part or held + len(x) + 1 > SHARD_TOKENS):
                        yield flush()
                        seq, held, ids, docs, counts = (seq + 1 if p == part else 0), 0, [], [], []
                    part = p
                    ids += [x, np.array([end_id], x.dtype)]
                    held += len(x) + 1
                    docs.append(doc)
                    counts.append(len(x) + 1)
        if ids:
            yield flush()

    return run


SHARD_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64()))])


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", docs_per_part: int = 10_000) -> None:
    """Encode every text, append `end_id` to each, and write the shards to `out` (and their sizes to `out`-index)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // docs_per_part))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_shards(tokenizer_path, end_id), SHARD_SCHEMA)
    with batches_of(docs.sparkSession, ENCODE_BYTES):  # a worker and the JVM beside it hold no more of the texts than is encoded at once
        shards.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(out)
    index = read_shards(docs.sparkSession, out).select("part", "seq", "n_tokens")
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row for each part, so the window below stays small
    before = sums.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"), "n_tokens").write.mode("overwrite").parquet(f"{out}-index")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_matrix(row) -> WaveletMatrix:
    """The wavelet matrix of one shard row (a Row or dict)."""
    return WaveletMatrix([np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]], list(row["zeros"]), row["n_tokens"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = shard_matrix(row).decode().astype("<u4")
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["shard_start"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shard files."""
    index = spark.read.schema("part int, seq int, shard_start long, n_tokens long").parquet(f"{path}-index").drop("n_tokens")
    return read_shards(spark, path).join(index, ["part", "seq"]).select("n_tokens", "doc_ids", "doc_tokens", "planes", "ranks", "zeros", "shard_start").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
