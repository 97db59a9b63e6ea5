"""Token-ID output: documents are tokenized, and their ids written as independently coded blocks and read back.

A file row is (part, seq, block): parts are ranges of doc_id in ascending order, blocks follow each other within a part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, byte_chunks, cut, give_back, runs, same_bytes, scratch_path, sized_partitions, small_batches, span_hashes, table, text_slices
from .range_coder import BLOCK, decode_block, encode_block

END_ID = 2
#: Stands for a null doc_id in a block.
NO_ID = -(1 << 63)
#: Bytes of text in a part, which is a task's.
PART_BYTES = 32 << 20
#: A worker remembers the ids of at most so many different pieces of text.
REMEMBERED = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: After these bytes, white space surely begins a new piece: ASCII but for controls, and the second bytes of U+00C0 to U+00FF.
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_MARK = _PLAIN & ~_ALPHA
_MARK[48:58] = False
#: The four as bits of a byte's class.
_CLASS = (_WHITE * 1 + _PLAIN * 2 + _MARK * 4 + _ALPHA * 8).astype(np.uint8).tobytes()


class PieceEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer, each different piece encoded once.

    Such a tokenizer never joins white space to what stands before it, so a text may be cut before any white space that
    follows a printable character; nor does it join marks to a letter before them, unless a special token is spelt out.
    The pieces' ids in a row are the text's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core; idle helpers would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(self.vocabulary, np.int64)  # bytes of each id: byte-level tokens have a letter for each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.text, self.written = np.zeros(1 << 20, np.uint8), 0  # the pieces' bytes
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.full(1 << 16, END_ID, np.int32), 1  # the end of a text is the id in the first place
        self.again = np.zeros(0, bool)  # met in a later slice than the one that they were learnt from

    def _tidy(self) -> None:
        """Most different pieces are never met again: those that were stay, unless even they are too many."""
        stay = np.flatnonzero(self.again)
        if len(stay) > REMEMBERED // 2:
            return self._forget()
        at, length, first, count = self.at[stay], self.length[stay], self.first[stay], self.count[stay].astype(np.int64)
        self.written, self.used = int(length.sum()), int(count.sum()) + 1
        text, pool = np.zeros(max(1 << 20, self.written + 8), np.uint8), np.full(max(1 << 16, self.used), END_ID, np.int32)
        text[: self.written], pool[1 : self.used] = self.text[runs(at, length)], self.pool[runs(first, count)]
        number = np.cumsum(self.again, dtype=np.int32) - 1
        own = self.again[self.place]
        self.keys, self.place = self.keys[own], number[self.place[own]]
        self.text, self.at, self.length = text, np.cumsum(length) - length, length
        self.pool, self.first, self.count = pool, np.cumsum(count) - count + 1, count.astype(np.int32)
        self.again = np.zeros(len(stay), bool)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Pieces that begin with white space and end with a printable one are encoded in one go; the bytes of the ids
        tell them apart."""
        joined = _WHITE[buf[starts]] & _PLAIN[buf[ends - 1]]
        length = ends - starts
        own = length[joined]
        texts = [buf[runs(starts[joined], own)].tobytes().decode()]
        texts += [buf[a:b].tobytes().decode() for a, b in zip(starts[~joined].tolist(), ends[~joined].tolist(), strict=True)]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first = np.array(coded[0], np.int32)
        sizes = np.zeros(len(starts), np.int64)
        if len(own):
            upto = np.searchsorted(np.cumsum(self.width[first]), np.cumsum(own), "left") + 1
            sizes[joined] = np.diff(np.concatenate(([0], upto)))
        sizes[~joined] = [len(c) for c in coded[1:]]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        flat = np.concatenate([first, np.array([i for c in coded[1:] for i in c], np.int32)])
        place = np.zeros(len(starts), np.int64)
        place[order] = np.cumsum(sizes[order]) - sizes[order]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.first, self.count = np.concatenate([self.first, place + self.used]), np.concatenate([self.count, sizes.astype(np.int32)])
        self.used += len(flat)
        size = int(length.sum())
        if self.written + size + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(max(len(self.text), size + 8), np.uint8)])
        self.text[self.written : self.written + size] = buf[runs(starts, length)]
        self.at = np.concatenate([self.at, np.cumsum(length) - length + self.written])
        self.length = np.concatenate([self.length, length])
        self.again = np.concatenate([self.again, np.zeros(len(length), bool)])
        self.written += size
        where = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, where, np.arange(len(self.first) - len(keys), len(self.first), dtype=np.int32))
        self.keys = np.insert(self.keys, where, keys)

    def _known(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray, place: np.ndarray) -> bool:
        """Whether every piece has the very bytes of the one that is remembered for its hash. Up to 8 bytes, equal lengths
        and hashes are enough."""
        if not (length == self.length[place]).all():
            return False
        long = np.flatnonzero(length > 8)
        pool = np.ndarray(len(self.text) - 7, "<u8", self.text, 0, (1,))
        return bool(same_bytes(byte_chunks(buf), starts[long], pool, self.at[place[long]], length[long]).all())

    def _plain(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same ids without the memory: two pieces share a hash."""
        raw = buf.tobytes()
        coded = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids + [END_ID] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return np.concatenate([np.array(c, np.int32) for c in coded]), np.array([len(c) for c in coded], np.int64)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), each text with END_ID at its end."""
        docs = len(offs) - 1
        n = len(buf)
        cuts = np.zeros(n + 1, bool)
        if n:
            raw = buf.tobytes()
            kind = np.frombuffer(raw.translate(_CLASS), np.uint8).copy()
            accented = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
            kind[1:] |= accented.view(np.uint8) << 1
            accented &= (buf[1:] != 0x97) & (buf[1:] != 0xB7)  # no letters: the signs of multiplication and division
            kind[1:] |= accented.view(np.uint8) << 3
            cuts[1:n] = kind[1:] & (kind[:-1] >> 1) & 1
            if not any(t in raw for t in self.special):
                cuts[1:n] |= ((kind[1:] >> 2) & (kind[:-1] >> 3) & 1).view(bool)
            cuts[offs[:-1][offs[:-1] < offs[1:]]] = True
            cuts[0] = True
        starts = np.flatnonzero(cuts[:n])
        ends = np.append(starts[1:], n) if len(starts) else starts
        h = span_hashes(buf, starts, ends)
        order = np.argsort(h)
        ranked = h[order]
        head = np.ones(len(h), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        keys, one, back = ranked[head], order[head], np.empty(len(h), np.int64)
        back[order] = np.cumsum(head) - 1
        if len(self.keys) + len(keys) > REMEMBERED:
            self._tidy()
        if len(self.keys):
            at = np.searchsorted(self.keys, keys)
            fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
            self.again[self.place[at[~fresh]]] = True
            new = np.flatnonzero(fresh)
        else:
            at, new = np.zeros(0, np.int64), np.arange(len(keys))
        if len(new):
            self._learn(keys[new], buf, starts[one[new]], ends[one[new]])
            at = np.searchsorted(self.keys, keys)
        place = self.place[at][back] if len(keys) else at
        if not self._known(buf, starts, ends - starts, place):
            return self._plain(buf, offs)
        # a text's end is a piece after those that begin before it; a piece has an id at least
        last = np.searchsorted(starts, offs[1:])
        first, size = np.insert(self.first[place], last, 0), np.insert(self.count[place], last, 1)
        ends = np.cumsum(size, dtype=np.int64)
        flat = np.ones(ends[-1] if docs else 0, np.int64)
        flat[:1] = first[:1]
        flat[ends[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
        return self.pool.take(np.cumsum(flat, out=flat)), np.diff(ends[last + np.arange(docs)], prepend=0)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def in_parts(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text) in parts that are ranges of ascending ids of about PART_BYTES, null ids first; a part is a
    partition, sorted. Rows of one doc_id stand in the order of their texts, and fall into several parts if their first
    characters tell them apart."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(32))]
    dealt = base.repartitionByRange(max(sized_partitions(spark), -(-size // PART_BYTES)), *order).sortWithinPartitions(*order, "text")
    return dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    """(part, seq, documents, tokens, block) of all documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        part, seq = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            ids, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            block = encode_block(ids, counts, tokens, coder.vocabulary)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([block], pa.binary())]
            size, seq = 0, seq + 1
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "documents", "tokens", "block"])

        for b in batches:
            parts = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else []
            for x, y in zip(edges, [*edges[1:], len(parts)], strict=True):
                if held and parts[x] != part:
                    yield flush()
                if parts[x] != part:
                    part, seq = int(parts[x]), 0
                own = b.slice(x, y - x)
                ids = own.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                for i, j, buf, offs in text_slices(own.column(2)):
                    tokens, counts = coder.encode(buf, offs)
                    held.append((ids[i:j], counts, tokens))
                    size += len(tokens)
                    if size >= BLOCK:
                        yield flush()
        if held:
            yield flush()
        give_back()

    return in_parts(docs).mapInArrow(run, "part int, seq long, documents long, tokens long, block binary")


def write_tokens(docs: DataFrame, at: str, path: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to the folder ``at`` and returns what stands there."""
    blocks_of(docs, path or tokenizer_path()).write.mode("overwrite").parquet(at)
    return docs.sparkSession.read.parquet(at)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: start counts the ids of all documents before
    it, from sums over parts, then blocks, then within the block. A damaged block raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, counts, tokens = decode_block(b.column(2)[r].as_py())
                raw = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends - counts, ends, strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column(0)[r].as_py(), np.int32)), pa.array(np.full(n, b.column(1)[r].as_py(), np.int64)), pa.array(ids, mask=ids == NO_ID), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])
        give_back()

    blocks = files.select("part", "seq", "tokens")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("t"))
    # one row a part, and their number is that of the partitions
    parts = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    offsets = blocks.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    found = files.select("part", "seq", "block").mapInArrow(run, "part int, seq long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return found.join(bounded_broadcast(cut(offsets)), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to a fresh folder beside the checkpoints, and reads them back.

    Null and empty texts have the end id alone. Rows of one doc_id follow each other in the order of their texts,
    equal rows included; a null doc_id stands first (so does the least 64-bit number, which is read back as null).
    A very long text is one slice and one block of its own. Empty tables give no rows. Other columns are ignored.
    """
    return read_tokens(write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), path))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))
