"""SentencePiece encoding that keeps where in the source each piece comes from, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; every byte of the normalised
text remembers the source byte it stands for. The library then cuts the normalised text by a model without a normaliser of
its own, word by word where no piece reaches over the beginning of a word, and the pieces' lengths carry their ends back
to bytes of the source.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

#: Words whose pieces a task remembers, and how long they may be.
REMEMBERED, LONGEST = 200_000, 48
#: What stands for a space in pieces.
SPACE = "▁"
_SPACE = SPACE.encode()

# fixed values: field numbers of the public model format, and the kinds of pieces
PIECES, NORMALISER, TRAINER = 1, 3, 2
PIECE_TEXT, PIECE_KIND = 1, 3
MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
SPACE_BEHIND, FALLBACK = 24, 35
CONTROL, USER_DEFINED, BYTE = 3, 4, 6


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _number(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message in the protocol buffers' wire format."""
    i = 0
    while i < len(b):
        key, i = _number(b, i)
        if key & 7 == 0:
            value, i = _number(b, i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(key & 7) or _number(b, i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


def _field(number: int, value: bytes) -> bytes:
    out, rest = bytearray(), [number << 3 | 2, len(value)]
    for x in rest:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out) + value


class CharacterMap:
    """The compiled map of a model: a double array of byte prefixes, and the strings that they become."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.strings = blob[4 + size :]

    # fixed values: the bits of a unit of the public double-array format
    def _step(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest prefix known at each place (0: none), and where its string begins."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.full(len(at), int(self._step(self.units[0])))
        depth = 0
        while len(live):
            live, node = live[at[live] + depth < len(buf)], node[at[live] + depth < len(buf)]
            byte = buf[at[live] + depth].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            live, node, byte = live[inside], node[inside], byte[inside]
            unit = self.units[node]
            same = (unit & 0x800000FF) == byte
            live, node, unit = live[same], node[same] ^ self._step(unit[same]), unit[same]
            depth += 1
            ends = (unit >> 8) & 1 == 1
            length[live[ends]] = depth
            value[live[ends]] = self.units[node[ends]] & 0x7FFFFFFF
        return length, value

    def string(self, begin: int) -> bytes:
        return self.strings[begin : self.strings.index(b"\0", begin)]


class Normaliser:
    """Bytes to normalised bytes, and for each of these (and the end) the place in the source."""

    def __init__(self, spec: bytes):
        got = dict(message(spec))
        self.map = CharacterMap(got[MAP]) if got.get(MAP) else None
        # what a model leaves unsaid is true
        self.prefix, self.remove, self.escape = (bool(got.get(k, 1)) for k in (DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE))

    def _mapped(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the map makes, and for each where in ``buf`` the prefix began that it comes from."""
        starts = np.flatnonzero((buf & 0xC0) != 0x80)
        sizes = np.diff(np.append(starts, len(buf)))
        if self.map is None:
            return buf, np.repeat(starts, sizes)
        known, value = self.map.longest(buf, starts)
        keep = np.ones(len(starts), bool)
        for i in np.flatnonzero(known > sizes).tolist():  # a prefix of several characters takes the later ones with it
            if keep[i]:
                keep[i + 1 : np.searchsorted(starts, starts[i] + known[i])] = False
        hit = np.flatnonzero(keep & (known > 0))
        if not len(hit):
            return buf, np.repeat(starts, sizes)
        strings = {v: np.frombuffer(self.map.string(v), np.uint8) for v in np.unique(value[hit]).tolist()}
        width = np.where(keep, np.where(known > 0, 0, sizes), 0)
        width[hit] = [len(strings[v]) for v in value[hit].tolist()]
        begin = np.cumsum(width) - width
        out, origin = np.zeros(int(width.sum()), np.uint8), np.repeat(starts, width)
        plain = np.flatnonzero(keep & (known == 0))
        span = np.repeat(starts[plain] - begin[plain], sizes[plain])
        where = np.arange(sizes[plain].sum()) - np.repeat(np.cumsum(sizes[plain]) - sizes[plain], sizes[plain]) + np.repeat(begin[plain], sizes[plain])
        out[where] = buf[where + span]
        for v, string in strings.items():
            at = begin[hit[value[hit] == v]]
            out[(at[:, None] + np.arange(len(string))).ravel()] = np.tile(string, len(at))
        return out, origin

    def _squeezed(self, out: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without spaces that lead or follow a space; those within what one prefix becomes stay."""
        if not len(out):
            return out, origin
        blank = out == 32
        first = np.concatenate(([True], origin[1:] != origin[:-1]))
        head = np.flatnonzero(first)
        after = np.concatenate(([True], blank[:-1]))[head]  # the prefix follows a space or begins the text
        group = np.cumsum(first) - 1
        solid = np.cumsum(~blank)
        leading = solid == (solid - ~blank)[head][group]
        stay = ~(leading & after[group])
        return out[stay], origin[stay]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int32)
        buf = np.frombuffer(text, np.uint8)
        out, origin = self._mapped(buf)
        begin, end = 0, len(buf)
        if self.remove:
            whole, at = out, origin
            out, origin = self._squeezed(out, origin)
            if not len(out) and (whole == 32).all() and len(whole):
                return b"", np.zeros(1, np.int32)
            lone = (whole == 32) & np.concatenate(([True], at[1:] != at[:-1])) & np.concatenate((at[1:] != at[:-1], [True]))
            heading = int(np.argmin(np.append(lone, False)))  # as many prefixes become a single space
            begin = int(at[heading]) if heading < len(at) else end
        if self.prefix:
            origin, out = np.concatenate(([begin], origin)), np.concatenate(([32], out))
        width = np.where(out == 32, 3 if self.escape else 1, 1)
        made, mark = out.astype(np.uint8).tobytes(), b" "
        if self.escape:
            made, mark = made.replace(b" ", _SPACE), _SPACE
        places, kept = np.append(np.repeat(origin, width), end).astype(np.int32), len(made)
        while self.remove and made.endswith(mark, 0, kept):  # what the text itself has of these marks goes too
            kept -= len(mark)
        return made[:kept], places[: kept + 1]


class Encoder:
    """Of texts: ids with begin and end id, spans of source bytes, decoded texts. The model must have byte pieces, so that
    every piece has a length of its own, and no pieces that its user defined."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        fields = list(message(model))
        pieces = [dict(message(v)) for k, v in fields if k == PIECES]
        kinds = np.array([p.get(PIECE_KIND, 1) for p in pieces])
        trainer = dict(message(next((v for k, v in fields if k == TRAINER), b"")))
        if not trainer.get(FALLBACK) or (kinds == USER_DEFINED).any() or trainer.get(SPACE_BEHIND):
            raise ValueError("only models with byte pieces, with spaces in front and without pieces of the user's can be projected")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalise = Normaliser(next((v for k, v in fields if k == NORMALISER), b""))
        # the same pieces; texts come normalised, so nothing is prefixed, removed or escaped any more
        plain = _field(1, b"identity") + bytes([DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0])
        bare = b"".join(_field(k, v) for k, v in fields if k not in (NORMALISER,)) + _field(NORMALISER, plain)
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.lengths = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(p.get(PIECE_TEXT, b"")) for kind, p in zip(kinds, pieces, strict=True)])
        texts = [p.get(PIECE_TEXT, b"").decode() for p in pieces]
        # a piece with a space after other characters would reach over words
        by_words = SPACE in texts and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in texts)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_words else r"(?s).+")
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of normalised texts, without begin and end."""
        cut, known = [self.words.findall(t) for t in texts], self.known
        new = list({w for words in cut for w in words if w not in known})
        known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(new, self.cutter.encode(new, num_threads=1), strict=True))
        found = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in cut]
        if len(known) > REMEMBERED:
            known.clear()
        for w in new:
            if len(w) > LONGEST:
                known.pop(w, None)
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, spans) of each text; spans has the first source byte of each id, and the one after its last. Begin and end
        id have empty spans at the text's ends, a piece that stands for nothing in the source an empty one where it is."""
        made = [self.normalise(t.encode()) for t in texts]
        for (_, origin), ids in zip(made, self.ids([m.decode() for m, _ in made]), strict=True):
            ends = np.cumsum(self.lengths[ids])
            if int(ends[-1] if len(ends) else 0) != len(origin) - 1:
                raise ValueError("pieces and text differ in length")
            spans = np.zeros((len(ids) + 2, 2), "<u4")
            spans[1:-1, 0], spans[1:-1, 1] = origin[ends - self.lengths[ids]], origin[ends]
            spans[-1] = origin[-1]
            yield np.concatenate(([self.whole.bos_id()], ids, [self.whole.eos_id()])).astype("<u4"), spans

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, spans, decoded) of every row of ``docs`` (doc_id, text): the ids as little-endian unsigned 32-bit
    integers, begin and end id with them; for each id the two ends of its source bytes in the same form; and the text
    that the ids decode to.

    Null texts are empty ones, which have the begin and the end id. Repeated rows give repeated rows, a null doc_id stays,
    an empty table gives no rows, and other columns are ignored. A very long text is in the memory of its task, alone.
    """
    small_batches(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for b in batches:
            size = np.diff(np.append(0, np.cumsum([len(x) for x in b.column(1).fill_null("").to_pylist()])))
            at = 0
            while at < len(size):  # a long text's pieces go out before the next one's are made
                upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 1 << 20, "right")) + at)
                texts = b.column(1).slice(at, upto - at).fill_null("").to_pylist()
                found = list(coder.encode(texts))
                rows = [pa.array([x.tobytes() for x in col], pa.large_binary()) for col in zip(*found, strict=True)]
                decoded = pa.array([coder.decode(ids) for ids, _ in found], pa.large_string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, upto - at), *(x.cast(pa.binary()) for x in rows), decoded.cast(pa.string())], names=["doc_id", "ids", "spans", "decoded"])
                at = upto
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, spans binary, decoded string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"))
    hexed = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "spans")]
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), *hexed, F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
