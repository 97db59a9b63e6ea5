"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs (lines, longer ones cut where the content itself says so), each paragraph into a 64-bit
digest, and every digest is added to three cells of a small table of (count, sum of keys, sum of checks). Two such
sketches subtract cell by cell; peeling the difference recovers the digests that only one of two versions has. If
peeling stalls, both versions are sketched again into twice as many cells.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, mix, seeds, sized_partitions, small_batches, span_hashes, table, text_slices, word_spans

#: Cells of the fingerprint itself: three parts of eight.
CELLS = 24
#: Sketches grow up to so many cells for each digest of both versions.
MOST_CELLS = 16
#: Bytes of text in a block of successive ids, and of all versions of the rows that a task holds as sketches at once.
BLOCK_BYTES, GROUP_BYTES = 16 << 20, 4 << 20
_PARTS = seeds(3, 101)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
#: A paragraph also ends after a word whose hash is divisible by this.
CUT = np.uint64(4)
_PLACE = seeds(512, 202) | np.uint64(1)


def digests(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, digest) of every paragraph; the n-th repeat of a paragraph has a digest of its own."""
    starts, ends, doc = word_spans(buf, offs)
    if not len(starts):
        return doc, np.zeros(0, np.uint64)
    h = span_hashes(buf, starts, ends)
    lines = np.cumsum(buf == 10)
    last = np.ones(len(h), bool)
    last[:-1] = (h[:-1] % CUT == 0) | (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
    heads = np.flatnonzero(np.concatenate(([True], last[:-1])))
    size = np.diff(np.append(heads, len(h)))
    place = (np.arange(len(h)) - np.repeat(heads, size)) % len(_PLACE)
    key, doc = mix(np.add.reduceat(h * _PLACE[place], heads) + size.astype(np.uint64)), doc[heads]
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    return d, mix(k + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Sketch:
    """The cells of ``rows`` documents, ``cells`` (a multiple of 3) each."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells = rows, cells
        self.count = np.zeros(rows * cells, np.int64)
        self.key = np.zeros(rows * cells, np.uint64)
        self.check = np.zeros(rows * cells, np.uint64)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        third, s = self.cells // 3, np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        u = s.astype(np.uint64)
        for part in range(3):
            cell = row * self.cells + part * third + ((mix(key ^ _PARTS[part]) >> np.uint64(20)) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, cell, s)
            np.add.at(self.key, cell, key * u)
            np.add.at(self.check, cell, mix(key ^ _CHECK) * u)

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0, self.cells)
        out.rows, out.count, out.key, out.check = self.rows, self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row comes out whole, and how many digests only the first and only the second version had."""
        whole, row, _, side = self.recover()
        return whole, *(np.bincount(row[side == s], minlength=self.rows) for s in (1, -1))

    def recover(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the cells. Whether each row came out whole, and the (row, digest, side) that were recovered: side 1 is
        the first version's, -1 the second's."""
        rows, keys, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        todo = np.flatnonzero(self.count)
        while len(todo):
            c = self.count[todo]
            one = np.abs(c) == 1
            at, c = todo[one], c[one]
            key = self.key[at] * c.astype(np.uint64)
            good = self.check[at] * c.astype(np.uint64) == mix(key ^ _CHECK)
            at, c, key = at[good], c[good], key[good]
            if not len(at):
                break
            row = at // self.cells
            order = np.lexsort((key, row))
            row, key, c = row[order], key[order], c[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, c = row[new], key[new], c[new]
            rows.append(row)
            keys.append(key)
            sides.append(c)
            self.add(row, key, -c)
            third = self.cells // 3
            todo = np.unique(np.concatenate([row * self.cells + p * third + ((mix(key ^ _PARTS[p]) >> np.uint64(20)) % np.uint64(third)).astype(np.int64) for p in range(3)]))
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.rows, self.cells).any(1)
        return ~left, np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)

    def strings(self, total: np.ndarray) -> list[str]:
        """Each row's digest count and cells, little-endian, in base 64."""
        cells = np.zeros((self.rows, self.cells), _CELL)
        cells["count"], cells["key"], cells["check"] = (x.reshape(cells.shape) for x in (self.count, self.key, self.check))
        return [base64.b64encode(int(n).to_bytes(8, "little") + row.tobytes()).decode() for n, row in zip(total, cells, strict=True)]

    @classmethod
    def stored(cls, strings: list[str]) -> tuple[Sketch, np.ndarray]:
        """The sketch and digest counts behind fingerprints of one size."""
        raw = [base64.b64decode(x) for x in strings]
        cells = np.array([np.frombuffer(r, _CELL, offset=8) for r in raw], _CELL)
        out = cls(*cells.shape)
        out.count, out.key, out.check = cells["count"].astype(np.int64).ravel(), cells["key"].ravel().copy(), cells["check"].ravel().copy()
        return out, np.array([int.from_bytes(r[:8], "little") for r in raw], np.int64)


_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")])


def stored_difference(a: str, b: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests that only the first and only the second of two stored fingerprints' texts have; None if they differ
    in more than their cells can tell, some 20: then only the texts' larger sketches can."""
    (x, _), (y, _) = Sketch.stored([a]), Sketch.stored([b])
    whole, _, key, side = x.minus(y).recover()
    return (np.sort(key[side == 1]), np.sort(key[side == -1])) if whole[0] else None


def differences(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], base: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's likeness, and the (row, digest, side) in which its two versions differ, by subtracting and peeling
    sketches, twice as large ones for the rows that fail.

    The likeness is the Jaccard index of the paragraphs, 1 if neither has any. Rows that still fail with MOST_CELLS cells
    a digest, which only chance collisions of digests explain, are told apart by the digests themselves.
    """
    na, nb = np.bincount(a[0], minlength=rows), np.bincount(b[0], minlength=rows)
    out = np.ones(rows)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo, cells = np.flatnonzero(na + nb > 0), CELLS
    while len(todo):
        if base is not None and cells == CELLS:
            diff, place = base[0].minus(base[1]), np.arange(rows)
            whole, row, key, side = diff.recover()
            whole = whole[todo]
        else:
            place = np.full(rows, -1)
            place[todo] = np.arange(len(todo))
            left, right = Sketch(len(todo), cells), Sketch(len(todo), cells)
            for sketch, (own_row, own_key) in ((left, a), (right, b)):
                own = place[own_row] >= 0
                sketch.add(place[own_row[own]], own_key[own])
            whole, row, key, side = left.minus(right).recover()
            row = todo[row]
        only_a, only_b = (np.bincount(row[side == s], minlength=rows)[todo] for s in (1, -1))
        # false keys, if ever, show as counts that can't be
        whole = whole & (only_a <= na[todo]) & (only_b <= nb[todo]) & (na[todo] - only_a == nb[todo] - only_b)
        own = np.zeros(rows, bool)
        own[todo[whole]] = True
        found.append((row[own[row]], key[own[row]], side[own[row]]))
        done = todo[whole]
        both = na[done] - only_a[whole]
        out[done] = both / np.maximum(na[done] + nb[done] - both, 1)
        todo, cells = todo[~whole], cells * 2
        for r in todo[cells > MOST_CELLS * (na + nb)[todo] + CELLS].tolist():
            x, y = a[1][a[0] == r], b[1][b[0] == r]
            for keys, s in ((np.setdiff1d(x, y), 1), (np.setdiff1d(y, x), -1)):
                found.append((np.full(len(keys), r), keys, np.full(len(keys), s)))
            both = len(np.intersect1d(x, y))
            out[r] = both / max(na[r] + nb[r] - both, 1)
        todo = todo[cells <= MOST_CELLS * (na + nb)[todo] + CELLS]
    return out, *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i == 1 else np.int64) for i in range(3))


def likeness(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], base: tuple[Sketch, Sketch] | None = None) -> np.ndarray:
    return differences(rows, a, b, base)[0]


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text) for every row: the next row is that of the next lower id (after the last: the first).

    Rows are dealt into blocks of successive ids of about BLOCK_BYTES, however large the input; the rows of a block's
    highest id also go to the block above it, so that every window is one block. Rows of equal ids are in the order of
    their texts; null ids stand last. Empty texts for null.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = base.select("doc_id")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = max(sized_partitions(spark), -(-size // BLOCK_BYTES))
    # two levels of bounds, each of about the root of the blocks; every bound is an id that is there
    outer, inner = -(-want // math.isqrt(want)), math.isqrt(want)
    row = ids.agg(F.percentile_approx("doc_id", _shares(outer), 20 * outer).alias("cuts"), F.max("doc_id").alias("top")).first()
    tops = sorted({*(row["cuts"] or []), *([] if row["top"] is None else [row["top"]])})
    level = F.size(F.filter(F.array(*map(_long, tops)), lambda c: c < F.col("doc_id"))) if tops else F.lit(0)
    level = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(level).cast("long").alias("level")
    fine = ids.select("doc_id", level).groupBy("level").agg(F.percentile_approx("doc_id", _shares(inner), 20 * inner).alias("cuts"), F.max("doc_id").alias("top"))
    fine = fine.select("level", F.array_sort(F.array_distinct(F.filter(F.array_append(F.coalesce("cuts", F.array().cast("array<bigint>")), F.col("top")), lambda c: c.isNotNull()))).alias("bounds"))
    rows = base.select("doc_id", "text", level).join(bounded_broadcast(cut(fine), size=8 * F.size("bounds")), "level")
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter("bounds", lambda c: c < F.col("doc_id"))))
    rows = rows.withColumn("place", place).withColumn("at", F.col("level") * (inner + 1) + F.col("place"))
    # block 0 has the lowest ids and the nulls; above the highest block is block 0 again
    above = F.when(F.col("place") + 1 < F.size("bounds"), F.col("at") + 1).when(F.col("level") + 1 < len(tops), (F.col("level") + 1) * (inner + 1)).otherwise(0).cast("long")
    is_top = F.col("doc_id") == F.try_element_at("bounds", F.col("place") + 1) if tops else F.lit(True)
    own = F.struct(F.col("at"), F.lit(False).alias("guest"))
    guest = F.struct(above.alias("at"), F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "p.at", "p.guest")
    # guests stand after all rows of the block, the wrap-around's after the null ids too
    w = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.repartitionByRange(want, "at").withColumn("next_text", F.lead("text").over(w))
    return dealt.filter("not guest").select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


def _shares(n: int) -> list[float]:
    return [i / n for i in range(1, n)] or [1.0]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _row_groups(b: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Successive rows whose texts make about GROUP_BYTES, or a single longer row."""
    size = sum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(x))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
    ends = np.cumsum(size)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GROUP_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def fingerprint_versions(pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, text, edited, next_text, ...) with fingerprint, edited_fingerprint, near_edited, near_next,
    removed and added (arrays: the digests that only the text, and only its edited version, has) in place of the texts;
    columns of these names are replaced, others are kept.

    Null texts count as empty; equal texts have equal fingerprints; an empty text's sketch is all zeros, and two empty
    texts are alike (1). Very long texts are sketched whole, a row at a time. Rows may repeat: each is done for itself.
    Empty tables give no rows.
    """
    made = ("fingerprint", "edited_fingerprint", "near_edited", "near_next", "removed", "added")
    names = ("text", "edited", "next_text")
    keep = [f for f in pairs.schema.fields if f.name not in (*names, *made)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "fingerprint string, edited_fingerprint string, near_edited double, near_next double, removed array<long>, added array<long>"])
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _row_groups(whole, names)):
            found = {}
            for name in names:
                rows, keys = [], []
                for i, _, buf, offs in text_slices(b.column(b.schema.get_field_index(name))):
                    row, key = digests(buf, offs)
                    rows.append(row + i)
                    keys.append(key)
                found[name] = np.concatenate(rows), np.concatenate(keys)
            n = b.num_rows
            base = {}
            for name in found:
                base[name] = Sketch(n, CELLS)
                base[name].add(*found[name])
            prints = [pa.array(base[x].strings(np.bincount(found[x][0], minlength=n))) for x in ("text", "edited")]
            near, row, key, side = differences(n, found["text"], found["edited"], (base["text"], base["edited"]))
            near_next = likeness(n, found["text"], found["next_text"], (base["text"], base["next_text"]))
            lists = []
            for s in (1, -1):
                order = np.lexsort((key[side == s], row[side == s]))
                at = np.concatenate(([0], np.cumsum(np.bincount(row[side == s], minlength=n)))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(key[side == s][order].view(np.int64))))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), *prints, pa.array(near), pa.array(near_next), *lists], names=[*(f.name for f in keep), *made])

    return pairs.mapInArrow(run, schema)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256))
    found = fingerprint_versions(docs).withColumns({"n_removed": F.size("removed").cast("long"), "n_added": F.size("added").cast("long")})
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_removed", "n_added")
