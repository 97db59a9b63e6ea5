import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import range_coder, token_files

ODD = ["", " ", "a", " a  b ", "x\u00a0 y", "caf\u00e9 \u3000 z", "\n\n a\n", "foo<|endoftext|> bar", "don't  stop\t\t!", "\u00e9 \u00e9  \u00e9", "\u4e2d\u6587 \u4e2d", "a\x1c b", "tr\u2003 em", "end  ", "\U0001f600 ok"]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 70_001])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50256).astype(np.int64)
    if n > 1000:
        ids[500:900] = np.tile([7, 8, 9, 50256], 100)
        ids[900:1000] = rng.integers(0, 50257, 100)
    counts = np.array([n // 3, 0, n - n // 3])
    docs = np.array([-5, 3, 2**60])
    block = range_coder.encode_block(docs, counts, ids, 50257)
    got = range_coder.decode_block(block)
    assert all((x == y).all() for x, y in zip(got, (docs, counts, ids), strict=True))
    assert n < 5000 or len(block) < 2.2 * n


def test_one_id_alone_and_damage():
    ids = np.full(3000, 42)
    block = range_coder.encode_block(np.array([1]), np.array([3000]), ids, 43)
    assert (range_coder.decode_block(block)[2] == 42).all()
    for at in (5, 40, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode_block(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.decode_block(block[:20])
    with pytest.raises(ValueError):
        range_coder.encode_block(np.array([1]), np.array([1]), np.array([43]), 43)


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    marks = ["a", "The", "'s", " ", "  ", "\n", "\t", "\u00a0", "\u00e9", "\u00fc", "1", "22", "!", "...", "\u2003", "\u4e2d", "\U0001f600", "\x1f"]
    texts = ODD + ["".join(rng.choice(marks, int(rng.integers(0, 30)))) for _ in range(300)]
    coder = token_files.PieceEncoder(token_files.tokenizer_path())
    monkeypatch.setattr(token_files, "REMEMBERED", 500)
    import pyarrow as pa

    want = reference(texts)
    for _ in range(2):
        ids, counts = [], []
        for _, _, buf, offs in token_files.text_slices(pa.array(texts), 200):
            x, n = coder.encode(buf, offs)
            ids.append(x)
            counts.append(n)
        assert (np.concatenate(counts) == [len(w) for w in want]).all() and (np.concatenate(ids) == np.concatenate(want)).all()


def parity(n, swap=False):
    """Two words of equal sums of powers of two at any scale: the bits' parities, and their complement."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_equal_power_sums_keep_their_ids(spark, n):
    texts = [parity(n), parity(n, True), f"x {parity(n, True)} y", f"x {parity(n)} y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [r["ids_crc32"] for r in token_files.tokens_of(df).orderBy("doc_id").collect()]
    assert got == [zlib.crc32(w.tobytes()) for w in reference(texts)]


def test_colliding_hashes_do_not_change_ids(monkeypatch):
    """Pieces of up to 8 bytes can't collide; all longer ones do here."""
    import pyarrow as pa

    real = token_files.span_hashes
    monkeypatch.setattr(token_files, "span_hashes", lambda buf, starts, ends: np.where(ends - starts > 8, np.uint64(1 << 63), real(buf, starts, ends)))
    texts = ["a bcdefghijk!", "a bcdefghijl! bcdefghijk", *ODD, "one two three", "six ten two", "abc def " + "z" * 90, "abd def " + "y" * 90]
    coder = token_files.PieceEncoder(token_files.tokenizer_path())
    ids = np.concatenate([coder.encode(buf, offs)[0] for _, _, buf, offs in token_files.text_slices(pa.array(texts), 20)])
    assert (ids == np.concatenate(reference(texts))).all()


def test_parts_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 1000)
    df = spark.createDataFrame([(i, "word " * 40) for i in range(100)], "doc_id long, text string")
    files = token_files.blocks_of(df, token_files.tokenizer_path())
    assert files.select("part").distinct().count() >= 15 and files.agg(F.sum("documents")).first()[0] == 100


def test_files_have_all_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 300)
    rng = np.random.default_rng(2)
    texts = [*ODD, None, "w " * 4000, *(" ".join("w%d" % i for i in rng.integers(0, 99, 40)) for _ in range(80))]
    ids = rng.permutation(len(texts)) * 7 - 50
    df = spark.createDataFrame(list(zip(ids.tolist(), texts)), "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("part", F.lit(2)).repartition(6)
    got = [tuple(r) for r in token_files.tokens_of(df).orderBy("doc_id").collect()]
    order = np.argsort(ids)
    want = reference([texts[i] for i in order])
    sizes = [len(w) for w in want]
    starts = np.cumsum(sizes) - sizes
    assert got == [(int(ids[i]), int(s), n, zlib.crc32(w.tobytes())) for i, s, n, w in zip(order, starts, sizes, want)]


def test_empty_table_ties_and_null_ids(spark):
    assert token_files.tokens_of(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "b"), (1, "a b"), (None, "n"), (1, "b")], "doc_id long, text string")
    got = [tuple(r)[:3] for r in token_files.tokens_of(df).orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 3), (1, 5, 2), (1, 7, 2)]


def test_pieces_that_are_met_again_are_encoded_once(monkeypatch):
    """Words that no other slice has don't drive out those that all have; nor is an accented letter a piece with each mark."""
    import pyarrow as pa

    monkeypatch.setattr(token_files, "REMEMBERED", 500)
    coder = token_files.PieceEncoder(token_files.tokenizer_path())
    learnt, real = [], coder._learn
    coder._learn = lambda keys, *rest: (learnt.append(len(keys)), real(keys, *rest))
    common = [f"c{k}" for k in range(100)]
    texts = [" ".join([*common, *(f"f{k}x{i}" for i in range(50))]) for k in range(40)]
    texts += [f"caf\u00e9{a}{b}" for a in ".,;:!?" for b in ".,;:!?"]
    got = [coder.encode(buf, offs) for _, _, buf, offs in token_files.text_slices(pa.array(texts), 300)]
    assert (np.concatenate([x for x, _ in got]) == np.concatenate(reference(texts))).all()
    assert sum(learnt) < 40 * 50 + 100 + 60
    got = [coder.encode(buf, offs) for _, _, buf, offs in token_files.text_slices(pa.array(["\u00d7. a\u00f7! \u00ff. \u00c0?"]), 300)]
    assert (got[0][0] == reference(["\u00d7. a\u00f7! \u00ff. \u00c0?"])[0]).all()
