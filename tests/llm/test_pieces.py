import hashlib

import numpy as np
import pytest
import sentencepiece

from pulsegrid.llm import pieces

MARKS = ["a", "The", " ", "  ", "\n", "\t", "　", "ｆ", "①", "㌕", "​", "é", "é", "ﾊﾞ", "가", "ß", " ", "世", "\U0001f600", "ﷺ", "­", "▁", "<s>", "</s>", "0", "\x00"]
TEXTS = ["", " ", "   ", "a", " a  b ", "héllo  世界\U0001f600x  ", "▁ ▁▁x", "\n\n", "<s>x</s>", "end\n"]


def some(n, seed, most=14):
    rng = np.random.default_rng(seed)
    return TEXTS + ["".join(rng.choice(MARKS, int(rng.integers(0, most)))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_maps_and_their_origins_equal_the_librarys(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normaliser(dict(pieces.message(library.serialized_model_proto()))[pieces.NORMALISER])
    for x in some(1500, 1):
        want, origin = library.normalize(x, with_offsets=True)
        got, places = own(x.encode())
        assert got.decode() == want, repr(x)
        # the library counts characters
        assert [len(x[:c].encode()) for c in origin] == [int(places[len(want[:i].encode())]) for i in range(len(want) + 1)], repr(x)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_ids_and_spans_equal_the_librarys(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 300)
    coder = pieces.Encoder(pieces.model_path())
    texts = some(1500, 2, 40) + ["x" * 5000, "世" * 300, " " * 1000 + "q"]
    got = [r for i in range(0, len(texts), 50) for r in coder.encode(texts[i : i + 50])]
    for x, (ids, spans) in zip(texts, got, strict=True):
        proto = library.encode(x, return_type="proto")
        assert ids.tolist() == [1, *(p.id for p in proto.pieces), 2], repr(x)
        assert coder.decode(ids) == library.decode(ids.tolist())
        source, at = x.encode(), 0
        for p, (i, j) in zip(proto.pieces, spans[1:-1].tolist(), strict=True):
            assert i == at  # the spans cover the source
            at = j
            if not library.is_byte(p.id):
                assert source[i:j].decode() == p.surface
                assert (p.begin, p.end) == (i, j)
        assert at == len(source)


def test_models_that_cannot_be_projected(tmp_path):
    with open(pieces.model_path(), "rb") as f:
        fields = list(pieces.message(f.read()))
    model = b"".join(pieces._field(k, v) for k, v in fields if k == pieces.PIECES)
    (tmp_path / "m").write_bytes(model)
    with pytest.raises(ValueError, match="byte pieces"):
        pieces.Encoder(str(tmp_path / "m"))


def test_rows(spark, library):
    long = "word 世  " * 300_000
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, long)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.spans), r.decoded) for r in pieces.encoded(docs).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        spans = next(r[2] for r in got if r[1] == raw)
        assert len(spans) == 2 * len(raw)
        want.append((i, raw, spans, library.decode(ids)))
    assert got == sorted(want, key=str)
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op13_pieces(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
