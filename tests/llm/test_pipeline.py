import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulsegrid.llm.registry import ORACLE_SQL, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    at = tmp_path_factory.mktemp("tables")
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    items = [prose(30) for _ in range(5)]
    rows, labels = [], []
    for i in range(300):
        text, good = prose(60) + ".", i % 6 != 0
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[1 + 6 * i][1] + " more", "en", None, 1) for i in range(8)]
    rows += [(2000 + i, prose(20) + " " + items[i] + " " + prose(20), None, "src0", 1) for i in range(5)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_work_on_all_that_is_left(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    bad = {i for i in range(0, 300, 6)}
    assert not ids[0] & bad and {i for i in range(300)} - bad <= ids[0]
    assert ids[0] - ids[1] == {1000 + i for i in range(8)}
    assert ids[1] - ids[2] == {2000 + i for i in range(5)}
    assert ids[3] < ids[2] and len(ids[3]) > 0.75 * len(ids[2])
    assert ids[4] == ids[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == ids[4]


def test_stages_take_empty_tables_and_odd_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.withColumns({c: F.lit("x") for c in ("topic", "tokens", "keep", "kept", "leaked", "evidence", "component_id", "part", "task")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        few = stage(spark, odd.filter("doc_id < 30 or doc_id >= 3000"), folder)
        assert few.columns == odd.columns and few.filter("topic = 'x'").count() > 20


def test_the_pipeline_equals_a_plain_one(spark, folder):
    """The decisions of quality and mixing are taken from the operators; duplicates, leaks and token ids are found plainly."""
    from tokenizers import Tokenizer

    from pulsegrid.llm import mixing, quality, token_files

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang")
    good = {r["doc_id"]: r["text"] for r in quality.judged(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).filter("probability >= 0.5").collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    sets = {i: shingles(t) for i, t in good.items()}
    kept = []
    for i in sorted(good):  # the planted copies have one original each
        if not any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in kept if sets[i]):
            kept.append(i)
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(x in (good[i] or "") for x in items)]
    left = spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("doc_id").isin(kept))
    drawn = sorted(r["doc_id"] for r in mixing.mixed(left, budget=corpus_pipeline.BUDGET).filter("kept").collect())
    coder, want, start = Tokenizer.from_file(token_files.tokenizer_path()), {}, 0
    for i in drawn:
        ids = np.array([*coder.encode(good[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_stages_take_very_long_texts_repeated_rows_and_null_ids(spark, folder):
    """A document of a megabyte, a copy of it, rows repeated whole, several of one doc_id, and one without."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(3)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(150_000)) + "."
    rows = [(5001, long, "en", "src0", 1), (5002, long + " more", "en", "src0", 1), *[(5003, "one text of a row that stands here five times, whole.", "en", "src1", 1)] * 5, (5004, "another text under the one number, and a plain one.", "en", "src1", 1), (5004, "yet another text under this number, plain as well.", "en", "src1", 1), (None, "a text without a number, which stays where others stay.", "en", "src1", 1)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    good, one, clean, mixed = (f for _, f in corpus_pipeline.STAGES[:4])
    kept = good(spark, more, folder)
    assert kept.filter("doc_id = 5003").count() in (0, 5) and kept.filter("doc_id between 5001 and 5002").count() in (0, 2)  # judged alike
    kept = more  # whatever the classifier makes of such texts, the later stages take them
    count = {r["doc_id"]: r["n"] for r in one(spark, kept, folder).groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id >= 5000 or doc_id is null").collect()}
    assert count == {5001: 1, 5003: 5, 5004: 2, None: 1}  # rows of one doc_id are one document
    left = clean(spark, more, folder)
    assert left.filter("doc_id >= 5000 or doc_id is null").count() == len(rows)
    drawn = {r["doc_id"]: r["n"] for r in mixed(spark, left, folder).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert drawn.get(5003, 5) == 5 and drawn.get(5004, 2) == 2  # rows of one doc_id fall together
    ids = corpus_pipeline.STAGES[4][1](spark, left, folder).filter("doc_id >= 5000 or doc_id is null").collect()
    assert len(ids) == len(rows) and len({r["start"] for r in ids}) == len(rows)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__spark_entry__.__file__).parent
    for f in [*(root / "pulsegrid").rglob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" not in f.parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", f.read_text()), f
    assert "localCheckpoint(" not in "".join(f.read_text() for f in (root / "pulsegrid").rglob("*.py"))
