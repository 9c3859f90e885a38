"""The pipeline against the stages' brute-force versions, one after the other."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import quality
from lexweave.llm.queries import quality_weights
from tests.llm.test_operators import JSON, jaccard_classes, line_brute, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(words(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.3:
            text += "\nThis text is licensed under some licence."
        good = int(i % 5 > 0)
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", f"src{i % 12}", len(text)))
        if i % 2:
            labels.append((i, good, 0))
    for i in range(30):
        w = rows[7][1].split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((500 + i, " ".join(w), "en", f"src{i % 12}", 0))
    rows += [(900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (902, " ", None, None, 0), (None, "a text without an id but with words", "en", "src3", 0), rows[9], rows[9]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = quality_weights(whole, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in whole.withColumn("p", quality.score(F.col("text"), weights)).collect() if r.p >= 0.7]
    assert 200 < len(want) < 260 and not any((r.text or "").isupper() for r in want)

    kinds = [c for c in whole.dtypes]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.dtypes == kinds and docs.count() <= before.count()
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "quality":
            assert got == Counter((r.doc_id, r.text) for r in want)
        if name == "lines":
            lines = line_brute([(r.doc_id, r.text, r.source) for r in want], 8, True)
            assert got == Counter((i, t) for i, t, *_ in lines.elements()) and any(x[3] for x in lines)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text and r.n_chars and r.doc_id < 500)
        if name == "near":
            rows = sorted(((i, t) for i, t, *_ in lines.elements()), key=lambda r: (r[0] is None, r[0] or 0))
            classes = jaccard_classes([t for _, t in rows])
            kept = [r for k, r in enumerate(rows) if classes[k] == k]
            assert got == Counter(kept) and sum(500 <= (i or 0) < 530 for i, _ in kept) <= 15
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    tokenizer, total = Tokenizer.from_file(JSON), Counter()
    for i, t in got:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            total[(i, start, zlib.crc32(np.array(ids[start : start + 1024], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces) == total


def test_clashing_columns_and_repeated_ids(spark, sf_dir):
    rng = random.Random(12)
    one, two = (words(rng, 30) for _ in range(2))
    texts = [(1, one), (2, one), (2, two), (3, None), (3, None), (None, one), (None, two), (None, words(rng, 30)), (4, " ")]
    names = ("kept", "_text", "n_lines", "n_removed", "exempt", "key", "row", "class_id", "n_shingles", "worded")
    rows = [(i, t, "en", f"s{k}", 0, *range(70, 70 + len(names))) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {c} int" for c in names))
    lines = corpus_pipeline.line_deduplicated(spark, docs, sf_dir)
    assert lines.dtypes == docs.dtypes and sorted(map(str, lines.collect())) == sorted(map(str, docs.collect()))
    near = corpus_pipeline.near_deduplicated(spark, docs, sf_dir)
    assert near.dtypes == docs.dtypes and all(tuple(r)[5:] == tuple(range(70, 70 + len(names))) for r in near.collect())
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([(1, one), (2, two), (3, None), (3, None), (None, texts[7][1]), (4, " ")])


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_empty(spark, sf_dir, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
