"""The pipeline's stages against brute force on small tables."""

import re
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from lociflow.llm import mixing, quality_qda  # noqa: E402
from lociflow.llm.common import materialise  # noqa: E402

from test_first_five import DOCS, ODD, plain_simhash, roots  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "dedup", "mix", "pack"]
    stages = dict(pipeline.STAGES)
    good = materialise(stages["quality"](spark, docs, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    passed = {r.doc_id for r in quality_qda.score_documents(docs, labels).collect() if r.predicted}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == passed and len(passed) > 100
    one = materialise(stages["dedup"](spark, good, sf_dir))
    prints = [(r.doc_id, plain_simhash(r.text)) for r in good.collect()]
    root = roots({a for a, _ in prints}, [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 4])
    assert sorted(r.doc_id for r in one.collect()) == sorted(a for a in root if root[a] == a)
    mixed = materialise(stages["mix"](spark, one, sf_dir))
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(one).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and +got == +Counter(counts)
    pieces = stages["pack"](spark, mixed, sf_dir).collect()
    from tokenizers import Tokenizer

    from lociflow.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    packed, fill = Counter(), defaultdict(int)
    for r in pieces:
        packed[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert packed == tokens and max(fill.values()) <= 2048 and sum(f < 2048 for f in fill.values()) <= 11


def test_odd_rows(spark, sf_dir, tmp_path):
    for name in ("labels",):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame(ODD, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.createDataFrame(ODD, DOCS)
    good = {r.doc_id for r in quality_qda.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
    texts = {r[0]: r[1] for r in ODD}
    prints = {i: plain_simhash(texts[i]) for i in good if i is not None}
    first = {i for i in prints if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 4 for j in prints)}
    # what the mix may take: rows with words, of the documents that stayed (all such without doc_id)
    stayed = {i for i in first | (good & {None}) if WORD.search(texts[i] or "")}
    assert {r.doc_id for r in pieces} <= stayed and (pieces or not stayed)
    spans = defaultdict(list)
    for r in pieces:
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and min(s)[0] == 0
    empty = tmp_path / "empty"
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(empty / "labels.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
