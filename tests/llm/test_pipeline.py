"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from test_operators import brute_contaminated, brute_copies  # noqa: E402
from tidewell.llm import language_id, toxicity  # noqa: E402
from tidewell.llm.queries import VOCABULARY  # noqa: E402
from tidewell.llm.shared import stored, work_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, SF), work_dir(spark, f"tp{k}"))
        kept.append((before, docs))
        if k < 4:
            assert docs.columns == columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}

    before, after = kept[0]
    found = language_id.identify(before, language_id.fit(before), work_dir(spark, "tp"), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    assert ids(after) == ids(found.where("lang <> 'und'")) and len(ids(after)) >= 0.99 * len(ids(before))

    before, after = kept[1]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), work_dir(spark, "tp"))
    assert ids(after) == ids(toxicity.score(before, model).where("predicted = 0"))

    before, after = kept[2]
    _, component = brute_copies(sorted((r["doc_id"], r["text"]) for r in before.collect()))
    assert ids(after) == {i for i, c in component.items() if i == c}

    before, after = kept[3]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == {r["doc_id"] for r in before.collect() if not any(brute_contaminated(r["text"], t) for t in items)}

    before, after = kept[4]
    library = Tokenizer.from_file(VOCABULARY)
    want = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in before.collect()}
    for r in after.collect():
        assert list(r["ids"]) == want.pop(r["doc_id"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert not want
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept[4][1])


def test_stages_on_empty_and_awkward_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "der die das und ist nicht", "de", "s", 3), (3, "x " * 20000, "en", "s", 1)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stored(stage(spark, docs, SF), work_dir(spark, f"te{k}"))
        assert docs.count() <= len(some)


def test_rows_of_one_id_are_judged_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'de'").limit(2).collect()
    rows = [(None, None, None, None, None), (None, good[0]["text"], "de", "s", 1), (7, None, None, None, 0), (7, good[1]["text"], "de", None, 1)]
    left = corpus_pipeline.identified(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)).where("doc_id is null or doc_id = 7 or doc_id % 3 = 0"), SF)
    assert left.columns == docs.columns
    assert [r["text"] for r in left.where("doc_id is null").collect()] == [good[0]["text"]]
    assert good[1]["text"] in [r["text"] for r in left.where("doc_id = 7").collect()] and left.where("doc_id = 7 and text is null").count() == 0
