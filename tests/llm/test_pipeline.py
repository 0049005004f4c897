"""The pipeline's stages on a small corpus, each against what it must do to its input."""

import __spark_entry__ as entry
import corpus_pipeline
from larder.llm import quality
from tests.conftest import SF
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, seen[-1], SF).cache()
        seen.append(df)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
    first, good, single, masked, mixed, encoded = ([tuple(r) for r in df.collect()] for df in seen)

    verdict = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(good) == sorted(r for r in first if verdict[r[0]])
    near = brute.near([r[:2] for r in good])
    assert sorted(single) == sorted(r for r in good if near[r[0]][2])
    assert {r[0] for r in masked} == {r[0] for r in single}
    assert not any("@" in r[1] and ".example.com" in r[1] for r in masked)
    assert {r[0] for r in mixed} <= {r[0] for r in masked}
    times = {}
    for r in mixed:
        times[r] = times.get(r, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= set(masked)
    assert len(encoded) == len(mixed) and all(r[-1] for r in encoded)


def test_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0
