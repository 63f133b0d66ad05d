import corpus_pipeline
from feedspan.llm.mixing import take_counts, weight_table
from feedspan.llm.queries import WEIGHTS

from helpers import awkward
from test_minhash import brute_classes

FOLDER = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        last = list(frames.values())[-1]
        out = stage(spark, last, FOLDER).cache()
        frames[name] = out
        if name != "packing":
            assert out.columns == docs.columns
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in frames.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    assert set(ids["toxicity"]) < set(ids[""]) and set(ids["quality"]) < set(ids["toxicity"])
    classes = brute_classes({r.doc_id: r.text for r in frames["quality"].collect()})
    assert sorted(ids["near_dedup"]) == sorted(set(classes.values()))
    taken = {r.doc_id: r.taken for r in take_counts(frames["near_dedup"], weights=weight_table(spark, WEIGHTS)).collect()}
    assert sorted(ids["mixing"]) == sorted(i for i, n in taken.items() for _ in range(n))
    assert sorted(ids["packing"]) == sorted(ids["mixing"])
    for f in frames.values():
        f.unpersist()


def test_stages_survive_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, FOLDER)
            assert out.count() <= 12
            if name != "packing":
                assert out.columns == docs.columns
