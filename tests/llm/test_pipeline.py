import hashlib

import public_tokenizers
from test_neardup import brute_components
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from groundlake.llm import decontaminate, quality, toxicity
from groundlake.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    clean = docs.filter(~docs.doc_id.isin(list(toxic) or [-1]))
    good = {r.doc_id for r in quality.rate(clean).filter("quality.kept").select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    first = {d for _, d in brute_components(rows)}
    rows = [r for r in rows if r[0] in first]
    patterns = decontaminate.Patterns([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 100, 0.08)
    rows = [(d, t) for d, t in rows if not patterns.of(decontaminate.normal(t))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for d, t in rows}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, none):
    want = ["toxicity", "quality", "near_dedup", "decontamination", "bpe"]
    assert [name for name, _ in corpus_pipeline.STAGES] == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns and kept.count() <= odd.count(), name
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
