from groundlake.llm import hmm
from groundlake.llm.common import documents, written

SF = "/root/testdata/sf0.001"


def test_training_makes_four_passes_and_each_gains(spark):
    s = hmm.Settings()
    packs, unigram, _ = hmm._encoded(documents(spark, SF), s, written)
    _, seen = hmm.train(packs.filter("not held_out"), unigram, s)
    assert len(seen) == 4 and all(a < b for a, b in zip(seen, seen[1:])), seen
    print("likelihoods", seen)
