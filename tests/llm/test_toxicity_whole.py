"""Training sees the whole of a long text, and a bounded number of rows."""

import numpy as np

from framemill.llm import toxicity

CLEAN = "quiet river stone meadow " * 5000  # 125,000 characters


def test_passage_after_a_long_beginning(spark):
    rows = [(i, CLEAN + ("vile scum" if i % 2 else "fine day"), float(i % 2)) for i in range(60)]
    w = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label double"))
    probe = spark.createDataFrame([(0, "vile scum"), (1, "fine day")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(probe, w, keep=("doc_id",)).collect()}
    assert s[0] > s[1]


def test_sample(spark):
    rows = [(i // 5 if i < 40 else None, f"word{i} other", float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    every, one = toxicity.train(df, max_train=50), toxicity.train(df.repartition(3), max_train=1000)
    assert np.array_equal(every, one) and toxicity.train(df, max_train=12).any()
