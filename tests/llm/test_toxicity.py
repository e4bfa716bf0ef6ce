"""Where the classifier is trained."""

import numpy as np

from sigweave.llm import toxicity


def test_the_sample_does_not_pass_through_the_driver(spark, monkeypatch):
    texts = [f"you nasty horrid insult number {i}" if i % 3 == 0 else f"a quiet river by the stone market {i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    train, here = toxicity.train, []
    monkeypatch.setattr(toxicity, "train", lambda bags, *rest: here.append(len(bags)) or train(bags, *rest))
    odds, bias = toxicity.fit(docs, labels)
    assert not here
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, odds, bias).collect()}
    assert min(scores[i] for i in range(0, 120, 3)) > 0.5 > max(scores[i] for i in range(120) if i % 3)
    one = labels.where("toxic = 0")
    assert not np.any(toxicity.fit(docs, one)[0]) and not np.any(toxicity.fit(docs.limit(0), labels)[0])
