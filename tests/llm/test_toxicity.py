"""Multiple-instance learning: scores, held-out accuracy, offending sentences."""

import random

from penmark.llm import toxicity


def test_labels_of_documents_find_sentences(spark):
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs, labels = [], []
    for d in range(600):
        lines = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(rng.randint(1, 6))]
        toxic = int(d % 5 == 0)
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] = lines[at][:-1] + " " + rng.choice(["scumbag", "Scumbags", "idiotic"]) + "!"
        docs.append((d, "\n".join(lines), 0.5))
        labels.append((d, toxic))
    docs += [(1000, "", 0.5), (1001, None, 0.5), (1002, " ... ", 0.5), (None, "scumbag", 0.5)]
    labels += [(2, None), (None, 1), (77777, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    rows = toxicity.scored(frame, model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() == {"doc_id", "text", "score", "held"}
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 1000]
    right = sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert all(r.score == 0 for r in rows if r.doc_id in (1000, 1001, 1002))
    found = toxicity.offending_sentences(frame, model).collect()
    assert found and all("scum" in r.text.lower() or "idiot" in r.text for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).first().score < 1e-9
    assert toxicity.scored(docs.limit(0), model).count() == 0
