"""The mixture's classifier learns from labelled documents that exist, with all telling tokens."""

from tripleweave.llm import mixing
from tripleweave.llm.ship import ship


def test_labels_without_documents_use_up_nothing(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(mixing, "SAMPLE", 40)
    rows = [(i, f"{'bad' if i % 2 else 'good'} word") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), i % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    assert {r.token for r in mixing.classifier(docs, labels).collect()} == {"good", "bad", mixing.ALWAYS}


def test_all_telling_tokens_are_kept(spark):
    ship(spark)
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(600))) for i in range(40)]
    docs = spark.createDataFrame([(i, t.replace("good", "g").replace("bad", "b")) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert mixing.classifier(docs, labels).count() == 1201
