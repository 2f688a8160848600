from collections import Counter

from tillframe.llm import toxicity


def test_document_frequencies_are_counted_in_the_tasks(spark):
    """A row for each term and task, where every occurrence was a row of its own."""
    rows = [([i % 3, 3 + i % 2],) for i in range(600)] + [([],), ([4],)]
    measured = spark.createDataFrame(rows, "terms array<int>").repartition(5)
    found = toxicity.document_frequencies(measured, 6)
    wanted = Counter(t for (terms,) in rows for t in terms)
    assert found.tolist() == [wanted[t] for t in range(6)]


def test_no_row_for_each_occurrence(spark, monkeypatch):
    frame = type(spark.range(0))
    exploded = []
    select = frame.select
    monkeypatch.setattr(frame, "select", lambda self, *c: exploded.append(any("explode" in str(x) for x in c)) or select(self, *c))
    toxicity.document_frequencies(spark.createDataFrame([([0, 1],)], "terms array<int>"), 2)
    assert not any(exploded)
