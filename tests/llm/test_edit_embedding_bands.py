from countspark.llm import edit_embedding


def test_no_link_at_the_threshold_is_lost(spark, monkeypatch):
    first = bytes([1]) * 128
    second, third = bytearray(first), bytearray(first)
    for at in range(0, 125, 5):  # 25 of 128 samples differ, some in each run of eight
        second[at] = 2
    for at in range(0, 128, 4):  # 32 differ from the first
        third[at] = 3
    rows = [(1, first), (2, bytes(second)), (3, bytes(third))]
    found = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    monkeypatch.setattr(edit_embedding, "fingerprints", lambda docs, *_: docs)
    got = {r.doc_id: r.component_id for r in edit_embedding.near_duplicates(found).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
