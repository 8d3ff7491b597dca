"""Cases that an operator once left out."""

from stratacast.llm.near_duplicates import _cells
from stratacast.llm.secrets import redacted, scan_secrets


def test_largest_component_of_a_table_is_the_same_however_rows_arrive(spark):
    # 40 tables of 8 unlinked classes each: all components count 1 there
    rows = [(100 * table + at, 5, [table], b"s") for table in range(40) for at in range(8)]
    labels = spark.createDataFrame([], "node long, label long")
    for arrival in (rows, rows[::-1]):
        store = spark.createDataFrame(arrival, "class_id long, n_shingles long, small array<long>, sketch binary")
        cells = _cells(store, labels, halves=1, grown_only=False).select("class_id", "outer", "member").collect()
        assert all(r.outer == (r.class_id % 100 != 7) for r in cells if r.member)
        asking = sorted(r.class_id for r in cells if not r.member)
        assert asking == [100 * table + at for table in range(40) for at in range(7)]


def test_long_tokens_are_secrets_too(frame):
    tokens = {number: ("Zx9Kd82mQp" * 20_000)[:number] for number in (19, 20, 128, 129, 4000, 200_000)}
    docs = frame([(number, f"user: alice01 and {token} here") for number, token in tokens.items()]
                 + [(1, f"NAME={tokens[128]} see https://db.example.com/x"), (2, f"{tokens[4000]} alone")])
    spans = {r.doc_id: r.spans for r in scan_secrets(docs).collect()}
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    for number, token in tokens.items():
        if number < 20:
            assert spans[number] == "" and token in clean[number]
        else:
            assert spans[number] == f"login:0:13,random:18:{18 + number}"
            assert clean[number] == "<secret> and <secret> here"
    assert spans[1] == "random:0:133,endpoint:138:162" and clean[1] == "<secret> see <secret>"
    assert spans[2] == "" and clean[2] == f"{tokens[4000]} alone"
