import duckdb

from merchantscope.llm import decontaminate
from merchantscope.llm.queries import oracle_sql, queries


def test_items_without_id_count_as_passages(spark, docs_of, tmp_path):
    """Words of their windows are hit and the document is dropped; they are no item of the list."""
    passage = " ".join(f"word{i}" for i in range(14))
    docs = docs_of([(1, f"start {passage} end"), (2, f"other {passage} with one two three"), (3, "nothing here"), (4, "one two three")])
    items = spark.createDataFrame([(None, passage), (None, passage), (7, "one two three"), (None, None)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries()["op6_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert {i: (r.n_hit, r.n_items, r.contaminated) for i, r in got.items()} == {
        1: (14, 0, True), 2: (17, 1, True), 3: (0, 0, False), 4: (3, 1, True)
    }
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for r in con.execute(oracle_sql()["op6_benchmark_decontamination"]).df().itertuples():
        mine = got[r.doc_id]
        assert (mine.n_words, mine.n_hit, mine.items_sha256, mine.contaminated) == (r.n_words, r.n_hit, r.items_sha256, r.contaminated)
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [3]


def test_a_passage_in_many_items(spark, docs_of):
    """Every item of a hot passage is listed; the windows that reach the driver do not grow with the items."""
    passage = " ".join(f"word{i}" for i in range(12))
    named = [(i, f"{passage} own{i}") for i in range(500)] + [(None, passage)] * 500 + [(i, f"{passage} own{i}") for i in range(500)]
    items = spark.createDataFrame(named, "item_id long, text string").repartition(4)
    distinct, members = decontaminate.window_sets(decontaminate.item_windows(items, 10))
    assert distinct.count() == 3 + 500 and members.count() == 500 + 500
    docs = docs_of([(1, passage), (1, passage), (None, f"{passage} own7"), (2, passage.replace("word5", "other")), (3, None)])
    for block_windows in (200_000, 100):
        got = decontaminate.benchmark_hits(docs, items, keep=["doc_id"], block_windows=block_windows).collect()
        every = sorted(str(i) for i in range(500))
        rows = sorted((str(r.row.doc_id), r.res.starts, r.res.ends, r.res["items"]) for r in got)
        assert rows == [("1", [0], [12], every), ("1", [0], [12], every), ("2", [], [], []), ("3", [], [], []), ("None", [0], [13], every)]
