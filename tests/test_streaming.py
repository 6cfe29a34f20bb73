from factloom.sources.store import Store
from factloom.streaming.changes import CHANGES, follow


def test_a_stream_of_changes(spark, tmp_path):
    source = tmp_path / "in"

    def send(rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(str(source))
        follow(spark, str(source), tmp_path / "ws", "c", str(tmp_path / "offsets"), applications=("selection-context",)).awaitTermination()

    def names():
        return {r.fqn for r in Store(spark, tmp_path / "ws", "c").table("symbols").collect()}

    send([(1, "a.kt", "fun a() { b() }\n"), (2, "b.kt", "fun b() {}\n"), (3, "c.kt", "fun old() {}\n"), (4, "c.kt", "fun c() {}\n")])
    assert names() == {"a", "b", "c"}
    assert [r.symbol_fqn for r in Store(spark, tmp_path / "ws", "c").table("refs").collect()] == ["b"]
    send([(5, "c.kt", None), (6, "a.kt", "@Composable\nfun a2() { b() }\n")])
    store = Store(spark, tmp_path / "ws", "c")
    assert names() == {"a2", "b"} and store.manifest().source_file_count == 2
    assert [r.callee for r in store.table("sites").collect()] == ["b"]
