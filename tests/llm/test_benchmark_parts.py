"""A benchmark in many parts finds what one part finds."""

from scoreloom.llm import decontaminate


def _found(df):
    return sorted((r["doc_id"], r[-1]) for r in df.select("doc_id", df.columns[-1]).collect())


def test_parts_by_number_and_by_bytes(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").count()
    whole = _found(decontaminate.search_benchmark(docs, benchmark))
    assert any(f for _, f in whole)
    monkeypatch.setattr(decontaminate, "PART", -(-items // 6))
    monkeypatch.setattr(decontaminate, "CHAIN", 2)
    assert len(list(decontaminate._parts(benchmark))) == 6
    assert [(i, sorted(f)) for i, f in _found(decontaminate.search_benchmark(docs, benchmark))] == [(i, sorted(f)) for i, f in whole]
    monkeypatch.setattr(decontaminate, "PART", 2_000)
    size = sum(len(r["text"].encode()) for r in benchmark.collect() if r["text"] is not None and r["item_id"] is not None)
    monkeypatch.setattr(decontaminate, "PART_BYTES", -(-size // 3))
    assert len(list(decontaminate._parts(benchmark))) == 3
    assert [(i, sorted(f)) for i, f in _found(decontaminate.search_benchmark(docs, benchmark))] == [(i, sorted(f)) for i, f in whole]


def test_clashing_names_are_kept(spark, small):
    docs = spark.createDataFrame([(1, "text", "a", "b")], "doc_id long, text string, Found string, _found string")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    out = decontaminate.search_benchmark(docs, benchmark)
    assert out.columns == [*docs.columns, "__found"] and tuple(out.first()) == (1, "text", "a", "b", [])
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and tuple(kept.first()) == (1, "text", "a", "b")


def test_empty_benchmark(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert list(decontaminate._parts(nothing)) == []
