from quillrank.functions.weights import Okapi
from quillrank.operators.index import build_index
from quillrank.operators.ranking import batch_top_n, prepared_table
from quillrank.streaming.queries import answers


def test_stream_equals_batch(spark, tmp_path):
    tokens = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"]), (2, ["d"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(0, ["a", "b"]), (1, ["d", "d"]), (2, ["x"])], "query_id long, tokens array<string>")
    asked.write.parquet(str(tmp_path / "in"))
    index, variant = build_index(tokens), Okapi()
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    run = answers(index, variant, stream, str(tmp_path / "out"), 2).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "doc_id", "score").collect()
    terms = asked.selectExpr("query_id", "posexplode(tokens) as (pos, term)")
    want = batch_top_n(index, variant, prepared_table(index, variant, terms), 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) != []
