"""JSON-line requests as a stream: one engine, replies as JSON lines."""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.engine import Engine
from loomgraph.sources.files import parse_requests


def latest_wins(requests: DataFrame) -> DataFrame:
    """requests (userKey, type, seq, ...) without those adjusts of a user that another adjust of the same user follows
    at once: of a run of slider moves the last counts."""
    w = Window.partitionBy("userKey").orderBy("seq")
    later = F.lead("type").over(w)
    return requests.withColumn("next_", later).where(~((F.col("type") == "adjust") & F.coalesce(F.col("next_") == "adjust", F.lit(False)))).drop("next_")


def serve(spark: SparkSession, engine: Engine, source: str, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answers the lines of files that appear in source; replies are written below sink, by batch. A line that can't be
    read is answered with an error."""

    def answer(batch: DataFrame, number: int) -> None:
        rows = parse_requests(batch.withColumn("seq", F.monotonically_increasing_id()))
        bad = rows.where("NOT ok").withColumn("userKey", F.coalesce("userKey", F.lit("")))
        good = latest_wins(rows.where("ok"))
        replies = []
        for r in good.unionByName(bad).orderBy("seq").toLocalIterator():  # requests of people, one engine call each
            request = {"type": r["type"], "userKey": r["userKey"], "queries": [q.asDict() for q in r["queries"] or []], "c": r["c"]}
            replies.append((r["seq"], json.dumps(engine.respond(request), ensure_ascii=False)))
        spark.createDataFrame(replies, "seq long, value string").orderBy("seq").select("value").write.mode("overwrite").text(f"{sink}/batch={number}")

    stream = spark.readStream.text(source).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
