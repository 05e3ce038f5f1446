"""Headline timings. Prints one JSON line.

`BENCH_SF_DIR` (default sf0.1) and `BENCH_CPUS` (default 8) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from colloquy.curation import finders
from colloquy.functions.mentions import extract_mentions
from colloquy.operators import graph, ingest, sessions, timeline, vectors
from colloquy.plans.memory import Memory
from colloquy.plans.recall import recall
from colloquy.runtime import local_session, spread_scan
from colloquy.sources import adapters

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def questions(spark, sf, n: int):
    """The benchmark passages, then turns of conversations spread by hash, all asked whole."""
    own = adapters.benchmark_queries(spark, sf)
    said = adapters.conversation_turns(spark, sf).where(F.length("text") > 0)
    turns = said.orderBy(F.xxhash64("uuid")).limit(n).select(F.concat(F.lit("t"), "uuid").alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query"))
    return own.unionByName(turns).limit(n)


def done(df) -> int:
    """Run a plan to its end without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()
    return 1


def main() -> None:
    spark = local_session(CPUS, "bench", **{"spark.sql.shuffle.partitions": CPUS})
    took: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        out = run()
        took[name] = round(time.time() - start, 3)
        return out

    spark.range(10).select(F.sum("id")).collect()
    talk, docs = adapters.conversation_turns(spark, SF), adapters.document_turns(spark, SF)
    n_talk, n_docs = talk.count(), docs.count()

    inputs = talk.select("id", "session_id", "speaker", "text", "ts", F.lit(None).cast("string").alias("uuid"), "scope").withColumnRenamed("id", "seq")

    def whole_ingest():
        stored = ingest.ingest(spread_scan(inputs), None, 0, first_id=1).turns.persist()
        found = extract_mentions(spread_scan(stored)).persist()
        done(graph.entity_stats(found, stored))
        done(graph.edges(found))
        done(timeline.segments(timeline.turn_keys(stored, found)))

    timed("ingest_conversations", whole_ingest)
    timed("session_summaries", lambda: done(sessions.session_summaries(talk)))
    timed("growth", lambda: done(sessions.growth(talk)))
    timed("segments_events", lambda: done(timeline.segments(adapters.event_turns(spark, SF))))
    timed("edges_orders", lambda: done(graph.edges(adapters.table(spark, SF, "lineitem"), "l_orderkey", "l_suppkey")))
    timed("exact_duplicates", lambda: done(finders.exact_duplicates(spread_scan(docs), docs.limit(0).select(F.col("id").alias("turn_id")), cutoff=10**15)))
    vecs = adapters.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    timed("knn_all", lambda: done(vectors.knn(vecs, vecs.select(F.col("id").cast("string").alias("query_id"), "vec"), 10)))
    timed("near_duplicates", lambda: done(vectors.near_duplicates(vecs)))

    def index(turns):
        memory = Memory.build(turns)
        memory.entries.count()
        memory.stats().count()
        memory.edges().count()
        return memory

    store = timed("index_conversations", lambda: index(talk))
    timed("recall_100_conversations", lambda: done(recall(store, questions(spark, SF, 100)).evidence))
    timed("recall_1000_conversations", lambda: done(recall(store, questions(spark, SF, 1000)).evidence))
    store.close()
    store = timed("index_documents", lambda: index(docs))
    timed("recall_100_documents", lambda: done(recall(store, questions(spark, SF, 100)).evidence))
    timed("recall_1000_documents", lambda: done(recall(store, questions(spark, SF, 1000)).evidence))

    rates = {
        "ingest_turns_per_sec": round(n_talk / took["ingest_conversations"], 1),
        "recall_queries_per_sec_conversations": round(1000 / took["recall_1000_conversations"], 1),
        "recall_queries_per_sec_documents": round(1000 / took["recall_1000_documents"], 1),
        "turns": n_talk, "documents": n_docs,
    }
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": SF.rsplit("sf", 1)[-1], "rates": rates,
    }))


if __name__ == "__main__":
    sys.exit(main())
