"""The derived tables of one store, built once and shared by every question asked of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.functions.embed import EmbedFn, embed, hash_embed_fn
from colloquy.functions.mentions import mentions_of
from colloquy.operators import graph, lexical, timeline

ATTRS = ["session_id", "ts", "scope", "hidden"]


@dataclass
class Memory:
    """`entries` is one row per turn with everything a view needs; the rest is drawn from it."""

    entries: DataFrame
    analyzer: str = "porter"
    embed_fn: EmbedFn | None = None
    dense_fallback: bool = True
    flags: DataFrame | None = None
    note_sources: DataFrame | None = None
    aliases: DataFrame | None = None
    blocklist: DataFrame | None = None
    #: On disk: the postings clustered by term, and the turns of every key clustered by key.
    index: lexical.Index | None = None
    keys: graph.KeyIndex | None = None
    document_prefix: str = ""
    query_prefix: str = ""
    _kept: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def build(
        turns: DataFrame, *, analyzer: str = "porter", embed_fn: EmbedFn | None = hash_embed_fn, dense_fallback: bool = True,
        flags: DataFrame | None = None, note_sources: DataFrame | None = None, aliases: DataFrame | None = None,
        blocklist: DataFrame | None = None, path: str | None = None, document_prefix: str = "", query_prefix: str = "", searched: bool = True,
    ) -> "Memory":
        """Derive the index. Turns with what was read from them are written under `path` and read back, or else kept in memory; postings
        are always written, under `path` or a new work folder. The prefixes go before every text, or question, that is embedded.

        `flags` holds `id, hidden, superseded_by`; `note_sources` holds `note_id, turn_id`. A store that is not to be `searched` has no index, words or vectors: it
        tells which keys it knows, which is all that reading questions (`recall.profile`) needs.
        """
        seen = runtime.spread_scan(turns, runtime.TEXT_ROWS).withColumn("m", mentions_of("text"))
        if not searched:
            seen = seen.persist(StorageLevel.MEMORY_AND_DISK)
            return Memory(seen, analyzer, None, dense_fallback, flags, note_sources, aliases, blocklist, _kept=[seen])
        entries = lexical.with_words(seen)
        if embed_fn is not None:
            entries = embed(entries, embed_fn, prefix=document_prefix)
        kept: list[DataFrame] = []
        spark = turns.sparkSession
        if path is not None:
            entries.write.mode("overwrite").parquet(f"{path}/entries")
            entries = spark.read.parquet(f"{path}/entries")
        else:
            path = runtime.work_folder(spark, "index")
            entries = entries.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(entries)
        # Postings are many times a text's size: made as they are written, never kept.
        posted = lexical.with_postings(entries.select("id", "text", *lexical.SEEN_BY), analyzer)
        index, keys = lexical.write_index(posted, path, analyzer, size=lexical.text_size(entries)), graph.write_keys(entries, f"{path}/keys")
        return Memory(
            entries, analyzer, embed_fn, dense_fallback, flags, note_sources, aliases, blocklist, index, keys, document_prefix, query_prefix, kept
        )

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(df)
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @property
    def flagged(self) -> DataFrame:
        """Entries with `hidden`. Only entries are read; the flags are few and broadcast when proven small."""
        if self.flags is None:
            return self.entries.withColumn("hidden", F.lit(False))
        marks = runtime.small_side(self.marks())
        return self.entries.join(marks, "id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))

    def marks(self) -> DataFrame | None:
        """`id, hidden` of the hidden turns."""
        return None if self.flags is None else self.flags.where("hidden").select("id", F.lit(True).alias("hidden"))

    def mentions(self, *carry: str, source: DataFrame | None = None) -> DataFrame:
        rows = (self.entries if source is None else source).select(
            F.col("id").alias("turn_id"), *carry, F.explode("m").alias("x")
        ).select("turn_id", *carry, F.col("x.key").alias("entity"), "x.kind", "x.surface", "x.start", "x.end")
        if self.aliases is None and self.blocklist is None:
            return rows
        spark = self.entries.sparkSession
        aliases = self.aliases if self.aliases is not None else spark.createDataFrame([], "alias string, canonical string")
        blocked = self.blocklist if self.blocklist is not None else spark.createDataFrame([], "entity string")
        return graph.apply_entity_rules(rows, aliases, blocked)

    def turns(self) -> DataFrame:
        return self.entries.drop("m", "words", "said", "plain", "vec")

    def stats(self) -> DataFrame:
        if not hasattr(self, "_stats"):
            rows = self.mentions("ts").groupBy("entity").agg(
                F.countDistinct("turn_id").alias("turns"), F.min("kind").alias("kind"), F.min("ts").alias("first_ts"),
                F.max("ts").alias("last_ts"),
            )
            self._stats = self._keep(rows)
        return self._stats

    def edges(self) -> DataFrame:
        if not hasattr(self, "_edges"):
            self._edges = self._keep(graph.edges(self.mentions()))
        return self._edges

    def segments(self) -> DataFrame:
        return timeline.segments(timeline.turn_keys(self.turns(), self.mentions()))
