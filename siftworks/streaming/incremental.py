"""Incremental loads behind a high-water id, batches that become current at once, and message routing, with Structured Streaming."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftworks.functions.formats import snapshot_payload
from siftworks.operators.cleaning import clean_entries, entry_key, record_to_row
from siftworks.operators.loading import ROW_SCHEMA, dedupe_first, first_of_key, insert_new
from siftworks.shared import exists

PAGE_CAP = 50
MAX_MESSAGE_BYTES = 64 * 1024


def bounded_read(entries: DataFrame, watermark: int | None, cap: int = PAGE_CAP) -> tuple[DataFrame, DataFrame]:
    """Entries (page_no, result_id, ...) above the mark from pages in order, up to and with the first page with a known id.

    The second table has one row: stopped (a known id was met), pages read, resume_page (null if stopped or at the end).
    """
    known = F.lit(False) if watermark is None else F.col("result_id") <= watermark
    edge = entries.agg(F.min(F.when(known, F.col("page_no"))).alias("stop"), F.max("page_no").alias("last"))
    last_read = F.least("stop", F.lit(cap), "last")
    state = edge.select(
        (F.col("stop") <= cap).eqNullSafe(True).alias("stopped"),
        F.coalesce(last_read, F.lit(0)).alias("pages_read"),
        F.when(~(F.col("stop") <= cap).eqNullSafe(True) & (F.col("last") > cap), F.lit(cap + 1)).alias("resume_page"),
    )
    fresh = entries.join(F.broadcast(state.select("pages_read")), F.col("page_no") <= F.col("pages_read")).drop("pages_read").filter(~known)
    return dedupe_first(fresh, "result_id", "page_no"), state


def resume_ranges(entries: DataFrame, pending: DataFrame, budget: int, watermark: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What pending positions (position, first: page) give in saved order within one budget of pages, and the positions left over (position, first).

    A position is read from its page on, up to and with the first page that has a known id: one that is not above the mark, or that an earlier
    position has read in this run; without one, to the last page. What the budget doesn't reach is left over, from the page that it stopped at.
    The positions that earlier runs have saved are few; they are gathered in one row. Of an id on several pages the one read first counts.
    """
    known = F.lit(False) if watermark is None else F.col("result_id") <= watermark
    edges = entries.groupBy("page_no").agg(F.max(known).alias("known"))
    few = F.broadcast(pending.select("position", "first"))
    stops = few.join(edges, F.col("page_no") >= F.col("first"), "left").groupBy("position", "first")
    stops = stops.agg(F.min(F.when(F.col("known"), F.col("page_no"))).alias("stop"), F.max("page_no").alias("last"))
    ranges = stops.agg(F.sort_array(F.collect_list(F.struct("position", "first", "stop", "last"))).alias("ranges"))

    read = "array<struct<position:int,first:int,upto:int>>"
    start = F.struct(F.lit(budget).alias("left"), F.array().cast(read).alias("read"), F.array().cast("array<struct<position:int,first:int>>").alias("rest"))

    def step(acc, r):
        met = F.array_min(F.transform(F.filter(acc["read"], lambda x: x["upto"] >= r["first"]), lambda x: F.greatest(x["first"], r["first"])))
        end = F.coalesce(F.least(r["stop"], met, r["last"]), r["first"])  # a page that is not there takes a request, too
        upto = F.least(end, r["first"] + acc["left"] - 1)
        one = F.array(F.struct(r["position"].cast("int").alias("position"), r["first"].cast("int").alias("first"), upto.cast("int").alias("upto")))
        rest = F.array(F.struct(r["position"].cast("int").alias("position"), (upto + 1).cast("int").alias("first")))
        return F.struct(
            (acc["left"] - (upto - r["first"] + 1)).cast("int").alias("left"),
            F.when(acc["left"] > 0, F.concat(acc["read"], one)).otherwise(acc["read"]).alias("read"),
            F.when(upto < end, F.concat(acc["rest"], rest)).otherwise(acc["rest"]).alias("rest"),
        )

    done = ranges.select(F.aggregate("ranges", start, step).alias("d"))
    pages = done.select(F.inline("d.read"))
    hit = F.broadcast(pages.select(F.col("position").alias("_position"), F.col("first").alias("_from"), F.col("upto").alias("_upto")))
    fresh = entries.filter(~known).join(hit, F.col("page_no").between(F.col("_from"), F.col("_upto")))
    fresh = fresh.withColumn("_turn", F.struct("_position", "page_no")).drop("_position", "_from", "_upto")
    return dedupe_first(fresh, "result_id", "_turn").drop("_turn"), done.select(F.inline("d.rest"))


STATE = "batch string, seq long, inserted long, last_seen long, payload string, computed_at timestamp, payload_seq long"


@dataclass
class BatchStore:
    """A table of applicants that grows by batches, each in a partition of its own that is written once and never again touched.

    A batch becomes part of the table with its row in the state, which is written last and holds the mark and the snapshot, too: rows, mark and
    snapshot change together. A batch that is tried again overwrites its own partition; one that has its row in the state is left alone.
    """

    spark: SparkSession
    root: str

    def states(self) -> DataFrame:
        """One row per batch."""
        path = f"{self.root}/state"
        return self.spark.read.schema(STATE).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], STATE)

    def state(self) -> Row | None:
        """The newest row."""
        rows = self.states().orderBy(F.desc("seq")).limit(1).collect()
        return rows[0] if rows else None

    def rows(self) -> DataFrame:
        """The rows of all batches that have their row in the state."""
        path = f"{self.root}/applicants"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], ROW_SCHEMA)
        return self.spark.read.schema(f"{ROW_SCHEMA}, batch string").parquet(path).join(self.states().select("batch"), "batch", "left_semi").drop("batch")

    def watermark(self) -> int | None:
        state = self.state()
        return state and state["last_seen"]

    def _put(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/{name}")

    def commit(self, batch: str, rows: DataFrame, last_seen: int | None, refresh: bool | None = None) -> None:
        """Add ``rows`` as ``batch``. The snapshot is computed again if there are new rows or if there is none yet (``refresh``: always, or never)."""
        before = self.state()
        self._put("applicants", rows.withColumn("batch", F.lit(batch)))
        path = f"{self.root}/applicants/batch={batch}"
        added = self.spark.read.schema(ROW_SCHEMA).parquet(path) if exists(self.spark, path) else None
        inserted = added.count() if added is not None else 0
        seq = before["seq"] + 1 if before else 0
        kept = (before["payload"], before["payload_seq"]) if before else (None, None)
        if refresh or refresh is None and (inserted > 0 or kept[0] is None):
            whole = self.rows() if added is None else self.rows().unionByName(added)
            state = snapshot_payload(whole).withColumn("payload_seq", F.lit(seq).cast("long"))
        else:
            state = self.spark.createDataFrame([kept], "payload string, payload_seq long")
        values = {"batch": F.lit(batch), "seq": F.lit(seq).cast("long"), "inserted": F.lit(inserted).cast("long"), "last_seen": F.lit(last_seen).cast("long"), "computed_at": F.current_timestamp()}
        self._put("state", state.withColumns(values).coalesce(1))


def apply_batch(store: BatchStore, entries: DataFrame, batch: str, since: int | None = None, arrival: str = "arrival") -> None:
    """One micro-batch of raw entries: those above the mark, the first of each id by ``arrival``, those not stored yet, cleaned, added with mark and snapshot.

    Without a mark the newest stored id takes its place. ``since`` reads from there instead; by itself it moves no mark. A batch that is in the
    store already changes nothing.
    """
    if not store.states().filter(F.col("batch") == batch).isEmpty():
        return
    stored, mark = store.rows(), store.watermark()
    if mark is None:
        mark = stored.agg(F.max("p_id")).first()[0]
    start = mark if since is None else since
    # cleaned last: what is old or stored costs no cleaning, and rows dealt by id keep all cores busy, whatever the files' order
    keyed = entries.withColumn("p_id", entry_key())
    fresh = keyed.filter("p_id is not null") if start is None else keyed.filter(F.col("p_id") > start)
    # greatest passes over nulls: the mark never falls, and there is none without data
    last_seen = fresh.agg(F.greatest(F.max("p_id").cast("long"), F.lit(mark).cast("long")).alias("last_seen")).first()["last_seen"]
    new = insert_new(stored, first_of_key(fresh, "p_id", arrival)).drop("p_id", arrival)
    store.commit(batch, record_to_row(clean_entries(new)), last_seen)


def incremental_pull(spark: SparkSession, source: str, schema, root: str, checkpoint: str) -> BatchStore:
    """Read the new Parquet files of raw entries below ``source`` as a stream, all that are there as one batch, until there are no more."""
    store = BatchStore(spark, root)
    # of one id the first row of the oldest file counts
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    stream = spark.readStream.schema(schema).parquet(source).select("*", arrival.alias("arrival"))

    def one(entries: DataFrame, number: int) -> None:
        # numbers start again with a new checkpoint, whose stream has another id
        own = entries.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        apply_batch(store, entries, f"{own}-{number:09d}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def refresh_snapshot(store: BatchStore, force: bool = False) -> bool:
    """Compute the stored snapshot again if no batch with rows is part of it yet, or on ``force``; whether it was computed.

    The staleness key is the number of the state that the snapshot was computed in: it is current if no later one inserted rows.
    """
    before = store.state()
    current = before is not None and before["payload"] is not None
    if current and not force and store.states().filter((F.col("seq") > before["payload_seq"]) & (F.col("inserted") > 0)).isEmpty():
        return False
    store.commit(f"refresh-{uuid.uuid4().hex}", store.spark.createDataFrame([], ROW_SCHEMA), before and before["last_seen"], refresh=True)
    return True


def snapshot_status(store: BatchStore) -> DataFrame:
    """(computed_at, total_entries, newest_entry, n_answers) of the stored snapshot, read from its payload by path; no row without one."""
    payload = F.try_parse_json("payload")
    read = lambda path, kind: F.try_variant_get(payload, path, kind)
    newest = store.states().filter("payload is not null").orderBy(F.desc("seq")).limit(1)
    return newest.select(
        "computed_at", read("$.summary.total_entries", "bigint").alias("total_entries"), read("$.summary.newest_entry", "date").alias("newest_entry"),
        F.size(read("$.answers", "array<variant>")).alias("n_answers"),
    )


# Kinds of messages, and the payload fields that each may have.
FIELDS = {"scrape_new_data": ("since",), "recompute_analytics": ()}


def route_messages(messages: DataFrame, fields: dict[str, tuple[str, ...] | None] = FIELDS, column: str = "body") -> DataFrame:
    """``messages`` with kind and reject_reason (null: good). Works on streams and tables.

    A payload may have the fields that ``fields`` names for its kind (None: any), must be an object if there is one, and its ``since`` must be
    a whole JSON number of 32 bits, not negative, or null.
    """
    body = F.col(column)
    whole = F.try_parse_json(body)
    part = lambda path, kind: F.try_variant_get(whole, path, kind)
    type_of = lambda path: F.schema_of_variant(part(path, "variant"))
    kind = F.when(type_of("$.kind") == "STRING", part("$.kind", "string"))
    payload = type_of("$.payload")
    since = type_of("$.payload.since")
    extra = F.lit(False)
    for name, allowed in fields.items():
        if allowed is not None:
            keys = F.map_keys(part("$.payload", "map<string, variant>"))
            extra = extra | ((kind == name) & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)).cast("array<string>"))) > 0))
    reason = (
        F.when(body.isNull() | (F.octet_length(body) > MAX_MESSAGE_BYTES), "size")
        .when(whole.isNull(), "not json")
        .when(~F.schema_of_variant(whole).startswith("OBJECT"), "not an object")
        .when(kind.isNull() | ~kind.isin(*fields), "unknown kind")
        .when(~payload.startswith("OBJECT") & (payload != "VOID"), "payload")
        .when(F.coalesce(extra, F.lit(False)), "unknown field")
        .when((since != "VOID") & ((since != "BIGINT") | ~F.coalesce(part("$.payload.since", "bigint").between(0, 2**31 - 1), F.lit(False))), "since")
    )
    return messages.withColumns({"kind": kind, "reject_reason": reason})
