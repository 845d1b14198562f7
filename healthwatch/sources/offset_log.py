"""An offset-addressed event log as a Spark data source (batch and stream).

A log is a folder of partitions.  ``append`` sorts new rows by event order
inside each partition and adds them as parquet segments; every row has its
partition and a consecutive offset.  A manifest per append names the segments
with their offset ranges, so a reader opens only the files it needs:

* batch: ``read_log(n=50)`` starts each partition at ``max(low, high - n)``;
  ``read_log(group="g")`` starts at the group's committed offsets;
* stream: ``stream_log(group="g")`` reads from the committed offsets, the
  beginning or the end; Spark's checkpoint holds the offsets of a running
  query and finished batches are committed for the group;
* lag: ``group_offsets`` lists committed offset and high watermark per
  partition, the input of ``telemetry.consumer_lag``.

The folder must be shared storage; it is reached through Arrow's file systems,
so a local path, ``file://``, HDFS and object stores work alike.  One writer
appends at a time (a second one fails on the manifest's name and adds
nothing)."""

from __future__ import annotations

import json
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "offset_log"
#: Rows of one segment file, at most.
SEGMENT_ROWS = 1_000_000
#: Rows of a segment that are decoded together.
BATCH_ROWS = 16_384


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or os.path.isabs(path) else os.path.abspath(path))


def _children(path: str) -> list[str]:
    from pyarrow import fs
    store, base = _store(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.path.endswith(".json"))


def _load(path: str, name: str) -> list[dict]:
    store, _ = _store(path)
    found = []
    for f in _children(os.path.join(path, name)):
        with store.open_input_stream(f) as s:
            found.append(json.loads(s.read()))
    return found


def _save(path: str, name: str, value: dict, new: bool = False) -> None:
    """Write a small file under another name and move it, so no reader sees
    half of it; with ``new`` an existing file is an error."""
    from pyarrow import fs
    store, base = _store(path)
    target = os.path.join(base, name)
    store.create_dir(os.path.dirname(target), recursive=True)
    if new and store.get_file_info(target).type != fs.FileType.NotFound:
        raise RuntimeError(f"another writer appended {name}")
    draft = f"{target}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as s:
        s.write(json.dumps(value).encode())
    store.move(draft, target)


def segments(path: str) -> list[dict]:
    """All segments: partition, start, count, file."""
    return [s for m in _load(path, "manifests") for s in m["segments"]]


def high_watermarks(path: str) -> dict[int, int]:
    """The next offset of each partition."""
    high = {p: 0 for p in range(_settings(path)["partitions"])}
    for s in segments(path):
        high[s["partition"]] = max(high[s["partition"]], s["start"] + s["count"])
    return high


def _settings(path: str) -> dict:
    found = _load(path, "settings")
    if not found:
        raise FileNotFoundError(f"{path} holds no log")
    return found[0]


def committed(path: str, group: str) -> dict[int, int]:
    """The group's committed offsets; partitions without one are left out."""
    return {int(p): o for g in _load(path, f"groups/{group}") for p, o in g.items()}


def commit(path: str, group: str, offsets: dict[int, int]) -> None:
    _save(path, f"groups/{group}/offsets.json", {str(p): o for p, o in offsets.items()})


def create(spark: SparkSession, path: str, schema: T.StructType, partitions: int = 4) -> None:
    """Start an empty log for rows of ``schema``."""
    _save(path, "settings/log.json", {"partitions": partitions, "schema": schema.json()}, new=True)


def append(df: DataFrame, path: str, key: str, order: list[str], segment_rows: int = SEGMENT_ROWS) -> dict[int, int]:
    """Add the rows of ``df``; returns the new high watermarks.

    A row's partition is a hash of its key.  The rows are range-partitioned by
    (partition, order), so a partition that holds most rows is spread over
    many tasks; each task writes sorted segments, whose row counts then give
    the offsets."""
    settings = _settings(path)
    schema = T.StructType.fromJson(json.loads(settings["schema"]))
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(settings["partitions"])).cast("int")
    placed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], part.alias("__partition"))
    name = uuid.uuid4().hex
    folder = os.path.join(path, "data", name)
    # rows range over the order within each partition, so file numbers rise with it
    (placed.repartitionByRange("__partition", *order).sortWithinPartitions("__partition", *order)
     .write.option("maxRecordsPerFile", segment_rows).partitionBy("__partition").parquet(folder))
    spark = df.sparkSession
    counts = (spark.read.parquet(folder).groupBy("__partition", F.input_file_name().alias("file"))
              .agg(F.count(F.lit(1)).alias("n")).collect())      # one row per segment file
    high, made = high_watermarks(path), []
    for r in sorted(counts, key=lambda r: (r["__partition"], os.path.basename(r["file"]))):
        p = r["__partition"]
        made.append({"partition": p, "start": high[p], "count": r["n"], "file": os.path.join("data", name, f"__partition={p}", os.path.basename(r["file"]))})
        high[p] += r["n"]
    _save(path, f"manifests/{len(_children(os.path.join(path, 'manifests'))):010d}.json", {"segments": made}, new=True)
    return high


def follow(source: str, target: str, upto: int | None = None) -> dict[int, int]:
    """Publish the next append of the log ``source`` (or all up to append
    number ``upto``) in the log ``target``, which names the same segment
    files: a replay at its own pace without a copy of the data.  Returns the
    target's high watermarks."""
    if not _load(target, "settings"):
        _save(target, "settings/log.json", _settings(source), new=True)
    have, all_ = len(_children(os.path.join(target, "manifests"))), _load(source, "manifests")
    for k in range(have, min(len(all_), have + 1 if upto is None else upto)):
        made = [s | {"file": os.path.join(source, s["file"])} for s in all_[k]["segments"]]
        _save(target, f"manifests/{k:010d}.json", {"segments": made}, new=True)
    return high_watermarks(target)


class Segment(InputPartition):
    """Rows [begin, end) of one segment file."""

    def __init__(self, file: str, partition: int, start: int, begin: int, end: int):
        self.file, self.partition, self.start, self.begin, self.end = file, partition, start, begin, end


def plan(path: str, begin: dict[int, int], end: dict[int, int]) -> list[Segment]:
    """The parts of segments that hold the offsets [begin, end)."""
    out = []
    for s in segments(path):
        lo = max(s["start"], begin.get(s["partition"], 0))
        hi = min(s["start"] + s["count"], end.get(s["partition"], 0))
        if lo < hi:
            out.append(Segment(os.path.join(path, s["file"]), s["partition"], s["start"], lo - s["start"], hi - s["start"]))
    return out


def read_segment(part: Segment, schema: T.StructType):
    """Arrow batches of one segment part, cast to the log's schema."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema
    store, file = _store(part.file)
    wanted = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]
    seen = 0
    with store.open_input_file(file) as source:
        for b in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=[n for n in names if n not in ("partition", "offset")]):
            lo, hi = max(part.begin - seen, 0), min(part.end - seen, b.num_rows)
            if lo < hi:
                rows = pa.Table.from_batches([b.slice(lo, hi - lo)])
                first = part.start + seen + lo
                rows = rows.append_column("partition", pa.array([part.partition] * rows.num_rows, pa.int32()))
                rows = rows.append_column("offset", pa.array(range(first, first + rows.num_rows), pa.int64()))
                yield from rows.select(names).cast(wanted).to_batches()
            seen += b.num_rows
            if seen >= part.end:
                break


class _Options:
    """Where a reader begins: newest ``n`` per partition, a group's commits,
    or the ``earliest`` or ``latest`` offset."""

    def __init__(self, options: dict):
        self.path, self.group, self.n = options["path"], options.get("group"), options.get("n")
        self.limit, self.starting = options.get("limit"), options.get("startingoffsets", options.get("startingOffsets", "earliest"))

    def begin(self, high: dict[int, int]) -> dict[int, int]:
        if self.n is not None:
            return {p: max(0, h - int(self.n)) for p, h in high.items()}
        start = dict(high) if self.starting == "latest" else {p: 0 for p in high}
        return start | (committed(self.path, self.group) if self.group else {})

    def end(self, high: dict[int, int], begin: dict[int, int]) -> dict[int, int]:
        return {p: min(h, begin[p] + int(self.limit)) for p, h in high.items()} if self.limit is not None else high


class _BatchReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, _Options(options)

    def partitions(self):
        high = high_watermarks(self.options.path)
        begin = self.options.begin(high)
        return plan(self.options.path, begin, self.options.end(high, begin)) or [Segment("", 0, 0, 0, 0)]

    def read(self, partition):
        return read_segment(partition, self.schema) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, _Options(options)

    def initialOffset(self):
        return {str(p): o for p, o in self.options.begin(high_watermarks(self.options.path)).items()}

    def latestOffset(self):
        return {str(p): o for p, o in high_watermarks(self.options.path).items()}

    def partitions(self, start, end):
        return plan(self.options.path, {int(p): o for p, o in start.items()}, {int(p): o for p, o in end.items()}) or [Segment("", 0, 0, 0, 0)]

    def read(self, partition):
        return read_segment(partition, self.schema) if partition.file else iter(())

    def commit(self, end):
        if self.options.group:
            commit(self.options.path, self.options.group, {int(p): o for p, o in end.items()})


class OffsetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        own = T.StructType.fromJson(json.loads(_settings(self.options["path"])["schema"]))
        return T.StructType([*own.fields, T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])

    def reader(self, schema):
        return _BatchReader(schema, dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known; its classes travel with the plan, so workers
    need not import this package."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(OffsetLog)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def read_log(spark: SparkSession, path: str, n: int | None = None, group: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with their partition and offset: the newest ``n`` of each
    partition, or those from the group's committed offsets on (at most
    ``limit`` a partition)."""
    register(spark)
    options = {"path": path} | {k: str(v) for k, v in (("n", n), ("group", group), ("limit", limit)) if v is not None}
    return spark.read.format(FORMAT).options(**options).load()


def stream_log(spark: SparkSession, path: str, group: str | None = None, starting: str = "earliest") -> DataFrame:
    """The log as a stream from the group's committed offsets, else from the
    ``earliest`` or ``latest`` one."""
    register(spark)
    options = {"path": path, "startingoffsets": starting} | ({"group": group} if group else {})
    return spark.readStream.format(FORMAT).options(**options).load()


def consume(spark: SparkSession, path: str, group: str, limit: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The next rows of a group and the offsets to ``commit`` once they are
    processed (at least once: rows not committed are read again)."""
    high = high_watermarks(path)
    options = _Options({"path": path, "group": group, "limit": limit})
    begin = options.begin(high)
    return read_log(spark, path, group=group, limit=limit), options.end(high, begin)


def group_offsets(spark: SparkSession, path: str, group: str, topic: str = "log") -> DataFrame:
    """(topic, partition_id, committed, high); committed is -1 where the group
    has none.  One row per partition."""
    done = committed(path, group)
    rows = [(topic, p, done.get(p, -1), h) for p, h in sorted(high_watermarks(path).items())]
    return spark.createDataFrame(rows, "topic string, partition_id int, committed long, high long")
