"""WARC archives of pages, and an index of all captures made by external merging.

Writing: each page becomes one record of WARC/1.1. Of pages with equal payloads of at least REVISIT bytes, that with the
largest id is a response and the others revisit it. Each task sorts its pages by URL key, time and id and writes them as
text files, bounded by records and bytes (CLASSES): a record ends in CR LF CR LF, the last LF being the line end of Spark's text
writer, so archives are written wherever Spark can write and a lost task's files are written again.

Index: each archive file is a run of captures in order. Ranges of (URL key, time, id) are dealt to tasks; a task merges
the pieces of all runs that fall into its range with a loser tree. Rows come out in order of (part, seq) over all.

Null payloads are empty; a null URL has no target line and the key ''; pages without id are written, refer to the group's
response, and read back without id; if no page of a group has an id, all are responses. Rows that repeat a page are
records each, all of the same kind. An empty table makes an empty archive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import cut

REVISIT = 1000
#: Largest payload in bytes, and records a file, by class of size: no file has more than 256 MB and a header a record, but
#: for those of a single record.
CLASSES = ((1 << 18, 1000), (1 << 22, 64), (None, 1))
#: Index rows in a range of the merge, about: what a task holds.
RANGE_ROWS = 200_000
#: Digests of repeated payloads that are broadcast at most; beyond, Spark joins as it sees fit.
BROADCAST = 200_000
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "run string, run_seq long, offset long, length long, page_id long, url string, captured string, "
    "record_type string, payload_digest string, payload_bytes long, refers_to long"
)


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query: `https://a.b.org/x?y#z` is `org,b,a)/x?y`."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[\w+.-]+://([^/?#]*)", 1)), r"^www\.|:\d*$", "")
    rest = F.regexp_extract(url, r"^[\w+.-]+://[^/?#]*([^#]*)", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def captured_at(page_id: Column) -> Column:
    """A time of capture where the table has none: one second after another by id."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.coalesce(page_id, F.lit(0)) % 1_000_000_000)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages with digest, kind of record and the response that a revisit refers to. Payloads aren't shuffled unless more
    than BROADCAST digests repeat."""
    payload = F.coalesce(payload_col, F.lit("")).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    repeated = cut(large.where("n > 1 and response is not null").select("payload_digest", "response"))
    few = repeated.count() <= BROADCAST
    rows = rows.join(F.broadcast(repeated) if few else repeated, "payload_digest", "left")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("response"))}).drop("response")


def record() -> Column:
    """A whole record but for its last line feed."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(2 * EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.format_string("<urn:page:%s>", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(EOL), block, F.lit("\r\n\r"))


def _size_class(payload_bytes: Column) -> Column:
    """The first of CLASSES that the payload fits into."""
    bounds = [limit for limit, _ in CLASSES if limit is not None]
    return sum((F.when(payload_bytes > b, 1).otherwise(0) for b in bounds), F.lit(0))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of pages, each sorted by URL key and time; files are bounded by records and, through CLASSES, by bytes."""
    rows = plan_records(pages, id_col, url_col, payload_col)
    rows = rows.withColumn("captured", captured_at(F.col("page_id"))).withColumn("url_key", url_key(F.col("url")))
    sizes = F.octet_length(F.coalesce(payload_col, F.lit("")).cast("string"))
    found = {r[0] for r in pages.select(_size_class(sizes)).distinct().collect()}  # at most as many as classes
    for n in sorted(found | {0}):
        run = rows.where(_size_class(F.col("payload_bytes")) == n).sortWithinPartitions("url_key", "captured", "page_id")
        run.select(record().alias("value")).write.mode("append" if n else "overwrite").option("maxRecordsPerFile", CLASSES[n][1]).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive file, in order."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it says")
        block = data[start:stop]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {"offset": at, "length": stop + 4 - at, "head": head, "http": http.decode("latin-1"), "payload": payload}
        at = stop + 4


def _number(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in READ_SCHEMA.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for n, r in enumerate(parse(content.as_py())):
                head, payload = r["head"], r["payload"]
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                size = int(r["http"].rpartition("Content-Length: ")[2])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{path}: the payload at byte {r['offset']} isn't what its record says")
                rows.append((path.as_py(), n, r["offset"], r["length"], _number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-date"], kind, digest, size, _number(head.get("warc-refers-to"))))
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, payloads checked against their digests."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], READ_SCHEMA)
    return files.mapInArrow(_read, READ_SCHEMA)


class LoserTree:
    """Merges sorted runs of (key, row) pairs: each inner place keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.n = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.n
        for leaf in range(self.n):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; an ended run comes last."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _play(self, leaf: int) -> None:
        winner, place = leaf, (leaf + self.n) // 2
        while place > 0:
            if self.losers[place] < 0:  # the other side hasn't come yet
                self.losers[place] = winner
                return
            if self._before(self.losers[place], winner):
                winner, self.losers[place] = self.losers[place], winner
            place //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.n and (head := self.heads[top := self.losers[0]]) is not None:
            yield head
            self.heads[top] = next(self.runs[top], None)
            winner, place = top, (top + self.n) // 2
            while place > 0:
                if self._before(self.losers[place], winner):
                    winner, self.losers[place] = self.losers[place], winner
                place //= 2
            self.losers[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    none = -(1 << 63)
    keys = list(zip(rows.column("url_key").to_pylist(), rows.column("captured").to_pylist(), (none if x is None else x for x in rows.column("page_id").to_pylist()), strict=True))
    runs = rows.column("run").to_pylist()
    starts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
    pieces = [iter([(keys[i], i) for i in range(a, b)]) for a, b in zip(starts, starts[1:])]
    order = [i for _, i in LoserTree(pieces)]
    part = TaskContext.get().partitionId()
    out = rows.take(pa.array(order)).append_column("part", pa.array([part] * len(order), pa.int32())).append_column("seq", pa.array(range(len(order)), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


def merged_index(records: DataFrame) -> DataFrame:
    """records with url_key, part and seq: all captures, in order of URL key, time and id by (part, seq). There are as many
    ranges as keep each to about RANGE_ROWS rows of the index, so a task's memory doesn't grow with the table."""
    rows = cut(records.withColumn("url_key", url_key(F.col("url"))))  # read twice: for the ranges' bounds, too
    n = max(records.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    ranges = rows.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("run", "run_seq")
    return ranges.mapInArrow(_merge, READ_SCHEMA + ", url_key string, part int, seq long")
