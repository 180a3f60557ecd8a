"""Content-addressed WARC archive (operator 8).

An archive is two tables in one folder: `payloads` holds the bytes of each distinct payload once, under its SHA-256; `headers` holds the exact header block of
every record, with the digest of its payload. Reading verifies every record: it is rebuilt by a join of its header block with its payload, and
held against the digest and lengths that the header names. Nothing but digests is compared or shuffled to find equal payloads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, table_path

#: Payloads below this size are always written as response: a revisit record would be no shorter.
LEAST_REVISIT = 100
#: Distinct payloads up to which the table of their owners is broadcast, so that payloads aren't shuffled to pick those to store.
BROADCAST_PAYLOADS = 200_000
CRLF = "\r\n"
END = "\r\n\r\n"
_SCHEME = "urn:x-page:"


def _header(kind: Column, page: Column, url: Column, digest: Column, size: Column, refers: Column, date: str) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit(f"WARC-Record-ID: <{_SCHEME}"), page, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit(f"WARC-Refers-To: <{_SCHEME}"), refers, F.lit(">")),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Length: "), size.cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(size).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END))  # concat_ws leaves out what is null


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of df to the archive at path, a folder that all executors can write to.

    The payload is the text in UTF-8 or the bytes (null: empty). Of equal payloads of LEAST_REVISIT bytes or more the row of the smallest id is the response and
    the others revisit it; of repeated rows of that id one is the response, the others revisit it by the same id. Rows whose id is null are the
    response only where no other has one. Line ends in a URL are dropped; a null URL is left out. An empty table gives an empty archive.

    The rows are read twice: for the digests, and for the bytes, which go by (digest, id) so that a group of copies is spread and only one of it is kept."""
    kind = df.schema[id_col].dataType
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    light = rows.select("id", "url", digest.alias("digest"), F.length("payload").cast("bigint").alias("size"))
    records = cut(light.withColumn("place", F.monotonically_increasing_id()))
    owners = cut(records.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first")))
    named = records.join(owners, "digest")
    revisit = (F.col("size") >= LEAST_REVISIT) & (F.col("place") != F.col("first.place"))
    kind_of = F.when(revisit, "revisit").otherwise("response")
    refers = F.when(revisit, F.col("first.id").cast("string"))
    header = _header(kind_of, F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("url"), F.col("digest"), F.col("size"), refers, date)
    named.select(F.col("id").cast(kind).alias("id"), "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers", compression="zstd")
    keep = owners.select(F.col("digest").alias("of"), F.col("first.id").alias("owner"))
    if keep.count() <= BROADCAST_PAYLOADS:
        keep = F.broadcast(keep)
    stored = rows.withColumn("digest", digest).join(keep, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("owner")), "left_semi")
    stored = stored.dropDuplicates(["digest"]) if _repeated(records) else stored
    stored.select("digest", "payload").write.parquet(f"{path}/payloads", compression="zstd")


def _repeated(records: DataFrame) -> bool:
    """Whether an id occurs with the same payload more than once: only then the rows picked by digest and id hold a payload twice."""
    return not records.groupBy("digest", "id").count().where("count > 1").isEmpty()


def _field(name: str) -> Column:
    """A field of `head` (null, if it is not there). Lines end with CR LF alone: other line ends of Unicode may stand in a field."""
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' fields as their header blocks have them: id_text, record_type, digest, payload_bytes, block_bytes, refers_text and the exact `header`."""
    head = spark.read.parquet(f"{path}/headers").select("header", F.decode("header", "UTF-8").alias("head"))
    bare = lambda c: F.regexp_extract(c, rf"^<{_SCHEME}(.*)>$", 1)
    return head.select(
        F.nullif(bare(_field("WARC-Record-ID")), F.lit("")).alias("id_text"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        _field("WARC-Payload-Length").cast("bigint").alias("payload_bytes"),
        _field("Content-Length").cast("bigint").alias("block_bytes"),
        bare(_field("WARC-Refers-To")).alias("refers_text"),
        "header",
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """The fields of read_headers, record binary: each original record, rebuilt from its header block and the stored payload (a revisit holds none), and payload
    binary, the bytes that it stands for (null, if they are not stored)."""
    held = spark.read.parquet(f"{path}/payloads").withColumnRenamed("digest", "held")
    joined = read_headers(spark, path).join(held, F.col("digest") == F.col("held"), "left").drop("held")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat("header", body, F.lit(END.encode())))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its verified payload's size: id_text, record_type, payload_digest, payload_bytes, refers_text.

    Each record is rebuilt and held against its header: a payload that is missing or whose length or SHA-256 is not the header's, and a block of another length
    than the header's, fail the query. Of a revisit the payload's bytes are those of the response, which are verified there."""
    found = records(spark, path)
    answer = F.col("record_type") == "response"
    block = F.substring("record", F.length("header") + 1, F.length("record") - F.length("header") - len(END))
    bad = (
        F.when(answer & (F.sha2(block, 256) != F.col("digest")), F.lit("payload differs from its digest "))
        .when(F.col("payload").isNull() | (F.length("payload") != F.col("payload_bytes")), F.lit("no payload of that length for "))
        .when(F.length("record") != F.length("header") + F.col("block_bytes") + len(END), F.lit("block of another length for "))
    )
    size = F.when(bad.isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(bad, "digest")).cast("bigint"))
    return found.select("id_text", "record_type", F.col("digest").alias("payload_digest"), size.alias("payload_bytes"), "refers_text")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record of WARC bytes, for files from elsewhere."""
    at = 0
    while at < len(data):
        stop = data.find(END.encode(), at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode().split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        start = stop + len(END)
        yield fields, data[start : start + size]
        at = start + size + len(END)


def archive(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write df to an archive (in the shared folder if path is not given) and read it back.

    One row per row of df: the id, payload_bytes bigint, payload_digest string, record_type string, refers_to of the id's type (null for a response)."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    path = path or table_path(spark, "warc")
    write_archive(df, path, id_col, url_col, payload_col)
    found = read_archive(spark, path)
    return found.select(F.col("id_text").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.nullif("refers_text", F.lit("")).cast(kind).alias("refers_to"))
