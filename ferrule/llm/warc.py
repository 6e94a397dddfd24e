"""A content-addressed archive of WARC records.

write() keeps each distinct payload once, under its SHA-256, and the exact header bytes of every record in a table of their own;
read() joins them and reconstructs the records.  A payload that is there more than once and has at least `least` bytes is the
response of its largest id; the other records of it are revisits that name that response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import require, settle

#: Payloads below this size are responses each.
LEAST = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends inside the value are percent-encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _header(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    # a null id has no record id of its own
    own = F.concat(F.lit("<urn:page:"), F.col("_id").cast("string"), F.lit(">"))
    other = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", other),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of a table under path: payloads/ and headers/.

    A null payload counts as empty; a null url leaves its header line out.  Repeated rows give repeated records.  A row with a
    null id has a record without an id and refers to the largest other id of its payload.  Other columns are not archived.
    """
    require(pages, id_col, url_col, payload_col)
    spark = pages.sparkSession
    plain = pages.select(F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = plain.select("_id", "_url", "payload", F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("key"))
    small = base.select("_id", "key", "size")
    # only of digests that occur more than once there is anything to decide; the count is combined before the shuffle
    groups = small.groupBy("key").agg(F.count("*").alias("n"), F.max("_id").alias("keeper"), F.min("size").alias("size_low"), F.max("size").alias("size_high")).filter("n > 1")
    groups = groups.withColumn("keeper", F.when(F.col("size_low") == F.col("size_high"), F.col("keeper")).otherwise(F.raise_error(F.lit("equal digests of payloads of different size"))))
    again = settle(small.join(groups.select("key", "keeper"), "key"), spark)

    losers = again.filter("NOT (_id <=> keeper)").select("_id", "key")
    # written rows carry no id: what stays of each digest is one row
    marked = losers.selectExpr("_id AS lost_id", "key AS lost_key")
    payloads = base.join(marked, base["_id"].eqNullSafe(marked["lost_id"]) & (base["key"] == marked["lost_key"]), "left_anti").select("key", "size", "payload")
    twice = again.filter("_id <=> keeper").groupBy("key").count().filter("count > 1")
    if not twice.isEmpty():
        payloads = payloads.dropDuplicates(["key"])
    payloads.write.parquet(f"{path}/payloads", compression="zstd")

    decided = again.filter("NOT (_id <=> keeper) AND keeper IS NOT NULL").filter(F.col("size") >= least).selectExpr("_id AS to_id", "key AS to_key", "keeper").distinct()
    rows = base.drop("payload").join(decided, base["_id"].eqNullSafe(decided["to_id"]) & (base["key"] == decided["to_key"]), "left")
    rows = rows.withColumn("refers_to", F.col("keeper"))
    rows.select(F.col("_id").alias("record_id"), "key", _header(date).alias("header")).write.parquet(f"{path}/headers", compression="zstd")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: record_id, header (binary), payload (binary; the full payload for revisits too).

    Fails on a payload whose bytes no longer have their digest.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("key"), F.lit("a stored payload does not match its digest"))
    stored = stored.select("key", F.when(sound.isNull(), F.col("payload")).alias("payload"))
    return spark.read.parquet(f"{path}/headers").join(stored, "key", "left").select("record_id", "header", "payload")


def field(header: Column, name: str) -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(F.length(found) > 0, found)


def record(header: Column, payload: Column) -> Column:
    """The bytes of the record as they stand in a WARC file; a revisit's block is empty."""
    block = F.when(field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header, block, F.lit(b"\r\n\r\n"))


def archive(pages: DataFrame, path: str, **options) -> DataFrame:
    """write() and read() with the fields that the headers hold: record_id, record_type, refers_to, digest, url, payload, header."""
    write(pages, path, **options)
    back = read(pages.sparkSession, path)
    number = lambda name: F.regexp_extract(field(F.col("header"), name), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return back.select(number("WARC-Record-ID").alias("record_id"), field(F.col("header"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), F.regexp_extract(field(F.col("header"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("digest"), field(F.col("header"), "WARC-Target-URI").alias("url"), "payload", "header")
