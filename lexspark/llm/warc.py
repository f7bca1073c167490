"""Content-addressed web archive.

Payload bytes are stored once, under a strong digest; the exact header of each record is stored
apart. Joins by digest give the records back, and what is read is verified against its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import checkpoint, hot_join, read, shared_folder

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records of one payload that are joined with it together, about.
SHARE = 256


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 8 times 5 hex digits, 4 letters each."""
    digits = F.sha1(payload)
    letter = lambda value, shift: F.substring(
        F.lit(_BASE32), (F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1), F.lit(1)
    )
    part = lambda i: F.conv(F.substring(digits, i * 5 + 1, 5), 16, 10).cast("int")
    return F.concat(*[letter(part(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def _header_value(value: F.Column) -> F.Column:
    """A value on one line: CR and LF are escaped, and so is the per cent sign, so that it can be read back as it was."""
    return F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _as_it_was(value: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(value, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def write_archive(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write ``folder``/payloads (address, payload, shares) and ``folder``/records (address, share, header).

    A null html is an empty payload; a null url has no WARC-Target-URI line; a null page_id makes
    the record id urn:page:null and counts as less than any other. Of the records with equal
    payloads of min_bytes or more, that with the largest page_id is a response and the others
    revisit it; rows that repeat this page_id are responses too, and still share one payload.
    Equality is that of SHA-256 and length. An empty table gives an empty archive. Other columns are
    ignored. The records of a payload are dealt over its shares, of SHARE records or so each, so that
    many records of one payload can be joined with it in many tasks.
    """
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload")
    )
    base = base.withColumn("address", F.unhex(F.sha2("payload", 256)))
    records = checkpoint(base.select(
        "page_id", "url", "address", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest")
    ))
    keepers = checkpoint(records.groupBy("address").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    ).withColumn("shares", F.ceil(F.col("n") / SHARE)))
    # copies meet within each task before the shuffle, so a payload that a third of the pages share moves once a task
    stored = base.groupBy("address").agg(
        F.any_value("payload").alias("payload"), (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload"))).alias("_one")
    )
    one = F.when(F.col("_one"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one address")).cast("binary"))
    stored.join(keepers, "address").select("address", one.alias("payload"), "shares").write.parquet(f"{folder}/payloads")
    again = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _header_value(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn(F.col("keeper")))
            )
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(CRLF),
    )
    share = F.pmod(F.xxhash64("page_id", "url"), F.col("shares"))
    hot_join(records, keepers, "address", "n").select(
        "address", share.alias("share"), F.encode(header, "UTF-8").alias("header")
    ).write.parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as it was: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record.

    The payload side is digested again as it is read; a payload that doesn't fit its address or a
    record that has none stops the job. ``record`` is header, block and the two closing line ends:
    a response's block is its payload, a revisit's is empty. Columns that the caller doesn't
    select, such as the bytes, are not shuffled.
    """
    stored = spark.read.schema("address binary, payload binary, shares long").parquet(f"{folder}/payloads")
    payloads = stored.select(
        F.col("address").alias("_address"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("_share"),
        F.when(
            F.unhex(F.sha2("payload", 256)) == F.col("address"), F.length("payload").cast("long")
        ).otherwise(F.raise_error(F.lit("a payload differs from its address")).cast("long")).alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "payload",
    )
    head = F.decode("header", "UTF-8")
    line = lambda name: rf"\r\n{name}: ([^\r\n]*)\r\n"
    value = lambda name: F.when(head.rlike(line(name)), F.regexp_extract(head, line(name), 1))
    number = lambda name: F.regexp_extract(head, rf"\r\n{name}: <urn:page:(-?\d*)", 1).try_cast("long")
    records = spark.read.schema("address binary, share long, header binary").parquet(f"{folder}/records").select(
        "address", "share", "header", number("WARC-Record-ID").alias("page_id"),
        _as_it_was(value("WARC-Target-URI")).alias("url"), value("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), value("WARC-Payload-Digest").alias("_digest")
    )
    joined = records.join(
        payloads, (records["address"] == payloads["_address"]) & (records["share"] == payloads["_share"]), "left"
    )
    told = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes",
        F.when(
            told == F.col("_digest"), F.col("payload_digest")
        ).otherwise(F.raise_error(F.lit("a record has no payload of its digest")).cast("string")).alias("payload_digest"),
        "payload",
        F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read every record back whole; ``record_sha256`` is the digest of a record's bytes (header, block, closing line ends).

    See ``write_archive`` for nulls, repeated rows, ties and empty tables.
    """
    folder = shared_folder(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256")
    )
