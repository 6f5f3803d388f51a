"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by a join.

The archive is a folder of two Parquet tables, ``payloads(digest, payload)`` and ``headers(digest, type, bytes, header)``.
A record is its header followed by its block; that of a revisit is empty. The digest is SHA-256 and is checked when a
record is put together. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.storage import stored

END = "\r\n"
#: Payloads below this size are never replaced by a reference. Many records may share one (the empty one above all), so
#: each goes to ``SALTS`` parts of a join.
SMALL, SALTS = 100, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(*of: Column) -> Column:
    """A URN that follows from these values, so that a second run writes the same records."""
    known = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in of]
    h = F.md5(F.concat_ws("\n", F.lit("page"), *known).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _line(name: str, value: Column, exact: bool = False) -> Column:
    """A header line; none for null. Line ends inside a value are percent-encoded, and percents where it must come back."""
    percent = [("%", "%25")] if exact else []
    bare = _replaced(value.cast("string"), *percent, ("\r", "%0D"), ("\n", "%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), bare, F.lit(END)), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, min_revisit: int = SMALL, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write one record for each row of ``pages``; the payload is the html in UTF-8 (null: empty).

    Of records with equal payloads of ``min_revisit`` bytes or more, those with the smallest id are responses, all
    others revisits of it; where no row of such a payload has an id, all are responses. Smaller payloads are always
    responses. A null url has no target line. Record ids follow from page id, url and digest; rows equal in all three, and
    only these, are told apart by their place in the input. Only digests, ids and urls are joined; a payload is
    shuffled once, and equal ones meet before that.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    facts = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    facts = stored(facts.withColumn("rid", record_id(F.col("page"), F.col("url"), F.col("digest"))), "warc-facts")
    again = facts.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid", F.lit(True).alias("again"))
    own = F.when(F.col("again"), record_id(F.col("rid"), F.col("row"))).otherwise(F.col("rid"))
    facts = facts.join(again, "rid", "left").withColumn("rid", own).drop("again")
    copies = facts.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min(F.struct(F.col("page").isNull(), "page", "rid")).alias("first"), F.count("*").alias("n"))
    copies = copies.where("n > 1").select("digest", F.col("first.page").alias("first"), F.col("first.rid").alias("first_rid"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # One payload may be that of most pages: its rows are parted by a salt. Small ones have nothing to look up.
    large = facts.where(F.col("bytes") >= min_revisit).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    marked = large.join(copies, ["digest", "salt"], "left").drop("salt").unionByName(facts.where(F.col("bytes") < min_revisit), allowMissingColumns=True)
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.lit(False))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.col("rid")),
        F.lit(f"WARC-Date: {date}{END}"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("bytes")),
        _line("X-Page-ID", F.col("page"), exact=True),
        F.when(revisit, F.concat(
            _line("WARC-Refers-To", F.col("first_rid")), _line("X-Refers-To-Page", F.col("first"), exact=True), F.lit(f"WARC-Profile: {PROFILE}{END}")
        )).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{END}"),
        _line("Content-Length", length),
        F.lit(END),
    )
    kind = F.when(revisit, "revisit").otherwise("response")
    marked.select("digest", kind.alias("type"), "bytes", header.alias("header")).write.parquet(f"{path}/headers")
    pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, each ``(digest, record)`` with the record's exact bytes.

    A payload that is missing or whose digest differs from its key fails the job.
    """
    headers = spark.read.schema("digest string, type string, bytes bigint, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), "digest")))
    salt = F.when(F.col("bytes") < SMALL, F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.octet_length("payload") < SMALL, SALTS - 1).otherwise(0))).alias("salt")
    wanted = headers.where("type = 'response'").select("digest", "header", salt)
    found = wanted.join(payloads.select("digest", checked.alias("payload"), salts), ["digest", "salt"], "left")
    block = F.coalesce("payload", F.raise_error(F.concat(F.lit("payload is missing: "), "digest")).cast("binary"))
    responses = found.select("digest", F.concat(F.col("header").cast("binary"), block, F.lit(END * 2).cast("binary")).alias("record"))
    revisits = headers.where("type = 'revisit'").select("digest", F.concat("header", F.lit(END * 2)).cast("binary").alias("record"))
    return responses.union(revisits)


def parse(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Fields of each record, read from its bytes: ids, url, digest, lengths, type and the block (the payload)."""
    head = F.substring_index(F.col("record").cast("string"), END * 2, 1)

    def get(name: str) -> Column:
        # (?d): only line feeds end a line. Values never hold one, but may hold other characters that end lines elsewhere.
        return F.when(F.col("head").contains(f"\n{name}: "), F.regexp_extract("head", rf"(?md)^{name}: ([^\r\n]*)", 1))

    def page(name: str) -> Column:
        return _replaced(get(name), ("%0D", "\r"), ("%0A", "\n"), ("%25", "%")).cast(id_type)

    # A long record's text is cut before the expressions over its header, which then handle that alone.
    cut = records.select(head.alias("head"), "record")
    size = get("Content-Length").cast("int")
    start = F.octet_length("head") + F.lit(len(END * 2) + 1)
    return cut.select(
        page("X-Page-ID").alias("page_id"), get("WARC-Target-URI").alias("url"), get("WARC-Type").alias("record_type"),
        get("X-Payload-Length").cast("bigint").alias("payload_bytes"),
        F.regexp_replace(get("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        page("X-Refers-To-Page").alias("refers_to"), F.col("record").substr(start, size).alias("block"),
    )


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Parsed records; a response's block must have the digest and length that its header states."""
    fields = parse(read_records(spark, path), id_type)
    wrong = (F.col("record_type") == "response") & (
        (F.sha2("block", 256) != F.col("payload_digest")) | (F.octet_length("block") != F.col("payload_bytes"))
    )
    kind = F.when(wrong, F.raise_error(F.concat(F.lit("a record's block differs from its header: "), "payload_digest"))).otherwise(F.col("record_type"))
    return fields.withColumn("record_type", kind)


def export_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files: the line separator of the text writer is the end of a record."""
    text = F.col("record").cast("string")
    records.select(F.substring(text, F.lit(1), F.length(text) - len(END * 2)).alias("value")).write.option("lineSep", END * 2).option(
        "compression", compression
    ).text(path)
