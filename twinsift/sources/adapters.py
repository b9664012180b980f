"""File, image and shot relations made from the tables at hand, in SQL that two engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT, HOME, KEEP = "/r", "/r/home", "/r/keep"

PATH = """case cast(doc_id % 12 as int)
  when 0 then concat('/r/keep/', doc_id, '.txt') when 1 then concat('/r/Downloads/Copy of ', doc_id, '.txt')
  when 2 then concat('/r/my-backup/', doc_id, ' (1).txt') when 3 then concat('/r/docs/', doc_id, '_1.txt')
  when 4 then concat('/r/docs/', doc_id, '.bak') when 5 then concat('/r/photos/', doc_id, '.jpg')
  when 6 then concat('/r/a-b/', doc_id, '.PNG') when 7 then concat('/r/a/b/', doc_id, '.pdf')
  when 8 then concat('/r/.cache/', doc_id, '/x.tmp') when 9 then concat('/r/home/.vim/.', doc_id, '.swp')
  when 10 then concat('/r/docs/~$', doc_id, '.docx') else concat('/r/node_modules/', doc_id, '.txt~') end"""
MTIME = "(doc_id * 7919 % 97) * 1000000000"

FILES_SQL = f"""
  select {PATH} as path, {{size}} as size, {MTIME} as mtime_ns, doc_id as inode, cast(1 + doc_id % 2 as bigint) as device, text as content
  from documents
  union all select concat('/r/links/', doc_id, '.txt'), {{size}}, {MTIME}, doc_id, cast(1 + doc_id % 2 as bigint), text
  from documents where doc_id % 50 = 0
  union all select concat('/r/empty/', doc_id, '.dat'), cast(0 as bigint), {MTIME}, doc_id + 1000000000, cast(1 as bigint), ''
  from documents where doc_id % 100 = 1"""

#: Fixed masks stand for the turned and mirrored image.
MASK = 1234567890123

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, mtime_ns, inode, device, content); hard links and empty files among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sql = FILES_SQL.format(size="cast(octet_length(text) as bigint)").replace("from documents", "from {documents}")
    return spark.sql(sql, documents=docs.select("doc_id", "text"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, phash, dhash, near, variants) from the signs of vectors, with near copies, whose ids can be other vectors' too."""
    e = F.col("embedding")
    bits = lambda hit: F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda a, i: a + F.when(hit(i), F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
    signs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", bits(lambda i: F.get(e, i) > 0).alias("phash"), bits(lambda i: F.get(e, i) > F.get(e, i + 1)).alias("dhash")
    )
    mask = F.pow(F.lit(2.0), F.col("vec_id") % 17).cast("long") - 1
    near = signs.select((F.col("vec_id") + 100000).alias("idx"), F.col("phash").bitwiseXOR(mask).alias("phash"), F.col("dhash").bitwiseXOR(mask).alias("dhash"))
    rows = signs.withColumnRenamed("vec_id", "idx").withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True)))
    turned = [F.struct(F.col("phash").bitwiseXOR(F.lit(k * MASK)).alias("p"), F.col("dhash").bitwiseXOR(F.lit(k * MASK)).alias("d")) for k in range(8)]
    return rows.withColumn("variants", F.array(*turned))


def image_meta(rows: DataFrame) -> DataFrame:
    """(idx, path, pixels, size, mtime_ns) of the images of ``hashes``."""
    i = F.col("idx")
    folder = F.when(i % 5 == 0, "/r/Downloads/").otherwise("/r/pics/")
    return rows.select(
        "idx", F.concat(folder, i.cast("string"), F.when(i % 3 == 0, "_1.jpg").otherwise(".jpg")).alias("path"),
        (i % 4 * 1000).alias("pixels"), (i % 3 + 1).alias("size"), (i % 11).alias("mtime_ns"),
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, taken, phash, dhash): events as photographs, in seconds."""
    event = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        event.alias("idx"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("taken"),
        (event * 7919 % 65536).alias("phash"), (event * 104729 % 65536).alias("dhash"),
    )
