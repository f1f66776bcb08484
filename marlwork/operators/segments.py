"""A stored index of words that follows a folder of files: what changes is a new segment, what goes is marked dead.

Under the path lie blocks, terms and documents in folders by segment, and for each version a manifest of the documents
(hash of the text, file, segment), the files it was made from, the dead rows and the corpus' figures. These are written
last, so that a search sees a whole version or the one before. A segment's terms also take away what its dead rows had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlwork.operators.search import Index, blocked, bucket_of, counted, in_folders, part_of, parts_of, rarity, with_docs, word_rows, write_blocks, write_documents, write_terms
from marlwork.sources.durable import few, kept

#: Columns of what is stored, by folder; the last ones are the folders' own.
STORED = {
    "blocks": "term string, part int, ids array<long>, dls array<int>, tfs array<int>, tf long, dl int, segment int, bucket int",
    "terms": "term string, df long, tf long, dl int, segment int, bucket int",
    "documents": "doc_id long, dl int, text string, segment int, shelf int",
    "manifest": "doc_id long, hash string, dl int, file string, made int, version int",
    "dead": "doc_id long, made int, version int",
    "files": "file string, size long, modified timestamp, version int",
    "figures": "n long, average double, mean double, buckets int, segments array<int>, version int",
}


def latest(spark: SparkSession, path: str) -> int:
    """The last version that is whole; 0 without one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/figures")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return stored(spark, path, "figures").agg(F.max("version")).first()[0] or 0


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.schema(STORED[name]).parquet(f"{path}/{name}")
    return with_docs(rows) if name == "blocks" else rows


def of_version(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """The rows of a version; none of version 0."""
    rows = stored(spark, path, name).where(F.col("version") == version) if version else spark.createDataFrame([], STORED[name])
    return rows.drop("version")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, file, size and modified of the Parquet files below a folder; no content is read."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return own.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def hashed(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update(spark: SparkSession, folder: str, path: str, buckets: int = 64) -> int:
    """Brings the index at `path` up to the Parquet files (doc_id, text) below `folder`; the number of its version.

    Files whose path, size and time are known aren't read. Of the others, documents whose text is known keep their place;
    the rest are a new segment. Documents of files that are gone or were written anew, and that aren't back, are dead.
    Rows without an id are left out; a null text counts as empty; an id that stands twice is an error.
    """
    version, made = latest(spark, path), latest(spark, path) + 1
    if version:
        buckets = of_version(spark, path, "figures", version).first()["buckets"]
    now, before = kept(listed(spark, folder)), of_version(spark, path, "files", version)
    same_file = ["file", "size", "modified"]
    fresh = [r["path"] for r in now.join(before, same_file, "left_anti").select("path").collect()]  # as many as the driver lists anyway
    stale = few(before.join(now, same_file, "left_anti").select("file"))
    if version and not fresh and stale.isEmpty():
        return version
    some = spark.read.schema("doc_id long, text string").parquet(*fresh) if fresh else None
    texts = spark.createDataFrame([], "doc_id long, text string, file string") if some is None else some.select("doc_id", "text", F.col("_metadata.file_path").alias("file")).where("doc_id is not null")
    rows = kept(texts.select("doc_id", hashed(F.col("text")).alias("hash"), "file"))
    manifest = of_version(spark, path, "manifest", version)
    removed = kept(manifest.join(stale, "file", "left_semi"))
    back = rows.join(removed.select("doc_id", "hash", "made", "dl"), ["doc_id", "hash"], "left")
    known = kept(manifest.join(stale, "file", "left_anti").unionByName(back.withColumn("made", F.coalesce("made", F.lit(made)))))
    twice = known.groupBy("doc_id").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"document {twice['doc_id']} stands in the files more than once")
    dead = kept(removed.join(known, ["doc_id", "made"], "left_anti").select("doc_id", "made"))
    new = known.where(F.col("made") == made)
    added = texts.join(few(new.select("doc_id")), "doc_id", "left_semi") if version else texts
    segments = [] if not version else of_version(spark, path, "figures", version).first()["segments"]
    lost = counted(texts_of(spark, path, segments, dead, False)).select(F.explode("words.term").alias("term")) if version else None
    n = new.count()
    write_documents(added, n, buckets, f"{path}/documents/segment={made}")
    write_segment(spark, path, made, n, buckets, lost)
    # Lengths are known by now: words are counted once.
    lengths = stored(spark, path, "documents").where(F.col("segment") == made).select("doc_id", F.col("dl").alias("words"))
    new = new.join(lengths, "doc_id", "left").withColumn("dl", F.coalesce("words", F.lit(0))).drop("words")
    every = of_version(spark, path, "dead", version).unionByName(dead)
    publish(spark, path, made, [*segments, made], buckets, known.where(F.col("made") != made).unionByName(new), every, now.drop("path"))
    return made


def merge(spark: SparkSession, path: str) -> int:
    """Makes one segment of all, without the dead rows; no file is read. The number of the version."""
    version = latest(spark, path)
    if not version:
        raise ValueError("there is no index to merge")
    made, figures = version + 1, of_version(spark, path, "figures", version).first()
    n, buckets = figures["n"], figures["buckets"]
    live = texts_of(spark, path, figures["segments"], of_version(spark, path, "dead", version), True)
    write_documents(live, n, buckets, f"{path}/documents/segment={made}")
    write_segment(spark, path, made, n, buckets)
    known = kept(of_version(spark, path, "manifest", version).withColumn("made", F.lit(made)))
    publish(spark, path, made, [made], buckets, known, spark.createDataFrame([], "doc_id long, made int"), of_version(spark, path, "files", version))
    return made


def texts_of(spark: SparkSession, path: str, segments: list[int], dead: DataFrame, live: bool) -> DataFrame:
    """doc_id and text of the documents of segments that are live, or of those that are dead (doc_id, made).

    Dead ids go to the documents in some lists, a slot of about a thousand each, as these are little and texts are much.
    """
    dead = kept(dead)
    slots = parts_of(dead.count())
    lists = few(dead.groupBy(F.col("made").alias("segment"), part_of(F.col("doc_id"), slots).alias("slot")).agg(F.collect_set("doc_id").alias("gone")))
    own = stored(spark, path, "documents").where(F.col("segment").isin(segments)).withColumn("slot", part_of(F.col("doc_id"), slots))
    marked = F.coalesce(F.array_contains("gone", F.col("doc_id")), F.lit(False))
    return own.join(lists, ["segment", "slot"], "left" if live else "inner").where(~marked if live else marked).select("doc_id", "text")


def write_segment(spark: SparkSession, path: str, made: int, n: int, buckets: int, lost: DataFrame | None = None) -> None:
    """Stores blocks and terms of a segment by its documents; each row of `lost` (term) takes one from the df of its term."""

    where = lambda name: f"{path}/{name}/segment={made}"
    of_segment = lambda name: stored(spark, path, name).where(F.col("segment") == made).drop("segment")
    write_blocks(blocked(of_segment("documents"), n, buckets), n, buckets, where("blocks"))
    terms = of_segment("blocks").select("bucket", "term", F.size("ids").alias("df"), "tf", "dl")
    if lost is not None:
        terms = terms.unionByName(lost.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", F.lit(-1).alias("df")), allowMissingColumns=True)
    write_terms(terms.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl")), where("terms"))


def summed(spark: SparkSession, path: str, segments: list[int], n: int, asked: DataFrame | None = None) -> DataFrame:
    """terms over segments, or those of asked (bucket, term) alone; their bounds may be those of dead rows, which makes them no smaller."""
    own = stored(spark, path, "terms").where(F.col("segment").isin(segments))
    if asked is not None:
        own = in_folders(own, "bucket", asked).join(few(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    if len(segments) > 1:
        own = own.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    return own.select("bucket", "term", "df", "tf", "dl").where("df > 0").withColumn("raw", rarity(F.col("df"), n))


def publish(spark: SparkSession, path: str, made: int, segments: list[int], buckets: int, manifest: DataFrame, dead: DataFrame, files: DataFrame) -> None:
    """Writes what makes a version, its figures last."""
    for name, rows in (("manifest", manifest), ("dead", dead), ("files", files)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/version={made}")
    total = manifest.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    average = (total["words"] or 0) / total["n"] if total["n"] else 0.0
    mean = summed(spark, path, segments, total["n"]).agg(F.avg("raw")).first()[0] or 0.0
    row = spark.createDataFrame([(total["n"], average, mean, buckets, segments)], "n long, average double, mean double, buckets int, segments array<int>")
    row.write.mode("overwrite").parquet(f"{path}/figures/version={made}")


def read(spark: SparkSession, path: str, epsilon: float = 0.25) -> Index:
    """The last version, as search.found() takes it. Only the terms of a query are added up, over segments."""
    version = latest(spark, path)
    if not version:
        raise ValueError("there is no index to read")
    figures = of_version(spark, path, "figures", version).first()
    segments, buckets = figures["segments"], figures["buckets"]
    dead = few(of_version(spark, path, "dead", version).select("doc_id", F.col("made").alias("segment")))
    hurt = [r["segment"] for r in dead.select("segment").distinct().collect()]  # segments at most
    blocks = stored(spark, path, "blocks").where(F.col("segment").isin(segments))
    whole = blocks.where(~F.col("segment").isin(hurt)).drop("segment")
    # Blocks of segments with dead rows lose these, by part; their bounds still hold.
    first = stored(spark, path, "manifest").where(F.col("version").isin(hurt) & (F.col("made") == F.col("version"))).groupBy("version").count().collect()
    own_part = F.coalesce(*(F.when(F.col("segment") == r["version"], part_of(F.col("doc_id"), parts_of(r["count"]))) for r in first), F.lit(0))
    dead = dead.withColumn("part", own_part)
    gone = dead.groupBy("segment", "part").agg(F.collect_set("doc_id").alias("gone"))
    hit = blocks.where(F.col("segment").isin(hurt)).join(F.broadcast(gone), ["segment", "part"], "left")
    live = F.when(F.col("gone").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda x: ~F.array_contains("gone", x["doc_id"])))
    left = hit.withColumn("docs", live).where(F.size("docs") > 0)
    apart = {"ids": F.col("docs.doc_id"), "dls": F.col("docs.dl"), "tfs": F.col("docs.tf").cast("array<int>")}
    left = left.withColumns(apart).select(*whole.columns)
    shelves = stored(spark, path, "documents").where(F.col("segment").isin(segments))

    def documents(some: DataFrame) -> DataFrame:
        found = few(some.withColumn("shelf", part_of(F.col("doc_id"), buckets)))
        live = in_folders(shelves, "shelf", found).join(found, ["shelf", "doc_id"]).join(dead, ["segment", "doc_id"], "left_anti")
        return word_rows(live)

    terms_of = lambda asked: summed(spark, path, segments, figures["n"], asked)
    marks = {"every": blocks, "dead": dead} if hurt else {}
    return Index(whole.unionByName(left), summed(spark, path, segments, figures["n"]), documents, figures["n"], figures["average"], figures["mean"], epsilon, buckets, terms_of=terms_of, **marks)
