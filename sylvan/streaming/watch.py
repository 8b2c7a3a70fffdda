"""Watching folders: a file stream whose micro-batches index new files first and prune vanished ones after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvan.operators import index, tree
from sylvan.operators.lineage import cut
from sylvan.sources import discovery, parsers


def debounced(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", item: str = "event_type") -> DataFrame:
    """(key, start, end, events, items): events without a gap between them, as one; works on streams with a watermark."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.array_join(F.sort_array(F.collect_set(item)), ",").alias("items")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "items")


def file_stream(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """(path) of files as they come, of any of the extensions (all that have a parser)."""
    names = ",".join(e.lstrip(".") for e in (extensions or sorted(parsers.SOURCE_TYPES)))
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{names}}}").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"))


def _parsed(changed: DataFrame, registry: parsers.Registry, split: int | None, thin: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Trees and document rows of files (path, content, ext, doc_name), one plan for all extensions."""
    nodes = documents = None
    for ext in sorted(r["ext"] for r in changed.select("ext").distinct().collect()):  # a few dozen extensions at most
        part = changed.where(F.col("ext") == ext)
        kind = registry.types.get(ext, "text")
        docs = part.select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"), "content", "doc_name")
        own = tree.shaped(registry.parse(docs, ext), split, thin).withColumn("__md", F.lit(kind == "markdown"))
        known = part.select(F.col("path").alias("doc_id"), "doc_name", F.col("path").alias("source_path"), F.lit(kind).alias("source_type"))
        nodes, documents = (own, known) if nodes is None else (nodes.unionByName(own), documents.unionByName(known))
    return (tree.build(cut(nodes)) if nodes is not None else None), documents


def sync(store: index.Index, folder: str, extensions: list[str] | None = None, registry: parsers.Registry | None = None, prune: bool | None = None, fingerprint: str = "content", force: bool = False, max_files: int = 10_000, split: int | None = 8000, thin: int | None = None) -> dict[str, int]:
    """Bring the index to the folder's state: moved files are renamed, new and changed ones (with ``force`` all) parsed.

    ``prune``: by default documents go whose files were below the folder, have one of the extensions and are no longer on
    disk; with ``True`` the index is reduced to exactly what the folder lists; with ``False`` nothing goes. A folder that is
    not there is an error, and nothing goes for it. Long texts are split, and small trees thinned on request, as indexed.
    """
    spark, registry = store.spark, registry or parsers.Registry()
    if not discovery.exists(spark, folder):
        raise FileNotFoundError(folder)
    wanted = [e.lower() for e in (extensions or registry.supported())]
    listed = discovery.listing(spark, [folder], wanted, max_files=max_files)
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]+$", "")
    listed = listed.select("path", "modificationTime", "length", "content", discovery.fingerprint(fingerprint).alias("file_hash"), discovery.extension_of(F.col("path")).alias("ext"), name.alias("doc_name"))
    paths = cut(listed.select(F.col("path").alias("source_path")))  # names alone: no content is read
    begun = store.version() is not None
    known = cut(store.table("meta")) if begun else spark.createDataFrame([], "source_path string, file_hash string")
    done = {"moved": 0, "indexed": 0, "pruned": 0}
    changed = listed if force else listed.join(known.withColumnRenamed("source_path", "path"), ["path", "file_hash"], "left_anti")
    changed = cut(changed.select("path", "content", "file_hash", "ext", "doc_name"))
    gone = cut(known.join(paths, "source_path", "left_anti"))
    gone_files = gone.join(_on_disk(spark, folder, wanted), "source_path", "left_anti")
    if begun and not force:
        new = changed.select(F.col("path").alias("source_path"), "file_hash").join(known, "source_path", "left_anti")
        moved = cut(index.moved(gone_files, new))
        done["moved"] = store.rename_all(moved.select(F.col("old_path").alias("old"), F.col("new_path").alias("new"), F.col("new_path").alias("path")))
        if done["moved"]:
            changed = changed.join(moved.select(F.col("new_path").alias("path")), "path", "left_anti")
            gone, gone_files = (x.join(moved.select(F.col("old_path").alias("source_path")), "source_path", "left_anti") for x in (gone, gone_files))
    nodes, documents = _parsed(changed, registry, split, thin)
    if documents is not None:
        store.add(nodes, documents, changed.select(F.col("path").alias("source_path"), "file_hash"), markdown=F.col("__md"), force=force)
        done["indexed"] = documents.count()
    if prune is not False and begun:
        if prune is None:
            below = F.col("source_path").startswith(discovery.qualified(spark, folder) + "/") & discovery.extension_of(F.col("source_path")).isin(wanted)
            gone = gone_files.where(below)
        ids = cut(store.table("documents").join(gone, "source_path", "left_semi").select("doc_id"))
        done["pruned"] = store.delete(ids)
    return done


def _on_disk(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    """(source_path) of all files below ``folder``, ignored ones too."""
    return discovery.listing(spark, [folder], wanted, respect_ignore=False, max_files=0, ignored=()).select(F.col("path").alias("source_path"))


def watch(store: index.Index, folder: str, extensions: list[str] | None = None, checkpoint: str | None = None, trigger: dict | None = None, after: Callable[[dict], None] | None = None, debounce: str = "1 second", **options) -> StreamingQuery:
    """Sync once, then again whenever the folder's names, times or sizes have changed. Micro-batches come with the file
    stream and with a clock, so that edits in place and deletions are seen too; changes within ``debounce`` are one sync."""
    spark = store.spark

    def state() -> tuple:
        rows = discovery.listing(spark, [folder], extensions, max_files=0).select(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)").alias("h"))
        return tuple(rows.agg(F.count("*"), F.sum("h")).first())

    last = [state()]
    sync(store, folder, extensions, **options)
    first = [True]

    def batch(_: DataFrame, __: int) -> None:
        now = state()
        if now == last[0] and not first[0]:
            return
        last[0], first[0] = now, False
        done = sync(store, folder, extensions, **options)
        if after:
            after(done)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(None).cast("string").alias("path"))
    rows = file_stream(spark, folder, extensions).unionByName(clock)
    writer = rows.writeStream.foreachBatch(batch).trigger(**(trigger or {"processingTime": debounce}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
