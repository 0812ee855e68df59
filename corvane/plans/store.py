"""A stored search index: immutable segments, delete marks, and versions that are switched by one rename.

Folders under the store::

    manifests/00000007.json               what version 7 consists of
    <table>/segment=<name>/               repositories, vectors (cell=k/), doc_terms, postings, term_stats, digests
    deletes/change=<name>/                (segment, shard, id) that the change removed from earlier segments
    delete_stats/change=<name>/           what those documents counted in the term statistics, negative
    centres/<name>/                       centres of the vector cells

Nothing is overwritten: a change writes new folders and then a manifest, which becomes visible by one rename.
A reader holds the folders of one version, so it sees no half-written change, and a change that dies leaves
folders that no manifest names. Documents are replaced and deleted by id; ``compact_index`` writes the living
rows into one segment again.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.dense import assign_cells, train_cells
from corvane.operators.lexical import TOTALS, count_terms, term_stats
from corvane.operators.postings import FILE_ENTRIES, block_stats, build_blocks, part_bounds, shard_count
from corvane.plans.search import Index
from corvane.session import BROADCAST_KEYS, materialise, small_side

TABLES = ["repositories", "vectors", "doc_terms", "digests"]
DEAD = "segment string, shard int, id bigint"
#: Most terms and vectors in a written file.
FILE_ROWS = 4_000_000


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def index_versions(spark: SparkSession, path: str) -> dict[int, dict]:
    """The manifests of a store by version; none if there is no store."""
    folder, files = _path(spark, f"{path.rstrip('/')}/manifests")
    if not files.exists(folder):
        return {}
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder.toString(), wholetext=True).collect()
    found = [json.loads(r["value"]) for r in rows]
    return {m["version"]: m for m in found}


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    found = index_versions(spark, path)
    version = max(found, default=0) if version is None else version
    if version not in found:
        raise ValueError(f"no index under {path!r}" if not found else f"no version {version} under {path!r}")
    return found[version]


def _commit(spark: SparkSession, path: str, changed: dict) -> int:
    """Make a manifest visible; the version it follows must still be the latest."""
    text = json.dumps(changed, indent=1).encode()
    final, files = _path(spark, f"{path.rstrip('/')}/manifests/{changed['version']:08d}.json")
    draft, _ = _path(spark, f"{path.rstrip('/')}/manifests/.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(text))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another change made version {changed['version']} of {path!r}: try again")
    return changed["version"]


def _read(spark: SparkSession, path: str, table: str, names: list[str], kind: str = "segment") -> DataFrame:
    root = f"{path.rstrip('/')}/{table}"
    rows = spark.read.option("basePath", root).parquet(*[f"{root}/{kind}={n}" for n in names])
    return rows.withColumn(kind, F.col(kind).cast("string"))


def _write_segment(index: Index, path: str, name: str, centres: np.ndarray | None) -> dict:
    """Write the tables of one segment; the statistics and postings follow from the written term rows."""
    spark = index.repositories.sparkSession
    root = path.rstrip("/")

    def save(df: DataFrame, table: str, *partitions: str) -> None:
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{root}/{table}/segment={name}")

    save(index.repositories.sortWithinPartitions("primary_language", "stars"), "repositories")
    vectors = index.vectors.drop("cell")
    if centres is not None:
        # A rebalance splits a cell that holds a third of the rows over many tasks.
        vectors = assign_cells(vectors, centres).hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "primary_language", "stars")
        save(vectors, "vectors", "cell")
    else:
        save(vectors.sortWithinPartitions("primary_language", "stars"), "vectors")
    terms = index.doc_terms if "tfs" in index.doc_terms.columns else count_terms(index.doc_terms)
    # Sorted file by file: a range over all files would count every text twice, once to find its bounds.
    save(terms.sortWithinPartitions("id"), "doc_terms")
    written = _read(spark, path, "doc_terms", [name]).drop("segment")
    docs, total, entries = written.agg(F.count(F.lit(1)), F.sum("doc_len"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    # The bounds of the files come from a sample, so that blocks are cut once.
    parts = -(-entries // FILE_ENTRIES)
    bounds = part_bounds(written, docs, entries, parts)
    blocks = build_blocks(written, docs, entries, bounds).repartitionById(len(bounds) + 1, "part")
    save(blocks.drop("part").sortWithinPartitions("term", "shard", "block"), "postings")
    stats = block_stats(_read(spark, path, "postings", [name]))
    if docs:
        stats = stats.unionByName(spark.createDataFrame([(TOTALS, docs, total)], "term string, df bigint, total_len bigint"))
    save(stats.repartitionByRange("term").sortWithinPartitions("term"), "term_stats")
    digests = index.digests
    if digests is None:
        digests = index.repositories.select("id", F.lit(0).cast("bigint").alias("digest"))
    save(digests, "digests")
    return {"name": name, "docs": docs, "shards": shard_count(docs, entries), "vectors": _read(spark, path, "vectors", [name]).count()}


def _centres(spark: SparkSession, path: str, name: str | None) -> np.ndarray | None:
    if not name:
        return None
    rows = spark.read.parquet(f"{path.rstrip('/')}/centres/{name}").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def write_index(index: Index, path: str, cells: int = 0) -> int:
    """Write ``index`` as the only segment of a new version. With ``cells`` its vectors are stored by cell."""
    spark = index.repositories.sparkSession
    last = max(index_versions(spark, path), default=0)
    name, centres = uuid.uuid4().hex, None
    if cells:
        centres = train_cells(index.vectors, cells)
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/centres/{name}")
    segment = _write_segment(index, path, name, centres)
    return _commit(spark, path, {"version": last + 1, "segments": [segment], "changes": [], "centres": name if cells else None})


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The living rows of one version, the latest by default; later changes are not seen."""
    m = manifest(spark, path, version)
    names = [s["name"] for s in m["segments"]]
    dead = None
    marks = [c["name"] for c in m["changes"] if c["deleted"]]
    if marks:
        dead = _read(spark, path, "deletes", marks, "change").select("segment", "shard", "id")
    few = sum(c["deleted"] for c in m["changes"]) <= BROADCAST_KEYS

    def living(table: str) -> DataFrame:
        rows = _read(spark, path, table, names)
        if dead is not None:
            gone = dead.select("segment", "id")
            rows = rows.join(F.broadcast(gone) if few else gone, ["segment", "id"], "left_anti")
        return rows.drop("segment")

    stats = _read(spark, path, "term_stats", names).select("term", "df", "total_len")
    if marks:
        stats = stats.unionByName(_read(spark, path, "delete_stats", marks, "change").select("term", "df", "total_len"))
    if len(names) > 1 or marks:
        stats = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_len").alias("total_len")).where("df > 0")
    return Index(
        **{t: living(t) for t in TABLES},
        term_stats=stats,
        blocks=_read(spark, path, "postings", names),
        dead=dead,
        centres=_centres(spark, path, m["centres"]),
        rows=sum(s["vectors"] for s in m["segments"]),
    )


def _mark_deleted(spark: SparkSession, path: str, m: dict, ids: DataFrame, name: str) -> int:
    """Write the delete marks of ``ids`` that live in version ``m``, and their share of the statistics."""
    root, names = path.rstrip("/"), [s["name"] for s in m["segments"]]
    old = _read(spark, path, "digests", names).select("segment", "id")
    marks = [c["name"] for c in m["changes"] if c["deleted"]]
    if marks:
        old = old.join(_read(spark, path, "deletes", marks, "change").select("segment", "id"), ["segment", "id"], "left_anti")
    shards = spark.createDataFrame([(s["name"], s["shards"]) for s in m["segments"]], "segment string, shards int")
    hit = old.join(small_side(ids.select("id").distinct(), BROADCAST_KEYS), "id", "left_semi").join(F.broadcast(shards), "segment")
    hit = hit.select("segment", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "id")
    hit.write.mode("overwrite").parquet(f"{root}/deletes/change={name}")
    hit = spark.read.schema(DEAD).parquet(f"{root}/deletes/change={name}")
    n, low, high = hit.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n:
        # Term rows are sorted by id in each file: the range skips row groups and pages.
        rows = _read(spark, path, "doc_terms", names).where(F.col("id").between(low, high))
        gone = rows.join(F.broadcast(hit) if n <= BROADCAST_KEYS else hit, ["segment", "id"], "left_semi")
        less = term_stats(gone).select("term", (-F.col("df")).alias("df"), (-F.col("total_len")).alias("total_len"))
        less.write.mode("overwrite").parquet(f"{root}/delete_stats/change={name}")
    return n


def refresh_index(spark: SparkSession, path: str, index: Index | None = None, deleted: DataFrame | None = None, name: str | None = None) -> int:
    """Add ``index`` as a segment whose rows replace those of the same id, and delete the ids of ``deleted``.

    One new version, or none if a change called ``name`` is in the store already (a replayed batch).
    """
    m = manifest(spark, path)
    name = name or uuid.uuid4().hex
    if any(c["name"] == name for c in m["changes"]) or any(s["name"] == name for s in m["segments"]):
        return m["version"]
    segments, ids = [], []
    if index is not None:
        segments.append(_write_segment(index, path, name, _centres(spark, path, m["centres"])))
        ids.append(_read(spark, path, "digests", [name]).select("id"))
    if deleted is not None:
        ids.append(deleted.select(F.col("id").cast("bigint").alias("id")))
    n = 0
    if ids:
        every = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        n = _mark_deleted(spark, path, m, every, name)
    changed = {**m, "version": m["version"] + 1, "segments": m["segments"] + segments, "changes": [*m["changes"], {"name": name, "deleted": n}]}
    return _commit(spark, path, changed)


def compact_index(spark: SparkSession, path: str) -> int:
    """Write the living rows as one segment; older versions keep their folders."""
    m = manifest(spark, path)
    name = uuid.uuid4().hex
    segment = _write_segment(read_index(spark, path, m["version"]), path, name, _centres(spark, path, m["centres"]))
    done = [{"name": c["name"], "deleted": 0} for c in m["changes"]] + [{"name": s["name"], "deleted": 0} for s in m["segments"]]
    return _commit(spark, path, {**m, "version": m["version"] + 1, "segments": [segment], "changes": done})


def sync_index(spark: SparkSession, path: str, curated: DataFrame, build) -> int:
    """Bring the store to the state of ``curated``: new and changed records are indexed, vanished ones deleted.

    Records are compared by a digest of their columns, ids and digests alone. ``build`` makes an ``Index`` of the
    records it is given (``build_index``). Without a store the first version is written. Records that are
    indexed are written to the shared folder once, as every table of the index is made from them.
    """
    if not index_versions(spark, path):
        return write_index(build(materialise(curated, "records")), path)
    from corvane.plans.index import with_digest

    curated = materialise(curated, "records")
    now = with_digest(curated).select("id", F.col("digest").alias("now"))
    stored = read_index(spark, path).digests.select("id", F.col("digest").alias("stored"))
    differ = now.join(stored, "id", "full").where(~F.col("now").eqNullSafe(F.col("stored")))
    differ = materialise(differ.select("id", F.col("now").isNull().alias("vanished")), "differ")
    counts = {r["vanished"]: r["n"] for r in differ.groupBy("vanished").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return manifest(spark, path)["version"]
    fresh = differ.where("not vanished").select("id")
    fresh = F.broadcast(fresh) if counts.get(False, 0) <= BROADCAST_KEYS else fresh
    index = build(materialise(curated.join(fresh, "id", "left_semi"), "changed")) if counts.get(False) else None
    return refresh_index(spark, path, index, differ.where("vanished").select("id") if counts.get(True) else None)
