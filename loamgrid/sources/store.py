"""A store of several tables under one version.

Rows belong to a parent (a document, an element), and a parent is replaced or removed as a unit in all tables at
once. A change is a layer: the new rows of its parents in a folder of each table, and a mark for each parent with
its fingerprint, or one that says that it is gone. A version is a small file that lists the layers that count; it is
put in place last, by a rename that fails if another writer was first. So readers see all of a change or nothing,
a writer that dies leaves folders that no version names, and unchanged input adds nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable, evenly

LAYER, MARK, GONE = "__layer", "__fingerprint", "__gone"


def _number() -> Column:
    """The number with which a layer's name begins; a version holds one layer of a number."""
    return F.substring(LAYER, 1, 10).cast("int")


class VersionConflict(RuntimeError):
    """Another writer put the next version in place first; take its state and try again."""


class RecordStore:
    """Tables in ``folder`` whose rows have a ``parent`` column. Past ``most_layers`` layers are merged into one.

    Up to ``few`` counted ids of parents that later layers replaced are broadcast when rows are read.
    """

    def __init__(self, spark: SparkSession, folder: str, parent: str, most_layers: int = 8, few: int = 1_000_000):
        self.spark, self.folder, self.parent, self.most_layers, self.few = spark, folder, parent, most_layers, few

    # --- versions -------------------------------------------------------------------------------------------------

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Numbers of the versions that are in place, ascending."""
        fs, where = self._fs(posixpath.join(self.folder, "versions"))
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _version_path(self, number: int) -> str:
        return posixpath.join(self.folder, "versions", f"v{number:010d}.json")

    def manifest(self, number: int | None = None) -> dict:
        """A version (the last one by default): its number, the layers that count, oldest first, and the stream batches that it holds."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return {"version": 0, "layers": [], "batches": {}}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(self._version_path(number)).collect()))

    def _publish(self, manifest: dict) -> None:
        """Puts the version in place: written under another name, then renamed; the rename fails if the version is there."""
        final, temporary = self._version_path(manifest["version"]), posixpath.join(self.folder, "versions", f".{uuid.uuid4().hex}")
        fs, where = self._fs(temporary)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(where, jvm.org.apache.hadoop.fs.Path(final), options)
        except Exception as e:
            fs.delete(where, False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"version {manifest['version']} is there already") from e
            raise

    # --- reading --------------------------------------------------------------------------------------------------

    def _paths(self, manifest: dict, table: str) -> list[str]:
        return [posixpath.join(self.folder, "tables", table, f"{LAYER}={x['name']}") for x in manifest["layers"] if table in x["tables"]]

    def _stored(self, manifest: dict, table: str) -> DataFrame | None:
        paths = self._paths(manifest, table)
        if not paths:
            return None
        read = self.spark.read.option("basePath", posixpath.join(self.folder, "tables", table)).option("mergeSchema", "true")
        return read.parquet(*paths).withColumn(LAYER, F.col(LAYER).cast("string"))

    def marks(self, manifest: dict | None = None) -> DataFrame | None:
        """(parent, fingerprint) of the parents that a version holds; None if it is empty."""
        stored = self._stored(manifest or self.manifest(), "__marks")
        if stored is None:
            return None
        last = stored.groupBy(self.parent).agg(F.max_by(F.struct(MARK, GONE), LAYER).alias("m"))
        return last.where(f"not m.{GONE}").select(self.parent, F.col(f"m.{MARK}").alias(MARK))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version: those whose parent no later layer replaced or removed."""
        manifest = self.manifest(version)
        return self._current(manifest, table, self._superseded(manifest))

    def _superseded(self, manifest: dict) -> DataFrame | None:
        """(parent, number of a layer) of what a later layer replaced or removed, stored, and broadcast where it is counted to be few; None for a single layer."""
        if len(manifest["layers"]) < 2:
            return None
        marks = self._stored(manifest, "__marks").select(F.col(self.parent).alias("__of"), _number().alias("__in"))
        newest = marks.groupBy("__of").agg(F.max("__in").alias("__newest"), F.count("*").alias("__n")).where("__n > 1")
        old = durable(marks.join(newest, "__of").where("__in < __newest").select("__of", "__in"))
        return F.broadcast(old) if old.count() <= self.few else evenly(old, "__of", "__in")

    def _current(self, manifest: dict, table: str, old: DataFrame | None) -> DataFrame:
        rows = self._stored(manifest, table)
        if rows is None:
            raise KeyError(f"no version of {table}")
        if old is not None:
            rows = rows.withColumn(LAYER, _number()).join(old, (F.col(self.parent) == F.col("__of")) & (F.col(LAYER) == F.col("__in")), "left_anti")
        return rows.drop(LAYER)

    # --- writing --------------------------------------------------------------------------------------------------

    def commit(self, tables: dict[str, DataFrame], marks: DataFrame, batch: tuple[str, int] | None = None, whole: bool = False) -> dict:
        """One layer: ``marks`` (parent, fingerprint, gone) and, for the parents that stay, all their rows in ``tables``; rows of others aren't written.

        ``marks`` are found once. With ``whole``, they hold every parent of the tables, so rows needn't meet them; they are sorted in their tasks,
        as a join would leave them, which keeps files small.
        ``batch`` names a stream's batch; one that a version holds already is left alone, so it can be done twice.
        Nothing is written where no parent changes, except that the batch is noted.
        """
        before = self.manifest()
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before
        marks = durable(marks.select(self.parent, F.col(MARK).cast("string").alias(MARK), F.col(GONE).cast("boolean").alias(GONE)).where(F.col(self.parent).isNotNull()))
        after = {"version": before["version"] + 1, "layers": list(before["layers"]), "batches": {**before["batches"], **({batch[0]: batch[1]} if batch else {})}}
        if marks.limit(1).count():
            stay = marks.where(f"not {GONE}").select(self.parent)
            own = {t: rows.where(F.col(self.parent).isNotNull()).sortWithinPartitions(self.parent) if whole else rows.join(stay, self.parent, "left_semi") for t, rows in tables.items()}
            after["layers"].append(self._write_layer(after["version"], own, marks))
        elif not batch:
            return before
        self._publish(after)
        return self.compact() if len(after["layers"]) > self.most_layers else after

    def _write_layer(self, number: int, tables: dict[str, DataFrame], marks: DataFrame) -> dict:
        name = f"{number:010d}-{uuid.uuid4().hex}"
        for table, rows in {**tables, "__marks": marks}.items():
            rows.write.parquet(posixpath.join(self.folder, "tables", table, f"{LAYER}={name}"))
        return {"name": name, "tables": [*tables, "__marks"]}

    def replace(self, tables: dict[str, DataFrame], fingerprints: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """Replaces parents as units: those in ``fingerprints`` (parent, fingerprint) have the given rows from now on, and no others."""
        return self.commit(tables, fingerprints.select(self.parent, MARK, F.lit(False).alias(GONE)), batch)

    def replace_all(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> dict:
        """Replaces every parent that ``tables`` hold, changed or not; others stay as they are."""
        return self.commit(tables, fingerprints(tables, self.parent).withColumn(GONE, F.lit(False)), batch, whole=True)

    def remove(self, parents: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """Removes parents with all their rows; ids that the store doesn't hold are ignored."""
        held = self.marks()
        if held is None:
            return self.manifest()
        gone = held.join(parents.select(self.parent).distinct(), self.parent, "left_semi")
        return self.commit({}, gone.select(self.parent, F.lit(None).alias(MARK), F.lit(True).alias(GONE)), batch)

    def remove_orphans(self, alive: DataFrame) -> dict:
        """Removes the parents that ``alive`` no longer lists."""
        held = self.marks()
        return self.manifest() if held is None else self.remove(held.join(alive.select(self.parent), self.parent, "left_anti"))

    # --- upkeep ---------------------------------------------------------------------------------------------------

    def compact(self) -> dict:
        """All layers merged into one; the version changes last, so a merge that dies leaves the layers as they were."""
        before = self.manifest()
        if len(before["layers"]) < 2:
            return before
        names = sorted({t for x in before["layers"] for t in x["tables"]} - {"__marks"})
        marks = self.marks(before).withColumn(GONE, F.lit(False))
        old = self._superseded(before)
        layer = self._write_layer(before["version"] + 1, {t: self._current(before, t, old) for t in names}, marks)
        after = {**before, "version": before["version"] + 1, "layers": [layer]}
        self._publish(after)
        return after

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions before the last ``keep`` and every layer folder that none of the kept ones names; how many folders went.

        Not to be run beside a writer: its layer isn't named yet.
        """
        numbers = self.versions()
        kept = {x["name"] for n in numbers[-keep:] for x in self.manifest(n)["layers"]}
        gone = 0
        for n in numbers[:-keep]:
            fs, where = self._fs(self._version_path(n))
            fs.delete(where, False)
        fs, top = self._fs(posixpath.join(self.folder, "tables"))
        for table in fs.listStatus(top) if fs.exists(top) else []:
            for layer in fs.listStatus(table.getPath()):
                if layer.getPath().getName().removeprefix(f"{LAYER}=") not in kept:
                    gone += bool(fs.delete(layer.getPath(), True))
        return gone

    def counts(self, version: int | None = None) -> DataFrame:
        """(table, n_rows, n_parents) of every table at a version."""
        manifest = self.manifest(version)
        names = sorted({t for x in manifest["layers"] for t in x["tables"]} - {"__marks"})
        old = self._superseded(manifest)
        each = [self._current(manifest, t, old).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.count_distinct(self.parent).alias("n_parents")) for t in names]
        return reduce(DataFrame.unionByName, each)


def fingerprints(tables: dict[str, DataFrame], parent: str) -> DataFrame:
    """(parent, fingerprint) over all rows of all tables: a count, a sum and an exclusive or of row hashes, so a parent's rows needn't meet.

    They are combined in each table first, which moves nothing where a table is dealt by parent, and then over the tables.
    """
    each = []
    for name, rows in sorted(tables.items()):
        columns = sorted(c for c in rows.columns if c != parent)
        row = F.to_json(F.struct(*[F.col(c) for c in columns])) if columns else F.lit("")
        one = rows.select(parent, F.sha2(F.concat(F.lit(f"{name}:"), row), 256).alias("h"))
        parts = one.where(F.col(parent).isNotNull()).select(parent, F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(20,0)").alias("a"), F.conv(F.substring("h", 17, 15), 16, 10).cast("long").alias("b"))
        each.append(parts.groupBy(parent).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.bit_xor("b").alias("b")))
    print_ = F.concat_ws(":", F.sum("n").cast("string"), F.sum("a").cast("string"), F.bit_xor("b").cast("string"))
    return reduce(DataFrame.unionByName, each).groupBy(parent).agg(print_.alias(MARK))


def changed(store: RecordStore, prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` (parent, fingerprint) that the store doesn't hold as they are."""
    held = store.marks()
    return prints if held is None else prints.join(held, [store.parent, MARK], "left_anti")

