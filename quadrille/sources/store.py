"""A versioned store of quads in Parquet.

Each version is a folder of its own, partitioned by a bucket of the graph's
name and sorted within each file.  Quads are kept once for each of ``orders``:
by subject, and by predicate and object, so that a scan with a bound subject,
or with a bound predicate or object, prunes row groups by their statistics.  A
pointer file names what a version consists of, and its number the version.  It
is written aside and renamed into place where no file of that number exists,
so readers see the old version or the new one and nothing between, and of two
writers that began with one version the later gets a ``StoreConflict``.
Changing some graphs rewrites only the buckets that hold them: the others are
named by the manifest of the new version where they lie.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan as scans
from ..plans.local import local_frame
from ..terms import ONTOLOGY, QUAD_COLUMNS, QUAD_SCHEMA, TYPE

POINTER = "version-"
ORDERS = (("s", "p", "o"), ("p", "o", "s"))
COUNTS = "dataset string, graph string, n_triples long, revision string"


class ReadOnlyError(PermissionError):
    pass


class StoreConflict(RuntimeError):
    """The store has another version than the one that a change began with."""


class Store:
    """``integrity``: ``strict`` compares stored counts with the quads when a version is opened, ``structural`` checks that all files of a version are there, ``trusted`` neither."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, read_only: bool = False, orders: Sequence[Sequence[str]] = ORDERS, integrity: str = "structural"):
        if integrity not in ("strict", "structural", "trusted"):
            raise ValueError(f"unknown integrity mode {integrity!r}")
        self.spark, self.path, self.buckets, self.read_only = spark, path.rstrip("/"), buckets, read_only
        self.orders, self.integrity = tuple(tuple(o) for o in orders), integrity
        self._checked: int | None = None

    # -- files, on whatever file system the path names

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> str:
        system, path = self._file(name)
        stream = system.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """A file that must not exist yet, complete at once."""
        system, aside = self._file(f".{name}.{uuid.uuid4().hex}")
        stream = system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, path = self._file(name)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(aside, path, options)
        except Py4JJavaError as e:
            system.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise StoreConflict(f"{self.path} has got another version meanwhile") from e
            raise

    # -- versions

    def version(self) -> int:
        """The current version; 0 where nothing is stored."""
        system, folder = self._file("")
        if not system.exists(folder):
            return 0
        found = [s.getPath().getName() for s in system.listStatus(folder)]
        return max((int(n.removeprefix(POINTER)) for n in found if n.startswith(POINTER)), default=0)

    def manifest(self) -> dict:
        version = self.version()
        if not version:
            return {"version": 0, "buckets": self.buckets, "orders": [list(o) for o in self.orders], "folders": {}, "counts": {}}
        found = json.loads(self._read(f"{POINTER}{version:08d}"))
        if self._checked != version:
            self._check(found)
            self._checked = version
        return found

    def _check(self, manifest: dict) -> None:
        if self.integrity == "trusted":
            return
        for folder in (f for folders in (*manifest["folders"].values(), manifest["counts"]) for f in folders.values()):
            system, path = self._file(folder)
            if not system.exists(path):
                raise OSError(f"{self.path}/{folder} is missing")
        if self.integrity == "strict":
            stored = self._counts(manifest).groupBy().agg(F.sum("n_triples")).first()[0] or 0
            for order in manifest["folders"]:
                if (held := self._quads(manifest, order).count()) != stored:
                    raise OSError(f"{self.path} holds {held} quads in order {order} and should hold {stored}")

    def _bucket(self, graph, buckets: int):
        return F.pmod(F.xxhash64(graph), F.lit(buckets)).cast("int")

    def _buckets_of(self, names: Sequence[str], buckets: int) -> set[str]:
        rows = local_frame(self.spark, [(n,) for n in names], "graph string").select(self._bucket(F.col("graph"), buckets).alias("b")).distinct().collect()
        return {str(r["b"]) for r in rows}

    def _table(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return local_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _quads(self, manifest: dict, order: str, buckets: set[str] | None = None) -> DataFrame:
        folders = manifest["folders"].get(order, {})
        return self._table(QUAD_SCHEMA, sorted(f for b, f in folders.items() if buckets is None or b in buckets))

    def _counts(self, manifest: dict) -> DataFrame:
        return self._table(COUNTS, sorted(manifest["counts"].values()))

    def quads(self) -> DataFrame:
        manifest = self.manifest()
        return self._quads(manifest, "".join(manifest["orders"][0]))

    def graph(self, *names: str) -> DataFrame:
        """Quads of named graphs, from their buckets only."""
        return self.scan(names=names)

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
        """Quads that match, from the copy that is sorted best for what is bound, and from the buckets of the named graphs only."""
        manifest = self.manifest()
        bound = {c for c, term in zip("spo", (s, p, o), strict=True) if term is not None}

        def fit(order: list[str]) -> int:
            return next((k for k, c in enumerate(order) if c not in bound), len(order))

        order = max(manifest["orders"], key=fit)
        found = self._quads(manifest, "".join(order), None if names is None else self._buckets_of(names, manifest["buckets"]))
        return scans.matching(found if names is None else found.where(F.col("graph").isin(*names)), s, p, o)

    def _publish(self, quads: DataFrame, manifest: dict, touched: set[str] | None) -> None:
        """The next version: these quads in the touched buckets, or in all, and the rest of the manifest as it is."""
        version, buckets = manifest["version"] + 1, manifest["buckets"]
        name = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        rows = quads.select(*QUAD_COLUMNS).dropDuplicates(["dataset", "graph", "s", "p", "o"]).withColumn("bucket", self._bucket(F.col("graph"), buckets))
        made: dict[str, dict[str, str]] = {}
        source = rows
        for order in manifest["orders"]:
            folder = f"{name}/{''.join(order)}"
            # a hot graph's rows are dealt by their first column as well, so that no task writes a whole bucket
            dealt = source.repartition("bucket", F.pmod(F.xxhash64(order[0], order[1]), F.lit(8))).sortWithinPartitions("bucket", *order)
            dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
            made["".join(order)] = self._folders(folder)
            # the other copies are made from the first
            source = self.spark.read.schema(QUAD_SCHEMA + ", bucket int").parquet(f"{self.path}/{folder}") if made["".join(order)] else rows.limit(0)
        revision = F.hex(F.sum(F.xxhash64("s", "p", "o").cast("decimal(38,0)")).cast("string").cast("binary"))
        counts = source.groupBy("dataset", "graph", "bucket").agg(F.count(F.lit(1)).alias("n_triples"), revision.alias("revision"))
        counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/counts")
        kept = lambda folders: {} if touched is None else {b: f for b, f in folders.items() if b not in touched}
        after = {
            "version": version, "buckets": buckets, "orders": manifest["orders"], "counts": kept(manifest["counts"]) | self._folders(f"{name}/counts"),
            "folders": {order: kept(manifest["folders"].get(order, {})) | folders for order, folders in made.items()},
        }
        self._create(f"{POINTER}{version:08d}", json.dumps(after))

    def _folders(self, folder: str) -> dict[str, str]:
        system, path = self._file(folder)
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError(f"the store {self.path} is open for reading only")

    def write(self, quads: DataFrame) -> None:
        """All quads anew."""
        self._writable()
        now = self.manifest()
        self._publish(quads, {"version": now["version"], "buckets": self.buckets, "orders": [list(o) for o in self.orders], "folders": {}, "counts": {}}, None)

    def replace_graphs(self, quads: DataFrame, names: Sequence[str], expected: int | None = None) -> None:
        """Named graphs in place of what they were; no quads remove them.  ``expected`` is the version that the change rests on, by default the current one."""
        self._writable()
        manifest = self.manifest()
        if expected is not None and manifest["version"] != expected:
            raise StoreConflict(f"{self.path} has version {manifest['version']} and not {expected}")
        touched = self._buckets_of(names, manifest["buckets"])
        rows = quads.where(F.col("graph").isin(*names)).select(*QUAD_COLUMNS)
        old = self._quads(manifest, "".join(manifest["orders"][0]), touched)
        self._publish(old.where(~F.col("graph").isin(*names)).unionByName(rows), manifest, touched)

    def write_graph(self, triples: DataFrame, name: str | None = None, dataset: str = "graph") -> str:
        """Store triples as one graph, named as given or by the least ontology that they declare; returns the name."""
        if name is None:
            name = triples.where((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY)).agg(F.min("s")).first()[0]
            if name is None:
                raise ValueError("the triples declare no ontology, so the graph needs a name")
        self.replace_graphs(triples.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("graph"), "s", "p", "o"), [name])
        return name

    def remove_graph(self, name: str) -> None:
        self.replace_graphs(local_frame(self.spark, [], QUAD_SCHEMA), [name])

    def graphs(self) -> DataFrame:
        """``dataset, graph, n_triples, revision``, as stored with the quads: the revision is a hash of the triples, whatever their order."""
        return self._counts(self.manifest())

    def triple_count(self, dataset: str, graph: str) -> int:
        """Triples of one physical graph, by the stored count."""
        return self.graphs().where((F.col("dataset") == dataset) & (F.col("graph") == graph)).agg(F.sum("n_triples")).first()[0] or 0

    def vacuum(self) -> list[str]:
        """Delete pointers of older versions and the folders that the current one does not name; only where no reader is left that began before."""
        self._writable()
        manifest = self.manifest()
        used = {f.split("/")[0] for folders in (*manifest["folders"].values(), manifest["counts"]) for f in folders.values()} | {f"{POINTER}{manifest['version']:08d}"}
        system, folder = self._file("")
        gone = sorted(n for n in (s.getPath().getName() for s in system.listStatus(folder)) if n not in used)
        for name in gone:
            system.delete(self._file(name)[1], True)
        return gone
