"""An environment of named graphs: sources, imports, names and views.

The catalog, one record for each source, is small and lives on the driver; the
quads are DataFrames throughout.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .operators import catalog, sync, union
from .operators.catalog import VERSION_PROPERTIES
from .plans.lineage import checkpointed, file_system
from .plans.local import local_frame
from .sources import files
from .sources.store import ReadOnlyError, Store, StoreConflict
from .sources.turtle import Parsed
from .terms import DCTERMS, IMPORTS, ONTOLOGY, QUAD_SCHEMA, TYPE, iri, literal
from .view import View, union_view


class UnresolvedImportError(KeyError):
    """A graph is imported and has no source."""


class CapabilityError(RuntimeError):
    """A store cannot do what was asked."""


class StoreChangedError(RuntimeError):
    """The graph store has been changed by someone else since it was catalogued."""


class RecoveryNeededError(RuntimeError):
    """A change of the graph store was not followed by its catalog; ``Environment.recover`` rebuilds it."""


@dataclass
class Config:
    """``policy``: default, latest, version or one given to the environment.  ``remote_cache_ttl_secs``: age from which a remote source is fetched again.  ``root`` is where relative search directories begin; ``external_graph_store`` names a store that is given from outside; a ``temporary`` environment keeps nothing."""

    root: str = "."
    external_graph_store: str | None = None
    temporary: bool = False
    search_directories: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=lambda: list(files.DEFAULT_INCLUDES))
    excludes: list[str] = field(default_factory=list)
    include_ontologies: list[str] = field(default_factory=list)
    exclude_ontologies: list[str] = field(default_factory=list)
    strict: bool = False
    offline: bool = False
    require_ontology_names: bool = False
    use_cached_ontologies: bool = False
    policy: str = "default"
    remote_cache_ttl_secs: int = 86400

    def override(self, **values) -> bool:
        """Set what is given, also to false or empty; the rest stays.  Returns whether anything has changed."""
        known = {f.name for f in fields(self)}
        if unknown := values.keys() - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        before = asdict(self)
        for name, value in values.items():
            setattr(self, name, value)
        return asdict(self) != before


@dataclass
class Record:
    """A source: its graph's name and location, what it imports, and when and with which content it was read."""

    name: str
    location: str
    imports: list[str] = field(default_factory=list)
    last_updated: float = 0.0
    version_properties: dict[str, str] = field(default_factory=dict)
    namespace_map: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, str] = field(default_factory=dict)
    content_hash: str = ""

    @property
    def graph(self) -> str:
        return iri(self.name)


def normal_name(name: str) -> str:
    return name.rstrip("#").rstrip("/")


def record_of(parsed: Parsed, location: str, require_name: bool = False) -> Record:
    """A record from statements, by the rules of the catalog: least declared ontology, least subject of a prefix declaration, location."""
    rows = {(s, p, o) for _, s, p, o in parsed.statements}
    declared = sorted(s for s, p, o in rows if p == TYPE and o == ONTOLOGY)
    prefixed = sorted(s for s, p, _ in rows if p == terms.DECLARE)
    subject = (declared or prefixed or [None])[0]
    if subject is None:
        if require_name:
            raise ValueError(f"{location} declares no ontology")
        subject = iri(location)
    if subject.startswith("_:"):
        raise ValueError(f"the ontology of {location} is a blank node")
    of = lambda s, p: sorted(o for x, y, o in rows if x == s and y == p)
    imports = [o[1:-1] for o in of(subject, IMPORTS) if o.startswith("<") and o != subject]
    versions = {}
    for property_ in VERSION_PROPERTIES:
        values = [v for node in [*of(subject, f"<{terms.VAEM}hasGraphMetadata>"), subject] for v in of(node, iri(property_))]
        if values:
            versions[property_] = values[0]
    namespaces = {}
    for node in sorted(o for _, p, o in rows if p == terms.DECLARE):
        for prefix in of(node, terms.PREFIX)[:1]:
            for namespace in of(node, terms.NAMESPACE)[:1]:
                if prefix.startswith('"') and not namespace.startswith("_:"):
                    namespaces[terms.split(prefix)[1]] = terms.split(namespace)[1]
    return Record(subject[1:-1], location, imports, time.time(), versions, namespaces, dict(parsed.prefixes))


class MemoryGraphs:
    """Graphs by name, as local DataFrames.  All of them together are written once after a change, so that queries read one table."""

    #: Graphs up to which they are just put together.
    FEW = 4

    def __init__(self, spark: SparkSession):
        self.spark, self.frames = spark, {}
        self._all: DataFrame | None = None

    def add_graph(self, name: str, quads: DataFrame) -> None:
        self.frames[name], self._all = quads, None

    def remove_graph(self, name: str) -> None:
        self.frames.pop(name, None)
        self._all = None

    def graph_ids(self) -> list[str]:
        return sorted(self.frames)

    def get_graph(self, name: str) -> DataFrame:
        return self.frames.get(name, local_frame(self.spark, [], QUAD_SCHEMA))

    def quads(self) -> DataFrame:
        if self._all is None:
            out = local_frame(self.spark, [], QUAD_SCHEMA)
            for frame in self.frames.values():
                out = out.unionByName(frame)
            self._all = checkpointed(out.coalesce(8)) if len(self.frames) > self.FEW else out
        return self._all


class StoredGraphs:
    """Graphs in a versioned Parquet store.  Within ``batch`` changes wait, and are published as one version."""

    def __init__(self, store: Store):
        self.store = store
        self.version = store.version()
        self.waiting: dict[str, DataFrame] | None = None

    @contextmanager
    def batch(self) -> Iterator[None]:
        if self.waiting is not None:
            yield
            return
        self.waiting = {}
        try:
            yield
        finally:
            waiting, self.waiting = self.waiting, None
            if waiting:
                self._publish(waiting)

    def _publish(self, changes: dict[str, DataFrame]) -> None:
        quads = local_frame(self.store.spark, [], QUAD_SCHEMA)
        for frame in changes.values():
            quads = quads.unionByName(frame)
        try:
            self.store.replace_graphs(quads, list(changes), self.version)
        except StoreConflict as e:
            raise StoreChangedError(f"{e}; refresh the environment from its store") from e
        self.version = self.store.version()

    def add_graph(self, name: str, quads: DataFrame) -> None:
        if self.waiting is not None:
            self.waiting[name] = quads
        else:
            self._publish({name: quads})

    def remove_graph(self, name: str) -> None:
        self.add_graph(name, local_frame(self.store.spark, [], QUAD_SCHEMA))

    def graph_ids(self) -> list[str]:
        names = {r["graph"] for r in self.store.graphs().select("graph").distinct().collect()}
        for name, quads in (self.waiting or {}).items():
            (names.discard if quads.isEmpty() else names.add)(name)
        return sorted(names)

    def get_graph(self, name: str) -> DataFrame:
        waiting = self.waiting or {}
        return waiting[name] if name in waiting else self.store.graph(name)

    def quads(self) -> DataFrame:
        out = self.store.quads()
        if self.waiting:
            out = out.where(~F.col("graph").isin(*self.waiting))
            for frame in self.waiting.values():
                out = out.unionByName(frame)
        return out

    def graph_revisions(self) -> dict[str, str]:
        """By the listing that the store keeps; the quads are not read."""
        self.version = self.store.version()
        return {r["graph"]: r["revision"] for r in self.store.graphs().groupBy("graph").agg(F.concat_ws(",", F.sort_array(F.collect_list("revision"))).alias("revision")).collect()}


class Environment:
    """Graphs with their catalog.  ``path`` keeps both in a folder; without it they live in memory.

    ``graph_store`` is any object with ``add_graph, get_graph, remove_graph,
    graph_ids`` and ``quads``, and for refreshing ``graph_revisions``.
    ``fetcher`` reads URLs.  ``policies`` are further ways to choose among the
    records of a name, and ``checks`` further reports of ``doctor``.  The folder
    may lie on any file system that Spark reads.
    """

    CATALOG, PENDING = "catalog.json", "pending"

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        config: Config | None = None,
        graph_store=None,
        fetcher: Callable[[str], bytes] | None = None,
        read_only: bool = False,
        recreate: bool = False,
        policies: dict[str, Callable[[list[Record]], Record]] | None = None,
        checks: Sequence[Callable[[Environment], list[str]]] = (),
    ):
        self.spark, self.path, self.fetcher, self.read_only = spark, path, fetcher, read_only
        self.config = config or Config()
        self.policies, self.checks = dict(policies or {}), list(checks)
        self.graphs = graph_store or (StoredGraphs(Store(spark, f"{path}/store", read_only=read_only)) if path else MemoryGraphs(spark))
        self.records: dict[tuple[str, str], Record] = {}
        self.aliases: dict[str, str] = {}
        self.failed: dict[str, str] = {}
        self.revisions: dict[str, str] = {}
        if path and recreate and not read_only:
            self.flush()
        elif path and self._exists(self.CATALOG):
            if self._exists(self.PENDING):
                raise RecoveryNeededError(f"a change of {path} was broken off; Environment.recover rebuilds its catalog")
            self._load()

    # -- files of the folder

    def _at(self, name: str):
        return file_system(self.spark, f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        files_, at = self._at(name)
        return files_.exists(at)

    def _read_text(self, name: str) -> str:
        files_, at = self._at(name)
        stream = files_.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written aside and put in place of what is there."""
        files_, aside = self._at(f".{name}.{os.getpid()}")
        stream = files_.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm, at = self.spark._jvm, self._at(name)[1]
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, at, options)

    # -- lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None, overwrite: bool = False, **more) -> Environment:
        """A new environment; an existing one is an error unless overwritten.  Sources are discovered now unless caching is on."""
        files_, at = file_system(spark, f"{path}/{cls.CATALOG}")
        if files_.exists(at) and not overwrite:
            raise FileExistsError(f"{path} holds an environment")
        env = cls(spark, path, config, recreate=True, **more)
        if not env.config.use_cached_ontologies:
            env.update()
        return env

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, overrides: dict | None = None, **more) -> Environment:
        """An environment that exists; its store is not looked at.  ``overrides`` are kept unless it is opened for reading only."""
        files_, at = file_system(spark, f"{path}/{cls.CATALOG}")
        if not files_.exists(at):
            raise FileNotFoundError(f"{path} holds no environment")
        env = cls(spark, path, read_only=read_only, **more)
        if overrides and env.config.override(**overrides) and not read_only:
            env.flush()
        return env

    load_from_directory = open

    @classmethod
    def open_or_init(cls, spark: SparkSession, path: str, config: Config | None = None, read_only: bool = False, overrides: dict | None = None, **more) -> Environment:
        """The environment at a path, or a new one; with ``read_only`` it must exist."""
        files_, at = file_system(spark, f"{path}/{cls.CATALOG}")
        if files_.exists(at) or read_only:
            return cls.open(spark, path, read_only, overrides, **more)
        config = config or Config()
        config.override(**(overrides or {}))
        return cls.create(spark, path, config, **more)

    @classmethod
    def connect(cls, spark: SparkSession, path: str, graph_store=None, sync: str = "auto", read_only: bool = False, config: Config | None = None, **more) -> Environment:
        """Open or create, and catalog what the store holds.

        ``sync``: ``auto`` where the store tells revisions, ``full`` all of it
        anew, ``catalog`` nothing of an environment that exists.  Sources are
        not looked at.
        """
        if sync not in ("auto", "full", "catalog"):
            raise ValueError(f"unknown mode {sync!r}")
        files_, at = file_system(spark, f"{path}/{cls.CATALOG}")
        if not files_.exists(at):
            if read_only:
                raise FileNotFoundError(f"{path} holds no environment")
            env = cls(spark, path, config, graph_store, recreate=True, **more)
            if hasattr(env.graphs, "graph_revisions") and env.graphs.graph_ids():
                env.refresh_from_store(full=True)
                env.flush()
            return env
        env = cls.open(spark, path, read_only, graph_store=graph_store, **more)
        if sync == "full" or sync == "auto" and hasattr(env.graphs, "graph_revisions"):
            env.refresh_from_store(full=sync == "full")
            if not read_only:
                env.flush()
        return env

    @classmethod
    def recover(cls, spark: SparkSession, path: str, graph_store=None, **more) -> Environment:
        """Rebuild the catalog from the graph store; settings and aliases that can be read are kept."""
        files_, pending = file_system(spark, f"{path}/{cls.PENDING}")
        at = file_system(spark, f"{path}/{cls.CATALOG}")[1]
        old = None
        if files_.exists(at):
            files_.delete(pending, False)
            old = cls(spark, path, graph_store=graph_store, **more)
        env = cls(spark, path, old.config if old else None, graph_store, recreate=True, **more)
        if old:
            env.aliases = old.aliases
            env.records = {k: r for k, r in old.records.items() if r.graph in set(env.graphs.graph_ids())}
        env.refresh_from_store(full=True)
        env.flush()
        return env

    @classmethod
    def adopt(cls, spark: SparkSession, path: str | None, graph_store, config: Config | None = None, overwrite: bool = False) -> Environment:
        """Catalog what a graph store holds already; an environment that exists is an error unless overwritten."""
        if path is not None and not overwrite:
            files_, at = file_system(spark, f"{path}/{cls.CATALOG}")
            if files_.exists(at):
                raise FileExistsError(f"{path} holds an environment")
        env = cls(spark, path, config, graph_store, recreate=path is not None)
        env.refresh_from_store(full=True)
        return env

    def _load(self) -> None:
        state = json.loads(self._read_text(self.CATALOG))
        self.config = Config(**state["config"])
        self.records = {(r["name"], r["location"]): Record(**r) for r in state["records"]}
        self.aliases, self.failed, self.revisions = state["aliases"], state["failed"], state["revisions"]

    def flush(self) -> None:
        """Publish the catalog, which ends a change of the graph store."""
        if self.path is None:
            return
        self._writable()
        state = {"config": asdict(self.config), "records": [asdict(r) for r in self.records.values()], "aliases": self.aliases, "failed": self.failed, "revisions": self.revisions}
        files_, at = self._at("")
        files_.mkdirs(at)
        self._write_text(self.CATALOG, json.dumps(state))
        files_, pending = self._at(self.PENDING)
        files_.delete(pending, False)

    @contextmanager
    def _change(self) -> Iterator[None]:
        """A change of graphs and catalog: one version of the store, and a mark that stays until the catalog follows."""
        self._writable()
        if self.path is not None:
            self._write_text(self.PENDING, "")
        with self.graphs.batch() if hasattr(self.graphs, "batch") else nullcontext():
            yield
        self.flush()

    def catalog(self) -> DataFrame:
        """The records as rows."""
        schema = "name string, location string, imports array<string>, last_updated double, version_properties map<string,string>, namespace_map map<string,string>, prefixes map<string,string>, content_hash string"
        return self.spark.createDataFrame([asdict(r) for r in self.records.values()], schema)

    def catalog_quads(self) -> DataFrame:
        """The records as triples of a graph of their own, for queries."""
        rows = []
        for r in self.records.values():
            about = [(TYPE, ONTOLOGY), (iri(DCTERMS + "source"), literal(r.location)), (iri(DCTERMS + "identifier"), literal(r.content_hash))]
            about += [(IMPORTS, iri(i)) for i in r.imports] + [(iri(p), v) for p, v in r.version_properties.items()]
            rows += [("catalog", iri("urn:quadrille:catalog"), r.graph, p, o) for p, o in about]
        rows += [("catalog", iri("urn:quadrille:catalog"), iri(a), iri(DCTERMS + "isReplacedBy"), iri(n)) for a, n in self.aliases.items()]
        return local_frame(self.spark, rows, QUAD_SCHEMA)

    close = flush

    def __enter__(self) -> Environment:
        return self

    def __exit__(self, *_: object) -> None:
        if not self.read_only:
            self.flush()

    def temporary_snapshot(self) -> Environment:
        """A copy in memory."""
        out = Environment(self.spark, config=Config(**asdict(self.config)), fetcher=self.fetcher)
        out.records = {k: Record(**asdict(r)) for k, r in self.records.items()}
        out.aliases, out.failed = dict(self.aliases), dict(self.failed)
        for name in self.graphs.graph_ids():
            out.graphs.add_graph(name, self.graphs.get_graph(name))
        return out

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError("the environment is open for reading only")

    # -- adding and refreshing

    def _fresh(self, location: str, data: bytes | None) -> Record | None:
        """The record of a location that needs no reading: equal content, or a remote one that is young enough."""
        known = next((r for r in self.records.values() if r.location == location), None)
        if known is None:
            return None
        if data is not None:
            return known if known.content_hash == hashlib.sha256(data).hexdigest() else None
        young = time.time() - known.last_updated <= self.config.remote_cache_ttl_secs
        return known if re.match(r"https?://", location) and young else None

    def _add_one(self, location: str, data: bytes | None, overwrite: bool, force: bool, rename: str | None, format: str | None) -> Record:
        if not force and (known := self._fresh(location, data)) is not None and rename in (None, known.name):
            return known
        data = files.fetch(location, self.config.offline, self.fetcher) if data is None else data
        if not force and (known := self._fresh(location, data)) is not None and rename in (None, known.name):
            return known
        parsed = files.parse_bytes(data, location, format)
        record = record_of(parsed, location, self.config.require_ontology_names)
        record.content_hash = hashlib.sha256(data).hexdigest()
        quads = files.to_frame(self.spark, parsed, record.graph, location)
        if rename and rename != record.name:
            quads = union.rename(quads, record.graph, iri(rename)).withColumn("graph", F.lit(iri(rename)))
            record.imports = [i for i in record.imports if i != rename]
            record.name = rename
        if overwrite or record.graph not in self.graphs.graph_ids():
            for key in [k for k, r in self.records.items() if r.location == location and r.name != record.name]:
                del self.records[key]
            # sources of one name keep their quads apart, by their location as dataset
            others = [r.location for r in self.records.values() if r.name == record.name and r.location != location]
            if others:
                kept = self.graphs.get_graph(record.graph).where(F.col("dataset").isin(*others))
                quads = kept.unionByName(quads)
            self.graphs.add_graph(record.graph, quads)
        self.records[record.name, location] = record
        if re.match(r"https?://", location):
            if normal_name(location) != normal_name(record.name):
                self.aliases[normal_name(location)] = record.name
            else:
                self.aliases.pop(normal_name(location), None)
        return record

    def add(self, location: str, data: bytes | None = None, overwrite: bool = True, fetch_imports: bool = True, force: bool = False, rename: str | None = None, format: str | None = None, max_depth: int | None = None) -> str:
        """Add a source and, breadth first, what it imports and is not known; returns its name.

        An import that cannot be read is remembered as failed, or raises if strict.
        """
        with self._change():
            return self._add(location, data, overwrite, fetch_imports, force, rename, format, max_depth)

    def _add(self, location: str, data: bytes | None, overwrite: bool, fetch_imports: bool, force: bool, rename: str | None, format: str | None, max_depth: int | None) -> str:
        record = self._add_one(location, data, overwrite, force, rename, format)
        queue, seen = [(i, 1) for i in record.imports] if fetch_imports else [], {record.name}
        while queue:
            target, depth = queue.pop(0)
            if target in seen or max_depth is not None and depth > max_depth:
                continue
            seen.add(target)
            try:
                found = self.resolve(target) or self._add_one(target, None, overwrite, force, None, None)
                self.failed.pop(target, None)
                queue += [(i, depth + 1) for i in found.imports]
            except (OSError, ValueError, files.OfflineError) as e:
                if self.config.strict:
                    raise UnresolvedImportError(f"{target}: {e}") from e
                self.failed[target] = str(e)
        self._prune()
        return record.name

    def add_no_imports(self, location: str, data: bytes | None = None, **more) -> str:
        return self.add(location, data, fetch_imports=False, **more)

    def _allowed(self, name: str) -> bool:
        if any(re.search(p, name) for p in self.config.exclude_ontologies):
            return False
        return not self.config.include_ontologies or any(re.search(p, name) for p in self.config.include_ontologies)

    def _remove(self, key: tuple[str, str]) -> None:
        record = self.records.pop(key)
        if not any(r.name == record.name for r in self.records.values()):
            self.graphs.remove_graph(record.graph)

    def _prune(self) -> None:
        for key in [k for k, r in self.records.items() if not self._allowed(r.name)]:
            self._remove(key)

    def update(self, location: str | None = None, force: bool = False, all: bool = False) -> list[str]:
        """Drop sources that have vanished, and read new and changed ones with their imports; returns the names read."""
        if location is not None:
            return [self.add(location, force=True)]
        with self._change():
            return self._update(force, all)

    def _update(self, force: bool, all: bool) -> list[str]:
        self.failed.clear()
        for key in [k for k, r in self.records.items() if not re.match(r"[a-z]+://", r.location) and not r.location.startswith("memory:") and not os.path.exists(r.location)]:
            self._remove(key)
        read = []
        for path in files.find_files([os.path.join(self.config.root, d) for d in self.config.search_directories], self.config.includes, self.config.excludes):
            with open(path, "rb") as file:
                data = file.read()
            if force or all or self._fresh(path, data) is None:
                try:
                    read.append(self._add(path, data, True, True, force or all, None, None, None))
                except ValueError:
                    if self.config.strict:
                        raise
        for record in list(self.records.values()):
            if re.match(r"https?://", record.location) and (force or self._fresh(record.location, None) is None):
                try:
                    read.append(self._add(record.location, None, True, True, True, None, None, None))
                except (OSError, files.OfflineError) as e:
                    self.failed[record.location] = str(e)
        self._prune()
        return read

    def refresh_from_store(self, graphs: Sequence[str] | None = None, full: bool = False) -> sync.SyncReport:
        """Catalog what has changed in the graph store, by its revisions."""
        if not hasattr(self.graphs, "graph_revisions"):
            raise CapabilityError("the graph store gives no revisions")
        now = self.graphs.graph_revisions()
        frame = lambda d: local_frame(self.spark, list(d.items()), "graph string, revision string")
        out = sync.report(frame(self.revisions), frame(now), graphs, full)
        for name in out.removed:
            for key in [k for k, r in self.records.items() if r.graph == name]:
                del self.records[key]
            self.revisions.pop(name, None)
        if changed := [*out.added, *out.changed]:
            # records are worked out where the quads are; one row for each graph comes to the driver
            found = catalog.describe(self.quads().where(F.col("graph").isin(*changed)))
            for r in found.toLocalIterator():
                name = r["graph"]
                old = next((k for k, x in self.records.items() if x.graph == name), None)
                location = self.records.pop(old).location if old else f"store:{name[1:-1]}"
                self.records[name[1:-1], location] = Record(name[1:-1], location, [i[1:-1] for i in r["imports"]], time.time(), dict(r["version_properties"]), dict(r["namespace_map"]))
                self.revisions[name] = now[name]
        return out

    # -- names

    def _choose(self, found: list[Record]) -> Record:
        if self.config.policy in self.policies:
            return self.policies[self.config.policy](sorted(found, key=lambda r: (r.name, r.location)))
        if self.config.policy == "latest":
            return min(found, key=lambda r: (-r.last_updated, r.name, r.location))
        if self.config.policy == "version":
            best = max([r.version_properties.get(p, "0") for p in VERSION_PROPERTIES] for r in found)
            found = [r for r in found if [r.version_properties.get(p, "0") for p in VERSION_PROPERTIES] == best]
        return min(found, key=lambda r: (r.name, r.location))

    def resolver(self) -> Callable[[str], Record | None]:
        """``resolve`` for many names: the records are indexed once, and must not change meanwhile."""
        by_name: dict[str, list[Record]] = {}
        by_location: dict[str, list[Record]] = {}
        for r in self.records.values():
            by_name.setdefault(normal_name(r.name), []).append(r)
            by_location.setdefault(r.location, []).append(r)
        chosen: dict[str, Record | None] = {}

        def resolve(name: str) -> Record | None:
            if name not in chosen:
                wanted = normal_name(name)
                found = by_name.get(normal_name(self.aliases.get(wanted, wanted))) or by_location.get(name)
                chosen[name] = self._choose(found) if found else None
            return chosen[name]

        return resolve

    def resolve(self, name: str) -> Record | None:
        """The record of a name or location: aliases first, then names, by the policy."""
        wanted = normal_name(name)
        wanted = normal_name(self.aliases.get(wanted, wanted))
        found = [r for r in self.records.values() if normal_name(r.name) == wanted] or [r for r in self.records.values() if r.location == name]
        return self._choose(found) if found else None

    def get_ontology(self, name: str) -> Record:
        record = self.resolve(name)
        if record is None:
            known = any(normal_name(name) == normal_name(i) for r in self.records.values() for i in r.imports)
            raise (UnresolvedImportError if known else KeyError)(name)
        return record

    def get_ontology_names(self) -> list[str]:
        return sorted({r.name for r in self.records.values()})

    def add_alias(self, alias: str, name: str) -> None:
        """One step only: the target must be the name of a source."""
        if not any(r.name == name for r in self.records.values()):
            raise KeyError(f"{name} is not the name of a graph")
        self.aliases[normal_name(alias)] = name

    def remove_alias(self, alias: str) -> str | None:
        return self.aliases.pop(normal_name(alias), None)

    def resolve_alias(self, alias: str) -> str | None:
        return self.aliases.get(normal_name(alias))

    def get_aliases_for(self, name: str) -> list[str]:
        return sorted(a for a, n in self.aliases.items() if n == name)

    def rename_graph_iri(self, name: str, new: str) -> str:
        """Give a graph another name, inside its triples too."""
        record = self.get_ontology(name)
        if any(r.name == new for r in self.records.values()):
            raise ValueError(f"{new} is taken")
        with self._change():
            quads = union.rename(self.graphs.get_graph(record.graph), record.graph, iri(new)).withColumn("graph", F.lit(iri(new)))
            # a store of another kind may give the old graph only as long as it has it
            self.graphs.add_graph(iri(new), quads if isinstance(self.graphs, (StoredGraphs, MemoryGraphs)) else checkpointed(quads))
            self.graphs.remove_graph(record.graph)
            del self.records[record.name, record.location]
            self.aliases = {a: new if n == record.name else n for a, n in self.aliases.items()}
            record.name = new
            self.records[new, record.location] = record
        return new

    # -- imports

    def list_closure(self, name: str | DataFrame, depth: int = -1) -> list[str]:
        """The name, then what it imports, breadth first; siblings by name.

        Given triples instead of a name, what they import, without what does
        not resolve; their own root stands first where they have one.
        """
        resolve = self.resolver()
        if isinstance(name, DataFrame):
            root = self._root(name)
            level = [r for t in self._imports_of(name) if (r := resolve(t)) is not None] if depth else []
            level = list({r.name: r for r in sorted(level, key=lambda r: r.name)}.values())
            out, step = ([root[1:-1]] if root else []), 1
            level = [r for r in level if r.name not in out]
            out += [r.name for r in level]
        else:
            record = self.get_ontology(name)
            out, level, step = [record.name], [record], 0
        seen = set(out)
        while level and step != depth:
            step += 1
            found: dict[str, Record] = {}
            for record in level:
                for target in record.imports:
                    hit = resolve(target)
                    if hit is None and self.config.strict:
                        raise UnresolvedImportError(target)
                    if hit is not None and hit.name not in seen:
                        found[hit.name] = hit
            level = [found[n] for n in sorted(found)]
            out += [r.name for r in level]
            seen |= found.keys()
        return out

    def edges(self) -> list[tuple[str, str]]:
        resolve = self.resolver()
        return sorted({(r.name, hit.name) for r in self.records.values() for i in r.imports if (hit := resolve(i)) is not None})

    def get_importers(self, name: str) -> list[str]:
        resolve = self.resolver()
        record = resolve(name)
        wanted = normal_name(record.name if record else name)
        return sorted({r.name for r in self.records.values() for i in r.imports if normal_name(hit.name if (hit := resolve(i)) else i) == wanted})

    def missing_imports(self, name: str | DataFrame | None = None) -> list[str]:
        """Imports without a source: of the closure of a name or of triples, or of all graphs, where failed ones count too."""
        resolve = self.resolver()
        names = set(self.list_closure(name) if name is not None else self.get_ontology_names())
        targets = {i for r in self.records.values() if r.name in names for i in r.imports}
        if isinstance(name, DataFrame):
            targets |= set(self._imports_of(name))
        return sorted({i for i in targets if resolve(i) is None} | (set(self.failed) if name is None else set()))

    def import_paths(self, name: str) -> list[list[str]]:
        """Simple paths from graphs that nothing imports to a graph; to its importers where it has no source."""
        record, edges = self.resolve(name), self.edges()
        above: dict[str, list[str]] = {}
        for a, b in edges:
            above.setdefault(b, []).append(a)
        live = [[record.name]] if record else [[i] for i in self.get_importers(name)]
        out = []
        while live:
            path = live.pop()
            if not above.get(path[0]):
                out.append(path)
            live += [[a, *path] for a in above.get(path[0], []) if a not in path]
        return sorted(out)

    def dep_graph_dot(self, roots: Sequence[str] = ()) -> str:
        names = {n for r in roots for n in self.list_closure(r)} if roots else set(self.get_ontology_names())
        rows = [f'  "{n}";' for n in sorted(names)] + [f'  "{a}" -> "{b}";' for a, b in self.edges() if a in names and b in names]
        return "\n".join(["digraph imports {", *rows, "}", ""])

    # -- graphs and views

    def quads(self) -> DataFrame:
        return self.graphs.quads()

    def _chosen(self, quads: DataFrame) -> DataFrame:
        """Of names with several sources only the quads of the source that the policy chooses."""
        by_name: dict[str, list[Record]] = {}
        for r in self.records.values():
            by_name.setdefault(r.name, []).append(r)
        for name, found in by_name.items():
            if len(found) > 1:
                quads = quads.where((F.col("graph") != iri(name)) | (F.col("dataset") == self._choose(found).location))
        return quads

    def get_graph(self, name: str) -> View:
        record = self.get_ontology(name)
        view = View(self._chosen(self.graphs.get_graph(record.graph)), record.graph)
        view.prefixes = dict(record.prefixes)
        return view

    def get_closure(self, name: str, depth: int = -1, remove_owl_imports: bool = True, rewrite_sh_prefixes: bool = True) -> tuple[View, list[str]]:
        """The closure as one normalised graph of the root."""
        names = self.list_closure(name, depth)
        root = iri(names[0])
        return View(self._normalized([iri(n) for n in names], root, rewrite_sh_prefixes, remove_owl_imports), root), names

    def _normalized(self, graphs: list[str], root: str, rewrite: bool, remove: bool) -> DataFrame:
        return union.normalized_union(self._chosen(self.quads()), graphs, root, rewrite, remove, self.config.strict)

    def copy_closure(self, name: str, depth: int = -1, remove_owl_imports: bool = True, rewrite_sh_prefixes: bool = True) -> tuple[DataFrame, list[str]]:
        view, names = self.get_closure(name, depth, remove_owl_imports, rewrite_sh_prefixes)
        return view.triples(), names

    def _union_names(self, names: Sequence[str], include_closures: bool, depth: int) -> list[str]:
        found = [n for name in names for n in (self.list_closure(name, depth) if include_closures else [self.get_ontology(name).name])]
        return list(dict.fromkeys(found))

    def get_union(self, names: Sequence[str], include_closures: bool = False, depth: int = -1) -> tuple[View, list[str]]:
        """The graphs as they are, each under its name."""
        found = self._union_names(names, include_closures, depth)
        return union_view(self._chosen(self.quads()), [iri(n) for n in found]), found

    def copy_union(self, names: Sequence[str], root: str, include_closures: bool = False, rewrite_sh_prefixes: bool = False, remove_owl_imports: bool = False, depth: int = -1) -> tuple[DataFrame, list[str]]:
        found = self._union_names(names, include_closures, depth)
        return self._normalized([iri(n) for n in found], iri(root), rewrite_sh_prefixes, remove_owl_imports), found

    def copy_graph(self, name: str) -> DataFrame:
        return self.get_graph(name).triples()

    def get_dataset(self) -> View:
        return View(self.quads())

    copy_dataset = quads

    def import_graph(self, destination: DataFrame, name: str, depth: int = -1) -> DataFrame:
        names = self.list_closure(name, depth)
        return union.import_into(destination, self._chosen(self.quads()), [iri(n) for n in names], iri(names[0]))

    def _dependencies(self, triples: DataFrame, depth: int, fetch_missing: bool) -> list[str]:
        targets = self._imports_of(triples)
        names: list[str] = []
        for target in targets:
            if self.resolve(target) is None and fetch_missing:
                try:
                    self.add(target)
                except (OSError, files.OfflineError):
                    continue
            if self.resolve(target) is not None:
                names += [n for n in self.list_closure(target, depth) if n not in names]
        return sorted(names)

    @staticmethod
    def _imports_of(triples: DataFrame) -> list[str]:
        return [r["o"][1:-1] for r in triples.where((F.col("p") == IMPORTS) & F.col("o").startswith("<")).select("o").distinct().orderBy("o").collect()]

    @staticmethod
    def _root(triples: DataFrame) -> str | None:
        own = F.min(F.when(F.col("p") == IMPORTS, F.col("s"))), F.min(F.when((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY), F.col("s")))
        row = triples.agg(*own).first()
        return row[0] or row[1]

    def import_dependencies(self, triples: DataFrame, depth: int = -1, fetch_missing: bool = False) -> tuple[DataFrame, list[str]]:
        """The triples with the closures of their imports, which are gone then; unchanged where no import resolves."""
        names = self._dependencies(triples, depth, fetch_missing)
        if not names:
            return triples, []
        merged = triples.select("s", "p", "o").unionByName(self._chosen(self.quads()).where(F.col("graph").isin(*map(iri, names))).select("s", "p", "o")).distinct()
        root = self._root(triples)
        if root is not None:
            merged = union.collapse_declarations(union.consolidate_prefixes(merged, root), root)
        return union.strip_imports(merged), names

    def get_dependencies(self, triples: DataFrame, graph_name: str | None = None, depth: int = -1, fetch_missing: bool = False) -> tuple[DataFrame, list[str]]:
        """The closures of the imports without the triples themselves: under one declaration and its prefixes where a name is given, and else with each member's own."""
        names = self._dependencies(triples, depth, fetch_missing)
        merged = union.strip_imports(self._chosen(self.quads()).where(F.col("graph").isin(*map(iri, names))).select("s", "p", "o").distinct())
        if graph_name is not None and names:
            root = iri(graph_name)
            merged = union.declare_root(union.collapse_declarations(union.consolidate_prefixes(merged, root), root), root)
        elif names:
            declared = local_frame(self.spark, [(iri(n), TYPE, ONTOLOGY) for n in names], "s string, p string, o string")
            merged = merged.unionByName(declared).distinct()
        return merged, names

    # -- reports

    def get_namespaces(self, name: str | None = None, include_closure: bool = False) -> dict[str, str]:
        """Prefixes of the text and then of declarations; later graphs of a closure, or greater names of all graphs, win."""
        names = self.get_ontology_names() if name is None else self.list_closure(name) if include_closure else [self.get_ontology(name).name]
        out: dict[str, str] = {}
        for n in names:
            record = self.get_ontology(n)
            out |= record.prefixes | record.namespace_map
        return out

    def doctor(self) -> list[str]:
        """Duplicate names, graphs with no or several declarations, prefixes with several namespaces."""
        problems = []
        by_name: dict[str, list[str]] = {}
        for r in self.records.values():
            by_name.setdefault(r.name, []).append(r.location)
        problems += [f"{n} has several sources: {', '.join(sorted(x))}" for n, x in sorted(by_name.items()) if len(x) > 1]
        counts = self.quads().groupBy("graph").agg(F.count_distinct(F.when((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY), F.col("s"))).alias("n"))
        problems += [f"{r['graph'][1:-1]} has {r['n'] or 'no'} declarations" for r in counts.where("n <> 1").orderBy("graph").collect()]
        spaces: dict[str, set[str]] = {}
        for r in self.records.values():
            for p, n in r.namespace_map.items():
                spaces.setdefault(p, set()).add(n)
        problems += [x for check in self.checks for x in check(self)]
        return problems + [f"prefix {p} has several namespaces: {', '.join(sorted(n))}" for p, n in sorted(spaces.items()) if len(n) > 1]

    def status(self) -> dict[str, object]:
        return {
            "graphs": len(self.graphs.graph_ids()), "triples": self.quads().select("graph", "s", "p", "o").distinct().count(), "sources": len(self.records),
            "last_updated": max((r.last_updated for r in self.records.values()), default=None), "missing_imports": self.missing_imports(), "store": self.store_path(), "failed": dict(self.failed), "aliases": len(self.aliases),
        }

    def dump(self, contains: str | None = None) -> str:
        rows = [f"{r.name}\n  location: {r.location}\n" + "".join(f"  imports: {i}\n" for i in r.imports) for r in sorted(self.records.values(), key=lambda r: (r.name, r.location)) if not contains or contains in r.name]
        return "".join(rows)

    def store_path(self) -> str | None:
        return f"{self.path}/store" if self.path else None

    def __len__(self) -> int:
        return len(self.records)

    def __contains__(self, name: str) -> bool:
        return self.resolve(name) is not None

    def __getitem__(self, name: str) -> View:
        return self.get_graph(name)

    def __iter__(self):
        return iter(self.get_ontology_names())
