"""Files and bytes of RDF: discovery, formats with fallbacks, and distributed parsing."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import file_system
from ..plans.local import local_frame
from ..plans.workers import ship_code
from ..terms import QUAD_COLUMNS
from . import jsonld, ntriples, rdfxml, turtle
from .turtle import Parsed, RdfSyntaxError

# Formats by file ending, and the default patterns of discovery.
ENDINGS = {"ttl": "turtle", "n3": "turtle", "nt": "ntriples", "nq": "nquads", "trig": "trig", "xml": "rdfxml", "rdf": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}
DEFAULT_INCLUDES = ("*.ttl", "*.xml", "*.n3")
FALLBACKS = ("turtle", "rdfxml", "ntriples", "nquads", "trig", "jsonld")

_PARSERS: dict[str, Callable[[str, str, str], Parsed]] = {
    "turtle": lambda text, base, scope: turtle.parse(text, base, scope),
    "ntriples": lambda text, base, scope: turtle.parse(text, "", scope),
    "nquads": lambda text, base, scope: turtle.parse(text, "", scope, graphs=True),
    "trig": lambda text, base, scope: turtle.parse(text, base, scope, graphs=True),
    "rdfxml": rdfxml.parse,
    "jsonld": jsonld.parse,
}


class OfflineError(RuntimeError):
    """A fetch was asked for while offline."""


def format_of(path: str) -> str | None:
    return ENDINGS.get(path.rsplit(".", 1)[-1].lower()) if "." in os.path.basename(path) else None


def sniff(data: bytes) -> str | None:
    """A format by the first 4096 bytes, or none."""
    head = data[:4096].decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if head.startswith(("{", "[")) and re.search(r'"@(?:context|id|graph|type)"', head):
        return "jsonld"
    if head.startswith("<?xml") or "<rdf:RDF" in head:
        return "rdfxml"
    if re.search(r"(?im)^\s*(?:@prefix|@base|prefix\s|base\s)", head):
        return "trig" if re.search(r"(?m)^\s*(?:GRAPH\s+)?(?:<[^>]*>|[\w-]*:[\w-]*)?\s*\{", head) else "turtle"
    if re.match(r"(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+\S", head):
        return "ntriples"
    return None


def scope_of(location: str) -> str:
    """A prefix for blank node labels, one for each source."""
    return hashlib.sha1(location.encode()).hexdigest()[:12] + "x"


def parse_bytes(data: bytes, location: str = "", preferred: str | None = None, named_graphs: bool = False) -> Parsed:
    """Statements of a text, by the preferred format, the location's, what the text looks like, and then all others.

    The first format that the whole text parses in wins.  Named graphs are an
    error unless asked for.
    """
    text = data.decode("utf-8-sig")
    order = [f for f in (preferred, format_of(location), sniff(data), *FALLBACKS) if f]
    first: Exception | None = None
    for kind in dict.fromkeys(order):
        try:
            out = _PARSERS[kind](text, location, scope_of(location))
            if not named_graphs and any(g is not None for g, *_ in out.statements):
                raise RdfSyntaxError("named graphs are not expected here")
            return out
        except ValueError as e:
            first = first or e
    raise RdfSyntaxError(f"{location or 'the text'} parses in no format; {order[0]}: {first}")


def is_included(path: str, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> bool:
    """Excludes win; no includes take everything; a bare folder stands for all below it."""

    def hits(patterns: Sequence[str]) -> bool:
        return any(fnmatch.fnmatch(path, p) or fnmatch.fnmatch(os.path.basename(path), p) or fnmatch.fnmatch(path, p.rstrip("/") + "/*") or fnmatch.fnmatch(path, "*/" + p.rstrip("/") + "/*") for p in patterns)

    return not hits(excludes) and (not includes or hits(includes))


def _glob(pattern: str) -> str:
    """A pattern for a whole path: by the path, by its last part, or as a folder above it."""
    folder = pattern.rstrip("/") + "/*"
    return "|".join(f"^(?:{fnmatch.translate(p)})" for p in (pattern, "*/" + pattern, folder, "*/" + folder)).replace("\\Z", "$").replace("\\z", "$")


def included(path: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """``is_included`` of a column of paths."""
    hits = lambda patterns: reduce(lambda a, b: a | b, (path.rlike(_glob(p)) for p in patterns), F.lit(False))
    return ~hits(excludes) & (hits(includes) if includes else F.lit(True))


def find_files(locations: Sequence[str], includes: Sequence[str] = DEFAULT_INCLUDES, excludes: Sequence[str] = ()) -> list[str]:
    """Files below the locations that the patterns take, sorted; a location that is a file is taken as it is."""
    found = set()
    for location in locations:
        if os.path.isfile(location):
            found.add(os.path.abspath(location))
        for folder, _, names in os.walk(location):
            found |= {os.path.abspath(os.path.join(folder, n)) for n in names if is_included(os.path.join(folder, n), includes, excludes)}
    return sorted(found)


def list_files(spark: SparkSession, locations: Sequence[str], includes: Sequence[str] = DEFAULT_INCLUDES, excludes: Sequence[str] = ()) -> DataFrame:
    """``location, modified, size`` of what ``find_files`` finds, on any file system that Spark reads."""
    found: dict[str, tuple[str, int, int]] = {}
    for location in locations:
        files, at = file_system(spark, location)
        if not files.exists(at):
            continue
        single = files.getFileStatus(at).isFile()
        each = files.listFiles(at, True)
        while each.hasNext():
            status = each.next()
            path = status.getPath().toString()
            if single or is_included(path.removeprefix("file:"), includes, excludes):
                found[path] = (path, status.getModificationTime(), status.getLen())
    return local_frame(spark, sorted(found.values()), "location string, modified long, size long")


STATEMENTS = "location string, graph string, s string, p string, o string, error string"


def _takes(path: Column, patterns: Sequence[str]) -> Column:
    """Whether some pattern matches a path's end; none take everything."""
    wanted = F.lit(not patterns)
    for p in patterns:
        wanted = wanted | path.rlike(fnmatch.translate("*/" + p))
    return wanted


def parse_files(spark: SparkSession, paths: str | Sequence[str], includes: Sequence[str] = (), named_graphs: bool = False, excludes: Sequence[str] = ()) -> DataFrame:
    """``location, graph, s, p, o, error`` of files, each parsed whole by one task; a file that does not parse gives one row with its error."""
    ship_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    files = files.where(_takes(F.col("path"), includes))
    if excludes:
        files = files.where(~_takes(F.col("path"), excludes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATEMENTS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, g, s, p, o, None) for g, s, p, o in parse_bytes(bytes(content), path, named_graphs=named_graphs).statements]
                except ValueError as e:
                    rows = [(path, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, STATEMENTS)


#: Patterns of the files that are read line by line inside the JVM, and so may be of any size.
BY_LINE = ("*.nt", "*.nq")


def read_statements(spark: SparkSession, paths: str | Sequence[str], includes: Sequence[str] = (), named_graphs: bool = False) -> DataFrame:
    """``location, graph, s, p, o, error``: N-Triples and N-Quads line by line, where an error is a line's, and other files whole, where it is the file's."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    others = parse_files(spark, paths, includes, named_graphs, excludes=BY_LINE)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.n[tq]").text(paths).select("value", F.input_file_name().alias("location"))
    scope = F.concat(F.substring(F.sha1("location"), 1, 12), F.lit("x"))
    found = ntriples.parse_lines(lines.where(_takes(F.col("location"), includes)), "value", scope, ("location",), errors=True)
    bad = F.col("error").isNotNull()
    if not named_graphs:
        wrong = F.col("graph").isNotNull()
        found = found.withColumn("error", F.when(wrong, F.lit("named graphs are not expected here")).otherwise(F.col("error")))
        bad = bad | wrong
    null = F.lit(None).cast("string")
    kept = (F.when(~bad, F.col(c)).otherwise(null).alias(c) for c in ("graph", "s", "p", "o"))
    return others.unionByName(found.select("location", *kept, "error"))


def read_errors(spark: SparkSession, paths: str | Sequence[str], includes: Sequence[str] = (), named_graphs: bool = False) -> DataFrame:
    """``location, error, n``: what does not parse, by file, with how many lines or files it is."""
    found = read_statements(spark, paths, includes, named_graphs).where(F.col("error").isNotNull())
    return found.groupBy("location").agg(F.min("error").alias("error"), F.count(F.lit(1)).alias("n"))


def read_quads(spark: SparkSession, paths: str | Sequence[str], includes: Sequence[str] = (), strict: bool = True, named_graphs: bool = False, dataset: str = "file") -> DataFrame:
    """Quads of files; statements without a graph go to the graph of their file.

    What does not parse raises; unless ``strict``, it is left out, a line of
    N-Triples or N-Quads alone, of other formats the file, and ``read_errors``
    lists it.
    """
    found = read_statements(spark, paths, includes, named_graphs)
    raised = F.raise_error(F.concat("location", F.lit(": "), "error")).cast("boolean")
    rows = found.where(F.when(F.col("error").isNull(), True).otherwise(raised)) if strict else found.where(F.col("error").isNull())
    graph = F.coalesce("graph", F.concat(F.lit("<"), F.col("location"), F.lit(">")))
    return rows.select(F.lit(dataset).alias("dataset"), graph.alias("graph"), "s", "p", "o").dropDuplicates()


def to_frame(spark: SparkSession, parsed: Parsed, graph: str, dataset: str = "memory") -> DataFrame:
    """Parsed statements as quads of a graph."""
    rows = sorted({(dataset, g or graph, s, p, o) for g, s, p, o in parsed.statements})
    # from Arrow it is a local relation, whose size the optimizer knows
    columns = {name: pa.array([r[k] for r in rows], pa.string()) for k, name in enumerate(QUAD_COLUMNS)}
    return spark.createDataFrame(pa.table(columns))


#: Media types of the formats, most welcome first.
MEDIA = {"turtle": "text/turtle", "rdfxml": "application/rdf+xml", "ntriples": "application/n-triples", "jsonld": "application/ld+json", "trig": "application/trig", "nquads": "application/n-quads"}


def accept_header() -> str:
    """What a fetcher should ask for, with falling weights."""
    return ", ".join(f"{media};q={1 - k / 10:g}" if k else media for k, media in enumerate(MEDIA.values())) + ", */*;q=0.1"


def format_of_media(media: str | None) -> str | None:
    """The format of a content type, or none."""
    kind = (media or "").split(";")[0].strip().lower()
    return next((f for f, m in MEDIA.items() if m == kind), None)


def candidates(location: str, links: Sequence[tuple[str, str]] = ()) -> list[str]:
    """Where else a document may lie: alternate links (URL, content type) of known formats, and the location with the endings of RDF files."""
    linked = [url for url, media in links if format_of_media(media)]
    base = location.rstrip("/#")
    plain = format_of(base.rsplit("/", 1)[-1]) is None
    return list(dict.fromkeys([*linked, *(f"{base}.{ending}" for ending in ("ttl", "rdf", "owl", "nt", "jsonld") if plain)]))


class Fetched(bytes):
    """Bytes of a document with the content type and the alternate links that came with it."""

    media: str | None = None
    links: tuple[tuple[str, str], ...] = ()


def fetch(location: str, offline: bool = False, fetcher: Callable[[str], bytes] | None = None, spark: SparkSession | None = None) -> bytes:
    """Bytes of a file, or of a URL through the fetcher given; with ``spark`` files of any file system that it reads.

    A fetcher may return ``Fetched``: where its content type names no format,
    and the bytes look like none, the candidates are tried in turn.
    """
    if re.match(r"https?://", location):
        if offline:
            raise OfflineError(f"{location} is remote and the environment is offline")
        if fetcher is None:
            raise OfflineError(f"no fetcher is set for {location}")
        data = fetcher(location)
        if isinstance(data, Fetched) and format_of_media(data.media) is None and sniff(data) is None:
            for other in candidates(location, data.links):
                try:
                    more = fetcher(other)
                except OSError:
                    continue
                if format_of_media(getattr(more, "media", None)) or sniff(more) or format_of(other):
                    return more
        return data
    if spark is not None and re.match(r"[a-z0-9+.-]+:/", location):
        files, at = file_system(spark, location)
        if not files.exists(at):
            raise FileNotFoundError(location)
        return bytes(spark.read.format("binaryFile").load(location).select("content").first()[0])
    with open(location.removeprefix("file://"), "rb") as file:
        return file.read()


def last_modified(location: str, offline: bool = False, prober: Callable[[str], float | None] | None = None, spark: SparkSession | None = None) -> float | None:
    """Seconds since 1970 at which a source was last changed; none where it cannot be told.  ``prober`` answers for URLs."""
    if re.match(r"https?://", location):
        return None if offline or prober is None else prober(location)
    if spark is not None and re.match(r"[a-z0-9+.-]+:/", location):
        files, at = file_system(spark, location)
        return files.getFileStatus(at).getModificationTime() / 1000 if files.exists(at) else None
    path = location.removeprefix("file://")
    return os.path.getmtime(path) if os.path.exists(path) else None


def exists(location: str, offline: bool = False, prober: Callable[[str], float | None] | None = None, spark: SparkSession | None = None) -> bool:
    """Whether a source is there; a URL whose prober raises ``OSError`` is not, and one that nothing can probe counts as there."""
    if re.match(r"https?://", location):
        if not offline and prober is not None:
            try:
                prober(location)
            except OSError:
                return False
        return True
    return last_modified(location, offline, prober, spark) is not None
