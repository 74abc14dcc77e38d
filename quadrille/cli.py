"""Command line: ``python -m quadrille.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from .env import Config, Environment
from .sources.files import read_quads
from .sources.store import Store
from .view import serialize


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadrille")
    top.add_argument("--env", default=".quadrille", help="folder of the environment")
    sub = top.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("directories", nargs="*")
    init.add_argument("--overwrite", action="store_true")
    for flag in ("strict", "offline", "require-ontology-names", "use-cached-ontologies"):
        init.add_argument(f"--{flag}", action="store_true")
    for name in ("includes", "excludes"):
        init.add_argument(f"--{name}", nargs="*")
    init.add_argument("--policy", default="default")
    for name in ("version", "status", "dep-graph", "doctor", "reset", "recover"):
        sub.add_parser(name)
    update = sub.add_parser("update")
    update.add_argument("--all", action="store_true")
    add = sub.add_parser("add")
    add.add_argument("location")
    add.add_argument("--no-imports", action="store_true")
    add.add_argument("--rename")
    for name in ("closure", "get"):
        one = sub.add_parser(name)
        one.add_argument("name")
        one.add_argument("--format", default="turtle")
        one.add_argument("--output")
    sub.choices["closure"].add_argument("--depth", type=int, default=-1)
    sub.choices["closure"].add_argument("--keep-imports", action="store_true")
    sub.choices["closure"].add_argument("--keep-prefixes", action="store_true")
    both = sub.add_parser("union")
    both.add_argument("root")
    both.add_argument("names", nargs="+")
    both.add_argument("--include-closures", action="store_true")
    both.add_argument("--keep-imports", action="store_true")
    both.add_argument("--keep-prefixes", action="store_true")
    both.add_argument("--format", default="turtle")
    both.add_argument("--output")
    listing = sub.add_parser("list")
    listing.add_argument("what", choices=["ontologies", "locations", "missing"])
    sub.add_parser("dump").add_argument("contains", nargs="?")
    sub.add_parser("why").add_argument("names", nargs="+")
    spaces = sub.add_parser("namespaces")
    spaces.add_argument("name", nargs="?")
    spaces.add_argument("--closure", action="store_true")
    config = sub.add_parser("config")
    config.add_argument("action", choices=["get", "set", "list", "unset", "add", "remove"])
    config.add_argument("key", nargs="?")
    config.add_argument("value", nargs="?")
    query = sub.add_parser("query")
    query.add_argument("text")
    build = sub.add_parser("build")
    build.add_argument("store")
    build.add_argument("files", nargs="+")
    build.add_argument("--datasets", action="store_true")
    sub.add_parser("stat").add_argument("store")
    return top


def _configure(config: Config, action: str, key: str | None, value: str | None) -> str:
    known = {f.name: getattr(config, f.name) for f in fields(Config)}
    if action == "list":
        return json.dumps(known, indent=2)
    if key not in known:
        raise SystemExit(f"unknown key {key}")
    now = known[key]
    if action == "get":
        return json.dumps(now)
    if action in ("add", "remove"):
        if not isinstance(now, list):
            raise SystemExit(f"{key} is not a list")
        setattr(config, key, [*now, value] if action == "add" else [x for x in now if x != value])
    elif action == "unset":
        setattr(config, key, getattr(Config(), key))
    elif isinstance(now, bool):
        setattr(config, key, value in ("true", "1", "yes"))
    else:
        setattr(config, key, int(value) if isinstance(now, int) else value.split(",") if isinstance(now, list) else value)
    return json.dumps(getattr(config, key))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run a command; returns what it prints."""
    a = _parser().parse_args(argv)
    if a.command == "version":
        from pyspark import __version__

        return f"pyspark {__version__}"
    if a.command == "reset":
        shutil.rmtree(a.env, ignore_errors=True)
        return "reset"
    spark = spark or SparkSession.builder.appName("quadrille").getOrCreate()
    if a.command == "build":
        Store(spark, a.store).write(read_quads(spark, a.files, named_graphs=a.datasets))
        return a.store
    if a.command == "stat":
        return "\n".join(f"{r['dataset']}\t{r['graph']}\t{r['n_triples']}" for r in Store(spark, a.store, read_only=True).graphs().orderBy("graph", "dataset").collect())
    if a.command == "init":
        lists = {k: getattr(a, k) for k in ("includes", "excludes") if getattr(a, k) is not None}
        config = Config(search_directories=a.directories or ["."], strict=a.strict, offline=a.offline, require_ontology_names=a.require_ontology_names, use_cached_ontologies=a.use_cached_ontologies, policy=a.policy, **lists)
        with Environment.create(spark, a.env, config, a.overwrite) as env:
            return f"{len(env)} sources"
    if a.command == "recover":
        with Environment.recover(spark, a.env) as env:
            return f"{len(env)} graphs"
    env = Environment.open(spark, a.env, read_only=a.command not in ("update", "add", "config"))
    with env:
        if a.command == "update":
            return "\n".join(env.update(all=a.all))
        if a.command == "add":
            return env.add(a.location, fetch_imports=not a.no_imports, rename=a.rename)
        if a.command == "status":
            return json.dumps(env.status(), indent=2, default=str)
        if a.command == "list":
            rows = {"ontologies": env.get_ontology_names(), "locations": sorted(r.location for r in env.records.values()), "missing": env.missing_imports()}
            return "\n".join(rows[a.what])
        if a.command == "dump":
            return env.dump(a.contains)
        if a.command == "dep-graph":
            return env.dep_graph_dot()
        if a.command == "why":
            return "\n".join(" -> ".join(p) for n in a.names for p in env.import_paths(n))
        if a.command == "doctor":
            return "\n".join(env.doctor())
        if a.command == "namespaces":
            return "\n".join(f"{p}: {n}" for p, n in sorted(env.get_namespaces(a.name, a.closure).items()))
        if a.command == "config":
            return _configure(env.config, a.action, a.key, a.value)
        if a.command == "query":
            return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in env.get_dataset().query(a.text).toLocalIterator())
        if a.command == "get":
            triples = env.copy_graph(a.name)
        elif a.command == "closure":
            triples, _ = env.copy_closure(a.name, a.depth, not a.keep_imports, not a.keep_prefixes)
        else:
            triples, _ = env.copy_union(a.names, a.root, a.include_closures, not a.keep_prefixes, not a.keep_imports)
        text = serialize(triples, a.format, env.get_namespaces())
        if a.output:
            with open(a.output, "w") as file:
                file.write(text)
            return a.output
        return text


if __name__ == "__main__":
    sys.stdout.write(main() + "\n")
