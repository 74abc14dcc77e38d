"""Query algebra to DataFrames.

Each variable is a column of terms; unbound is null.  The compiler keeps for
every variable whether it may be unbound, so that variables that are always
bound join by plain equality.  Where one may be unbound, either side is split
by which of the shared variables are bound, and each two parts join on those
that both have; only parts that share no bound variable are paired without a
key, as the semantics ask.  ``GRAPH ?g`` carries the graph as one more join key
through every pattern and path below it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import BUILTINS, cast, is_in
from ..functions.values import DECIMAL, EXACT, INTEGER, Number, Term, Text, Truth, Value, arithmetic, compare, fixed, integer, let, number, number_of, order_key, term_of, text, text_value, truth_of
from ..operators import closure
from ..plans.local import local_frame
from ..sources.access import Source, source_of
from ..terms import XSD, is_blank, is_iri, is_literal
from . import algebra as A
from .parser import SparqlError, parse, visible


def column_of(name: str) -> str:
    """Column of a variable; generated names have characters that columns cannot."""
    return "v_" + name.replace(".", "__d").replace(":", "__c")


@dataclass
class Rel:
    """Solutions; ``names`` says of each variable whether it may be unbound."""

    df: DataFrame
    names: dict[str, bool]

    def column(self, name: str) -> Column:
        return F.col(column_of(name)) if name in self.names else F.lit(None).cast("string")


def conjuncts(e: A.Expression) -> list[A.Expression]:
    if isinstance(e, A.Call) and e.name == "&&":
        return conjuncts(e.args[0]) + conjuncts(e.args[1])
    return [e]


def has_exists(e: A.Expression | None) -> bool:
    return isinstance(e, A.Exists) or isinstance(e, A.Call) and any(map(has_exists, e.args))


def substitute(node, bindings: dict[str, str]):
    """Constants for variables, everywhere; a projection still returns them."""
    if isinstance(node, A.Var):
        return bindings.get(node.name, node)
    if isinstance(node, A.Ref):
        return A.Const(bindings[node.name]) if node.name in bindings else node
    if isinstance(node, A.Call) and node.name == "BOUND" and isinstance(node.args[0], A.Ref) and node.args[0].name in bindings:
        return A.Const(f'"true"^^<{XSD}boolean>')
    if isinstance(node, A.Project):
        inner = substitute(node.pattern, bindings)
        for name in node.names:
            if name in bindings:
                inner = A.Extend(inner, name, A.Const(bindings[name]))
        return A.Project(inner, node.names)
    if isinstance(node, tuple):
        return tuple(substitute(x, bindings) for x in node)
    if dataclasses.is_dataclass(node) and not isinstance(node, type):
        return dataclasses.replace(node, **{f.name: substitute(getattr(node, f.name), bindings) for f in dataclasses.fields(node)})
    return node


class Compiler:
    """Queries over a source of quads.

    ``default_graphs`` and ``named_graphs`` restrict the graphs; None is all of
    them, and the default graph is then the union of all named ones.  ``unique``
    says that no triple stands in two rows of one graph, ``merged`` that none
    stands in two rows at all; either saves a shuffle for each pattern, and a
    source may know it of itself.
    """

    def __init__(self, quads: DataFrame | Source, default_graphs: Sequence[str] | None = None, named_graphs: Sequence[str] | None = None, functions: dict[str, Callable[..., Column]] | None = None, unique: bool = False, merged: bool = False):
        self.quads = source_of(quads, unique, merged)
        self.spark = self.quads.spark
        self.default_graphs, self.named_graphs = default_graphs, named_graphs
        one = default_graphs is not None and len(default_graphs) < 2
        self.unique = unique or merged or self.quads.unique
        self.merged = merged or self.quads.merged or self.unique and one
        self.functions = functions or {}

    # -- scans

    def read(self, graph: A.Node | None, s: str | None = None, p: str | None = None, o: str | None = None) -> tuple[DataFrame, list[str], bool]:
        """Matching rows of the active graph, the columns of a triple beside its own, and whether rows may repeat."""
        df, within = self.quads.scan(s, p, o), self.default_graphs if graph is None else self.named_graphs
        if within is not None:
            df = df.where(F.col("graph").isin(*within))
        if graph is None:
            return df, [], not self.merged
        if isinstance(graph, A.Var):
            return df, ["graph"], not self.unique
        return df.where(F.col("graph") == graph), [], not self.unique

    def graph_names(self) -> DataFrame:
        return self.read(A.Var("g"))[0].select("graph").distinct()

    def scan(self, t: A.Triple, graph: A.Node | None, by: str | None = None) -> Rel:
        """Solutions of a pattern.  ``by``: the variable that they are joined by next; where they must be made distinct, one shuffle by it serves both."""
        places = list(zip(["s", "p", "o"], (t.s, t.p, t.o), strict=True))
        df, extra, repeats = self.read(graph, **{place: node for place, node in places if isinstance(node, str)})
        if extra:
            assert isinstance(graph, A.Var)
            places.append(("graph", graph))
        seen: dict[str, str] = {}
        for place, node in places:
            if isinstance(node, str):
                continue
            if node.name in seen:
                df = df.where(F.col(place) == F.col(seen[node.name]))
            else:
                seen[node.name] = place
        df = df.select(*(F.col(place).alias(column_of(name)) for name, place in seen.items()))
        if repeats:
            df = (df.repartition(column_of(by)) if by in seen else df).distinct() if seen else df.limit(1)
        return Rel(df, dict.fromkeys(seen, False))

    def one(self) -> Rel:
        """The empty solution."""
        return Rel(self.spark.range(1).select(), {})

    def bgp(self, triples: Sequence[A.Triple], graph: A.Node | None) -> Rel:
        """Patterns joined in an order that begins with the most constants and goes on by shared variables."""
        if not triples:
            if isinstance(graph, A.Var):
                return Rel(self.graph_names().select(F.col("graph").alias(column_of(graph.name))), {graph.name: False})
            return self.one()
        left = list(triples)
        names = lambda t: {n.name for n in (t.s, t.p, t.o) if isinstance(n, A.Var)}
        weight = lambda t: sum(w for w, n in ((4, t.s), (1, t.p), (3, t.o)) if isinstance(n, str))
        # several patterns about one subject meet by it
        subjects = [t.s.name for t in triples if isinstance(t.s, A.Var)]
        star = lambda t: t.s.name if isinstance(t.s, A.Var) and subjects.count(t.s.name) > 1 else None
        out, bound = None, set()
        while left:
            best = max(left, key=lambda t: (bool(names(t) & bound), weight(t)))
            left.remove(best)
            rel = self.scan(best, graph, star(best))
            out = rel if out is None else self.join(out, rel)
            bound |= names(best)
        return out

    # -- paths

    def edges(self, path: A.Path, graph: A.Node | None) -> DataFrame:
        """``src, dst`` of a path, and ``graph`` where that is a variable."""
        df, keys, repeats = self.read(graph, p=path.iri if isinstance(path, A.Step) else None)
        swap = lambda x: x.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        if isinstance(path, A.Step):
            found = df.select(*keys, F.col("s").alias("src"), F.col("o").alias("dst"))
            return found.distinct() if repeats else found
        if isinstance(path, A.Inverse):
            return swap(self.edges(path.path, graph))
        if isinstance(path, A.Sequence):
            a, b = self.edges(path.first, graph).withColumnRenamed("dst", "mid"), self.edges(path.second, graph).withColumnRenamed("src", "mid")
            return a.join(b, [*keys, "mid"]).select(*keys, "src", "dst")
        if isinstance(path, A.Alternative):
            return self.edges(path.first, graph).unionByName(self.edges(path.second, graph))
        if isinstance(path, A.NotIn):
            rows = df.select(*keys, "s", "p", "o").distinct() if repeats else df
            out = None
            if path.forward or not path.backward:
                out = rows.where(~F.col("p").isin(*path.forward)) if path.forward else rows
                out = out.select(*keys, F.col("s").alias("src"), F.col("o").alias("dst"))
            if path.backward:
                back = rows.where(~F.col("p").isin(*path.backward)).select(*keys, F.col("o").alias("src"), F.col("s").alias("dst"))
                out = back if out is None else out.unionByName(back)
            return out
        assert isinstance(path, A.Repeat)
        base = self.edges(path.path, graph).distinct()
        found = closure.transitive(base, keys) if path.many else base
        if path.zero:
            found = found.unionByName(self.nodes(graph)).distinct()
        return found

    def nodes(self, graph: A.Node | None) -> DataFrame:
        """Every term of the active graph with itself."""
        df, keys, _ = self.read(graph)
        terms = df.select(*keys, F.col("s").alias("src")).unionByName(df.select(*keys, F.col("o").alias("src"))).distinct()
        return terms.withColumn("dst", F.col("src"))

    def path(self, p: A.PathPattern, graph: A.Node | None) -> Rel:
        keys = ["graph"] if isinstance(graph, A.Var) else []
        ends = [("src", p.s), ("dst", p.o)]
        fixed = [(c, n) for c, n in ends if isinstance(n, str)]
        if isinstance(p.path, A.Repeat) and fixed and not keys:
            df = self.seeded(p.path, graph, *fixed[0])
        else:
            df = self.edges(p.path, graph)
            if isinstance(p.path, A.Repeat) and p.path.zero and fixed and keys:
                # a path of no steps binds a constant in every graph
                own = self.graph_names().select("graph", F.lit(fixed[0][1]).alias("src"), F.lit(fixed[0][1]).alias("dst"))
                df = df.unionByName(own).distinct()
        for column, node in fixed:
            df = df.where(F.col(column) == node)
        if isinstance(p.s, A.Var) and p.s == p.o:
            df, ends = df.where("src = dst"), ends[:1]
        out = {n.name: c for c, n in ends if isinstance(n, A.Var)} | ({graph.name: "graph"} if isinstance(graph, A.Var) else {})
        return Rel(df.select(*(F.col(c).alias(column_of(n)) for n, c in out.items())), dict.fromkeys(out, False))

    def seeded(self, path: A.Repeat, graph: A.Node | None, end: str, term: str) -> DataFrame:
        """A repeated path from or to a constant: only its frontier is followed."""
        edges = self.edges(path.path if end == "src" else A.Inverse(path.path), graph)
        first = edges.where(F.col("src") == term).select(F.col("dst").alias("seed")).distinct()
        found = closure.reachable(edges, first).select("node").distinct() if path.many else first.select(F.col("seed").alias("node"))
        if path.zero:
            found = found.unionByName(local_frame(self.spark, [(term,)], "node string")).distinct()
        other = "dst" if end == "src" else "src"
        return found.select(F.lit(term).alias(end), F.col("node").alias(other)).select("src", "dst")

    # -- joins

    @staticmethod
    def masks(rel: Rel, shared: Sequence[str]) -> Iterator[tuple[frozenset[str], DataFrame]]:
        """The rows by which of the shared variables are bound; a variable that always is needs no split."""
        open_ = [n for n in shared if rel.names[n]]
        for size in range(len(open_), -1, -1):
            for bound in combinations(open_, size):
                df = rel.df
                for n in open_:
                    df = df.where(F.col(column_of(n)).isNotNull() if n in bound else F.col(column_of(n)).isNull())
                yield frozenset(shared) - frozenset(open_) | frozenset(bound), df

    @staticmethod
    def matched(left: DataFrame, right: DataFrame, shared: Sequence[str], keys: frozenset[str], how: str, more: Sequence[Column] = ()) -> DataFrame:
        """A join on the keys and further conditions, the right side's shared columns renamed."""
        for n in shared:
            right = right.withColumnRenamed(column_of(n), "r_" + column_of(n))
        on = [F.col(column_of(n)) == F.col("r_" + column_of(n)) for n in shared if n in keys] + list(more)
        if not on and how == "inner":
            return left.crossJoin(right)
        return left.join(right, reduce(lambda a, b: a & b, on) if on else F.lit(True), how)

    @staticmethod
    def merged_columns(bound: frozenset[str], shared: Sequence[str]) -> dict[str, Column]:
        """Shared columns of a solution, given which of them the left side binds."""
        return {n: F.col(column_of(n)) if n in bound else F.col("r_" + column_of(n)) for n in shared}

    def join(self, left: Rel, right: Rel) -> Rel:
        shared = [n for n in left.names if n in right.names]
        names = {n: left.names.get(n, True) and right.names.get(n, True) for n in (*left.names, *right.names)}
        if not shared:
            return Rel(left.df.crossJoin(right.df), names)
        if not any(left.names[n] or right.names[n] for n in shared):
            return Rel(left.df.join(right.df, [column_of(n) for n in shared]), names)
        parts = []
        for a, ldf in self.masks(left, shared):
            merged = self.merged_columns(a, shared)
            for b, rdf in self.masks(right, shared):
                joined = self.matched(ldf, rdf, shared, a & b, "inner")
                parts.append(joined.select(*(merged.get(n, F.col(column_of(n))).alias(column_of(n)) for n in names)))
        return Rel(reduce(DataFrame.unionByName, parts), names)

    def left_join(self, left: Rel, right: Rel, condition: A.Expression | None, graph: A.Node | None = None) -> Rel:
        shared = [n for n in left.names if n in right.names]
        names = {n: left.names.get(n, True) if n in left.names and not left.names[n] else True for n in (*left.names, *right.names)}
        if condition is None and shared and not any(left.names[n] or right.names[n] for n in shared):
            return Rel(left.df.join(right.df, [column_of(n) for n in shared], "left"), names)
        if condition is not None and has_exists(condition):
            return self.left_join_exists(left, right, condition, graph, names)
        parts = []
        for a, ldf in self.masks(left, shared):
            merged = self.merged_columns(a, shared)
            within = lambda n, merged=merged: merged.get(n, F.col(column_of(n)) if n in names else F.lit(None).cast("string"))
            more = [truth_of(self.value(condition, within))] if condition is not None else []
            shape = lambda df, merged=merged: df.select(*(merged.get(n, F.col(column_of(n))).alias(column_of(n)) for n in names))
            rights = list(self.masks(right, shared))
            if len(rights) == 1:
                parts.append(shape(self.matched(ldf, rights[0][1], shared, a & rights[0][0], "left", more)))
                continue
            alone = ldf
            for b, rdf in rights:
                parts.append(shape(self.matched(ldf, rdf, shared, a & b, "inner", more)))
                alone = self.matched(alone, rdf, shared, a & b, "left_anti", more)
            parts.append(alone.select(*((F.col(column_of(n)) if n in left.names else F.lit(None).cast("string")).alias(column_of(n)) for n in names)))
        return Rel(reduce(DataFrame.unionByName, parts), names)

    def left_join_exists(self, left: Rel, right: Rel, condition: A.Expression, graph: A.Node | None, names: dict[str, bool]) -> Rel:
        """OPTIONAL whose filter holds EXISTS: the filtered join, and the left solutions that are in none of its rows.  Equal solutions have the same matches."""
        own = {f".l{n}": False for n in left.names}
        kept = Rel(left.df.withColumns({column_of(f".l{n}"): F.col(column_of(n)) for n in left.names}), left.names | own)
        found = self.filter(self.join(kept, right), condition, graph)
        same = [F.col(column_of(n)).eqNullSafe(F.col(column_of(f".l{n}"))) for n in left.names]
        keys = found.df.select(*(column_of(f".l{n}") for n in left.names)).distinct()
        alone = left.df.join(keys, reduce(lambda a, b: a & b, same) if same else F.lit(True), "left_anti")
        shape = lambda df, there: df.select(*((F.col(column_of(n)) if n in there else F.lit(None).cast("string")).alias(column_of(n)) for n in names))
        return Rel(shape(found.df, found.names).unionByName(shape(alone, left.names)), names)

    def minus(self, left: Rel, right: Rel) -> Rel:
        shared = [n for n in left.names if n in right.names]
        if not shared:
            return left
        parts = []
        for a, df in self.masks(left, shared):
            for b, rdf in self.masks(right, shared):
                # solutions that share no bound variable do not exclude each other
                if a & b:
                    df = self.matched(df, rdf.select(*(column_of(n) for n in shared)).distinct(), shared, a & b, "left_anti")
            parts.append(df)
        return Rel(reduce(DataFrame.unionByName, parts), left.names)

    def exists(self, rel: Rel, e: A.Exists, graph: A.Node | None) -> Rel:
        """Semi or anti join; filters of the inner group may use the outer solution."""
        pattern, outer = e.pattern, []
        while isinstance(pattern, A.Filter):
            parts = conjuncts(pattern.condition)
            inside = visible(pattern.pattern, hidden=True)
            late = [c for c in parts if not has_exists(c) and not A.names_in(c) <= inside]
            early = [c for c in parts if c not in late]
            outer += late
            if early:
                pattern = A.Filter(reduce(lambda a, b: A.Call("&&", (a, b)), early), pattern.pattern)
                break
            pattern = pattern.pattern
        inner = self.pattern(pattern, graph)
        shared = [n for n in rel.names if n in inner.names]
        found = []
        for a, df in self.masks(rel, shared):
            merged = self.merged_columns(a, shared)
            within = lambda n, merged=merged: merged.get(n, F.col(column_of(n)) if n in rel.names or n in inner.names else F.lit(None).cast("string"))
            more = [truth_of(self.value(c, within)) for c in outer]
            for b, rdf in self.masks(inner, shared):
                if not e.negated:
                    found.append(self.matched(df, rdf, shared, a & b, "left_semi", more))
                df = self.matched(df, rdf, shared, a & b, "left_anti", more)
            if e.negated:
                found.append(df)
        return Rel(reduce(DataFrame.unionByName, found), rel.names)

    def filter(self, rel: Rel, condition: A.Expression, graph: A.Node | None) -> Rel:
        for part in conjuncts(condition):
            if isinstance(part, A.Exists):
                rel = self.exists(rel, part, graph)
            elif isinstance(part, A.Call) and part.name == "!" and isinstance(part.args[0], A.Exists):
                rel = self.exists(rel, A.Exists(part.args[0].pattern, not part.args[0].negated), graph)
            elif has_exists(part):
                rel = self.marked(rel, part, graph)
            else:
                rel = Rel(rel.df.where(truth_of(self.value(part, rel.column))), rel.names)
        return rel

    def marked(self, rel: Rel, condition: A.Expression, graph: A.Node | None) -> Rel:
        """EXISTS inside another expression: a marking column for each, by a left join on the shared variables."""
        marks: dict[str, str] = {}
        df = rel.df

        def lifted(e: A.Expression) -> A.Expression:
            nonlocal df
            if isinstance(e, A.Exists):
                name = f".e{len(marks)}"
                marks[name] = column_of(name)
                inner = self.pattern(e.pattern, graph)
                shared = [n for n in rel.names if n in inner.names]
                keys = [column_of(n) for n in shared]
                if isinstance(e.pattern, A.Filter) or any(rel.names[n] or inner.names[n] for n in shared):
                    # the solutions for which it holds, and those for which it doesn't
                    now = Rel(df, rel.names)
                    yes, no = (self.exists(now, A.Exists(e.pattern, negated), graph).df for negated in (e.negated, not e.negated))
                    mark = lambda x: F.lit(f'"{x}"^^<{XSD}boolean>')
                    df = yes.withColumn(marks[name], mark("true")).unionByName(no.withColumn(marks[name], mark("false")))
                    return A.Ref(name)
                found = inner.df.select(*keys).distinct() if keys else inner.df.limit(1).select()
                found = found.withColumn(marks[name], F.lit(f'"{str(not e.negated).lower()}"^^<{XSD}boolean>'))
                df = df.join(found, keys, "left") if keys else df.join(found, F.lit(True), "left")
                df = df.withColumn(marks[name], F.coalesce(marks[name], F.lit(f'"{str(e.negated).lower()}"^^<{XSD}boolean>')))
                return A.Ref(name)
            return A.Call(e.name, tuple(map(lifted, e.args))) if isinstance(e, A.Call) else e

        plain = lifted(condition)
        within = lambda n: F.col(marks[n]) if n in marks else rel.column(n)
        return Rel(df.where(truth_of(self.value(plain, within))).drop(*marks.values()), rel.names)

    # -- expressions

    def value(self, e: A.Expression, column: Callable[[str], Column]) -> Value:
        if isinstance(e, A.Const):
            return fixed(e.term)
        if isinstance(e, A.Ref):
            return Term(column(e.name))
        if isinstance(e, A.Aggregate):
            raise SparqlError("an aggregate stands outside of SELECT, HAVING and ORDER BY")
        if not isinstance(e, A.Call):
            raise NotImplementedError("EXISTS here")
        if e.name == "BOUND":
            return Truth(term_of(self.value(e.args[0], column)).isNotNull())
        args = [self.value(a, column) for a in e.args]
        if e.name in ("&&", "||"):
            a, b = truth_of(args[0]), truth_of(args[1])
            return Truth(a & b if e.name == "&&" else a | b)
        if e.name == "!":
            return Truth(~truth_of(args[0]))
        if e.name in ("=", "<", ">", "<=", ">="):
            return Truth(compare(e.name, *args))
        if e.name == "!=":
            return Truth(~compare("=", *args))
        if e.name == "IN":
            return Truth(is_in(args[0], args[1:]))
        if e.name in ("+", "-", "*", "/"):
            return arithmetic(e.name, *args)
        if e.name == "negate":
            return Number(let(lambda n: number(n["rank"], -n["exact"], -n["double"]), number_of(args[0])))
        if e.name == "COALESCE":
            return Term(F.coalesce(*map(term_of, args)))
        if e.name in BUILTINS:
            return BUILTINS[e.name](*args)
        if e.name in self.functions:
            return Term(self.functions[e.name](*map(term_of, args)))
        if e.name.startswith(f"<{XSD}") and len(args) == 1 and (made := cast(e.name[len(XSD) + 1 : -1], args[0])) is not None:
            return made
        raise SparqlError(f"unknown function {e.name}")

    # -- aggregation

    def aggregate(self, a: A.Aggregate, term: Column, packed: Column | None) -> Column:
        if a.name == "COUNT":
            return term_of(integer(F.count_distinct(term) if a.distinct else F.count(term)))
        if a.name in ("SUM", "AVG"):
            assert packed is not None

            def made(n: Column, errors: Column, rank: Column, exact: Column, double: Column) -> Column:
                if a.name == "AVG":
                    rank = F.when(n == 0, F.lit(INTEGER)).otherwise(F.greatest(rank, F.lit(DECIMAL)))
                    exact, double = F.try_divide(exact.try_cast("decimal(28,10)"), n.cast("decimal(20,0)")), F.try_divide(double, n)
                exact = F.when(n == 0, F.lit(0).cast(EXACT)).otherwise(exact.try_cast(EXACT))
                return number(F.when(errors == 0, F.coalesce(rank, F.lit(INTEGER))), exact, double)

            sums = (F.count(F.lit(1)), F.count_if(packed["rank"].isNull()), F.max(packed["rank"]), F.try_sum(packed["exact"]), F.sum(packed["double"]))
            return term_of(Number(let(made, *sums)))
        if a.name in ("MIN", "MAX"):
            key = F.when(term.isNotNull(), order_key(Term(term)))
            return F.min_by(term, key) if a.name == "MIN" else F.max_by(term, key)
        if a.name == "SAMPLE":
            return F.min(term)
        texts = text_value(Term(term))
        return term_of(Text(text(F.array_join(F.sort_array(F.collect_set(texts) if a.distinct else F.collect_list(texts)), a.separator))))

    def group(self, g: A.Group, graph: A.Node | None) -> Rel:
        rel = self.pattern(g.pattern, graph)
        keys = [column_of(k) for k in g.keys]
        missing = [k for k in g.keys if k not in rel.names]
        df = rel.df.withColumns({column_of(k): F.lit(None).cast("string") for k in missing}) if missing else rel.df
        # arguments are computed once, as columns
        made: dict[str, Column] = {}
        for k, (_, a) in enumerate(g.aggregates):
            if a.arg is not None:
                v = self.value(a.arg, rel.column)
                made[f"a{k}"] = term_of(v)
                if a.name in ("SUM", "AVG"):
                    made[f"a{k}_number"] = number_of(v)
        df = df.withColumns(made) if made else df
        packed = lambda k: F.col(f"a{k}_number") if f"a{k}_number" in made else None
        plain, apart = [], []
        for k, (name, a) in enumerate(g.aggregates):
            if a.arg is None:
                every = [column_of(n) for n in sorted(rel.names)]
                n = F.count_distinct(F.struct(*every)) if a.distinct and every else F.count(F.lit(1))
                plain.append(term_of(integer(n)).alias(column_of(name)))
            elif a.distinct and a.name in ("SUM", "AVG"):
                apart.append((k, name, a))
            else:
                plain.append(self.aggregate(a, F.col(f"a{k}"), packed(k)).alias(column_of(name)))
        out = df.groupBy(*keys).agg(*plain) if plain else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        for k, name, a in apart:
            one = df.select(*keys, *(c for c in made if c == f"a{k}" or c.startswith(f"a{k}_"))).distinct()
            more = one.groupBy(*keys).agg(self.aggregate(a, F.col(f"a{k}"), packed(k)).alias(column_of(name)))
            renamed = more.select(*(F.col(c).alias("r_" + c) for c in keys), column_of(name))
            same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col("r_" + c)) for c in keys)) if keys else F.lit(True)
            out = out.join(renamed, same).drop(*("r_" + c for c in keys))
        if not g.keys and not g.aggregates:
            out = self.one().df
        return Rel(out, {k: rel.names.get(k, True) for k in g.keys} | {n: True for n, _ in g.aggregates})

    # -- patterns

    def pattern(self, p: A.Pattern, graph: A.Node | None = None) -> Rel:
        if isinstance(p, A.Bgp):
            return self.bgp(p.triples, graph)
        if isinstance(p, A.PathPattern):
            return self.path(p, graph)
        if isinstance(p, A.Join):
            return self.join(self.pattern(p.left, graph), self.pattern(p.right, graph))
        if isinstance(p, A.LeftJoin):
            return self.left_join(self.pattern(p.left, graph), self.pattern(p.right, graph), p.condition, graph)
        if isinstance(p, A.Filter):
            return self.filter(self.pattern(p.pattern, graph), p.condition, graph)
        if isinstance(p, A.Union):
            a, b = self.pattern(p.left, graph), self.pattern(p.right, graph)
            names = {n: a.names.get(n, True) or b.names.get(n, True) for n in (*a.names, *b.names)}
            fill = lambda r: r.df.select(*(r.column(n).alias(column_of(n)) for n in names))
            return Rel(fill(a).unionAll(fill(b)), names)
        if isinstance(p, A.Minus):
            return self.minus(self.pattern(p.left, graph), self.pattern(p.right, graph))
        if isinstance(p, A.Graph):
            inner = self.pattern(p.pattern, p.name)
            if isinstance(p.name, A.Var) and p.name.name not in inner.names:
                return self.join(inner, self.bgp((), p.name))
            return inner
        if isinstance(p, A.Service):
            if p.silent:
                return self.one()
            raise NotImplementedError("SERVICE")
        if isinstance(p, A.Extend):
            rel = self.pattern(p.pattern, graph)
            value = term_of(self.value(p.value, rel.column))
            sure = isinstance(p.value, A.Const)
            return Rel(rel.df.withColumn(column_of(p.name), value), rel.names | {p.name: not sure})
        if isinstance(p, A.Values):
            return self.values(p)
        if isinstance(p, A.Group):
            return self.group(p, graph)
        if isinstance(p, A.OrderBy):
            rel = self.pattern(p.pattern, graph)
            return Rel(self.ordered(rel, p.keys), rel.names)
        if isinstance(p, A.Project):
            rel = self.pattern(p.pattern, graph)
            return Rel(rel.df.select(*(rel.column(n).alias(column_of(n)) for n in p.names)), {n: rel.names.get(n, True) for n in p.names})
        if isinstance(p, A.Distinct):
            rel = self.pattern(p.pattern, graph)
            rel = Rel(rel.df.distinct(), rel.names)
            inner = p.pattern.pattern if isinstance(p.pattern, A.Project) else p.pattern
            if isinstance(inner, A.OrderBy):
                # a distinct shuffles; the order is laid on again, as far as its keys are still there
                keys = tuple(k for k in inner.keys if A.names_in(k[0]) <= set(rel.names))
                rel = Rel(self.ordered(rel, keys), rel.names) if keys else rel
            return rel
        assert isinstance(p, A.Slice)
        rel = self.pattern(p.pattern, graph)
        df = rel.df.offset(p.offset) if p.offset else rel.df
        return Rel(df if p.limit is None else df.limit(p.limit), rel.names)

    def ordered(self, rel: Rel, keys: Sequence[tuple[A.Expression, bool]]) -> DataFrame:
        columns = [order_key(self.value(e, rel.column)) for e, _ in keys]
        return rel.df.orderBy(*(c.asc() if up else c.desc() for c, (_, up) in zip(columns, keys, strict=True)))

    def values(self, p: A.Values) -> Rel:
        if not p.names:
            return Rel(self.spark.range(len(p.rows)).select(), {})
        schema = ", ".join(f"`{column_of(n)}` string" for n in p.names)
        names = {n: any(row[k] is None for row in p.rows) for k, n in enumerate(p.names)}
        return Rel(local_frame(self.spark, [tuple(r) for r in p.rows], schema), names)

    # -- query forms

    def construct(self, template: Sequence[A.Triple], rel: Rel) -> DataFrame:
        df = rel.df
        if any(isinstance(n, A.Var) and n.hidden for t in template for n in (t.s, t.p, t.o)):
            df = df.withColumn("_row", F.monotonically_increasing_id())
        every = [column_of(n) for n in sorted(rel.names)]

        def node(n: A.Node) -> Column:
            if isinstance(n, str):
                return F.lit(n)
            if n.hidden:
                return F.concat(F.lit("_:c"), F.hex(F.xxhash64(F.lit(n.name), "_row", *every)))
            return rel.column(n.name)

        rows = df.select(F.inline(F.array(*(F.struct(node(t.s).alias("s"), node(t.p).alias("p"), node(t.o).alias("o")) for t in template))))
        return rows.where(~is_literal(F.col("s")) & is_iri(F.col("p")) & F.col("o").isNotNull()).distinct()

    def describe(self, nodes: Sequence[A.Node], rel: Rel) -> DataFrame:
        """All triples of the resources, and of the blank nodes that these lead to."""
        fixed = [n for n in nodes if isinstance(n, str)]
        found = local_frame(self.spark, [(n,) for n in fixed], "seed string")
        for n in nodes:
            if isinstance(n, A.Var):
                found = found.unionByName(rel.df.select(rel.column(n.name).alias("seed")))
        triples = self.read(None)[0].select("s", "p", "o").distinct()
        blank = triples.where(is_blank(F.col("o"))).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        wanted = closure.reachable(blank, found.where(F.col("seed").isNotNull()).distinct()).select(F.col("node").alias("s")).distinct()
        return triples.join(wanted, "s", "left_semi").select("s", "p", "o")


def query(
    quads: DataFrame | Source,
    text: str,
    prefixes: dict[str, str] | None = None,
    default_graphs: Sequence[str] | None = None,
    named_graphs: Sequence[str] | None = None,
    bindings: dict[str, str] | None = None,
    functions: dict[str, Callable[..., Column]] | None = None,
    unique: bool = False,
    merged: bool = False,
) -> DataFrame:
    """A query's result: a column of terms for each variable; ``ask``; or ``s, p, o`` for CONSTRUCT and DESCRIBE.

    FROM and FROM NAMED of the text go before the graphs given here.
    """
    q = parse(text, prefixes)
    if bindings:
        pattern = substitute(q.pattern, bindings)
        q = dataclasses.replace(q, pattern=pattern, template=substitute(q.template, bindings), describe=substitute(q.describe, bindings))
    if q.default_graphs or q.named_graphs:
        default_graphs, named_graphs = q.default_graphs, q.named_graphs
    compiler = Compiler(quads, default_graphs, named_graphs, functions, unique, merged)
    rel = compiler.pattern(q.pattern)
    if q.form == "ASK":
        return rel.df.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("ask"))
    if q.form == "CONSTRUCT":
        return compiler.construct(q.template, rel)
    if q.form == "DESCRIBE":
        return compiler.describe(q.describe, rel)
    names = q.pattern.names if isinstance(q.pattern, A.Project) else None
    inner = q.pattern
    while names is None and isinstance(inner, (A.Slice, A.Distinct)):
        inner = inner.pattern
        names = inner.names if isinstance(inner, A.Project) else None
    names = names or tuple(n for n in rel.names if not n.startswith((".", "_:")))
    return rel.df.select(*(rel.column(n).alias(n) for n in names))
