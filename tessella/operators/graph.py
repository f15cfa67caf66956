"""Variable roles and control-flow shapes as patterns over a code property graph (schemas.CPG_NODES, schemas.CPG_EDGES).

A Cpg turns nodes and edges into a few narrow relations (references, arguments, writes, syntax-tree closure, containment of references); every pattern
is a composition of equi-joins, semi-joins and anti-joins of these. Edges of one type that a pattern must not use twice are told apart by edge_id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.spans import line_table
from tessella.sources.storage import shared_dir, stored

OP = "<operator>."
# Names of graph calls that the patterns test for.
ASSIGNMENT = "<operator>.assignment"
COMPOUND = ("<operator>.assignmentPlus", "<operator>.assignmentMinus", "<operator>.assignmentMultiplication", "<operator>.assignmentDivision")
STEPS = ("<operator>.postIncrement", "<operator>.postDecrement", "<operator>.preIncrement", "<operator>.preDecrement")
ARITHMETIC = ("<operator>.addition", "<operator>.subtraction", "<operator>.multiplication", "<operator>.division")
COMPARISONS = ("<operator>.lessThan", "<operator>.lessEqualsThan", "<operator>.greaterThan", "<operator>.greaterEqualsThan")
INDEXING = ("<operator>.indirectIndexAccess", "<operator>.indirection")
TRAVERSALS = ("next", "hasNext", "begin", "end", "find")
READS = ("next", "read", "getline", "get", "front", "back", "at")
MUTATORS = ("push_back", "push_front", "pop_back", "pop_front", "insert", "emplace", "emplace_back", "emplace_front", "erase", "remove", "clear", "append")
ORGANIZERS = (
    "sort", "stable_sort", "partial_sort", "nth_element", "reverse", "rotate", "shuffle", "random_shuffle",
    "std::sort", "std::stable_sort", "std::partial_sort", "std::nth_element", "std::reverse", "std::rotate", "std::shuffle", "std::random_shuffle",
)
# End of fixed values.
WRITES = (ASSIGNMENT, *COMPOUND, *STEPS)
LOOPS2, LOOPS3 = ("FOR", "WHILE"), ("FOR", "WHILE", "DO")


def closure(edges: DataFrame) -> DataFrame:
    """a, b, depth: b lies `depth` >= 1 tree edges below a. edges: src, dst of a forest.

    Paths are doubled, so a tree of depth n takes log2(n) joins; what each round adds is stored once. The result has a row per node and ancestor: its size follows the
    depth of the trees, and all joins are on node keys.
    """
    parts = [stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("depth")).distinct(), "closure")]
    reach = 1
    while True:
        step = reduce(DataFrame.unionByName, parts)
        last = parts[-1].where(F.col("depth") == reach).select("a", F.col("b").alias("m"))
        more = stored(last.join(step.select(F.col("a").alias("m"), "b", (F.col("depth") + reach).alias("depth")), "m").select("a", "b", "depth"), "closure")
        if more.isEmpty():
            return step
        parts.append(more)
        reach *= 2


def paths_up(edges: DataFrame) -> DataFrame:
    """b, up: each node that lies below another, with all nodes above it, the nearest first. edges: src, dst of a forest.

    As closure(), by doubling, but a node is one row, and only nodes that have others below them take part in the rounds: the rest is one join with their parents.
    """
    link = edges.select(F.col("src").alias("p"), F.col("dst").alias("b")).distinct()
    inner = link.join(edges.select(F.col("src").alias("b")).hint("merge"), "b", "left_semi")
    # top: the last node of up, null once nothing lies above it
    d = stored(inner.select("b", F.array("p").alias("up"), F.col("p").alias("top")), "paths")
    while not d.where("top is not null").isEmpty():
        more = d.select(F.col("b").alias("top"), F.col("up").alias("_more"), F.col("top").alias("_next")).hint("merge")
        d = stored(d.join(more, "top", "left").select("b", F.when(F.col("_more").isNull(), F.col("up")).otherwise(F.concat("up", "_more")).alias("up"), F.col("_next").alias("top")), "paths")
    above = d.select(F.col("b").alias("p"), F.col("up").alias("_more")).hint("merge")
    return stored(link.join(above, "p", "left").select("b", F.when(F.col("_more").isNull(), F.array("p")).otherwise(F.concat(F.array("p"), "_more")).alias("up")), "paths")


class Cpg:
    """Narrow relations over a graph, each stored when first asked for, as all patterns read them. Ids are unique; any property may be null, and comparisons with null hold for neither side.

    All of them grow with the graph, and columnar files are far smaller than their rows in memory, so that a size taken from files would have them broadcast: they ask for merge joins.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes.hint("merge"), edges.hint("merge")
        self._found: dict[Callable, DataFrame] = {}

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def edge(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("type") == kind)

    @cached_property
    def up(self) -> DataFrame:
        """b, up: the nodes above b in the syntax tree."""
        return paths_up(self.edge("AST")).hint("merge")

    def above(self, df: DataFrame) -> DataFrame:
        """df (with b) with a: each node above b."""
        return df.join(self.up, "b").withColumn("a", F.explode("up")).drop("up")

    def at_or_above(self, df: DataFrame) -> DataFrame:
        """df (with b) with a: b, and each node above it."""
        return df.join(self.up, "b", "left").withColumn("a", F.explode(F.when(F.col("up").isNull(), F.array("b")).otherwise(F.concat(F.array("b"), "up")))).drop("up")

    @cached_property
    def decls(self) -> DataFrame:
        return self.label("LOCAL", "METHOD_PARAMETER_IN").select(F.col("id").alias("d"), F.col("label").alias("d_label"), F.col("line_number").alias("d_line"), F.col("column_number").alias("d_col"))

    @cached_property
    def locals(self) -> DataFrame:
        return self.decls.where("d_label = 'LOCAL'")

    @cached_property
    def refs(self) -> DataFrame:
        """i (identifier), d (what it refers to), i_ix, i_line, i_col, ref_edge."""
        e = self.edge("REF").select(F.col("src").alias("i"), F.col("dst").alias("d"), F.col("edge_id").alias("ref_edge"))
        i = self.label("IDENTIFIER").select(F.col("id").alias("i"), F.col("argument_index").alias("i_ix"), F.col("line_number").alias("i_line"), F.col("column_number").alias("i_col"))
        return stored(e.join(i, "i"), "refs").hint("merge")

    @cached_property
    def args(self) -> DataFrame:
        """c (call), x (argument), ix, x_label, c_name, c_line, arg_edge."""
        e = self.edge("ARGUMENT").select(F.col("src").alias("c"), F.col("dst").alias("x"), F.col("edge_id").alias("arg_edge"))
        c = self.label("CALL").select(F.col("id").alias("c"), F.col("name").alias("c_name"), F.col("line_number").alias("c_line"))
        x = self.nodes.select(F.col("id").alias("x"), F.col("argument_index").alias("ix"), F.col("label").alias("x_label"))
        return stored(e.join(c, "c").join(x, "x"), "args").hint("merge")

    @cached_property
    def uses(self) -> DataFrame:
        """References to declarations that are arguments of calls: refs and args together."""
        return stored(self.refs.join(self.args.withColumnRenamed("x", "i"), "i").join(self.decls, "d"), "uses").hint("merge")

    @cached_property
    def writes(self) -> DataFrame:
        return self.uses.where(F.col("c_name").isin(*WRITES) & (F.col("ix") == 1))

    @cached_property
    def later_writes(self) -> DataFrame:
        """Writes at another place than the declaration's."""
        return self.writes.where((F.col("d_line") != F.col("i_line")) | (F.col("d_col") != F.col("i_col")))

    @cached_property
    def assigned(self) -> DataFrame:
        return self.writes.where(F.col("c_name") == ASSIGNMENT)

    @cached_property
    def holds(self) -> DataFrame:
        """x, d: a reference to declaration d is x or lies below it."""
        found = self.at_or_above(self.refs.join(self.decls.select("d"), "d").select("d", F.col("i").alias("b"))).select(F.col("a").alias("x"), "d").distinct()
        return stored(found, "holds").hint("merge")

    @cached_property
    def controls(self) -> DataFrame:
        return self.label("CONTROL_STRUCTURE").select(F.col("id").alias("cs"), F.col("control_structure_type").alias("kind"), F.col("line_number").alias("cs_line"), F.col("code").alias("cs_code"))

    @cached_property
    def conditions(self) -> DataFrame:
        return self.edge("CONDITION").select(F.col("src").alias("cs"), F.col("dst").alias("x")).join(self.controls, "cs")

    @cached_property
    def methods(self) -> DataFrame:
        """a, m_name, m_full, filename of all methods; unnamed files don't count."""
        return self.label("METHOD").where("filename <> '<empty>'").select(F.col("id").alias("a"), F.col("name").alias("m_name"), F.col("full_name").alias("m_full"), "filename")

    def owned(self, d: DataFrame) -> DataFrame:
        """d (with d, any node) with filename of a method above it."""
        return d.join(self.above(d.select(F.col("d").alias("b")).distinct()).join(self.methods.select("a", "filename"), "a").select(F.col("b").alias("d"), "filename").distinct().hint("merge"), "d")

    def under_control(self, df: DataFrame, *kinds: str) -> DataFrame:
        """df (with b) with cs: each control structure of these kinds above b."""
        return self.above(df).join(self.controls.where(F.col("kind").isin(*kinds)).select(F.col("cs").alias("a")), "a").withColumnRenamed("a", "cs")

    def found(self, pattern: Callable[[Cpg], DataFrame]) -> DataFrame:
        """What a pattern of declarations finds, with filename: stored, as its occurrences are read from it too."""
        if pattern not in self._found:
            d = pattern(self)
            d = d if "filename" in d.columns else self.owned(stored(d, "pattern").hint("merge"))
            self._found[pattern] = stored(d.distinct(), "found").hint("merge")
        return self._found[pattern]

    def right_side(self) -> DataFrame:
        """c, r (second argument of a call), r_label."""
        return self.args.where("ix = 2").select("c", F.col("x").alias("r"), F.col("x_label").alias("r_label"))


# Each variable pattern returns d (declaration) and further columns that its rows are distinct by; node patterns return d (the control structure).


def fixed_value(g: Cpg) -> DataFrame:
    local = g.assigned.where("d_label = 'LOCAL' and d_line = i_line and d_col = i_col").select("d")
    param = g.decls.where("d_label = 'METHOD_PARAMETER_IN'").select("d")
    return local.unionByName(param).join(g.later_writes.select("d"), "d", "left_anti").distinct()


def future_mutated_variable(g: Cpg) -> DataFrame:
    return g.later_writes.groupBy("d").agg(F.count("*").alias("num_writes"))


def gatherer(g: Cpg) -> DataFrame:
    first = g.assigned.where("d_label = 'LOCAL'").select("d", F.col("ref_edge").alias("r1"), F.col("arg_edge").alias("a1"))
    up = g.edge("AST").select(F.col("src").alias("p"), F.col("dst").alias("d"), F.col("edge_id").alias("e1"))
    down = g.edge("AST").select(F.col("src").alias("p"), F.col("dst").alias("cs"), F.col("edge_id").alias("e2"))
    update = g.uses.select("d", F.col("c").alias("b"), "c_name", "ix", F.col("ref_edge").alias("r2"), F.col("arg_edge").alias("a2"))
    # loops that update a variable come first, then those of them beside its declaration: siblings are never paired
    inside_loop = g.under_control(update, *LOOPS2).join(first, "d").where("r1 <> r2 and a1 <> a2")
    d = inside_loop.join(up, "d").join(down, ["p", "cs"]).where("e1 <> e2").drop("p", "e1", "e2")
    by_operator = g.right_side().where("r_label <> 'LITERAL'").select(F.col("c").alias("b"))
    own = g.assigned.select(F.col("c").alias("b"), "d")
    again = g.right_side().join(g.holds.withColumnRenamed("x", "r"), "r").select(F.col("c").alias("b"), "d").hint("merge")
    # something in the right side that is no literal and no reference to d: a relation of (b, d) over the right side's nodes
    inside = g.at_or_above(g.nodes.where("label <> 'LITERAL'").select(F.col("id").alias("b"))).select(F.col("a").alias("r"), F.col("b").alias("o"))
    inside = g.right_side().join(inside, "r").select(F.col("c").alias("b"), "o")
    to = g.edge("REF").select(F.col("src").alias("o"), F.col("dst").alias("d"))
    other = d.where(F.col("c_name") == ASSIGNMENT).select("b", "d").distinct().join(inside, "b").join(to, ["o", "d"], "left_anti").select("b", "d").hint("merge")
    one = d.where(F.col("c_name").isin(*COMPOUND) & (F.col("ix") == 1)).join(by_operator, "b", "left_semi")
    two = d.where(F.col("c_name") == ASSIGNMENT).join(own, ["b", "d"], "left_semi").join(again, ["b", "d"], "left_semi").join(other, ["b", "d"], "left_semi")
    both = one.unionByName(two).groupBy("d", "cs").agg(F.sort_array(F.collect_set("c_name")).alias("update_names"), F.sort_array(F.collect_set("b")).alias("update_calls"))
    return both.drop("cs").distinct()


def stepper(g: Cpg) -> DataFrame:
    tested = g.conditions.where(F.col("kind").isin(*LOOPS2)).join(g.holds, "x").join(g.locals.select("d"), "d").select("cs", "d").distinct()
    update = g.uses.where("ix = 1 and (d_line <> i_line or d_col <> i_col)").select("d", F.col("c").alias("b"), "c_name")
    d = tested.join(g.under_control(update, *LOOPS2), ["cs", "d"])
    literal = g.right_side().where("r_label = 'LITERAL'").select(F.col("c").alias("b"))
    sums = g.label("CALL").where(F.col("name").isin(*ARITHMETIC)).select(F.col("id").alias("r"))
    sums = g.right_side().join(sums, "r").select(F.col("c").alias("b"), "r").join(g.args.where("x_label = 'LITERAL'").select(F.col("c").alias("r")), "r", "left_semi")
    sums = sums.join(g.uses.select(F.col("c").alias("r"), "d"), "r").select("b", "d")
    ok = d.where(F.col("c_name").isin(*STEPS)).unionByName(d.where(F.col("c_name").isin(*COMPOUND)).join(literal, "b", "left_semi"))
    ok = ok.unionByName(d.where(F.col("c_name") == ASSIGNMENT).join(sums, ["b", "d"], "left_semi").select(*d.columns))
    names = ok.groupBy("d", "cs").agg(F.collect_set("c_name").alias("update_names")).where("size(update_names) = 1")
    return names.drop("cs").distinct()


def walker(g: Cpg) -> DataFrame:
    tested = g.conditions.where(F.col("kind").isin(*LOOPS2)).join(g.holds, "x").join(g.locals.select("d"), "d").select("cs", "d").distinct()
    index = g.label("CALL").where(F.col("name").isin(*INDEXING)).select(F.col("id").alias("b"))
    indexed = g.under_control(index, *LOOPS2).select("cs", F.col("b").alias("x")).join(g.holds, "x").select("cs", "d")
    moved = g.under_control(g.uses.where(F.col("c_name").isin(*TRAVERSALS)).select(F.col("i").alias("b"), "d"), *LOOPS2).select("cs", "d")
    return tested.join(indexed.unionByName(moved), ["cs", "d"], "left_semi").select("d").distinct()


def most_recent_holder(g: Cpg) -> DataFrame:
    head = g.under_control(g.later_writes.where((F.col("c_name") == ASSIGNMENT) & (F.col("d_label") == "LOCAL")).select("d", F.col("c").alias("b")), *LOOPS3).select("d", "b").distinct()
    side = g.right_side().withColumnRenamed("c", "b")
    kinds = g.nodes.where((F.col("label") == "IDENTIFIER") | ((F.col("label") == "CALL") & F.col("name").isin(*READS))).select(F.col("id").alias("o"))
    telling = g.at_or_above(kinds.withColumnRenamed("o", "b")).select(F.col("a").alias("r")).distinct()
    return head.join(side, "b").join(telling, "r", "left_semi").join(g.holds.withColumnRenamed("x", "r"), ["r", "d"], "left_anti").select("d").distinct()


def most_wanted_holder(g: Cpg) -> DataFrame:
    write = g.later_writes.where((F.col("c_name") == ASSIGNMENT) & (F.col("d_label") == "LOCAL")).select("d", F.col("c").alias("b"))
    looped = g.under_control(g.controls.where("kind = 'IF'").select(F.col("cs").alias("b")), *LOOPS3).select(F.col("b").alias("cs")).distinct()
    head = g.under_control(write, "IF").join(looped, "cs", "left_semi").withColumnRenamed("cs", "choice")
    test = g.label("CALL").where(F.col("name").isin(*COMPARISONS)).select(F.col("id").alias("o"))
    tests = g.at_or_above(test.withColumnRenamed("o", "b")).select(F.col("a").alias("x"), F.col("b").alias("o"))
    compared = g.conditions.select(F.col("cs").alias("choice"), "x").join(tests, "x").select("choice", F.col("o").alias("x")).join(g.holds, "x").select("choice", "d")
    named = g.label("CALL").where(F.col("code").rlike(r"(?i)\b(min|max)\b")).select(F.col("id").alias("b"))
    return head.join(compared, ["choice", "d"], "left_semi").select("d").unionByName(head.join(named, "b", "left_semi").select("d")).distinct()


def one_way_flag(g: Cpg) -> DataFrame:
    literals = g.label("LITERAL").where(F.col("code").isin("true", "false", "0", "1")).select(F.col("id").alias("r"), F.col("code").alias("value"))
    sets = g.assigned.where("d_label = 'LOCAL'").join(g.right_side(), "c").join(literals, "r").select("d", "c", "c_line", "value", "d_line", "d_col", "i_line", "i_col")
    init = sets.select("d", F.col("c").alias("c0"), F.col("value").alias("v0"))
    flip = sets.where("d_line <> i_line or d_col <> i_col").select("d", F.col("c").alias("c1"), F.col("c_line").alias("l1"), F.col("value").alias("v1"))
    on = lambda c: F.col(c).isin("true", "1")
    pairs = init.join(flip, "d").where((F.col("c0") != F.col("c1")) & (on("v0") != on("v1")))
    back = sets.select("d", F.col("value").alias("v0"), F.col("c_line").alias("l2"))
    b = back.select(F.col("d").alias("d2"), F.col("v0").alias("v2"), "l2")
    return pairs.join(b, (F.col("d") == F.col("d2")) & (F.col("v0") == F.col("v2")) & (F.col("l2") > F.col("l1")), "left_anti").select("d").distinct()


def _arguments_holding(g: Cpg) -> DataFrame:
    """c, c_name, x, ix, d, u_ix: arguments x of calls that are or hold a reference to d; u_ix is that reference's own index."""
    inner = g.at_or_above(g.refs.join(g.decls.select("d"), "d").select(F.col("i").alias("b"), "d", F.col("i_ix").alias("u_ix")))
    return g.args.select("c", "c_name", "x", "ix").join(inner.select(F.col("a").alias("x"), "d", "u_ix"), "x")


def organizer(g: Cpg) -> DataFrame:
    held = _arguments_holding(g)
    return held.where(F.col("c_name").isin(*ORGANIZERS)).select("d").distinct().join(held.where(F.col("c_name").isin(*MUTATORS)).select("d"), "d", "left_anti")


def container(g: Cpg) -> DataFrame:
    return _arguments_holding(g).where(F.col("c_name").isin(*MUTATORS) & (F.coalesce("ix", "u_ix") == 0)).select("d").distinct()


def variable_dependent(g: Cpg) -> DataFrame:
    other = g.holds.select(F.col("x").alias("r"), F.col("d").alias("d2"))
    return g.assigned.select("d", "c").join(g.right_side(), "c").join(other, "r").where("d2 <> d").select("d").distinct()


def follower(g: Cpg) -> DataFrame:
    lead = g.refs.select(F.col("i").alias("r"), F.col("d").alias("d2")).join(g.decls.select(F.col("d").alias("d2")), "d2").hint("merge")
    d = g.assigned.where("d_label = 'LOCAL'").select("d", "c", "c_line").join(g.right_side().where("r_label = 'IDENTIFIER'"), "c").join(lead, "r").where("d2 <> d")
    later = g.writes.select(F.col("d").alias("d3"), F.col("c_line").alias("l3"))
    return d.join(later, (F.col("d2") == F.col("d3")) & (F.col("l3") > F.col("c_line")), "left_semi").select("d").distinct()


def future_dependency(g: Cpg) -> DataFrame:
    d = g.refs.join(g.decls, "d").where("i_line > d_line").select("d", "i")
    return d.join(g.args.where(F.col("c_name").isin(*WRITES) & (F.col("ix") == 1)).select(F.col("x").alias("i")), "i", "left_anti").select("d").distinct()


def future_return_dependency(g: Cpg) -> DataFrame:
    r = g.label("RETURN").select(F.col("id").alias("x"), F.col("line_number").alias("r_line"))
    return r.join(g.holds, "x").join(g.decls, "d").where("r_line >= d_line").select("d").distinct()


def variable_used_in_function(g: Cpg) -> DataFrame:
    return _arguments_holding(g).where(~F.col("c_name").startswith(OP) & (F.coalesce("ix", "u_ix") >= 1)).select("d").distinct()


def temporary(g: Cpg) -> DataFrame:
    source = g.args.select("c", F.col("x").alias("j"), F.col("ix").alias("jx"), F.col("arg_edge").alias("a2"))
    copies = g.assigned.select("d", "c", "c_line", "d_label", "arg_edge").join(source, "c").where("arg_edge <> a2").join(g.refs.select(F.col("i").alias("j"), F.col("d").alias("s")), "j").join(g.decls.select(F.col("d").alias("s")), "s")
    one = copies.where("d_label = 'LOCAL' and jx = 2").select(F.col("d").alias("t"), F.col("s").alias("x"), F.col("c").alias("c1"), F.col("c_line").alias("l1"))
    two = copies.select(F.col("d").alias("x"), F.col("s").alias("y"), F.col("c").alias("c2"), F.col("c_line").alias("l2"))
    three = copies.select(F.col("d").alias("y"), F.col("s").alias("t"), F.col("c").alias("c3"), F.col("c_line").alias("l3"))
    return one.join(two, "x").join(three, ["y", "t"]).where("y <> x and l1 <= l2 and l2 <= l3 and c1 <> c2 and c2 <> c3 and c1 <> c3").select(F.col("t").alias("d")).distinct()


def future_branch_dependency(g: Cpg) -> DataFrame:
    return g.conditions.where("kind in ('IF', 'SWITCH')").join(g.holds, "x").join(g.decls, "d").where("cs_line >= d_line").select("d").distinct()


def future_recursive_call(g: Cpg) -> DataFrame:
    c = g.label("CALL").select(F.col("id").alias("b"), F.col("name").alias("c_name"), F.col("method_full_name").alias("c_full"))
    calls = g.above(c).join(g.methods, "a").where("c_full = m_full or c_name = m_name").select(F.col("b").alias("c"), "filename")
    return calls.join(g.args.select("c", "x"), "c").join(g.holds, "x").select("d", "filename").distinct()


_ELSE, _ELSE_IF = r"\belse\b", r"\belse\s+if\b"


def _control(g: Cpg, keep: Column) -> DataFrame:
    return g.controls.where(keep).select(F.col("cs").alias("d"))


def single_control_flow(g: Cpg) -> DataFrame:
    return _control(g, (F.col("kind") == "IF") & ~F.col("cs_code").rlike(_ELSE))


def binary_control_flow(g: Cpg) -> DataFrame:
    return _control(g, (F.col("kind") == "IF") & F.col("cs_code").rlike(_ELSE) & ~F.col("cs_code").rlike(_ELSE_IF))


def n_case_control_flow(g: Cpg) -> DataFrame:
    return _control(g, (F.col("kind") == "SWITCH") | ((F.col("kind") == "IF") & F.col("cs_code").rlike(_ELSE_IF)))


def future_loop_entry(g: Cpg) -> DataFrame:
    return _control(g, F.col("kind").isin(*LOOPS3))


def future_branch_merge(g: Cpg) -> DataFrame:
    """Two nodes that depend on a branch and a later node that both lead to by POST_DOMINATE edges. Counting nodes per target needs no pairs."""
    child = g.edge("CDG").select(F.col("src").alias("cs"), F.col("dst").alias("k")).distinct()
    to = g.edge("POST_DOMINATE").select(F.col("src").alias("k"), F.col("dst").alias("m")).distinct()
    late = g.nodes.select(F.col("id").alias("m"), F.col("line_number").alias("m_line"))
    d = g.controls.where("kind in ('IF', 'SWITCH')").join(child, "cs").join(to, "k").join(late, "m").where("m_line > cs_line")
    return d.groupBy("cs", "m").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cs").alias("d")).distinct()


VARIABLES: dict[str, Callable[[Cpg], DataFrame]] = {f.__name__: f for f in (
    future_mutated_variable, fixed_value, gatherer, stepper, walker, most_recent_holder, most_wanted_holder, one_way_flag, organizer, container, variable_dependent, follower,
    future_dependency, future_return_dependency, variable_used_in_function, temporary, future_branch_dependency, future_recursive_call,
)}
CONTROL: dict[str, Callable[[Cpg], DataFrame]] = {f.__name__: f for f in (single_control_flow, binary_control_flow, n_case_control_flow, future_loop_entry, future_branch_merge)}


class Registry:
    """Concept name -> pattern; a caller may register further patterns (Cpg -> frame of var, filename and extra columns)."""

    def __init__(self):
        self.patterns: dict[str, Callable[[Cpg], DataFrame]] = {}

    def register(self, name: str, pattern: Callable[[Cpg], DataFrame]) -> None:
        self.patterns[name] = pattern

    def run(self, name: str, g: Cpg) -> DataFrame:
        """var, filename, num_writes: null where the pattern has no such column."""
        d = self.patterns[name](g)
        writes = F.col("num_writes").cast("int") if "num_writes" in d.columns else F.lit(None).cast("int")
        return d.select("var", "filename", writes.alias("num_writes"))

    def run_all(self, g: Cpg) -> DataFrame:
        """concept, var, filename, num_writes of all patterns. One after the other is added to a stored table, so that no plan holds more than one of them."""
        path = f"{shared_dir(g.nodes.sparkSession).rstrip('/')}/concepts-{uuid.uuid4().hex}"
        for n in self.patterns:
            self.run(n, g).select(F.lit(n).alias("concept"), "var", "filename", "num_writes").write.mode("append").parquet(path)
        return g.nodes.sparkSession.read.schema("concept string, var long, filename string, num_writes int").parquet(path)


def declarations_of(pattern: Callable[[Cpg], DataFrame]) -> Callable[[Cpg], DataFrame]:
    def run(g: Cpg) -> DataFrame:
        return g.found(pattern).withColumnRenamed("d", "var")

    return run


def occurrences_of(pattern: Callable[[Cpg], DataFrame]) -> Callable[[Cpg], DataFrame]:
    def run(g: Cpg) -> DataFrame:
        return declarations_of(pattern)(g).withColumnRenamed("var", "d").join(g.refs.select("d", F.col("i").alias("var")), "d").drop("d")

    return run


def default_registry() -> Registry:
    out = Registry()
    for name, f in VARIABLES.items():
        out.register(f"{name}_decl", declarations_of(f))
        out.register(name, occurrences_of(f))
    for name, f in CONTROL.items():
        out.register(name, declarations_of(f))
    return out


def annotations(found: DataFrame, nodes: DataFrame, files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(annotations, unmatched) for found (concept, var, filename, num_writes): schemas.GRAPH_ANNOTATIONS, and per concept how many records have no place.

    A record's place is the first whole-word occurrence of its name on its line (control structures: of the first line of its code, else its first word).
    Records whose file, line or name isn't there are counted, not returned.
    """
    v = nodes.select(F.col("id").alias("var"), "label", "name", "code", F.col("line_number").alias("line"), F.col("column_number").alias("column"))
    d = found.join(v, "var", "left").withColumn("path", F.concat(F.lit(root), F.col("filename")))
    lines = line_table(files).select("path", "line", F.col("text").alias("_text"), "line_start").hint("merge")
    d = d.join(lines, ["path", "line"], "left")
    control = F.col("label") == "CONTROL_STRUCTURE"
    at, size = X.code_place(F.col("_text"), F.col("code"))
    d = d.withColumns({"_at": F.when(control, at).otherwise(X.word_place(F.col("_text"), F.col("name"))), "_size": F.when(control, size).otherwise(F.length("name"))})
    start = (F.col("line_start") + F.col("_at")).cast("int")
    good = d.where("_at is not null").select("concept", "path", F.when(~control, F.col("name")).alias("variable_name"), "line", "column", "code", start.alias("span_start"), (start + F.col("_size")).alias("span_end"), "num_writes")
    return good, d.groupBy("concept").agg(F.count_if(F.col("_at").isNull()).alias("unmatched"))


def snake_case(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()
