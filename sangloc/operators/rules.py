"""Rule registry, the order in which rules run, and the column conventions that every rule follows.

A rule takes a DataFrame of postings (and, if it needs them, the dictionary tables and the key) and
returns it with `<name>_count INT` and `<name>_msg STRING` added; an empty message means
no violation.

A rule states the columns it reads, those it adds besides these two, and those it repairs.  A step only adds columns, for rules to
read.  `ordered` finds the steps that some rules need and an order in which every column is made before
it is read and repaired before others read it; `applied` runs them and drops a step's columns after their last use.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[..., DataFrame]


@dataclass(frozen=True)
class Node:
    """A rule or a step, with the columns that it reads, makes, and repairs in place."""

    name: str
    run: Rule
    reads: tuple[str, ...]
    makes: tuple[str, ...]
    repairs: tuple[str, ...]
    is_step: bool

    @property
    def wants(self) -> tuple[str, ...]:
        """Which of `dims` and `key` the function takes."""
        return tuple(p for p in inspect.signature(self.run).parameters if p in ("dims", "key"))


#: Rules by name and profile, and steps by name, in the order in which they were defined.
RULES: dict[tuple[str, str], Node] = {}
STEPS: dict[str, Node] = {}


@dataclass(frozen=True)
class Dictionaries:
    """The dictionary tables that a user supplies.

    province_alias(alias, province, province_id), district_province(district, province),
    places(words, kind in workplace|district|province), stopwords(word),
    topics(term, related_term).
    """

    province_alias: DataFrame
    district_province: DataFrame
    places: DataFrame
    stopwords: DataFrame
    topics: DataFrame


def rule(
    name: str, profile: str = "posting", reads: Sequence[str] = (), makes: Sequence[str] = (), repairs: Sequence[str] = ()
) -> Callable[[Rule], Rule]:
    def register(fn: Rule) -> Rule:
        RULES[name, profile] = Node(name, fn, tuple(reads), tuple(makes), tuple(repairs), False)
        return fn

    return register


def step(reads: Sequence[str], makes: Sequence[str]) -> Callable[[Rule], Rule]:
    def register(fn: Rule) -> Rule:
        STEPS[fn.__name__] = Node(fn.__name__, fn, tuple(reads), tuple(makes), (), True)
        return fn

    return register


def rule_of(name: str, profile: str) -> Node:
    """The rule of a profile; where it has none of its own, that of the posting profile."""
    return RULES.get((name, profile)) or RULES[name, "posting"]


def ordered(rules: Iterable[Node], columns: Iterable[str]) -> list[Node]:
    """The rules and the steps they need, over a table with these columns, in an order that respects reads and repairs.

    Rules that repair the same column do so in the order given.  Raises ValueError for a column that nothing makes.
    """
    rules, have = list(rules), set(columns)
    makers = {c: n for n in (*STEPS.values(), *rules) for c in n.makes}
    chosen: dict[str, Node] = {}
    todo = list(rules)
    while todo:
        node = todo.pop(0)
        if node.name in chosen:
            continue
        chosen[node.name] = node
        for column in (*node.reads, *node.repairs):
            if column not in have and column not in makers:
                raise ValueError(f"{node.name} reads {column}, which neither the table has nor a rule makes")
            if column not in have:
                todo.append(makers[column])
    before: dict[str, set[str]] = {name: set() for name in chosen}
    repairers: dict[str, list[str]] = {}
    for node in chosen.values():
        for column in node.repairs:
            repairers.setdefault(column, []).append(node.name)
    for node in chosen.values():
        for column in (*node.reads, *node.repairs):
            chain = repairers.get(column, [])
            if column not in have:
                before[node.name].add(makers[column].name)
            before[node.name] |= set(chain[: chain.index(node.name)] if node.name in chain else chain)
        before[node.name].discard(node.name)
    place = {name: i for i, name in enumerate([*STEPS, *[n.name for n in rules]])}
    graph, out = TopologicalSorter(before), []
    graph.prepare()
    while graph.is_active():
        ready = sorted(graph.get_ready(), key=place.__getitem__)
        out += [chosen[name] for name in ready]
        graph.done(*ready)
    return out


def applied(df: DataFrame, nodes: Sequence[Node], dims: Dictionaries, key: str, keep: Iterable[str] = ()) -> DataFrame:
    """Run rules and steps in order; columns of a step go after their last reader, but for those to `keep`."""
    given, kept = set(df.columns), set(keep)
    last = {c: i for i, n in enumerate(nodes) for c in (*n.makes, *n.reads, *n.repairs)}
    made = {c for n in nodes if n.is_step for c in n.makes} - given - kept
    for i, node in enumerate(nodes):
        arguments = {"dims": dims, "key": key}
        df = node.run(df, **{name: arguments[name] for name in node.wants})
        df = df.drop(*[c for c in made if last[c] == i])
    return df


def with_violation(df: DataFrame, name: str, count: Column, message: str | Column) -> DataFrame:
    """Add the two columns of a rule from its count and the message of a violation."""
    count = F.coalesce(count.cast("int"), F.lit(0))
    message = F.lit(message) if isinstance(message, str) else message
    return df.withColumn(f"{name}_count", count).withColumn(
        f"{name}_msg", F.when(F.col(f"{name}_count") > 0, message).otherwise("")
    )


def numbered_lines(messages: Sequence[Column]) -> Column:
    """Non-empty messages as `1, ...` lines; a rule's several messages, one a line, are numbered one by one."""
    filled = F.filter(F.flatten(F.transform(F.array(*messages), lambda m: F.split(m, "\n"))), lambda m: m != "")
    return F.array_join(
        F.transform(filled, lambda m, i: F.concat((i + 1).cast("string"), F.lit(", "), m)), "\n"
    )


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
