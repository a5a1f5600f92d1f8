"""Rules kept in a table: the first whose patterns match a row decides."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.globs import to_regex
from tidewire.plans.storage import stage

#: The rules go to every task: at most so many bytes of patterns and results.
MAX_RULE_BYTES = 32 << 20
CACHED_STEPS = 1 << 16
CACHED_NAMES = 1 << 16
_END = "\0"
_ANY = f"[^{_END}]"
_LEVEL = f"[^/{_END}]"
_LINE = f"[^\n\r\x85\u2028\u2029{_END}]"


def glob_tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """A glob as literal characters, single members of a class, and runs of such members."""
    for piece in re.findall(r"(?s)\[!?.[^\]]*\]|.", pattern):
        if piece == "*":
            yield "run", _ANY
        elif piece == "?":
            yield "one", _ANY
        elif len(piece) > 1:
            yield "one", to_regex(piece).removeprefix("^(?s:").removesuffix(")\\z")
        else:
            yield "char", piece


def path_tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """A pattern of log names: one star is what is left of a level, two are any depth."""
    for piece in re.findall(r"(?s)\*\*?|[^*]", pattern):
        if piece == "*":
            yield "one", _LEVEL
            yield "run", _LEVEL
        elif piece == "**":
            yield "run", _LINE
        else:
            yield "char", piece


class _Node:
    __slots__ = ("chars", "ones", "runs", "loop", "rule")

    def __init__(self, loop: re.Pattern | None = None):
        self.chars: dict[str, _Node] = {}
        self.ones: dict[str, tuple[re.Pattern, _Node]] = {}
        self.runs: dict[str, _Node] = {}
        self.loop, self.rule = loop, None


class RuleTrie:
    """Patterns of many rules as one trie whose nodes are walked together.

    Rules that begin alike share their nodes, and what follows a node is found by its character,
    so a step costs by the nodes that are alive, not by the number of rules. Sets of live nodes
    that occurred are kept with where they led, up to ``CACHED_STEPS``."""

    def __init__(self, tokens):
        self.tokens, self.root, self.steps, self.answers = tokens, _Node(), {}, {}

    def add(self, patterns: Sequence[str], rule: int) -> None:
        """A rule whose patterns match one field each; of rules with equal patterns the least counts."""
        node = self.root
        for pattern in patterns:
            for kind, text in (*self.tokens(pattern), ("char", _END)):
                if kind == "char":
                    node = node.chars.setdefault(text, _Node())
                elif kind == "one":
                    node = node.ones.setdefault(text, (re.compile(text), _Node()))[1]
                else:
                    node = node.runs.setdefault(text, _Node(re.compile(text)))
        node.rule = rule if node.rule is None else min(node.rule, rule)

    @staticmethod
    def _closed(nodes: list[_Node]) -> frozenset[_Node]:
        """With the nodes that runs of no character lead to."""
        alive, todo = set(), list(nodes)
        while todo:
            node = todo.pop()
            if node not in alive:
                alive.add(node)
                todo += node.runs.values()
        return frozenset(alive)

    def _step(self, alive: frozenset[_Node], char: str) -> frozenset[_Node]:
        found = self.steps.get((alive, char))
        if found is None:
            reached = []
            for node in alive:
                if node.loop is not None and node.loop.fullmatch(char):
                    reached.append(node)
                if char in node.chars:
                    reached.append(node.chars[char])
                reached += [after for members, after in node.ones.values() if members.fullmatch(char)]
            if len(self.steps) >= CACHED_STEPS:
                self.steps.clear()
            found = self.steps[alive, char] = self._closed(reached)
        return found

    def first(self, fields: tuple[str, ...]) -> int | None:
        """The least rule that matches; none for a field that is null."""
        if any(f is None or _END in f for f in fields):
            return None
        if fields not in self.answers:
            alive = self._closed([self.root])
            for char in _END.join(fields) + _END:
                alive = self._step(alive, char)
                if not alive:
                    break
            if len(self.answers) >= CACHED_NAMES:
                self.answers.clear()
            self.answers[fields] = min((n.rule for n in alive if n.rule is not None), default=None)
        return self.answers[fields]


def _first_of(rules: DataFrame, order: str, patterns: Sequence[str], result: str, fields: Sequence[Column], tokens) -> Column:
    size = rules.agg(F.sum(sum(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 16 for c in [*patterns, result]))).first()[0]
    if (size or 0) > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; at most {MAX_RULE_BYTES} go to every task")
    listed = rules.filter(F.col(order).isNotNull()).select(order, *patterns, F.col(result).cast("string")).collect()
    listed = [tuple(r) for r in sorted(listed, key=lambda r: (r[0], r[-1] is not None, r[-1]))]
    made: list[RuleTrie] = []

    def find(*columns: pd.Series) -> pd.Series:
        if not made:
            made.append(RuleTrie(tokens))
            for n, (_, *texts, _) in enumerate(listed):
                if None not in texts:
                    made[0].add(texts, n)
        hits = [made[0].first(names) for names in zip(*columns)]
        return pd.Series([None if n is None else listed[n][-1] for n in hits], dtype=object)

    return F.pandas_udf(find, "string")(*fields)


def first_rule(
    rules: DataFrame,
    newsgroup: Column | None = None,
    filename: Column | None = None,
    order: str = "rule_no",
    feed: str = "feed",
    name: str = "name",
    result: str = "template",
) -> Column:
    """The ``result`` of the first rule, by ``order``, whose feed and name globs both match; null if
    none does. Rules with a null in a pattern or in the order match nothing; equal numbers go
    by their results. Only the two names of a row reach Python; nothing is shuffled.

    Collects the rules when called, after a check of their size."""
    fields = [F.col("newsgroup") if newsgroup is None else newsgroup, F.col("filename") if filename is None else filename]
    return _first_of(rules, order, [feed, name], result, fields, glob_tokens)


def _anchor(pattern: Column) -> Column:
    """The literal text that a glob begins with or, if none, ends with: ``(at_end, text)``."""
    head = F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0)
    tail = F.regexp_extract(pattern, r"(?s)[^*?\]]*\z", 0)
    # a bracket that opens no class is a character of its own; such a pattern is left to the check
    return F.struct((head == "").alias("at_end"), F.when(head == "", F.when(pattern.contains("["), "").otherwise(tail)).otherwise(head).alias("text"))


def _regexes(globs: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(to_regex, na_action="ignore"), "string")(globs)


def match_first_rule(
    rows: DataFrame,
    rules: DataFrame,
    newsgroup: str = "newsgroup",
    filename: str = "filename",
    order: str = "rule_no",
    feed: str = "feed",
    name: str = "name",
    result: str = "template",
) -> DataFrame:
    """``rows`` with the ``result`` that :func:`first_rule` gives them, for any number of rules: neither
    rules nor rows are collected.

    A rule is found by the text that its globs begin or end with, of both together, and
    then checked; rows give their names' beginnings and ends of the lengths that rules have (few
    ``shapes``). Rules without any such text meet every pair of names, as they have to."""
    best = F.struct(F.col(order).alias("no"), F.col(result).cast("string").isNotNull().alias("some"), F.col(result).cast("string").alias("result"))
    known = rules.filter(F.col(order).isNotNull() & F.col(feed).isNotNull() & F.col(name).isNotNull())
    # of rules with equal patterns the least counts
    least = known.groupBy(F.col(feed).alias("__feed"), F.col(name).alias("__name")).agg(F.min(best).alias("__best"))
    a, b = _anchor(F.col("__feed")), _anchor(F.col("__name"))
    least = least.select(
        "__best", _regexes(F.col("__feed")).alias("__feed"), _regexes(F.col("__name")).alias("__name"),
        a["at_end"].alias("fe"), F.length(a["text"]).alias("fl"), b["at_end"].alias("ne"), F.length(b["text"]).alias("nl"),
        a["text"].alias("ft"), b["text"].alias("nt"),
    )
    least = stage(least, "rules")
    shape = ["fe", "fl", "ne", "nl"]
    found = F.array_sort(F.collect_set(F.struct(*shape)))
    shapes = least.agg(found.alias("shapes"))

    def part(text: Column, at_end: Column, length: Column) -> Column:
        return F.when(at_end, F.substring(text, F.length(text) - length + 1, length)).otherwise(F.substring(text, F.lit(1), length))

    f, n = F.col("__f"), F.col("__n")
    names = rows.select(F.col(newsgroup).alias("__f"), F.col(filename).alias("__n")).distinct()
    names = names.filter(~f.contains("\0") & ~n.contains("\0"))
    asked = names.crossJoin(shapes).select("__f", "__n", F.explode("shapes").alias("s")).select("__f", "__n", "s.*")
    asked = asked.filter((F.length(f) >= F.col("fl")) & (F.length(n) >= F.col("nl")))
    asked = asked.withColumn("ft", part(f, F.col("fe"), F.col("fl"))).withColumn("nt", part(n, F.col("ne"), F.col("nl")))
    met = asked.join(least, [*shape, "ft", "nt"]).filter(F.rlike(f, F.col("__feed")) & F.rlike(n, F.col("__name")))
    first = met.groupBy("__f", "__n").agg(F.min("__best")["result"].alias(result))
    kept = rows.drop(result)
    return kept.join(first, (kept[newsgroup] == first["__f"]) & (kept[filename] == first["__n"]), "left").drop("__f", "__n")


def log_rule(rules: DataFrame, name: Column, order: str = "rule_no", pattern: str = "pattern", result: str = "keep") -> Column:
    """The same for patterns of log names: whether the first that matches keeps a record; no match drops."""
    return F.coalesce(_first_of(rules, order, [pattern], result, [name], path_tokens).cast("boolean"), F.lit(False))
