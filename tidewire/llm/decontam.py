"""Benchmark decontamination.

The normalised items form one generalised suffix automaton over words. Documents
stream through it word by word; the automaton state and the length of the longest
match that ends at each word say which windows of the items end there. Documents
are never shuffled: a pass is one narrow stage.

An automaton has at most AUTOMATON_WORDS words, so what a task holds is bounded. A
larger benchmark is cut into several automata by the hash of its items and takes
one pass each; what a pass found is written to the shared folder for the next.

Defined results: a null or empty text has no words; a null item_id counts as the
empty string; items that share an item_id are one item; repeated documents are
judged row by row; an empty benchmark hits nothing; columns besides the named ones
are ignored by `find_contamination` and kept by `remove_contamination`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import ALNUM_WORD, alnum_words
from tidewire.plans.storage import stage

AUTOMATON_WORDS = 200_000

FOUND = "doc_id long, n_words long, hits array<struct<first:long,last:long>>, items array<string>"
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


class Automaton:
    """Generalised suffix automaton of items over words, with the windows it watches for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.moves: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._place_windows()
        self.items: dict[int, set[str]] = {}
        #: state: (words, item) of whole short items that end a match there, longest first
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            if len(words) >= window:
                for _, state, _ in self._matches(words):
                    self.items.setdefault(self.at_window[state], set()).add(item)
            elif words:
                state = 0
                for word in words:
                    state = self.moves[state][word]
                self.short.setdefault(state, []).append((len(words), item))
        self._spread_short()

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the item so far and one word more; states of earlier items are reused."""
        moves, link, length = self.moves, self.link, self.length
        if word in moves[last]:
            old = moves[last][word]
            return old if length[old] == length[last] + 1 else self._clone(last, old, word)
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = new
            at = link[at]
        if at >= 0:
            old = moves[at][word]
            link[new] = old if length[old] == length[at] + 1 else self._clone(at, old, word)
        return new

    def _clone(self, at: int, old: int, word: bytes) -> int:
        moves, link, length = self.moves, self.link, self.length
        copy = len(moves)
        moves.append(dict(moves[old]))
        length.append(length[at] + 1)
        link.append(link[old])
        link[old] = copy
        while at >= 0 and moves[at].get(word) == old:
            moves[at][word] = copy
            at = link[at]
        return copy

    def _place_windows(self) -> None:
        """For states with matches of a window or more: the state of their last window."""
        self.at_window = [-1] * len(self.moves)
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__):
            if self.length[state] >= self.window:
                up = self.link[state]
                self.at_window[state] = state if self.length[up] < self.window else self.at_window[up]

    def _spread_short(self) -> None:
        """Give every state the short items that end wherever its matches end."""
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__):
            if inherited := self.short.get(self.link[state]):
                self.short[state] = self.short.get(state, []) + inherited

    def _matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matched words) where a window or a short item may end."""
        moves, link, length, window, short = self.moves, self.link, self.length, self.window, getattr(self, "short", {})
        state = matched = 0
        for i, word in enumerate(words):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= window or state in short:
                yield i, state, matched

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (first and last), and the items whose windows occur."""
        spans, states, items = [], set(), set()
        for i, state, matched in self._matches(words):
            if matched >= self.window:
                states.add(self.at_window[state])
                spans.append((i - self.window + 1, i))
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    items.add(item)
                    spans.append((i - size + 1, i))
        for state in states:
            items |= self.items[state]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans of words; overlapping and touching ones become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def automata(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    """The automata of a benchmark, each built of at most about AUTOMATON_WORDS words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = items.where(F.col("text").isNotNull())
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = letters // (2 * AUTOMATON_WORDS) + 1
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        yield Automaton([(r["item"], alnum_words(r["text"])) for r in part.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: its number of words, the spans of words hit by windows of the
    items (first and last word), and the ids of the items whose windows occur."""
    found = docs.select("doc_id", "text")
    cut = list(automata(benchmark, window)) if not isinstance(benchmark, list) else benchmark
    for k, automaton in enumerate(cut):
        found = _pass(found if k == 0 else stage(found, "decontaminate"), automaton, k, k == len(cut) - 1)
    return found


def _pass(docs: DataFrame, automaton: Automaton, k: int, is_last: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts, hits, items = [], [], []
            for r, text in enumerate(texts):
                words = alnum_words(text)
                spans, found = machine.scan(words)
                if k:
                    spans = merged(spans + [(x["first"], x["last"]) for x in batch.column("hits")[r].as_py()])
                    found = found | set(batch.column("items")[r].as_py())
                counts.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in spans])
                items.append(sorted(found))
            columns = {"doc_id": batch.column("doc_id")} | ({} if is_last else {"text": batch.column("text")})
            columns |= {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, _HITS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, FOUND.replace("doc_id long", f"doc_id {kind}" + ("" if is_last else ", text string")))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the passages of the benchmark, in the columns they had.

    Every hit span goes from the text. A document of whose words more than
    max_coverage are hit goes altogether. n_chars, where there is one, follows.
    All automata look at the text as it was; their spans are merged before they are
    judged, so into how many automata a benchmark is cut does not matter."""
    machines = list(automata(benchmark, window))
    if len(machines) == 1:
        return docs.mapInArrow(lambda batches, of=docs.sparkSession.sparkContext.broadcast(machines[0]): _cleaned(batches, of, max_coverage), docs.schema)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.array().cast("array<struct<first:long,last:long>>").alias("hits"))
    schema = rows.schema
    for k, machine in enumerate(machines):
        held = docs.sparkSession.sparkContext.broadcast(machine)
        if k == len(machines) - 1:
            return rows.mapInArrow(lambda batches, of=held: _cleaned(batches, of, max_coverage, True), docs.schema)
        rows = stage(rows.mapInArrow(lambda batches, of=held: _marked(batches, of), schema), "decontaminate")


def _marked(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Batches (row, hits) with the hits of one more automaton."""
    for batch in batches:
        texts = pa.RecordBatch.from_struct_array(batch.column("row")).column("text").to_pylist()
        hits = [[{"first": a, "last": b} for a, b in merged(spans + held.value.scan(alnum_words(text))[0])] for text, spans in zip(texts, _spans_of(batch))]
        yield replaced(batch, "hits", pa.array(hits, batch.schema.field("hits").type))


def _spans_of(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [[(x["first"], x["last"]) for x in row] for row in batch.column("hits").to_pylist()]


def _cleaned(batches: Iterator[pa.RecordBatch], held, max_coverage: float, marked: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before = _spans_of(batch) if marked else None
        if marked:
            batch = pa.RecordBatch.from_struct_array(batch.column("row"))
        texts = batch.column("text").to_pylist()
        keep = np.ones(len(texts), bool)
        changed = {}
        for r, text in enumerate(texts):
            words = alnum_words(text)
            spans, _ = held.value.scan(words)
            if marked:
                spans = merged(spans + before[r])
            if spans:
                keep[r] = sum(b - a + 1 for a, b in spans) <= max_coverage * len(words)
                changed[r] = without(text, spans)
        if changed:
            texts = [changed.get(r, text) for r, text in enumerate(texts)]
            batch = replaced(batch, "text", pa.array(texts, batch.schema.field("text").type))
            if "n_chars" in batch.schema.names:
                old = batch.column("n_chars").to_pylist()
                sizes = [len(texts[r]) if r in changed else old[r] for r in range(len(texts))]
                batch = replaced(batch, "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
        yield batch if keep.all() else batch.filter(pa.array(keep))


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values if x == name else batch.column(i) for i, x in enumerate(batch.schema.names)], schema=batch.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words, given by their first and last word."""
    places = [m.span() for m in ALNUM_WORD.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    return "".join([*out, text[at:]])
