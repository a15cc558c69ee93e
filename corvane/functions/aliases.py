"""Names brought to their one form: many patterns at once, the leftmost and longest first.

A trie of all names with failure links (pyahocorasick) is built once on the driver and sent
to the tasks with their function, so a text is read once whatever the number of names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def automaton(aliases: dict[str, str]) -> ahocorasick.Automaton:
    """Of names that are not empty; each leads to its length and its replacement."""
    out = ahocorasick.Automaton()
    for name, to in aliases.items():
        if name:
            out.add_word(name, (len(name), to))
    if len(out):
        out.make_automaton()
    return out


def replaced(text: str, names: ahocorasick.Automaton, words: bool = False) -> str:
    """text with each name replaced: of names that overlap the one that begins first, of those the longest; a replacement is not looked at again.

    words: only names that no letter or digit stands beside.
    """
    if not len(names) or not text:
        return text
    inside = lambda i: 0 <= i < len(text) and text[i].isalnum()
    found = ((end - size + 1, end + 1, to) for end, (size, to) in names.iter(text))
    hits = sorted((h for h in found if not words or not (inside(h[0] - 1) or inside(h[1]))), key=lambda h: (h[0], -h[1]))
    out, at = [], 0
    for start, end, to in hits:
        if start >= at:
            out += [text[at:start], to]
            at = end
    return "".join([*out, text[at:]])


def normalized(rows: DataFrame, aliases: dict[str, str], column: str = "query", words: bool = False) -> DataFrame:
    """rows with the names in a column brought to their one form, and the text as it was in <column>_original; null stays null.

    aliases goes to every task, so it is a list of names and not a table: its size is checked by the sender.
    """
    names, own = automaton(aliases), f"{column}_original"
    kept = [c for c in rows.columns if c != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([t if t is None else replaced(t, names, words) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == column else batch.column(c) for c in kept] + [batch.column(column)], names=[*kept, own])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept]
    return rows.select(*kept).mapInArrow(run, ", ".join([*schema, f"`{own}` string"]))
