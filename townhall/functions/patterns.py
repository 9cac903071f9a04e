"""Many names looked for in texts at once, by one automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, StructField, StructType

from townhall.functions.text import CIVIC_SUBJECTS, literals

#: Characters of names that an automaton holds; more names are looked for in blocks, each with a pass over the texts.
BLOCK_CHARS = 4_000_000
TAMIL = regex.compile("[஀-௿]")
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")


class _WordChars(dict):
    """Whether a character is part of words, each looked up once."""

    def __missing__(self, c: str) -> bool:
        is_word = self[c] = WORD.match(c) is not None
        return is_word


_word = _WordChars()


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before a place."""
    return (at > 0 and _word[text[at - 1]]) != (at < len(text) and _word[text[at]])


class Names:
    """Finds which names stand in a text: those in Tamil letter by letter, anywhere or where a word begins; others as whole words,
    in any case."""

    def __init__(self, names: tuple[str, ...], at_word_start: bool):
        self.at_word_start = at_word_start
        self.tamil, self.other = (self._automaton({k: n if tamil else n.lower() for k, n in enumerate(names) if (TAMIL.search(n) is not None) == tamil}) for tamil in (True, False))

    @staticmethod
    def _automaton(names: dict[int, str]):
        if not names:
            return None
        numbers: dict[str, list[int]] = {}
        for k, n in names.items():
            numbers.setdefault(n, []).append(k)
        automaton = ahocorasick.Automaton()
        for n, of in numbers.items():
            automaton.add_word(n, (len(n), of))
        automaton.make_automaton()
        return automaton

    def found(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if not text:
            return out
        if self.tamil is not None:
            for end, (size, of) in self.tamil.iter(text):
                if of[0] not in out and not (self.at_word_start and end >= size and TAMIL.match(text[end - size])):
                    out.update(of)
        if self.other is not None:
            low = text.lower()
            for end, (size, of) in self.other.iter(low):
                if of[0] not in out and _edge(low, end - size + 1) and _edge(low, end + 1):
                    out.update(of)
        return out


@lru_cache(maxsize=2)
def _held(names: tuple[str, ...], at_word_start: bool) -> Names:
    return Names(names, at_word_start)


def _blocks(lexicon: DataFrame) -> Iterator[tuple[list, tuple[str, ...]]]:
    """The entries and names of a lexicon in blocks, streamed to the driver."""
    entries, names, chars = [], [], 0
    for entry, name in lexicon.toLocalIterator():
        if names and chars + len(name) > BLOCK_CHARS:
            yield entries, tuple(names)
            entries, names, chars = [], [], 0
        entries.append(entry)
        names.append(name)
        chars += len(name)
    yield entries, tuple(names)


def lexicon_matches(items: DataFrame, lexicon: DataFrame, text: str, at_word_start: bool = False) -> DataFrame:
    """item_id, entry: the entries of a lexicon (entry, name) whose name stands in a text. Names may have several words.

    English names stand as whole words, in any case. Tamil ones stand anywhere or, at_word_start, where a word begins, since
    case endings follow a name. A text is read once, where it is, for all names of a block; what is shuffled are the hits.
    Null texts and empty names match nothing; names in both scripts count as Tamil; repeated rows give their hits once."""
    entry_type = lexicon.schema["entry"].dataType
    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("entry", entry_type)])

    def search(entries: list, names: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, kind = _held(names, at_word_start), to_arrow_type(entry_type)
            for b in batches:
                hits = [(i, k) for i, t in enumerate(b.column(1).to_pylist()) for k in known.found(t)]
                rows, which = [h[0] for h in hits], [h[1] for h in hits]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([entries[k] for k in which], kind)], ["item_id", "entry"])

        return run

    read, out = items.select("item_id", F.col(text).alias("in_text")).filter("in_text is not null"), None
    for entries, names in _blocks(lexicon.filter("name <> ''").select("entry", "name").distinct()):
        part = read.mapInArrow(search(entries, names), schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@lru_cache(maxsize=8)
def _any_of(words: tuple[str, ...]):
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, len(w))
    automaton.make_automaton()
    return automaton


def any_stands_in(words: tuple[str, ...], text: Column) -> Column:
    """Whether any of the words stands anywhere in a text: one pass over it, as far as the first; false for null."""

    @F.pandas_udf(BooleanType())
    def stands(texts: pd.Series) -> pd.Series:
        automaton = _any_of(words)
        return pd.Series([t is not None and next(automaton.iter(t), None) is not None for t in texts], dtype="bool")

    return stands(text)


def is_civic(low: Column) -> Column:
    """Whether a text, given in lower case, is about any of the civic subjects."""
    return any_stands_in(tuple(w for p in CIVIC_SUBJECTS.values() for w in literals(p)), low)
