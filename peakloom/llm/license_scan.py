"""Licenses in texts by template markup: optional and replaceable regions are compiled into one automaton over words.

A template is a row of words with regions that may be left out and regions that stand for other words. Its automaton has a
state for each place where a word is read; the automata of all templates, and of plain phrases, run side by side over the
words of a whole text, wherever a template may begin. A place is accepted if its mandatory wording is there word for word;
of the places of one template that overlap, the one that begins first and is longest stands. A thread of the automaton is a
state and the word where it began; a place has no more words than its template allows, so the threads alive are bounded by
the templates and time is linear in the text.

Null texts have no words, and so have texts without letters, digits or characters beyond ASCII. Rows of equal doc_id are
scanned each by itself; a null doc_id stays null; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import executor_task, read_table, ship, text_bytes, text_slices
from .license_templates import PHRASES, TEMPLATES

#: A-Z become a-z; digits, a-z and bytes of other alphabets stay; the rest are separators.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PLACE = "label string, template string, base boolean, first_word long, last_word long, from_char long, to_char long"
#: Scores of a text with an accepted template, and with base phrases alone.
TEMPLATE_SCORE, PHRASE_SCORE = 1.0, 0.5


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


@dataclass
class Region:
    """kind: words (``items`` are words), optional (regions), one (a word out of ``items``), free (``low`` to ``high`` words)."""

    kind: str
    items: list = field(default_factory=list)
    low: int = 0
    high: int = 0


def parse(markup: str) -> list[Region]:
    """The regions of a template."""
    stack: list[list[Region]] = [[]]
    for i, piece in enumerate(re.split(r"<<(.*?)>>", markup, flags=re.S)):
        if not i % 2:
            if own := words_of(piece.encode()):
                stack[-1].append(Region("words", own))
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(Region("optional", inner))
        else:
            options = dict(x.split("=", 1) for x in piece.split(";")[1:])
            if not piece.startswith("var;") or ("match" in options) == ("words" in options):
                raise ValueError(f"unknown markup <<{piece}>>")
            if "match" in options:
                stack[-1].append(Region("one", [w.lower().encode() for w in options["match"].split("|")]))
            else:
                low, high = map(int, options["words"].split("-"))
                stack[-1].append(Region("free", low=low, high=high))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """One automaton for all templates: ``reads[s]`` are the word numbers that state s takes (None: any word), ``after[s]`` the
    states that may follow, ``ends[s]`` the template that may be whole after it (-1: none)."""

    def __init__(self, templates: list[tuple[str, str, str, bool]]):
        """templates: (name, label, markup, base)."""
        self.templates = templates
        self.numbers: dict[bytes, int] = {}
        self.reads: list[frozenset[int] | None] = []
        self.after: list[set[int]] = []
        self.ends: list[int] = []
        self.first: set[int] = set()
        for t, (name, _, markup, _) in enumerate(templates):
            first, last, empty = self._row(parse(markup))
            if empty or any(self.reads[s] is None for s in first):
                raise ValueError(f"template {name} must begin with a word of its own")
            for s in last:
                self.ends[s] = t
            self.first |= first
        n = len(self.numbers) + 1
        # pairs of words with which some template may begin; number 0 is any other word
        self.opens = np.zeros((n, n), dtype=bool)
        for s in self.first:
            here = list(self.reads[s])
            if self.ends[s] >= 0 or any(self.reads[a] is None for a in self.after[s]):
                self.opens[here, :] = True
            for a in self.after[s]:
                if self.reads[a] is not None:
                    self.opens[np.ix_(here, list(self.reads[a]))] = True

    def _state(self, words: list[bytes] | None) -> int:
        self.reads.append(None if words is None else frozenset(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words))
        self.after.append(set())
        self.ends.append(-1)
        return len(self.reads) - 1

    def _row(self, regions: list[Region]) -> tuple[set[int], set[int], bool]:
        """(states that may come first, last, may it be empty) of regions one after the other."""
        first, last, empty = set(), set(), True
        for r in regions:
            for f, e, n in self._steps(r):
                for s in last:
                    self.after[s] |= f
                first = first | f if empty else first
                last = last | e if n else e
                empty = empty and n
        return first, last, empty

    def _steps(self, r: Region) -> Iterator[tuple[set[int], set[int], bool]]:
        if r.kind == "optional":
            first, last, _ = self._row(r.items)
            yield first, last, True
        elif r.kind == "free":
            states = [self._state(None) for _ in range(r.high)]
            for a, b in zip(states, states[1:], strict=False):
                self.after[a].add(b)
            yield ({states[0]}, set(states[max(0, r.low - 1) :]), r.low == 0) if states else (set(), set(), True)
        else:
            for w in [[w] for w in r.items] if r.kind == "words" else [r.items]:
                s = self._state(w)
                yield {s}, {s}, False

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, last word) of each place, by first word."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), dtype=np.int32, count=len(words))
        begins = np.flatnonzero(self.opens[ids, np.append(ids[1:], 0)]).tolist() if len(ids) else []
        found: list[tuple[int, int, int]] = []
        at, k = 0, 0
        threads: dict[int, set[int]] = {}
        while threads or k < len(begins):
            if not threads:
                at = max(at, begins[k])
            if at >= len(words):
                break
            while k < len(begins) and begins[k] < at:
                k += 1
            if k < len(begins) and begins[k] == at:
                for s in self.first:
                    threads.setdefault(s, set()).add(at)
            word, on = int(ids[at]), {}
            for s, began in threads.items():
                take = self.reads[s]
                if take is None or word in take:
                    if self.ends[s] >= 0:
                        found += [(self.ends[s], b, at) for b in began]
                    for a in self.after[s]:
                        on.setdefault(a, set()).update(began)
            threads = on
            at += 1
        # of overlapping places of a template, the first begun and longest
        out, until = [], {}
        for t, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
            if until.get(t, -1) < a:
                out.append((t, a, b))
                until[t] = b
        return out


def _characters(data: bytes, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """(first character, character after the last) of the words of these numbers."""
    out, byte, char = {}, 0, 0
    for i, m in enumerate(re.finditer(rb"[^ ]+", data.translate(WORD_TABLE))):
        if i in wanted:
            char += len(data[byte : m.start()].decode("utf-8", "surrogatepass"))
            end = char + len(data[m.start() : m.end()].decode("utf-8", "surrogatepass"))
            out[i] = char, end
            byte, char = m.end(), end
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, template, base, first and last word, and the characters from and to): every place of every
    phrase (label -> words; base) and template (name, label, markup) in the whole texts."""
    ship(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    every = [(f"phrase-{label}", label, words, True) for label, words in phrases.items()] + [(*x, False) for x in (TEMPLATES if templates is None else templates)]
    kind = docs.schema["doc_id"].dataType.simpleString()

    @executor_task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(every)
        empty = pa.array([], pa.struct([("label", pa.string()), ("template", pa.string()), ("base", pa.bool_()), *[(c, pa.int64()) for c in ("first_word", "last_word", "from_char", "to_char")]]))
        for ids, texts in text_slices(batches):
            counts, lists = [], []
            for t in texts:
                data = text_bytes(t.as_py())
                words = words_of(data)
                places = machine.places(words)
                counts.append(len(words))
                char = _characters(data, {i for p in places for i in p[1:]}) if places else {}
                lists.append([{"label": every[t][1], "template": every[t][0], "base": every[t][3], "first_word": a, "last_word": b, "from_char": char[a][0], "to_char": char[b][1]} for t, a, b in places])
            yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array(lists, pa.list_(empty.type))], names=["doc_id", "n_words", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<{PLACE.replace(' ', ':').replace(',:', ', ')}>>")


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; score: 1 with an accepted template, one half with base phrases alone, else 0."""
    found = scan_licenses(read_table(spark, sf_dir, "documents")).withColumn("base", F.filter("places", lambda p: p["base"]))
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.col(f"{c}.label"))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.when(F.exists("places", lambda p: ~p["base"]), TEMPLATE_SCORE).when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0).alias("score"),
    )


def _pattern(regions: list[Region]) -> str:
    out = ""
    for r in regions:
        if r.kind == "words":
            out += "".join(f" {w.decode()}" for w in r.items)
        elif r.kind == "optional":
            out += f"(?:{_pattern(r.items)})?"
        elif r.kind == "one":
            out += f" (?:{'|'.join(w.decode() for w in r.items)})"
        else:
            out += f"(?: [^ ]+){{{r.low},{r.high}}}"
    return out


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


#: The templates as regular expressions over the words with single spaces between.
OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT k, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
ph AS (SELECT * FROM (VALUES {_values(list(PHRASES.items()))}) AS x(label, words)),
b AS (SELECT k, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + len(string_split(words, ' '))], ' ') = words)) AS i FROM n, ph WHERE contains(line, ' ' || words || ' ')),
bs AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY k),
tp AS (SELECT * FROM (VALUES {_values([(label, _pattern(parse(markup)) + " ") for _, label, markup in TEMPLATES])}) AS x(label, pattern)),
t AS (SELECT DISTINCT k, label FROM n, tp WHERE regexp_matches(line, pattern)),
bl AS (SELECT k, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT k, label FROM b) GROUP BY k),
al AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION SELECT k, label FROM t) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN k IN (SELECT k FROM t) THEN {TEMPLATE_SCORE}::DOUBLE WHEN n_base > 0 THEN {PHRASE_SCORE}::DOUBLE ELSE 0::DOUBLE END AS score
FROM n LEFT JOIN bs USING (k) LEFT JOIN bl USING (k) LEFT JOIN al USING (k)"""
