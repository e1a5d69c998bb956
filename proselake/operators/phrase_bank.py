"""Stock expressions found by one automaton: any number of variants, one plan of constant size.

All words and phrases of a bank stand in two Aho-Corasick automata, one over sentences and one over their joined words, which
are built once on the driver, broadcast, and run over Arrow batches of sentences. What a sentence costs grows with its length
and its hits, not with the bank. A bank beyond the size that may be broadcast is searched part by part, groups staying whole.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proselake.functions import text as T

#: Phrases of up to EXACT words are looked up as they are, longer ones by their triples in windows of PADDING more.
EXACT, PADDING = 3, 2
BOUNDARY = re.compile(r"""[.!?]["”’'*_)\]]*(\s|[A-Z])""")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(patterns: dict[str, list]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, what in patterns.items():
        a.add_word(p, (len(p), what))
    if patterns:
        a.make_automaton()
    return a if patterns else None


@dataclass
class Bank:
    """Groups of a bank, compiled; a group's number is its place in the whole bank."""

    variants: list[tuple[int, str, int, int]] = field(default_factory=list)  # group, phrase, words, distinct triples
    regexes: list[tuple[int, str]] = field(default_factory=list)
    words: dict[str, list[int]] = field(default_factory=dict)  # over sentences in lower case
    phrases: dict[str, list] = field(default_factory=dict)  # over joined words: phrases, and triples between spaces
    size: int = 0

    def add(self, k: int, group) -> None:
        if isinstance(group, dict) and group.get("kind") == "regex":
            pattern = (group.get("pattern") or "").strip()
            try:
                re.compile(pattern)
            except re.error:  # one bad pattern of a user must not stop the audit
                return
            if pattern:
                self.regexes.append((k, pattern))
                self.size += len(pattern)
            return
        for v in (group.get("variants") or []) if isinstance(group, dict) else group:
            t = re.findall(T.PHRASE_TOKEN, v.lower())
            grams = {" ".join(t[j : j + 3]) for j in range(len(t) - 2)} if len(t) > EXACT else set()
            at = len(self.variants)
            self.variants.append((k, v, len(t), len(grams)))
            self.size += len(v) * (3 if grams else 1)
            if len(t) == 1:
                self.words.setdefault(v, []).append(at)
            elif grams:
                for g in grams:
                    self.phrases.setdefault(f" {g} ", [None, []])[1].append(at)
            elif t:
                found = self.phrases.setdefault(" ".join(t), [[], []])
                found[0] = [*(found[0] or []), at]

    def compiled(self) -> bytes:
        return pickle.dumps((self.variants, self.regexes, _automaton(self.words), _automaton(self.phrases)))


class Matcher:
    """The best variant of each group in a sentence."""

    def __init__(self, compiled: bytes, threshold: float):
        self.variants, regexes, self.words, self.phrases = pickle.loads(compiled)
        self.regexes = [(k, re.compile(p, re.IGNORECASE)) for k, p in regexes]
        self.threshold = threshold

    def hits(self, sentence: str, joined: str) -> list[tuple[int, str, float]]:
        """(group, phrase, score) in order of the groups; of equal scores the variant that comes first."""
        best: dict[int, tuple[float, int]] = {}

        def offer(at: int, score: float) -> None:
            k = self.variants[at][0]
            if score > 0 and (k not in best or (score, -at) > (best[k][0], -best[k][1])):
                best[k] = score, at

        if self.words is not None:
            lower = sentence.lower()
            for end, (n, found) in self.words.iter(lower):
                start, after = end - n + 1, end + 1
                first = _is_word(lower[start]) != (start > 0 and _is_word(lower[start - 1]))
                if first and _is_word(lower[end]) != (after < len(lower) and _is_word(lower[after])):
                    for at in found:
                        offer(at, 1.0)
        if self.phrases is not None:
            padded, places = f" {joined} ", {}
            spaces: list[int] | None = None
            for end, (n, (whole, long)) in self.phrases.iter(padded):
                for at in whole or ():
                    offer(at, 1.0)
                if long:
                    if spaces is None:
                        spaces = [k for k, c in enumerate(padded) if c == " "]
                    word = bisect_right(spaces, end - n + 1) - 1  # the word that begins the triple
                    for at in long:
                        places.setdefault(at, []).append((word, end, n))
            for at, found in places.items():
                offer(at, self._share(at, [(w, padded[e - n + 1 : e + 1]) for w, e, n in found], len(spaces) - 1))
        out = [(k, self.variants[at][1], score) for k, (score, at) in best.items()]
        for k, rx in self.regexes:
            m = rx.search(sentence)
            text = m.group(0).strip() if m else ""
            if text and not BOUNDARY.search(text):
                out.append((k, text, 1.0))
        return sorted(out)

    def _share(self, at: int, found: list[tuple[int, str]], n_words: int) -> float:
        """The largest share of the variant's triples in a window; windows that begin at a hit hold the best."""
        _, _, size, n_grams = self.variants[at]
        wide = min(size + PADDING, n_words) - 3
        most = max(len({g for w, g in found if s <= w <= s + wide}) for s, _ in found)
        score = most / n_grams
        return score if score >= self.threshold else 0.0


_MATCHERS: dict[str, Matcher] = {}


def banks(groups: list, most_chars: int = 32 << 20) -> list[Bank]:
    """The bank in parts of about `most_chars` characters at most; a group stays whole."""
    parts = [Bank()]
    for k, group in enumerate(groups):
        if parts[-1].size >= most_chars:
            parts.append(Bank())
        parts[-1].add(k, group)
    return parts


def found(sentences: DataFrame, groups: list, threshold: float = 0.4, most_chars: int = 32 << 20) -> DataFrame:
    """Stock expressions in rows that have a column `sentence`: all columns and grp, phrase, score, a row for each group that fits.

    A group is a list of variants, a dict with `variants`, or a dict of kind "regex" with a `pattern`. One word must stand whole
    in the sentence; two or three must stand in its joined words; longer ones score the largest share of their distinct word
    triples that a window of two more words holds. A match of a pattern scores 1 unless it spans a sentence boundary; patterns
    that don't compile are left out. Null sentences, empty banks and variants without words find nothing.
    """
    spark = sentences.sparkSession
    rows = sentences.where("sentence IS NOT NULL").withColumn("_joined", F.array_join(T.tokens("sentence", T.PHRASE_TOKEN), " "))
    kept = sentences.columns
    schema = StructType([*sentences.schema.fields, *StructType.fromDDL("grp int, phrase string, score double").fields])

    def searched(bank: Bank) -> DataFrame:
        compiled, key = spark.sparkContext.broadcast(bank.compiled()), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _MATCHERS:  # once for each worker
                _MATCHERS[key] = Matcher(compiled.value, threshold)
            matcher = _MATCHERS[key]
            for b in batches:
                at, grp, phrase, score = [], [], [], []
                place = {n: k for k, n in enumerate(b.schema.names)}
                for k, (s, j) in enumerate(zip(b.column(place["sentence"]).to_pylist(), b.column(place["_joined"]).to_pylist())):
                    for g, p, x in matcher.hits(s, j):
                        at.append(k)
                        grp.append(g)
                        phrase.append(p)
                        score.append(x)
                if at:
                    columns = [b.column(place[n]).take(pa.array(at)) for n in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(grp, pa.int32()), pa.array(phrase), pa.array(score)], names=[*kept, "grp", "phrase", "score"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, (searched(b) for b in banks(groups, most_chars)))
