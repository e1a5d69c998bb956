"""Sentences of texts that arrive in pieces: each is emitted as soon as its end is certain, the rest when its text ends.

A boundary is certain once something follows its white space, since more of it could make a paragraph's end of a sentence's.
What is kept of a text is its last, open sentence and pieces that came too early; nothing is kept of a text that has ended.
Texts are dealt to shards by their key, and a shard's open texts are one value of state: it is read and written once a batch,
and its pieces come as one frame, however many texts they belong to.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proselake.functions import text as T
from proselake.streaming.state import key_of, named

#: Fixed values, as in functions.text: white space is ASCII; a boundary's closing marks go with it.
SPACE = r"[ \t\n\x0b\f\r]"
PARAGRAPH = re.compile(rf"\n{SPACE}*\n(?={SPACE}*[^ \t\n\x0b\f\r])")
SENTENCE = re.compile(rf"""(?<=[.!?…])["”’'*_)\]]*{SPACE}+(?=[^ \t\n\x0b\f\r])""")


def sentences_of(text: str) -> list[str]:
    """What functions.text.sentences() gives."""
    white = " \t\n\x0b\f\r"
    parts = [p for p in re.split(T.PARAGRAPH, text.strip(white), flags=re.ASCII) if p.strip(white)]
    return [s for p in parts for s in (x.strip(white) for x in re.split(T.SENTENCE, p, flags=re.ASCII)) if s]


def closed(text: str) -> tuple[list[str], str]:
    """The sentences of a text so far that nothing after it can change, and what is still open."""
    ends = [m.end() for pattern in (PARAGRAPH, SENTENCE) for m in pattern.finditer(text)]
    if not ends:
        return [], text
    return sentences_of(text[: max(ends)] + "x")[:-1], text[max(ends) :]  # something follows, as it does in the whole text


class _Segmenter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "texts string")  # by key: text, sentences told, next piece, early pieces

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.open.exists()
        texts = json.loads(self.open.get()[0]) if was else {}
        got: dict[str, list[tuple[int, str, bool]]] = {}
        for part in rows:
            for name, at, delta, last in zip(*(part[c].tolist() for c in ("key", "at", "delta", "last"))):
                got.setdefault(name, []).append((int(at), delta or "", bool(last)))
        names, places, told = [], [], []
        for name, pieces in got.items():
            text, n, following, before = texts.pop(name, ("", 0, 0, ()))
            early, parts, ended = [], [text], False
            for at, delta, last in sorted([*pieces, *map(tuple, before)]):
                if at > following:
                    early.append((at, delta, last))
                elif at == following and not ended:  # a piece that came before is left out
                    parts.append(delta)
                    following, ended = at + 1, last
            text = "".join(parts)
            done, text = (sentences_of(text), "") if ended else closed(text)
            if not ended:
                texts[name] = (text, n + len(done), following, early)
            names += [name] * len(done)
            places += range(n, n + len(done))
            told += done
        if texts:
            self.open.update((json.dumps(texts),))
        elif was:
            self.open.clear()
        if told:
            yield pd.DataFrame({"key": names, "i": pd.array(places, "int32"), "sentence": told})

    def close(self) -> None:
        pass


def sentence_stream(deltas: DataFrame, key: str = "doc_id", shards: int = 1024) -> DataFrame:
    """(key, i, sentence) of texts whose pieces come as (key, at, delta, last): at counts from 0, the last piece is marked.

    Pieces may come in any order and more than once until the text has ended; a null piece is empty. Texts with a null key
    have no rows. A text whose last piece doesn't come keeps its open sentence in state. `shards` must stay as it is as long as
    the state is used; a shard's new pieces and open texts meet in a task.
    """
    rows = deltas.where(F.col(key).isNotNull()).select(named(key).alias("key"), F.col("at").cast("long").alias("at"), "delta", "last")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = dealt.groupBy("shard").transformWithStateInPandas(_Segmenter(), "key string, i int, sentence string", "append", "None")
    return found.select(key_of("key", deltas.schema[key].dataType).alias(key), "i", "sentence")


def in_pieces(texts: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """(key, at, delta, last): texts cut into pieces of `size` characters; an empty or null text is one empty piece."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut: Column = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    parts = F.when(text == "", F.array(F.lit(""))).otherwise(cut)
    told = texts.select(key, F.size(parts).alias("n"), parts.alias("_parts"))  # beside an explode, a text would be cut again for each of its pieces
    rows = told.select(key, "n", F.posexplode("_parts").alias("at", "delta"))
    return rows.select(key, F.col("at").cast("long").alias("at"), "delta", (F.col("at") == F.col("n") - 1).alias("last"), "n")
