"""Segmentation and lexical functions as column expressions: no Python runs for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.functions import lexicon

#: Paragraph break, sentence boundary (the closing marks go with it), quoted span, word tokens.
PARAGRAPH = r"\n\s*\n"
SENTENCE = r"""(?<=[.!?…])["”’'*_)\]]*\s+"""
QUOTED = r'["“‘][^"”’]*(?:["”’]|\z)|[”’]'
TOKEN = r"[a-z0-9']+"
PHRASE_TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
GRAMMAR_TOKEN = r"(?U)\w+(?:'\w+)?|[^\s\w]"
GUARD_TOKEN = r"[a-z']+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def dedup_key(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def paragraphs(c: Column | str) -> Column:
    """Parts between blank lines, blank ones dropped. Null: none."""
    return F.filter(F.split(strip(F.coalesce(col(c), F.lit(""))), PARAGRAPH), lambda p: p.rlike(r"\S"))


def _pieces(parts: Column) -> Column:
    cut = F.flatten(F.transform(parts, lambda p: F.split(p, SENTENCE)))
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def sentences(c: Column | str) -> Column:
    """Sentences in order, paragraph by paragraph; dialogue stays."""
    return _pieces(paragraphs(c))


def narration(paragraph: Column | str) -> Column:
    """A paragraph without its quoted spans; an unclosed quotation takes the rest."""
    return squeeze(F.regexp_replace(col(paragraph), QUOTED, " "))


def narration_sentences(c: Column | str) -> Column:
    told = F.filter(F.transform(paragraphs(c), narration), lambda p: p != "")
    return _pieces(told)


def strip_asides(c: Column | str) -> Column:
    """Without bracketed asides, innermost first; as many turns as there are opening brackets are always enough."""
    text = col(c)
    turns = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("["))))
    return F.aggregate(turns, text, lambda t, _: F.regexp_replace(t, r"\[[^\[\]]*\]", " "))


def count_sentences(c: Column | str) -> Column:
    body = strip(F.coalesce(col(c), F.lit("")))
    pieces = F.filter(F.split(body, SENTENCE), lambda s: s.rlike(r"\S"))
    return F.when(body == "", 0).otherwise(F.greatest(F.lit(1), F.size(pieces)))


def ends_with_question(c: Column | str) -> Column:
    body = F.regexp_replace(col(c), r"""[ \t\n"”’'*_)\]}>]+\z""", "")
    return F.endswith(F.regexp_replace(body, r"[!.…]+\z", ""), F.lit("?"))


def tokens(c: Column | str, token: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(token), F.lit(0))


def ngrams(t: Column, n: int) -> Column:
    """Runs of n tokens, none if there are fewer."""
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(t, i, n))


def array_of(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def content(t: Column, stopwords=lexicon.STOPWORDS) -> Column:
    """Tokens that are no stop words; the list becomes a hash set in the plan."""
    stop = list(stopwords)
    return F.filter(t, lambda w: ~w.isin(stop)) if stop else t


def content_words(t: Column, stopwords=lexicon.STOPWORDS) -> Column:
    return F.size(content(t, stopwords))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct members that b has; 0 for an empty a."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def contains_run(short: Column, long: Column) -> Column:
    """Whether `short` stands in the longer array `long` as a run."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(long) - F.size(short) + 1))
    return (F.size(short) < F.size(long)) & F.exists(starts, lambda i: F.slice(long, i, F.size(short)) == short)


def joined_ngrams(t: Column, n: int) -> Column:
    """n-grams as texts, which are told apart by hashing; arrays would be compared one by one."""
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))


def repeated_share(t: Column, n: int) -> Column:
    """1 - distinct / all n-grams; 0 where there are n tokens or fewer."""
    return F.when(F.size(t) > n, 1 - F.size(F.array_distinct(joined_ngrams(t, n))) / (F.size(t) - n + 1)).otherwise(0.0)


def lexicon_hits(c: Column | str, terms: list[str], apart: bool = False) -> Column:
    return F.regexp_count(col(c), F.lit(lexicon.apart(terms) if apart else lexicon.pattern(terms)))


def lexicon_words(c: Column | str, apart: bool = False) -> Column:
    return F.regexp_count(col(c), F.lit(lexicon.LETTER + "+" if apart else r"(?U)\w+"))


def density(c: Column | str, terms: list[str], apart: bool = False) -> Column:
    """Lexicon hits a word; 0 for a text without words. `apart`: hits take the characters beside them."""
    text = F.coalesce(col(c), F.lit(""))
    return ratio(lexicon_hits(text, terms, apart), lexicon_words(text, apart))


def two_decimals(c: Column | str) -> Column:
    """A number with two decimals, rounded by its exact value and ties to even, as C's printf does; below 2^20 in size.

    Java's formats round the shortest decimal that stands for the number: 0.975 is a little less than its name, and becomes 0.98.
    """
    x = F.abs(col(c).cast("double"))
    high = F.floor(x * (1 << 26)) / (1 << 26)  # high * 100, what is left and its distance from a half are exact
    whole = F.floor(high * 100)
    over = (high * 100 - whole - 0.5) + (x - high) * 100
    cents = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(F.startswith(col(c).cast("string"), F.lit("-")), "-").otherwise("")
    exact = F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(x < 1 << 20, exact).otherwise(F.format_string("%.2f", col(c)))


def words_per_sentence(c: Column | str) -> Column:
    ss = sentences(c)
    words = F.aggregate(ss, F.lit(0), lambda n, s: n + F.size(F.split(s, r"\s+")))
    return ratio(words, F.size(ss))


def escaped(term: Column) -> Column:
    """The term for use in a pattern, character by character."""
    return F.regexp_replace(term, r"([^\w\s])", r"\\$1")


def model_slug(c: Column | str) -> Column:
    return F.replace(F.lower(F.element_at(F.split(col(c), "/"), -1)), F.lit("-encoder"))


def strip_asterisks(c: Column | str) -> Column:
    return strip(F.regexp_replace(strip(c), r"^\*+|\*+$", ""))
