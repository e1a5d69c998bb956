"""Word lists and lexicon patterns; every operator takes its own list as a parameter."""

from __future__ import annotations

import re

#: Function words that don't count as content; written for this project.
STOPWORDS = tuple(
    """a an the and or but nor so yet if then than that this these those there here
    i me my mine you your yours he him his she her hers it its we us our ours they them their theirs who whom whose which what
    when where why how all any both each few more most other some such no not only own same too very just also even still
    of to in into on onto at by for from with without about above below between through during before after up down out off over under again
    is am are was were be been being do does did doing have has had having will would shall should can could may might must
    as because until while like i'm you're he's she's it's we're they're i've you've we've they've i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd isn't aren't wasn't weren't don't doesn't didn't haven't hasn't hadn't won't wouldn't can't couldn't shouldn't
    let's that's there's here's what's who's where's how's""".split()
)

#: The shorter list that the repetition guards use; fixed values.
GUARD_STOPWORDS = tuple(
    """a an the and or but if then of to in into on at by for with from up out down off over
    is are was were be been being am do does did has have had will would can could my your his
    her its their our i you he she it we they me him them this that these those there here as
    so not no yes like just""".split()
)


#: What words are made of where hits stand apart, and its complement; white space is ASCII there.
LETTER, GAP = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _terms(terms: list[str], space: str) -> str:
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return "|".join(space.join(re.escape(w) for w in t.lower().split()) for t in ordered if t.strip())


def pattern(terms: list[str]) -> str:
    """Regular expression of a lexicon: whole words, the longest term first, any white space between words."""
    parts = _terms(terms, r"\s+")
    return rf"(?iU)(?<!\w)(?:{parts})(?!\w)" if parts else r"(?!)"


def apart(terms: list[str]) -> str:
    """As pattern(), but a hit takes the characters beside it: of two with one character between them only the first counts.

    Case is ignored for A-Z alone, and marks are no part of a word.
    """
    parts = _terms(terms, r"[ \t\n\f\r]+")
    return rf"(?i)(?:\A|{GAP})(?:{parts})(?:\z|{GAP})" if parts else r"(?!)"
