"""All keywords of many groups found in one pass over a text, by an Aho-Corasick automaton.

The time for a text follows its length and the matches in it, not the number of keywords. The automaton is made once in each
worker from the keywords, which are part of the function and go out with the task: they are lists that people write.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Groups = tuple[tuple[str, ...], ...]


@cache
def automaton(groups: Groups) -> tuple[ahocorasick.Automaton | None, frozenset[int]]:
    """The automaton, each keyword with the groups that have it; and the groups with an empty keyword, which every text holds."""
    of = defaultdict(set)
    for i, words in enumerate(groups):
        for w in words:
            of[w].add(i)
    always = frozenset(of.pop("", ()))
    if not of:
        return None, always
    found = ahocorasick.Automaton()
    for w, numbers in of.items():
        found.add_word(w, frozenset(numbers))
    found.make_automaton()
    return found, always


def find_groups(text: str | None, groups: Groups) -> list[int] | None:
    """The groups a keyword of which is in the text, in order; null for a null text."""
    if text is None:
        return None
    found, always = automaton(groups)
    out = set(always)
    if found is not None:
        for _, numbers in found.iter(text):
            out |= numbers
            if len(out) == len(groups):
                break
    return sorted(out)


def groups_in(c: Column, groups: Groups) -> Column:
    """An array of the numbers of the groups a keyword of which is in the text."""
    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_groups(t, groups), na_action=None)

    return find(c)


def first_group(c: Column, groups: Groups) -> Column:
    """The least number of a group a keyword of which is in the text, or null."""
    return F.try_element_at(groups_in(c, groups), F.lit(1))
