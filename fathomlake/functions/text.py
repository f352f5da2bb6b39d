"""Text expressions: accent folding, tokens, abbreviations, titles. All native columns, none a UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content in a question, folded.
STOP_WORDS = ["khong", "co", "bi", "sao", "thi", "toi", "tui", "cho", "o", "dau", "gi", "nao", "duoc", "va", "cua", "la", "the", "a", "oi", "vay", "nhu"]
# Abbreviations, replaced in this order.
ABBREVIATIONS = [("không", "ko"), ("được", "dc"), ("đăng ký", "đk"), ("giấy tờ", "gt"), ("hồ sơ", "hs"), ("bao nhiêu", "bn"), ("thủ tục", "tt"), ("tôi", "t"), ("bao lâu", "bl"), ("như thế nào", "ntn"), ("thế nào", "tn"), ("người", "ng"), ("với", "vs"), ("gì", "j"), ("biết", "bit")]
MARKS = r"\p{Mn}+"


@cache
def accents() -> tuple[str, str]:
    """Latin letters with marks, and their bare letters: by rule, those below U+1F00 whose decomposition is one base and marks."""
    pairs = {"đ": "d", "Đ": "D"}
    for x in map(chr, range(0xC0, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", x)
        if marks and base.isascii() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs[x] = base
    return "".join(pairs), "".join(pairs.values())


def strip_marks(c: Column) -> Column:
    """Without diacritics; case and punctuation stay."""
    return F.regexp_replace(F.translate(c, *accents()), MARKS, "")


def has_marks(c: Column) -> Column:
    return (F.translate(c, *accents()) != c) | c.rlike(r"\p{Mn}")


def fold(c: Column) -> Column:
    """Lower case, without marks, punctuation as spaces, single spaces."""
    bare = strip_marks(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of the folded text; none for a blank one."""
    return F.filter(F.split(fold(c), " "), lambda w: w != "")


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) with c evaluated once: inside a lambda an outer expression is evaluated again for each element."""
    return F.element_at(F.transform(F.array(c), then), 1)


def content_tokens(c: Column) -> Column:
    """Tokens without stop words; all of them where nothing else is left."""
    def kept(all_tokens: Column) -> Column:
        some = F.filter(all_tokens, lambda w: ~w.isin(STOP_WORDS))
        return F.when(F.size(some) > 0, some).otherwise(all_tokens)

    return let(tokens(c), kept)


def abbreviate(c: Column) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), ABBREVIATIONS, F.lower(c))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_words(c: Column, n: int = 6, default: str = "Cuộc trò chuyện mới") -> Column:
    found = F.array_join(F.slice(F.split(strip(F.coalesce(c, F.lit(""))), r"\s+"), 1, n), " ")
    return F.when(found == "", F.lit(default)).otherwise(found)


def any_in(c: Column, words: list[str]) -> Column:
    """Whether the text contains any of some strings: one pattern of them all, so that the text is made once."""
    return c.rlike("|".join(re.escape(w) for w in words)) if len(words) > 1 else F.contains(c, F.lit(words[0]))


def blank_as_null(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(c)


def outside_parentheses(c: Column) -> Column:
    """Pieces between commas that are not inside parentheses."""
    return F.filter(F.transform(F.split(c, r",\s*(?![^()]*\))"), strip), lambda x: x != "")


def clipped_sigmoid(c: Column, limit: float = 30.0) -> Column:
    """Values between 0 and 1 as they are, others through a sigmoid."""
    return F.when(c.between(0, 1), c).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), c)))))
