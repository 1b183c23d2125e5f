"""Folding, tokens, phrases and identifiers as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes that look like issue ids but are none.
ISSUE_DENYLIST = ["UTF-8", "UTF-16", "HTTP-2", "SHA-1", "SHA-256", "ISO-8601", "RFC-3339"]
ISSUE = r"\b([A-Z][A-Z0-9]{1,9}-\d{1,6})\b"

#: Application names that close a window title after a dash.
APP_SUFFIXES = ["Slack", "Linear", "Figma", "Notes", "Mail", "Finder", "Terminal", "iTerm2", "Google Chrome", "Chrome", "Safari", "Cockpit", "Aperçu", "Preview", "Visual Studio Code", "Windows Terminal"]

#: Words that name no subject.
TITLE_STOPWORDS = (
    "the and for with from that this into your you are was were has have new all out how why what when where which who open close file files page home main "
    "app apps http https www com org net run runs test tests les des une pour avec dans sur par aux est sont vous nous plus tout documentation docs reference "
    "guide issue pull request commit branch error failed passed review draft untitled window tab search settings general random"
).split()


def _bare(s: str) -> str:
    """Decomposed, without the accents U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f")


#: Letters that are one letter and accents, and that letter; then the accents themselves, which go.
_ACCENTED = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(_bare(c)) == 1 and _bare(c) != c]
_FROM, _TO = "".join(_ACCENTED) + "".join(map(chr, range(0x300, 0x370))), "".join(map(_bare, _ACCENTED))


def fold(text: Column) -> Column:
    """Lower case without accents, in the JVM. Letters that aren't one letter and accents when decomposed (Hangul's) stay whole."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.lower(F.translate(text, _FROM, _TO)))


def fold_text(s: str) -> str:
    """fold() of one string, for questions on the driver."""
    return s.translate(str.maketrans({**dict(zip(_FROM, _TO)), **dict.fromkeys(_FROM[len(_TO) :], "")})).lower()


def slug(folded: Column) -> Column:
    """What isn't a-z or 0-9 becomes one hyphen, none at the ends; of an already folded text."""
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize(text: Column) -> Column:
    return slug(fold(text))


def tokens(text: Column, folded: Column) -> Column:
    """Words of two characters at least of the folded text, then the parts of camel-case words, each once."""
    plain = F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 2) | F.rlike(t, F.lit("[\uac00-\ud7a3]")))
    humps = F.flatten(F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.when(F.rlike(w, F.lit("[a-z0-9][A-Z]")), F.split(w, "(?<=[a-z0-9])(?=[A-Z])")).otherwise(F.array().cast("array<string>"))))
    parts = F.filter(F.transform(humps, F.lower), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(plain, parts))


def issue_ids(text: Column) -> Column:
    """Issue ids in order, each once, without those of the deny-list."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ISSUE), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, ISSUE_DENYLIST)))


def leaf(path: Column) -> Column:
    """Last non-empty part of a path with either separator."""
    return bound(F.filter(F.split(path, r"[/\\]+"), lambda p: p != ""), lambda parts: F.get(parts, F.size(parts) - 1))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value being worked out once however often `of` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), of), 0)


def strip_app_suffix(title: Column) -> Column:
    """As if each name were cut from the end in turn: the names in reverse order, each at most once, in one pattern that is tried at blanks and dashes only."""
    names = "".join(rf"(?:\s*[—–-]\s*{re.escape(app)}\s*)?" for app in reversed(APP_SUFFIXES))
    return F.regexp_replace(title, rf"(?i)(?=[\s—–-]){names}$", "")


#: What a commit's message may begin with, and what separates the words of a title.
COMMIT_TYPE = r"(?i)^(feat|fix|chore|docs|refactor|test|style|perf|build|ci)(\([^)]*\))?!?:\s*"
TITLE_SEPARATORS = r"[\[\](){}|·•:;,.!?/\\\"'`—–-]+"


def title_words(title: Column) -> Column:
    """Words of a title that may name a subject, in order."""
    text = F.regexp_replace(strip_app_suffix(title), COMMIT_TYPE, "")
    text = F.regexp_replace(F.regexp_replace(text, ISSUE, " "), TITLE_SEPARATORS, " ")
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(TITLE_STOPWORDS) & ~F.rlike(w, F.lit(r"^\d+$")))


def title_phrases(title: Column) -> Column:
    """Words of four characters at least, then pairs of neighbours."""

    def of(words: Column) -> Column:
        pairs = F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
        return F.concat(F.filter(words, lambda w: F.length(w) >= 4), pairs)

    return bound(title_words(title), of)


def pretty(name: Column) -> Column:
    """A branch or document name for people: no kind prefix, blanks for separators, capital letters at ASCII word starts."""
    bare = F.regexp_replace(F.regexp_replace(name, "^(fix|feat|chore|refactor|investigate)/", ""), "[-_/]+", " ")
    words = F.split(bare, "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(F.transform(words, lambda w: F.when(F.rlike(w, F.lit("^[a-z]")), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))).otherwise(w)), "")
