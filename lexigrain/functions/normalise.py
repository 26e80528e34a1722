"""String normalisers as Column expressions.

A normaliser maps a token to its index form; the empty string means "not a valid token".
Everything runs inside whole-stage code generation: folding is a chain of regular expressions,
stemming one CASE of ordered rules. Null stays null.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as .NET's Char.IsWhiteSpace has it, as regular expression and SQL escapes.
SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def inside(inside_class: str) -> str:
    """The characters of a regular expression's class that is made of escapes and ranges of them."""
    ends = [[int(code, 16) for code in re.findall(r"\{(\w+)\}", run)] for run in re.findall(r"\\x\{\w+\}(?:-\\x\{\w+\})?", inside_class)]
    return "".join(chr(c) for run in ends for c in range(run[0], run[-1] + 1))


STOP_WORDS = {"en": tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())}


def stop_words(language: str) -> tuple[str, ...]:
    """The stop words of a language; none for languages without a list."""
    if not language.strip():
        raise ValueError("blank language")
    return STOP_WORDS.get(language.strip().lower(), ())


@lru_cache(maxsize=4)
def fold_tables(stop: int = 0x10000) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """What compatibility decomposition does to single characters below stop, combining marks counting as spaces.

    Three tables: letter with marks to its letter (a space follows), character to another one,
    and character to several. Hangul syllables are left out.
    """
    marked, single, several = {}, {}, {}
    for code in range(0xA0, stop):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        d = unicodedata.normalize("NFKD", c)
        if d == c:
            continue
        to = "".join(" " if unicodedata.category(x) == "Mn" else x for x in d)
        if len(to) == 1:
            single[c] = to
        elif len(to.rstrip(" ")) == 1 and to[0] != " ":
            marked[c] = to[0]
        else:
            several[c] = to
    return marked, single, several


def _class(characters: Iterable[str]) -> str:
    """The inside of a regular expression's class, as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(rf"\x{{{lo:x}}}" if lo == hi else rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in runs)


#: Before a class of many ranges: rules most characters out without a walk through all of them.
_NOT_ASCII = r"(?![\x{0}-\x{7f}])"


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def _decomposed_short(c: Column) -> Column:
    marked, single, _ = fold_tables()
    spaced = F.regexp_replace(c, f"({_NOT_ASCII}[{_class(marked)}])", "$1 ")
    plain = F.translate(spaced, "".join(marked) + "".join(single), "".join(marked.values()) + "".join(single.values()))
    return F.when(_beyond_ascii(c), plain).otherwise(c)


def _decomposed_long(c: Column) -> Column:
    several = fold_tables()[2]
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to a constant
    long = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(_beyond_ascii(c) & c.rlike(f"{_NOT_ASCII}[{_class(several)}]"), long).otherwise(c)


def _decomposed(c: str) -> str:
    marked, single, several = fold_tables()
    return f"{marked[c]} " if c in marked else single.get(c) or several.get(c, c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluating value once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Normaliser:
    """Base: how a token becomes its index form. name and options() go to the sidecar of a saved index."""

    def steps(self) -> list[Callable[[Column], Column]]:
        """Functions to be applied one after the other; decomposition covers all but Hangul and what lies beyond the BMP."""
        raise NotImplementedError

    def __call__(self, c: Column) -> Column:
        """The form as one expression; for whole tables, add() is faster."""
        for step in self.steps():
            c = let(c, step)
        return c

    def add(self, table: DataFrame, column: str, output: str) -> DataFrame:
        """table with the form of a column; each step is a projection, so that nothing is evaluated twice and all is generated code."""
        out = table.withColumn(output, F.col(column))
        for step in self.steps():
            out = out.withColumn(output, step(F.col(output)))
        return out

    def form(self, text: str) -> str:
        """The form of a string on the driver, for query terms and stop words."""
        raise NotImplementedError

    def spec(self) -> dict:
        return {"type": REGISTRY_NAMES[type(self)]} | self.options()

    def options(self) -> dict:
        return {}

    def literal(self, text: str) -> Column:
        """The form of a constant."""
        try:
            return F.lit(self.form(text))
        except ValueError:
            return self(F.lit(text))

    def equal(self, a: Column, b: Column) -> Column:
        """Whether two strings have the same form."""
        return self(a) == self(b)

    def hash(self, c: Column) -> Column:
        return F.xxhash64(self(c))


@dataclass(frozen=True)
class CaseNormaliser(Normaliser):
    """Lower case only."""

    def steps(self) -> list[Callable[[Column], Column]]:
        return [F.lower]

    def form(self, text: str) -> str:
        return text.lower()


@dataclass(frozen=True)
class DefaultNormaliser(Normaliser):
    """Decomposed, punctuation dropped, marks and line breaks as spaces, spaces collapsed and trimmed, lower case.

    full=True also decomposes Hangul syllables and characters beyond the BMP, which needs a Python function.
    """

    full: bool = False

    def steps(self) -> list[Callable[[Column], Column]]:
        def clean(c: Column) -> Column:
            bare = F.regexp_replace(c, r"\p{P}+", "")
            full = F.lower(F.trim(F.regexp_replace(bare, r"[\r\n\t\p{Mn} ]+", " ")))
            plain = string.ascii_letters + string.digits
            return F.when(F.translate(c, plain, "") != "", full).otherwise(F.lower(c))  # most tokens are plain; a regular expression takes ten times as long to find out

        return [*([_nfkd] if self.full else [_decomposed_short, _decomposed_long]), clean]

    def __call__(self, c: Column) -> Column:
        if not self.full:
            return super().__call__(c)
        return self.steps()[1](_nfkd(c))  # a Python function can't stand in a lambda

    def form(self, text: str) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", text) if self.full else "".join(_decomposed(c) for c in text):
            kind = unicodedata.category(c)
            if kind[0] != "P":
                out.append(" " if c in "\r\n\t" or kind == "Mn" else c)
        return " ".join(x for x in "".join(out).split(" ") if x).lower()

    def options(self) -> dict:
        return {"full": self.full}


def _nfkd(c: Column) -> Column:
    @F.pandas_udf("string")
    def decomposed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(" " if unicodedata.category(x) == "Mn" else x for x in unicodedata.normalize("NFKD", t)), na_action="ignore")

    return decomposed(c)


@dataclass(frozen=True)
class Suffix:
    """Words ending in one of the suffixes (and longer than it) lose it."""

    endings: tuple[str, ...]

    def cases(self, c: Column) -> list[tuple[Column, Column]]:
        return [(c.endswith(e) & (F.length(c) > len(e)), F.substring(c, F.lit(1), F.length(c) - len(e))) for e in self.endings]


@dataclass(frozen=True)
class Word:
    """Whole words that become the first of them."""

    words: tuple[str, ...]

    def cases(self, c: Column) -> list[tuple[Column, Column]]:
        return [(c.isin(*self.words), F.lit(self.words[0]))]


def tidy(values: Sequence[str]) -> tuple[str, ...]:
    """Trimmed, lower case, without repeats; an empty list or blank value is an error."""
    out = tuple(dict.fromkeys(v.strip().lower() for v in values))
    if not out or not all(out):
        raise ValueError("a rule needs at least one value, none of them blank")
    return out


def suffix(*values: str) -> Suffix:
    return Suffix(tidy(values))


def word(*values: str) -> Word:
    return Word(tidy(values))


PLURALS: tuple[Suffix | Word, ...] = (
    suffix("ula", "ulae", "ulas"), suffix("y", "ies"), suffix("us", "ii"), suffix("ld", "ldren"), suffix("ium", "ia"),
    suffix("ne", "nes"), suffix("me", "mes"), suffix("ue", "ues"), word("index", "indexes", "indices"),
    word("matrix", "matrices"), word("vertex", "vertices"), suffix("ses", "es", "s"), word("datum", "data"), word("man", "men"), word("woman", "women"),
)


@dataclass(frozen=True)
class StemmingNormaliser(Normaliser):
    """The first rule that applies shortens the word; a '~' marks the stem, so stems stay as they are.

    extra: further (condition, replacement) makers, tried after the rules; they cannot be saved.
    """

    rules: tuple[Suffix | Word, ...] = PLURALS
    before: Normaliser | None = field(default_factory=DefaultNormaliser)
    extra: tuple[Callable[[Column], list[tuple[Column, Column]]], ...] = ()

    def steps(self) -> list[Callable[[Column], Column]]:
        return [*(self.before.steps() if self.before is not None else [lambda c: F.lower(F.trim(c))]), self._stem]

    def __call__(self, c: Column) -> Column:
        return let(self.before(c), self._stem) if self.before is not None else super().__call__(c)

    def form(self, text: str) -> str:
        if self.extra:
            raise ValueError("rules made by functions have no form on the driver")
        text = self.before.form(text) if self.before is not None else text.strip(" ").lower()
        if not text or text.endswith("~"):
            return text
        for r in self.rules:
            if isinstance(r, Word):
                if text in r.words:
                    return f"{r.words[0]}~"
            else:
                for e in r.endings:
                    if text.endswith(e) and len(text) > len(e):
                        return f"{text[: -len(e)]}~"
        return f"{text}~"

    def _stem(self, c: Column) -> Column:
        """One '~' behind one CASE, and no more code than that: Java doesn't compile methods beyond 8000 bytes, which then take ten times as long."""
        pairs = [p for r in self.rules for p in r.cases(c)] + [p for make in self.extra for p in make(c)]
        stem = c
        if pairs:
            stem = F.when(*pairs[0])
            for p in pairs[1:]:
                stem = stem.when(*p)
            stem = stem.otherwise(c)
        return F.when((c == "") | c.endswith("~"), c).otherwise(F.concat(stem, F.lit("~")))

    def options(self) -> dict:
        if self.extra:
            raise ValueError("rules made by functions can't be saved")
        return {"rules": [{"suffix": list(r.endings)} if isinstance(r, Suffix) else {"word": list(r.words)} for r in self.rules], "before": self.before and self.before.spec()}


def PluralNormaliser(rules: tuple[Suffix | Word, ...] = PLURALS, before: Normaliser | None = DefaultNormaliser()) -> StemmingNormaliser:  # noqa: N802, B008
    """English plurals fold into the singular's stem."""
    return StemmingNormaliser(rules, before)


REGISTRY_NAMES = {CaseNormaliser: "case", DefaultNormaliser: "default", StemmingNormaliser: "stemming"}


def from_spec(spec: dict | None) -> Normaliser | None:
    """The normaliser that spec() described."""
    if spec is None:
        return None
    if spec["type"] == "case":
        return CaseNormaliser()
    if spec["type"] == "default":
        return DefaultNormaliser(spec.get("full", False))
    if spec["type"] == "stemming":
        return StemmingNormaliser(tuple(suffix(*r["suffix"]) if "suffix" in r else word(*r["word"]) for r in spec["rules"]), from_spec(spec["before"]))
    raise ValueError(f"unknown normaliser {spec['type']!r}")
