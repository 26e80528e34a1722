"""Tokenisers as DataFrame transformations.

A breaker takes texts (a column `text`) and returns a row per token with token, multiplier, token_idx,
src_idx and src_len beside the columns it was given. The tokens of a text are an array made from that text
alone: nothing is shuffled or sorted, and a task holds one text's tokens at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.normalise import SPACE, inside, let

#: The 21 characters that break tokens besides white space; ' and - do not.
DEFAULT_BREAKS = "<>[](){}.,:;\"?!/\\@+|="


def escaped(characters: str) -> str:
    """Characters as the inside of a regular expression's class, for Spark and DuckDB alike."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in characters)


@dataclass(frozen=True)
class Breaker:
    """Base of tokenisers."""

    def tokens(self, text: Column, positions: bool = True) -> Column:
        """The array of (token, multiplier, token_idx, src_idx, src_len) of a text, in order. Without positions src_idx is null, and src_len of a run of several tokens."""
        raise NotImplementedError

    def pieces(self, text: Column, positions: bool = True) -> Column | None:
        """The array of (piece, start), if tokens are pieces of the text as it is; None if they are more than that."""
        return None

    def break_text(self, texts: DataFrame, positions: bool = True) -> DataFrame:
        """Tokens of each row's `text`. Without a use for positions, src_idx is left null, which costs less."""
        keep = [c for c in texts.columns if c != "text"]
        pieces = self.pieces(F.col("text"), positions)
        if pieces is None:
            return texts.select(*keep, F.explode(self.tokens(F.col("text"), positions)).alias("_token")).select(*keep, "_token.*")
        # what follows from a piece is left to generated code
        rows = texts.select(*keep, F.posexplode(pieces).alias("token_idx", "_piece"))
        return rows.select(*keep, F.col("_piece.piece").alias("token"), F.lit(1.0).alias("multiplier"), "token_idx", F.col("_piece.start").alias("src_idx"), F.length("_piece.piece").alias("src_len"))


def split(text: Column, inside_class: str, positions: bool) -> Column:
    """The array of (piece, start) between the characters of a regular expression's class, without empty pieces; a piece
    starts behind the character that ends the one before."""
    pieces = F.split(text, f"[{inside_class}]", -1)
    if not positions:
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(p.alias("piece"), F.lit(None).cast("int").alias("start")))
    characters = inside(inside_class)
    ends = F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(*characters), i + 1)))
    return F.filter(F.arrays_zip(pieces.alias("piece"), F.concat(F.array(F.lit(0)), ends).alias("start")), lambda p: p["piece"] != "")


def _token(token: Column, multiplier: Column, token_idx: Column, src_idx: Column, src_len: Column) -> Column:
    return F.struct(token.alias("token"), multiplier.alias("multiplier"), token_idx.cast("int").alias("token_idx"), src_idx.cast("int").alias("src_idx"), src_len.cast("int").alias("src_len"))


def _numbered(pieces: Column, multiplier: Callable[[Column], Column]) -> Column:
    return F.transform(pieces, lambda p, i: _token(p["piece"], multiplier(p), i, p["start"], F.length(p["piece"])))


@dataclass(frozen=True)
class SplitBreaker(Breaker):
    """Splits at given characters only; other breakers may split its tokens again."""

    characters: str

    def pieces(self, text: Column, positions: bool = True) -> Column:
        return split(text, escaped(self.characters), positions)

    def tokens(self, text: Column, positions: bool = True) -> Column:
        return _numbered(self.pieces(text, positions), lambda p: F.lit(1.0))


@dataclass(frozen=True)
class WhitespaceBreaker(Breaker):
    """Splits at white space, and at extra characters; tokens of a wrapped breaker are split again,
    with offsets and multipliers carried over."""

    extra: str = ""
    wrapped: Breaker | None = None

    def pieces(self, text: Column, positions: bool = True) -> Column | None:
        return split(text, SPACE + escaped(self.extra), positions) if self.wrapped is None else None

    def tokens(self, text: Column, positions: bool = True) -> Column:
        if self.wrapped is None:
            return _numbered(self.pieces(text, positions), lambda p: F.lit(1.0))

        def again(t: Column) -> Column:
            return F.transform(split(t["token"], SPACE + escaped(self.extra), positions), lambda p: F.struct(p["piece"].alias("piece"), (t["src_idx"] + p["start"]).alias("start"), t["multiplier"].alias("multiplier")))

        return _numbered(F.flatten(F.transform(self.wrapped.tokens(text, positions), again)), lambda p: p["multiplier"])


@dataclass(frozen=True)
class ExtendingBreaker(Breaker):
    """Turns the given characters into spaces, one for one, before another breaker splits."""

    characters: str
    inner: Breaker = WhitespaceBreaker()

    def spaced(self, text: Column) -> Column:
        return F.translate(text, self.characters, " " * len(self.characters))

    def pieces(self, text: Column, positions: bool = True) -> Column | None:
        return self.inner.pieces(self.spaced(text), positions)

    def tokens(self, text: Column, positions: bool = True) -> Column:
        return self.inner.tokens(self.spaced(text), positions)


def default_breaker() -> Breaker:
    """White space and the usual punctuation."""
    return WhitespaceBreaker(DEFAULT_BREAKS)


@dataclass(frozen=True)
class NgramBreaker(Breaker):
    """Runs of 1 to longest tokens, joined by a space and placed at the first of them.

    weight gets an array column of the multipliers of the run and gives its multiplier (0 < m <= 1).
    """

    longest: int
    inner: Breaker
    weight: Callable[[Column], Column] = lambda multipliers: F.array_min(multipliers)

    def __post_init__(self) -> None:
        if self.longest < 1:
            raise ValueError("longest must be at least 1")

    def tokens(self, text: Column, positions: bool = True) -> Column:
        def joined(run: Column) -> Column:
            first, end = run[0], F.element_at(run, -1)
            weight = self.weight(F.transform(run, lambda x: x["multiplier"]))
            checked = F.when((weight > 0) & (weight <= 1), weight).otherwise(F.raise_error(F.lit("a run's multiplier must lie in (0, 1]")).cast("double"))
            return _token(F.array_join(F.transform(run, lambda x: x["token"]), " "), checked, first["token_idx"], first["src_idx"], end["src_idx"] + end["src_len"] - first["src_idx"])

        def runs(found: Column) -> Column:
            of = lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(self.longest), F.size(found) - i)), lambda n: let(F.slice(found, i + 1, n), joined))
            return F.flatten(F.transform(found, of))

        return let(self.inner.tokens(text, positions), runs)


@dataclass(frozen=True)
class FragmentBreaker(Breaker):
    """Each token and its substrings of shortest to longest characters (prefixes alone if from_start).

    weight gets token and fragment and gives the multiplier: 0 drops the fragment, less is an error.
    pre splits tokens once more before fragments are cut. Fragments stand at their token's place and
    repeat as often as they occur. The token's multiplier counts twice, once for the token and once for
    the part that is cut up.
    """

    shortest: int
    longest: int
    from_start: bool
    inner: Breaker
    pre: str | None = None
    weight: Callable[[Column, Column], Column] = lambda token, fragment: F.length(fragment) / F.length(token)

    def __post_init__(self) -> None:
        if not 1 <= self.shortest <= self.longest:
            raise ValueError("1 <= shortest <= longest")

    def tokens(self, text: Column, positions: bool = True) -> Column:
        def cuts(part: Column) -> Column:
            starts = F.lit(1) if self.from_start else F.greatest(F.length(part) - self.shortest + 1, F.lit(1))
            of = lambda s: F.transform(F.sequence(F.lit(self.shortest), F.least(F.lit(self.longest), F.length(part) - s + 1)), lambda n: F.substring(part, s, n))
            return F.when(F.length(part) < self.shortest, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), starts), of)))

        def fragments(t: Column) -> Column:
            token = t["token"]
            parts = F.filter(F.split(token, f"[{SPACE}{escaped(self.pre)}]", -1), lambda x: x != "") if self.pre is not None else F.array(token)
            cut = F.filter(F.flatten(F.transform(parts, cuts)), lambda x: x != token)

            def weighed(fragment: Column) -> Column:
                weight = self.weight(token, fragment)
                checked = F.when(weight < 0, F.raise_error(F.lit("a fragment's multiplier must not be negative")).cast("double")).otherwise(t["multiplier"] * weight)
                return F.struct(fragment.alias("token"), checked.cast("double").alias("weight"))

            kept = F.filter(F.transform(cut, weighed), lambda x: x["weight"] > 0)
            return F.concat(F.array(t), F.transform(kept, lambda x: _token(x["token"], t["multiplier"] * x["weight"], t["token_idx"], t["src_idx"], t["src_len"])))

        return F.flatten(F.transform(self.inner.tokens(text, positions), fragments))
