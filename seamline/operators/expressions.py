"""Match expressions of full-text search, compiled to columns: what a name asks of a text, or why it asks nothing.

An expression is a list of phrases that a text must all hold. A phrase is one string or several with + between them; a
string is a bareword (ASCII letters and digits, underscores, anything beyond ASCII) or stands in double quotes. A * after
a string leaves the token before it open at the end; a ^ before a phrase asks for it at the start of the text. A string
before a colon names a column. Anything else is a syntax error. Strings are tokenised as texts are, so one may give several
tokens, or none; phrases without tokens are dropped. Open tokens are written with a * behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.text import clean_name, tokens

PHRASES = "array<struct<words:array<string>,first:boolean>>"
_STATE = f"struct<phrases:{PHRASES},at:string,error:string>"
#: White space is what separates here; any other single character is a piece of its own.
_PIECE = r'(?:[A-Za-z0-9_\x1A]|[^\x00-\x7F])+|"(?:[^"]|"")*"|[^ \t\n\r]'


def expression_of(name: Column, prefix: str | None = None, raw: bool = False) -> Column:
    """The expression that a name is sought by: its words as one phrase, after the prefix as a word of its own.

    Brackets go if a name has both. What then holds a dot or a slash is quoted whole, so the prefix joins the phrase; with
    raw the name as it is given decides, and there both brackets count too.
    """
    spaced = F.replace(clean_name(name), F.lit(" "), F.lit(" + "))
    both = F.contains(spaced, F.lit("(")) & F.contains(spaced, F.lit(")"))
    spaced = F.when(both, F.translate(spaced, "()", "")).otherwise(spaced)
    said = F.concat(F.lit(f"{prefix} "), spaced) if prefix is not None else spaced
    judged = name if raw else said
    quoted = F.contains(judged, F.lit(".")) | F.contains(judged, F.lit("/"))
    if raw:
        quoted = quoted | (F.contains(name, F.lit("(")) & F.contains(name, F.lit(")")))
    return F.when(quoted, F.concat(F.lit('"'), said, F.lit('"'))).otherwise(said)


def _string_tokens(piece: Column) -> Column:
    bare = F.replace(F.substring(piece, F.lit(2), F.length(piece) - 2), F.lit('""'), F.lit('"'))
    return tokens(F.when(piece.startswith('"'), bare).otherwise(piece))


def compiled(expression: Column, column: str = "text") -> Column:
    """(phrases, error) of an expression; error is null if it can be read, and phrases is empty if it can't."""
    pieces = F.regexp_extract_all(expression, F.lit(_PIECE), F.lit(0))
    empty = F.lit(None).cast(PHRASES)
    start = F.struct(F.coalesce(empty, F.array().cast(PHRASES)).alias("phrases"), F.lit("start").alias("at"), F.lit(None).cast("string").alias("error")).cast(_STATE)

    def state(phrases: Column, at: str | Column, error: Column | None = None) -> Column:
        return F.struct(phrases.alias("phrases"), (F.lit(at) if isinstance(at, str) else at).alias("at"), (F.lit(None).cast("string") if error is None else error).alias("error")).cast(_STATE)

    def with_last(words: Column, change: Callable[[Column], Column]) -> Column:
        return F.transform(words, lambda w, k: F.when(k == F.size(words) - 1, change(w)).otherwise(w))

    def step(s: Column, piece: Column) -> Column:
        old, at = s["phrases"], s["at"]
        is_string = (piece.rlike(r"^(?:[A-Za-z0-9_\x1A]|[^\x00-\x7F])") & ~piece.isin("AND", "OR", "NOT")) | (piece.startswith('"') & (piece != '"'))
        words, last = _string_tokens(piece), F.element_at(old, -1)
        fresh = F.struct(words.alias("words"), (at == "caret").alias("first"))
        # what follows without a token of its own closes the token before it again
        before = F.when(F.size(words) > 0, last["words"]).otherwise(with_last(last["words"], lambda w: F.rtrim(w, F.lit("*"))))
        longer = F.struct(F.concat(before, words).alias("words"), last["first"].alias("first"))
        but_last = F.slice(old, 1, F.greatest(F.size(old) - 1, F.lit(0)))
        opened = F.struct(with_last(last["words"], lambda w: F.concat(F.rtrim(w, F.lit("*")), F.lit("*"))).alias("words"), last["first"].alias("first"))
        after = at.isin("string", "more", "star")
        names_column = (piece == ":") & (at == "string") & ~last["first"]
        return (
            F.when(s["error"].isNotNull(), s)
            .when(is_string & (at == "plus"), state(F.concat(but_last, F.array(longer)), "more"))
            # only a phrase's first string may name a column
            .when(is_string, state(F.concat(old, F.array(fresh)), "string"))
            .when((piece == "+") & after, state(old, "plus"))
            .when((piece == "*") & at.isin("string", "more"), state(F.concat(but_last, F.array(opened)), "star"))
            .when(piece == '"', state(old, at, F.lit("unterminated string")))
            .when((piece == "*") & (at == "start"), state(old, at, F.lit("unknown special query")))
            .when((piece == "^") & at.isin("start", "string", "more", "star", "column"), state(old, "caret"))
            .when((piece == "AND") & after, state(old, "and"))
            .when(names_column & (F.lower(F.element_at(last["words"], 1)) == column), state(but_last, "column"))
            .when(names_column, state(old, at, F.concat(F.lit("no such column: "), F.array_join(last["words"], " "))))
            .otherwise(state(old, at, F.concat(F.lit('syntax error near "'), piece, F.lit('"'))))
        )

    def finish(s: Column) -> Column:
        ended = s["at"].isin("string", "more", "star")
        error = F.coalesce(s["error"], F.when(~ended, F.lit('syntax error near ""')))
        kept = F.filter(s["phrases"], lambda p: F.size(p["words"]) > 0)
        return F.struct(F.when(error.isNull(), kept).otherwise(F.array().cast(PHRASES)).alias("phrases"), error.alias("error"))

    return F.aggregate(pieces, start, step, finish)


def is_plain(phrase: Column) -> Column:
    """Whether a phrase is a plain substring: no token but the last is open, and it may stand anywhere."""
    inner = F.slice(phrase["words"], 1, F.greatest(F.size(phrase["words"]) - 1, F.lit(0)))
    return ~phrase["first"] & ~F.exists(inner, lambda w: w.endswith("*"))


def pattern(phrase: Column) -> Column:
    """The string that a text of padded tokens holds if it holds a plain phrase."""
    said = F.concat(F.lit(" "), F.array_join(phrase["words"], " "), F.lit(" "))
    return F.regexp_replace(said, r"\* $", "")


def _expression(phrase: Column) -> Column:
    """A regular expression for any phrase; tokens are letters and digits alone."""
    said = F.concat(F.when(phrase["first"], F.lit("^ ")).otherwise(F.lit(" ")), F.array_join(phrase["words"], " "), F.lit(" "))
    return F.replace(said, F.lit("*"), F.lit("[^ ]*"))


def lookup_key(phrases: Column) -> Column:
    """A token that a matching text must hold: the longest of all; "*" and a beginning where only open tokens are asked for."""
    words = F.flatten(phrases["words"])
    longest = lambda xs: F.array_max(F.transform(xs, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.coalesce(longest(F.filter(words, lambda w: ~w.endswith("*"))), F.concat(F.lit("*"), F.rtrim(longest(words), F.lit("*"))))


def holds(hay: Column, phrases: Column) -> Column:
    """Whether a text of padded tokens holds all phrases."""
    return (F.size(phrases) > 0) & F.forall(phrases, lambda p: F.when(is_plain(p), F.contains(hay, pattern(p))).otherwise(F.rlike(hay, _expression(p))))
