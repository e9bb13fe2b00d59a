"""Text functions as columns: cleaning, folding, tokens and the parsing of small formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.numbers import exact_round


def _folding() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter with one mark, and that letter: what canonical decomposition leaves.

    Letters with two marks, and those that don't decompose (ł, ø, đ), stay. The marks themselves are listed last, beyond
    the plain letters, so that translate() drops them.
    """
    marked, plain, marks = [], [], set()
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code).casefold())
        if parts[0].isascii() and parts[0].isalpha() and len(parts) == 1 + sum(map(bool, map(unicodedata.combining, parts))):
            marks |= set(parts[1:])
            if chr(code) == chr(code).lower() and len(parts) <= 2 and parts[0] != chr(code):
                marked.append(chr(code))
                plain.append(parts[0])
    return "".join(marked) + "".join(sorted(marks)), "".join(plain)


MARKED, PLAIN = _folding()


def trimmed(x: Column) -> Column:
    """White space of every kind cut off at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _spelled(x: Column) -> Column:
    """Quotes out, hyphens and underscores to spaces."""
    return F.translate(x, "-_'\"", "  ")


def clean_name(x: Column, squeeze: bool = True) -> Column:
    """A name for matching: trimmed, without quotes, lower case. squeeze: one pass of two spaces to one."""
    spaced = _spelled(trimmed(x))
    return F.lower(F.replace(spaced, F.lit("  "), F.lit(" ")) if squeeze else spaced)


def caption(x: Column) -> Column:
    """A caption as it is indexed: "N.A." if there is none; case is kept."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("N.A.")).otherwise(_spelled(x))


def folded(x: Column) -> Column:
    """Lower case, one mark off a letter, marks that stand alone out."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def tokens(x: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(folded(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def spaced_caption(x: Column) -> Column:
    """padded(tokens(caption(x))) in one pass of each kind."""
    low = F.lower(F.when(F.coalesce(x, F.lit("")) == "", F.lit("N.A.")).otherwise(x))
    plain = F.translate(low, "-_'\"", "  ")
    marks = F.translate(low, "-_" + MARKED + "'\"", "  " + PLAIN)
    one = F.when(F.octet_length(low) == F.char_length(low), plain).otherwise(marks)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(one, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def padded(words: Column) -> Column:
    """Tokens with a space around each, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def unpunctuated(x: Column) -> Column:
    """Only letters, marks, digits, underscores and white space."""
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_\s]", "")


def word_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")))


def unbracketed(x: Column) -> Column:
    """(...) and [...] taken out."""
    return F.regexp_replace(x, r"\([^)]*\)|\[.*?\]", "")


def numbered_entries(x: Column) -> Column:
    """Array of (place, entry) of a numbered list, one entry a line, numbers and brackets off and cleaned."""
    return F.transform(
        F.split(x, "\n"),
        lambda line, k: F.struct((k + 1).cast("int").alias("place"), clean_name(unbracketed(F.replace(line, F.concat((k + 1).cast("string"), F.lit(".")), F.lit(""))), squeeze=False).alias("entry")),
    )


def from_template(template: Column, *names: Column) -> Column:
    """The template's {} filled from left to right."""
    parts = F.split(template, r"\{\}", -1)
    pieces = [F.get(parts, F.lit(0))]
    for k, name in enumerate(names):
        pieces.append(F.when(F.size(parts) > k + 1, F.concat(name, F.get(parts, F.lit(k + 1)))).otherwise(F.lit("")))
    return F.concat(*pieces)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(path: Column) -> Column:
    """The last part of a path up to its first dot."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]


def shard_name(shard: Column, digits: int = 5) -> Column:
    return F.lpad(shard.cast("string"), digits, "0")


def yes_or_no(x: Column) -> Column:
    """Booleans as people write them; anything else is an error."""
    low = F.lower(trimmed(x))
    return F.when(low.isin("yes", "true", "t", "y", "1"), F.lit(True)).when(low.isin("no", "false", "f", "n", "0"), F.lit(False)).when(x.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))


def shown_number(x: Column, digits: int = 4) -> Column:
    """A number rounded from its binary value, as short as it goes: one digit after the point at least, powers below 0.0001."""
    v = exact_round(x, digits)
    plain = F.regexp_replace(F.format_string(f"%.{digits}f", v), r"(\.\d+?)0+$", "$1")
    small = F.regexp_replace(F.format_string("%.15e", v), r"\.?0+e", "e")
    return F.when((v != 0) & (F.abs(v) < 1e-4), small).otherwise(plain)


def audit_line(score: Column, threshold: Column | None, path: Column, text: Column, second: Column | None = None, second_threshold: Column | None = None) -> Column:
    """"score/threshold[, second/threshold], path, caption" of a row that a sampler looked at."""

    def of(x: Column, limit: Column | None) -> Column:
        return F.concat_ws("/", shown_number(x), *([] if limit is None else [shown_number(limit, 6)]))

    return F.concat_ws(", ", of(score, threshold), *([] if second is None else [of(second, second_threshold)]), path, text)


def with_attribute(template: Column, name: Column, attribute: Column) -> Column:
    """A prompt that says what a thing is and has."""
    return F.concat_ws(" ", from_template(template, name), F.replace(attribute, F.lit("Has"), F.lit("has")))


def regrouped_path(path: Column, parts: dict[str, str]) -> Column:
    """"split/class/name_id.ext" to "new split/class_id.ext"; a split that isn't listed is an error."""
    piece = F.split(path, "/")
    new = F.try_element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), piece[0])
    known = F.coalesce(new, F.raise_error(F.concat(F.lit("unknown part: "), piece[0])).cast("string"))
    return F.concat(known, F.lit("/"), piece[1], F.lit("_"), F.element_at(F.split(piece[2], "_"), -1))


def path_and_name(line: Column) -> Column:
    """(path, name): the first word of a line, and the rest."""
    parts = F.split(line, " ", 2)
    return F.struct(parts[0].alias("path"), F.get(parts, F.lit(1)).alias("name"))


def model_parts(config: Column) -> Column:
    """(architecture, family, pretraining) of names joined by underscores; the last may be missing."""
    parts = F.split(config, "_", 3)
    return F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("architecture", "family", "pretraining"))])


def question(kind: Column, name: Column, templates: dict[str, str], default: str) -> Column:
    """A question about a name by its kind of set."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]), kind)
    return from_template(F.coalesce(own, F.lit(default)), name)
