"""Text columns: joining, tokens, masks, keys, n-grams. Column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters of tokens, money notation, bare numbers and the bounds of masked numbers.
SEPARATORS = r"(?U)[\s/・,、|｜]+"
MONEY = r"(?iU)(?:[$＄]\s?[\d][\d,.]*)|(?:\b[\d][\d,.]*\s?(?:dollars?|usd|万円|円)\b)"
BARE_NUMBER = r"(?U)(?<![\w.$])(\d{1,3}(?:,\d{3})+|\d{3,6})(?![\w.])"
MASK_LOW, MASK_HIGH = 300, 300_000
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "t"), ("0", "false", "no", "n", "f")


def blank(text: Column | str) -> Column:
    """The text, "" for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def join_columns(*columns: str) -> Column:
    """Several text columns joined by one space; a null counts as "" and keeps its space."""
    return F.concat_ws(" ", *(blank(F.col(c).cast("string")) for c in columns))


def tokens(text: Column) -> Column:
    return F.filter(F.split(blank(text), SEPARATORS), lambda t: t != "")


def without(token_list: Column, stop: Column) -> Column:
    """Tokens outside of ``stop``; order and repeats stay."""
    return F.filter(token_list, lambda t: ~F.array_contains(stop, t))


def mask_money(text: Column) -> Column:
    return F.regexp_replace(text, MONEY, "<AMOUNT>")


def mask_numbers(text: Column) -> Column:
    """Bare integers within the mask's bounds become <NUMBER>."""
    found = F.regexp_extract_all(text, F.lit(BARE_NUMBER), F.lit(1))
    value = lambda m: F.replace(m, F.lit(",")).cast("long")
    new = F.transform(found, lambda m: F.when(value(m).between(MASK_LOW, MASK_HIGH), "<NUMBER>").otherwise(m))
    return F.array_join(F.zip_with(F.split(text, BARE_NUMBER, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def mask_amounts(text: Column) -> Column:
    """Everything in a text that could be the answer to a question for a price."""
    return mask_numbers(mask_money(text))


def truncated(text: Column, limit: int) -> Column:
    """Cut at ``limit`` characters with a note of how many are missing; no limit if it is 0 or less."""
    if limit <= 0:
        return text
    rest = F.char_length(text) - limit
    return F.when(rest > 0, F.concat(F.substring(text, 1, limit), F.lit("... ("), F.format_number(rest, 0), F.lit(" more characters omitted)"))).otherwise(text)


def collapsed(text: Column) -> Column:
    """Ends trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clipped(text: Column, limit: int = 500) -> Column:
    return F.substring(blank(text), 1, limit)


def normalised(value: Column) -> Column:
    """Key form: lower case, trimmed, single spaces; null is ""."""
    return F.lower(collapsed(blank(value.cast("string"))))


def composite_key(*parts: Column) -> Column:
    """Normalised parts joined by " | ", or "" if one is empty."""
    keys = [normalised(p) for p in parts]
    empty = keys[0] == ""
    for k in keys[1:]:
        empty = empty | (k == "")
    return F.when(empty, "").otherwise(F.concat_ws(" | ", *keys))


def split_key(key: Column, names: Sequence[str]) -> Column:
    """Back from a composite key to a map of column to part."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.split(key, r" \| ", len(names)))


def ngram_words(text: Column) -> Column:
    """Lower-cased words that n-grams are taken from."""
    return F.filter(F.split(F.lower(collapsed(blank(text))), " "), lambda w: w != "")


def word_ngrams(word: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of a word that is padded by one space at each side."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.char_length(padded)

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n))

    return F.flatten(F.transform(F.sequence(F.lit(low), F.greatest(F.least(F.lit(high), size), F.lit(low))), of))


def distinct_ngrams(word_list: Column, low: int = 2, high: int = 4) -> Column:
    """The different word_ngrams() of a list of words, beside some that no word has: those hold two spaces, where two words meet.

    Each is read by a regular expression that goes on by one character, so a word's place costs nothing and no lambda runs.
    """
    joined = F.concat(F.lit(" "), F.array_join(F.array_distinct(word_list), "  "), F.lit(" "))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(joined, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(low, high + 1))))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of all words of a text."""
    return F.flatten(F.transform(ngram_words(text), lambda w: word_ngrams(w, low, high)))


def parsed_number(value: Column) -> Column:
    """Double of a text such as "28,500"; null for what is no finite number."""
    number = F.replace(F.trim(value.cast("string")), F.lit(",")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def boolean_number(value: Column) -> Column:
    """1.0, 0.0 or null of a text that says yes or no."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), 1.0).when(word.isin(*FALSE_WORDS), 0.0)


def shown(value: Column, kind: str) -> Column:
    """Display form: integers with thousands separators, booleans as yes or no, null as unknown."""
    if kind == "integer":
        out = F.format_number(value, 0)
    elif kind == "boolean":
        out = F.when(value, "yes").otherwise("no")
    else:
        out = value.cast("string")
    return F.when(value.isNull(), "unknown").otherwise(out)


def described(fields: Sequence[tuple[str, Column, str]]) -> Column:
    """A row as one bullet line for each (name, value, kind)."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"- {name}: "), shown(value, kind)) for name, value, kind in fields))


def fingerprint(*parts: Column) -> Column:
    """16 hex digits that tell row contents apart; null differs from every text."""
    marked = [F.when(p.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), p.cast("string"))) for p in parts]
    return F.substring(F.sha1(F.concat_ws("\u001f", *marked)), 1, 16)


def looks_like_date(value: Column) -> Column:
    """Whether a text has a date's separators and parses in one of the common forms."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = F.coalesce(value.try_cast("timestamp"), *(F.try_to_timestamp(value, F.lit(f)) for f in forms))
    return value.rlike("[-/:]") & parsed.isNotNull()
