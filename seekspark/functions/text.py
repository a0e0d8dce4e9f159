"""Text functions as Column expressions: identifiers, tokens, previews, words at a cursor, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are split at everything else; regexp_extract_all copies the whole text for every match, so it is quadratic in long texts.
OTHER = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), OTHER), lambda x: x != "")


def _cut(c: Column) -> Column:
    """Underscores where case changes part an identifier."""
    return F.regexp_replace(F.regexp_replace(c, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")


def split_identifier(c: Column) -> Column:
    """Lower-case parts of a camelCase or snake_case identifier; none if it has one part only."""
    parts = F.filter(F.split(F.lower(_cut(c)), "_"), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def plain_tokens(c: Column) -> Column:
    return words(F.lower(c))


def code_tokens(c: Column) -> Column:
    """Each alphanumeric run followed by its identifier parts, in lower case."""
    # the whole text is cut at once: words are parted by blanks, parts by underscores, of which no word has one of its own
    runs = F.filter(F.split(_cut(F.regexp_replace(F.coalesce(c, F.lit("")), OTHER, " ")), " "), lambda x: x != "")
    parted = lambda x: F.concat(F.array(F.lower(F.replace(x, F.lit("_"), F.lit("")))), F.split(F.lower(x), "_"))
    return F.flatten(F.transform(runs, lambda x: F.when(F.contains(x, F.lit("_")), parted(x)).otherwise(F.array(F.lower(x)))))


def preview(c: Column, limit: int = 200) -> Column:
    """The first `limit` bytes, on to the next character's end, and `...`, if there are more."""
    # characters whose end lies within the limit, plus the one that crosses it
    n = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.lit(0), lambda acc, i: F.when(F.octet_length(F.substr(c, F.lit(1), i - 1)) < limit, i).otherwise(acc))
    return F.when(F.octet_length(c) > limit, F.concat(F.substr(c, F.lit(1), n), F.lit("..."))).otherwise(c)


def minify(c: Column) -> Column:
    """Trailing blanks go, indentation halves (a tab counts as two), runs of blank lines become one."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.rtrim(x))

    def indent(x: Column) -> Column:
        lead = F.regexp_extract(x, r"^([ \t]*)", 1)
        width = F.length(lead) + F.length(F.regexp_replace(lead, "[^\t]", ""))
        return F.concat(F.repeat(F.lit(" "), F.ceil(width / 2).cast("int")), F.substr(x, F.length(lead) + 1, F.length(x)))

    return F.regexp_replace(F.array_join(F.transform(lines, indent), "\n"), "\n{3,}", "\n\n")


def word_at(line: Column, column: Column) -> Column:
    """The identifier around a 0-based column, or null."""
    left = F.regexp_extract(F.substr(line, F.lit(1), column), r"([A-Za-z0-9_]*)$", 1)
    right = F.regexp_extract(F.substr(line, column + 1, F.length(line)), r"^([A-Za-z0-9_]*)", 1)
    word = F.concat(left, right)
    return F.when((column <= F.length(line)) & (word != ""), word)
