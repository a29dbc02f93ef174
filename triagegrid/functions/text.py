"""Text building blocks: pattern matching with the flags the lexicon assumes, and whitespace."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.functions.pieces import KEY, KEYLESS, KEYS, PIECES

# Word characters, boundaries and whitespace follow Unicode; "." stops only at a line feed.
_FLAGS = "(?Ud)"
_FLAGS_ANY_CASE = "(?iUd)"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def pattern(text: str, any_case: bool = True) -> str:
    return (_FLAGS_ANY_CASE if any_case else _FLAGS) + text


def add_folded(df: DataFrame, text: str = "text", out: str = "_low") -> DataFrame:
    """Add the lower-cased text that the cheap look for pieces runs on, and the beginnings of its words that patterns know.

    Three letters fold to ASCII when case is ignored but not when lower-cased.
    """
    odd = " OR ".join(f"contains({text}, '{c}')" for c in "ſİı")
    folded = df.select("*", F.expr(f"lower(IF({odd}, translate({text}, 'ſİı', 'sii'), {text}))").alias(out))
    listed = ", ".join(sql_text(key) for key in sorted({key for keys in KEYS.values() for key in keys}))
    heads = rf"transform(split({out}, '(?U)\\W+'), w -> substring(w, 1, {KEY}))"
    return folded.select("*", F.expr(f"filter({heads}, k -> k IN ({listed}))").alias(out + HEADS))


#: Behind the name of a folded text: the name of its words' beginnings.
HEADS = "_heads"


def may_match(low: str, regex: str) -> Column:
    """False only where the pattern cannot match the text ``low`` was folded from."""

    def any_of(pieces: list[str]) -> str:
        return " OR ".join(f"contains({low}, {sql_text(piece)})" for piece in pieces)

    if not KEYS[regex]:
        return F.expr(any_of(PIECES[regex]))
    begun = f"exists({low}{HEADS}, k -> k IN ({', '.join(map(sql_text, KEYS[regex]))}))"
    return F.expr(f"({' OR '.join([begun, *([any_of(KEYLESS[regex])] if KEYLESS[regex] else [])])}) AND ({any_of(PIECES[regex])})")


def first_match(text: Column, regex: str, any_case: bool = True, group: int = 0, low: str | None = None) -> Column:
    """The first match, or ``''`` when there is none (no lexicon pattern can match empty text).

    With ``low``, the name of the folded text, the pattern runs only where it may match.
    """
    found = F.regexp_extract(text, pattern(regex, any_case), group)
    return F.when(may_match(low, regex), found).otherwise(F.lit("")) if low else found


def has_match(text: Column, regex: str, any_case: bool = True, low: str | None = None) -> Column:
    found = F.rlike(text, F.lit(pattern(regex, any_case)))
    return may_match(low, regex) & found if low else found


def all_matches(text: Column, regex: str, any_case: bool = True, group: int = 1, low: str | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern(regex, any_case)), F.lit(group))
    return F.when(may_match(low, regex), found).otherwise(empty_strings()) if low else found


def count_matches(text: Column, regex: str, any_case: bool = True, low: str | None = None) -> Column:
    found = F.regexp_count(text, F.lit(pattern(regex, any_case)))
    return F.when(may_match(low, regex), found).otherwise(F.lit(0)) if low else found


# Surrounding whitespace of any kind, not only blanks; both are linear in the text.
STRIP = r"(?Us)^[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])"
RIGHT_STRIP = r"(?Us)^(.*[^\s\x1c-\x1f])"


def strip_ws(text: Column) -> Column:
    return F.regexp_extract(text, STRIP, 1)


def blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots (``{}`` is slot ``value``) of a fixed sentence with columns."""
    parts, rest = [], template.replace("{}", "{value}")
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def append_absent(base: Column, new: Column) -> Column:
    """Append the values of ``new`` that ``base`` lacks; duplicates already in ``base`` stay."""
    return F.concat(base, F.array_except(new, base))


def contains_all(have: Column, want: Column) -> Column:
    return F.size(F.array_except(want, have)) == 0


def sorted_join(values: Column, sep: str = ", ") -> Column:
    return F.array_join(F.sort_array(values), sep)


# The helpers below write SQL text for ``F.expr``: where everything is a column of the frame at hand,
# one parsed expression is far cheaper to build than dozens of column objects.


def sql_text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: list[str]) -> str:
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_fill(template: str, **values: str) -> str:
    """Fill ``{name}`` slots (``{}`` is slot ``value``) of a fixed sentence with SQL expressions."""
    parts, rest = [], template.replace("{}", "{value}")
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if head:
            parts.append(sql_text(head))
        parts.append(values[name])
    if rest:
        parts.append(sql_text(rest))
    return f"concat({', '.join(parts)})"


def sql_listed(pairs: list[tuple[str, str]], of: str = "string") -> str:
    """An array of each value whose condition is true, in order.

    Made of ``concat`` so that it stays inside generated code, which lambda functions do not.
    """
    empty = f"CAST(array() AS array<{of}>)"
    return "concat(" + ", ".join(f"IF({cond}, array({value}), {empty})" for cond, value in pairs) + ")"
