"""Free-text labels and split names to canonical values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import paths
from tallyframe.functions.text import let, sql_text


def normalize_token(value: Column) -> Column:
    """Lower case, every run of other characters than ``a-z0-9`` to one ``_``, none at the ends; null gives ''."""
    joined = F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), "[^a-z0-9]+", "_")
    return F.btrim(joined, F.lit("_"))


def _plain_token(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def _ranked_aliases(aliases: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(alias, class), most parts first, then in the order of the classes."""
    ranked = [
        (-len(token.split("_")), order, token, category)
        for order, (category, names) in enumerate(aliases.items())
        for token in dict.fromkeys(_plain_token(name) for name in (category, *names))
        if token
    ]
    return [(token, category) for _, _, token, category in sorted(ranked, key=lambda item: item[:2])]


def _alias_table(aliases: Mapping[str, Sequence[str]]) -> Column:
    """The ranked aliases as one constant array, each alias between underscores."""
    rows = [f"struct({sql_text(f'_{a}_')} AS alias, {sql_text(c)} AS category)" for a, c in _ranked_aliases(aliases)]
    return F.expr(f"array({', '.join(rows)})")


def _category_of_token(token: Column, table: Column) -> Column:
    """First alias, in rank order, whose parts occur side by side in the token."""
    return let(
        F.concat(F.lit("_"), token, F.lit("_")),
        lambda padded: F.get(F.filter(table, lambda a: padded.contains(a["alias"])), F.lit(0))["category"],
    )


def canonical_category(value: Column, aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES) -> Column:
    """Class named by a text, or null. The alias with most words wins; parts of words never match."""
    return _category_of_token(normalize_token(value), _alias_table(aliases))


def _split_of_token(token: Column, splits: Sequence[str]) -> Column:
    found = F.when(token.contains("validation") | token.rlike("(^|_)val(id)?(_|$)"), "val")
    for split in splits:
        found = found.when(token.rlike(f"(^|_){split}(_|$)"), split)
    return found


def canonical_split(value: Column, splits: Sequence[str] = defaults.SPLITS) -> Column:
    """Split named by a text, or null. Any form of validation gives ``val``."""
    return let(normalize_token(value), lambda token: _split_of_token(token, splits))


def _nearest(path: Column, of_token) -> Column:
    """First non-null result over the directories of ``path``, nearest first."""
    tokens = F.transform(paths.directories_nearest_first(path), normalize_token)
    return F.get(F.filter(F.transform(tokens, of_token), lambda found: found.isNotNull()), F.lit(0))


def category_from_path(
    path: Column,
    root: str | None = None,
    aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES,
    stem_patterns: Sequence[tuple[str, str]] = defaults.STEM_PATTERNS,
) -> Column:
    """Class from the directories, nearest first; else from the whole stem; else from the file name."""
    relative = paths.relative_path(path, root)
    table = _alias_table(aliases)
    stem_token = normalize_token(paths.stem(path))
    by_stem = [F.when(stem_token.rlike(f"^(?:{pattern})$"), category) for pattern, category in stem_patterns]
    return F.coalesce(
        _nearest(relative, lambda token: _category_of_token(token, table)),
        *by_stem,
        _category_of_token(normalize_token(paths.base_name(path)), table),
    )


def split_from_path(path: Column, root: str | None = None, splits: Sequence[str] = defaults.SPLITS) -> Column:
    """Split from the directories, nearest first; else from the file name."""
    relative = paths.relative_path(path, root)
    return F.coalesce(
        _nearest(relative, lambda token: _split_of_token(token, splits)),
        canonical_split(paths.base_name(path), splits),
    )


def column_lookup(header: Column, candidates: Sequence[str]) -> Column:
    """Name of the header field that equals a candidate after normalisation, else of one that contains a candidate.

    Candidates are tried in the order given for the exact match, header fields in file order for the other. Of fields that
    are equal after normalisation the last one counts.
    """
    wanted = F.array(*[F.lit(name) for name in candidates])

    def find(names: Column) -> Column:
        exact = F.filter(wanted, lambda name: F.array_contains(names, name))
        part = F.filter(names, lambda name: F.exists(wanted, lambda known: name.contains(known)))
        found = F.coalesce(F.get(exact, F.lit(0)), F.get(part, F.lit(0)))
        last = F.size(names) - F.array_position(F.reverse(names), found)
        return F.when(found.isNotNull(), F.get(header, last.cast("int")))

    return let(F.transform(header, normalize_token), find)
