"""Language choices per recording. The tables are fixed and small, so they are map literals and need no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from speechloom.functions.fixed_values import (
    COMMAS, CONJUNCTIONS, DEFAULT_COMMA, DEFAULT_SENTENCE_SPLITTER, LANGUAGE_ALIASES, LANGUAGE_NAMES,
    PRIMARY_ALIGN_MODELS, SECONDARY_ALIGN_MODELS, SENTENCE_SPLITTERS,
)
from speechloom.plans.lookups import literal_map


def _found(table: dict[str, str], key: Column) -> Column:
    return F.element_at(literal_map(table), key)


def language_code(requested: Column) -> Column:
    """Code of a code, name or alias in any case; null if there is none."""
    low = F.lower(requested)
    names = {name: code for code, name in LANGUAGE_NAMES.items()} | LANGUAGE_ALIASES
    return F.coalesce(F.when(low.isin(*LANGUAGE_NAMES), low), _found(names, low))


def normalise_languages(requests: DataFrame) -> DataFrame:
    """Adds ``language`` and ``unsupported`` (asked for, but unknown)."""
    code = language_code(F.col("requested"))
    return requests.withColumns({"language": code, "unsupported": F.col("requested").isNotNull() & code.isNull()})


def english_only(requests: DataFrame) -> DataFrame:
    """A model named ``*.en`` decodes English whatever was asked; ``overridden`` flags another wish."""
    forced = F.col("model").endswith(".en") & ~F.col("language").eqNullSafe(F.lit("en"))
    return requests.withColumns({
        "overridden": forced & F.col("language").isNotNull(),
        "language": F.when(forced, "en").otherwise(F.col("language")),
    })


def route_models(requests: DataFrame) -> DataFrame:
    """Alignment model: the named one, else the primary, else the secondary table; ``unrouted`` where none fits."""
    lang = F.coalesce("language", F.lit("en"))
    model = F.coalesce("align_model", _found(PRIMARY_ALIGN_MODELS, lang), _found(SECONDARY_ALIGN_MODELS, lang))
    return requests.withColumns({"align_model": model, "unrouted": model.isNull()})


def language_rules(df: DataFrame, lang: str = "language") -> DataFrame:
    """Sentence splitter, comma sign and conjunction list of a language, with defaults."""
    code = F.col(lang)
    lists = F.create_map(*[x for k, words in CONJUNCTIONS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words]))])
    return df.withColumns({
        "splitter": F.coalesce(_found(SENTENCE_SPLITTERS, code), F.lit(DEFAULT_SENTENCE_SPLITTER)),
        "comma": F.coalesce(_found(COMMAS, code), F.lit(DEFAULT_COMMA)),
        "conjunctions": F.coalesce(F.element_at(lists, code), F.array().cast("array<string>")),
    })
