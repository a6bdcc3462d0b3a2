"""Reference data of an extraction run and the check of its size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import HARMLESS_PHRASES, WHITELIST
from ..functions import scalars as S
from ..functions.textmatch import strip

# A table of literals may have so many entries; larger ones must be named in `joined`.
MAX_LITERALS = 20_000


def bounded(df: DataFrame, limit: int = MAX_LITERALS) -> list:
    """Rows of a table that must be small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of more than {limit} entries cannot become literals: name it in Reference.joined")
    return rows


def whitelist_frame(spark: SparkSession, entries=WHITELIST) -> DataFrame:
    rows = [(kind, value) for kind, values in entries.items() for value in values]
    return normalize_whitelist(spark.createDataFrame(rows, "kind string, value string"))


def normalize_whitelist(raw: DataFrame) -> DataFrame:
    """Trimmed, and lower case except for addresses."""
    value = strip(F.col("value"))
    return raw.select(
        "kind", F.when(F.col("kind") == "ips", value).otherwise(F.lower(value)).alias("value")
    ).dropDuplicates()


def actor_order() -> list:
    """Table order of actors: as loaded, then those that articles added, by name."""
    last = F.lit(2**62)
    return [F.coalesce(F.col("seq"), last).alias("_seq"), F.col("name").alias("_by")]


def actor_lexicon(actors: DataFrame) -> DataFrame:
    """(name, canonical) of every spelling; a later row wins where spellings collide.

    ``actors`` has name, aliases (array) and seq, the position in the loaded table.
    """
    named = actors.filter(F.coalesce("name", F.lit("")) != "")
    forms = F.concat(
        F.array(
            F.struct(F.lit(0).alias("step"), F.col("name").alias("name")),
            F.struct(F.lit(1).alias("step"), S.spaced_variation(F.col("name")).alias("name")),
        ),
        F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")),
            lambda a, i: F.struct((i + 2).alias("step"), strip(a).alias("name")),
        ),
    )
    return (
        named.select(*actor_order(), F.col("name").alias("canonical"), F.explode(forms).alias("f"))
        .select("_seq", "_by", "canonical", F.col("f.step").alias("step"), F.col("f.name").alias("name"))
        .filter(F.coalesce("name", F.lit("")) != "")
        .groupBy(F.lower("name").alias("name"))
        .agg(F.max_by("canonical", F.struct("_seq", "_by", "step")).alias("canonical"))
    )


@dataclass(frozen=True)
class Reference:
    """What extraction needs to know; every table may be absent.

    Tables are literals of the extraction expression, or joined if the caller names them in
    ``joined`` (tlds, whitelist, actors, countries). The result is the same.
    """

    tlds: DataFrame | None = None  # (tld), lower case
    whitelist: DataFrame | None = None  # (kind, value), normalised
    actors: DataFrame | None = None  # (name, canonical), name in lower case
    countries: DataFrame | None = None  # (name, ...)
    phrases: tuple = HARMLESS_PHRASES
    joined: frozenset = frozenset()
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def literals(self, table: str, *columns: str) -> list | None:
        """Entries of a table, or None if it is joined; an absent table is an empty one."""
        if table not in self._cache:
            df = getattr(self, table)
            if df is None:
                self._cache[table] = []
            else:
                self._cache[table] = None if table in self.joined else bounded(df.select(*columns).distinct())
        return self._cache[table]


def one_of(value: Column, entries) -> Column:
    entries = list(entries)
    return value.isin(entries) if entries else F.lit(False)
