"""Small building blocks for work inside one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK, MOST_BLOCK = 8, 64


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds an expensive column that later filters use.

    A filter on a plain column is pushed below it and repeats its expression there; it is
    not pushed below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def empty_array(element_ddl: str) -> Column:
    return F.array().cast(f"array<{element_ddl}>")


def running(items: Column, start: Column, out_ddl: str, step) -> Column:
    """Fold over ``items`` in order and keep what each step emits.

    ``step(state, item)`` gives ``(next_state, array_to_emit)``. Appending to one
    growing array copies it at every step, so the fold works on blocks: a row with
    many thousand hits costs close to linear time instead of quadratic. What a block has
    emitted is copied at each step too, so few items make small blocks.
    """

    def fold_block(block, state):
        def merge(acc, item):
            after, emitted = step(acc["state"], item)
            return F.struct(after.alias("state"), F.concat(acc["out"], emitted).alias("out"))

        zero = F.struct(state.alias("state"), empty_array(out_ddl).alias("out"))
        return F.aggregate(block, zero, merge)

    def merge_blocks(acc, block):
        return let(
            fold_block(block, acc["state"]),
            lambda r: F.struct(
                r["state"].alias("state"),
                F.concat(acc["out"], F.array(r["out"])).alias("out"),
            ),
        )

    def over(all_items):
        block = F.least(F.greatest(F.sqrt(F.size(all_items)).cast("int"), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
        return let(block, lambda size: in_blocks(all_items, size))

    def in_blocks(all_items, size):
        last = F.greatest(F.floor((F.size(all_items) - 1) / size).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_items, k * size + 1, size))
        zero = F.struct(start.alias("state"), empty_array(f"array<{out_ddl}>").alias("out"))
        return F.flatten(F.aggregate(blocks, zero, merge_blocks)["out"])

    return let(items, over)
