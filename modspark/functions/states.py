"""Read states from flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from modspark.model import FLAGS, STATES, strand_of


def state_or_null(flag: Column) -> Column:
    """The read state of a flag, null for flags that are none."""
    return reduce(lambda c, x: c.when(flag == x[0], F.lit(x[1])), list(STATES.items())[1:], F.when(flag == 0, F.lit(STATES[0])))


def state(flag: Column) -> Column:
    """The read state of a flag; flags that are none stop the query."""
    return F.coalesce(state_or_null(flag), F.raise_error(F.concat(F.lit("not a read state: flag "), flag.cast("string"))))


def strand(state: Column) -> Column:
    return F.when(state == "unmapped", F.lit(".")).when(F.endswith(state, F.lit("reverse")), F.lit("-")).when(state.isNotNull(), F.lit("+"))


def flag(state: Column) -> Column:
    return reduce(lambda c, x: c.when(state == x[0], F.lit(x[1])), list(FLAGS.items())[1:], F.when(state == "primary_forward", F.lit(0)))


STRANDS = {name: strand_of(name) for name in FLAGS}
