"""Running states along arrays, so that what depends on earlier elements stays within its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States are collected in runs of this length: appending copies a run, never the whole array.
RUN = 256


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of ``items``: ``step(state, item)``, beginning with ``start``.

    ``items`` should be a column of its own, since it is looked at once for each run. (Spark puts an
    expression in the place of a column that is named once. So within lambdas, arrays are zipped and not
    looked up by place: what is put into a lambda is computed for every element.)
    """

    def run(done: Column, number: Column) -> Column:
        last = F.element_at(F.element_at(done, -1), -1)
        return F.array_append(
            done,
            F.aggregate(
                F.slice(items, number * RUN + 1, F.lit(RUN)),
                F.array(last),
                lambda states, item: F.array_append(states, step(F.element_at(states, -1), item)),
            ),
        )

    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0)))
    states = F.aggregate(runs, F.array(F.array(start)), run)
    # Each run begins with the state before it.
    return F.flatten(F.transform(after_first(states), after_first))


def after_first(array: Column) -> Column:
    return F.slice(array, 2, 1 << 30)
