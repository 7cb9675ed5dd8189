"""Processing only what is new or changed, with the target as the only state.

The target stores the source key and version of every row it was made from. What
is still to do is the source anti-joined against it, so no separate bookmark can
disagree with the data. A run writes its part aside and publishes it with one
atomic manifest: a run that dies before has published nothing and its work is
pending again; one that dies after is found in the manifest and not repeated.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.manifest import Part, PartStore, Version

#: Any value will do, as whether it stands for null is kept beside it.
STAND_INS = (
    (T.StringType, ""),
    (T.NumericType, 0),
    (T.BooleanType, False),
    (T.BinaryType, b""),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), datetime.datetime(2000, 1, 1)),
)


class IncrementalTarget:
    """A target table keyed by ``state``: the source key and version columns, which are texts, numbers, flags, bytes or times.

    A null in a state column is a value like any other. Repeated source rows of
    one state are one state, reduced before the join so that a hot state never
    meets it with more than one row. An empty target leaves everything pending,
    an empty source nothing.
    """

    def __init__(self, spark: SparkSession, root: str, state: Sequence[str]):
        self.spark, self.store, self.state = spark, PartStore(spark, root), list(state)

    def published(self) -> DataFrame | None:
        """Rows of the target as last published, or None before the first run."""
        return self.store.read(self.store.current().parts)

    def pending(self, source: DataFrame) -> DataFrame:
        """Distinct states of ``source`` that no published row was made from."""
        states, done = self._flat(source, "k"), self.published()
        if done is not None:
            names = range(2 * len(self.state))
            same = reduce(lambda a, b: a & b, [F.col(f"__k{i}") == F.col(f"__d{i}") for i in names])
            states = states.join(self._flat(done, "d"), same, "left_anti")
        return states.select(*[F.when(~F.col(f"__k{2 * i + 1}"), F.col(f"__k{2 * i}")).alias(c) for i, c in enumerate(self.state)])

    def _flat(self, rows: DataFrame, name: str) -> DataFrame:
        """Distinct states as pairs of a value, or a stand-in for null, and whether it is null.

        Grouping and joining are then by the same plain columns, so a row that
        was moved for the one is where the other needs it. That holds for the
        usual key and version; the planner may change the order of more than four
        columns, and then moves one side again.
        """
        columns = []
        for i, c in enumerate(self.state):
            stand_in = F.lit(next(value for kind, value in STAND_INS if isinstance(rows.schema[c].dataType, kind))).cast(rows.schema[c].dataType)
            columns += [F.coalesce(F.col(c), stand_in).alias(f"__{name}{2 * i}"), F.col(c).isNull().alias(f"__{name}{2 * i + 1}")]
        return rows.select(*columns).distinct()

    def publish(self, rows: DataFrame, run: str) -> Version:
        """Add the rows of one run as a new version of the target; a run already published changes nothing."""
        base = self.store.current()
        if any(p.tag == run for p in base.parts):
            return base
        path = self.store.new_part_path()
        rows.write.parquet(path)
        return self.store.publish(base, (*base.parts, Part(path, run)))

    def undo(self, run: str) -> Version:
        """Take a run's rows out again: its states become pending."""
        base = self.store.current()
        kept = tuple(p for p in base.parts if p.tag != run)
        return base if kept == base.parts else self.store.publish(base, kept)


def last_successful_mark(runs: DataFrame) -> DataFrame:
    """One row, ``mark``: the greatest mark of an attempt whose last state is ``ok``; null if there is none.

    Attempts are (run_no, attempt); their last state is that of the greatest
    state_at, on a tie the greatest run_state. Rows with a null state_at come first.
    """
    order = F.struct(F.col("state_at"), F.col("run_state"), F.col("mark"))
    last = runs.groupBy("run_no", "attempt").agg(F.max(order).alias("last"))
    return last.where(F.col("last.run_state") == "ok").agg(F.max("last.mark").alias("mark"))
