"""Project records: operational fields of outputs, missing and extra members, restart states."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields a run writes back into stored outputs.
OPERATIONAL = (
    "status", "progress", "error", "publication_video_path", "publication_original_srt_path",
    "publication_narration_srt_path", "render_signature", "sanitized_title",
)


# Between a project and an id; no name holds it.
BETWEEN = "\x1f"


def per_project(*keys: str) -> Callable:
    """An operator on tables keyed by `keys` that keeps projects apart where its tables have a `project` column.

    Ids are only unique inside a project (every project has an E01). The project goes into the keys before the operator runs, so
    it is part of every join, group and window there, and comes out as a column of its own. A null project is the project ''.
    Tables without the column are one project; all tables have it or none has.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args, **named):
            given = [a for a in (*args, *named.values()) if isinstance(a, DataFrame)]
            with_project = ["project" in t.columns for t in given]
            if not any(with_project):
                return operator(*args, **named)
            if not all(with_project):
                raise ValueError(f"{operator.__name__}: some tables have a project and some have none")
            project = F.coalesce(F.col("project").cast("string"), F.lit(""))

            def inside(value):
                if not isinstance(value, DataFrame):
                    return value
                return value.withColumns({k: F.concat(project, F.lit(BETWEEN), F.col(k)) for k in keys if k in value.columns}).drop("project")

            out = operator(*map(inside, args), **{name: inside(value) for name, value in named.items()})
            present = [k for k in keys if k in out.columns]
            part = lambda k, n: F.get(F.split(F.col(k), BETWEEN, 2), F.lit(n))
            columns = [part(c, 1).alias(c) if c in present else F.col(c) for c in out.columns]
            return out.select(part(present[0], 0).alias("project"), *columns)

        return run

    return wrap


def upsert_outputs(stored: DataFrame, current: DataFrame, keys: Sequence[str] = ("project", "output_id")) -> DataFrame:
    """Stored outputs with the operational fields of the current run; new outputs are appended."""
    fields = [c for c in OPERATIONAL if c in current.columns]
    rest = [c for c in stored.columns if c not in keys and c not in fields]
    new = current.select(*keys, *[F.col(c).alias(f"n_{c}") for c in (*fields, *[r for r in rest if r in current.columns])], F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    ran = F.coalesce("_new", F.lit(False))
    value = {c: F.when(ran, F.col(f"n_{c}")).otherwise(F.col(c)) for c in fields}
    value |= {c: F.when(F.col("_old").isNull(), F.col(f"n_{c}")).otherwise(F.col(c)) for c in rest if c in current.columns}
    return both.select(*keys, *[value.get(c, F.col(c)).alias(c) for c in stored.columns if c not in keys])


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): members expected but absent, and present but not expected."""
    lacking = expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")
    surplus = actual.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti")
    return lacking.withColumn("side", F.lit("missing")).unionByName(surplus.withColumn("side", F.lit("extra")))


def restart_states(projects: DataFrame) -> DataFrame:
    """After a restart nothing runs: running and queued projects are paused."""
    return projects.withColumn("status", F.when(F.col("status").isin("RUNNING", "QUEUED"), "PAUSED").otherwise(F.col("status")))


def evidence_totals(evidence: DataFrame, key: str = "project") -> DataFrame:
    """Evidence items and episodes with any, per project."""
    per = evidence.groupBy(key, "episode_id").agg(F.count(F.lit(1)).alias("items"))
    return per.groupBy(key).agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("episodes"))
