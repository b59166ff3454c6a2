"""Entry point 2: a change batch -> the next snapshot, published only if clean.

``apply_and_publish`` overlays the changes on the base (S8 full rows or S9 some
columns), checks every rule on the groups the changes touch, and writes the new
snapshot to a new path only when no rule reports a violation (S14); otherwise it
raises ``ConstraintViolation`` with a bounded sample and writes nothing. The
trigger's statement rollback becomes "decide before writing".
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from podium.operators import rules as R
from podium.operators.overlay import overlay_rows, update_columns
from podium.sources.sinks import publish_draft


def apply_and_publish(base: DataFrame, changes: DataFrame, races: DataFrame, rules: Sequence, target: str,
                      *, key: str = "ResultId", columns: Sequence[str] | None = None,
                      insert: bool = False, dry_run: bool = False) -> str | None:
    """Publish ``base`` with ``changes`` applied to ``target`` if every rule holds.

    insert=True appends the changes as new rows (INSERT); otherwise they update
    rows by ``key`` - all columns (S8) or only ``columns`` (S9). The new state is
    written once, beside the target; every check reads it there, and a clean one is renamed to the target.
    """
    if insert:
        state = base.unionByName(changes.select(*base.columns))
    elif columns:
        state = update_columns(base, changes, key, columns)
    else:
        state = overlay_rows(base, changes, key)
    spark, draft = base.sparkSession, f"{target.rstrip('/')}-draft-{uuid.uuid4().hex}"
    state.write.mode("errorifexists").parquet(draft)
    state = spark.read.parquet(draft)
    # the groups to check are those of the new state's changed rows: a change that names only its key
    # and some columns does not say which race or season it belongs to
    touched = state.join(changes.select(key).distinct(), key, "left_semi")
    checks = {}
    for rule in rules:
        if isinstance(rule, R.CapRule):
            checks[rule.name] = R.violations(rule, state, touched)
        elif isinstance(rule, R.OwnerRule):
            checks[rule.name] = R.violations(rule, R.with_season(state, races, season=rule.season),
                                             R.with_season(touched, races, season=rule.season))
        else:
            checks[rule.name] = R.violations(rule, state, touched, races=races)
    return publish_draft(spark, draft, checks, target, dry_run=dry_run)
