"""The stored lookup and the stored correction queue, kept in committed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import CommittedTable
from .corrections import approvals, new_submissions, queue_state
from .lookup import upsert

LOOKUP = "field_key string, tier string, country string, raw string, std string"
SUBMISSION = (
    "id string, submitted_at string, submitted_by string, country string, raw_value string, field_key string, field_display string, original string, proposed string, source string"
)
DECISION = "id string, action string, decided_at string, seq bigint, note string, needs_update boolean"


def lookup_store(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, LOOKUP)


def apply_approvals(store: CommittedTable, approved: DataFrame, batch: str | None = None) -> int:
    """Bring approved corrections into the stored lookup as a new version; the old one stays readable, and
    stays the last one if this fails. A batch that was applied isn't applied again."""
    return store.change(lambda lookup: upsert(lookup, approved), "replace", batch)


def first_decisions(decisions: DataFrame) -> DataFrame:
    """The decision of each submission that counts."""
    first = Window.partitionBy("id").orderBy("decided_at", "seq")
    return decisions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class QueueStore:
    """Submissions and decisions, each appended in batches.

    Keys that are pending when submissions arrive are left out even where two writers send them at once:
    the second one finds that the table has changed and looks again.
    """

    spark: SparkSession
    path: str
    submission: str = SUBMISSION
    decision: str = DECISION

    @property
    def submissions(self) -> CommittedTable:
        return CommittedTable(self.spark, f"{self.path}/submissions", self.submission)

    @property
    def decisions(self) -> CommittedTable:
        return CommittedTable(self.spark, f"{self.path}/decisions", self.decision)

    def submit(self, rows: DataFrame, order_column: str, batch: str | None = None) -> int:
        """Append what ``corrections.new_submissions`` leaves of ``rows``."""
        return self.submissions.change(lambda sent: new_submissions(rows, queue_state(sent, self.decisions.read()), order_column), "append", batch)

    def decide(self, rows: DataFrame, batch: str | None = None) -> int:
        return self.decisions.append(rows, batch)

    def state(self) -> DataFrame:
        """The queue as it is: see ``corrections.queue_state``."""
        return queue_state(self.submissions.read(), self.decisions.read())

    def compact(self) -> None:
        """Rewrite both tables as one folder each, with the one decision of each submission that counts: later
        reads take these and what was appended since. A decision that comes later but was taken earlier
        still counts, as it would have."""
        self.submissions.compact()
        self.decisions.change(first_decisions, "replace")

    def apply_to(self, lookup: CommittedTable, batch: str | None = None) -> int:
        """Bring all approvals into a stored lookup."""
        return apply_approvals(lookup, approvals(self.state()), batch)
