"""Writing approved comments of a run, or of all runs, to the catalog."""

from metadoc.operators.results import filter_results, latest_approved
from metadoc.operators.review import applied_counts
from metadoc.sinks.catalog import publish


def run(spark, results, execution_id=None):
    """The newest approved comment per object is written; (outcomes, counts)."""
    outcomes = publish(spark, latest_approved(filter_results(results, execution_id)))
    return outcomes, applied_counts(outcomes)
