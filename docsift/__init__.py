"""docsift: document preparation and hybrid search as Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) -> DataFrame``. Nothing here
collects rows to the driver; the only driver-side actions are row counts
on tables whose size has a structural bound (query batches, centroid
tables), used to decide broadcast versus shuffle.
"""

from docsift.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
