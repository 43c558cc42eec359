"""recframe — recommendation-data operators on the Spark DataFrame API.

Every operator takes and returns ``pyspark.sql.DataFrame`` (or ``Column``)
objects; Catalyst plans the work.  Python runs on executors only for the
blockwise vector maths and the encoder hooks.
"""

from recframe.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__version__ = "0.1.0"
