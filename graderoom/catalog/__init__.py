"""Importing this package registers every query with its oracle SQL."""

from graderoom.catalog import metrics  # noqa: F401
from graderoom.catalog import relational  # noqa: F401
from graderoom.catalog import verdict  # noqa: F401
from graderoom.catalog import perf  # noqa: F401
from graderoom.catalog import vectors  # noqa: F401
from graderoom.catalog import text  # noqa: F401
from graderoom.catalog import sources  # noqa: F401
from graderoom.catalog import inputs  # noqa: F401
from graderoom.catalog import streaming  # noqa: F401
from graderoom.catalog import plans  # noqa: F401
