"""All queries over the driver tables and their SQL twins."""

from voxloom.plans import annotation_queries, event_queries, record_queries, split_queries, text_queries, voxel_queries, work_queries  # noqa: F401
from voxloom.plans.base import QUERIES, SQL  # noqa: F401
