"""All queries over the driver's tables; importing the modules registers them."""

from strandline.plans import edit_queries, queries, trace_queries  # noqa: F401
from strandline.plans.registry import QUERIES, SQL  # noqa: F401
