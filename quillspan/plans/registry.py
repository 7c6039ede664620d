"""All registered queries over the driver's tables, and the same queries in DuckDB SQL.

The engine's own data is absent, so driver tables stand in; each module says which for what.
"""

from quillspan.plans import checks, choice, hooks, ledger, matching, palettes, ratings, texts, wall  # noqa: F401
from quillspan.plans.base import QUERIES, SQL  # noqa: F401
