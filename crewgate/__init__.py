"""crewgate: site-access rosters as Spark DataFrame jobs.

Subpackages: ``functions`` (column rules), ``sources`` (tables, raw roster
CSV, change records, test-table views), ``operators`` (listings, reports,
quality checks, changes, bulk load, keys), ``plans`` (registered queries and
their SQL oracle), ``streaming`` (flag-change feed).
"""

__version__ = "0.1.0"
