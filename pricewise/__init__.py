"""pricewise — retail demand and price analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (composable with
``DataFrame.transform``); planning is left to Catalyst and AQE.  Sub-packages:

* ``sources``    schemas, readers/writers, and the testdata -> retail-table fixtures
* ``functions``  column-level helpers (dates, keys, safe arithmetic)
* ``operators``  joins, aggregates, windows, panels, forecasts, models, optimiser
* ``plans``      the registered queries and their DuckDB oracle SQL
* ``streaming``  incremental (Structured Streaming) form of the daily demand build
"""

__version__ = "0.1.0"
