"""skyledger: flight-delay star-schema analytics expressed as Spark DataFrame plans.

Layers (each a sub-package):

* ``functions``  – scalar Column expressions (clock, calendar, flags, text cleaning)
* ``sources``    – readers for raw files, landed API JSON, and the flight-shaped test view
* ``operators``  – dimension maintenance, key resolution, upsert, star join, analytics,
                   weather matching, feature engineering, data-quality checks
* ``plans``      – end-to-end jobs (historical load, live update, dashboard)
* ``streaming``  – the live update as a Structured Streaming ``foreachBatch`` job
* ``ml``         – Spark ML training, evaluation, model selection and batch scoring
"""

__version__ = "0.1.0"
