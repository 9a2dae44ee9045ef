"""Job profitability analytics for field-service businesses, on Spark DataFrames.

Layers, each a set of plain ``DataFrame -> DataFrame`` functions:

``sources``    raw tables in, published tables and CSV exports out
``functions``  casts, ratios, the named-measure registry, display formats
``operators``  staging, job economics, the job fact, filters, quality rules
``plans``      scorecards, dashboard answers, the what-if story, the full refresh
"""
