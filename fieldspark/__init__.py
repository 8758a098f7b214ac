"""fieldspark: field-experiment analytics as Spark DataFrame plans.

Sub-packages
------------
sources    typed readers, column-name normalisation, literal tables, sinks
functions  Column-level helpers (strings, dates, conditionals, hashed random)
operators  DataFrame -> DataFrame operators (reshape, aggregate, window,
           joins and grids, posterior-draw algebra, model aggregations)
plans      domain pipelines composed from the operators, plus the driver
           queries over the benchmark tables
llm        corpus operators for language-model training (self-contained)
"""

__version__ = "0.1.0"
