"""Security-guidance analytics as Spark DataFrame jobs.

Layers: ``functions`` build Columns, ``sources`` read and write tables,
``operators`` are the reusable DataFrame steps, ``plans`` compose them into the
user-facing pipelines, ``streaming`` runs two of them on streams.  Every
function takes and returns DataFrames or Columns; none holds a session.
"""
