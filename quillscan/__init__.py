"""quillscan — essay screening and writing-pattern analytics as Spark DataFrame jobs.

Layout
------
functions/   Column -> Column expressions (sentence splitting, script features, rules)
operators/   DataFrame -> DataFrame operators (rollups, corpus steps, evaluation, TF-IDF)
sources/     table readers/writers and the derived test views (essays, pairs)
plans/       end-to-end flows (screening, pattern profile, rule profile, corpus builds, models)
streaming/   Structured Streaming form of the scoring flows
"""

__version__ = "0.1.0"
