"""effortlab: work-item effort and overrun-risk analytics as Spark jobs.

Sub-packages
------------
functions   column expressions (text features, literal parsers, labels, formatting)
sources     table readers/writers (testdata views, CSV, nested JSON export, stores)
operators   DataFrame operators (split/CV, aggregates, top-k, TF-IDF/LSA, models)
plans       composed jobs and reports (prepare, baselines, error report, scoring)
streaming   Structured Streaming jobs (scoring, feedback, retrain trigger)
"""

__all__ = ["session"]
