"""staylink: linked-episode cohort analysis on Spark DataFrames.

Packages:
- ``staylink.sources``    CSV ingest, fixture views over the test tables, parquet hand-over
- ``staylink.functions``  scalar column helpers (dates, flags, recodes)
- ``staylink.operators``  episodes, cohort, deaths, stays, reports, readmission,
                          comorbidity, survival, quality; ``scan`` is the ranged
                          per-person ordered scan they share
- ``staylink.plans``      the analysis as stages, the registered queries and their SQL oracles
- ``staylink.llm``        operators for training data (text dedup, packing, ...); nothing else imports it
"""

__version__ = "0.1.0"
