"""evlens: multi-tenant event analytics as Spark DataFrame operators.

Main entry points:
  evlens.session.build_session          session with the library defaults
  evlens.sources.tables                 schemas, pruned scans, sinks
  evlens.operators.reports              Q1-Q8 event reports
  evlens.operators.tenants              Q9-Q19 tenant / key / user reports
  evlens.operators.security, reqlog     Q20-Q29 log reports
  evlens.operators.ingest               I1-I15 admission
  evlens.operators.limits               L1-L6 counter replays
  evlens.operators.upkeep               M1-M15 table upkeep, Q27-Q28
  evlens.streaming                      T1-T4
  evlens.jobs                           batch jobs sharing the stream's per-batch code
"""

__version__ = "0.1.0"
