"""tallyline: analytics over ledgers of ordered events, written as PySpark DataFrame jobs.

sources/    readers, writers, upserts, table layout
functions/  column factories: flags, metrics, dimensions, text normalisation
operators/  derivations, query views, studies, models, audits
plans/      the registered queries with their SQL twins
streaming/  Structured Streaming forms of the running-state operators
llm/        training-data operators; nothing else imports it
"""
