"""weekcraft: weekly multi-site performance analytics as Spark jobs.

Layout
------
functions/  Column -> Column expression builders (cleaning, formats, dates, concept dictionary)
sources/    readers: driver tables and their bindings to the logical model, wide report files
operators/  reusable DataFrame operators (reshape, aggregates, windows, ranks, upserts, security, quality)
plans/      whole query plans built from operators (weekly matrix, daily detail, loads, admin jobs)
streaming/  Structured Streaming jobs (incremental arrival, sessions, lock-outs)
"""

from weekcraft.session import build_session, checkpoint_dir  # noqa: F401
