"""provenant: content-digest Records and study-design expansion as Spark jobs.

Sub-packages:

* ``functions``  -- column functions (digests, ids, paths, templates)
* ``sources``    -- readers and writers (contents, includes, Records, design, markers)
* ``operators``  -- DataFrame operators (records, compare, steps, study, status)
* ``plans``      -- derived inputs and the registered queries with oracle SQL
* ``streaming``  -- incremental status-log checks with Structured Streaming
"""

__version__ = "0.1.0"
