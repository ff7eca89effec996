"""flowloom: network-flow analytics expressed as Spark jobs.

Packets become flows, flows become features, findings, root causes and reports.
Every step is a DataFrame transformation; see the sub-packages:

``sources``    tables, captures, labelled CSV, report and flow-table sinks
``functions``  column expressions (tokens, ports, signatures, frames, text)
``operators``  flow assembly, rules, contexts, verdicts, packing, metrics, detector
``plans``      whole jobs built from the operators, and the query catalogue
``streaming``  the cross-flow contexts over event-time windows
"""

__version__ = "0.1.0"
