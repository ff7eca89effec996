"""Expected results of queries over sketches, bucketed tables, as-of edges and JSON reports."""

from __future__ import annotations

from oracle import wire
from oracle.wire import ALL, BARE, WIRE


def _contexts(key: str, pair: str) -> str:
    return f"""WITH {WIRE} SELECT {key}, count(*) AS n_packets, round(avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END), 6) AS syn_only_ratio,
        count(DISTINCT concat({pair})) AS n_pairs, true AS within_bound FROM wire GROUP BY {key}"""


ORACLES = {
    "sketch_source_contexts": _contexts("src", "dst, '|', dport"),
    "sketch_target_contexts": _contexts("dst, dport", "src, '|', sport"),
    "asof_edges": """WITH e AS (SELECT source, n_chars // 500 AS class, max(n_chars) AS edge, count(*) AS n_class FROM documents
            GROUP BY source, n_chars // 500 HAVING count(*) >= 2)
        SELECT d.doc_id, d.source, d.n_chars, min(e.edge) AS edge, arg_min(e.n_class, e.edge) AS n_class
        FROM documents d LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.edge >= d.n_chars GROUP BY d.doc_id, d.source, d.n_chars""",
    "bucketed_score_join": wire.ORACLES["score_records_join"],
    "report_json_fields": f"WITH {ALL} SELECT flow, packets, anomaly_score, anomaly, tag, label, finding_codes, actions FROM report",
}
