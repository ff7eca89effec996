"""Expected results of replayed streams: the same as over whole tables, window by window."""

from __future__ import annotations

from oracle.wire import ALL, BARE, FROM_TABLE, REPORT_COLUMNS, WIRE

WIDTH = 900
# Addresses that carry their window make flows, contexts and verdicts end at its borders.
_START = f"CAST(event_id // {WIDTH} * {WIDTH} AS VARCHAR)"
WINDOWED = f"(SELECT * REPLACE (concat({_START}, '|', src) AS src, concat({_START}, '|', dst) AS dst) FROM {FROM_TABLE})"


def _plain(column: str) -> str:
    return f"regexp_replace({column}, '[0-9]+[|]', '', 'g') AS {column}"


_NAMED = REPORT_COLUMNS.replace("flow, ", "", 1).replace("reasoning, ", "")
ORACLES = {
    "stream_packet_index": f"WITH {WIRE} SELECT flow, event_id, idx AS packet_index FROM capped",
    "stream_source_windows": f"""WITH {WIRE} SELECT CAST(event_id // {WIDTH} * {WIDTH} AS BIGINT) AS window_start, src, count(*) AS n_packets,
        count(DISTINCT concat(dst, '|', dport)) AS n_distinct_dst_ports, round(avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END), 6) AS syn_only_ratio
        FROM wire GROUP BY 1, src""",
    "stream_target_windows": f"""WITH {WIRE} SELECT CAST(event_id // {WIDTH} * {WIDTH} AS BIGINT) AS window_start, dst, dport, count(*) AS n_packets,
        count(DISTINCT concat(src, '|', sport)) AS n_distinct_sources, round(avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END), 6) AS syn_only_ratio
        FROM wire GROUP BY 1, dst, dport""",
    "stream_reports": f"""WITH {ALL.replace(FROM_TABLE, WINDOWED, 1)}
        SELECT concat(split_part(flow, '|', 1), '|', regexp_replace(flow, '[0-9]+[|]', '', 'g')) AS flow, {_NAMED}, {_plain('reasoning')} FROM report""",
}
