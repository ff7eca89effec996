"""Expected results over flow sizes, labels and scores."""

from __future__ import annotations

from flowloom.plans import fixtures as FX
from oracle.payload import ONE, PACKETS
from oracle.wire import fill

FC = f"fc AS ({fill(FX.FLOW_COUNTS)})"
SC = f"sc AS ({fill(FX.SCORED_FLOWS)})"
LG = f"lg AS ({fill(FX.CLASS_LOGITS)})"
CS = f"cs AS ({fill(FX.CAPTURE_SCORES)})"


def order(seed: int) -> str:
    return f"md5(concat('{seed}|', flow_id)), flow_id"


def edge(n: str, edges: str = "[2, 4, 8, 16]") -> str:
    return f"CAST(coalesce(list_min(list_filter({edges}, lambda e: e >= {n})), list_max({edges})) AS INT)"


BATCHED = f"{FC}, b AS (SELECT *, row_number() OVER (ORDER BY {order(3)}) - 1 AS r FROM fc)"
SPLIT = f"""{FC}, s AS (SELECT flow_id, row_number() OVER (ORDER BY {order(0)}) - 1 < (SELECT CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS BIGINT) FROM fc) AS is_train FROM fc)"""


def weights(label: str, table: str, k: int) -> str:
    return f"""cnt AS (SELECT {label} AS label, count(*) AS c FROM {table} GROUP BY {label}),
raw AS (SELECT CAST(l.range AS INT) AS label, coalesce(c, 0) AS c, CASE WHEN c > 0 THEN CAST((SELECT sum(c) FROM cnt) AS DOUBLE) / c ELSE 0 END AS inv
    FROM range({k}) l LEFT JOIN cnt ON cnt.label = l.range),
wt AS (SELECT label, c, inv / (SELECT avg(inv) FROM raw WHERE inv > 0) AS weight FROM raw)"""


# All choices of three edges below 16, cheapest first; ties take the smallest last-but-one edge first.
EDGES4 = """h AS (SELECT CAST(least(n, 16) AS INT) AS size, count(*) AS c FROM fc GROUP BY ALL),
e AS (SELECT a.range AS e1, b.range AS e2, d.range AS e3 FROM range(1, 16) a, range(1, 16) b, range(1, 16) d
    WHERE a.range < b.range AND b.range < d.range),
best AS (SELECT e1, e2, e3 FROM (SELECT e1, e2, e3, sum(c * CASE WHEN size <= e1 THEN e1 WHEN size <= e2 THEN e2 WHEN size <= e3 THEN e3 ELSE 16 END) AS cost
    FROM e, h GROUP BY ALL) ORDER BY cost, e3, e2, e1 LIMIT 1),
edges AS (SELECT [CAST(e1 AS INT), CAST(e2 AS INT), CAST(e3 AS INT), 16] AS l FROM best)"""
PACKED = f"""{FC}, {EDGES4}, p AS (SELECT flow_id, n, {edge('n', 'l')} AS edge FROM fc, edges),
r AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY {order(0)}) - 1 AS r FROM p)"""

ARGMAX = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"
PRED = f"{LG}, pr AS (SELECT *, {ARGMAX} AS pred FROM lg)"


def f1(table: str, k: int) -> str:
    return f"""f1 AS (SELECT CAST(k.range AS INT) AS class_id,
    (SELECT count(*) FROM {table} WHERE pred = k.range AND label = k.range) AS tp,
    (SELECT count(*) FROM {table} WHERE pred = k.range AND label <> k.range) AS fp,
    (SELECT count(*) FROM {table} WHERE pred <> k.range AND label = k.range) AS fn FROM range({k}) k)"""


F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END"


def auc(table: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM {table}),
auc AS (SELECT (sum(avg_rank) FILTER (WHERE label = 1) - p * (p + 1) / CAST(2 AS DOUBLE)) / (CAST(p AS DOUBLE) * n) AS auc
    FROM rk, (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {table}) GROUP BY p, n)"""


EXPS = "list_transform(logits, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(logits) AS DOUBLE)))"
CE = f"(ln(list_sum({EXPS})) + CAST(list_max(logits) AS DOUBLE) - CAST(logits[label + 1] AS DOUBLE))"

ORACLES = {
    "train_val_split": f"WITH {SPLIT} SELECT flow_id, is_train FROM s",
    "split_check": f"""WITH {SPLIT} SELECT count(*) AS n_flows, count(*) FILTER (WHERE is_train) AS n_train,
        count(*) FILTER (WHERE NOT is_train) AS n_val, CAST(0 AS BIGINT) AS n_shared, CAST(0 AS BIGINT) AS n_missing FROM s""",
    "assign_batches": f"""WITH {BATCHED} SELECT flow_id, CAST(r // 256 AS BIGINT) AS batch_id, CAST(r % 256 AS INT) AS slot_in_batch,
        CAST(label_cls AS BIGINT) AS label FROM b""",
    "ordered_batches": f"""WITH {FC}, b AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) - 1 AS r FROM fc)
        SELECT flow_id, CAST(r // 256 AS BIGINT) AS batch_id, CAST(r % 256 AS INT) AS slot_in_batch FROM b""",
    "full_batches": f"""WITH {BATCHED} SELECT CAST(r // 256 AS BIGINT) AS batch_id, count(*) AS n_flows FROM b
        WHERE r // 256 < (SELECT count(*) // 256 FROM fc) GROUP BY ALL""",
    "class_weights": f"WITH {FC}, {weights('label_cls', 'fc', 12)} SELECT label, c AS n_flows, round(weight, 6) AS weight FROM wt",
    "example_weights": f"""WITH {FC}, {weights('label_bin', 'fc', 2)} SELECT flow_id, label_bin, round(weight, 6) AS weight
        FROM fc JOIN wt ON wt.label = label_bin""",
    "packet_histogram": f"WITH {FC} SELECT CAST(least(n, 16) AS INT) AS size, count(*) AS n_flows FROM fc GROUP BY ALL",
    "optimal_buckets": f"WITH {FC}, {EDGES4} SELECT unnest(l) AS edge FROM edges",
    "bucket_assign": f"WITH {FC} SELECT flow_id, n, {edge('n')} AS edge FROM fc",
    "bucket_batches": f"""WITH {FC}, p AS (SELECT flow_id, {edge('n')} AS edge FROM fc)
        SELECT flow_id, edge, CAST((row_number() OVER (PARTITION BY edge ORDER BY {order(1)}) - 1) // 64 AS BIGINT) AS batch_no FROM p""",
    "pack_bucketed": f"""WITH {PACKED} SELECT edge, CAST(r // 64 AS BIGINT) AS batch_no, count(*) AS n_flows,
        CAST(sum(n) AS BIGINT) AS n_packets FROM r GROUP BY ALL""",
    "pack_coverage": f"""WITH {FC} SELECT count(*) AS n_flows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS "foreign",
        CAST(0 AS BIGINT) AS repeated FROM fc""",
    "trim_flows": f"""WITH {PACKETS}, {ONE} SELECT flow_id, CAST(CASE WHEN npkts <= 4 THEN 4 ELSE 16 END AS INT) AS edge, npkts,
        npkts AS n_kept, CAST(n_bytes AS INT) AS n_bytes FROM flow""",
    "padding_report": f"""WITH {PACKED}, t AS (SELECT count(*) AS n_examples, CAST(sum(n) AS BIGINT) AS real, count(*) * 16 AS naive,
        CAST(sum(edge) AS BIGINT) AS packed, count(DISTINCT edge) AS shapes FROM p),
        nb AS (SELECT CAST(sum(ceil(c / CAST(64 AS DOUBLE))) AS BIGINT) AS n_batches FROM (SELECT edge, count(*) AS c FROM p GROUP BY edge))
        SELECT n_examples, array_to_string(l, ',') AS buckets, 'bucket' AS strategy, n_batches, shapes AS distinct_shapes,
        real AS real_packet_tokens, naive AS naive_padded_tokens, packed AS packed_padded_tokens,
        CAST(printf('%.4f', real / CAST(naive AS DOUBLE)) AS DOUBLE) AS naive_efficiency, CAST(printf('%.4f', real / CAST(packed AS DOUBLE)) AS DOUBLE) AS packed_efficiency,
        CAST(printf('%.4f', 1.0 - packed / CAST(naive AS DOUBLE)) AS DOUBLE) AS padding_reduction FROM t, nb, edges""",
    "accuracy": f"WITH {PRED} SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pr",
    "macro_f1": f"WITH {PRED}, {f1('pr', 12)} SELECT round(avg({F1}), 6) AS macro_f1 FROM f1",
    "class_recall": f"""WITH {PRED}, {f1('pr', 10)} SELECT class_id, tp, fp, fn,
        round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall, round({F1}, 6) AS f1 FROM f1""",
    "roc_auc": f"WITH {SC}, {auc('sc')} SELECT round(auc, 9) AS auc FROM auc",
    "average_ranks": f"WITH {SC}, {auc('sc')} SELECT flow_id, avg_rank FROM rk",
    "score_spread": f"""WITH {SC} SELECT count(*) AS n, round(quantile_cont(score, 0.05), 6) AS score_p05,
        round(quantile_cont(score, 0.95), 6) AS score_p95 FROM sc""",
    "score_summary": f"""WITH {CS} SELECT capture, round(min(score), 6) AS min_score, round(quantile_cont(score, 0.5), 6) AS median_score,
        round(max(score), 6) AS max_score, count(*) FILTER (WHERE score > 0.5) AS n_flagged, count(*) AS n_flows FROM cs GROUP BY capture""",
    "anomaly_flag": f"WITH {SC} SELECT flow_id, score, score > 0.5 AS anomaly FROM sc",
    "softmax": f"""WITH {LG}, s AS (SELECT vec_id, {EXPS} AS e FROM lg), g AS (SELECT vec_id, e, unnest(range(0, len(e))) AS i FROM s)
        SELECT vec_id, CAST(i AS INT) AS class_id, round(e[i + 1] / list_sum(e), 6) AS p FROM g""",
    "weighted_loss": f"""WITH {LG}, {weights('label', 'lg', 10)}, l AS (SELECT {CE} AS ce, weight FROM lg JOIN wt USING (label))
        SELECT round(sum(ce * weight) / greatest(sum(weight), 1e-8), 6) AS weighted, round(avg(ce), 6) AS plain FROM l""",
    "evaluate": f"""WITH {SC}, pr AS (SELECT label, CAST(score > 1 - score AS INT) AS pred, 1 / (1 + exp((1 - score) - score)) AS raw_score FROM sc),
        {f1('pr', 2)}, {auc('sc')}
        SELECT (SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM pr) AS accuracy, (SELECT count(*) FROM pr) AS n,
        (SELECT round(avg({F1}), 6) FROM f1) AS macro_f1, (SELECT round(auc, 6) FROM auc) AS auc,
        (SELECT round(quantile_cont(raw_score, 0.05), 6) FROM pr) AS score_p05,
        (SELECT round(quantile_cont(raw_score, 0.95), 6) FROM pr) AS score_p95""",
    "evaluate_classes": f"""WITH {PRED}, {f1('pr', 10)} SELECT (SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) FROM pr) AS accuracy,
        (SELECT count(*) FROM pr) AS n, (SELECT round(avg({F1}), 6) FROM f1) AS macro_f1""",
    "majority_baseline": f"""WITH {FC}, c AS (SELECT label_cls AS label, count(*) AS c FROM fc GROUP BY ALL)
        SELECT (SELECT CAST(label AS BIGINT) FROM c ORDER BY c DESC, label LIMIT 1) AS label,
        round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS accuracy, CAST(sum(c) AS BIGINT) AS n FROM c""",
    "best_epoch": """WITH g AS (SELECT event_type, event_id // 100 AS epoch, sum(CAST(trunc(value * 100) AS BIGINT)) / CAST(10000000 AS DOUBLE) AS raw,
        count(*) / CAST(100 AS DOUBLE) AS macro_f1 FROM events GROUP BY ALL),
        f AS (SELECT event_type, epoch, CASE WHEN epoch % 5 = 0 OR epoch % 7 = 0 OR epoch % 11 = 0 OR raw = 0 THEN macro_f1 ELSE raw END AS figure FROM g)
        SELECT event_type, CAST(epoch AS BIGINT) AS epoch, round(figure, 9) AS figure, figure > coalesce(max(figure) OVER (PARTITION BY event_type
            ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM f""",
}
