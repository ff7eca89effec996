"""Reports over event-time windows: every flow window judged with the contexts of its own window.

Two streaming jobs with a table between them. The first turns packets into flow windows (keyed state). The second
reads these as a stream and joins them with the scan and flood contexts of the same window; both joins are outer joins
of streams on the window's end, so their state goes when the watermark has passed the window. Contexts below the limits
can't change a report and never enter a join. Ladder, texts and actions are those of the batch reports, and a window
takes the place of a capture: a replay gives the reports that ``plans.diagnose`` gives for the windows' packets.

Late packets are those at or behind the watermark when they arrive: they are dropped before the flow windows and
change neither flows nor contexts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import verdicts as V
from flowloom.plans.diagnose import report_rows
from flowloom.streaming import contexts as C


def attach_window_contexts(flows: DataFrame, limits: V.Limits = V.Limits(), late: str = "0 seconds") -> DataFrame:
    """Left joins of flow windows with their source's and target's context; ``flows`` has a watermark-able ``end``."""
    def timed() -> DataFrame:
        return flows.withWatermark("end", late)

    window = ["end", "capture"]
    by_src = C.scans(C.exact_contexts(timed(), window, C.SOURCE, C.SOURCE_PAIR, "n_distinct_dst_ports"), limits).select(
        *window, "src", F.col("n_distinct_dst_ports").alias("src_ports"))
    by_dst = C.floods(C.exact_contexts(timed(), window, C.TARGET, C.TARGET_PAIR, "n_distinct_sources"), limits).select(
        *window, "dst", "dport", F.col("n_distinct_sources").alias("dst_sources"), F.col("n_packets").alias("dst_packets"),
        F.col("syn_only_ratio").alias("dst_ratio"))
    return timed().join(by_src, [*window, "src"], "left").join(by_dst, [*window, "dst", "dport"], "left")


def window_reports(flows: DataFrame, scorer: Callable[[DataFrame], DataFrame], limits: V.Limits = V.Limits(),
                   late: str = "0 seconds", actions: dict[str, list[str]] | None = None) -> DataFrame:
    """Reports of flow windows. ``scorer`` adds ``anomaly_score`` to flow rows, without an aggregate."""
    return report_rows(attach_window_contexts(scorer(flows), limits, late), limits, actions, keep=["end"])
