"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line with seconds per query.

Each query is executed in full through the ``noop`` sink (no result travels
to the driver); fit steps inside a query (level counts, ranges, lambdas)
run as part of building it and are timed with it. Before timing, every
headline query runs once on the smallest tables (sf0.001) so JVM JIT and
whole-stage-codegen compilation are not billed to the first query; the
reported numbers are steady-state seconds at ``$BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import get_session  # noqa: E402
from tessera.sources.tables import VIEW_PARTITIONS  # noqa: E402

HEADLINE = [
    "v1_logloss_by_fold",        # flagship: impact coding + folds + log-loss
    "e3_impact_encode",
    "e5_nb_impact",
    "e6_frequency_encode",
    "e11_first_appearance_codes",
    "a5_numeric_summary",
    "a5_lineitem_summary",
    "c5_association_matrix",
    "c5_lineitem_association",
    "t3_yeo_johnson",
    "i3_median_fill",
    "i4_random_impute",
    "v2_auc_by_fold",
    "v5_stratified_folds",
    "v9_oof_average",
    "d_median_imputed",          # end to end: pipeline, join, exact-median imputation
]

#: Timed after the headline queries and reported beside them, not in their total.
LEARNERS = [
    "m4_gbt_cv_scores",          # 15 early-stopped boosted fits
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.conf.set(VIEW_PARTITIONS, str(cpus))  # the test tables are single small files
    qs = catalog.queries()
    # warm-up on the smallest tables: JVM JIT, codegen caches
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    qs["s1_claims_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    learners = {}
    for name in LEARNERS:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        learners[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": times, "learners": learners, "sf": sf, "cpus": cpus,
                      "shuffle_partitions": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
