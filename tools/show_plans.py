"""Write PLANS.md: the physical plans of the main pipeline steps (sf0.01).

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from credence.operators import clusters as C  # noqa: E402
from credence.operators import kmeans as KM  # noqa: E402
from credence.operators import sampling as M  # noqa: E402
from credence.operators import tfidf as X  # noqa: E402
from credence.operators import vectors as VF  # noqa: E402
from credence.plans.detector import ClusterDetector  # noqa: E402
from credence.session import local_session, reuse  # noqa: E402
from credence.sources.tables import corpus, table  # noqa: E402


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)                   # drop expression ids
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    lines = [ln if len(ln) < 160 else ln[:157] + "..." for ln in text.splitlines()]
    return "\n".join(lines)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(shuffle_partitions=8)
    c = corpus(spark, sf, by_doc=True)
    n = c.count()
    terms = X.detector_terms(c, keep=("is_fake",))
    tf = X.term_frequencies(terms, keep=("is_fake",))
    vocab = X.fit_vocabulary(tf, n, 2000, 2)
    sparse = VF.sparse_counts(terms, vocab)
    kept = reuse(sparse)
    weights = VF.long_weights(kept, vocab, ("is_fake",))
    scaler = X.fit_scaler(weights, n, len(vocab))
    docs = c.select("doc_id", "is_fake")
    cent = C.fit_class_mean_centroids(X.scaled_weights(weights, scaler.to_df(spark)), docs, len(vocab))
    assigned = KM.nearest(kept, vocab, scaler, cent)
    model = ClusterDetector(vocab, scaler, cent, [r.asDict() for r in C.cluster_distance_stats(assigned).collect()])
    sections = [
        ("Term counts: one hash repartition of the text by doc_id, then no exchange", tf),
        ("Top-K vocabulary: filters before the cut, TakeOrdered for the terms around it only", X.top_terms(tf, 2000, 2)),
        ("Sparse rows: vocabulary ids and counts of each document, no explode", sparse),
        ("A k-means round: nearest centroid in the row, one aggregation by (cluster, term)",
         VF.long_weights(assigned, vocab, ("cluster",)).groupBy("cluster", "term_id").agg({"weight": "sum"})),
        ("Scores: no exchange, k-row statistics broadcast", model.score(corpus(spark, sf))),
        ("The same scores in long form", model.score_long(c)),
        ("Exact sample: first scan, of the key column alone", M._Cuts(table(spark, sf, "documents"), M.hash_key()).values),
        ("Exact sample: filter at the cut of the seeded order", M.sample_exact(table(spark, sf, "documents"), 500)),
    ]
    out = ["# Physical plans (generated by tools/show_plans.py)", "",
           f"Input `{sf}`; `local[*]`, 8 shuffle partitions, AQE on (plans before adaptive re-planning).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
